import ipaddress
import random

from pyspark.sql import functions as F

from caselens.functions import columns as C
from caselens.functions.addresses import classify_ips


def _expected(text):
    try:
        return "global" if ipaddress.ip_address(text).is_global else "host_scoped"
    except ValueError:
        return None


def test_address_scope_equals_python(spark):
    rnd = random.Random(7)
    texts = ["8.8.8.8", "10.1.2.3", "100.64.0.1", "192.0.0.9", "192.0.0.170", "224.0.0.1",
             "01.2.3.4", "1.2.3", "256.1.1.1", "1.2.3.4 ", "", "-", "abc", "::", "::1", "1::",
             ":1", "1:", ":::", "1::2::3", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8",
             "1:2:3:4:5:6:7:8:9", "1:2:3:4::5:6:7:8", "2001:db8::1", "2001:4:112::9", "2001:3::1",
             "2001:1::1", "2001:1::3", "fe80::1%eth0", "fe80::1%", "fe80::1%a%b", "::ffff:8.8.8.8",
             "::ffff:10.0.0.1", "64:ff9b::1.2.3.4", "64:ff9b:1::1", "3fff::1", "2606:4700::1111",
             "::1.2.3.400", "1.2.3.4::", "12345::", "g::1", "2001:2f::1", "2001:30::1", "FE80::1",
             "2002::1", "fd00::1", "255.255.255.255", "203.0.113.9", "198.19.0.1", "172.32.0.1"]
    for _ in range(600):
        texts.append(".".join(str(rnd.randint(0, 260)) for _ in range(4)))
        groups = [format(rnd.choice([0, 1, rnd.randint(0, 65535), 0x2001, 0xfe80]), "x")
                  for _ in range(rnd.randint(1, 9))]
        text = ":".join(groups)
        if rnd.random() < 0.7:
            text = text.replace(":", "::", 1)
        texts.append(text)
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for row in classify_ips(df, "t", "s").collect():
        assert row.s == _expected(row.t), row.t


def test_redact_masks_in_order(spark):
    texts = ["Authorization: Bearer abc.def", "password=hunter2, next", "token : 'x y'",
             "key sk-abcdefgh12 tail", "plain text stays", 'api_key="q"']
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(C.redact(F.col("t"))).collect()]
    assert got == ["Authorization: *** ***", "password=***, next", "token : '*** y'",
                   "key sk-*** tail", "plain text stays", 'api_key="***"']


def test_number_is_strict(spark):
    df = spark.createDataFrame([(t,) for t in ["1d", "1_000", " 12 ", "nan", "", "-3.5e2", ".5"]],
                               "t string")
    assert [r[0] for r in df.select(C.number(F.col("t"))).collect()] == [
        None, None, 12.0, None, None, -350.0, 0.5]
