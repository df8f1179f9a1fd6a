"""IP address validity and global reachability as Column expressions.

The outcome equals Python's ``ipaddress`` (3.13): IANA special-purpose registries with
their more specific exceptions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import compute_once

# Special-purpose address blocks that are not globally reachable, and
# the more specific blocks inside them that are (IANA registries).
IPV4_NOT_GLOBAL = [
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16",
    "172.16.0.0/12", "192.0.0.0/24", "192.0.0.170/31", "192.0.2.0/24", "192.168.0.0/16",
    "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4",
    "255.255.255.255/32",
]
IPV4_GLOBAL_INSIDE = ["192.0.0.9/32", "192.0.0.10/32"]
IPV6_NOT_GLOBAL = [
    "::1/128", "::/128", "::ffff:0:0/96", "64:ff9b:1::/48", "100::/64", "2001::/23",
    "2001:db8::/32", "2002::/16", "fc00::/7", "fe80::/10",
]
IPV6_GLOBAL_INSIDE = [
    "2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48",
    "2001:20::/28", "2001:30::/28",
]

_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4_PATTERN = rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"
_GROUPS = r"[0-9a-f]{1,4}(:[0-9a-f]{1,4})*"


def _v4_number(text: Column) -> Column:
    part = F.split(text, r"\.")
    return reduce(lambda acc, i: acc * 256 + part[i].cast("bigint"), range(1, 4),
                  part[0].cast("bigint"))


def _in_v4(number: Column, block: str) -> Column:
    base, width = block.split("/")
    start = reduce(lambda acc, o: acc * 256 + int(o), base.split("."), 0)
    return number.between(start, start + 2 ** (32 - int(width)) - 1)


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def _v4_global(number: Column) -> Column:
    return (~_any([_in_v4(number, b) for b in IPV4_NOT_GLOBAL])
            | _any([_in_v4(number, b) for b in IPV4_GLOBAL_INSIDE]))


def _group_count(text: Column) -> Column:
    return F.when(text == "", F.lit(0)).otherwise(F.size(F.split(text, ":")))


def _padded(side: Column) -> Column:
    return F.when(side == "", F.lit("")).otherwise(
        F.concat_ws("", F.transform(F.split(side, ":"), lambda g: F.lpad(g, 4, "0"))))


def _side_ok(side: Column) -> Column:
    return (side == "") | side.rlike(f"^{_GROUPS}$")


def _v6_prefix(block: str) -> tuple[str, int]:
    base, width = block.split("/")
    head, _, tail = base.partition("::")
    left = [g for g in head.split(":") if g]
    right = [g for g in tail.split(":") if g]
    groups = left + ["0"] * (8 - len(left) - len(right)) + right
    return "".join(g.zfill(4) for g in groups), int(width)


def _in_v6(digits: Column, block: str) -> Column:
    base, width = _v6_prefix(block)
    whole, rest = divmod(width, 4)
    same = F.substring(digits, 1, whole) == base[:whole] if whole else F.lit(True)
    if rest:
        low = int(base[whole], 16) >> (4 - rest) << (4 - rest)
        allowed = [format(low + i, "x") for i in range(1 << (4 - rest))]
        same = same & F.substring(digits, whole + 1, 1).isin(allowed)
    return same


def classify_ips(df: DataFrame, column: str, out: str = "scope") -> DataFrame:
    """Add ``out``: 'global', 'host_scoped', or NULL when ``column`` is no IP address.

    IPv6 text is brought to 32 hex digits in small projection steps, so that each
    intermediate value is computed once.
    """
    text = F.col(column)
    zone = F.split(F.lower(text), "%")
    quad = F.substring_index(F.col("_a"), ":", -1)
    quad_hex = F.lower(F.lpad(F.hex(_v4_number(F.col("_quad"))), 8, "0"))
    gap = F.instr(F.col("_b"), "::")
    used = F.col("_used")
    mapped = F.conv(F.substring(F.col("_d"), 25, 8), 16, 10).cast("bigint")
    word = lambda flag: F.when(flag, F.lit("global")).otherwise(F.lit("host_scoped"))
    staged = (
        df
        .withColumn("_a", F.when(
            text.contains(":") & ((F.size(zone) == 1)
                                  | ((F.size(zone) == 2) & (F.get(zone, F.lit(1)) != ""))),
            F.get(zone, F.lit(0))))
        .withColumn("_quad", F.when(F.col("_a").contains("."), quad))
        # A dotted tail becomes two hex groups; a malformed one ends the address.
        .withColumn("_b", F.when(F.col("_quad").isNull(), F.col("_a")).when(
            F.col("_quad").rlike(IPV4_PATTERN),
            F.concat(F.substring(F.col("_a"), F.lit(1),
                                 F.length("_a") - F.length("_quad")),
                     F.substring(quad_hex, 1, 4), F.lit(":"), F.substring(quad_hex, 5, 4))))
        .withColumn("_gap", gap)
        .withColumn("_head", F.when(F.col("_gap") > 0, F.substring(
            F.col("_b"), F.lit(1), F.col("_gap") - 1)).otherwise(F.col("_b")))
        .withColumn("_tail", F.when(F.col("_gap") > 0, F.substring(
            F.col("_b"), F.col("_gap") + 2, F.length("_b"))).otherwise(F.lit("")))
        .withColumn("_used", _group_count(F.col("_head")) + _group_count(F.col("_tail")))
        .withColumn("_d", F.when(
            _side_ok(F.col("_head")) & _side_ok(F.col("_tail"))
            & F.when(F.col("_gap") > 0, used <= 7).otherwise(used == 8),
            F.concat(_padded(F.col("_head")),
                     F.repeat(F.lit("0000"), (F.lit(8) - used).cast("int")),
                     _padded(F.col("_tail")))))
        .withColumn("_n", F.when(text.rlike(IPV4_PATTERN), _v4_number(text)).when(
            _in_v6(F.col("_d"), "::ffff:0:0/96"), mapped)))
    # An IPv4-mapped address is as global as the IPv4 address inside it.
    return compute_once(staged, **{out: F.when(
        F.col("_n").isNotNull(), word(_v4_global(F.col("_n")))).when(
        F.col("_d").isNotNull(), word(
            ~_any([_in_v6(F.col("_d"), b) for b in IPV6_NOT_GLOBAL])
            | _any([_in_v6(F.col("_d"), b) for b in IPV6_GLOBAL_INSIDE])))}).drop(
        "_a", "_quad", "_b", "_gap", "_head", "_tail", "_used", "_d", "_n")
