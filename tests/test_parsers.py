import hashlib
import json
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from caselens.sources.access_logs import parse_apache_common, parse_nginx_combined, parse_raw
from caselens.sources.descriptors import (
    DescriptorError, parse_descriptor, preview_parse, validate_descriptor)
from caselens.sources.event_xml import parse_event_xml
from caselens.sources.iis_logs import parse_iis_w3c
from caselens.sources.lines import read_log_lines, tail_lines, view_lines
from caselens.sources.multiline import merge_multiline
from caselens.sources.normalize import build_events, extract_entities
from caselens.sources.tables import write_events


def lines_df(spark, texts, source="s"):
    return spark.createDataFrame([(source, i + 1, t) for i, t in enumerate(texts)],
                                 "source_id string, line_no long, raw string")


def outcome(df):
    return {r.line_no: r for r in df.collect()}


GOOD = '8.8.8.8 - bob [10/Oct/2023:13:55:36 +0300] "GET /a?x=1?2 HTTP/1.1" 200 123 "-" "curl/8"'


def test_combined_lines(spark):
    rows = outcome(parse_nginx_combined(lines_df(spark, [
        GOOD, "", "   ", "broken", GOOD.replace("10/Oct", "41/Oct"), GOOD.replace("bob", "-"),
        GOOD.replace("GET /a?x=1?2 HTTP/1.1", "-"), GOOD + ' "1.2.3.4, 5.6.7.8"',
        GOOD + ' "no address"', GOOD.replace(" 123 ", " - "), GOOD.replace("curl", "cu\u0001rl"),
        GOOD.replace("10/Oct", "10/oct"), GOOD.replace("GET /a?x=1?2 HTTP/1.1", "GET  /a HTTP/1.1"),
        GOOD.replace("GET /a?x=1?2 HTTP/1.1", "GET /a"), GOOD.replace("13:55:36", "13:55:61")])))
    assert [rows[i].kind for i in range(1, 16)] == [
        "event", "skip", "skip", "bad", "bad", "event", "event", "event", "event", "event", "event",
        "event", "event", "event", "bad"]
    first = rows[1]
    assert (first.norm.src_ip, first.norm.user, first.norm.method, first.norm.path,
            first.norm.query, first.norm.status, first.norm.bytes, first.norm.referer,
            first.norm.ua) == ("8.8.8.8", "bob", "GET", "/a", "x=1?2", "200", "123", None, "curl/8")
    assert first.dt_local == datetime(2023, 10, 10, 13, 55, 36)
    assert json.loads(first.extras) == {"protocol": "HTTP/1.1", "time_offset": "+0300"}
    assert rows[5].ts_raw.startswith("41/Oct")
    assert rows[6].norm.user is None
    assert rows[7].norm.method is None and json.loads(rows[7].extras)["request"] == "-"
    assert rows[8].norm.xff == "1.2.3.4, 5.6.7.8"
    assert json.loads(rows[9].extras)["trailing"] == '"no address"'
    assert rows[10].norm.bytes is None
    assert rows[11].norm.ua == "cu\u0001rl/8"
    assert json.loads(rows[13].extras)["request"] == "GET  /a HTTP/1.1"
    assert "protocol" not in json.loads(rows[14].extras)


def test_common_and_combined_are_told_apart(spark):
    common = GOOD.split(' "-"')[0]
    df = lines_df(spark, [common, GOOD])
    assert [r.kind for r in parse_apache_common(df).orderBy("line_no").collect()] == ["event", "bad"]
    assert [r.kind for r in parse_nginx_combined(df).orderBy("line_no").collect()] == ["bad", "event"]


def test_raw_keeps_every_non_blank_line(spark):
    rows = outcome(parse_raw(lines_df(spark, ["a", " ", "é　"])))
    assert [rows[i].kind for i in (1, 2, 3)] == ["event", "skip", "event"]
    assert rows[1].norm.src_ip is None and rows[1].dt_local is None


@pytest.mark.parametrize("block", [2, 65536])
def test_iis_directives_order_columns(spark, block, monkeypatch):
    import caselens.operators.ordered as ordered
    monkeypatch.setattr(ordered.carry_forward, "__defaults__", (False, block))
    rows = outcome(parse_iis_w3c(lines_df(spark, [
        "2024-01-01 00:00:00 early", "#Software: x", "#Fields: date time c-ip sc-status x-odd",
        "2024-01-01 00:00:01 1.2.3.4 200 v", "2024-01-01 00:00:01 1.2.3.4 200", "",
        "#fields: sc-status date time cs-username", "- 2024-13-01 00:00:02 bob",
        "abc 2024-01-01 00:00:03 -"])))
    assert [rows[i].kind for i in range(1, 10)] == [
        "bad", "skip", "skip", "event", "bad", "skip", "skip", "bad", "event"]
    assert rows[4].norm.src_ip == "1.2.3.4" and rows[4].norm.status == "200"
    assert json.loads(rows[4].extras) == {"x-odd": "v"}
    assert json.loads(rows[9].extras) == {"sc-status": "abc"} and rows[9].norm.user is None
    assert rows[9].dt_local == datetime(2024, 1, 1, 0, 0, 3)


def test_event_records(spark):
    xml = ("<Event xmlns='http://schemas.microsoft.com/win/2004/08/events/event'><System>"
           "<Provider Name='Sec'/><EventID Qualifiers='1'>4624</EventID><Level>0</Level>"
           "<TimeCreated SystemTime='{t}'/><EventRecordID>7</EventRecordID><Channel>Security</Channel>"
           "<Computer>PC</Computer></System><EventData><Data Name='IpAddress'>{ip}</Data>"
           "<Data Name='TargetUserName'>amy</Data><Data Name='IpPort'>55</Data>"
           "<Data Name='IpPort'>66</Data><Data>loose</Data></EventData></Event>")
    rows = outcome(parse_event_xml(lines_df(spark, [
        xml.format(t="2024-05-01T10:00:00.1234567Z", ip="9.9.9.9"), xml.format(t="odd", ip="::1"),
        "<Event>", "", xml.replace("4624", "x").format(t="", ip=""), "<Event><Other/></Event>"])))
    assert [rows[i].kind for i in range(1, 7)] == ["event", "event", "bad", "bad", "bad", "bad"]
    one = rows[1]
    assert (one.norm.event_id, one.norm.src_ip, one.norm.user, one.norm.ipport, one.norm.level,
            one.norm.channel, one.norm.provider, one.norm.computer) == (
        "4624", "9.9.9.9", "amy", "55", "0", "Security", "Sec", "PC")
    assert one.ts_direct == datetime(2024, 5, 1, 10, 0, 0, 123456)
    assert json.loads(one.extras) == {
        "event_data": {"IpAddress": "9.9.9.9", "TargetUserName": "amy", "IpPort": "55"},
        "event_data_unnamed": ["loose"], "event_record_id": "7"}
    assert rows[2].norm.src_ip is None and rows[2].ts_direct is None and rows[2].ts_raw == "odd"


def test_event_records_of_odd_shapes(spark):
    ok = "<System><EventID>1</EventID></System>"
    user = ("<e:Event xmlns:e='q'><e:System><EventID> +012 </EventID><EventID>5</EventID><Level>x</Level>"
            "</e:System><System/><EventData><Data Name='Q'>e</Data></EventData><e:UserData>"
            "<Data Name='Q'>w</Data><Data>z</Data><T>007</T><T>8</T><U a='1'> 1 &lt; 2 </U>"
            "<V><N>in</N></V><X/><Y><![CDATA[05]]></Y></e:UserData></e:Event>\n<!-- end -->")
    texts = [user, f"<Event>{ok}</Event> junk", f"<Event>{ok}</Event", None, "  \n", "no xml",
             "<Event><System><EventID><b>3</b></EventID></System></Event>", f"<Event>{ok}</Event>\n",
             "<?xml version='1.0'?><Event/>"]
    rows = outcome(parse_event_xml(lines_df(spark, texts)))
    assert [rows[i].reason for i in range(1, 10)] == [
        None, "malformed XML", "malformed XML", "record without XML", "record without XML",
        "malformed XML", "EventID missing or not an integer", None, "no System section"]
    assert rows[1].norm.event_id == "12" and rows[1].norm.level is None
    assert json.loads(rows[1].extras) == {"event_data": {"Q": "e", "T": "007", "U": "1 < 2", "Y": "05"},
                                          "event_data_unnamed": ["z"]}
    assert rows[8].extras is None and rows[8].ts_direct is None
    times = ["2024-05-01T10:00:00Z", "2024-05-01 10:00:00.5", "2024-05-01T10:00+0200", "2024-05-01",
             "2024-13-01T00:00:00Z", "10:00:00", "2024", "2024-05-01T10:00:00Z later", ""]
    stamped = outcome(parse_event_xml(lines_df(spark, [
        f"<Event><System><EventID>1</EventID><TimeCreated SystemTime='{t}'/></System></Event>"
        for t in times])))
    assert [stamped[i].ts_direct for i in range(1, 10)] == [
        datetime(2024, 5, 1, 10), datetime(2024, 5, 1, 10, 0, 0, 500_000), datetime(2024, 5, 1, 8),
        datetime(2024, 5, 1), None, None, None, None, None]
    plan = parse_event_xml(lines_df(spark, texts))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InPandas" not in plan and "Exchange" not in plan


REGEX = {"name": "app", "kind": "regex", "status": "enable",
         "line_regex": r"(?P<ts>\S+ \S+) (?P<level>\w+)(?: \[(?P<tag>\w+)\])? (?P<message>.*)",
         "field_map": {"ts": "ts_raw", "level": "level", "message": "message"},
         "ts_field": "ts", "ts_formats": ["%m-%d %H:%M:%S", "%Y-%m-%d %H:%M:%S"]}


def test_regex_descriptor_with_blocks(spark):
    spec = REGEX | {"multiline": {"start_regex": r"\d", "max_continuation_lines": 2}}
    rows = outcome(parse_descriptor(lines_df(spark, [
        "stray", "2024-01-01 00:00:00 ERROR [db] failed", " at a", "", " at b", " at c", " at d",
        "04-27 16:26:48 INFO fine", "9 nothing"]), spec))
    assert [rows[i].kind for i in (1, 2, 4, 6, 8, 9)] == ["bad", "event", "skip", "bad", "event", "bad"]
    assert rows[2].raw == "2024-01-01 00:00:00 ERROR [db] failed\n at a\n at b"
    assert rows[2].continuation_lines == 2
    assert json.loads(rows[2].extras) == {"tag": "db", "multiline_truncated": True}
    assert rows[6].raw == " at c\n at d" and "continuation without" in rows[6].reason
    assert rows[8].dt_local == datetime(1900, 4, 27, 16, 26, 48) and rows[8].extras is None


def test_json_and_csv_descriptors(spark):
    spec = {"name": "j", "kind": "json", "field_map": {"t": "ts_raw", "u": "actor", "n": "status"},
            "ts_field": "t", "ts_formats": ["%Y"]}
    rows = outcome(parse_descriptor(lines_df(spark, [
        '{"t": 2024, "u": "x", "n": 5, "more": [1]}', "[1]", "{", '{"u": 1}', '{"t": null}']), spec))
    assert [rows[i].kind for i in range(1, 6)] == ["event", "bad", "bad", "bad", "bad"]
    assert rows[1].norm.status == "5" and json.loads(rows[1].extras) == {"more": [1]}
    spec = {"name": "c", "kind": "csv", "csv": {"delimiter": ",", "header": True},
            "field_map": {"时间": "ts_raw", "人": "actor"}, "ts_field": "时间", "ts_formats": ["%Y-%m-%d"]}
    rows = outcome(parse_descriptor(lines_df(spark, [
        "", "时间,人,其他", '2024-02-03,"a, b",z', "2024-02-03,a"]), spec))
    assert [rows[i].kind for i in range(1, 5)] == ["skip", "skip", "event", "bad"]
    assert rows[3].norm.actor == "a, b" and json.loads(rows[3].extras) == {"其他": "z"}
    counts = preview_parse(lines_df(spark, ["{", "["]), {**spec, "kind": "json"})["counts"].first()
    assert counts.bad_lines == 2 and counts.warning


def test_bad_descriptors_are_refused():
    for change in ({"kind": "xml"}, {"name": "Bad Name"}, {"extra": 1}, {"ts_formats": []},
                   {"line_regex": "("}, {"line_regex": "abc"}, {"field_map": {"ts": "odd"}},
                   {"ts_field": "level"}, {"encoding": "nope"}, {"status": "on"},
                   {"multiline": {"start_regex": "x", "max_block_bytes": 5}}):
        with pytest.raises(DescriptorError):
            validate_descriptor(REGEX | change)


def _loop(texts, starts, max_cont, max_chars):
    """Plain walk over one file: (first line, lines, truncated, orphan)."""
    out, block = [], None
    for no, text in enumerate(texts, 1):
        if not text.strip():
            continue
        if text[0] in starts:
            if block:
                out.append((*block[:2], False, block[3]))
            block = [no, 1, len(text), False]
        elif block:
            if block[1] > max_cont or block[2] + len(text) > max_chars:
                out.append((*block[:2], True, block[3]))
                block = [no, 1, len(text), True]
            else:
                block[1] += 1
                block[2] += len(text)
    if block:
        out.append((*block[:2], False, block[3]))
    return sorted(out)


@pytest.mark.parametrize("giant", [{}, {"lines_per_task": 12, "piece_lines": 5},
                                   {"lines_per_task": 3, "piece_lines": 17}])
def test_blocks_equal_a_plain_walk(spark, giant):
    import random
    rnd = random.Random(3)
    texts = [rnd.choice(["S start", "c " + "x" * rnd.randint(0, 30), "", "d"]) if i != 50 else "S"
             for i in range(400)] + [rnd.choice(["c", "c " + "y" * rnd.randint(0, 70), " "]) for _ in range(90)]
    got = merge_multiline(lines_df(spark, texts), "S", 4, 60, **giant).collect()
    assert sorted((r.line_no, r.continuation_lines + 1, r.truncated, r.orphan) for r in got) == _loop(
        texts, "S", 4, 60)


def test_giant_blocks_of_several_sources_are_cut_in_rounds(spark):
    rnd = random.Random(5)
    texts = {s: ["S"] + ["c" * rnd.randint(0, 25) for _ in range(n)] for s, n in
             (("a", 700), ("b", 40), ("c", 9), ("d", 0), ("e", 333))}
    rows = [(s, i, t) for s, own in texts.items() for i, t in enumerate(own, 1)]
    lines = spark.createDataFrame(rows, "source_id string, line_no long, raw string").repartition(3)
    got = merge_multiline(lines, "S", 4, 60, lines_per_task=8, piece_lines=5).collect()
    for source, own in texts.items():
        assert sorted((r.line_no, r.continuation_lines + 1, r.truncated, r.orphan) for r in got
                      if r.source_id == source) == _loop(own, "S", 4, 60)


def test_line_numbers_do_not_depend_on_splits(spark, tmp_path):
    texts = [f"line {i} " + "y" * (i % 37) for i in range(1, 5001)]
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.log").write_bytes("\n".join(texts).encode() + b"\r\nlast\rreal last\n")
    (folder / "b.log").write_bytes("第一\n".encode("gbk") + b"ok\n")
    paths = {r.path: r.source_id for r in spark.read.format("binaryFile").load(str(folder)).select(
        "path", F.regexp_extract("path", r"([ab])\.log", 1).alias("source_id")).collect()}
    sources = spark.createDataFrame(
        [(p, s, "gbk" if s == "b" else None) for p, s in paths.items()],
        "path string, source_id string, encoding string")
    results = []
    for size in ("128m", "7000"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        got = read_log_lines(spark, str(folder), sources)
        results.append(sorted((r.source_id, r.line_no, r.raw) for r in got.collect()))
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert results[0] == results[1]
    assert results[0][:5000] == [("a", i + 1, t) for i, t in enumerate(texts)]
    assert results[0][5000:] == [("a", 5001, "last"), ("a", 5002, "real last"), ("b", 1, "第一"),
                                 ("b", 2, "ok")]
    assert [r.line_no for r in view_lines(got, "a", 10, 3).collect()] == [11, 12, 13]
    only_b = got.where("source_id = 'b'")
    assert [r.raw for r in tail_lines(only_b, 1, "OK").collect()] == ["ok"]


def test_lines_are_a_snapshot(spark, tmp_path):
    log = tmp_path / "a.log"
    log.write_text("".join(f"line {i}\n" for i in range(1, 2001)))
    before = dict(spark.sparkContext.getConf().getAll()), spark.conf.get(
        "spark.sql.files.minPartitionNum", None)
    lines = read_log_lines(spark, str(tmp_path))
    with log.open("a") as more:
        more.write("appended later\n" * 50)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    got = sorted((r.line_no, r.raw) for r in lines.collect())
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [(i, f"line {i}") for i in range(1, 2001)]
    assert read_log_lines(spark, str(tmp_path)).count() == 2050
    after = dict(spark.sparkContext.getConf().getAll()), spark.conf.get(
        "spark.sql.files.minPartitionNum", None)
    assert before == after  # reading does not change the session


def test_a_path_of_two_sources_is_refused(spark, tmp_path):
    (tmp_path / "a.log").write_text("x\n")
    sources = spark.createDataFrame([(f"file:{tmp_path}/a.log", "1"), (f"{tmp_path}/a.log", "2")],
                                    "path string, source_id string")
    with pytest.raises(ValueError, match="2 sources"):
        read_log_lines(spark, str(tmp_path), sources)


def test_time_zones_and_entities(spark, tmp_path):
    names = ["Asia/Shanghai", "America/New_York", "asia/beijing", "UTC+3:30", "-0500", "UTC+99", "",
             None, "GMT+8", "nowhere"]
    sources = spark.createDataFrame([(str(i), n, "h") for i, n in enumerate(names)],
                                    "source_id string, tz_declared string, sha256 string")
    line = GOOD.replace("10/Oct/2023:13:55:36", "10/Mar/2024:02:30:00")
    df = None
    for i in range(len(names)):
        part = lines_df(spark, [line], str(i))
        df = part if df is None else df.unionByName(part)
    events = build_events(parse_nginx_combined(df), sources)
    got = {int(r.source_id): r.ts_utc for r in events.collect()}
    at = lambda d, h, m: datetime(2024, 3, d, h, m)
    assert got == {0: at(9, 18, 30), 1: at(10, 7, 30), 2: at(9, 18, 30), 3: at(9, 23, 0),
                   4: at(10, 7, 30), 5: None, 6: None, 7: None, 8: at(9, 18, 30), 9: None}
    entities = {(r.canonical_key, r.qualifier) for r in extract_entities(events).collect()}
    assert entities == {("ip:8.8.8.8", "global"), ("account:bob", "host_scoped")}
    path = str(tmp_path / "events")
    assert write_events(events, path) == 10
    assert write_events(events.where("source_id = '3'"), path) == 1
    assert spark.read.parquet(path).count() == 10


def test_a_source_list_that_changes_when_read_again(spark, tmp_path):
    """Each reading of the list names another lost file: it is missing, not looked for."""
    from uuid import uuid4

    from caselens.sources.case_parse import parse_case
    (tmp_path / "a.log").write_text("x\n")
    lost = F.udf(lambda: f"{tmp_path}/{uuid4().hex}.log").asNondeterministic()
    here = hashlib.sha256(b"x\n").hexdigest()
    sources = spark.createDataFrame(
        [("a", here), ("gone", here)], "source_id string, sha256 string").select(
        F.when(F.col("source_id") == "a", f"{tmp_path}/a.log").otherwise(lost()).alias("path"),
        "source_id", "sha256", F.lit("raw").alias("format_id"), F.lit("UTC").alias("tz_declared"))
    report = {r.source_id: (r.status, r.reason) for r in parse_case(
        spark, sources, f"{tmp_path}/stored").collect()}
    assert report == {"a": ("parsed", None), "gone": ("failed", "file missing")}


def test_a_preview_parses_the_sample_once(spark):
    """Lines that are other texts each time they are made look the same in every reading."""
    from uuid import uuid4
    spec = {"name": "n", "kind": "regex", "line_regex": r"(?P<t>\S+ \S+) (?P<who>\S+)",
            "field_map": {"t": "ts_raw", "who": "actor"}, "ts_field": "t",
            "ts_formats": ["%Y-%m-%d %H:%M:%S"]}
    made = F.udf(lambda: f"2024-01-01 24:00:00 {uuid4()}" if uuid4().int % 2
                 else f"2024-01-01 10:00:00 {uuid4()}").asNondeterministic()
    lines = spark.range(40).select(F.lit("s").alias("source_id"), "id").select(
        "source_id", F.col("id").alias("line_no"), made().alias("raw"))
    seen = preview_parse(lines, spec, 40)
    events, bad = seen["events"].collect(), seen["bad"].collect()
    counts = seen["counts"].first()
    assert (counts.total_lines, counts.parsed, counts.bad_lines) == (40, len(events), len(bad))
    assert sorted(r.line_no for r in events + bad) == list(range(40))
    assert seen["events"].collect() == events
    assert {r.norm.actor for r in events} == {r.raw.split()[-1] for r in events}


def test_csv_lines_stay_in_their_tasks(spark):
    """The header of a source goes to its lines; a source of any size is many tasks."""
    from caselens.plans.parsing import parse_csv
    plan = parse_csv(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(event_type" not in plan
