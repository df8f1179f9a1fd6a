"""Registered queries: reading, parsing and normalising log text made from the tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import broadcast_if_small, cut_lineage, new_folder, spread
from ..sources import (
    access_logs, case_parse, descriptors, detect, event_xml, files, iis_logs, multiline,
)
from ..sources import lines as text_lines
from ..sources.normalize import build_events, extract_entities
from ..sources.tables import list_sources, read_stored, write_entities, write_events
from .registry import DOC_LINES_SQL, document_lines, query, table


def access_lines(spark: SparkSession, d: str, combined: bool = True) -> DataFrame:
    """One access log line per event, some of them blank or broken."""
    ev = spread(table(spark, d, "events"), "event_id")
    k, uid = F.get_json_object("props", "$.k"), F.col("user_id").cast("string")
    is_public = F.col("user_id") % 3 != 0
    text = F.concat(
        F.when(is_public, "8.8.4.").otherwise("10.0.0."), uid, F.lit(" - "),
        F.when(F.col("event_type") == "signup", F.concat(F.lit("u"), uid)).otherwise("-"),
        F.lit(" ["), F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss"), F.lit(" +0300] \""),
        F.when(F.col("event_type") == "view", F.lit("-")).otherwise(F.concat(
            F.when(F.col("event_type") == "purchase", "POST").otherwise("GET"),
            F.lit(" /item/"), k,
            F.when(k.cast("int") % 2 == 0, F.concat(F.lit("?id="), F.col("event_id").cast("string"),
                                                    F.lit("&q=a?b"))).otherwise(""),
            F.lit(" HTTP/1.1"))),
        F.lit("\" "), F.when(F.col("event_type") == "error", "404").otherwise("200"), F.lit(" "),
        F.when(F.col("value") < 1, "-").otherwise((F.col("value") * 100).cast("bigint").cast("string")))
    if combined:
        text = F.concat(
            text, F.lit(' "-" "agent/'), k, F.lit('"'),
            F.when(k.cast("int") % 5 == 0, ' "1.2.3.4, 5.6.7.8"')
            .when(k.cast("int") % 7 == 0, " rt=0.5").otherwise(""))
    line = (F.when(F.col("event_id") % 101 == 0, "  ")
            .when(F.col("event_id") % 97 == 0, "broken line")
            .when(F.col("event_id") % 89 == 0, F.replace(text, F.lit("Jan"), F.lit("Foo")))
            .otherwise(text))
    return ev.select(F.col("event_type").alias("source_id"),
                     (F.col("event_id") + 1).alias("line_no"), line.alias("raw"))


_ACCESS_SQL = """
l AS (SELECT *, event_id + 1 AS line_no, json_extract_string(props, '$.k') AS k,
  CAST(json_extract_string(props, '$.k') AS INTEGER) AS ki, event_type = 'view' AS dash,
  CASE WHEN event_id % 101 = 0 THEN 'skip' WHEN event_id % 97 = 0 OR event_id % 89 = 0 THEN 'bad'
       ELSE 'event' END AS kind,
  CASE WHEN user_id % 3 <> 0 THEN '8.8.4.' ELSE '10.0.0.' END || user_id AS ip FROM events)
"""
_ACCESS_COLUMNS = """line_no, kind, ip AS src_ip, CASE WHEN event_type = 'signup' THEN 'u' || user_id END AS "user",
  CASE WHEN dash THEN NULL WHEN event_type = 'purchase' THEN 'POST' ELSE 'GET' END AS method,
  CASE WHEN NOT dash THEN '/item/' || k END AS path,
  CASE WHEN NOT dash AND ki % 2 = 0 THEN 'id=' || event_id || '&q=a?b' END AS query,
  CASE WHEN dash THEN '-' END AS request,
  CASE WHEN event_type = 'error' THEN '404' ELSE '200' END AS status,
  CASE WHEN value >= 1 THEN CAST(CAST(trunc(value * 100) AS BIGINT) AS VARCHAR) END AS bytes,
  '+0300' AS time_offset, epoch_us(date_trunc('second', ts)) AS ts_us"""


def _access_columns(parsed: DataFrame) -> list:
    return ["line_no", "kind",
            *[F.col(f"norm.{f}").alias(f) for f in
              ["src_ip", "user", "method", "path", "query", "status", "bytes"]],
            F.get_json_object("extras", "$.request").alias("request"),
            F.get_json_object("extras", "$.time_offset").alias("time_offset"),
            F.unix_micros(F.col("dt_local").cast("timestamp")).alias("ts_us")]


@query("parse_nginx_combined", f"""
WITH {_ACCESS_SQL} SELECT {_ACCESS_COLUMNS}, 'agent/' || k AS ua,
  CASE WHEN ki % 5 = 0 THEN '1.2.3.4, 5.6.7.8' END AS xff,
  CASE WHEN ki % 5 <> 0 AND ki % 7 = 0 THEN 'rt=0.5' END AS trailing
FROM l WHERE kind = 'event'""")
def parse_nginx(spark, d):
    parsed = access_logs.parse_nginx_combined(access_lines(spark, d))
    return parsed.where(F.col("kind") == "event").select(
        *_access_columns(parsed), F.col("norm.ua").alias("ua"), F.col("norm.xff").alias("xff"),
        F.get_json_object("extras", "$.trailing").alias("trailing"))


@query("parse_apache_common", f"""
WITH {_ACCESS_SQL} SELECT {_ACCESS_COLUMNS} FROM l WHERE kind = 'event'""")
def parse_apache(spark, d):
    parsed = access_logs.parse_apache_common(access_lines(spark, d, combined=False))
    return parsed.where(F.col("kind") == "event").select(*_access_columns(parsed))


@query("parse_kinds", f"""
WITH {_ACCESS_SQL} SELECT event_type AS source_id, kind, count(*) AS n FROM l GROUP BY ALL
UNION ALL SELECT 'common ' || event_type, CASE kind WHEN 'skip' THEN 'skip' ELSE 'bad' END, count(*)
FROM l GROUP BY ALL""")
def parse_kinds(spark, d):
    lines = access_lines(spark, d)
    own = access_logs.parse_nginx_combined(lines)
    other = access_logs.parse_apache_common(lines).withColumn(
        "source_id", F.concat(F.lit("common "), F.col("source_id")))
    return own.unionByName(other).groupBy("source_id", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("parse_raw", f"""
WITH {DOC_LINES_SQL} SELECT source_id, CASE WHEN trim(raw) = '' THEN 'skip' ELSE 'event' END AS kind,
count(*) AS n FROM dl GROUP BY ALL""")
def parse_raw(spark, d):
    return access_logs.parse_raw(document_lines(spark, d)).groupBy("source_id", "kind").agg(
        F.count(F.lit(1)).alias("n"))


@query("parse_report", f"""
WITH {_ACCESS_SQL}, b AS (SELECT event_type, 'L' || line_no || ': ' || CASE WHEN event_id % 97 = 0
    THEN 'no combined log line' ELSE 'unreadable time' END AS s,
    row_number() OVER (PARTITION BY event_type ORDER BY line_no) AS n FROM l WHERE kind = 'bad'
    QUALIFY n <= 10),
s AS (SELECT event_type, string_agg(s, '|' ORDER BY n) AS bad_samples FROM b GROUP BY event_type)
SELECT event_type AS source_id, count(*) AS total_lines,
  sum((kind = 'event')::INT)::BIGINT AS parsed, sum((kind = 'bad')::INT)::BIGINT AS bad_lines,
  sum((kind = 'skip')::INT)::BIGINT AS skipped_lines, any_value(bad_samples) AS bad_samples,
  'parsed' AS status FROM l JOIN s USING (event_type) GROUP BY event_type""")
def parse_report(spark, d):
    report = detect.parse_report(access_logs.parse_nginx_combined(access_lines(spark, d)))
    return report.withColumn("bad_samples", F.concat_ws("|", "bad_samples"))


def _zones(spark, d) -> DataFrame:
    """The declared zone of each source."""
    return table(spark, d, "events").select(F.col("event_type").alias("source_id")).distinct().select(
        "source_id", F.lit("00").alias("sha256"),
        F.when(F.col("source_id") == "click", "Asia/Shanghai")
        .when(F.col("source_id") == "view", "America/New_York")
        .when(F.col("source_id") == "error", "UTC+3:30")
        .when(F.col("source_id") == "signup", "ASIA/Beijing").otherwise("nowhere").alias("tz_declared"))


def _log_events(spark, d) -> DataFrame:
    return build_events(access_logs.parse_nginx_combined(access_lines(spark, d)), _zones(spark, d))


_UTC = """CASE event_type WHEN 'click' THEN -480 WHEN 'view' THEN 300 WHEN 'error' THEN -210
  WHEN 'signup' THEN -480 END"""


@query("normalize_time", f"""
WITH {_ACCESS_SQL} SELECT event_type AS source_id, line_no,
  epoch_us(date_trunc('second', ts)) + ({_UTC})::BIGINT * 60000000 AS ts_us FROM l WHERE kind = 'event'""")
def normalize_time(spark, d):
    return _log_events(spark, d).select("source_id", "line_no", F.unix_micros("ts_utc").alias("ts_us"))


@query("build_entities", f"""
WITH {_ACCESS_SQL} SELECT 'ip:' || ip AS canonical_key, 'ip' AS entity_type,
  CASE WHEN user_id % 3 <> 0 THEN 'global' ELSE 'host_scoped' END AS qualifier, count(*) AS n
FROM l WHERE kind = 'event' AND user_id <= 255 GROUP BY ALL
UNION ALL SELECT 'account:u' || user_id, 'account', 'host_scoped', count(*)
FROM l WHERE kind = 'event' AND event_type = 'signup' GROUP BY ALL""")
def build_entities(spark, d):
    return extract_entities(_log_events(spark, d)).groupBy(
        "canonical_key", "entity_type", "qualifier").agg(F.count(F.lit(1)).alias("n"))


@query("write_and_read_events", f"""
WITH {_ACCESS_SQL} SELECT event_type AS source_id, count(*) AS events,
  sum(CASE WHEN user_id <= 255 THEN 1 ELSE 0 END + (event_type = 'signup')::INT)::BIGINT AS entities
FROM l WHERE kind = 'event' GROUP BY event_type""")
def write_and_read(spark, d):
    """Both tables are written twice; the second write replaces the first."""
    folder = new_folder(spark, "tables")
    events = _log_events(spark, d)
    for _ in range(2):
        write_events(events, f"{folder}/events")
        write_entities(extract_entities(events), f"{folder}/entities")
    count = lambda name: spark.read.parquet(f"{folder}/{name}").groupBy("source_id").agg(
        F.count(F.lit(1)).alias(name))
    return count("events").join(count("entities"), "source_id")


@query("reparse_replaces", f"""
WITH {_ACCESS_SQL} SELECT CASE event_type WHEN 'click' THEN '007' ELSE '7' END AS source_id, count(*) AS events
FROM l WHERE kind = 'event' AND event_type IN ('click', 'purchase') GROUP BY event_type""")
def reparse_replaces(spark, d):
    """Ids 007 and 7 stay apart, and a source parsed to nothing loses its old events."""
    folder = new_folder(spark, "reparsed")
    named = F.when(F.col("source_id") == "click", "007").when(
        F.col("source_id") == "purchase", "7").otherwise(F.col("source_id"))
    parsed = _log_events(spark, d).withColumn("source_id", named)
    sources = parsed.select("source_id").distinct()
    write_events(parsed, folder, sources)
    write_events(parsed.where(F.col("source_id").isin("007", "7")), folder, sources)
    return read_stored(spark, folder, parsed.schema).groupBy("source_id").agg(
        F.count(F.lit(1)).alias("events"))


@query("unregistered_files", """
SELECT 'r' || r_regionkey AS source_id, 1 AS lines FROM region WHERE r_regionkey > 0
UNION ALL SELECT 'unregistered', 1""")
def unregistered(spark, d):
    """One file per region; region 0 is not registered and the rest in another spelling."""
    folder = new_folder(spark, "regions")
    rows = table(spark, d, "region").select(F.col("r_name").alias("value"), "r_regionkey")
    rows.write.partitionBy("r_regionkey").text(folder)
    key = F.regexp_extract("path", r"r_regionkey=(\d+)", 1)
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select(
        F.regexp_replace("path", "^file:/+", "file:///").alias("path"),
        F.concat(F.lit("r"), key).alias("source_id")).where(F.col("source_id") != "r0")
    lines = text_lines.read_log_lines(spark, [folder], listed)
    name = F.when(F.col("source_id").contains("/"), "unregistered").otherwise(F.col("source_id"))
    return lines.groupBy(name.alias("source_id")).agg(F.count(F.lit(1)).alias("lines"))


def iis_lines(spark: SparkSession, d: str) -> DataFrame:
    """W3C lines whose column order changes along the file."""
    ev = spread(table(spark, d, "events"), "event_id")
    moment = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    uid = F.col("user_id").cast("string")
    k = F.get_json_object("props", "$.k")
    size = F.when(F.col("value") < 1, "-").otherwise(F.col("value").cast("int").cast("string"))
    order_a = F.floor((F.col("event_id") - 500) / 1000) % 2 == 0
    directive = F.when(order_a, "#Fields: date time c-ip cs-uri-stem sc-bytes x-k").otherwise(
        "#Fields: date time x-k sc-bytes cs-uri-stem c-ip")
    ip, path = F.concat(F.lit("10.0.0."), uid), F.concat(F.lit("/p/"), k)
    data = F.when(order_a, F.concat_ws(" ", moment, ip, path, size, k)).otherwise(
        F.concat_ws(" ", moment, k, size, path, ip))
    return ev.select(
        F.lit("iis").alias("source_id"), (F.col("event_id") + 1).alias("line_no"),
        F.when(F.col("event_id") % 1000 == 500, directive)
        .when(F.col("event_id") % 97 == 0, F.concat(data, F.lit(" extra"))).otherwise(data).alias("raw"))


@query("parse_iis_w3c", """
SELECT event_id + 1 AS line_no,
  CASE WHEN event_id % 1000 = 500 THEN 'skip' WHEN event_id < 500 OR event_id % 97 = 0 THEN 'bad' ELSE 'event' END AS kind,
  CASE WHEN e THEN '10.0.0.' || user_id END AS src_ip, CASE WHEN e THEN '/p/' || k END AS path,
  CASE WHEN e AND value >= 1 THEN CAST(CAST(trunc(value) AS BIGINT) AS VARCHAR) END AS bytes,
  CASE WHEN e THEN k END AS x_k, CASE WHEN e THEN epoch_us(date_trunc('second', ts)) END AS ts_us
FROM (SELECT *, json_extract_string(props, '$.k') AS k,
  event_id % 1000 <> 500 AND event_id >= 500 AND event_id % 97 <> 0 AS e FROM events)""")
def parse_iis(spark, d):
    return iis_logs.parse_iis_w3c(iis_lines(spark, d)).select(
        "line_no", "kind", F.col("norm.src_ip").alias("src_ip"), F.col("norm.path").alias("path"),
        F.col("norm.bytes").alias("bytes"), F.get_json_object("extras", "$.x-k").alias("x_k"),
        F.unix_micros(F.col("dt_local").cast("timestamp")).alias("ts_us"))


@query("parse_event_xml", """
SELECT event_id + 1 AS line_no, CASE WHEN event_id % 50 = 0 OR event_id % 53 = 0 THEN 'bad' ELSE 'event' END AS kind,
  CASE WHEN e THEN k END AS event_id, CASE WHEN e AND event_type <> 'error' THEN '10.0.0.' || user_id END AS src_ip,
  CASE WHEN e THEN 'u' || user_id END AS "user", CASE WHEN e THEN 'P-' || event_type END AS provider,
  CASE WHEN e THEN epoch_us(date_trunc('second', ts)) END AS ts_us
FROM (SELECT event_id, user_id, event_type, ts, json_extract_string(props, '$.k') AS k,
  event_id % 50 <> 0 AND event_id % 53 <> 0 AS e FROM events)""")
def parse_xml(spark, d):
    ev = spread(table(spark, d, "events"), "event_id")
    uid = F.col("user_id").cast("string")
    xml = F.concat(
        F.lit("<Event xmlns='http://schemas.microsoft.com/win/2004/08/events/event'><System>"
              "<Provider Name='P-"), F.col("event_type"), F.lit("'/><EventID Qualifiers='0'>"),
        F.when(F.col("event_id") % 50 == 0, "none").otherwise(F.get_json_object("props", "$.k")),
        F.lit("</EventID><TimeCreated SystemTime='"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        F.lit("'/></System><EventData><Data Name='IpAddress'>"),
        F.when(F.col("event_type") == "error", "::1").otherwise(F.concat(F.lit("10.0.0."), uid)),
        F.lit("</Data><Data Name='TargetUserName'>u"), uid, F.lit("</Data></EventData></Event"),
        F.when(F.col("event_id") % 53 == 0, "").otherwise(">"))
    records = ev.select(F.lit("sec").alias("source_id"), (F.col("event_id") + 1).alias("line_no"),
                        xml.alias("raw"))
    return event_xml.parse_event_xml(records).select(
        "line_no", "kind", *[F.col(f"norm.{f}").alias(f) for f in
                             ["event_id", "src_ip", "user", "provider"]],
        F.unix_micros("ts_direct").alias("ts_us"))


_AUDIT = {
    "name": "audit-lines", "kind": "regex", "status": "enable",
    "line_regex": r"(?P<t>\S+ \S+) (?P<who>\S+) (?P<what>\w+)(?: on (?P<where>\S+))? #(?P<n>\d+)",
    "field_map": {"t": "ts_raw", "who": "actor", "what": "action", "where": "object"},
    "ts_field": "t", "ts_formats": ["%d.%m.%Y %H:%M", "%Y-%m-%d %H:%M:%S"],
}


@query("parse_descriptor_regex", """
SELECT event_id + 1 AS line_no, CASE WHEN event_id % 71 = 0 THEN 'bad' ELSE 'event' END AS kind,
  CASE WHEN e THEN 'u' || user_id END AS actor, CASE WHEN e THEN event_type END AS action,
  CASE WHEN e AND value >= 10 THEN 'item' || k END AS object, CASE WHEN e THEN k END AS n,
  CASE WHEN e THEN epoch_us(date_trunc('second', ts)) END AS ts_us
FROM (SELECT *, json_extract_string(props, '$.k') AS k, event_id % 71 <> 0 AS e FROM events)""")
def parse_regex(spark, d):
    return descriptors.parse_descriptor(_audit_lines(spark, d), _AUDIT).select(
        "line_no", "kind", F.col("norm.actor").alias("actor"), F.col("norm.action").alias("action"),
        F.col("norm.object").alias("object"), F.get_json_object("extras", "$.n").alias("n"),
        F.unix_micros(F.col("dt_local").cast("timestamp")).alias("ts_us"))


def _audit_lines(spark, d):
    ev = spread(table(spark, d, "events"), "event_id")
    k = F.get_json_object("props", "$.k")
    text = F.concat(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" u"), F.col("user_id").cast("string"),
        F.lit(" "), F.col("event_type"),
        F.when(F.col("value") >= 10, F.concat(F.lit(" on item"), k)).otherwise(""), F.lit(" #"), k)
    return ev.select(F.lit("audit").alias("source_id"), (F.col("event_id") + 1).alias("line_no"),
                     F.when(F.col("event_id") % 71 == 0, F.replace(text, F.lit("2024"), F.lit("year")))
                     .otherwise(text).alias("raw"))


@query("preview_parse", """
WITH l AS (SELECT event_id + 1 AS line_no, event_id % 71 = 0 AS bad FROM events),
c AS (SELECT count(*) AS total, count(*) FILTER (NOT bad) AS good, count(*) FILTER (bad) AS bad FROM l)
SELECT 'total' AS part, total AS value FROM c UNION ALL SELECT 'parsed', good FROM c
UNION ALL SELECT 'bad', bad FROM c UNION ALL SELECT 'skipped', 0 UNION ALL SELECT 'warnings', 0
UNION ALL SELECT 'never matched', 1
UNION ALL (SELECT 'event', line_no FROM l WHERE NOT bad ORDER BY line_no LIMIT 5)
UNION ALL (SELECT 'bad line', line_no FROM l WHERE bad ORDER BY line_no LIMIT 5)""")
def preview(spark, d):
    """Counts and first rows of a descriptor's preview, and one that matches no line."""
    lines = _audit_lines(spark, d)
    seen = descriptors.preview_parse(lines, _AUDIT)
    wrong = descriptors.preview_parse(lines, {**_AUDIT, "line_regex": r"(?P<t>never) (?P<who>matched)",
                                              "field_map": {"t": "ts_raw", "who": "actor"}})
    row = lambda df, name, value: df.select(F.lit(name).alias("part"), value.cast("bigint").alias("value"))
    warned = F.col("warning").isNotNull()
    parts = [row(seen["counts"], name, F.col(column)) for name, column in (
        ("total", "total_lines"), ("parsed", "parsed"), ("bad", "bad_lines"), ("skipped", "skipped_lines"))]
    parts += [row(seen["counts"], "warnings", warned), row(wrong["counts"], "never matched", warned),
              row(seen["events"], "event", F.col("line_no")), row(seen["bad"], "bad line", F.col("line_no"))]
    return reduce(DataFrame.unionByName, parts)


_JSON = {
    "name": "json-lines", "kind": "json", "status": "enable",
    "field_map": {"time": "ts_raw", "user_id": "actor", "event_type": "action"},
    "ts_field": "time", "ts_formats": ["%Y-%m-%d %H:%M:%S"],
}


@query("parse_descriptor_json", """
SELECT event_id + 1 AS line_no, CASE WHEN event_id % 61 = 0 THEN 'bad' ELSE 'event' END AS kind,
  CASE WHEN e THEN CAST(user_id AS VARCHAR) END AS actor, CASE WHEN e THEN event_type END AS action,
  CASE WHEN e THEN epoch_us(date_trunc('second', ts)) END AS ts_us
FROM (SELECT *, event_id % 61 <> 0 AS e FROM events)""")
def parse_json(spark, d):
    ev = spread(table(spark, d, "events"), "event_id")
    text = F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("time"), "user_id",
                              "event_type", "value"))
    lines = ev.select(F.lit("json").alias("source_id"), (F.col("event_id") + 1).alias("line_no"),
                      F.when(F.col("event_id") % 61 == 0, F.concat(F.lit("["), text, F.lit("]")))
                      .otherwise(text).alias("raw"))
    return descriptors.parse_descriptor(lines, _JSON).select(
        "line_no", "kind", F.col("norm.actor").alias("actor"), F.col("norm.action").alias("action"),
        F.unix_micros(F.col("dt_local").cast("timestamp")).alias("ts_us"))


_CSV = {
    "name": "csv-lines", "kind": "csv", "status": "enable", "csv": {"delimiter": ";", "header": True},
    "field_map": {"when": "ts_raw", "who": "actor", "what": "message"},
    "ts_field": "when", "ts_formats": ["%Y-%m-%d %H:%M:%S"],
}


@query("parse_descriptor_csv", """
SELECT source_id, kind, count(*) AS n, CAST(sum(hash_key) AS BIGINT) AS key_sum FROM (
  SELECT event_type AS source_id, user_id AS hash_key, CASE
    WHEN row_number() OVER (PARTITION BY event_type ORDER BY event_id) = 1 THEN 'skip'
    WHEN event_id % 59 = 0 THEN 'bad' ELSE 'event' END AS kind FROM events)
GROUP BY source_id, kind""")
def parse_csv(spark, d):
    ev = spread(table(spark, d, "events"), "event_id")
    # The first line of each source is its header: a row with the smallest line number.
    first = cut_lineage(ev.groupBy("event_type").agg(F.min("event_id").alias("_first")))
    text = F.concat_ws(";", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.col("user_id").cast("string"),
                       F.concat(F.lit('"a;b '), F.col("props").substr(3, 1), F.lit('"')),
                       F.col("value").cast("string"))
    lines = ev.join(broadcast_if_small(first, 100), "event_type").select(
        F.col("event_type").alias("source_id"), (F.col("event_id") + 1).alias("line_no"), F.when(
            F.col("event_id") == F.col("_first"), "when;who;what;size").when(
            F.col("event_id") % 59 == 0, F.concat(text, F.lit(";x"))).otherwise(text).alias("raw"))
    parsed = descriptors.parse_descriptor(lines, _CSV)
    users = ev.select((F.col("event_id") + 1).alias("line_no"), "user_id")
    return (parsed.join(users, "line_no").groupBy("source_id", "kind").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(
            F.col("norm.actor").cast("bigint"), F.col("user_id"))).alias("key_sum")))


_BLOCKS_SQL = f"""
{DOC_LINES_SQL},
t AS (SELECT *, regexp_matches(raw, '^[A-E]') AS s FROM dl WHERE trim(raw) <> ''),
b AS (SELECT *, last_value(CASE WHEN s THEN line_no END IGNORE NULLS) OVER (PARTITION BY source_id
  ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS start FROM t)
"""


@query("merge_multiline", f"""
WITH {_BLOCKS_SQL} SELECT source_id, start AS line_no, count(*) - 1 AS continuation_lines,
  md5(string_agg(raw, chr(10) ORDER BY line_no)) AS digest FROM b WHERE start IS NOT NULL
GROUP BY source_id, start""")
def merge_blocks(spark, d):
    return multiline.merge_multiline(document_lines(spark, d), "[A-E]").select(
        "source_id", "line_no", F.col("continuation_lines").cast("bigint").alias("continuation_lines"),
        F.md5("raw").alias("digest"))


@query("stray_lines", f"""
WITH {_BLOCKS_SQL} SELECT source_id, line_no FROM b WHERE start IS NULL""")
def stray(spark, d):
    return multiline.stray_lines(document_lines(spark, d), "[A-E]").select("source_id", "line_no")


@query("merge_multiline_capped", f"""
WITH RECURSIVE {_BLOCKS_SQL},
-- Places in a block and characters up to each line.
n AS (SELECT source_id, start, line_no, length(raw) AS size,
        row_number() OVER w AS i, sum(length(raw)) OVER w AS upto
      FROM b WHERE start IS NOT NULL WINDOW w AS (PARTITION BY source_id, start ORDER BY line_no)),
-- The part that begins at a line ends before the first line that breaks a limit.
j AS (SELECT x.source_id, x.start, x.i, min(y.i) AS next FROM n x LEFT JOIN n y
        ON y.source_id = x.source_id AND y.start = x.start AND y.i > x.i
        AND (y.i - x.i > 3 OR y.upto - x.upto + x.size > 400)
      GROUP BY x.source_id, x.start, x.i),
part AS (SELECT source_id, start, i, next FROM j WHERE i = 1
  UNION ALL SELECT p.source_id, p.start, j.i, j.next FROM part p JOIN j
    ON j.source_id = p.source_id AND j.start = p.start AND j.i = p.next)
SELECT p.source_id, n.line_no,
  (coalesce(p.next, (SELECT max(i) + 1 FROM n m WHERE m.source_id = p.source_id AND m.start = p.start))
   - p.i - 1)::INT AS continuation_lines,
  p.next IS NOT NULL AS truncated, p.i > 1 AS orphan
FROM part p JOIN n ON n.source_id = p.source_id AND n.start = p.start AND n.i = p.i""")
def merge_capped(spark, d):
    """Blocks that the limits cut; the tests also compare them with a plain loop."""
    return multiline.merge_multiline(document_lines(spark, d), "[A-E]", 3, 400).select(
        "source_id", "line_no", "continuation_lines", "truncated", "orphan")


@query("read_log_lines", f"""
WITH {DOC_LINES_SQL} SELECT CAST(substr(source_id, 5) AS BIGINT) AS doc_id, count(*) AS lines,
  true AS adjacent, true AS in_order FROM dl GROUP BY source_id""")
def read_lines(spark, d):
    """Documents written as text files and read back by line number: the lines of one
    document lie next to each other and in order."""
    folder = new_folder(spark, "text")
    docs = table(spark, d, "documents")
    (docs.select(F.col("doc_id"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
     .select(F.format_string("%d %d %s", "doc_id", "pos", "line").alias("value"))
     .write.text(folder))
    read = text_lines.read_log_lines(spark, folder)
    part = F.split("raw", " ", 3)
    numbered = read.select("source_id", "line_no", part[0].cast("bigint").alias("doc_id"),
                           part[1].cast("bigint").alias("pos"))
    return numbered.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("lines"),
        (F.max("line_no") - F.min("line_no") + 1 == F.count(F.lit(1))).alias("adjacent"),
        (F.max(F.col("line_no") - F.col("pos")) == F.min(F.col("line_no") - F.col("pos")))
        .alias("in_order"))


@query("file_inventory", """
SELECT n_nationkey, sha256(n_name || chr(10)) AS actual,
  CASE n_nationkey WHEN 3 THEN 'mismatch' ELSE 'ok' END AS state
FROM nation WHERE n_nationkey <> 5 UNION ALL SELECT 99, NULL, 'missing'""")
def inventory(spark, d):
    """One text file per nation; the registry has an altered hash and a lost file, and lacks one."""
    folder = new_folder(spark, "nations")
    table(spark, d, "nation").select(F.col("n_name").alias("value"), "n_nationkey").write.partitionBy(
        "n_nationkey").text(folder)
    found = files.file_inventory(spark, folder)
    key = F.regexp_extract("path", r"n_nationkey=(\d+)", 1)
    gone = spark.range(1).select(F.lit(f"{folder}/n_nationkey=99/part").alias("path"), F.lit("0").alias("sha256"))
    registry = found.where(key != "5").select("path", F.when(key == "3", "0").otherwise(
        F.col("sha256")).alias("sha256")).unionByName(gone)
    return files.verify_files(found, registry).select(
        key.cast("int").alias("n_nationkey"), "actual", "state")


@query("distinct_contents", """
SELECT sha256(n_regionkey || chr(10)) AS sha256, count(*) AS copies FROM nation GROUP BY n_regionkey""")
def contents(spark, d):
    """One file per nation that holds its region's number: five contents."""
    folder = new_folder(spark, "contents")
    table(spark, d, "nation").select(
        F.col("n_regionkey").cast("string").alias("value"), "n_nationkey").write.partitionBy(
        "n_nationkey").text(folder)
    return files.distinct_contents(files.file_inventory(spark, folder)).select("sha256", "copies")


@query("malformed_bytes", """
SELECT doc_id, text || chr(65533) AS raw FROM documents WHERE lang = 'en' AND NOT regexp_matches(text, '[^ -~]')""")
def malformed_bytes(spark, d):
    """GBK lines that end in half a character: it becomes U+FFFD and the line stays."""
    docs = table(spark, d, "documents").where((F.col("lang") == "en") & ~F.col("text").rlike("[^ -~]"))
    data = F.concat(F.col("text").cast("binary"), F.lit(bytearray([0x81])))
    return docs.select("doc_id", text_lines.decode(data, "gbk").alias("raw"))


@query("parse_case", f"""
WITH {_ACCESS_SQL}, c AS (SELECT event_type AS source_id, count(*) AS total_lines,
    sum((kind = 'event')::INT)::BIGINT AS parsed FROM l WHERE event_type IN ('click', 'error') GROUP BY 1)
SELECT source_id, 'parsed' AS status, NULL AS reason, total_lines, parsed, parsed AS stored FROM c
UNION ALL SELECT 'view', 'parsed', NULL, count(*), sum((event_id % 101 <> 0)::INT)::BIGINT,
  sum((event_id % 101 <> 0)::INT)::BIGINT FROM events WHERE event_type = 'view'
UNION ALL SELECT 'signup', 'parsed', NULL, count(*), count(*), count(*) FROM events WHERE event_type = 'signup'
UNION ALL SELECT 'purchase', 'failed', 'file altered', NULL, NULL, 0
UNION ALL SELECT 'gone', 'failed', 'file missing', NULL, NULL, 0""")
def parse_case(spark, d):
    """Files of four formats, one altered and one lost file; events are stored and counted."""
    folder = new_folder(spark, "case")
    named = _case_files(spark, d, folder)
    lost = named.limit(1).withColumns({"path": F.concat("path", F.lit(".gone")), "source_id": F.lit("gone")})
    altered = named.withColumn("sha256", F.when(
        F.col("source_id") == "purchase", "0").otherwise(F.col("sha256")))
    report = case_parse.parse_case(spark, altered.unionByName(lost), f"{folder}/stored", _OWN_JSON)
    return _with_stored(spark, report, folder).select(
        "source_id", "status", "reason", "total_lines", "parsed", "stored")


_OWN_JSON = {"own-json": {"name": "own-json", "kind": "json", "ts_field": "t",
                          "ts_formats": ["%Y-%m-%d %H:%M:%S"], "field_map": {"t": "ts_raw"}}}


def _case_files(spark, d, folder):
    """The sources of a case, written from the events table: one file of each event type."""
    ev = table(spark, d, "events")
    kind = F.col("source_id")
    rows = access_lines(spark, d).where(kind.isin("click", "purchase", "view")).unionByName(
        access_lines(spark, d, combined=False).where(kind == "error")).unionByName(
        ev.where(F.col("event_type") == "signup").select(
            F.col("event_type").alias("source_id"), (F.col("event_id") + 1).alias("line_no"),
            F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("t"),
                               F.col("user_id").cast("string").alias("u"))).alias("raw")))
    rows.repartition(8, "source_id").sortWithinPartitions("source_id", "line_no").select(
        F.col("raw").alias("value"), "source_id").write.partitionBy("source_id").text(f"{folder}/raw")
    found = files.file_inventory(spark, f"{folder}/raw").select("path", "sha256").withColumn(
        "source_id", F.regexp_extract("path", r"source_id=([^/]+)/", 1))
    return found.select(
        "path", "source_id", "sha256", F.lit("UTC").alias("tz_declared"),
        F.when(F.col("source_id") == "error", "apache_common").when(
            F.col("source_id") == "view", "raw").when(
            F.col("source_id") == "signup", "own-json").otherwise("nginx_combined").alias("format_id"))


def _with_stored(spark, report, folder):
    stored = spark.read.parquet(f"{folder}/stored/events").groupBy("source_id").agg(
        F.count(F.lit(1)).alias("stored"))
    return report.join(stored, "source_id", "left").withColumn("stored", F.coalesce("stored", F.lit(0)))


@query("reparse_altered_keeps", f"""
WITH {_ACCESS_SQL}, c AS (SELECT event_type AS source_id, sum((kind = 'event')::INT)::BIGINT AS stored
    FROM l WHERE event_type IN ('click', 'error', 'purchase') GROUP BY 1
  UNION ALL SELECT 'view', sum((event_id % 101 <> 0)::INT)::BIGINT FROM events WHERE event_type = 'view'
  UNION ALL SELECT 'signup', count(*) FROM events WHERE event_type = 'signup')
SELECT source_id, CASE WHEN source_id IN ('purchase', 'view', 'signup') THEN 'failed' ELSE 'parsed' END AS status,
  CASE source_id WHEN 'purchase' THEN 'file altered' WHEN 'view' THEN 'file missing'
    WHEN 'signup' THEN 'unknown format' END AS reason, stored
FROM c""")
def reparse_altered_keeps(spark, d):
    """A case parsed twice: what the second parse refuses keeps the rows of the first."""
    folder = new_folder(spark, "case")
    named = _case_files(spark, d, folder)
    case_parse.parse_case(spark, named, f"{folder}/stored", _OWN_JSON)
    kind = F.col("source_id")
    later = named.withColumns({
        "sha256": F.when(kind == "purchase", "0").otherwise(F.col("sha256")),
        "path": F.when(kind == "view", F.concat("path", F.lit(".gone"))).otherwise(F.col("path"))})
    report = case_parse.parse_case(spark, later, f"{folder}/stored")
    return _with_stored(spark, report, folder).select("source_id", "status", "reason", "stored")


@query("detect_formats", f"""
WITH {_ACCESS_SQL}, head AS (SELECT kind FROM l WHERE kind <> 'skip' ORDER BY line_no LIMIT 50)
SELECT 'nginx' AS source_id, 1 AS rank, 'nginx_combined' AS format_id,
  (SELECT round(avg((kind = 'event')::INT), 4) FROM head) AS confidence, 'ok' AS verdict
UNION ALL SELECT * FROM (VALUES ('common', 1, 'apache_common', 1.0, 'ok'),
  ('iis', 1, 'iis_w3c', 1.0, 'ok'), ('prose', NULL, NULL, NULL, 'unknown'))""")
def detect_written(spark, d):
    """Four kinds of files written from the tables; each head is tried with every parser."""
    folder = new_folder(spark, "detect")
    kinds = {
        "nginx": access_lines(spark, d).where(~F.col("raw").rlike(r"^\s*$")),
        "common": access_lines(spark, d, combined=False).where(F.col("raw").rlike("2024:.*[0-9-]$")),
        "iis": iis_lines(spark, d).where(F.col("line_no") > 500),
        "prose": document_lines(spark, d).orderBy("source_id", "line_no"),
    }
    for name, lines in kinds.items():
        lines.orderBy("line_no").select("raw").write.text(f"{folder}/{name}")
    sample = files.sample_heads(spark, folder)
    kind = F.regexp_extract("source_id", r"/([a-z]+)/part-[^/]*$", 1)
    first = sample.select("source_id").withColumn("kind", kind).groupBy("kind").agg(
        F.min("source_id").alias("source_id"))
    best = detect.detect_formats(sample.join(first, "source_id", "left_semi"))
    return best.where(F.coalesce("rank", F.lit(1)) == 1).select(
        kind.alias("source_id"), "rank", "format_id", "confidence", "verdict")


@query("list_sources", f"""
WITH {_ACCESS_SQL} SELECT event_type AS source_id, sum((kind = 'event')::INT)::BIGINT AS parsed,
  sum((kind = 'bad')::INT)::BIGINT AS bad_lines FROM l GROUP BY event_type""")
def sources_with_report(spark, d):
    report = detect.parse_report(access_logs.parse_nginx_combined(access_lines(spark, d)))
    old = report.withColumn("parsed", F.lit(0).cast("bigint")).withColumn("run_ts", F.lit(1))
    reports = report.withColumn("run_ts", F.lit(2)).unionByName(old)
    return list_sources(_zones(spark, d), reports).select(
        "source_id", F.col("parse_report.parsed").alias("parsed"),
        F.col("parse_report.bad_lines").alias("bad_lines"))


@query("stream_signature_scan", """
SELECT rule_id, matched_field, matched_value, count(*) AS n FROM (
  SELECT event_id, 'odd-path' AS rule_id, 'path' AS matched_field, '/item/4' AS matched_value FROM events
  WHERE event_type <> 'view' AND starts_with(json_extract_string(props, '$.k'), '4')
    AND event_id % 101 <> 0 AND event_id % 97 <> 0 AND event_id % 89 <> 0)
GROUP BY ALL""")
def stream_signatures(spark, d):
    """Log files dropped into a folder, scanned as a stream into a table."""
    from ..streaming.scan import stream_log_lines, stream_signature_scan
    folder = new_folder(spark, "drop")
    access_lines(spark, d).select("raw").write.text(f"{folder}/in")
    rule = {"id": "odd-path", "severity": "low", "target": "web", "match": {"path": ["/item/4"]}}
    found = stream_signature_scan(stream_log_lines(spark, f"{folder}/in"), [rule])
    (found.writeStream.format("parquet").option("path", f"{folder}/out")
     .option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
     .awaitTermination())
    hits = spark.read.schema(found.schema).parquet(f"{folder}/out")
    return hits.groupBy("rule_id", "matched_field", "matched_value").agg(F.count(F.lit(1)).alias("n"))
