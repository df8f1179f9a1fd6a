"""Registered queries: search, windows, statistics, lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import iso, number, redact
from ..operators import retrieve as R
from ..operators.explain import explain
from ..operators.ordered import carry_forward
from ..session import spread
from .registry import DOC_LINES_SQL, EVENTS_SQL, document_lines, events, one_source, query, table


@query("search_text", f"""
WITH {DOC_LINES_SQL} SELECT source_id, line_no, raw FROM dl WHERE contains(raw, 'the on')
ORDER BY source_id, line_no LIMIT 50 OFFSET 10""")
def search_text(spark, d):
    return R.search(document_lines(spark, d), q="the on", limit=50, offset=10)


@query("search_text_total", f"""
WITH {DOC_LINES_SQL} SELECT count(*) AS total FROM dl WHERE contains(raw, 'the on')""")
def search_text_total(spark, d):
    return R.search_total(document_lines(spark, d), q="the on")


@query("search_text_literal", """
SELECT doc_id, n_chars FROM documents WHERE contains(text, '%') OR contains(text, '_x')""")
def search_text_literal(spark, d):
    docs = table(spark, d, "documents")
    found = R.apply_filters(docs, q="%", text="text").select("doc_id", "n_chars")
    return found.unionByName(R.apply_filters(docs, q="_x", text="text").select(
        "doc_id", "n_chars")).distinct()


@query("search_fields", f"""
WITH {EVENTS_SQL} SELECT source_id, line_no, epoch_us(ts_utc) AS ts_us, value FROM ev
WHERE k = '42' AND contains(event_type, 'ic') AND ts_utc >= TIMESTAMP '2024-01-05 08:00:00'
  AND ts_utc <= TIMESTAMP '2024-01-25 00:00:00' ORDER BY source_id, line_no LIMIT 50""")
def search_fields(spark, d):
    return R.search(events(spark, d), fields="", field_filters={
        "k": {"eq": 42}, "event_type": {"contains": "ic"}},
        ts_from="2024-01-05T09:00:00+01:00", ts_to="2024-01-25T00:00:00").select(
        "source_id", "line_no", F.unix_micros("ts_utc").alias("ts_us"), "value")


@query("case_scope", f"""
WITH {EVENTS_SQL} SELECT source_id, count(*) AS n FROM ev
WHERE source_id IN ('click', 'error') GROUP BY source_id""")
def case_scope(spark, d):
    ev = events(spark, d)
    sources = ev.select("source_id").distinct().withColumn("case_id", F.when(
        F.col("source_id").isin("click", "error"), "c1").otherwise("c2"))
    return R.scan_events(ev, sources, "c1").groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))


@query("read_window", """
SELECT l_orderkey AS line_no, l_linenumber, l_quantity FROM lineitem
WHERE l_orderkey BETWEEN 100 AND 140""")
def read_window(spark, d):
    lines = table(spark, d, "lineitem").select(
        F.lit("lineitem").alias("source_id"), F.col("l_orderkey").alias("line_no"),
        "l_linenumber", "l_quantity")
    return R.read_window(lines, "lineitem", 100, 140).drop("source_id")


@query("time_slice", f"""
WITH {EVENTS_SQL} SELECT line_no, value FROM ev WHERE source_id = 'error'
AND line_no BETWEEN 1 AND 240""")
def time_slice(spark, d):
    return R.time_slice(events(spark, d), "error", 90, 100, 150).select("line_no", "value")


@query("lines_around", f"""
WITH {EVENTS_SQL}, a AS (SELECT line_no AS anchor_line FROM ev WHERE value > 300)
SELECT anchor_line, line_no, value FROM ev, a
WHERE line_no BETWEEN greatest(1, anchor_line - 40) AND anchor_line + 60""")
def lines_around(spark, d):
    ev = one_source(spark, d).select("source_id", "line_no", "value")
    anchors = ev.where(F.col("value") > 300).select("source_id", F.col("line_no").alias("anchor_line"))
    return R.lines_around(ev, anchors, 40, 60).select("anchor_line", "line_no", "value")


@query("source_stats", f"""
WITH {EVENTS_SQL} SELECT source_id, count(*) AS events, epoch_us(min(ts_utc)) AS ts_min,
epoch_us(max(ts_utc)) AS ts_max FROM ev GROUP BY source_id""")
def source_stats(spark, d):
    return R.source_stats(events(spark, d)).select(
        "source_id", "events", F.unix_micros("ts_min").alias("ts_min"),
        F.unix_micros("ts_max").alias("ts_max"))


@query("top_values", f"""
WITH {EVENTS_SQL}, c AS (SELECT source_id, "user" AS value, count(*) AS count FROM ev GROUP BY ALL)
SELECT source_id, value, count, row_number() OVER (PARTITION BY source_id
  ORDER BY count DESC, value) AS rank FROM c QUALIFY rank <= 10""")
def top_values(spark, d):
    return R.top_values(events(spark, d), "user").withColumn("rank", F.col("rank").cast("bigint"))


@query("aggregate", f"""
WITH {EVENTS_SQL} SELECT k AS value, count(*) AS count FROM ev
WHERE event_type = 'error' AND k IS NOT NULL GROUP BY k ORDER BY count DESC, value LIMIT 20""")
def aggregate(spark, d):
    return R.aggregate(events(spark, d), "k", fields="", field_filters={"event_type": "error"})


@query("aggregate_total", f"""
WITH {EVENTS_SQL} SELECT count(*) AS total_events FROM ev WHERE event_type = 'error'""")
def aggregate_total(spark, d):
    return R.aggregate_total(events(spark, d), fields="", field_filters={"event_type": "error"})


@query("host_distribution", r"""
SELECT regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS value, count(*) AS count
FROM pages GROUP BY 1 ORDER BY count DESC, value LIMIT 1000""")
def host_distribution(spark, d):
    pages = table(spark, d, "pages").select(
        F.regexp_extract("url", r"^[a-z]+://([^/:?#]+)", 1).alias("host"))
    return R.aggregate(pages, "host", fields="", limit=1000)


@query("ts_coverage", f"""
WITH {EVENTS_SQL} SELECT source_id, count(*) AS events, count(CASE WHEN value >= 5 THEN ts_utc END)
AS with_ts FROM ev GROUP BY source_id""")
def ts_coverage(spark, d):
    return R.ts_coverage(events(spark, d).withColumn(
        "ts_utc", F.when(F.col("value") >= 5, F.col("ts_utc"))))


@query("event_order", f"""
WITH {EVENTS_SQL} SELECT "user", line_no,
  row_number() OVER (PARTITION BY "user" ORDER BY ts_utc, line_no) AS pos FROM ev""")
def event_order(spark, d):
    """Positions inside each key, read off the rows in the order in which they come."""
    from pyspark.sql import Window

    from ..operators.motifs import event_series
    placed = event_series(one_source(spark, d), ["user"]).withColumn(
        "_at", F.monotonically_increasing_id())
    return placed.select("user", "line_no", F.row_number().over(
        Window.partitionBy("user").orderBy("_at")).cast("bigint").alias("pos"))


@query("viewer_lines", f"""
WITH {DOC_LINES_SQL} SELECT line_no, raw FROM dl WHERE source_id = 'doc-7' AND line_no BETWEEN 3 AND 12""")
def viewer_lines(spark, d):
    from ..sources.lines import view_lines
    return view_lines(document_lines(spark, d), "doc-7", 2, 10).drop("source_id")


@query("tail_lines", f"""
WITH {DOC_LINES_SQL}, t AS (SELECT line_no, raw FROM dl WHERE source_id = 'doc-0'
  ORDER BY line_no DESC LIMIT 20)
SELECT line_no, raw FROM t WHERE contains(lower(raw), 'une')""")
def tail_lines(spark, d):
    from ..sources.lines import tail_lines as tail
    lines = document_lines(spark, d).where(F.col("source_id") == "doc-0")
    return tail(lines, 20, " UNE ").drop("source_id")


@query("error_types", r"""
WITH t AS (SELECT event_id, CASE WHEN user_id % 3 = 0 THEN 'app.' || upper(substr(event_type, 1, 1))
    || substr(event_type, 2) || 'Error' ELSE event_type || 'Exception' END AS name
  FROM events ORDER BY event_id DESC LIMIT 100)
SELECT name, count(*) AS count FROM t GROUP BY name""")
def error_types(spark, d):
    ev = table(spark, d, "events")
    name = F.when(F.col("user_id") % 3 == 0, F.concat(
        F.lit("app."), F.initcap("event_type"), F.lit("Error"))).otherwise(
        F.concat("event_type", F.lit("Exception")))
    lines = ev.select((F.col("event_id") + 1).alias("line_no"),
                      F.concat(F.lit("failed: "), name, F.lit(" at x, no Errors")).alias("raw"))
    return R.error_type_counts(lines)


@query("redact", r"""
SELECT doc_id, md5(m) AS digest, m <> text AS masked FROM (SELECT doc_id, text,
  regexp_replace(regexp_replace(regexp_replace(text, '\bBearer\s+\S+', 'Bearer ***', 'gi'),
  '\b(authorization|cookie|set-cookie|api[_-]?key|password|passwd|token|secret)(\s*[:=]\s*)(["'']?)[^\s,"''\]]+',
  '\1\2\3***', 'gi'), '\bsk-[A-Za-z0-9_\-]{6,}', 'sk-***', 'gi') AS m FROM documents)""")
def redact_documents(spark, d):
    docs = spread(table(spark, d, "documents").select("doc_id", "text")).select(
        "doc_id", "text", redact(F.col("text")).alias("m"))
    return docs.select("doc_id", F.md5("m").alias("digest"), (F.col("m") != F.col("text")).alias("masked"))


@query("explain_path", """
SELECT host, count(*) AS pages, sum(CASE WHEN c THEN 1 ELSE 0 END)::BIGINT AS covered FROM (
  SELECT regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host,
         contains(lower(url), 'example') OR contains(lower(url), '/en') AS c FROM pages)
GROUP BY host""")
def explain_path(spark, d):
    pages = table(spark, d, "pages").select(
        "url", F.regexp_extract("url", r"^[a-z]+://([^/:?#]+)", 1).alias("host"))
    out = explain(pages, "url", "path", [("example", "example host"), ("/EN", "English page")])
    return out.groupBy("host").agg(F.count(F.lit(1)).alias("pages"),
                                   F.count_if("covered").alias("covered"))


@query("explain_status", """
SELECT s AS status, count(*) AS n, max(CASE s WHEN '404' THEN 'missing' WHEN '200' THEN 'fine' END)
  AS explanation FROM (SELECT CASE event_type WHEN 'error' THEN '404' WHEN 'view' THEN '200'
  ELSE '2000' END AS s FROM events) GROUP BY s""")
def explain_status(spark, d):
    status = F.when(F.col("event_type") == "error", "404").when(
        F.col("event_type") == "view", "200").otherwise("2000")
    out = explain(table(spark, d, "events").select(status.alias("status")), "status", "status",
                  [("404", "missing"), ("200", "fine")])
    return out.groupBy("status").agg(F.count(F.lit(1)).alias("n"),
                                     F.max("explanation").alias("explanation"))


@query("explain_builtin", """
WITH v AS (SELECT event_id, 'HTTP://h/' || CASE event_type WHEN 'click' THEN 'Admin/x' WHEN 'view' THEN '.git/config'
    WHEN 'signup' THEN 'wp-login.php?a=/admin' ELSE 'item' END AS path,
  CASE event_type WHEN 'error' THEN 'sqlmap/1.4 Mozilla/5.0' WHEN 'purchase' THEN 'Mozilla/5.0 X' ELSE '  ' END AS ua
  FROM events)
SELECT kind, value, count(*) AS n, min(explanation) AS explanation FROM (
  SELECT 'path' AS kind, path AS value, CASE WHEN path LIKE '%wp-login%'
    THEN 'WordPress sign-in page; look at failures and where they come from.'
    WHEN path LIKE '%Admin%' THEN 'Administration path; check the status for successful access.'
    WHEN path LIKE '%.git%' THEN 'Git metadata; any success leaks source code.' END AS explanation FROM v
  UNION ALL SELECT 'ua', ua, CASE WHEN ua LIKE 'sqlmap%' THEN 'SQL injection tool; check what its requests returned.'
    WHEN ua LIKE 'Moz%' THEN 'Prefix of every common browser; ordinary baseline.' END FROM v)
GROUP BY kind, value""")
def explain_builtin(spark, d):
    """The built-in entries: the first listed token that occurs in a value explains it."""
    kind = F.col("event_type")
    path = (F.when(kind == "click", "Admin/x").when(kind == "view", ".git/config")
            .when(kind == "signup", "wp-login.php?a=/admin").otherwise("item"))
    agent = F.when(kind == "error", "sqlmap/1.4 Mozilla/5.0").when(
        kind == "purchase", "Mozilla/5.0 X").otherwise("  ")
    ev = table(spark, d, "events")
    parts = [explain(ev.select(F.lit(name).alias("kind"), value.alias("value")), "value", name)
             for name, value in (("path", F.concat(F.lit("HTTP://h/"), path)), ("ua", agent))]
    return parts[0].unionByName(parts[1]).groupBy("kind", "value").agg(
        F.count(F.lit(1)).alias("n"), F.min("explanation").alias("explanation"))


@query("numbers", r"""
SELECT event_id, CASE event_id % 6 WHEN 0 THEN value WHEN 1 THEN -value WHEN 2 THEN event_id * 1000.0 END AS number
FROM events""")
def numbers(spark, d):
    """Plain numbers of texts, with signs, blanks and exponents; other texts have none."""
    ev = table(spark, d, "events")
    text, case = F.col("value").cast("string"), F.col("event_id") % 6
    written = (F.when(case == 0, F.concat(F.lit(" "), text)).when(case == 1, F.concat(F.lit("-"), text))
               .when(case == 2, F.concat(F.col("event_id").cast("string"), F.lit("e3 ")))
               .when(case == 3, F.concat(F.lit("0x"), F.col("event_id").cast("string")))
               .when(case == 4, F.lit("NaN")).otherwise(""))
    return ev.select("event_id", number(written).alias("number"))


@query("iso_times", """
SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z' AS iso FROM events""")
def iso_times(spark, d):
    return table(spark, d, "events").select("event_id", iso(F.col("ts").cast("timestamp")).alias("iso"))


@query("carry_forward", f"""
WITH {EVENTS_SQL} SELECT line_no, last_value(CASE WHEN event_type = 'signup' THEN line_no END IGNORE NULLS)
  OVER (ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_signup FROM ev""")
def last_signup_before(spark, d):
    ev = one_source(spark, d)
    return carry_forward(ev, ["source_id"], "line_no", F.when(
        F.col("event_type") == "signup", F.col("line_no")), "last_signup", strict=True).select(
        "line_no", "last_signup")
