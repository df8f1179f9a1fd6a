"""Registered queries: statistical hunts, motifs, correlation and graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import hunts as H
from ..operators import motifs as M
from ..operators.corroborate import corroborate
from ..operators.cross_source import cross_source_entities
from ..operators.linkage import attach_linkage, entity_linkage
from ..sources.normalize import extract_entities
from .registry import EVENTS_SQL, events, one_source, query, table


@query("rate_spike", f"""
WITH {EVENTS_SQL}, b AS (SELECT "user", CAST(floor(epoch_us(ts_utc) / 86400000000.0) AS BIGINT) * 86400
    AS bucket, count(*) AS count, min(line_no) AS line_no FROM ev GROUP BY ALL),
s AS (SELECT *, avg(count) OVER w AS mean, stddev_pop(count) OVER w AS std FROM b
      WINDOW w AS (PARTITION BY "user"))
SELECT "user", bucket, count, line_no, round((count - mean) / std, 3) AS z FROM s
WHERE std > 0 AND (count - mean) / std >= 3 AND count >= 5""")
def rate_spike(spark, d):
    return H.rate_spike(one_source(spark, d), ["user"], 86400, 3.0, 5).select(
        "user", "bucket", "count", "line_no", F.round("z", 3).alias("z"))


@query("same_key_divergence", f"""
WITH {EVENTS_SQL}, c AS (SELECT "user", event_type, count(*) AS n, avg(value) AS m,
    min(line_no) AS l FROM ev GROUP BY ALL)
SELECT "user", CAST(sum(n) AS BIGINT) AS group_events, min(l) AS line_no,
       round(max(m) / min(m), 3) AS ratio FROM c GROUP BY "user"
HAVING sum(n) >= 50 AND count(m) >= 2 AND max(m) / min(m) >= 3""")
def same_key_divergence(spark, d):
    return H.same_key_divergence(one_source(spark, d), ["user"], "event_type", "value", 50, 3.0).select(
        "user", "group_events", "line_no", F.round("ratio", 3).alias("ratio"))


@query("divergence_cells", f"""
WITH {EVENTS_SQL} SELECT "user", event_type, count(*) AS events, round(avg(value), 6) AS mean,
min(line_no) AS first_line FROM ev GROUP BY ALL""")
def divergence_cells(spark, d):
    return H.divergence_cells(one_source(spark, d), ["user"], "event_type", "value").select(
        "user", "event_type", "events", F.round("mean", 6).alias("mean"), "first_line")


@query("cross_key_same_value", f"""
WITH {EVENTS_SQL} SELECT k, count(DISTINCT "user") AS distinct_keys, count(*) AS total_freq,
  min(line_no) AS line_no, epoch_us(min(ts_utc)) AS first_us, epoch_us(max(ts_utc)) AS last_us
FROM ev WHERE k IS NOT NULL GROUP BY k
HAVING count(DISTINCT "user") >= 2 AND count(*) < 90 AND NOT contains(k, '7')""")
def cross_key_same_value(spark, d):
    return H.cross_key_same_value(one_source(spark, d), "k", ["user"], 2, 90, ["7"]).select(
        "k", "distinct_keys", "total_freq", "line_no", F.unix_micros("first_ts").alias("first_us"),
        F.unix_micros("last_ts").alias("last_us"))


@query("size_outlier", f"""
WITH {EVENTS_SQL}, m AS (SELECT event_type, median(value) AS median, count(*) AS group_events
  FROM ev GROUP BY event_type HAVING count(*) >= 20)
SELECT event_type, line_no, value, group_events, round(median, 4) AS median,
  row_number() OVER (PARTITION BY event_type ORDER BY abs(value - median) DESC, line_no) AS rank
FROM ev JOIN m USING (event_type) WHERE value > median * 3 OR value < median / 3
QUALIFY rank <= 3""")
def size_outlier(spark, d):
    return H.size_outlier(one_source(spark, d), ["event_type"], "value", 20, 3.0, 3).select(
        "event_type", "line_no", "value", "group_events", F.round("median", 4).alias("median"),
        F.col("rank").cast("bigint").alias("rank"))


@query("sequence", f"""
WITH {EVENTS_SQL}, a AS (SELECT "user", count(*) AS n,
    arg_max(ts_utc, (ts_utc, line_no)) AS t0, arg_max(line_no, (ts_utc, line_no)) AS l0
  FROM ev WHERE event_type = 'error' GROUP BY "user" HAVING count(*) >= 5)
SELECT a."user", n AS first_step_count, arg_min(line_no, (ts_utc, line_no)) AS line_no,
  epoch_us(min(ts_utc)) AS final_us
FROM a JOIN ev ON ev."user" = a."user" AND event_type = 'purchase'
  AND (ts_utc > t0 OR (ts_utc = t0 AND line_no > l0)) AND ts_utc <= t0 + INTERVAL 1 DAY
GROUP BY a."user", n""")
def sequence(spark, d):
    steps = [{"field": "event_type", "in": ["error"]}, {"field": "event_type", "in": ["Purchase"]}]
    return M.sequence_motif(one_source(spark, d), ["user"], steps, 86400, 5).select(
        "user", "first_step_count", "line_no", F.unix_micros("final_ts").alias("final_us"))


@query("sequence_three_steps", f"""
WITH {EVENTS_SQL}, a AS (SELECT "user", count(*) AS n,
    arg_max(ts_utc, (ts_utc, line_no)) AS t0, arg_max(line_no, (ts_utc, line_no)) AS l0
  FROM ev WHERE event_type = 'error' GROUP BY "user" HAVING count(*) >= 3),
b AS (SELECT a."user", n, l0, min(ts_utc) AS t1, arg_min(line_no, (ts_utc, line_no)) AS l1
  FROM a JOIN ev ON ev."user" = a."user" AND event_type IN ('view', 'click')
    AND (ts_utc > t0 OR (ts_utc = t0 AND line_no > l0)) AND ts_utc <= t0 + INTERVAL 1 DAY
  GROUP BY ALL)
SELECT b."user", n AS first_step_count, l0, l1, arg_min(line_no, (ts_utc, line_no)) AS line_no
FROM b JOIN ev ON ev."user" = b."user" AND event_type = 'purchase'
  AND (ts_utc > t1 OR (ts_utc = t1 AND line_no > l1)) AND ts_utc <= t1 + INTERVAL 1 DAY
GROUP BY ALL""")
def sequence_three_steps(spark, d):
    steps = [{"field": "event_type", "in": ["error"]}, {"field": "event_type", "in": ["view", "click"]},
             {"field": "event_type", "in": ["purchase"]}]
    return M.sequence_motif(one_source(spark, d), ["user"], steps, 86400, 3).select(
        "user", "first_step_count", F.col("chain_lines")[0].alias("l0"),
        F.col("chain_lines")[1].alias("l1"), "line_no")


@query("periodicity", f"""
WITH {EVENTS_SQL}, g AS (SELECT "user", line_no, ts_utc, (epoch_us(ts_utc) - lag(epoch_us(ts_utc))
    OVER (PARTITION BY "user" ORDER BY ts_utc, line_no)) / 1e6 AS gap FROM ev)
SELECT "user", count(*) AS events, arg_min(line_no, (ts_utc, line_no)) AS line_no,
  round(avg(gap), 3) AS interval_mean, round(stddev_pop(gap) / avg(gap), 4) AS cv
FROM g GROUP BY "user"
HAVING count(*) >= 6 AND sum(gap) >= 300 AND stddev_pop(gap) / avg(gap) <= 0.85""")
def periodicity(spark, d):
    return M.periodicity(one_source(spark, d), ["user"], 6, 0.85, 300).select(
        "user", "events", "line_no", F.round("interval_mean", 3).alias("interval_mean"),
        F.round("cv", 4).alias("cv"))


_IP = r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"


def _document_entities(spark, d):
    docs = table(spark, d, "documents").select(
        F.col("source").alias("source_id"), F.col("doc_id").alias("line_no"),
        F.lit(None).cast("timestamp").alias("ts_utc"),
        F.explode(F.regexp_extract_all("text", F.lit(_IP), F.lit(0))).alias("ip"),
        F.lit(None).cast("string").alias("user"))
    return extract_entities(docs, "ip", ("user",))


_PUBLIC = r"""
ips AS (SELECT source AS source_id, doc_id AS line_no,
    unnest(regexp_extract_all(text, '\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b')) AS ip FROM documents),
oct AS (SELECT *, list_transform(string_split(ip, '.'), lambda x: CAST(x AS INTEGER)) AS o FROM ips),
ok AS (SELECT *, o[1] AS a, o[2] AS b, o[3] AS c, o[4] AS e FROM oct
       WHERE list_max(o) <= 255 AND len(regexp_extract_all(ip, '(^|\.)0\d')) = 0),
sc AS (SELECT source_id, line_no, ip, CASE WHEN a IN (0, 10, 127) OR a >= 240
    OR (a = 100 AND b BETWEEN 64 AND 127) OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31)
    OR (a = 192 AND b = 0 AND c = 2) OR (a = 192 AND b = 0 AND c = 0 AND e NOT IN (9, 10))
    OR (a = 192 AND b = 168) OR (a = 198 AND b IN (18, 19)) OR (a = 198 AND b = 51 AND c = 100)
    OR (a = 203 AND b = 0 AND c = 113) THEN 'host_scoped' ELSE 'global' END AS qualifier FROM ok)
"""


@query("extract_entities", f"""
WITH {_PUBLIC} SELECT source_id, line_no, 'ip:' || ip AS canonical_key, qualifier, count(*) AS n
FROM sc GROUP BY ALL""")
def extract_document_entities(spark, d):
    return _document_entities(spark, d).groupBy(
        "source_id", "line_no", "canonical_key", "qualifier").agg(F.count(F.lit(1)).alias("n"))


@query("entity_lookup", f"""
WITH {_PUBLIC}, pick AS (SELECT min(ip) AS ip FROM sc)
SELECT source_id, line_no, sc.ip AS raw_value FROM sc, pick WHERE sc.ip = pick.ip
ORDER BY source_id, line_no""")
def entity_lookup(spark, d):
    from ..operators.retrieve import entity_lookup as lookup
    entities = _document_entities(spark, d)
    value = entities.agg(F.min("raw_value")).first()[0] or ""
    return lookup(entities, f"ip:{value}").select("source_id", "line_no", "raw_value")


@query("cross_source_entities", f"""
WITH {_PUBLIC}, p AS (SELECT ip, source_id, count(*) AS n, min(line_no) AS l FROM sc
  WHERE qualifier = 'global' GROUP BY ALL)
SELECT 'ip:' || ip AS canonical_key, source_id, n AS occurrences, l AS line_no,
  count(*) OVER (PARTITION BY ip) AS source_count FROM p
QUALIFY source_count >= 2""")
def cross_source(spark, d):
    return cross_source_entities(_document_entities(spark, d)).select(
        "canonical_key", "source_id", "occurrences", "line_no", "source_count")


def _event_entities(spark, d):
    """Accounts and agents of the events as entities."""
    ev = one_source(spark, d)
    return ev.select("source_id", "line_no", "ts_utc", F.explode(F.array(
        F.concat(F.lit("account:"), F.col("user")), F.concat(F.lit("k:"), F.col("k")))).alias(
        "canonical_key")).where(F.col("canonical_key").isNotNull())


def _linkage_sql(rounds: int, result: str, rare: str = "HAVING count(*) > 1") -> str:
    """PageRank by sums per entity; ``result`` is selected from rank (e, pr, n)."""
    parts = [f"""
WITH ent AS MATERIALIZED (
  SELECT 'account:' || user_id AS key, event_id + 1 AS e FROM events
  UNION ALL SELECT 'k:' || json_extract_string(props, '$.k'), event_id + 1 FROM events),
freq AS MATERIALIZED (SELECT key, e, ln(1 + count(*)) AS l FROM ent WHERE key IS NOT NULL GROUP BY ALL),
rare AS MATERIALIZED (SELECT key, count(*) AS df, sum(l) AS s FROM freq GROUP BY key {rare}),
inc AS MATERIALIZED (SELECT key, e, l, 1.0::DOUBLE / df AS w, s FROM rare JOIN freq USING (key)),
node AS MATERIALIZED (SELECT e, sum(w * (s - l)) AS o, sum(w * l) AS own, count(*) OVER () AS n FROM inc GROUP BY e),
r0 AS MATERIALIZED (SELECT e, 1.0::DOUBLE / n AS pr FROM node)"""]
    for i in range(1, rounds + 1):
        parts.append(f"""
s{i} AS MATERIALIZED (SELECT e, CASE WHEN o > 0 THEN pr / o ELSE 0 END AS share, own, n FROM r{i - 1} JOIN node USING (e)),
t{i} AS MATERIALIZED (SELECT key, sum(share) AS t FROM inc JOIN s{i} USING (e) GROUP BY key),
r{i} AS MATERIALIZED (SELECT e, 0.15 / any_value(n) + 0.85 * (sum(w * l * t) - any_value(share * own)) AS pr
  FROM inc JOIN t{i} USING (key) JOIN s{i} USING (e) GROUP BY e)""")
    parts.append(f" rank AS (SELECT e, pr, n FROM r{rounds} JOIN node USING (e))")
    return ",".join(parts) + result


_RELATIVE = " SELECT e AS line_no, round(pr * n, 6) AS relative_score FROM rank"


def _relative(scores):
    nodes = scores.agg(F.count(F.lit(1)).alias("n")).first()[0]
    return scores.select("line_no", F.round(F.col("score") * nodes, 6).alias("relative_score"))


@query("entity_linkage", _linkage_sql(20, _RELATIVE))
def linkage(spark, d):
    return _relative(entity_linkage(_event_entities(spark, d)))


@query("entity_linkage_rarest", _linkage_sql(
    20, _RELATIVE, "HAVING count(*) BETWEEN 2 AND 100 ORDER BY df, key LIMIT 60"))
def linkage_of_rarest(spark, d):
    return _relative(entity_linkage(_event_entities(spark, d), max_entities=60, max_df=100))


@query("attach_linkage", _linkage_sql(20, """
SELECT event_id + 1 AS line_no, coalesce(round(pr, 6), 0) AS linkage_score FROM events
LEFT JOIN rank ON e = event_id + 1 WHERE value > 200"""))
def linkage_of_hits(spark, d):
    hits = one_source(spark, d).where(F.col("value") > 200).select("source_id", "line_no")
    return attach_linkage(hits, entity_linkage(_event_entities(spark, d))).select(
        "line_no", "linkage_score")


def _corroboration(spark, d):
    ev = events(spark, d)
    sources = ev.select("source_id").distinct().select(
        "source_id", F.lit("c").alias("case_id"),
        F.when(F.col("source_id") == "signup", None).otherwise("shop").alias("system"))
    hits = ev.where(F.col("value") > 200).select(F.lit("c").alias("case_id"), "source_id", "line_no")
    return corroborate(hits, ev, sources, 7200, path="k", address="user")


_CORROBORATION = f"""
WITH {EVENTS_SQL}, h AS (SELECT * FROM ev WHERE value > 200),
m AS (SELECT h.source_id AS hs, h.line_no AS hl, ev.source_id, ev.line_no, ev.ts_utc
  FROM h JOIN ev ON ev.source_id <> h.source_id AND ev.source_id <> 'signup'
    AND h.source_id <> 'signup' AND (ev.k = h.k OR ev."user" = h."user")
    AND ev.ts_utc >= h.ts_utc - INTERVAL 2 HOUR AND ev.ts_utc <= h.ts_utc + INTERVAL 2 HOUR),
r AS (SELECT *, row_number() OVER (PARTITION BY hs, hl ORDER BY ts_utc, source_id, line_no) AS rank
  FROM m QUALIFY rank <= 20)
"""


@query("corroborating_events", f"""{_CORROBORATION}
SELECT hs AS hit_source_id, hl AS hit_line_no, rank, source_id, line_no FROM r""")
def corroborating_events(spark, d):
    items = _corroboration(spark, d)[1]
    return items.select("hit_source_id", "hit_line_no", F.col("rank").cast("bigint").alias("rank"),
                        "source_id", "line_no")


@query("corroboration_status", f"""{_CORROBORATION}
SELECT h.source_id, h.line_no, CASE WHEN h.source_id = 'signup' THEN 'no_siblings'
  WHEN count(r.line_no) > 0 THEN 'ok' ELSE 'none' END AS status, count(r.line_no) AS items
FROM h LEFT JOIN r ON r.hs = h.source_id AND r.hl = h.line_no GROUP BY h.source_id, h.line_no""")
def corroboration_status(spark, d):
    return _corroboration(spark, d)[0].select("source_id", "line_no", "status", "items")


@query("stream_rate_buckets", """
SELECT CAST(user_id AS VARCHAR) AS "user", CAST(floor(epoch_us(ts) / 3600000000.0) AS BIGINT) * 3600
  AS bucket, count(*) AS count FROM events
WHERE (floor(epoch_us(ts) / 3600000000.0) + 1) * 3600000000
  <= (SELECT (epoch_us(max(ts)) // 1000 - 600000) * 1000 FROM events) GROUP BY ALL""")
def stream_rate_buckets(spark, d):
    """Runs the stream over all files at hand and returns what it has written."""
    from ..session import new_folder
    from ..streaming.scan import stream_rate_buckets as buckets
    source = table(spark, d, "events")
    stream = (spark.readStream.schema(source.schema).option("pathGlobFilter", "events.parquet")
              .parquet(d).select(F.col("ts").cast("timestamp").alias("ts_utc"),
                                 F.col("user_id").cast("string").alias("user")))
    out = new_folder(spark, "stream")
    (buckets(stream, ["user"], 3600, "10 minutes").writeStream.format("parquet")
     .option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state")
     .outputMode("append").trigger(availableNow=True).start().awaitTermination())
    return spark.read.schema('user string, bucket long, count long').parquet(f"{out}/rows")
