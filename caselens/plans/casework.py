"""Registered queries: rule scans, review, windows, journal and custody."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import custody, findings, journal, review, rounds, scan, signatures, windows
from ..operators.retrieve import hit_id, hits_total, list_hits
from ..rules import builtin_rules
from ..schema import HITS
from ..session import cut_lineage, new_folder
from ..sources.access_logs import parse_nginx_combined
from ..sources.normalize import build_events, extract_entities
from ..sources.tables import case_overview
from .parsing import _ACCESS_SQL, _zones, access_lines
from .registry import DOC_LINES_SQL, EVENTS_SQL, document_lines, events, one_source, query, table

_TOKENS = {"first": ["the on", "ent"], "second": ["zzz", "ion"], "both": ["the", "of"]}
_RULES = [
    {"id": "first", "severity": "high", "target": "any", "match": {"raw": ["the on", "ent"]}},
    {"id": "second", "severity": "low", "target": "web", "match": {"raw": ["zzz", "ion"]}},
    {"id": "both", "severity": "info", "target": "any",
     "match": {"path": ["doc-1"], "raw": ["the", "of"]}},
]


def _document_events(spark: SparkSession, d: str) -> DataFrame:
    return document_lines(spark, d).withColumn("ts_utc", F.lit(None).cast("timestamp"))


def _document_sources(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("source_id"),
        F.when(F.col("lang") == "en", "web").otherwise("audit").alias("log_type"))


@query("signature_scan", f"""
WITH {DOC_LINES_SQL}, x AS (SELECT dl.*, lower(raw) AS lo, d.lang FROM dl
  JOIN documents d ON dl.source_id = 'doc-' || d.doc_id)
SELECT source_id, line_no, 'first' AS rule_id, 'raw' AS matched_field,
  CASE WHEN contains(lo, 'the on') THEN 'the on' ELSE 'ent' END AS matched_value, substr(raw, 1, 300) AS snippet
FROM x WHERE contains(lo, 'the on') OR contains(lo, 'ent')
UNION ALL SELECT source_id, line_no, 'second', 'raw', CASE WHEN contains(lo, 'zzz') THEN 'zzz' ELSE 'ion' END,
  substr(raw, 1, 300) FROM x WHERE lang = 'en' AND (contains(lo, 'zzz') OR contains(lo, 'ion'))
UNION ALL SELECT source_id, line_no, 'both', 'path', 'doc-1', substr(raw, 1, 300) FROM x
WHERE contains(source_id, 'doc-1') AND (contains(lo, 'the') OR contains(lo, 'of'))""")
def signature_scan(spark, d):
    found = signatures.signature_scan(
        _document_events(spark, d), _document_sources(spark, d), _RULES,
        {"raw": "raw", "path": "source_id"})
    return found.select("source_id", "line_no", "rule_id", "matched_field", "matched_value", "snippet")


_EVENT_HITS_SQL = f"""
{EVENTS_SQL},
h AS (SELECT source_id, line_no, 'large' AS rule_id, 'high' AS severity, 'value' AS matched_field,
    CAST(CAST(trunc(value) AS BIGINT) AS VARCHAR) AS matched_value, 'Large value of ' || "user" AS snippet FROM ev WHERE value > 100
  UNION ALL SELECT source_id, line_no, 'seven', 'info', 'k', k, 'agent ' || k FROM ev WHERE contains(k, '7'))
"""


def _event_hits(spark: SparkSession, d: str) -> DataFrame:
    """Hits of two simple rules over the events, as candidates of a scan."""
    ev = events(spark, d)
    build = lambda df, rule, severity, field, value, text: df.select(
        "source_id", "line_no", F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"),
        F.lit(field).alias("matched_field"), value.alias("matched_value"), text.alias("snippet"),
        "ts_utc", F.lit(None).cast("string").alias("detail"))
    large = build(ev.where(F.col("value") > 100), "large", "high", "value",
                  F.col("value").cast("bigint").cast("string"),
                  F.concat(F.lit("Large value of "), F.col("user")))
    seven = build(ev.where(F.col("k").contains("7")), "seven", "info", "k", F.col("k"),
                  F.concat(F.lit("agent "), F.col("k")))
    return large.unionByName(seven)


def _stored_hits(spark: SparkSession, d: str) -> DataFrame:
    return _event_hits(spark, d).withColumn("status", F.lit("pending")).withColumn(
        "round_no", F.when(F.col("rule_id") == "large", 1)).withColumn("case_id", F.lit("c"))


_CAPS = {"large": 40, "seven": 25}


@query("apply_budget", f"""
WITH {_EVENT_HITS_SQL} SELECT rule_id, source_id, line_no FROM h
QUALIFY row_number() OVER (PARTITION BY rule_id ORDER BY source_id, line_no)
  <= CASE rule_id WHEN 'large' THEN 40 ELSE 25 END""")
def apply_budget(spark, d):
    return scan.apply_budget(_event_hits(spark, d), _CAPS).select("rule_id", "source_id", "line_no")


@query("mark_budget", f"""
WITH {_EVENT_HITS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY source_id, line_no) AS n FROM h)
SELECT rule_id, source_id, line_no, n <= CASE rule_id WHEN 'large' THEN 40 ELSE 25 END AS within_budget FROM r""")
def mark_budget(spark, d):
    return scan.mark_budget(_event_hits(spark, d), _CAPS).select(
        "rule_id", "source_id", "line_no", "within_budget")


@query("append_hits_two_cases", f"""
WITH {_EVENT_HITS_SQL} SELECT 'a' AS case_id, 1 AS round_no, rule_id, count(*) AS n FROM h GROUP BY rule_id
UNION ALL SELECT 'b', 1, rule_id, count(*) FROM h WHERE rule_id = 'large' GROUP BY rule_id""")
def append_hits_two_cases(spark, d):
    """Round 1 of a second case leaves round 1 of the first; a round without hits goes."""
    folder = new_folder(spark, "hits")
    hits = _event_hits(spark, d).select("*", F.lit("pending").alias("status"),
                                        F.lit(True).alias("within_budget"))
    named = lambda case, no: hits.withColumns(
        {"case_id": F.lit(case), "round_no": F.lit(no)}).select(*HITS.fieldNames())
    scan.append_hits(named("a", 1), folder)
    scan.append_hits(named("b", 1).where(F.col("rule_id") == "large"), folder)
    scan.append_hits(named("a", 2), folder)
    scan.append_hits(named("a", 2).limit(0), folder, "a", 2)
    return scan.stored_hits(spark, folder).groupBy("case_id", "round_no", "rule_id").agg(
        F.count(F.lit(1)).alias("n"))


@query("budget_report", f"""
WITH {_EVENT_HITS_SQL}, c AS (SELECT 'large' AS rule_id, 40 AS cap UNION ALL SELECT 'seven', 25
  UNION ALL SELECT 'silent', 10)
SELECT c.rule_id, least(count(h.line_no), any_value(cap)) AS hits,
  greatest(count(h.line_no) - any_value(cap), 0) AS truncated
FROM c LEFT JOIN h USING (rule_id) GROUP BY c.rule_id""")
def budget_report(spark, d):
    return scan.budget_report(_event_hits(spark, d), {**_CAPS, "silent": 10})


@query("merge_hits", f"""
WITH {_EVENT_HITS_SQL} SELECT rule_id, count(*) AS n FROM h WHERE NOT (rule_id = 'large' AND source_id = 'click')
GROUP BY rule_id""")
def merge_hits(spark, d):
    hits = _event_hits(spark, d)
    stored = hits.where((F.col("rule_id") == "large") & (F.col("source_id") == "click"))
    return scan.merge_hits(hits.unionByName(hits), stored).groupBy("rule_id").agg(
        F.count(F.lit(1)).alias("n"))


@query("list_hits", f"""
WITH {_EVENT_HITS_SQL} SELECT rule_id, source_id, line_no, matched_value FROM h
WHERE severity = 'high' AND (contains(lower(snippet), 'large value of 4') OR contains(CAST(line_no AS VARCHAR), 'LARGE VALUE OF 4'))
ORDER BY rule_id, source_id, line_no LIMIT 50""")
def hits_page(spark, d):
    return list_hits(_stored_hits(spark, d), severity="high", q="LARGE value OF 4", round_no="1").select(
        "rule_id", "source_id", "line_no", "matched_value")


@query("list_hits_total", f"""
WITH {_EVENT_HITS_SQL} SELECT 'page' AS measure, count(*) AS total FROM h WHERE severity = 'high'
UNION ALL SELECT 'one', (SELECT count(*) FROM (SELECT 1 FROM h GROUP BY source_id, line_no, rule_id
  ORDER BY rule_id, source_id, line_no LIMIT 1))
UNION ALL SELECT 'other case', 0""")
def hits_totals(spark, d):
    """How many hits a page stands for; one hit found again by its id; another case has none."""
    hits = _stored_hits(spark, d)
    first = hit_id(hits).orderBy("rule_id", "source_id", "line_no").select("hit_id").first()
    named = lambda name, df: df.select(F.lit(name).alias("measure"), "total")
    return named("page", hits_total(hits, severity="high", case_id="c")).unionByName(
        named("one", hits_total(hits.dropDuplicates(["source_id", "line_no", "rule_id"]),
                                hit=first["hit_id"], case_id="c"))).unionByName(
        named("other case", hits_total(hits, case_id="d")))


@query("scan_rounds", f"""
WITH {EVENTS_SQL}, s AS (SELECT contains(raw, '42')::INT AS a, contains(raw, '17')::INT AS b FROM ev
  WHERE source_id IN ('click', 'error')),
n AS (SELECT count(*) AS scanned, sum(a)::BIGINT AS a, sum(b)::BIGINT AS b FROM s)
SELECT 1 AS round_no, 1 AS rule_count, scanned, a AS hits_new, a AS hits_total,
  greatest(a - 500, 0) AS truncated, a AS visible FROM n
UNION ALL SELECT 2, 2, scanned, b, a + b, greatest(a - 500, 0) + greatest(b - 500, 0), b FROM n
UNION ALL SELECT 3, 1, scanned, 0, a + b, greatest(b - 500, 0), 0 FROM n""")
def scan_rounds(spark, d):
    """Three published rounds of a case and rows of one that failed, which nobody sees."""
    folder = new_folder(spark, "rounds")
    ev = events(spark, d)
    case = F.when(F.col("source_id").isin("click", "error"), "c").otherwise("d")
    sources = ev.select("source_id").distinct().withColumns({"case_id": case, "log_type": F.lit("web")})
    rules = [{"id": f"k{token}", "title": token, "severity": "low", "target": "any",
              "match": {"raw": [token]}} for token in ("42", "17")]
    run = lambda ids: rounds.scan_case(
        ev, ev, sources, folder, "c", rule_ids=ids, signatures=rules, stats=[])
    run(["k42"])
    run(["k42", "k17"])
    run(["k17"])
    failed = rounds.published_hits(spark, folder, "c").withColumn("round_no", F.lit(4))
    scan.append_hits(cut_lineage(failed), f"{folder}/hits")
    seen = rounds.published_hits(spark, folder).groupBy("round_no").agg(F.count(F.lit(1)).alias("visible"))
    return rounds.published_rounds(spark, folder).join(seen, "round_no", "left").select(
        "round_no", "rule_count", "scanned", "hits_new", "hits_total", "truncated",
        F.coalesce("visible", F.lit(0)).alias("visible"))


@query("skipped_sources", """
SELECT 'spike' AS rule_id, 'error' AS source_id""")
def skipped_sources(spark, d):
    ev = events(spark, d).withColumn("ts_utc", F.when(F.col("source_id") != "error", F.col("ts_utc")))
    rules = [{"id": "spike", "operator": "rate_spike"}, {"id": "size", "operator": "size_outlier"}]
    return scan.skipped_sources(ev, rules).select("rule_id", "source_id")


def _scan(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    zones = _zones(spark, d)
    # A scan reads the event table many times: parsed once, stored, read by columns.
    folder = new_folder(spark, "scanned")
    build_events(parse_nginx_combined(access_lines(spark, d)), zones).write.parquet(folder)
    parsed = spark.read.parquet(folder)
    sources = zones.select("source_id", F.lit("c").alias("case_id"), F.lit("web").alias("log_type"),
                           "sha256")
    return scan.run_scan(parsed, extract_entities(parsed), sources, "c")


_ACCESS_NUMBERS = """'agent/' || k AS ua, CASE WHEN NOT dash THEN '/item/' || k END AS path,
  CASE WHEN dash THEN NULL WHEN event_type = 'purchase' THEN 'POST' ELSE 'GET' END AS method,
  CASE WHEN event_type = 'error' THEN '404' ELSE '200' END AS status,
  CASE WHEN value >= 1 THEN trunc(value * 100) END AS bytes"""
_CAPS_SQL = ", ".join(f"('{r['id']}', {scan.hit_cap(r)})" for part in builtin_rules() for r in part)

# What the built-in rules find in these log lines: entities of several sources, sizes far from
# the median of a path, agents on several addresses. No other rule has a hit.
_SCAN_SQL = f"""
{_ACCESS_SQL},
e AS (SELECT event_type AS source_id, line_no, ip, user_id, {_ACCESS_NUMBERS} FROM l WHERE kind = 'event'),
shared AS (
  SELECT source_id, min(line_no) AS line_no, 'cross-source-entity' AS rule_id,
    'canonical_key' AS matched_field, 'ip:' || ip AS matched_value
  FROM e WHERE user_id % 3 <> 0 AND user_id <= 255 GROUP BY source_id, ip
  QUALIFY count(*) OVER (PARTITION BY ip) >= 2),
m AS (SELECT source_id, path, method, status, median(bytes) AS median FROM e
      WHERE path IS NOT NULL AND method IS NOT NULL AND bytes IS NOT NULL
      GROUP BY ALL HAVING count(*) >= 20),
outlier AS (
  SELECT source_id, line_no, 'path-size-outlier' AS rule_id, 'path,method,status' AS matched_field,
    'path=' || path || ' method=' || method || ' status=' || status AS matched_value
  FROM e JOIN m USING (source_id, path, method, status)
  WHERE median > 0 AND (bytes > median * 3 OR bytes < median / 3)
  QUALIFY row_number() OVER (PARTITION BY source_id, path, method, status
    ORDER BY abs(bytes - median) DESC, line_no) <= 3),
agent AS (
  SELECT source_id, min(line_no) AS line_no, 'rare-ua-cross-ip' AS rule_id, 'ua' AS matched_field,
    ua AS matched_value
  FROM e GROUP BY source_id, ua HAVING count(DISTINCT ip) >= 2 AND count(*) < 50),
found AS (FROM shared UNION ALL FROM outlier UNION ALL FROM agent)
"""


@query("run_scan", f"""
WITH {_SCAN_SQL} SELECT source_id, line_no, rule_id, min(matched_field) AS matched_field,
  min(matched_value) AS matched_value FROM found GROUP BY source_id, line_no, rule_id""")
def run_scan(spark, d):
    """All built-in rules over log lines made from the events."""
    return _scan(spark, d)["hits"].select("source_id", "line_no", "rule_id", "matched_field",
                                          "matched_value")


@query("scan_report", f"""
WITH {_SCAN_SQL}, c AS (SELECT rule_id, count(*) AS n FROM found GROUP BY rule_id),
rules(rule_id, cap) AS (VALUES {_CAPS_SQL})
SELECT rule_id, least(coalesce(n, 0), cap) AS hits, greatest(coalesce(n, 0) - cap, 0) AS truncated
FROM rules LEFT JOIN c USING (rule_id)""")
def scan_report(spark, d):
    return _scan(spark, d)["report"]


@query("merge_windows", f"""
WITH {EVENTS_SQL}, a AS (SELECT source_id, line_no AS anchor_line FROM ev WHERE value > 150),
g AS (SELECT *, lag(anchor_line) OVER w AS p FROM a WINDOW w AS (PARTITION BY source_id ORDER BY anchor_line)),
o AS (SELECT *, CASE WHEN p IS NULL OR p + 50 - greatest(1, anchor_line - 50) + 1 < 10 THEN 1 ELSE 0 END AS opens FROM g),
i AS (SELECT *, sum(opens) OVER (PARTITION BY source_id ORDER BY anchor_line) AS island FROM o)
SELECT source_id, greatest(1, min(anchor_line) - 50) AS line_from,
  least(max(anchor_line) + 50, any_value(m.line_count)) AS line_to, count(*) AS anchors
FROM i JOIN (SELECT source_id, max(line_no) AS line_count FROM ev GROUP BY source_id) m USING (source_id) GROUP BY source_id, island""")
def merge_windows(spark, d):
    ev = events(spark, d)
    anchors = ev.where(F.col("value") > 150).select("source_id", F.col("line_no").alias("anchor_line"))
    sources = ev.groupBy("source_id").agg(F.max("line_no").alias("line_count"))
    return windows.merge_windows(anchors, 50, sources).select(
        "source_id", "line_from", "line_to", "anchors")


def _windows(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    ev = one_source(spark, d)
    anchors = ev.where(F.col("value") > 150).select("source_id", F.col("line_no").alias("anchor_line"))
    return ev, windows.merge_windows(anchors, 50)


_WINDOWS_SQL = f"""
{EVENTS_SQL}, a AS (SELECT line_no AS anchor_line FROM ev WHERE value > 150),
g AS (SELECT *, lag(anchor_line) OVER (ORDER BY anchor_line) AS p FROM a),
o AS (SELECT *, CASE WHEN p IS NULL OR p + 50 - greatest(1, anchor_line - 50) + 1 < 10 THEN 1 ELSE 0 END AS opens FROM g),
i AS (SELECT *, sum(opens) OVER (ORDER BY anchor_line) AS island FROM o),
w AS (SELECT greatest(1, min(anchor_line) - 50) AS line_from, max(anchor_line) + 50 AS line_to,
  min(anchor_line) AS first_anchor FROM i GROUP BY island)
"""


@query("window_excerpts", f"""
WITH {_WINDOWS_SQL}, x AS (SELECT line_from, line_to, line_no, length(raw) + 10 AS c,
    row_number() OVER (PARTITION BY line_from ORDER BY line_no) AS n,
    sum(length(raw) + 10) OVER (PARTITION BY line_from ORDER BY line_no) AS upto
  FROM w JOIN ev ON line_no BETWEEN line_from AND line_to)
SELECT line_from, count(*) AS lines, sum((n <= 120 AND upto <= 2100)::INT)::BIGINT AS shown,
  CASE WHEN count(*) > sum((n <= 120 AND upto <= 2100)::INT) THEN CASE WHEN sum((n <= 120 AND upto <= 2100)::INT)
    < least(count(*), 120) THEN 'chars' ELSE 'lines' END END AS truncated_by
FROM x GROUP BY line_from""")
def window_excerpts(spark, d):
    ev, wins = _windows(spark, d)
    return windows.window_excerpts(wins, ev, 120, 2100)[0].select(
        "line_from", "lines", "shown", "truncated_by")


@query("window_standing_hits", f"""
WITH {_WINDOWS_SQL} SELECT line_from, line_no FROM w JOIN ev ON line_no BETWEEN line_from AND line_to
WHERE contains(k, '7') AND event_type IN ('error', 'view')""")
def window_standing_hits(spark, d):
    ev, wins = _windows(spark, d)
    hits = ev.where(F.col("k").contains("7")).select(
        "source_id", "line_no", F.lit("seven").alias("rule_id"),
        F.when(F.col("event_type") == "error", "pending").when(
            F.col("event_type") == "view", "accepted").otherwise("rejected").alias("status"))
    return windows.window_standing_hits(wins, hits).select("line_from", "line_no")


@query("triple_negative", f"""
WITH {_WINDOWS_SQL}, f AS (SELECT DISTINCT line_from FROM w WHERE line_from % 3 = 0),
s AS (SELECT DISTINCT line_from FROM w JOIN ev ON line_no BETWEEN line_from AND line_to WHERE k = '77')
SELECT w.line_from, CASE WHEN s.line_from IS NULL THEN 'clean' ELSE 'suppressed' END AS verdict
FROM w LEFT JOIN s USING (line_from) WHERE w.line_from NOT IN (SELECT line_from FROM f)""")
def triple_negative(spark, d):
    ev, wins = _windows(spark, d)
    hits = ev.where(F.col("k") == "77").select(
        "source_id", "line_no", F.lit("seven").alias("rule_id"), F.lit("pending").alias("status"))
    found = wins.select("source_id", "line_from", "line_to", F.when(
        F.col("line_from") % 3 == 0, "low").otherwise("info").alias("severity"))
    return windows.triple_negative(wins, found, hits, ["seven"]).select("line_from", "verdict")


@query("pending_anchors", f"""
WITH {_EVENT_HITS_SQL} SELECT DISTINCT source_id, line_no AS anchor_line FROM h""")
def pending_anchors(spark, d):
    return windows.pending_anchors(_stored_hits(spark, d))


@query("rank_windows", f"""
WITH {_WINDOWS_SQL} SELECT line_from, round(max(value) / 1000, 6) AS linkage_score
FROM w JOIN ev ON line_no BETWEEN line_from AND line_to WHERE value > 150 GROUP BY line_from""")
def rank_windows(spark, d):
    ev, wins = _windows(spark, d)
    anchors = ev.where(F.col("value") > 150).select("source_id", F.col("line_no").alias("anchor_line"))
    scores = ev.select("source_id", "line_no", (F.col("value") / 1000).alias("score"))
    return windows.rank_windows(wins, anchors, scores).select("line_from", "linkage_score")


_REVIEWS_SQL = f"""
{_EVENT_HITS_SQL},
first AS (SELECT source_id, line_no, CASE WHEN line_no % 2 = 0 THEN 'accepted' ELSE 'rejected' END AS decision
  FROM ev WHERE value > 200)
"""


def _reviews(spark: SparkSession, d: str) -> DataFrame:
    """Two decisions on every large hit, and some on hits that do not exist."""
    ev = events(spark, d).where(F.col("value") > 200)
    base = ev.select(
        "source_id", "line_no", F.explode(F.array(F.lit("large"), F.lit("unknown"))).alias("rule_id"))
    row = lambda n, when, decision: base.select(
        "*", F.lit(n).alias("review_id"), F.lit(when).alias("decided_at"),
        decision.alias("decision"), F.lit(" seen ").alias("note"), F.lit("kim").alias("actor"))
    even = F.col("line_no") % 2 == 0
    return row(2, "2024-02-02", F.when(even, "rejected").otherwise("accepted")).unionByName(
        row(1, "2024-02-01", F.when(even, "accepted").otherwise("rejected")))


@query("apply_reviews", f"""
WITH {_REVIEWS_SQL} SELECT h.source_id, h.line_no, h.rule_id,
  CASE WHEN rule_id = 'large' THEN coalesce(decision, 'pending') ELSE 'pending' END AS status
FROM h LEFT JOIN first USING (source_id, line_no)""")
def apply_reviews(spark, d):
    decided, _ = review.apply_reviews(_stored_hits(spark, d), _reviews(spark, d))
    return decided.select("source_id", "line_no", "rule_id", "status")


@query("refused_reviews", f"""
WITH {_REVIEWS_SQL} SELECT source_id, line_no, refusal, n FROM first,
  (VALUES ('already decided', 1), ('no such hit', 2)) AS r(refusal, n)""")
def refused_reviews(spark, d):
    _, refused = review.apply_reviews(_stored_hits(spark, d), _reviews(spark, d))
    return refused.groupBy("source_id", "line_no", "refusal").agg(F.count(F.lit(1)).alias("n"))


@query("build_clues", f"""
WITH {_REVIEWS_SQL} SELECT 'Large value' AS title, source_id, line_no,
  '[rule hit] Large value' || chr(10) || 'rule: large (severity=high)' || chr(10) ||
  'match: value contains "' || matched_value || '"' || chr(10) || 'text: ' || snippet || chr(10) ||
  'anchor: source ' || source_id || ' line ' || line_no || ' sha256=00' || chr(10) ||
  'review note: seen' AS body
FROM h JOIN first USING (source_id, line_no) WHERE decision = 'accepted' AND rule_id = 'large'""")
def build_clues(spark, d):
    decided, _ = review.apply_reviews(_stored_hits(spark, d), _reviews(spark, d))
    return review.build_clues(decided, _zones(spark, d), {"large": "Large value"}).select(
        "title", "source_id", "line_no", "body")


_FINDING_SQL = f"""
{_WINDOWS_SQL}"""


def _replies(spark: SparkSession, d: str) -> DataFrame:
    """A written reading of every window: fenced, bare or unusable text."""
    _, wins = _windows(spark, d)
    ref = F.col("first_anchor").cast("string")
    body = F.concat(
        F.lit('{"window_note": "n", "findings": [{"summary": " odd ", "suspicion": "high", "line_refs": ['),
        ref, F.lit(', 999999999]}, {"summary": "", "suspicion": "low"}, {"summary": "again", "suspicion": "info", "line_refs": ['),
        ref, F.lit("]}]}"))
    kind = F.col("first_anchor") % 3
    content = F.when(kind == 0, F.concat(F.lit("here:\n```json\n"), body, F.lit("\n```"))).when(
        kind == 1, F.concat(F.lit("text "), body, F.lit(" end"))).otherwise("nothing { odd")
    return wins.select(F.lit("r1").alias("run_id"), "source_id", "line_from", "line_to",
                       "first_anchor", content.alias("content"))


@query("read_replies", f"""
WITH {_FINDING_SQL} SELECT line_from, CASE WHEN first_anchor % 3 = 2 THEN 'unreadable' ELSE 'read' END AS status,
  CASE WHEN first_anchor % 3 = 2 THEN 0 ELSE 1 END AS skipped FROM w""")
def read_replies(spark, d):
    return findings.read_replies(_replies(spark, d))[0].select("line_from", "status", "skipped")


@query("findings_to_hits", f"""
WITH {_FINDING_SQL} SELECT line_from, first_anchor AS line_no, 'high' AS severity, 'odd' AS snippet
FROM w WHERE first_anchor % 3 <> 2 AND first_anchor % 5 <> 0""")
def findings_to_hits(spark, d):
    _, wins = _windows(spark, d)
    _, found = findings.read_replies(_replies(spark, d))
    stored = wins.where(F.col("first_anchor") % 5 == 0).select(
        "source_id", F.col("first_anchor").alias("line_no"), F.lit("ai-l3-finding").alias("rule_id"))
    hits = findings.findings_to_hits(found, stored)
    return hits.select(F.get_json_object("detail", "$.window.from").cast("bigint").alias("line_from"),
                       "line_no", "severity", "snippet")


def _ledgers(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scan rounds from orders, analysis runs from events, notes from conversations."""
    case = lambda c: F.concat(F.lit("case"), (c % 3).cast("string")).alias("case_id")
    orders = table(spark, d, "orders")
    rounds = orders.select(
        case(F.col("o_custkey")), (F.col("o_orderkey") + 1).alias("round_no"),
        F.when(F.col("o_orderkey") % 2 == 0, F.lit(3)).alias("rule_count"), F.lit("kim").alias("actor"),
        F.when(F.col("o_orderkey") % 5 > 0, F.col("o_custkey")).alias("scanned"),
        F.lit(1).alias("hits_new"), (F.col("o_orderkey") % 4).alias("truncated"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("created_at"))
    ev = table(spark, d, "events")
    runs = ev.select(
        case(F.col("user_id")), F.concat(F.lit("run"), F.col("event_id").cast("string")).alias("run_id"),
        F.lit("done").alias("status"), F.lit(2).alias("anchors"), F.lit(1).alias("windows"),
        F.lit(0).alias("findings"), F.when(F.col("event_type") == "error", "failed").alias("error"),
        F.date_format("ts", "yyyy-MM-dd").alias("created_at"))
    talk = table(spark, d, "conversations")
    notes = talk.select(
        case(F.col("conv_id")), F.format_string("%d-%d", "conv_id", "turn").alias("note_id"),
        F.col("text").alias("body"), F.lit(None).cast("string").alias("anchor_kind"),
        F.lit(None).cast("string").alias("anchor_ref"), F.col("role").alias("author"),
        F.lit("2024-01-15").alias("created_at"))
    return rounds, runs, notes


@query("journal", """
WITH j AS (
  SELECT 'case' || o_custkey % 3 AS case_id, 'scan' AS kind, strftime(o_orderdate, '%Y-%m-%d') AS ts, 1 AS r,
    CAST(o_orderkey + 1 AS VARCHAR) AS anchor_ref, CASE WHEN o_orderkey % 5 = 0 THEN 'no summary' ELSE
      CASE WHEN o_orderkey % 2 = 0 THEN '3 rules' ELSE 'all rules' END || ' | scanned ' || o_custkey || ' | new 1' ||
      CASE WHEN o_orderkey % 4 > 0 THEN ' | truncated ' || o_orderkey % 4 ELSE '' END END AS body FROM orders
  UNION ALL SELECT 'case' || user_id % 3, 'ai', strftime(ts, '%Y-%m-%d'), 2, 'run' || event_id,
    CASE WHEN event_type = 'error' THEN 'done | error: failed' ELSE 'done | anchors 2 | windows 1 | findings 0' END FROM events
  UNION ALL SELECT 'case' || conv_id % 3, 'note', '2024-01-15', 0, NULL, text FROM conversations)
SELECT kind, ts, anchor_ref, body FROM j WHERE case_id = 'case1'
ORDER BY ts DESC, r, anchor_ref, body LIMIT 700 OFFSET 100""")
def journal_page(spark, d):
    return journal.journal(*_ledgers(spark, d), "case1", 700, 100).select("kind", "ts", "anchor_ref", "body")


@query("validate_notes", """
WITH n AS (SELECT event_id, user_id % 3 AS c, CASE event_id % 5 WHEN 0 THEN 'scan_round' WHEN 1 THEN 'line'
    WHEN 2 THEN 'analysis_run' WHEN 3 THEN 'hit' END AS kind, event_type FROM events)
SELECT event_id, CASE kind
  WHEN 'scan_round' THEN CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey % 3 = n.c AND o_orderkey + 1 = event_id)
    THEN NULL ELSE 'anchor does not exist' END
  WHEN 'line' THEN CASE WHEN EXISTS (SELECT 1 FROM events e WHERE e.event_type = n.event_type AND e.event_id + 1 = n.event_id)
    THEN NULL ELSE 'anchor does not exist' END
  WHEN 'analysis_run' THEN NULL WHEN 'hit' THEN 'anchor does not exist' END AS problem FROM n""")
def validate_notes(spark, d):
    rounds, runs, _ = _ledgers(spark, d)
    ev = table(spark, d, "events")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("scan_round", "line", "analysis_run", "hit")]),
                        (F.col("event_id") % 5 + 1).cast("int"))
    kind = F.when(F.col("event_id") % 5 < 4, F.get(F.array(
        *[F.lit(x) for x in ("scan_round", "line", "analysis_run", "hit")]), (F.col("event_id") % 5).cast("int")))
    text = F.col("event_id").cast("string")
    notes = ev.select(
        "event_id", F.concat(F.lit("case"), (F.col("user_id") % 3).cast("string")).alias("case_id"),
        F.lit("seen").alias("body"), kind.alias("anchor_kind"),
        F.when(kind == "line", F.concat("event_type", F.lit(":"), text))
        .when(kind == "analysis_run", F.concat(F.lit("run"), text)).otherwise(text).alias("anchor_ref"))
    hits = ev.select(F.lit("case9").alias("case_id"), text.alias("hit_id"))
    sources = ev.select(F.col("event_type").alias("source_id")).distinct().select(
        "source_id", F.explode(F.array(*[F.lit(f"case{i}") for i in range(3)])).alias("case_id"))
    return journal.validate_notes(notes, hits, rounds, runs, events(spark, d), sources).select(
        "event_id", "problem")


def _audit(spark: SparkSession, d: str) -> DataFrame:
    """A log with some broken links, gaps and altered entries.

    Odd entries carry a link of their own, even entries link to the odd entry before them.
    """
    orders = table(spark, d, "orders").select(
        (F.col("o_orderkey") + 1).alias("id"),
        F.concat(F.lit("case"), (F.col("o_custkey") % 3).cast("string")).alias("case_id"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("ts"), F.col("o_orderpriority").alias("actor"),
        F.col("o_orderstatus").alias("action"), F.lit(None).cast("string").alias("scope"),
        F.lit("{}").alias("detail_json"))
    odd = orders.where(F.col("id") % 2 == 1).withColumn("prev_hash", F.when(
        F.col("id") == 1, custody.GENESIS).otherwise(F.md5(F.col("id").cast("string"))))
    odd = odd.withColumn("entry_hash", custody.entry_hash())
    even = orders.where(F.col("id") % 2 == 0).join(
        odd.select((F.col("id") + 1).alias("id"), F.col("entry_hash").alias("prev_hash")), "id")
    even = even.withColumn("entry_hash", F.when(
        F.col("id") % 10 == 0, F.lit("altered")).otherwise(custody.entry_hash()))
    log = odd.unionByName(even.select(odd.columns))
    return log.where(F.col("id") % 100 != 51)


_AUDIT_SQL = """
base AS (SELECT o_orderkey + 1 AS id, 'case' || o_custkey % 3 AS case_id, strftime(o_orderdate, '%Y-%m-%d') AS ts,
  o_orderpriority AS actor, o_orderstatus AS action FROM orders),
odd AS (SELECT *, CASE WHEN id = 1 THEN 'GENESIS' ELSE md5(CAST(id AS VARCHAR)) END AS prev_hash FROM base WHERE id % 2 = 1),
oddh AS (SELECT *, sha256(id || '|' || case_id || '|' || ts || '|' || actor || '|' || action || '||{}|' || prev_hash) AS entry_hash FROM odd),
even AS (SELECT b.*, o.entry_hash AS prev_hash FROM base b JOIN oddh o ON o.id + 1 = b.id WHERE b.id % 2 = 0),
log AS (SELECT * FROM (SELECT * FROM oddh UNION ALL SELECT *, CASE WHEN id % 10 = 0 THEN 'altered' ELSE
  sha256(id || '|' || case_id || '|' || ts || '|' || actor || '|' || action || '||{}|' || prev_hash) END FROM even)
  WHERE id % 100 <> 51)
"""


@query("chain_checks", f"""
WITH {_AUDIT_SQL} SELECT a.id, CASE WHEN a.id > 1 AND b.id IS NULL THEN 'gap'
  WHEN a.id > 1 AND a.prev_hash <> b.entry_hash THEN 'link' WHEN a.entry_hash = 'altered' THEN 'hash' END AS failure
FROM log a LEFT JOIN log b ON b.id + 1 = a.id""")
def chain_checks(spark, d):
    return custody.chain_checks(_audit(spark, d)).select("id", "failure")


@query("verify_chain", f"""
WITH {_AUDIT_SQL}, f AS (SELECT a.id, CASE WHEN a.id > 1 AND b.id IS NULL THEN 'gap'
  WHEN a.id > 1 AND a.prev_hash <> b.entry_hash THEN 'link' WHEN a.entry_hash = 'altered' THEN 'hash' END AS failure
  FROM log a LEFT JOIN log b ON b.id + 1 = a.id)
SELECT count(failure) = 0 AS ok, count(*) AS entries, min(id) FILTER (failure IS NOT NULL) AS first_bad_id,
  arg_min(failure, id) FILTER (failure IS NOT NULL) AS failure FROM f""")
def verify_chain(spark, d):
    return custody.verify_chain(_audit(spark, d))


@query("chain_tampering", f"""
WITH {_AUDIT_SQL}, o AS (SELECT * FROM oddh WHERE id % 100 <> 51),
t AS (SELECT id, CASE WHEN id % 6 = 1 THEN 'hash' WHEN id % 6 = 3 THEN 'duplicate' END AS bad FROM o)
SELECT id, CASE WHEN bad = 'duplicate' THEN bad WHEN id > 1 THEN 'gap' ELSE bad END AS failure FROM t
UNION ALL SELECT id, CASE WHEN bad = 'duplicate' THEN bad WHEN id > 1 THEN 'gap' ELSE bad END FROM t WHERE bad = 'duplicate'""")
def chain_tampering(spark, d):
    """Missing hashes and repeated ids never pass; only odd ids are left, so links are gaps."""
    log = _audit(spark, d).where(F.col("id") % 2 == 1)
    torn = log.withColumn("entry_hash", F.when(F.col("id") % 6 != 1, F.col("entry_hash")))
    return custody.chain_checks(torn.unionByName(torn.where(F.col("id") % 6 == 3))).select("id", "failure")


@query("chain_intact", """
SELECT true AS ok, count(*) AS entries, CAST(NULL AS BIGINT) AS first_bad_id, CAST(NULL AS VARCHAR) AS failure
FROM orders WHERE o_orderkey = 0""")
def chain_intact(spark, d):
    """A chain of one entry that holds, hash and genesis link included."""
    return custody.verify_chain(_audit(spark, d).where(F.col("id") == 1))


def _exported(spark: SparkSession, d: str):
    ev = events(spark, d)
    cases = _audit(spark, d).select("case_id").distinct()
    sources = ev.select("source_id").distinct().select(
        "source_id", F.col("source_id").alias("name"), F.lit("case1").alias("case_id"),
        F.concat(F.lit("/f/"), "source_id").alias("path"), F.md5("source_id").alias("sha256"))
    inventory = sources.where(F.col("source_id") != "view").select("path", F.when(
        F.col("source_id") == "click", "other").otherwise(F.col("sha256")).alias("sha256"))
    return cases, sources, ev, inventory


@query("case_manifest", f"""
WITH {_AUDIT_SQL} SELECT case_id, count(*) AS count, arg_max(entry_hash, id) AS last_hash,
  CASE case_id WHEN 'case1' THEN 5 ELSE 0 END AS sources, CASE case_id WHEN 'case1' THEN 1 ELSE 0 END AS files_missing
FROM log GROUP BY case_id""")
def case_manifest(spark, d):
    cases, sources, ev, inventory = _exported(spark, d)
    return custody.case_manifest(cases, sources, ev, inventory, _audit(spark, d))["cases"].select(
        "case_id", "count", "last_hash", "sources", "files_missing")


@query("manifest_sources", f"""
WITH {EVENTS_SQL} SELECT source_id, count(*) AS events, source_id = 'view' AS missing FROM ev GROUP BY source_id""")
def manifest_sources(spark, d):
    _, sources, ev, inventory = _exported(spark, d)
    return custody.manifest_sources(sources, ev, inventory).select("source_id", "events", "missing")


@query("verify_manifest", f"""
WITH {_AUDIT_SQL}, x AS (SELECT *, lag(entry_hash) OVER (PARTITION BY case_id ORDER BY id) AS p FROM log),
s AS (SELECT case_id, count(*) AS n, sum((entry_hash = 'altered')::INT) AS bad,
  sum((prev_hash <> coalesce(p, 'GENESIS'))::INT) AS ext, arg_max(entry_hash, id) AS last FROM x GROUP BY case_id)
SELECT case_id, 'entry_hash' AS "check", bad = 0 AS ok, bad || ' altered' AS detail FROM s
UNION ALL SELECT case_id, 'chain_link', true, ext || ' external' FROM s
UNION ALL SELECT case_id, 'count', true, n || ' recorded, ' || n || ' found' FROM s
UNION ALL SELECT case_id, 'last_hash', true, last || ' recorded, ' || last || ' found' FROM s
UNION ALL SELECT DISTINCT 'case1', 'file:' || event_type, event_type NOT IN ('view', 'click'),
  CASE event_type WHEN 'view' THEN 'missing' WHEN 'click' THEN 'altered' ELSE 'same' END FROM events""")
def verify_manifest(spark, d):
    cases, sources, ev, inventory = _exported(spark, d)
    log = _audit(spark, d)
    manifest = custody.case_manifest(cases, sources, ev, inventory, log)
    return custody.verify_manifest(manifest["cases"], sources, manifest["audit_chain"], inventory)


@query("case_overview", """
SELECT 'nation' || n_nationkey AS case_id, count(c_custkey) AS source_count
FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey""")
def overview(spark, d):
    cases = table(spark, d, "nation").select(
        F.concat(F.lit("nation"), F.col("n_nationkey").cast("string")).alias("case_id"),
        F.col("n_nationkey").alias("created_at"))
    sources = table(spark, d, "customer").select(
        F.concat(F.lit("nation"), F.col("c_nationkey").cast("string")).alias("case_id"))
    return case_overview(cases, sources).select("case_id", "source_count")
