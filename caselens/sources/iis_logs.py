"""IIS W3C extended logs: the latest ``#Fields:`` line above names the columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import compute_once, is_blank
from ..operators.ordered import carry_sparse
from ..schema import norm_struct

# W3C field name → normalised field.
FIELD_NAMES = {
    "c-ip": "src_ip",
    "cs-method": "method",
    "cs-uri-stem": "path",
    "cs-uri-query": "query",
    "sc-status": "status",
    "sc-bytes": "bytes",
    "cs(User-Agent)": "ua",
    "cs(Referer)": "referer",
    "cs(Referrer)": "referer",
    "cs-username": "user",
}
NUMERIC_FIELDS = ["status", "bytes"]
INTEGER_PATTERN = r"^\s*[+-]?\d+\s*$"


def parse_iis_w3c(lines: DataFrame) -> DataFrame:
    raw = F.col("raw")
    directive = F.lower(raw).startswith("#fields:")
    headed = carry_sparse(
        lines, ["source_id"], "line_no",
        F.when(directive, F.filter(F.split(
            F.substring(raw, F.lit(9), F.length(raw)), r"(?U)\s+"), lambda n: n != "")), "_names")
    staged = compute_once(
        headed, _blank=is_blank(raw), _parts=F.split(raw, " "))
    staged = compute_once(
        staged, _note=F.col("_blank") | raw.startswith("#"),
        _ok=~F.col("_blank") & ~raw.startswith("#") & F.col("_names").isNotNull()
        & (F.size("_names") == F.size("_parts")))
    staged = compute_once(staged, _row=F.when(F.col("_ok"), _last_wins()))
    get = lambda name: F.col("_row").getItem(name)
    both = (get("date") != "") & (get("time") != "")
    staged = compute_once(staged, ts_raw=F.when(
        both, F.concat_ws(" ", get("date"), get("time"))))
    staged = compute_once(staged, _dt=F.when(
        F.col("ts_raw").rlike(r"^\d{1,4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$"),
        F.try_to_timestamp("ts_raw", F.lit("yyyy-M-d H:m:s"))).cast("timestamp_ntz"))
    reason = (
        F.when(F.col("_blank"), F.lit("blank line"))
        .when(F.col("_note"), F.lit("directive or comment"))
        .when(F.col("_names").isNull(), F.lit("no #Fields line above"))
        .when(~F.col("_ok"), F.format_string(
            "%d columns, #Fields names %d", F.size("_parts"), F.size("_names")))
        .when(F.col("ts_raw").isNotNull() & F.col("_dt").isNull(), F.lit("unreadable time")))
    staged = compute_once(staged, reason=reason)
    staged = compute_once(staged, kind=F.when(F.col("_note"), "skip").when(
        F.col("reason").isNotNull(), "bad").otherwise("event"))
    norm = {}
    for w3c, field in FIELD_NAMES.items():
        value = F.when(get(w3c) != "-", get(w3c))
        if field in NUMERIC_FIELDS:
            value = F.when(value.rlike(INTEGER_PATTERN),
                           F.trim(value).try_cast("decimal(38,0)").cast("string"))
        norm[field] = F.coalesce(value, norm[field]) if field in norm else value
    known = [n for n, f in FIELD_NAMES.items() if f not in NUMERIC_FIELDS] + ["date", "time"]
    numeric = [n for n, f in FIELD_NAMES.items() if f in NUMERIC_FIELDS]
    rest = F.map_filter("_row", lambda k, v: (v != "-") & ~k.isin(known) & ~(
        k.isin(numeric) & v.rlike(INTEGER_PATTERN)))
    is_event = F.col("kind") == "event"
    return staged.select(
        "source_id", "line_no", "kind", "raw", "ts_raw",
        F.when(is_event, F.col("_dt")).alias("dt_local"),
        F.lit(None).cast("timestamp").alias("ts_direct"),
        F.when(is_event, norm_struct(norm)).alias("norm"),
        F.when(is_event & (F.size(rest) > 0), F.to_json(rest)).alias("extras"),
        "reason", F.lit(0).alias("continuation_lines"))


def _last_wins():
    """Column name → value; of a repeated name the last column counts."""
    pairs = F.arrays_zip(F.col("_names").alias("name"), F.col("_parts").alias("value"))
    last = F.filter(pairs, lambda e, i: F.array_position(
        F.slice(F.col("_names"), i + 2, F.size("_names")), e["name"]) == 0)
    twice = F.size(F.array_distinct("_names")) < F.size("_names")
    return F.when(twice, F.map_from_entries(last)).otherwise(F.map_from_arrays("_names", "_parts"))
