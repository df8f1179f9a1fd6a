"""From parsed lines to events and entities."""

from __future__ import annotations

import re
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from ..functions.addresses import classify_ips
from ..session import broadcast_if_small, cut_lineage

# Standard offsets in minutes for names the zone database may lack.
STANDARD_OFFSETS = {
    "asia/shanghai": 480, "asia/beijing": 480, "asia/chongqing": 480,
    "asia/hong_kong": 480, "asia/taipei": 480, "asia/singapore": 480,
    "asia/tokyo": 540, "asia/seoul": 540, "asia/kolkata": 330,
    "europe/london": 0, "europe/paris": 60, "europe/berlin": 60,
    "america/new_york": -300, "america/chicago": -360, "america/los_angeles": -480,
    "utc": 0, "etc/utc": 0, "etc/gmt": 0,
}
OFFSET_PATTERN = r"(?:UTC|GMT)?([+-])(\d{1,2})(?::?(\d{2}))?"


def _zone(declared: str | None) -> tuple[str | None, int | None]:
    """(zone name, None), (None, minutes) or (None, None) for an unknown declaration."""
    name = (declared or "").strip()
    if not name:
        return None, None
    try:
        return ZoneInfo(name).key, None
    except Exception:  # unknown key, bad characters, missing database
        pass
    if name.lower() in STANDARD_OFFSETS:
        return None, STANDARD_OFFSETS[name.lower()]
    match = re.fullmatch(OFFSET_PATTERN, name, re.IGNORECASE)
    if match is None:
        return None, None
    minutes = int(match[2]) * 60 + int(match[3] or 0)
    if minutes >= 24 * 60:
        return None, None
    return None, -minutes if match[1] == "-" else minutes


@pandas_udf(T.StructType([T.StructField("zone", T.StringType()),
                          T.StructField("minutes", T.IntegerType())]))
def resolve_zone(declared: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_zone(d) for d in declared], columns=["zone", "minutes"])


def to_utc(parsed: DataFrame, sources: DataFrame) -> DataFrame:
    """Add ``ts_utc`` and ``sha256``.

    A time that the log itself gives in UTC counts first, then the local time in the
    declared zone of the source; an unknown zone leaves NULL. Zones are resolved on the
    source list, one row per file.
    """
    zones = cut_lineage(sources.select(
        "source_id", "sha256", resolve_zone(F.col("tz_declared")).alias("_z")).select(
        "source_id", "sha256", F.col("_z.zone").alias("_zone"),
        F.col("_z.minutes").alias("_minutes")))
    local = F.col("dt_local").cast("timestamp")
    return (
        parsed.join(broadcast_if_small(zones, 300), "source_id", "left")
        .withColumn("ts_utc", F.coalesce(
            F.col("ts_direct"),
            F.when(F.col("_zone").isNotNull(), F.to_utc_timestamp(local, F.col("_zone"))),
            F.when(F.col("_minutes").isNotNull(), F.timestamp_micros(
                F.unix_micros(local) - F.col("_minutes").cast("bigint") * 60_000_000))))
        .drop("_zone", "_minutes"))


def build_events(parsed: DataFrame, sources: DataFrame) -> DataFrame:
    """The ``events`` table from parsed lines."""
    return to_utc(parsed.where(F.col("kind") == "event"), sources).select(
        "source_id", "line_no", "ts_raw", "ts_utc", "norm", "extras", "raw", "sha256")


def extract_entities(events: DataFrame, address: str = "norm.src_ip",
                     accounts: tuple[str, ...] = ("norm.actor", "norm.user")) -> DataFrame:
    """Addresses and accounts named by the events; an invalid address is not an entity."""
    named = events.select(
        "source_id", "line_no", "ts_utc", F.col(address).alias("_ip"),
        *[F.col(a).alias(f"_a{i}") for i, a in enumerate(accounts)])
    scoped = classify_ips(named, "_ip", "_scope")
    entity = lambda value, prefix, kind, scope: F.struct(
        value.alias("raw_value"), F.concat(F.lit(prefix), value).alias("canonical_key"),
        F.lit(kind).alias("entity_type"), scope.alias("qualifier"))
    found = [F.when(F.col("_scope").isNotNull(),
                    entity(F.col("_ip"), "ip:", "ip", F.col("_scope")))]
    for i in range(len(accounts)):
        account = F.col(f"_a{i}")
        found.append(F.when(account.isNotNull() & (account != ""),
                            entity(account, "account:", "account", F.lit("host_scoped"))))
    return (scoped.select("source_id", "line_no", "ts_utc", F.explode(F.array(*found)).alias("e"))
            .where(F.col("e").isNotNull())
            .select("e.*", "source_id", "line_no", "ts_utc"))
