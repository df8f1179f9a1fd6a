"""Windows event records that were already rendered as XML, one record per row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import EVENT_RECORD_FIELDS, norm_struct

# Addresses that mean "no remote side", and lifted data names.
NO_ADDRESS = ["-", "", "0.0.0.0", "127.0.0.1", "::1", "::"]
LIFTED = ["IpPort", "WorkstationName", "ProcessName", "TargetDomainName"]

# Elements are read as lists, because a record may repeat them; the first one counts.
_TEXTS = "array<struct<_VALUE:string>>"
_NAMED = "array<struct<_Name:string,_VALUE:string>>"
_RECORD = (
    "System array<struct<Provider:array<struct<_Name:string>>, "
    "TimeCreated:array<struct<_SystemTime:string>>, "
    + ", ".join(f"{name}:{_TEXTS}" for name in
                ["EventID", "Level", "Channel", "Computer", "EventRecordID"])
    + f">>, EventData array<struct<Data:{_NAMED}>>, "
    f"UserData array<struct<Data:{_NAMED}>>, _bad string")
_READ = {"ignoreNamespace": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
# Own elements of user data are known by no schema. The variant reader makes numbers of texts
# such as 007, so every text gets a mark in front while it is read.
_MARKED = r"(<[^<>!?][^<>]*>)(?=[^<]|<!\[CDATA\[)"
_BLANK = r"\A\s*\z"
_INTEGER = r"\A[+-]?[0-9]+\z"
_TIME = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[T ][0-9]{2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]+)?)?)?"
_ZONE = r"(?:Z|[+-][0-9]{2}:?[0-9]{2})\z"


def _first(values: Column) -> Column:
    return F.get(values, F.lit(0))


def _clean(text: Column) -> Column:
    """Text without surrounding blanks, null if nothing is left."""
    return F.nullif(F.regexp_replace(text, r"\A\s+|\s+\z", ""), F.lit(""))


def _whole(text: Column) -> Column:
    """An integer as text, without sign or zeros in front; null for other texts."""
    return F.when(text.rlike(_INTEGER), text.try_cast("decimal(38,0)")).cast("string")


def _utc(text: Column) -> Column:
    """System times without a zone are UTC; the session's zone has no say."""
    there = text.rlike(_TIME + r"\z") | text.rlike(_TIME + _ZONE)
    zoned = F.when(text.rlike(_ZONE) & text.contains(":"), text).when(
        F.length(text) == 10, F.concat(text, F.lit("T00:00:00Z"))).otherwise(
        F.concat(text, F.lit("Z")))
    # Spark wants seconds before a zone and a colon inside it.
    full = F.regexp_replace(zoned, r"\A(.{10}[T ][0-9]{2}:[0-9]{2})(?=[Z+-])", "$1:00")
    full = F.regexp_replace(full, r"([+-][0-9]{2})([0-9]{2})\z", "$1:$2")
    return F.when(there, full.try_cast("timestamp"))


def _kind(value: Column, prefix: str) -> Column:
    return F.schema_of_variant(value).startswith(prefix)


def _inner(value: Column, prefix: str, path: str) -> Column:
    return F.when(_kind(value, prefix), F.variant_get(value, path, "variant")).otherwise(value)


def _own_text(value: Column) -> Column:
    """The text of the first element of one name."""
    value = _inner(_inner(_inner(value, "ARRAY", "$[0]"), "OBJECT", "$._VALUE"), "ARRAY", "$[0]")
    text = F.when(~_kind(value, "OBJECT"), F.try_variant_get(value, "$", "string"))
    return _clean(F.regexp_replace(text, r"\A=", ""))


def _pairs() -> Column:
    """(name, text) of named data: event data, then user data, then its own elements."""
    def named(data: Column) -> Column:
        return F.transform(
            F.filter(data, lambda d: F.coalesce(d["_Name"], F.lit("")) != ""),
            lambda d: F.struct(d["_Name"].alias("name"), F.coalesce(
                _clean(d["_VALUE"]), F.lit("")).alias("text")))

    own = F.filter(F.transform(F.map_entries("_own"), lambda e: F.struct(
        e["key"].alias("name"), _own_text(e["value"]).alias("text"))),
        lambda p: p["text"].isNotNull() & (p["name"] != "Data"))
    none = F.array().cast("array<struct<name:string,text:string>>")
    return F.concat(*[F.coalesce(part, none) for part in
                      (named(F.col("_event")), named(F.col("_user")), own)])


def _first_of_each(pairs: Column) -> Column:
    """A map in which the first pair of a name counts."""
    return F.map_from_entries(F.filter(pairs, lambda p, at: F.array_position(
        F.transform(pairs, lambda q: q["name"]), p["name"]) == at + 1))


def parse_event_xml(records: DataFrame) -> DataFrame:
    """``records`` has source_id, line_no (record number) and raw (XML text).

    A record is an event when it is well-formed XML with a System section whose EventID is an
    integer; otherwise it is bad and says why. A time that cannot be read leaves the event
    without one. Of repeated elements and names the first counts; user data may hold own
    elements beside Data, and their text outside of nested elements is kept by their names.
    Each record is parsed by Spark's XML reader once, those with user data twice.
    """
    has_own = F.col("raw").contains("UserData>")
    read = records.select(
        "source_id", "line_no", "raw", F.from_xml("raw", _RECORD, _READ).alias("_x"),
        F.when(has_own, F.from_xml(
            F.regexp_replace("raw", _MARKED, "$1="), "UserData variant",
            {"ignoreNamespace": "true"})["UserData"]).alias("_u"))
    root = F.regexp_extract("raw", r"<([^\s<>/!?]+)", 1)
    # The XML reader stops behind the root element; nothing but comments may follow it.
    last = F.regexp_extract("raw", r"<(/?[^\s<>/!?]+)[^<>]*>\s*(?:<!--(?:[^-]|-[^-])*-->\s*)*\z", 1)
    whole = F.col("_x._bad").isNull() & ((last == F.concat(F.lit("/"), root)) | (last == root))
    system = _first(F.col("_x.System"))

    def text(name: str) -> Column:
        return _clean(_first(system[name])["_VALUE"])

    rows = read.select(
        "source_id", "line_no", "raw", whole.alias("_whole"), system.isNotNull().alias("_system"),
        _whole(text("EventID")).alias("_id"),
        _first(system["TimeCreated"])["_SystemTime"].alias("_time"),
        F.nullif(_first(system["Provider"])["_Name"], F.lit("")).alias("_provider"),
        F.when(_first(system["Channel"]).isNotNull(),
               F.coalesce(text("Channel"), F.lit(""))).alias("_channel"),
        text("Computer").alias("_computer"), _whole(text("Level")).alias("_level"),
        text("EventRecordID").alias("_number"),
        _first(F.col("_x.EventData"))["Data"].alias("_event"),
        _first(F.col("_x.UserData"))["Data"].alias("_user"),
        F.try_variant_get(_inner(F.col("_u"), "ARRAY", "$[0]"), "$",
                          "map<string,variant>").alias("_own"))
    rows = rows.withColumn("_pairs", _pairs()).withColumn("_data", _first_of_each(F.col("_pairs")))
    rows = rows.withColumn("reason", F.when(
        F.col("raw").isNull() | F.col("raw").rlike(_BLANK), "record without XML")
        .when(~F.coalesce("_whole", F.lit(False)), "malformed XML")
        .when(~F.col("_system"), "no System section")
        .when(F.col("_id").isNull(), "EventID missing or not an integer"))
    is_event = F.col("reason").isNull()
    data = {name: F.nullif(F.element_at("_data", name), F.lit(""))
            for name in [*LIFTED, "IpAddress", "TargetUserName"]}
    address, user = data.pop("IpAddress"), data.pop("TargetUserName")
    fields = {"src_ip": F.when(~address.isin(NO_ADDRESS), address),
              "user": F.when(user != "-", user), "level": F.col("_level"),
              "event_id": F.col("_id"), "channel": F.col("_channel"),
              "provider": F.col("_provider"), "computer": F.col("_computer"),
              **{name.lower(): value for name, value in data.items()}}
    unnamed = F.filter(F.transform(
        F.filter(F.concat(*[F.coalesce(c, F.array().cast(_NAMED)) for c in ("_event", "_user")]),
                 lambda d: F.coalesce(d["_Name"], F.lit("")) == ""),
        lambda d: _clean(d["_VALUE"])), lambda t: t.isNotNull())
    extras = {"event_data": F.when(F.size("_data") > 0, F.col("_data")),
              "event_data_unnamed": F.when(F.size(unnamed) > 0, unnamed),
              "event_record_id": F.col("_number")}
    any_extra = reduce(Column.__or__, [value.isNotNull() for value in extras.values()])
    return rows.select(
        "source_id", "line_no", F.when(is_event, "event").otherwise("bad").alias("kind"), "raw",
        F.when(is_event, F.col("_time")).alias("ts_raw"),
        F.lit(None).cast("timestamp_ntz").alias("dt_local"),
        F.when(is_event, _utc(F.col("_time"))).alias("ts_direct"),
        F.when(is_event, norm_struct({n: fields.get(n, F.lit(None).cast("string")) for n in [
            "src_ip", "user", "level", *EVENT_RECORD_FIELDS]})).alias("norm"),
        F.when(is_event & any_extra, F.to_json(F.struct(
            *[value.alias(name) for name, value in extras.items()]))).alias("extras"),
        "reason", F.lit(0).alias("continuation_lines"))
