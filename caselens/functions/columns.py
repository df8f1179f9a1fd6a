"""Scalar building blocks as Column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Placeholders, sensitive names and token shapes that are masked.
MASK = "***"
BEARER_PATTERN = r"(?iU)\bBearer\s+\S+"
SECRET_PAIR_PATTERN = (
    r"(?iU)\b(authorization|cookie|set-cookie|api[_-]?key|password|passwd|token|secret)"
    r"(\s*[:=]\s*)([\"']?)[^\s,\"'\]]+"
)
API_KEY_PATTERN = r"(?iU)\bsk-[A-Za-z0-9_\-]{6,}"
# A number as both SQL engines read it, and the error names in a log line.
NUMBER_PATTERN = r"^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*$"
ERROR_NAME_PATTERN = r"\b([A-Za-z_][A-Za-z0-9_.]*(?:Error|Exception))\b"
# Request line, quoted trailer and a list of IPv4 addresses.
REQUEST_PATTERN = r"(?U)\A\S+ \S+(?: \S+)?\z"
QUOTED_PATTERN = r'^"([^"]*)"$'
IP_LIST_PATTERN = r"^\d{1,3}(?:\.\d{1,3}){3}(?:\s*,\s*\d{1,3}(?:\.\d{1,3}){3})*$"


def compute_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are evaluated once per row.

    The optimizer substitutes a projected expression into every filter above it; for a
    parsed line that would run the line pattern once per use. A one-element ``inline`` is
    a boundary it does not move filters across, and it stays in generated code.
    """
    fields = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select("*", F.inline(F.array(fields)))


def is_blank(text: Column) -> Column:
    return text.rlike(r"(?U)^\s*$")


def number(text: Column) -> Column:
    """String form of a metric as double, NULL when it is not a plain number."""
    return F.when(text.rlike(NUMBER_PATTERN), F.trim(text).try_cast("double"))


def epoch(ts: Column) -> Column:
    return F.unix_micros(ts) / F.lit(1_000_000.0)


def bucket_start(ts: Column, seconds: int) -> Column:
    """Start of the time bucket in whole epoch seconds (floor, also before 1970)."""
    return (F.floor(F.unix_micros(ts) / F.lit(int(seconds) * 1_000_000)) * seconds).cast("bigint")


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")


def any_token(text: Column, tokens: list[str]) -> Column:
    """True when one of the lower-case tokens occurs in ``text``; the scan is literal."""
    if not tokens:
        return F.lit(False)
    low = F.lower(text)
    return reduce(lambda a, b: a | b, [low.contains(t) for t in tokens])


def first_token(text: Column, tokens: list[str]) -> Column:
    """The first listed token that occurs in ``text`` (already lower-case), else NULL."""
    return F.coalesce(*[F.when(text.contains(t), F.lit(t)) for t in tokens])


def redact(text: Column) -> Column:
    """Mask bearer tokens, sensitive key-value pairs and API keys, in this order."""
    masked = F.regexp_replace(text, BEARER_PATTERN, f"Bearer {MASK}")
    masked = F.regexp_replace(masked, SECRET_PAIR_PATTERN, "$1$2$3" + MASK)
    return F.regexp_replace(masked, API_KEY_PATTERN, f"sk-{MASK}")


def error_names(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(ERROR_NAME_PATTERN), F.lit(1))


def request_parts(request: Column) -> Column:
    """The two or three words of a request line, NULL when it is none."""
    return F.when(request.rlike(REQUEST_PATTERN), F.split(request, " "))


def split_request(request: Column, parts: Column | None = None) -> dict[str, Column]:
    """Request line → method, path, query, protocol, and the text when it is none.

    ``parts`` is ``request_parts(request)`` when that was already computed.
    """
    parts = request_parts(request) if parts is None else parts
    target = F.get(parts, F.lit(1))
    return {
        "method": F.get(parts, F.lit(0)),
        "path": F.substring_index(target, "?", 1),
        "query": F.when(F.instr(target, "?") > 0,
                        F.substring(target, F.instr(target, "?") + 1, F.length(target))),
        "protocol": F.get(parts, F.lit(2)),
        "unparsed": F.when(parts.isNull() & (request != ""), request),
    }


def forwarded_for(trailing: Column) -> Column:
    """The quoted trailer when it is a list of IPv4 addresses, else NULL."""
    inner = F.trim(F.regexp_extract(trailing, QUOTED_PATTERN, 1))
    return F.when(inner.rlike(IP_LIST_PATTERN), inner)
