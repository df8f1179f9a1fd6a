"""Personal data by weak supervision.

Candidates come from strict and from loose patterns. Labelers (pattern, checksum, gazetteer,
context, shape) vote on each for, against or not at all. The counts of all vote patterns in
the corpus are the evidence: expectation-maximisation estimates how reliable each labeler is
and how likely each pattern is personal data, and a span classifier (logistic regression on
votes and span features) is trained on these likelihoods. Strict spans stay in any case;
loose ones are added when the classifier finds them likelier than not.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

KINDS = ("email", "ip", "card", "phone")
EXTRA_KINDS = ("email", "ip", "card", "phone", "ssn", "iban", "mac")

# The strict patterns.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NEAR_DIGITS = re.compile(r"[0-9](?:.{0,60}?[0-9])*", re.S)
_AT = re.compile(r"(?i)[\[({]\s?at\s?[\])}]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

_LOOSE = {
    "email": re.compile(r"(?i)\b[a-z0-9._%+-]{1,64}\s?[\[({]\s?at\s?[\])}]\s?[a-z0-9-]{1,63}(?:\s?[\[({]\s?dot\s?[\])}]\s?[a-z0-9-]{1,63}|\.[a-z]{2,24})+"),
    "ip": re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"),
    "phone": re.compile(r"(?<![0-9A-Za-z+.-])(?:\(\d{3}\)[ ]?|\d{3}[-. ])\d{3}[-. ]\d{4}(?![0-9.-])"),
    "card": re.compile(r"(?<![0-9A-Za-z])\d{4}(?:[./]\d{4}){3}(?![0-9])"),
    "ssn": re.compile(r"(?<![0-9A-Za-z-])\d{3}-\d{2}-\d{4}(?![0-9A-Za-z-])"),
    "iban": re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){3,7}(?:[ ]?[A-Z0-9]{1,3})?(?![0-9A-Za-z])"),
    "mac": re.compile(r"(?<![0-9A-Fa-f:-])[0-9A-Fa-f]{2}(?:[:-][0-9A-Fa-f]{2}){5}(?![0-9A-Fa-f:-])"),
}
_CONTEXT = {
    "email": re.compile(r"(?i)mail|contact|write|reach|courriel|correo|kontakt"),
    "ip": re.compile(r"(?i)\bip\b|address|host|client|login|from\b|server"),
    "card": re.compile(r"(?i)card|visa|master|amex|credit|debit|pay|karte|tarjeta|carte"),
    "phone": re.compile(r"(?i)phone|tel\b|call|mobile|cell|fax|ring|sms|telef|\bt[ée]l"),
    "ssn": re.compile(r"(?i)ssn|social|security|tax"),
    "iban": re.compile(r"(?i)iban|bank|account|konto|cuenta|compte"),
    "mac": re.compile(r"(?i)mac|device|ethernet|wlan|wifi|address"),
}
_AGAINST = re.compile(r"(?i)(?:version|release|build|order|invoice|isbn|issn|doi|serial|part|section|chapter|page|id|no\.|#)\W*\Z")
# Well-known top domains and lengths of country codes.
_TOP = frozenset("com org net edu gov mil int info biz io co uk de fr es it nl eu us ca au jp cn ch at be se no dk fi pl ru br in mx".split())
_IBAN_LENGTHS = {"DE": 22, "FR": 27, "ES": 24, "IT": 27, "GB": 22, "NL": 18, "BE": 16, "AT": 20,
                 "CH": 21, "PL": 28, "PT": 25, "IE": 22, "SE": 24, "DK": 18, "NO": 15, "FI": 18}


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    even = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (odd + even) % 10 == 0


def _emails(text: str):
    done = 0
    at = text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL:
            begin -= 1
        m = _DOMAIN.match(text, at) if begin < at else None
        if m:
            yield begin, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """The strict spans by start, then kind: leftmost and not overlapping within a kind."""
    out = [(b, e, "email") for b, e in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(int(p) <= 255 if len(p) < 9 else int(p.lstrip("0")[:4] or 0) <= 255
               for p in m[0].split(".")):
            out.append((m.start(), m.end(), "ip"))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def loose_spans(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Further candidates that no strict span touches; all but addresses hold a digit."""
    out = []
    if _AT.search(text):
        out += [(m.start(), m.end(), "email") for m in _LOOSE["email"].finditer(text)]
    for near in _NEAR_DIGITS.finditer(text):
        low, high = max(0, near.start() - 60), near.end() + 60
        for kind, pattern in _LOOSE.items():
            if kind != "email":
                out += [(m.start(), m.end(), kind) for m in pattern.finditer(text, low, high)]
    # Both lists are short; a sweep over starts finds overlaps.
    taken = sorted(base)
    kept, i, reach = [], 0, -1
    for span in sorted(set(out), key=lambda s: (s[0], EXTRA_KINDS.index(s[2]))):
        while i < len(taken) and taken[i][0] < span[1]:
            reach = max(reach, taken[i][1])
            i += 1
        if span[0] >= reach and (not kept or span[0] >= kept[-1][1]):
            kept.append(span)
    return kept


def votes(text: str, span: tuple[int, int, str], strict: bool) -> tuple[int, ...]:
    """Votes (1 for, -1 against, 0 none) of the labelers, then three span features."""
    begin, end, kind = span
    value = text[begin:end]
    digits = "".join(c for c in value if c.isdigit())
    before, after = text[max(0, begin - 40):begin], text[end:end + 20]
    if kind == "card":
        proof = 1 if luhn(digits) else -1
    elif kind == "ip":
        proof = 1 if ":" in value or all(p == "0" or p[0] != "0" for p in value.split(".")) else -1
    elif kind == "iban":
        compact = value.replace(" ", "")
        number = "".join(str(int(c, 36)) for c in compact[4:] + compact[:4])
        proof = 1 if int(number) % 97 == 1 else -1
    elif kind == "ssn":
        proof = -1 if value[:3] in ("000", "666") or value[0] == "9" or value[4:6] == "00" else 1
    elif kind == "phone":
        proof = -1 if len(set(digits)) <= 2 else 1
    else:
        proof = 0
    if kind == "email":
        listed = 1 if value.rsplit(".", 1)[-1].lower() in _TOP else -1
    elif kind == "card":
        listed = 1 if digits[0] in "3456" else -1
    elif kind == "ip":
        listed = -1 if value.startswith(("0.", "255.")) else 0
    elif kind == "iban":
        listed = 1 if _IBAN_LENGTHS.get(value[:2]) == len(value.replace(" ", "")) else 0
    else:
        listed = 0
    context = 1 if _CONTEXT[kind].search(before) else 0
    against = -1 if _AGAINST.search(before) else 0
    edge = (before[-1:] or " ") + (after[:1] or " ")
    shape = -1 if any(c.isalnum() or c in "_=/" for c in edge) else 1
    return (1 if strict else 0, proof, listed, context, against, shape,
            min(3, len(value) // 8), int("\n" in edge), min(3, len(digits) // 5))


LABELERS = 6


def vote_counts(docs: DataFrame, column: str = "text") -> DataFrame:
    """(pattern, n): how often each kind with its votes occurs among all candidates."""
    def run(batches):
        for batch in batches:
            counts = Counter()
            for value in batch.column("text"):
                text = value.as_py() or ""
                strict = base_spans(text)
                for spans, is_strict in ((strict, True), (loose_spans(text, strict), False)):
                    counts.update(f"{s[2]}:" + ",".join(map(str, votes(text, s, is_strict)))
                                  for s in spans)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())],
                ["pattern", "n"])

    return docs.select(F.col(column).alias("text")).mapInArrow(
        run, "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("n"))


def estimate(patterns: list[tuple[str, int]], rounds: int = 50
             ) -> tuple[dict[str, float], np.ndarray]:
    """Likelihood of each pattern, and the reliabilities (labeler, truth, vote).

    Labelers are taken as independent given the truth. The first likelihoods are majority
    votes; counts of a half keep every reliability inside (0, 1).
    """
    kinds = [p.split(":")[0] for p, _ in patterns]
    cast = np.array([[int(v) for v in p.split(":")[1].split(",")][:LABELERS] for p, _ in patterns])
    n = np.array([c for _, c in patterns], float)
    likely = 1 / (1 + np.exp(-cast.sum(axis=1) * 1.5))
    which = {k: np.array([x == k for x in kinds]) for k in set(kinds)}
    table = np.zeros((LABELERS, 2, 3))
    for _ in range(rounds):
        for truth, share in ((0, (1 - likely) * n), (1, likely * n)):
            for i in range(LABELERS):
                counts = np.bincount(cast[:, i] + 1, weights=share, minlength=3) + 0.5
                table[i, truth] = counts / counts.sum()
        odds = np.zeros(len(n))
        for mask in which.values():
            prior = ((likely * n)[mask].sum() + 1) / (n[mask].sum() + 2)
            odds[mask] = math.log(prior / (1 - prior))
        for i in range(LABELERS):
            odds += np.log(table[i, 1, cast[:, i] + 1] / table[i, 0, cast[:, i] + 1])
        likely = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return {p: float(x) for (p, _), x in zip(patterns, likely, strict=True)}, table


def _features(pattern: str) -> np.ndarray:
    kind, rest = pattern.split(":")
    values = [int(v) for v in rest.split(",")]
    return np.array([1.0, *[float(kind == k) for k in EXTRA_KINDS],
                     *[float(v > 0) for v in values[:LABELERS]],
                     *[float(v < 0) for v in values[:LABELERS]],
                     *[v / 3 for v in values[LABELERS:]]])


def train_classifier(patterns: list[tuple[str, int]], likely: dict[str, float],
                     steps: int = 400) -> np.ndarray:
    """Weights of a logistic regression on soft labels, each pattern weighed by log counts."""
    x = np.array([_features(p) for p, _ in patterns])
    y = np.array([likely[p] for p, _ in patterns])
    w = np.log1p([c for _, c in patterns])
    w = w / w.sum()
    beta = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ beta))
        beta -= np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(beta)),
                                x.T @ (w * (p - y)) + 1e-3 * beta) * 0.5
    return beta


def fit(docs: DataFrame, column: str = "text") -> np.ndarray:
    """The span classifier for a corpus. Patterns are bounded by kinds, votes and features."""
    patterns = [(r["pattern"], r["n"]) for r in vote_counts(docs, column).orderBy("pattern").collect()]
    if not patterns:
        return np.zeros(len(_features("email:" + ",".join("0" * (LABELERS + 3)))))
    likely, _ = estimate(patterns)
    return train_classifier(patterns, likely)


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{b}:{e}" for b, e, k in spans)


def find_personal_data(docs: DataFrame, beta: np.ndarray, doc_id: str = "doc_id",
                       column: str = "text") -> DataFrame:
    """doc_id, counts by kind, the hash of the strict spans, and all spans of every text.

    Offsets are code points, the end exclusive. A null or empty text has no spans; repeated
    rows are read each; other columns are not.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(column).alias("text"))
    schema = StructType([rows.schema["doc_id"], *[StructField(f"n_{k}", LongType()) for k in KINDS],
                         StructField("base_sha256", StringType()), StructField("spans", StringType())])

    def run(batches):
        scores: dict[str, bool] = {}
        for batch in batches:
            counts, hashes, every = [], [], []
            for value in batch.column("text"):
                text = value.as_py() or ""
                strict = base_spans(text)
                added = []
                for span in loose_spans(text, strict):
                    pattern = f"{span[2]}:" + ",".join(map(str, votes(text, span, False)))
                    if pattern not in scores:
                        scores[pattern] = float(_features(pattern) @ beta) > 0
                    if scores[pattern]:
                        added.append(span)
                counts.append([sum(s[2] == k for s in strict) for k in KINDS])
                hashes.append(hashlib.sha256(_joined(strict).encode()).hexdigest())
                every.append(_joined(sorted(
                    strict + added, key=lambda s: (s[0], EXTRA_KINDS.index(s[2])))))
            table = np.array(counts, np.int64).reshape(-1, len(KINDS))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(table[:, i]) for i in range(len(KINDS))],
                 pa.array(hashes, pa.string()), pa.array(every, pa.string())], schema.names)

    return rows.mapInArrow(run, schema)
