"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

A text region within e edits of an item of m characters shares at least m - q + 1 - q * e
of its q-grams, all inside a diagonal band as wide as the edits. Shared q-grams are counted
in bands that overlap by half, so that such a region lies wholly in one of them; bands that
reach the bound are aligned, and those within the edit budget are kept. Short items have shorter
q-grams, so that the bound is at least one q-gram for every item at its full budget.

The item table goes to the tasks in blocks of a fixed number of characters, one pass over
the documents for each block; a usual benchmark is one block.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from . import blocks
from .storage import free_name

Q = 7
EDIT_SHARE = 0.12
WHOLE_BELOW = 6
STRETCH = 512
BLOCK_CHARS = 4_000_000
_FILTER_BITS = 22
_SLOT_BITS = 20


def folded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Case-folded code points of a UTF-8 block, any ASCII white space as a blank, and the
    row offsets among them."""
    raw = data.tobytes()
    rows = [raw[a:b].decode("utf-8", "replace").casefold() for a, b in pairwise(offsets.tolist())]
    points = np.frombuffer("".join(rows).encode("utf-32-le", "replace"), np.uint32)
    return (np.where(blocks.SPACE[np.minimum(points, 255)], np.uint32(32), points),
            np.cumsum([0, *map(len, rows)]))


def gram_hashes(points: np.ndarray, q: int) -> np.ndarray:
    values = blocks.mix(points.astype(np.uint64) + np.uint64(1))
    out = np.zeros(max(0, len(points) - q + 1), np.uint64)
    for i in range(q):
        out = out * np.uint64(0x9E3779B97F4A7C15) + values[i:len(points) - q + 1 + i]
    return blocks.mix(out)


@dataclass
class Items:
    """The q-grams of benchmark items with one q, ready for lookups."""

    q: int
    ids: np.ndarray
    texts: list[np.ndarray]
    budgets: np.ndarray
    needed: np.ndarray
    grams: np.ndarray
    first: np.ndarray
    item: np.ndarray
    place: np.ndarray
    filter: np.ndarray


def prepare(rows: list[tuple[int, str]], q: int, share: float) -> list[Items]:
    """The items of ``WHOLE_BELOW`` or more characters, in one table for each length of grams.

    An item of m characters and e edits has grams of ``q`` characters or of m // (e + 1), the
    longest of which e edits cannot touch all.
    """
    tables: dict[int, list[tuple[int, np.ndarray, int]]] = {}
    for i, text in rows:
        data = np.frombuffer(text.strip().encode(), np.uint8)
        points = folded(data, np.array([0, len(data)]))[0]
        if len(points) >= WHOLE_BELOW:
            budget = int(len(points) * share + 1e-9)
            tables.setdefault(max(1, min(q, len(points) // (budget + 1))), []).append(
                (i, points, budget))
    return [_table(q, entries) for q, entries in sorted(tables.items())]


def whole_items(rows: list[tuple[int, str]]) -> dict[bytes, list[int]]:
    """The items of fewer characters by their folded code points: every text of some length
    holds such letters by chance, so they are looked for as whole texts."""
    out: dict[bytes, list[int]] = {}
    for i, text in rows:
        data = np.frombuffer(text.strip().encode(), np.uint8)
        points = folded(data, np.array([0, len(data)]))[0]
        if 0 < len(points) < WHOLE_BELOW:
            out.setdefault(points.tobytes(), []).append(i)
    return out


def trimmed(points: np.ndarray) -> np.ndarray:
    """``points`` without blanks at both ends."""
    dark = points != 32
    return points[dark.argmax():len(dark) - dark[::-1].argmax()] if dark.any() else points[:0]


def _table(q: int, entries: list[tuple[int, np.ndarray, int]]) -> Items:
    texts = [t for _, t, _ in entries]
    sizes = np.array([len(t) for t in texts], np.int64)
    budgets = np.array([e for *_, e in entries], np.int64)
    hashes = [gram_hashes(t, q) for t in texts]
    item = np.repeat(np.arange(len(texts)), [len(h) for h in hashes])
    place = np.concatenate([np.zeros(0, np.int64), *[np.arange(len(h)) for h in hashes]])
    every = np.concatenate([np.zeros(0, np.uint64), *hashes])
    order = np.argsort(every, kind="stable")
    grams, first = np.unique(every[order], return_index=True)
    bits = np.zeros(1 << _FILTER_BITS, bool)
    bits[(grams >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
    return Items(q, np.array([i for i, *_ in entries], np.int64), texts, budgets,
                 np.maximum(1, sizes - q + 1 - q * budgets), grams,
                 np.append(first, len(every)), item[order], place[order], bits)


def banded_distance(item: np.ndarray, region: np.ndarray, budget: int) -> int | None:
    """Least edits that turn ``item`` into some part of ``region``, if within the budget.

    Only diagonals that the region allows are filled; the part may begin and end anywhere.
    """
    m, width = len(item), len(region) - len(item)
    if width < -budget:
        return None
    low, high = -budget, width + budget
    offsets = np.arange(low, high + 1)
    big = m + len(region) + 1
    row = np.where((offsets >= 0) & (offsets <= len(region)), 0, big)
    padded = np.full(m + len(region) + 2 * (budget + abs(width)) + 4, -1, np.int64)
    shift = budget + 1
    padded[shift:shift + len(region)] = region
    for i in range(1, m + 1):
        ends = offsets + i
        same = padded[shift + low + i - 1:shift + high + i] == item[i - 1]
        best = np.minimum(row + ~same, np.append(row[1:], big) + 1)
        best[(ends < 0) | (ends > len(region))] = big
        row = np.minimum.accumulate(best - offsets) + offsets
        row[(ends < 0) | (ends > len(region))] = big
        if row.min() > budget:
            return None
    least = int(row.min())
    return least if least <= budget else None


def _slots(pair: np.ndarray) -> np.ndarray:
    spread = pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (spread >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)


def _dense(spot: np.ndarray, item: np.ndarray, items: Items) -> np.ndarray:
    """Which hits lie where an item has enough of them in neighbouring stretches of text.

    A stretch is longer than any region of its item, so a region lies in two neighbours.
    """
    many = len(items.ids)
    length = max(STRETCH, int((np.array([len(t) for t in items.texts]) + 2 * items.budgets + 1).max()))
    pair = spot // length * many + item
    # Counters shared by several pairs are never too low; what they leave is counted exactly.
    shared = np.bincount(_slots(pair), minlength=1 << _SLOT_BITS)
    most = shared[_slots(pair)] + np.maximum(shared[_slots(pair - many)], shared[_slots(pair + many)])
    maybe = np.flatnonzero(most >= items.needed[item])
    if not len(maybe):
        return maybe
    # Only pairs that occur are counted: memory follows the hits.
    pair, of, count = np.unique(pair[maybe], return_inverse=True, return_counts=True)

    def beside(step: int) -> np.ndarray:
        at = np.minimum(np.searchsorted(pair, pair + step), len(pair) - 1)
        return np.where(pair[at] == pair + step, count[at], 0)

    enough = np.maximum(beside(-many), beside(many)) + count >= items.needed[pair % many]
    return maybe[enough[of]]


def matches(points: np.ndarray, firsts: np.ndarray, items: Items) -> list[tuple[int, int, int]]:
    """(row, item index, edits) of the items found in each row of a block, best first."""
    grams = gram_hashes(points, items.q)
    maybe = np.flatnonzero(items.filter[(grams >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
    at = np.searchsorted(items.grams, grams[maybe])
    known = at < len(items.grams)
    known[known] = items.grams[at[known]] == grams[maybe[known]]
    at, maybe = at[known], maybe[known]
    count = items.first[at + 1] - items.first[at]
    entry = np.repeat(items.first[at] - np.cumsum(count) + count, count) + np.arange(count.sum())
    item = items.item[entry]
    spot = np.repeat(maybe, count)
    near = _dense(spot, item, items)
    item, spot, place = item[near], spot[near], items.place[entry[near]]
    diagonal = spot - place + 1_000_000
    row = np.searchsorted(firsts, spot, side="right") - 1
    step = items.budgets[item] + 1
    found: dict[tuple[int, int], int] = {}
    for half in (0, 1):
        band = (diagonal + half * step) // (2 * step)
        # Every q-gram of the item counts once in a band.
        key = np.stack([row, item, band, place])[:, np.lexsort((place, band, item, row))]
        if not key.shape[1]:
            break
        key = key[:3, np.append(True, (key[:, 1:] != key[:, :-1]).any(axis=0))]
        cut = np.flatnonzero(np.append(True, (key[:, 1:] != key[:, :-1]).any(axis=0)))
        many = np.diff(np.append(cut, key.shape[1])) >= items.needed[key[1, cut]]
        for r, i, b in key[:, cut[many]].T.tolist():
            if found.get((r, i)) == 0:
                continue
            text, budget = items.texts[i], int(items.budgets[i])
            start = b * 2 * (budget + 1) - half * (budget + 1) - 1_000_000
            low = max(int(firsts[r]), start - budget)
            high = min(int(firsts[r + 1]), start + 3 * (budget + 1) + len(text) + budget)
            region = points[low:high]
            exact = text.tobytes() in region.tobytes() and any(
                np.array_equal(region[p:p + len(text)], text)
                for p in np.flatnonzero(region == text[0])) if len(text) else False
            edits = 0 if exact else banded_distance(text, region, budget)
            if edits is not None and edits < found.get((r, i), budget + 1):
                found[r, i] = edits
    return [(r, i, e) for (r, i), e in found.items()]


def _blocks_of_items(benchmark: DataFrame, item_id: str, text: str):
    part, size = [], 0
    rows = benchmark.select(F.col(item_id).alias("i"), F.col(text).alias("t")).where(
        F.length(F.trim("t")) > 0)
    for row in rows.toLocalIterator():
        part.append((row["i"], row["t"]))
        size += len(row["t"])
        if size >= BLOCK_CHARS:
            yield part
            part, size = [], 0
    if part:
        yield part


def find_benchmark_items(docs: DataFrame, benchmark: DataFrame, q: int = Q,
                         share: float = EDIT_SHARE, result: str = "_items") -> DataFrame:
    """All columns of ``docs`` plus ``result``: sorted (item_id, edits) found in the text.

    An item is found where a stretch of the text is within ``share`` of the item's length
    in edits, both case-folded and every white space as a blank. A null or empty text holds
    nothing. An item shorter than ``WHOLE_BELOW`` characters is found where it is the whole
    text but for white space around it, one without text nowhere; equal items are all reported, and an empty benchmark leaves every list empty. A
    column of ``docs`` named like the result is replaced by it.
    """
    kind = ArrayType(StructType([StructField("item_id", LongType()),
                                 StructField("edits", LongType())]))
    out = docs.withColumn(result, F.array().cast(kind))
    names = [c for c in docs.columns if c != result]
    found = free_name("_found", out.columns)
    for rows in _blocks_of_items(benchmark, "item_id", "text"):
        tables, whole = prepare(rows, q, share), whole_items(rows)

        def run(batches, tables=tables, whole=whole):
            for batch in batches:
                texts = batch.column(batch.schema.get_field_index("text"))
                lists = []
                for low, high, data, offsets in blocks.text_blocks(texts):
                    here = [[] for _ in range(low, high)]
                    points, firsts = folded(data, offsets)
                    for items in tables:
                        for r, i, e in matches(points, firsts, items):
                            here[r].append({"item_id": int(items.ids[i]), "edits": e})
                    for r in range(high - low) if whole else ():
                        text = trimmed(points[firsts[r]:firsts[r + 1]])
                        here[r] += [{"item_id": int(i), "edits": 0} for i in whole.get(
                            text.tobytes() if len(text) < WHOLE_BELOW else b"", ())]
                    lists += here
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(lists, pa.list_(pa.struct(
                        [("item_id", pa.int64()), ("edits", pa.int64())])))],
                    [*batch.schema.names, found])

        out = out.mapInArrow(run, StructType([*out.schema.fields, StructField(found, kind)]))
        out = out.select(*[F.col(f"`{n}`") for n in names], F.array_sort(
            F.concat(F.col(f"`{result}`"), F.col(found))).alias(result))
    return out
