"""Maximal runs of repeated word sequences in whole texts.

Suffixes of word sequences are sorted by rank doubling, many texts at once: a word counts as
equal only inside its text. Then suffix classes are united by decreasing common prefix, as in
Kruskal's algorithm: the neighbours in suffix order are the edges, a class is an ordered set of
positions, and the smaller of two classes goes into the larger. When a union at prefix length l
makes two positions adjacent whose distance d is at most l, the words between them repeat: they
seed a run of period d. Every maximal run has exactly one such seed at its start, at which l is
the whole common prefix, so the run ends there and d is its smallest period.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import (
    ArrayType, LongType, StringType, StructField, StructType,
)

from . import blocks

RUN = StructType([StructField(n, LongType()) for n in ("start", "length", "period")])


def doubled_ranks(keys: np.ndarray) -> list[np.ndarray]:
    """Ranks of the positions by their first 1, 2, 4, … values.

    Positions share a rank of a level when that many values are equal; the last ranks differ
    and order all suffixes. Only positions that still share a rank are sorted on.
    """
    n = len(keys)
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    begin = np.append(True, ordered[1:] != ordered[:-1])
    rank = np.empty(n, np.int64)
    rank[order] = np.flatnonzero(begin)[np.cumsum(begin) - 1]
    ranks, width = [rank], 1
    tied = np.sort(order[~(begin & np.append(begin[1:], True))])
    while len(tied):
        after = tied + width
        second = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        first = rank[tied]
        by = np.argsort(first * (n + 1) + second, kind="stable")
        first, second, tied = first[by], second[by], tied[by]
        new = np.append(True, first[1:] != first[:-1])
        begin = new | np.append(True, second[1:] != second[:-1])
        starts = np.flatnonzero(begin)[np.cumsum(begin) - 1]
        rank = rank.copy()
        rank[tied] = first + starts - np.flatnonzero(new)[np.cumsum(new) - 1]
        ranks.append(rank)
        width *= 2
        tied = tied[~(begin & np.append(begin[1:], True))]
    return ranks


def common_prefixes(ranks: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, next position in suffix order, common prefix) where it is ``least`` or more."""
    n = len(ranks[0])
    order = np.argsort(ranks[-1], kind="stable")
    a, b = order[:-1], order[1:]
    level = min(len(ranks), least.bit_length()) - 1
    near = ranks[level][a] == ranks[level][b]
    a, b = a[near], b[near]
    length = np.zeros(len(a), np.int64)
    for k in reversed(range(len(ranks))):
        i, j = a + length, b + length
        inside = np.maximum(i, j) < n
        same = inside & (ranks[k][np.minimum(i, n - 1)] == ranks[k][np.minimum(j, n - 1)])
        length += same.astype(np.int64) << k
    long = length >= least
    return a[long], b[long], length[long]


def united(a: np.ndarray, b: np.ndarray, length: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """Seeds (i, j, l): positions that a union at prefix length l made adjacent, j - i <= l."""
    owner: dict[int, list[int]] = {}
    left, right, prefix = [], [], []

    def seed(i: int, j: int, common: int) -> None:
        if j - i <= common:
            left.append(i)
            right.append(j)
            prefix.append(common)

    by = np.argsort(-length, kind="stable")
    for x, y, common in zip(a[by].tolist(), b[by].tolist(), length[by].tolist(), strict=True):
        large, small = owner.get(x) or [x], owner.get(y) or [y]
        if len(large) < len(small):
            large, small = small, large
        if len(small) == 1:
            item = small[0]
            at = bisect_left(large, item)
            if at:
                seed(large[at - 1], item, common)
            if at < len(large):
                seed(item, large[at], common)
            large.insert(at, item)
            owner[item] = large
            if len(large) == 2:
                owner[x] = owner[y] = large
            continue
        own = set(small)
        if len(small) * 8 < len(large):
            for item in small:
                insort(large, item)
        else:
            large += small
            large.sort()  # two sorted runs: one merge
        for item in small:
            owner[item] = large
            at = bisect_left(large, item)
            if at and large[at - 1] not in own:
                seed(large[at - 1], item, common)
            if at + 1 < len(large) and large[at + 1] not in own:
                seed(item, large[at + 1], common)
    return left, right, prefix


def maximal_runs(keys: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of the maximal runs of ``least`` values or more, and at least
    two periods, by start and period. Equal keys are equal values."""
    none = np.zeros(0, np.int64)
    shared = (least + 1) // 2  # a run of period q shares its length less q >= half of it
    if len(keys) < 2:
        return none, none, none
    ranks = doubled_ranks(keys)
    i, j, common = (np.array(v, np.int64) for v in united(*common_prefixes(ranks, shared)))
    # A seed inside a run is not where the run starts.
    inner = (i > 0) & (keys[np.maximum(i, 1) - 1] == keys[np.maximum(j, 1) - 1])
    whole = ~inner & (j - i + common >= least)
    start, period, length = i[whole], (j - i)[whole], (j - i + common)[whole]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, firsts: np.ndarray,
            kept: np.ndarray) -> pa.Array:
    """The kept words of each row joined by one space."""
    before = np.concatenate([[0], np.cumsum(kept)])[firsts]
    starts, size = starts[kept], (ends - starts)[kept]
    places = np.cumsum(size + 1) - size - 1
    total = int(size.sum()) + len(size)
    out = np.full(total, 0x20, np.uint8)
    inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(places, size) + inner] = data[np.repeat(starts, size) + inner]
    text = out.tobytes()
    edges = np.append(places, total)[before]
    return pa.array([text[a:max(a, b - 1)].decode("utf-8", "replace") for a, b in
                     zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)], pa.string())


def find_runs(docs: DataFrame, least: int = 12, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Maximal runs of word sequences and the text with each repeated part once.

    Words are runs without ASCII white space. Returns one row per input row: doc_id, runs (array
    of start, length and period in words, by start and period: stretches of at least ``least``
    words and two smallest periods that no neighbouring word extends) and collapsed (the words
    that no run contains after its first period, joined by one space). A null, empty or blank
    text has no runs and an empty collapsed text; null ids and repeated rows keep their rows, an
    empty table gives none. Other columns are not read. Words are compared by 64-bit hashes. A
    text is worked on whole, in memory of its own size times about two hundred bytes a word.
    """
    kind = docs.schema[doc_id].dataType
    schema = StructType([StructField("doc_id", kind), StructField("runs", ArrayType(RUN)),
                         StructField("collapsed", StringType())])

    def run(batches):
        for batch in batches:
            for low, high, data, offsets in blocks.text_blocks(batch.column(1)):
                starts, ends, firsts = blocks.word_spans(data, offsets, blocks.SPACE)
                row_of = np.repeat(np.arange(high - low), np.diff(firsts))
                words = blocks.span_hash(blocks.prefix_hash(data), starts, ends)
                # A word of one row is never equal to one of another.
                keys = words + blocks.mix(row_of.astype(np.uint64) + np.uint64(1))
                start, length, period = maximal_runs(keys, least)
                change = np.zeros(len(words) + 1, np.int64)
                np.add.at(change, start + period, 1)
                np.add.at(change, start + length, -1)
                kept = np.cumsum(change[:-1]) == 0
                of = row_of[start]
                lists = pa.ListArray.from_arrays(
                    pa.array(np.searchsorted(of, np.arange(high - low + 1)), pa.int32()),
                    pa.StructArray.from_arrays(
                        [pa.array(start - firsts[of]), pa.array(length), pa.array(period)],
                        ["start", "length", "period"]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, high - low), lists,
                     _joined(data, starts, ends, firsts, kept)], schema.names)

    return docs.select(doc_id, text).mapInArrow(run, schema)
