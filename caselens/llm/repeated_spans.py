"""Removal of repeated byte strings with suffix arrays built by induced sorting.

A string of LENGTH bytes is repeated when it starts anywhere else in the corpus. Each such
string has an anchor, the k-gram with the least hash among its k-grams, and equal strings
have equal anchors. So the strings of a text fall into extents, one per anchor, and only
extents with one anchor hash need to meet:

* an anchor that occurs once: none of its strings is repeated;
* an extent that occurs twice as a whole: all of its strings are repeated;
* different extents with one anchor: their bytes go to shards, groups kept together, and
  each shard's suffix array and permuted common prefixes tell which strings are repeated.

A group of more different extents than GROUP_MOST is not gathered: its strings are counted
one by one by their hashes, spread over all tasks.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..session import cut_lineage
from . import blocks
from .induced_sorting import repeated_starts

LENGTH, GRAM = 200, 100
SHARD_BYTES = 1 << 18
GROUP_MOST = 2000
BROADCAST_ROWS = 1 << 20
_MOST = np.uint64(0xFFFFFFFFFFFFFFFF)


def extents(data: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """(anchor hash, extent hash, first start, last start) of all extents of a text."""
    n, width = len(data) - gram + 1, length - gram + 1
    if len(data) < length:
        return [np.zeros(0, np.uint64)] * 2 + [np.zeros(0, np.int64)] * 2
    running = blocks.prefix_hash(data)
    _, down = blocks.powers(len(running))
    grams = (running[gram:] - running[:-gram]) * down[:n]
    grams = (grams ^ (grams >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    grams ^= grams >> np.uint64(29)
    # Least hash of every window, from running minima inside aligned rows.
    rows = np.append(grams, np.full(-n % width, _MOST)).reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    count = n - width + 1
    least = np.minimum(behind[:count], ahead[width - 1:width - 1 + count])
    first = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
    last = np.append(first[1:], count) - 1
    more = _repeated_anchors(grams, least, first, last, width)
    if len(more):
        first = np.unique(np.concatenate([first, more]))
        last = np.append(first[1:], count) - 1
    return least[first], blocks.span_hash(running, first, last + length), first, last


def _repeated_anchors(grams: np.ndarray, least: np.ndarray, first: np.ndarray,
                      last: np.ndarray, width: int) -> np.ndarray:
    """Starts after which an extent goes on with a later copy of its anchor.

    An anchor is the leftmost of equal ones, so the strings of periodic text, which has the
    same anchor again and again, belong to one extent per copy.
    """
    out = [np.zeros(0, np.int64)]
    reach = np.arange(2 * width)
    for low in range(0, len(first), 4096):
        begin, end = first[low:low + 4096], last[low:low + 4096]
        at = np.minimum(begin[:, None] + reach, len(grams) - 1)
        copies = ((grams[at] == least[begin][:, None]) & (at < (end + width)[:, None])
                  & (reach < (len(grams) - begin)[:, None])).sum(axis=1)
        for i in np.flatnonzero((copies > 1) | (end - begin >= width)):
            place = np.flatnonzero(grams[begin[i]:end[i] + width] == least[begin[i]]) + begin[i] + 1
            out.append(place[place <= end[i]])
    return np.concatenate(out)


def _bytes_of(batch: pa.RecordBatch, name: str):
    """Row number and bytes of each text of a batch."""
    row = 0
    for low, high, data, offsets in blocks.text_blocks(batch.column(batch.schema.get_field_index(name))):
        for i in range(high - low):
            yield row, data[offsets[i]:offsets[i + 1]]
            row += 1


def _extent_rows(batches):
    for batch in batches:
        ids = np.array(batch.column("t").to_pylist(), np.int64)
        parts = [(row, extents(data)) for row, data in _bytes_of(batch, "text")]
        if parts:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([e[0] for _, e in parts]).view(np.int64)),
                 pa.array(np.concatenate([e[1] for _, e in parts]).view(np.int64)),
                 pa.array(np.repeat(ids, [len(e[0]) for _, e in parts])),
                 pa.array(np.concatenate([e[2] << 24 | (e[3] - e[2]) for _, e in parts]))],
                ["h", "e", "t", "at"])


def _cut_extents(batches):
    for batch in batches:
        columns = [[], [], [], []]
        wanted = batch.column("wanted").to_pylist()
        ids = batch.column("t").to_pylist()
        for row, data in _bytes_of(batch, "text"):
            for w in wanted[row]:
                begin, span = w["at"] >> 24, w["at"] & 0xFFFFFF
                for c, v in zip(columns, (w["h"], ids[row], w["at"],
                                          data[begin:begin + span + LENGTH].tobytes()), strict=True):
                    c.append(v)
        yield pa.RecordBatch.from_arrays(
            [*[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3], pa.binary())],
            ["h", "t", "at", "bytes"])


def _runs(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[False], found, [False]]).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


def _shard(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    """Repeated starts, as ranges in their texts, among the extents of one shard."""
    parts, begins, at = [], [], 0
    for _, _, value in rows:
        begins.append(at)
        parts += [np.frombuffer(value, np.uint8).astype(np.int64) + 2, np.ones(1, np.int64)]
        at += len(value) + 1
    found = repeated_starts(np.concatenate(parts), LENGTH)
    ids, first, last = [], [], []
    for (t, place, value), begin in zip(rows, begins, strict=True):
        a, b = _runs(found[begin:begin + len(value) - LENGTH + 1])
        ids += [t] * len(a)
        first += (a + (place >> 24)).tolist()
        last += (b + (place >> 24)).tolist()
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (ids, first, last)],
                                      ["t", "first", "last"])


def _sharded(batches):
    """Rows arrive in order of h; a shard is closed where h changes beyond its size."""
    rows, size, seen = [], 0, None
    for batch in batches:
        for h, t, at, value in zip(*[batch.column(c).to_pylist() for c in
                                     ("h", "t", "at", "bytes")], strict=True):
            if h != seen and size >= SHARD_BYTES:
                yield _shard(rows)
                rows, size = [], 0
            seen = h
            rows.append((t, at, value))
            size += len(value)
    if rows:
        yield _shard(rows)


def _single_strings(batches):
    """Every string of an extent by its hash, for groups too large to gather."""
    for batch in batches:
        for t, at, value in zip(*[batch.column(c).to_pylist() for c in ("t", "at", "bytes")],
                                strict=True):
            running = blocks.prefix_hash(np.frombuffer(value, np.uint8))
            start = np.arange(len(value) - LENGTH + 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(blocks.span_hash(running, start, start + LENGTH).view(np.int64)),
                 pa.array(np.full(len(start), t)), pa.array(start + (at >> 24))],
                ["w", "t", "first"])


def _digest(batches):
    for batch in batches:
        sizes, removed, spans, hashes = [], [], [], []
        ranges = batch.column("ranges").to_pylist()
        for row, data in _bytes_of(batch, "text"):
            gone = np.zeros(len(data) + 1, np.int64)
            for r in ranges[row] or []:
                gone[r["first"]] += 1
                gone[r["last"] + LENGTH] -= 1
            keep = np.cumsum(gone)[:-1] == 0
            sizes.append(len(data))
            removed.append(int(len(data) - keep.sum()))
            spans.append(len(_runs(~keep)[0]))
            hashes.append(hashlib.sha256(data[keep].tobytes()).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in (sizes, removed, spans)],
             pa.array(hashes, pa.string())],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeated_ranges(texts: DataFrame) -> DataFrame:
    """(t, first, last): ranges of starts of repeated strings, for ``texts`` (t, text)."""
    every = texts.mapInArrow(_extent_rows, "h long, e long, t long, at long")
    shared = every.groupBy("h").agg(F.count("*").alias("_n"), F.min("e").alias("_p"),
                                    F.max("e").alias("_q")).where("_n > 1").select(
        "h", (F.col("_p") == F.col("_q")).alias("equal"))
    rows = cut_lineage(every.join(shared, "h"))
    ends = [F.shiftright("at", 24).alias("first"),
            (F.shiftright("at", 24) + F.col("at").bitwiseAND(0xFFFFFF)).alias("last")]
    mixed = cut_lineage(rows.where("not equal").groupBy("h", "e").agg(
        F.count("*").alias("n"), F.min(F.struct("t", "at")).alias("_r")))
    whole = rows.where("equal").select("t", *ends).unionByName(
        rows.where("not equal").join(mixed.where("n > 1").select("h", "e"), ["h", "e"]).select(
            "t", *ends))
    wanted = mixed.groupBy(F.col("_r.t").alias("t")).agg(
        F.collect_list(F.struct("h", F.col("_r.at").alias("at"))).alias("wanted"))
    cut = _few_first(texts, wanted).groupBy("t").agg(F.first("text").alias("text")).join(
        wanted, "t").mapInArrow(_cut_extents, "h long, t long, at long, bytes binary")
    giant = cut_lineage(mixed.groupBy("h").agg(F.count("*").alias("_n")).where(
        F.col("_n") > GROUP_MOST).select("h", F.lit(True).alias("giant")))
    if giant.isEmpty():
        usual = cut
    else:
        marked = cut_lineage(cut.join(giant, "h", "left"))
        usual = marked.where("giant is null").drop("giant")
        strings = marked.where("giant").mapInArrow(_single_strings, "w long, t long, first long")
        many = strings.groupBy("w").agg(F.count("*").alias("_n")).where("_n > 1").select("w")
        whole = whole.unionByName(strings.join(many, "w").select(
            "t", "first", F.col("first").alias("last")))
    sharded = usual.repartition("h").sortWithinPartitions("h", "t", "at").mapInArrow(
        _sharded, "t long, first long, last long")
    return whole.unionByName(sharded)


def _few_first(texts: DataFrame, few: DataFrame) -> DataFrame:
    """The rows of ``texts`` whose t is in ``few``; small id sets filter before any shuffle."""
    ids = cut_lineage(few.select("t").distinct())
    return texts.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, "t", "left_semi")


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: n_bytes, n_removed, n_spans and the hash of the bytes that remain.

    Every byte of a repeated string of LENGTH bytes goes, at all its places; strings are
    judged on the input, and none reaches over the end of a text. Equal texts are each
    other's repeats. A null or empty text has no bytes; other columns are not read.
    Strings meet by 64-bit hashes of at least GRAM bytes.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"),
                       F.coalesce(F.col(text), F.lit("")).alias("text"))
    texts = rows.select(F.xxhash64("text").alias("t"), "text")
    ranges = cut_lineage(repeated_ranges(texts).groupBy("t").agg(
        F.collect_set(F.struct("first", "last")).alias("ranges")))
    known = ranges.select("t", F.lit(True).alias("_known"))
    small = ranges.count() <= BROADCAST_ROWS
    marked = rows.withColumn("t", F.xxhash64("text")).join(
        F.broadcast(known) if small else known, "t", "left")
    none = F.array().cast(ranges.schema["ranges"].dataType)
    plain = marked.where("_known is null").select("doc_id", "text", none.alias("ranges"))
    changed = marked.where("_known").join(ranges, "t").select("doc_id", "text", "ranges")
    schema = StructType([rows.schema["doc_id"], *[StructField(n, LongType()) for n in
                         ("n_bytes", "n_removed", "n_spans")], StructField("kept_sha256", StringType())])
    return plain.unionByName(changed).mapInArrow(_digest, schema)
