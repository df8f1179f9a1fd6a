"""Hard negatives: near rows of another label, in a window below each positive's score.

Scores are whole numbers: components are quantised and products are exact. Anchors and
candidates are cut into blocks of bounded rows, every pair of blocks is one cell, and a cell
multiplies tile by tile by Strassen's recursion. What a cell keeps are heaps of the first few
rows of each anchor (or of each window); heaps merge tile by tile inside a cell and, through
limited windows, between cells. The first round finds the positives of each anchor, whose
scores are the windows of the second round.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import stored
from .strassen import strassen

ANCHOR_ROWS, CANDIDATE_ROWS, TILE = 4096, 8192, 512
SCALE = 256
# By Cauchy and Schwarz no score exceeds this bound on squared lengths, and a hundredfold
# score still fits 64 bits.
MOST_SQUARE = float(1 << 56)
_NONE = np.iinfo(np.int64).min


class Heap:
    """The first ``k`` (score, id) of each of ``n`` rows: higher scores first, ties by the
    smaller id, an id once with its best score. Two heaps merge into one."""

    def __init__(self, n: int, k: int):
        self.k, self.n = k, n
        self.row = self.score = self.id = np.zeros(0, np.int64)

    def add(self, row: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        row, score, ids = (np.concatenate(p) for p in (
            (self.row, row), (self.score, score), (self.id, ids)))
        best = np.lexsort((-score, ids, row))
        row, score, ids = row[best], score[best], ids[best]
        once = np.append(True, (row[1:] != row[:-1]) | (ids[1:] != ids[:-1]))[:len(row)]
        row, score, ids = row[once], score[once], ids[once]
        order = np.lexsort((ids, -score, row))
        row = row[order]
        first = np.searchsorted(row, row)
        kept = np.arange(len(row)) - first < self.k
        self.row, self.score, self.id = row[kept], score[order][kept], ids[order][kept]

    def merge(self, other: Heap) -> None:
        self.add(other.row, other.score, other.id)

    def add_tile(self, scores: np.ndarray, allowed: np.ndarray, row: np.ndarray, ids: np.ndarray) -> None:
        """The allowed entries of a tile that can be among the first ``k`` of their row; ``row``
        names the tile's rows. A row that already has k entries asks for at least the last."""
        least = np.full(self.n, _NONE)
        if len(self.row):
            count = np.bincount(self.row, minlength=self.n)
            ends = np.cumsum(count)
            full = count == self.k
            least[full] = self.score[ends[full] - 1]
        masked = np.where(allowed & (scores >= least[row][:, None]), scores, _NONE)
        if masked.shape[1] > self.k:
            cut = np.partition(masked, masked.shape[1] - self.k, axis=1)[:, -self.k]
            # An id that is there twice needs room for those behind it.
            if len(np.unique(ids)) < len(ids):
                cut = np.full(len(masked), _NONE)
        else:
            cut = np.full(len(masked), _NONE)
        at, place = np.nonzero((masked >= cut[:, None]) & (masked > _NONE))
        if len(at):
            self.add(row[at], masked[at, place], ids[place])


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as int64, shorter ones filled up with zeros."""
    out = np.zeros((len(column), width), np.int64)
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(column)), lengths)
    place = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[row, place] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _tiles(anchors: pa.Table, rows: pa.Table, width: int):
    """(anchor slice, row slice, scores) of all tiles of a cell."""
    one = lambda t: _matrix(t.column("v").combine_chunks(), width)
    a, b = one(anchors), one(rows).T.copy()
    for i in range(0, a.shape[0], TILE):
        for j in range(0, b.shape[1], TILE):
            yield slice(i, i + TILE), slice(j, j + TILE), strassen(a[i:i + TILE], b[:, j:j + TILE])


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy().astype(np.int64)


def _positive_cell(width: int, k: int):
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        ids, labels = _numbers(anchors, "id"), _numbers(anchors, "label")
        row_ids, row_labels = _numbers(rows, "id"), _numbers(rows, "label")
        heap = Heap(len(ids), k)
        for i, j, scores in _tiles(anchors, rows, width):
            allowed = (labels[i][:, None] == row_labels[j]) & (ids[i][:, None] != row_ids[j])
            heap.add_tile(scores, allowed, np.arange(len(ids))[i], row_ids[j])
        return pa.table({"anchor_id": ids[heap.row], "positive_id": heap.id,
                         "positive_score": heap.score})
    return run


def _negative_cell(width: int, k: int, low: int, high: int):
    """Windows: a row of the heap is an (anchor, positive), of which an anchor has few."""
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        labels, row_ids, row_labels = (
            _numbers(anchors, "label"), _numbers(rows, "id"), _numbers(rows, "label"))
        found = anchors.column("positives").combine_chunks()
        count = found.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        first = np.cumsum(count) - count
        items = found.flatten()
        positive, top = (items.field(n).to_numpy(zero_copy_only=False).astype(np.int64)
                         for n in ("positive_id", "positive_score"))
        heap = Heap(len(top), k)
        for i, j, scores in _tiles(anchors, rows, width):
            other = labels[i][:, None] != row_labels[j]
            for nth in range(int(count[i].max(initial=0))):
                at = np.flatnonzero(count[i] > nth)
                window = first[i][at] + nth
                bound, own = top[window][:, None], scores[at]
                heap.add_tile(own, other[at] & (low * bound <= 100 * own) & (own * 100 <= high * bound),
                              window, row_ids[j])
        at = np.repeat(np.arange(len(count)), count)[heap.row]
        return pa.table({"anchor_id": _numbers(anchors, "id")[at], "positive_id": positive[heap.row],
                         "positive_score": top[heap.row], "negative_id": heap.id,
                         "negative_score": heap.score})
    return run


def quantised(vectors: DataFrame, vec_id: str, embedding: str, label: Column) -> DataFrame:
    """(id, label, v): whole components floor(256 x) of the rows that take part."""
    whole = vectors.select(F.col(vec_id).cast("long").alias("id"), label.cast("long").alias("label"),
                           F.col(embedding).alias("x")).where(
        F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & F.forall(
            "x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    scaled = whole.withColumn("x", F.transform("x", lambda x: F.floor(x.cast("double") * SCALE)))
    square = F.aggregate("x", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return scaled.where(square <= MOST_SQUARE).withColumnRenamed("x", "v")


def _cells(anchors: DataFrame, rows: DataFrame, anchor_blocks: int, row_blocks: int):
    """Both sides by cell: each anchor goes to all blocks of rows, each row to all of anchors."""
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block = lambda n: F.pmod("place", F.lit(n)).cast("int")
    left = anchors.withColumns({"_a": block(anchor_blocks), "_r": spread(row_blocks)})
    right = rows.withColumns({"_r": block(row_blocks), "_a": spread(anchor_blocks)})
    return left.groupBy("_a", "_r").cogroup(right.groupBy("_a", "_r"))


def _first(found: DataFrame, keys: list[str], score: str, item: str, k: int) -> DataFrame:
    """The heaps of all cells merged: every task cuts its rows to k of a key before they move."""
    best = found.groupBy(*keys, item).agg(F.max(score).alias(score))
    order = Window.partitionBy(*keys).orderBy(F.desc(score), item)
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5,
                   low: int = 80, high: int = 100, vec_id: str = "vec_id",
                   embedding: str = "embedding", label: Column | str = "label") -> DataFrame:
    """The first ``negatives`` rows of another label whose score lies in the window of a positive.

    Anchors are ids divisible by ``every``; an anchor's positives are its first ``positives``
    other ids of its label, and the window of one is low * positive <= 100 * negative <= high *
    positive. Scores are inner products of floor(256 x); higher scores first, ties by the smaller
    id. Returns anchor_id, positive_id, rank (from 1), negative_id, positive_score and
    negative_score; a positive without negatives has no row.

    Rows with a null id, label or vector, or a null or non-finite component, take no part, nor do
    vectors with a squared length above 2**56 after quantising, whose scores could leave 64 bits.
    A shorter vector counts as filled up with zeros, an empty one scores 0. Rows that repeat an
    id are that id: as candidates with their best score, as an anchor with the least (label,
    vector). An empty table gives no rows. Other columns are not read.
    """
    label = F.col(label) if isinstance(label, str) else label
    rows = stored(quantised(vectors, vec_id, embedding, label).withColumn(
        "place", F.monotonically_increasing_id()), "vectors")
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    row_blocks, width = max(1, -(-size["n"] // CANDIDATE_ROWS)), max(1, size["width"] or 0)
    anchors = stored(rows.where(F.col("id") % every == 0).groupBy("id").agg(
        F.min(F.struct("label", "v")).alias("_")).select("id", "_.label", "_.v").withColumn(
        "place", F.xxhash64("id")), "anchors")
    anchor_blocks = max(1, -(-anchors.count() // ANCHOR_ROWS))
    near = _cells(anchors, rows, anchor_blocks, row_blocks).applyInArrow(
        _positive_cell(width, positives), "anchor_id long, positive_id long, positive_score long")
    near = _first(near, ["anchor_id"], "positive_score", "positive_id", positives)
    # An anchor has ``positives`` rows here at most.
    windows = near.groupBy(F.col("anchor_id").alias("id")).agg(
        F.collect_list(F.struct("positive_id", "positive_score")).alias("positives"))
    asked = stored(anchors.join(windows, "id"), "asked")
    found = _cells(asked, rows, anchor_blocks, row_blocks).applyInArrow(
        _negative_cell(width, negatives, low, high),
        "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    return _first(found, ["anchor_id", "positive_id", "positive_score"], "negative_score",
                  "negative_id", negatives).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
