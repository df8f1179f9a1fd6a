"""Nearest neighbours by a hierarchical k-means tree with best-bin-first traversal.

The tree is fitted on a bounded sample; every row is put into a leaf. A query goes through
the tree with a priority queue of branches by their distance to it and so meets leaves best
bin first. How many leaves are visited is calibrated: for a bounded set of queries the true
neighbours are found by brute force over all rows, and visits are widened until the wanted
recall is reached. Leaves are searched in cells of bounded size, rows by queries.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

SAMPLE_ROWS, BRANCHES, LEAF_ROWS, MOST_LEAVES = 20000, 8, 60, 2048
CALIBRATION_QUERIES, RECALL = 200, 0.97
CELL_ROWS, CELL_QUERIES = 20000, 2000


@dataclass
class Tree:
    """Centres of all nodes, the children of inner nodes, and the leaf number of the others."""

    centres: np.ndarray
    children: list[np.ndarray]
    leaf: np.ndarray
    leaves: int
    sizes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def assign(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of each row: the nearest child at every level."""
        node = np.zeros(len(rows), np.int64)
        active = np.arange(len(rows))
        while len(active):
            for n in np.unique(node[active]):
                at = active[node[active] == n]
                kids = self.children[n]
                if len(kids):
                    node[at] = kids[_nearest(rows[at], self.centres[kids])]
            active = active[np.array([len(self.children[n]) > 0 for n in node[active]], bool)]
        return self.leaf[node]

    def best_bins(self, query: np.ndarray, visits: int, needed: int) -> list[int]:
        """The first leaves best bin first: ``visits`` of them, and on while their rows are
        fewer than ``needed``."""
        queue, out, rows = [(0.0, 0)], [], 0
        while queue and (len(out) < visits or rows < needed):
            _, node = heapq.heappop(queue)
            kids = self.children[node]
            if len(kids):
                far = ((self.centres[kids] - query) ** 2).sum(axis=1)
                for d, k in zip(far.tolist(), kids.tolist(), strict=True):
                    heapq.heappush(queue, (d, k))
            else:
                leaf = int(self.leaf[node])
                if self.sizes[leaf]:
                    out.append(leaf)
                    rows += int(self.sizes[leaf])
        return out


def _nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (-2 * rows @ centres.T + (centres ** 2).sum(axis=1)).argmin(axis=1)


def fit_tree(sample: np.ndarray, seed: int = 5) -> Tree:
    """Split the sample by k-means until a node has few rows, equal rows, or leaves are many."""
    rng = np.random.default_rng(seed)
    centres, children, todo = [sample.mean(axis=0)], [np.zeros(0, np.int64)], [(0, np.arange(len(sample)))]
    leaves = 1
    while todo:
        todo.sort(key=lambda t: len(t[1]))
        node, at = todo.pop()
        if len(at) <= LEAF_ROWS or leaves + BRANCHES > MOST_LEAVES:
            continue
        rows = sample[at]
        means = np.unique(rows[rng.choice(len(rows), min(BRANCHES, len(rows)), replace=False)], axis=0)
        if len(means) < 2:
            different = (rows != rows[0]).any(axis=1)
            if not different.any():
                continue
            means = np.stack([rows[0], rows[different][0]])
        for _ in range(12):
            near = _nearest(rows, means)
            count = np.bincount(near, minlength=len(means))
            sums = np.zeros_like(means)
            np.add.at(sums, near, rows)
            means = sums[count > 0] / count[count > 0, None]
        near = _nearest(rows, means)
        if len(np.unique(near)) < 2:
            continue
        kids = []
        for k in np.unique(near):
            kids.append(len(centres))
            centres.append(means[k])
            children.append(np.zeros(0, np.int64))
            todo.append((kids[-1], at[near == k]))
        children[node] = np.array(kids)
        leaves += len(kids) - 1
    leaf = np.full(len(centres), -1)
    ends = [i for i, c in enumerate(children) if not len(c)]
    leaf[ends] = np.arange(len(ends))
    return Tree(np.array(centres), children, leaf, len(ends), np.ones(len(ends), np.int64))


def nearest_in_block(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray,
                     row_ids: np.ndarray, k: int):
    """(query number, row id, distance) of the k nearest rows of another id, ties by id.

    Candidates come from a matrix product; distances are then taken from differences.
    """
    out = ([], [], [])
    norms = (rows ** 2).sum(axis=1)
    for low in range(0, len(queries), 128):
        part = queries[low:low + 128]
        far = norms - 2 * part @ rows.T + (part ** 2).sum(axis=1)[:, None]
        far[query_ids[low:low + 128][:, None] == row_ids] = np.inf
        most = min(k, len(rows))
        cut = np.partition(far, most - 1, axis=1)[:, most - 1]
        slack = 1e-9 * (1 + np.abs(norms).max() + (part ** 2).sum(axis=1))
        for i in range(len(part)):
            near = np.flatnonzero((far[i] <= cut[i] + slack[i]) & np.isfinite(far[i]))
            exact = np.sqrt(((rows[near] - part[i]) ** 2).sum(axis=1))
            first = np.lexsort((row_ids[near], exact))[:k]
            out[0].append(np.full(len(first), low + i))
            out[1].append(row_ids[near[first]])
            out[2].append(exact[first])
    return [np.concatenate([np.zeros(0, t), *o]) for o, t in zip(out, (int, np.int64, float), strict=True)]


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column, all of one length, in double precision."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(id, v) of vectors that take part: no null, zero or non-finite one, of the usual length.

    The usual length is the most frequent one, the smaller of equally frequent ones.
    """
    rows = vectors.select(F.col(vec_id).alias("id"), F.col(embedding).alias("v")).where(
        F.col("id").isNotNull() & F.col("v").isNotNull() & F.forall(
            "v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("v", lambda x: x != 0))
    length = rows.groupBy(F.size("v").alias("s")).count().orderBy(F.desc("count"), "s").first()
    return rows.where(F.size("v") == (length["s"] if length else 0))


def _true_neighbours(rows: DataFrame, queries: np.ndarray, ids: np.ndarray, k: int) -> DataFrame:
    """Brute force of the bounded calibration set against every row."""
    def run(batches):
        for batch in batches:
            data = _matrix(batch.column("v"))
            if len(data):
                q, r, d = nearest_in_block(queries, ids, data, batch.column("id").to_numpy(), k)
                leaf = dict(zip(batch.column("id").to_pylist(), batch.column("leaf").to_pylist(), strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(q), pa.array(r), pa.array(d), pa.array([leaf[x] for x in r.tolist()], pa.int32())],
                    ["q", "id", "d", "leaf"])

    found = rows.mapInArrow(run, "q long, id long, d double, leaf int")
    order = Window.partitionBy("q").orderBy("d", "id")
    return found.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k)


def calibrate(tree: Tree, queries: np.ndarray, truth: dict[int, list[int]], recall: float) -> int:
    """The least power of two of leaf visits at which the mean recall is reached."""
    ranks = []
    for q, leaves in truth.items():
        place = {leaf: i for i, leaf in enumerate(tree.best_bins(queries[q], tree.leaves, 0))}
        ranks += [place[leaf] for leaf in leaves]
    visits = 1
    while visits < tree.leaves and ranks and np.mean(np.array(ranks) < visits) < recall:
        visits *= 2
    return min(visits, tree.leaves)


def neighbours(vectors: DataFrame, k: int = 10, every: int = 100, recall: float = RECALL,
               vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each id divisible by ``every``.

    Scores are Euclidean distances in double precision, nearest first, ties by the smaller
    id; every other id is a candidate. Unusable vectors take no part, rows that repeat an
    id count as that id, and an empty table gives no rows.
    """
    good = usable(vectors, vec_id, embedding).select(F.col("id").cast("long").alias("id"), "v")
    sample = [r["v"] for r in good.orderBy(F.xxhash64("id", F.lit(3)), "id").limit(SAMPLE_ROWS).collect()]
    tree = fit_tree(np.array(sample, np.float64)) if sample else None
    if tree is None:
        return vectors.sparkSession.createDataFrame(
            [], "query_id long, rank int, vec_id long, score double")

    def place(batches):
        for batch in batches:
            data = _matrix(batch.column("v"))
            leaf = tree.assign(data) if len(data) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("v"), pa.array(leaf, pa.int32())],
                ["id", "v", "leaf"])

    kind = good.schema["v"].dataType.simpleString()
    rows = cut_lineage(good.mapInArrow(place, f"id long, v {kind}, leaf int"))
    sizes = {r["leaf"]: r["n"] for r in rows.groupBy("leaf").agg(F.count("*").alias("n")).collect()}
    tree.sizes = np.array([sizes.get(i, 0) for i in range(tree.leaves)])
    asked = rows.where(F.col("id") % every == 0)
    tried = asked.orderBy(F.xxhash64("id", F.lit(9)), "id").limit(CALIBRATION_QUERIES).collect()
    truth: dict[int, list[int]] = {}
    if tried:
        queries = np.array([r["v"] for r in tried], np.float64)
        ids = np.array([r["id"] for r in tried])
        for r in _true_neighbours(rows, queries, ids, k).collect():
            truth.setdefault(r["q"], []).append(r["leaf"])
        visits = calibrate(tree, queries, truth, recall)
    else:
        visits = 1

    def visit(batches):
        for batch in batches:
            data = _matrix(batch.column("v"))
            bins = [tree.best_bins(q, visits, k + 1) for q in data]
            count = np.array([len(b) for b in bins], np.int64)
            at = np.repeat(np.arange(len(data)), count)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(at)), batch.column("v").take(pa.array(at)),
                 pa.array(np.concatenate([np.zeros(0, int), *bins]), pa.int32())],
                ["id", "v", "leaf"])

    visited = cut_lineage(asked.mapInArrow(visit, f"id long, v {kind}, leaf int"))
    # Cells: a leaf's rows and its queries are both cut into parts of bounded size.
    cells = F.broadcast(visited.groupBy("leaf").agg(F.count("*").alias("_q")).join(
        F.broadcast(rows.groupBy("leaf").agg(F.count("*").alias("_n"))), "leaf").select(
        "leaf", F.ceil(F.col("_n") / CELL_ROWS).cast("int").alias("_rows"),
        F.ceil(F.col("_q") / CELL_QUERIES).cast("int").alias("_queries")))
    part = lambda column, of: F.pmod(F.xxhash64("id", F.lit(of)), F.col(column)).cast("int")
    spread = lambda column: F.explode(F.sequence(F.lit(0), F.col(column) - 1))
    left = visited.join(cells, "leaf").select(
        "id", "v", "leaf", part("_queries", 1).alias("qc"), spread("_rows").alias("rc"))
    right = rows.join(cells, "leaf").select(
        "id", "v", "leaf", part("_rows", 2).alias("rc"), spread("_queries").alias("qc"))

    def search(queries: pa.Table, block: pa.Table) -> pa.Table:
        empty = {"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()),
                 "score": pa.array([], pa.float64())}
        if not queries.num_rows or not block.num_rows:
            return pa.table(empty)
        one = lambda t, c: t.column(c).combine_chunks()
        ids = one(queries, "id").to_numpy()
        q, r, d = nearest_in_block(_matrix(one(queries, "v")), ids, _matrix(one(block, "v")),
                                   one(block, "id").to_numpy(), k)
        return pa.table({"query_id": ids[q], "vec_id": r, "score": d})

    found = left.groupBy("leaf", "qc", "rc").cogroup(right.groupBy("leaf", "qc", "rc")).applyInArrow(
        search, "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
