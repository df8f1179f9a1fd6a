"""Operators on rows: mixing, sharding, neighbours, and the pipeline."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from caselens.llm import kmeans_tree, mixing, queries, sharding, toxicity

from .conftest import INNER, edge_texts, prose

FOLDER = "/root/testdata/sf0.001"


def test_exponent_meets_its_target():
    tokens = [1000, 100, 100, 10]
    a = mixing.find_exponent(tokens, 3.0, None)
    assert abs(max(mixing.passes_at(tokens, a)) - 3) < 1e-6 and 0 < a < 1
    b = mixing.find_exponent(tokens, None, 0.9)
    w = mixing.weights_at(tokens, b)
    assert abs(-sum(x * np.log(x) for x in w) - 0.9 * np.log(4)) < 1e-6
    assert mixing.find_exponent([5], 2.0, None) == 0.0


def test_mix_keeps_all_and_meets_budgets(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["big"] * 8 + ["mid"] * 2 + ["low", None]), prose(i, rng.randint(1, 40)), 1)
            for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, _n long")
    plan = {p["source"]: p for p in mixing.source_plan(docs)}
    out = mixing.mix(docs).select(
        "doc_id", "source", "_pass", "_place", "_weight", "_n", "text").collect()
    times = Counter(r.doc_id for r in out)
    assert set(times) == set(range(3000)) and max(times.values()) <= 2
    for source, p in plan.items():
        used = sum(len(r.text.split()) for r in out if r.source == source)
        assert p["passes"] * p["tokens"] - 60 <= used <= p["passes"] * p["tokens"] + 1
        assert {r["_weight"] for r in out if r.source == source} == {p["weight"]}
    assert mixing.mix(docs.limit(0)).count() == 0 and {r["_n"] for r in out} == {1}
    # Passes follow each other, each in its own order; every stretch holds the target weights.
    twice = {i for i, n in times.items() if n == 2}
    by_pass = [[r.doc_id for r in sorted(out, key=lambda r: r["_place"])
                if r.doc_id in twice and r["_pass"] == n and r.source == "low"] for n in (0, 1)]
    assert sorted(by_pass[0]) == sorted(by_pass[1]) and by_pass[0] != by_pass[1]
    assert all(0 <= r["_place"] <= 1 for r in out)
    for low in (0.0, 0.25, 0.5, 0.75):
        part = [r for r in out if low <= r["_place"] <= low + 0.25]
        total = sum(len(r.text.split()) for r in part)
        for source, p in plan.items():
            used = sum(len(r.text.split()) for r in part if r.source == source)
            assert abs(used / total - p["weight"]) < 0.05


def test_mix_edges(edge_docs):
    out = mixing.mix(edge_docs)
    assert out.count() == len(edge_texts()) and sorted(out.columns) == sorted(edge_docs.columns)
    own = [c for c in INNER if c not in ("_pass", "_place", "_weight")]
    assert out.select(own).distinct().collect() == edge_docs.select(own).distinct().collect()


def test_hilbert_curve_moves_by_single_steps():
    grid = np.meshgrid(*[np.arange(8)] * 3, indexing="ij")
    index = sharding.hilbert_index([g.ravel() for g in grid], 3)
    assert sorted(index) == list(range(512))
    path = np.stack([g.ravel() for g in grid])[:, np.argsort(index)]
    assert (np.abs(np.diff(path, axis=1)).sum(axis=0) == 1).all()


def test_shards(spark, edge_docs, no_docs):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = sharding.assign_shards(docs).collect()
    counts = Counter(r.shard for r in out)
    assert set(counts) == set(range(24)) and max(counts.values()) - min(counts.values()) <= 1
    for s in counts:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(counts[s]))
    assert sorted(r.doc_id for r in out) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    last = -1
    for s in range(24):  # runs of the curve
        inside = [r.hilbert for r in out if r.shard == s]
        assert min(inside) >= last
        last = max(inside)
    small = sharding.assign_shards(edge_docs)
    assert small.count() == len(edge_texts()) and small.select("shard").distinct().count() == len(edge_texts())
    assert sharding.assign_shards(no_docs).count() == 0


def plain_neighbours(ids, v, every, k):
    out = {}
    for q in range(len(ids)):
        if ids[q] % every == 0:
            far = np.sqrt(((v - v[q]) ** 2).sum(axis=1))
            order = [i for i in np.lexsort((ids, far)) if ids[i] != ids[q]][:k]
            out[int(ids[q])] = [(int(ids[i]), far[i]) for i in order]
    return out


def test_neighbours_reach_their_recall(spark, monkeypatch):
    rng = np.random.default_rng(4)
    v = rng.standard_normal((1500, 8)).astype(np.float32)
    v[700:1000] = v[700]
    rows = [(i, [float(x) for x in v[i]]) for i in range(1500)]
    bad = [(2000, None), (2100, [0.0] * 8), (2200, [float("nan")] * 8), (2300, [1.0, 2.0]), (None, [1.0] * 8),
           (2400, [None] * 8)]
    table = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").repartition(4)
    monkeypatch.setattr(kmeans_tree, "CELL_ROWS", 200)
    monkeypatch.setattr(kmeans_tree, "CELL_QUERIES", 7)
    got = {}
    for r in kmeans_tree.neighbours(table).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = plain_neighbours(np.arange(1500), v.astype(np.float64), 100, 10)
    assert got.keys() == want.keys()
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 10 * len(want)
    assert [i for i, _ in got[700]] == list(range(701, 711))  # ties by id
    assert kmeans_tree.neighbours(table.limit(0)).count() == 0
    few = kmeans_tree.neighbours(table.where(F.col("vec_id").isin(0, 100, 5)))
    assert few.count() == 4  # all candidates, if fewer


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_return_a_row_for_each_input(spark, name):
    out = queries.QUERIES[name](spark, FOLDER)
    table = "pages" if name.startswith("op9") else "documents"
    rows = spark.read.parquet(f"{FOLDER}/{table}.parquet").count()
    if name.startswith("op3"):
        assert out.select("query_id").distinct().count() == 5 and out.count() == 50
    elif name.startswith("op13"):
        assert out.select("anchor_id").distinct().count() <= 5
    elif name.startswith("op2"):
        assert rows <= out.count() <= 2 * rows
    else:
        assert out.count() == rows


def test_stages_keep_columns_and_clean_rows(spark, edge_docs):
    labels = FOLDER
    for docs in (edge_docs, edge_docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, labels)
            assert out.columns == docs.columns, name
            assert out.select(INNER).distinct().count() <= 1, name
            assert out.count() >= docs.select("text").distinct().count() - 4, name
        assert corpus_pipeline.STAGES[-1][1](spark, docs, labels).count() == docs.count()


def test_near_duplicates_leave_one_row_of_each_group(spark):
    text, other = prose(1, 60), prose(2, 60)
    rows = [(7, text, "a"), (7, other, "a"), (7, other, "b"), (3, text, "a"), (3, text, "a"),
            (None, text, "a"), (None, prose(3, 60), "a"), (None, prose(3, 60), "b"),
            (5, "", "a"), (5, "", "a"), (6, None, "a"), (9, prose(4, 3), "a"), (8, prose(4, 3), "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row string").withColumn(
        "tags", F.create_map(F.lit("x"), F.col("_row")))
    out = corpus_pipeline.drop_near_duplicates(spark, docs.repartition(4), FOLDER)
    assert out.columns == docs.columns
    kept = Counter((r.doc_id, r.text) for r in out.collect())
    assert kept == Counter({(3, text): 1, (7, other): 1, (None, prose(3, 60)): 1, (5, ""): 2,
                            (6, None): 1, (8, prose(4, 3)): 1})
    assert corpus_pipeline.drop_near_duplicates(spark, docs.limit(0), FOLDER).count() == 0


@pytest.mark.parametrize("folder", [FOLDER, "/root/testdata/sf0.01"])
def test_toxicity_leaves_clean_rows_alone(spark, folder):
    labels = spark.read.parquet(f"{folder}/labels.parquet").where("toxic = 0").select("doc_id")
    out = queries.op10_toxicity(spark, folder).join(labels, "doc_id")
    flagged, rows = out.agg(F.sum("predicted"), F.count("*")).first()
    assert rows > 50 and flagged <= 0.05 * rows


def test_toxicity_cut():
    clean, bad = np.linspace(-8, -1, 1000), np.linspace(0, 5, 100)
    value, toxic = np.append(clean, bad), np.append(np.zeros(1000, int), np.ones(100, int))
    assert -1 < toxicity.place_cut(value, toxic) < 0
    few = np.append(np.zeros(20, int), np.ones(5, int))  # too few rows to trust any cut between
    assert toxicity.place_cut(np.append(clean[-20:], bad[:5]), few) == pytest.approx(-0.5)
    assert toxicity.place_cut(np.zeros(0), np.zeros(0, int)) == 0.5


def test_pipeline_runs(spark):
    out = corpus_pipeline.run(spark, FOLDER)
    assert out.count() > 100 and out.select("shard").distinct().count() == 24
