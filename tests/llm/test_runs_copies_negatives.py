"""Periodic runs, exact copies by content sort, hard negatives: against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from caselens.llm import content_sort, hard_negatives, periodic_runs, queries
from caselens.llm.oracles import ORACLES
from caselens.llm.strassen import strassen

from .conftest import edge_texts, prose

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(words, least):
    out, n = [], len(words)
    for q in range(1, n // 2 + 1):
        same, start = 0, 0
        for i in range(n - q + 1):
            if i + q < n and words[i] == words[i + q]:
                start = i if not same else start
                same += 1
                continue
            size, same = same + q if same else 0, 0
            if size >= max(least, 2 * q) and not any(
                    2 * r <= size and words[start:start + size - r] == words[start + r:start + size]
                    for r in range(1, q)):
                out.append((start, size, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_runs_against_plain_ones():
    rng = random.Random(3)
    for _ in range(400):
        letters, n = rng.choice([1, 2, 3, 6]), rng.randint(0, 60)
        words = [rng.randrange(letters) for _ in range(n)]
        if n > 12 and rng.random() < 0.5:
            at, p = rng.randrange(n - 8), rng.randint(1, 6)
            words = words[:at] + [words[at + (i - at) % p] for i in range(at, n)]
        for least in (2, 12):
            got = [tuple(r) for r in np.array(
                periodic_runs.maximal_runs(np.array(words, np.uint64), least)).T.tolist()]
            assert got == plain_runs(words, least), words


def test_runs_of_fibonacci_words_and_one_word():
    a, b = [0], [0, 1]
    for _ in range(9):
        a, b = b, b + a
    got = [tuple(r) for r in np.array(periodic_runs.maximal_runs(np.array(b, np.uint64), 2)).T.tolist()]
    assert got == plain_runs(b, 2) and len(got) > 50
    start, length, period = periodic_runs.maximal_runs(np.ones(200_000, np.uint64), 12)
    assert (start.tolist(), length.tolist(), period.tolist()) == ([0], [200_000], [1])


def test_find_runs_edges(spark, edge_docs, no_docs):
    long = "one two three " * 30_000
    more = spark.createDataFrame([(50, long), (51, "a b\t\n a  b " * 6)], "doc_id long, text string")
    docs = edge_docs.select("doc_id", "text").union(more)
    got = Counter((r.doc_id, tuple(tuple(x) for x in r.runs), r.collapsed)
                  for r in periodic_runs.find_runs(docs).collect())
    want = Counter()
    for i, text in [*edge_texts(), (50, long), (51, "a b\t\n a  b " * 6)]:
        words = WORD.findall(text or "")
        runs = [(0, len(words), 3)] if i == 50 else [] if len(words) > 2000 else plain_runs(words, 12)
        want[i, tuple(runs), collapsed(words, runs)] += 1
    assert got == want
    assert (51, ((0, 24, 2),), "a b") in got
    assert periodic_runs.find_runs(edge_docs).columns == ["doc_id", "runs", "collapsed"]
    assert periodic_runs.find_runs(no_docs).count() == 0


def test_periodic_runs_query(spark):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r.doc_id: tuple(r) for r in queries.op11_periodic_runs(spark, FOLDER).collect()}
    changed = 0
    for d in spark.read.parquet(f"{FOLDER}/documents.parquet").collect():
        words = WORD.findall(d.text or "")
        n, h = len(words), zlib.crc32(str(d.doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            changed += 1
        if n > 1200:
            continue
        runs = plain_runs(words, 12)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        assert got[d.doc_id] == (
            d.doc_id, len(runs), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4),
            sha("".join(f"{s},{x},{q}\n" for s, x, q in runs)), sha(collapsed(words, runs)))
    assert changed > 10


def test_repeated_parts_leave_null_ids_and_wordless_texts(spark):
    rows = [(None, "a b c"), (12, None), (12, "  "), (12, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, queries.with_repeated_parts(docs).collect())) == Counter(rows)


def plain_copies(rows):
    groups = defaultdict(list)
    for i, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(i)
    out = Counter()
    for text, ids in groups.items():
        least = min((i for i in ids if i is not None), default=None)
        left = 1
        for i in ids:
            stays = bool(left) and i == least
            left -= stays
            out[i, least, len(ids), stays, hashlib.sha256(text.encode()).hexdigest()] += 1
    return out


def sql_rows(name, **tables):
    con = duckdb.connect()
    for table, path in tables.items():
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}'")
    return Counter(con.sql(ORACLES[name]).fetchall())


def test_copies_edges(edge_docs, no_docs):
    out = content_sort.find_exact_copies(edge_docs)
    assert out.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert Counter(map(tuple, out.collect())) == plain_copies(edge_texts())
    assert content_sort.find_exact_copies(no_docs).count() == 0


@pytest.mark.parametrize("samples", [1, 1000])
def test_copies_when_splitters_cut_groups(spark, monkeypatch, samples):
    monkeypatch.setattr(content_sort, "SAMPLES_PER_RANGE", samples)
    rng, long = random.Random(5), prose(9, 9000)
    texts = [prose(1, 30), prose(1, 30) + " ", "\t" + prose(1, 30), long, long + "x", "", None, " "]
    rows = [(rng.randrange(4000), rng.choice(texts[:1] * 6 + texts)) for _ in range(3000)]
    rows += [(5000 + i, texts[0][:20] + str(i % 300)) for i in range(600)] + [(None, texts[0])] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    splitters = content_sort.sampled_splitters(docs, "doc_id", "text", 32)
    if samples > 1:  # the large group fills many ranges
        digest = hashlib.sha256(texts[0].encode()).hexdigest()
        assert sum(s[64:128] == digest for s in splitters) > 5
    assert Counter(map(tuple, content_sort.find_exact_copies(docs).collect())) == plain_copies(rows)


def test_copies_query_against_sql(spark):
    got = queries.op12_content_sort(spark, FOLDER)
    assert Counter(map(tuple, got.collect())) == sql_rows(
        "op12_content_sort", documents=f"{FOLDER}/documents.parquet")


def test_copies_without_python(spark):
    plan = queries.op12_content_sort(spark, FOLDER)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_strassen_is_exact():
    rng = np.random.default_rng(2)
    for m, k, n in ((1, 1, 1), (65, 130, 77), (200, 64, 31), (128, 128, 128), (3, 70, 90)):
        a, b = rng.integers(-(1 << 25), 1 << 25, (m, k)), rng.integers(-(1 << 25), 1 << 25, (k, n))
        assert (strassen(a, b, 8) == a @ b).all()
    big = np.full((64, 64), 1 << 31)  # sums of halves leave 64 bits, the result wraps as plain ones do
    assert (strassen(big, big, 4) == big @ big).all()


def test_heaps_merge():
    rng = np.random.default_rng(6)
    row, score, ids = rng.integers(0, 4, 300), rng.integers(-5, 5, 300), rng.integers(0, 40, 300)
    whole = hard_negatives.Heap(4, 3)
    whole.add(row, score, ids)
    parts = [hard_negatives.Heap(4, 3) for _ in range(3)]
    for n, part in enumerate(parts):
        part.add(row[n::3], score[n::3], ids[n::3])
    parts[0].merge(parts[1])
    parts[2].merge(parts[0])
    best = {}
    for r, s, i in zip(row.tolist(), score.tolist(), ids.tolist(), strict=True):
        best[r, i] = max(s, best.get((r, i), s))
    want = [(r, s, i) for r in range(4) for s, i in sorted(
        ((s, i) for (q, i), s in best.items() if q == r), key=lambda t: (-t[0], t[1]))[:3]]
    for heap in (whole, parts[2]):
        assert list(zip(heap.row.tolist(), heap.score.tolist(), heap.id.tolist(), strict=True)) == want


def plain_negatives(rows, every, k, low, high):
    """Over ids that occur once."""
    out = set()
    v = {i: (label, [int(np.floor(256 * np.float64(np.float32(x)))) for x in e]) for i, e, label in rows}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    for a, (label, e) in v.items():
        if a % every:
            continue
        scores = {i: (dot(e, f), other) for i, (other, f) in v.items() if i != a}
        order = sorted(scores, key=lambda i: (-scores[i][0], i))
        for p in [i for i in order if scores[i][1] == label][:k]:
            top = scores[p][0]
            fit = [i for i in order if scores[i][1] != label
                   and low * top <= 100 * scores[i][0] <= high * top][:k]
            out |= {(a, p, r + 1, i, top, scores[i][0]) for r, i in enumerate(fit)}
    return out


def test_negatives_against_plain_ones(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "ANCHOR_ROWS", 7)
    monkeypatch.setattr(hard_negatives, "CANDIDATE_ROWS", 60)
    monkeypatch.setattr(hard_negatives, "TILE", 16)
    rng = np.random.default_rng(8)
    rows = [(i, [float(np.float32(x)) for x in rng.standard_normal(9)], int(rng.integers(0, 3)))
            for i in range(300)]
    rows += [(i, [0.5] * 9, 1 if i % 3 else 2) for i in range(300, 420)]  # ties
    rows += [(420, [1.0, 2.0], 1), (430, [], 1), (440, [0.0] * 9, 2), (450, [-0.5] * 9, 2)]
    bad = [(1000, None, 1), (1010, [None] * 9, 1), (1020, [float("nan")] * 9, 1), (1030, [1.0] * 9, None),
           (1040, [float("inf")] * 9, 1), (None, [1.0] * 9, 1), (1050, [1e30] * 9, 1)]
    table = spark.createDataFrame(
        [(*r, 1, 2, "x") for r in rows + bad],
        "vec_id long, embedding array<float>, label int, place long, rank int, v string").repartition(6)
    out = hard_negatives.hard_negatives(table, every=10)
    got = [tuple(r) for r in out.collect()]
    want = plain_negatives(rows, 10, 5, 80, 100)
    assert len(got) == len(want) and set(got) == want
    assert hard_negatives.hard_negatives(table.limit(0)).count() == 0
    few = hard_negatives.hard_negatives(table.where("vec_id in (300, 301, 302, 303)"), every=300)
    assert {tuple(r) for r in few.collect()} == {(300, 303, r, i, 9 * 128 ** 2, 9 * 128 ** 2)
                                                for r, i in ((1, 301), (2, 302))}


def test_negatives_of_repeated_ids(spark):
    one, two = [1.0] * 4, [0.95] * 4
    rows = [(0, one, 1)] * 3 + [(1, one, 1)] * 4 + [(2, two, 2)] * 5 + [(2, one, 2), (3, two, 2)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    top, near = 4 * 256 ** 2, 4 * 256 * 243
    assert sorted(map(tuple, hard_negatives.hard_negatives(table).collect())) == [
        (0, 1, 1, 2, top, top), (0, 1, 2, 3, top, near)]


def test_negatives_query_against_sql(spark):
    got = queries.op13_hard_negatives(spark, FOLDER)
    assert Counter(map(tuple, got.collect())) == sql_rows(
        "op13_hard_negatives", embeddings=f"{FOLDER}/embeddings.parquet")
