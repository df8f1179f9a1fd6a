import hashlib
import math
import random
import statistics
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from caselens.operators import custody, findings, hunts, journal, motifs, review, scan, windows
from caselens.operators.corroborate import corroborate, dangling_hits
from caselens.operators.cross_source import cross_source_entities
from caselens.operators.linkage import entity_linkage
from caselens.operators.ordered import carry_forward
from caselens.operators.retrieve import apply_filters, entity_lookup, list_hits, search
from caselens.operators.signatures import signature_scan
from caselens.operators.skew import join_group_facts
from caselens.rules import (
    RuleError, builtin_rules, load_exclusions, load_explanations, load_rules, select_rules,
    validate_signature, validate_stat)

T0 = datetime(2024, 1, 1)
# Small groups are salted too, so that the skew path is what runs here.
SALTED = {"rows_per_task": 5}


def flat(spark, rows):
    """Rows of (key, field, value, seconds) as one source; the line number is the position."""
    data = [("s", i + 1, T0 + timedelta(seconds=t) if t is not None else None, k, f,
             None if v is None else str(v)) for i, (k, f, v, t) in enumerate(rows)]
    return spark.createDataFrame(data, "source_id string, line_no long, ts_utc timestamp, key string, "
                                       "field string, value string")


def test_salted_join_keeps_every_row(spark):
    rows = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("line"))
    facts = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("line").alias("top"))
    got = join_group_facts(rows, facts, ["k"], "n", ["line"], rows_per_task=10)
    assert got.count() == 1000 and got.select("line").distinct().count() == 1000


def test_carry_forward_across_blocks(spark):
    rnd = random.Random(1)
    values = [(s, i, rnd.choice([None, None, None, i])) for s in "ab" for i in range(1, 200)]
    df = spark.createDataFrame(values, "s string, i long, v long")
    for strict in (False, True):
        got = {(r.s, r.i): r.out for r in carry_forward(
            df, ["s"], "i", F.col("v"), "out", strict, block_lines=7).collect()}
        want, last = {}, {}
        for s, i, v in values:
            before = last.get(s)
            last[s] = v if v is not None else before
            want[s, i] = before if strict else last[s]
        assert got == want


def test_divergence_thresholds(spark):
    base = [("k", "GET", 100, 0)] * 6 + [("k", "POST", 1000, 0)] * 6
    run = lambda rows, n=10, r=3.0: hunts.same_key_divergence(
        flat(spark, rows), ["key"], "field", "value", n, r).collect()
    hit, = run(base)
    assert (hit.ratio, hit.group_events, hit.line_no) == (10.0, 12, 1)
    assert not run(base, n=13) and not run(base, r=10.1) and run(base, r=10.0)
    assert not run([("k", "GET", 100, 0)] * 12)
    assert not run([("k", "GET", "x", 0)] * 6 + [("k", "POST", 5, 0)] * 6)
    zero, = run([("k", "GET", 0, 0)] * 6 + [("k", "POST", 5, 0)] * 6)
    assert math.isinf(zero.ratio)
    assert not run([("k", "GET", 0, 0)] * 6 + [("k", "POST", 0, 0)] * 6)
    assert not run([(None, f, v, t) for _, f, v, t in base])


def test_rare_shared_value_thresholds(spark):
    rows = [("1", "odd-agent", 0, 3), ("2", "odd-agent", 0, 1), ("2", "odd-agent", 0, None)]
    run = lambda rows, keys=2, freq=4, ex=(): hunts.cross_key_same_value(
        flat(spark, rows), "field", ["key"], keys, freq, list(ex)).collect()
    hit, = run(rows)
    assert (hit.distinct_keys, hit.total_freq, hit.line_no, hit.first_ts) == (
        2, 3, 1, T0 + timedelta(seconds=1))
    assert not run(rows, keys=3) and not run(rows, freq=3) and not run(rows, ex=["-AGENT".lower()])


def test_rate_spike_needs_both_gates(spark):
    quiet = [("k", "", 0, 60 * m + s) for m in range(30) for s in (1, 2)]
    rows = quiet + [("k", "", 0, 1800 + s) for s in range(35)]
    run = lambda rows, z=4.0, n=30: hunts.rate_spike(
        flat(spark, rows), ["key"], 60, z, n, **SALTED).collect()
    hit, = run(rows)
    assert (hit["count"], hit.line_no, round(hit.z, 2)) == (35, 61, 5.48)
    assert not run(rows, n=36) and not run(rows, z=5.5) and not run(quiet)
    assert not run([(k, f, v, None) for k, f, v, _ in rows])


def test_sparse_values_are_carried_like_others(spark):
    from caselens.operators.ordered import carry_forward, carry_sparse
    rows = [(s, i, f"{s}{i}" if i in marks else None) for s, marks in
            (("a", {3, 4, 17, 40}), ("b", set()), ("c", {1}), ("d", {60})) for i in range(1, 61)]
    df = spark.createDataFrame(rows, "s string, i long, v string").repartition(4)
    want = carry_forward(df, ["s"], "i", F.col("v"), "out")
    for block in (1, 7, 1000):
        got = carry_sparse(df, ["s"], "i", F.col("v"), "out", block_lines=block)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_medians_of_large_groups_without_a_window(spark):
    import random
    import statistics
    rng = random.Random(4)
    groups = {"hot": [rng.lognormvariate(0, 9) * rng.choice([-1, 1]) for _ in range(9000)],
              "even": [float(rng.randint(0, 300)) for _ in range(1000)],
              "ends": [0.0] * 400 + [float(i) for i in range(1, 500)] + [1e300],
              "one": [3.5], "two": [1.0, 2.0], "flat": [7.0] * 50}
    rows = [(k, "s", v) for k, values in groups.items() for v in values]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "key string, source_id string, value double").repartition(5)
    for most in (4096, 8, 1):
        found = hunts.group_medians(df, ["key"], "value", "source_id", most_values=most)
        text = found._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in text
        got = {r.key: (r.median, r.group_events, r._min, r._max) for r in found.collect()}
        assert got.keys() == groups.keys()
        for k, values in groups.items():
            assert got[k] == (statistics.median(values), len(values), min(values), max(values)) or abs(
                got[k][0] - statistics.median(values)) < 1e-9, (k, most)


def test_size_outliers_and_medians(spark):
    rows = [("k", "", 1000 + i, i) for i in range(25)] + [("k", "", 5000, 30), ("k", "", 60, 31)]
    run = lambda rows, n=20, r=3.0, m=3: sorted(x.line_no for x in hunts.size_outlier(
        flat(spark, rows), ["key"], "value", n, r, m, **SALTED).collect())
    assert run(rows) == [26, 27] and run(rows, n=28) == [] and run(rows, r=20) == []
    assert run(rows, m=1) == [26] and run(rows[:25]) == []
    rnd = random.Random(5)
    data = [(str(rnd.randint(0, 5)), "", rnd.randint(0, 9) / 4, 0) for _ in range(301)]
    got = {r.key: (r.median, r.group_events) for r in hunts.group_medians(
        flat(spark, data).withColumn("v", F.col("value").cast("double")), ["key"], "v",
        "source_id").collect()}
    assert got == {k: (statistics.median([d[2] for d in data if d[0] == k]),
                       sum(d[0] == k for d in data)) for k in {d[0] for d in data}}


def _walk(events, steps, window, least):
    events = sorted(events)
    first = [e for e in events if e[2] in steps[0]]
    if len(first) < least:
        return None
    chain = [first[-1]]
    for step in steps[1:]:
        later = [e for e in events if e[:2] > chain[-1][:2] and e[2] in step
                 and e[0] - chain[-1][0] <= window]
        if not later:
            return None
        chain.append(later[0])
    return [e[1] for e in chain]


@pytest.mark.parametrize("n", [2, 3])
def test_chains_equal_a_plain_walk(spark, n):
    rnd = random.Random(n)
    rows = [(str(rnd.randint(0, 60)), rnd.choice("aabcdx"), 0, rnd.choice([None, *range(60)]))
            for _ in range(1500)]
    steps = [["a"], ["b", "c"], ["d"]][:n]
    got = {r.key: list(r.chain_lines) for r in motifs.sequence_motif(
        flat(spark, rows), ["key"], [{"field": "field", "in": [v.upper() for v in s]} for s in steps],
        7, 3, **SALTED).collect()}
    by_key = {}
    for i, (k, f, _, t) in enumerate(rows):
        if t is not None:
            by_key.setdefault(k, []).append((t, i + 1, f))
    want = {k: _walk(e, steps, 7, 3) for k, e in by_key.items()}
    assert got == {k: c for k, c in want.items() if c} and got


def test_periodicity_equals_direct_formula(spark):
    rnd = random.Random(9)
    rows = []
    for k in range(30):
        gap, jitter = rnd.randint(20, 90), rnd.choice([0, 0.5, 5, 30])
        t = 0.0
        for _ in range(rnd.randint(3, 25)):
            rows.append((str(k), "", 0, round(t, 3)))
            t += max(0, gap + rnd.uniform(-jitter, jitter)) if rnd.random() > 0.03 else 0
    rnd.shuffle(rows)
    df = flat(spark, rows)
    for limit in (5, 1000):
        got = {r.key: (r.events, round(r.cv, 6), r.line_no) for r in motifs.periodicity(
            df, ["key"], 6, 0.2, 300, rows_per_task=limit).collect()}
        want = {}
        for k in {r[0] for r in rows}:
            times = sorted((r[3], i + 1) for i, r in enumerate(rows) if r[0] == k)
            gaps = [b[0] - a[0] for a, b in zip(times, times[1:])]
            if len(times) >= 6 and times[-1][0] - times[0][0] >= 300:
                cv = statistics.pstdev(gaps) / statistics.mean(gaps)
                if cv <= 0.2:
                    want[k] = (len(times), round(cv, 6), times[0][1])
        assert got == want and got


def test_windows_equal_the_sequential_merge(spark):
    rnd = random.Random(4)
    for n in (1, 5, 40):
        anchors = sorted({rnd.randint(1, 900) for _ in range(60)})
        merged = []
        for a in anchors:
            lo, hi = max(1, a - n), a + n
            if merged and merged[-1][1] - lo + 1 >= max(1, int((2 * n + 1) * 0.1)):
                merged[-1][1] = max(hi, merged[-1][1])
            else:
                merged.append([lo, hi])
        df = spark.createDataFrame([("s", a) for a in anchors], "source_id string, anchor_line long")
        sources = spark.createDataFrame([("s", 700)], "source_id string, line_count long")
        got = [[r.line_from, r.line_to] for r in windows.merge_windows(df, n, sources).orderBy(
            "line_from").collect()]
        assert got == [[lo, min(hi, 700)] for lo, hi in merged]


def _events(spark, rows):
    """(source, line, seconds, path, ip)"""
    data = [(s, n, None if t is None else T0 + timedelta(seconds=t), (p, i)) for s, n, t, p, i in rows]
    return spark.createDataFrame(data, "source_id string, line_no long, ts_utc timestamp, "
                                       "norm struct<path:string,src_ip:string>")


def test_corroboration_equals_brute_force(spark):
    rnd = random.Random(8)
    rows = [(f"s{rnd.randint(0, 5)}", i, None if rnd.random() < 0.02 else round(rnd.uniform(0, 90), rnd.choice([0, 3, 6])),
             rnd.choice(["/a", "/a", "/b", None]), rnd.choice(["1", "2", None])) for i in range(1, 700)]
    systems = {"s0": "x", "s1": "x", "s2": "x", "s3": "y", "s4": None, "s5": "x"}
    cases = {s: "c2" if s == "s5" else "c1" for s in systems}
    sources = spark.createDataFrame([(s, cases[s], systems[s]) for s in systems],
                                    "source_id string, case_id string, system string")
    picked = rows[::17]
    hits = spark.createDataFrame([(cases[r[0]], r[0], r[1]) for r in picked],
                                 "case_id string, source_id string, line_no long")
    events = _events(spark, rows)
    for window, limit in ((7, 4), (30, 20)):
        status, items = corroborate(hits, events, sources, window, limit)
        got = {}
        for r in items.orderBy("rank").collect():
            got.setdefault((r.hit_source_id, r.hit_line_no), []).append((r.source_id, r.line_no))
        want, states = {}, {}
        for s, n, t, p, i in picked:
            near = sorted((e[2], e[0], e[1]) for e in rows if t is not None and e[2] is not None
                          and e[0] != s and systems[e[0]] is not None and systems[e[0]] == systems[s]
                          and cases[e[0]] == cases[s] and round(abs(e[2] - t), 6) <= window
                          and ((p is not None and e[3] == p) or (i is not None and e[4] == i)))
            alone = systems[s] is None or sum(
                systems[o] == systems[s] and cases[o] == cases[s] for o in systems) < 2
            if near:
                want[s, n] = [(b, c) for _, b, c in near[:limit]]
            states[s, n] = "no_ts" if t is None else "no_siblings" if alone else "ok" if near else "none"
        assert got == want
        assert {(r.source_id, r.line_no): r.status for r in status.collect()} == states
    lost = spark.createDataFrame([("c1", "s0", 10_000)], "case_id string, source_id string, line_no long")
    assert dangling_hits(lost.unionByName(hits), events).count() == 1
    with pytest.raises(ValueError):
        corroborate(hits, events, sources, 0)


def _entities(spark, rows):
    return spark.createDataFrame([(k, k, "ip", q, s, n, None) for k, q, s, n in rows],
                                 "raw_value string, canonical_key string, entity_type string, qualifier "
                                 "string, source_id string, line_no long, ts_utc timestamp")


def test_linkage_equals_edge_form(spark):
    rnd = random.Random(2)
    rows = [(f"k{rnd.randint(0, 12)}", "global", rnd.choice("ab"), rnd.randint(1, 25)) for _ in range(90)]
    rows += [("hot", "global", "a", n) for n in range(1, 60)] + [("once", "global", "a", 99)]
    got = {(r.source_id, r.line_no): r.score for r in entity_linkage(
        _entities(spark, rows), rounds=8, max_df=30).collect()}
    by_key = {}
    for k, _, s, n in rows:
        by_key.setdefault(k, []).append((s, n))
    out = {}
    for occ in by_key.values():
        events = sorted(set(occ))
        if 2 <= len(events) <= 30:
            for a in events:
                row = out.setdefault(a, {})
                for b in events:
                    if a != b:
                        row[b] = row.get(b, 0) + math.log1p(occ.count(b)) / len(events)
    rank = {e: 1 / len(out) for e in out}
    for _ in range(8):
        new = {e: 0.15 / len(out) for e in out}
        for a, row in out.items():
            for b, w in row.items():
                new[b] += 0.85 * rank[a] * w / sum(row.values())
        rank = new
    assert got.keys() == rank.keys() and ("a", 99) not in got
    assert all(abs(got[e] - rank[e]) < 1e-12 for e in rank)


def test_cross_source_takes_global_entities_only(spark):
    df = _entities(spark, [("ip:8.8.8.8", "global", "a", 5), ("ip:8.8.8.8", "global", "a", 3),
                           ("ip:8.8.8.8", "global", "b", 9), ("ip:10.0.0.1", "host_scoped", "a", 1),
                           ("ip:10.0.0.1", "host_scoped", "b", 1), ("ip:1.1.1.1", "global", "a", 2)])
    assert sorted((r.source_id, r.line_no, r.source_count) for r in cross_source_entities(df).collect()) \
        == [("a", 3, 2), ("b", 9, 2)]
    assert entity_lookup(df, "ip:10.0.0.1", cross_source=True).count() == 0
    assert entity_lookup(df, "ip:10.0.0.1").count() == 2


def _norm_events(spark, rows):
    from caselens.schema import EVENTS, NORM_FIELDS
    data = [(r.get("source", "s"), n + 1, None, r.get("ts"), tuple(r.get(f) for f in NORM_FIELDS), None,
             r.get("raw", ""), "h") for n, r in enumerate(rows)]
    return spark.createDataFrame(data, EVENTS)


def test_signatures_report_first_field_and_token(spark):
    rules = [validate_signature(r) for r in [
        {"id": "two", "title": "t", "severity": "low", "target": "web",
         "match": {"path": ["B", "a"], "status": ["404"]}},
        {"id": "any", "title": "t", "severity": "low", "target": "any", "match": {"raw": ["ZZ"]}}]]
    ev = _norm_events(spark, [{"path": "/AB", "status": "404", "raw": "zz" * 300},
                              {"path": "/a", "status": "200"}, {"status": "404"},
                              {"path": "/a", "status": "404", "source": "x", "raw": "zz"}])
    sources = spark.createDataFrame([("s", "web"), ("x", "audit")], "source_id string, log_type string")
    got = sorted((r.line_no, r.rule_id, r.matched_field, r.matched_value, len(r.snippet))
                 for r in signature_scan(ev, sources, rules).collect())
    assert got == [(1, "any", "raw", "zz", 300), (1, "two", "path", "b", 300), (4, "any", "raw", "zz", 2)]


def test_builtin_rules_and_refusals():
    signatures, stats = builtin_rules()
    assert len(signatures) == 11 and len(stats) == 6
    with pytest.raises(RuleError):
        select_rules(signatures, stats, ["scanner-ua", "nope"])
    assert [len(x) for x in select_rules(signatures, stats, ["scanner-ua"])[:2]] == [1, 0]
    good = {"id": "a", "title": "t", "severity": "low", "target": "web", "match": {"path": ["x"]}}
    for change in ({"id": "A"}, {"severity": "x"}, {"target": "x"}, {"match": {}}, {"match": {"odd": ["x"]}},
                   {"match": {"path": []}}, {"max_hits": 0}, {"max_hits": True}, {"more": 1}, {"title": " "}):
        with pytest.raises(RuleError):
            validate_signature(good | change)
    seq = {"id": "a", "title": "t", "severity": "low", "operator": "sequence", "key_fields": ["src_ip"],
           "steps": [{"field": "status", "in": [401]}, {"field": "status", "in": ["OK"]}], "window_seconds": 5}
    assert validate_stat(seq)["steps"][1]["in"] == ["ok"] and validate_stat(seq)["min_first_step_count"] == 3
    for change in ({"steps": []}, {"steps": [{"field": "status"}] * 2}, {"key_fields": ["odd"]},
                   {"window_seconds": 0}, {"operator": "odd"}, {"min_first_step_count": 1.5}):
        with pytest.raises(RuleError):
            validate_stat(seq | change)


def test_only_enabled_rule_files_load(tmp_path):
    (tmp_path / "a.json").write_text('{"id": "a", "title": "t", "severity": "low", "target": "web", '
                                     '"match": {"path": ["x"]}, "status": "enable"}')
    (tmp_path / "b.json").write_text('{"broken": 1, "status": "draft"}')
    assert [[r["id"] for r in rules] for rules in load_rules(str(tmp_path))] == [["a"], []]


def test_word_lists_load_from_files(tmp_path):
    (tmp_path / "bots.json").write_text('{"tokens": [" Bot/ "]}')
    assert load_exclusions(str(tmp_path)) == {"bots": ["bot/"]}
    (tmp_path / "bots.json").write_text('{"tokens": []}')
    with pytest.raises(RuleError):
        load_exclusions(str(tmp_path))
    notes = tmp_path / "notes.json"
    notes.write_text('{"paths": [{"match": "/A", "text": "t"}], "statuses": {"404": "gone"}}')
    assert load_explanations(str(notes)) == {"path": [("/a", "t")], "ua": [], "status": [("404", "gone")]}
    notes.write_text('{"statuses": {"40": "gone"}}')
    with pytest.raises(RuleError):
        load_explanations(str(notes))


def test_scan_is_idempotent_and_budgeted(spark):
    rows = [{"path": "/x", "query": "cmd=1", "src_ip": "8.8.8.8", "ts": T0 + timedelta(seconds=60 * i),
             "raw": "GET /x?cmd=1"} for i in range(12)]
    rows += [{"source": "t", "src_ip": "8.8.8.8", "path": "/y", "raw": "../"} for _ in range(3)]
    ev = _norm_events(spark, rows).cache()
    from caselens.sources.normalize import extract_entities
    sources = spark.createDataFrame([("s", "c", "web"), ("t", "c", "audit"), ("z", "d", "web")],
                                    "source_id string, case_id string, log_type string")
    entities = extract_entities(ev)
    signatures, stats = builtin_rules()
    signatures = [r | {"max_hits": 5} if r["id"] == "cmd-exec-params" else r for r in signatures]
    first = scan.run_scan(ev, entities, sources, "c", signatures, stats)
    hits = first["hits"].cache()
    by_rule = {r.rule_id: r["count"] for r in hits.groupBy("rule_id").count().collect()}
    assert by_rule == {"cmd-exec-params": 12, "path-traversal": 3, "periodic-beacon": 1, "cross-source-entity": 2}
    inside = {r.rule_id: r["count"] for r in hits.where("within_budget").groupBy("rule_id").count().collect()}
    assert inside == by_rule | {"cmd-exec-params": 5}
    report = {r.rule_id: (r.hits, r.truncated) for r in first["report"].collect()}
    assert report["cmd-exec-params"] == (5, 7) and report["scanner-ua"] == (0, 0)
    assert {(r.rule_id, r.source_id) for r in first["skipped"].collect()} == {
        (i, "t") for i in ("auth-bruteforce-success", "ip-rate-spike", "periodic-beacon")}
    assert {r.measure: r.value for r in first["summary"].collect()} == {
        "scanned": 15, "hits_new": 18, "truncated": 7}
    again = scan.run_scan(ev, entities, sources, "c", signatures, stats, stored=hits, round_no=2)
    assert again["hits"].count() == 0
    subset = scan.run_scan(ev, entities, sources, "c", signatures, stats, rule_ids=["path-traversal"],
                           source_id="t")
    assert subset["hits"].count() == 3
    page = list_hits(hits, q="CMD-EXEC", limit=2)
    assert [r.line_no for r in page.collect()] == [1, 2]


def test_rounds_are_published_last_and_scopes_are_checked(spark, tmp_path, monkeypatch):
    from caselens.operators import rounds
    ev = _norm_events(spark, [{"raw": "GET /a", "ts": T0}, {"raw": "GET /b", "ts": T0},
                              {"source": "t", "raw": "GET /a", "ts": T0}]).cache()
    sources = spark.createDataFrame([("s", "c", "web"), ("t", "d", "web")],
                                    "source_id string, case_id string, log_type string")
    own = tmp_path / "rules"
    own.mkdir()
    text = '{"id": "%s", "title": "t", "severity": "low", "target": "web", "match": {"raw": ["%s"]}, "status": "%s"}'
    (own / "a.json").write_text(text % ("own-a", "/a", "enable"))
    (own / "b.json").write_text(text % ("own-b", "/b", "review"))
    folder = str(tmp_path / "case")
    run = lambda case="c", **more: rounds.scan_case(
        ev, ev, sources, folder, case, rules_folder=str(own), **more)
    for wrong in ({"case": "x"}, {"source_id": "t"}, {"rule_ids": ["own-b"]}, {"rule_ids": ["none"]}):
        with pytest.raises(ValueError):
            run(**{"rule_ids": ["own-a"]} | wrong)
    assert rounds.published_rounds(spark, folder).count() == 0

    def fail(*args, **kwargs):
        raise OSError("lost")

    with monkeypatch.context() as m, pytest.raises(OSError):
        m.setattr(rounds, "stored_hits", fail)  # after the hits are written, before the ledger row
        run(rule_ids=["own-a"])
    assert rounds.published_hits(spark, folder).count() == 0
    first = run(rule_ids=["own-a"])
    assert first["hits"].count() == 1 and first["round"].first().hits_new == 1
    assert run("d", rule_ids=["own-a"])["round"].first().round_no == 1
    again = run(rule_ids=["own-a"])["round"].first()
    assert (again.round_no, again.hits_new, again.hits_total, again.signature_new) == (2, 0, 1, 0)
    assert {(r.case_id, r.round_no) for r in rounds.published_hits(spark, folder).collect()} == {("c", 1), ("d", 1)}
    from caselens.operators.retrieve import hit_id, hits_total
    hits = hit_id(rounds.published_hits(spark, folder))
    one = hits.where("case_id = 'd'").first()
    assert hits_total(hits, hit=one.hit_id).first().total == 1
    assert hits_total(hits, case_id="c", hit=one.hit_id).first().total == 0
    assert list_hits(hits, case_id="d").first().hit_id == one.hit_id


def test_filters_agree_with_search_total(spark):
    ev = _norm_events(spark, [{"ua": "a_b%c", "raw": "50% off", "ts": T0}, {"ua": "axbyc", "raw": "500 off"}])
    assert apply_filters(ev, q="0% o").count() == 1
    assert search(ev, field_filters={"ua": {"contains": "_b%"}}).count() == 1
    assert search(ev, field_filters={"no;field": "x"}).count() == 2
    assert search(ev, field_filters={"nofield": "x"}).count() == 0
    assert search(ev, ts_from="2024-01-01T00:00:00").count() == 1
    assert search(ev, source_id="other").count() == 0
    with pytest.raises(ValueError):
        search(ev, ts_to="yesterday")


def test_findings_take_free_lines(spark):
    reply = ('```json\n{"findings": [{"summary": "a", "suspicion": "high", "line_refs": [5, 99]},'
             '{"summary": "b", "suspicion": "low", "line_refs": [5]}, {"summary": "c", "suspicion": "odd"},'
             '{"summary": "d", "suspicion": "info", "line_refs": "x"}]}\n```')
    replies = spark.createDataFrame(
        [("r", "s", 1, 20, 9, reply), ("r", "s", 19, 40, 30, reply.replace("[5, 99]", "[20]")),
         ("r", "s", 100, 120, 110, "[]"), ("r", "s", 200, 220, 210, None)],
        "run_id string, source_id string, line_from long, line_to long, first_anchor long, content string")
    read, found = findings.read_replies(replies)
    assert sorted((r.line_from, r.status, r.skipped) for r in read.collect()) == [
        (1, "read", 1), (19, "read", 1), (100, "unreadable", 0), (200, "unreadable", 0)]
    stored = spark.createDataFrame([("s", 30, "ai-l3-finding"), ("s", 5, "other")],
                                   "source_id string, line_no long, rule_id string")
    got = sorted((r.line_no, r.snippet) for r in findings.findings_to_hits(found, stored).collect())
    assert got == [(5, "a"), (9, "b"), (20, "a")]


def test_findings_in_rounds_equal_one_by_one(spark):
    rnd = random.Random(5)
    rows = [("r", rnd.choice("ab"), w, w + 12, w + rnd.randint(0, 12), n, "low", f"t{w}",
             [rnd.randint(w - 2, w + 14) for _ in range(rnd.randint(0, 4))])
            for w in range(1, 60, 4) for n in range(7)]
    rows += rows[:5]
    found = spark.createDataFrame(
        rows, "run_id string, source_id string, line_from long, line_to long, first_anchor long, "
              "seq int, severity string, summary string, line_refs array<long>")
    stored = [("a", 3), ("b", 9)]
    want, busy = [], set(stored)
    for r in sorted(rows, key=lambda r: (r[2], r[5], r[1], r[8], r[4])):
        free = [x for x in [*(x for x in r[8] if r[2] <= x <= r[3]), r[4]] if (r[1], x) not in busy]
        if free:
            busy.add((r[1], free[0]))
            want.append((r[1], free[0], r[7]))
    hits = findings.findings_to_hits(found, spark.createDataFrame(
        [(*s, "ai-l3-finding") for s in stored], "source_id string, line_no long, rule_id string"))
    assert sorted((h.source_id, h.line_no, h.snippet) for h in hits.collect()) == sorted(want)
    assert findings.findings_to_hits(found.limit(0), hits).count() == 0


def test_replies_of_odd_shapes(spark):
    texts = ['{"findings": {"a": 1}}', '{"findings": []}', '{"findings": null, "window_note": 3}',
             'x {"window_note": "n"} y', "null", '"{}"', '{"a": 1', "",
             '{"findings": [1, null, {"summary": " ", "suspicion": "low"}, {"summary": "\u00e9",'
             ' "suspicion": "low", "line_refs": [1, 2.5, true, "3", 4]}]}']
    read, found = findings.read_replies(spark.createDataFrame(
        [("r", "s", i, i, i, t) for i, t in enumerate(texts)],
        "run_id string, source_id string, line_from long, line_to long, first_anchor long, content string"))
    assert [(r.status, r.skipped, r.window_note) for r in read.orderBy("line_from").collect()] == [
        ("read", 1, None), ("read", 0, None), ("read", 0, None), ("read", 0, "n"),
        *[("unreadable", 0, None)] * 4, ("read", 3, None)]
    assert [(f.seq, f.summary, f.line_refs) for f in found.collect()] == [(0, "\u00e9", [1, 4])]


def test_second_decision_is_refused(spark):
    hits = spark.createDataFrame([("s", 1, "r", "pending"), ("s", 2, "r", "accepted")],
                                 "source_id string, line_no long, rule_id string, status string")
    reviews = spark.createDataFrame(
        [("s", 1, "r", "1", "t1", "accepted", None, "a"), ("s", 1, "r", "2", "t2", "rejected", "n", "b"),
         ("s", 2, "r", "3", "t1", "rejected", None, "a"), ("s", 3, "r", "4", "t1", "rejected", None, "a")],
        "source_id string, line_no long, rule_id string, review_id string, decided_at string, "
        "decision string, note string, actor string")
    decided, refused = review.apply_reviews(hits, reviews)
    assert sorted((r.line_no, r.status, r.reviewer) for r in decided.collect()) == [
        (1, "accepted", "a"), (2, "accepted", None)]
    assert sorted((r.review_id, r.refusal) for r in refused.collect()) == [
        ("2", "already decided"), ("3", "already accepted"), ("4", "no such hit")]


def _chain(n):
    rows, prev = [], custody.GENESIS
    for i in range(1, n + 1):
        entry = (i, "c", f"t{i}", "kim", "act", None, "{}", prev)
        prev = hashlib.sha256("|".join("" if v is None else str(v) for v in entry).encode()).hexdigest()
        rows.append((*entry, prev))
    return rows


def test_chain_finds_the_first_tampered_entry(spark):
    schema = ("id long, case_id string, ts string, actor string, action string, scope string, "
              "detail_json string, prev_hash string, entry_hash string")
    rows = _chain(30)
    verdict = lambda r: tuple(custody.verify_chain(spark.createDataFrame(r, schema)).first())
    assert verdict(rows) == (True, 30, None, None)
    edited = [r if r[0] != 12 else (*r[:3], "eve", *r[4:]) for r in rows]
    assert verdict(edited) == (False, 30, 12, "hash")
    assert verdict([r for r in rows if r[0] != 7]) == (False, 29, 8, "gap")
    assert verdict([r for r in rows if r[0] != 1]) == (False, 29, 2, "gap")
    assert verdict([*rows, rows[3]]) == (False, 31, 4, "duplicate")
    for gone in (7, 8):  # a missing link, a missing hash
        torn = [r if r[0] != 9 else (*r[:gone], None, *r[gone + 1:]) for r in rows]
        assert verdict(torn)[0] is False and verdict(torn)[2] == 9
    relinked = [r if r[0] != 5 else (*r[:7], "odd", r[8]) for r in rows]
    assert verdict(relinked) == (False, 30, 5, "link")


def test_note_anchors(spark):
    notes = spark.createDataFrame(
        [("1", "c", "x", "hit", "h1"), ("2", "c", "x", "hit", "h2"), ("3", "c", "x", "scan_round", "1"),
         ("4", "c", "x", "scan_round", "one"), ("5", "c", "x", "line", "s:a:3"), ("6", "c", "x", "line", "s:a:4"),
         ("7", "c", " ", None, None), ("8", "c", "y" * 4001, None, None), ("9", "d", "x", "line", "s:a:3"),
         ("10", "c", "x", "analysis_run", " r1 "), ("11", "c", "x", "odd", "r1"), ("12", "c", "x", "hit", None)],
        "note_id string, case_id string, body string, anchor_kind string, anchor_ref string")
    small = lambda rows, schema: spark.createDataFrame(rows, schema)
    out = journal.validate_notes(
        notes, small([("c", "h1")], "case_id string, hit_id string"),
        small([("c", 1)], "case_id string, round_no int"), small([("c", "r1")], "case_id string, run_id string"),
        small([("s:a", 3)], "source_id string, line_no long"),
        small([("c", "s:a")], "case_id string, source_id string"))
    assert {int(r.note_id): r.problem for r in out.collect()} == {
        1: None, 2: "anchor does not exist", 3: None, 4: "anchor does not exist", 5: None,
        6: "anchor does not exist", 7: "empty note", 8: "note too long", 9: "anchor does not exist",
        10: None, 11: "unknown anchor kind", 12: "anchor reference missing"}


def test_linkage_rounds_leave_the_pairs_where_they_are(spark, monkeypatch):
    """A round exchanges sums per entity and, after a checkpoint, one row per event."""
    from caselens.operators import linkage
    plans, cut = [], linkage.cut_lineage
    monkeypatch.setattr(linkage, "cut_lineage", lambda df: plans.append(
        df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    entities = spark.range(400).select(
        F.lit("s").alias("source_id"), F.col("id").alias("line_no"), F.explode(F.array(
            F.concat(F.lit("a"), F.col("id") % 7), F.concat(F.lit("b"), F.col("id") % 11))).alias(
            "canonical_key"))
    scores = linkage.entity_linkage(entities, rounds=6)
    assert scores.count() == 400
    assert abs(scores.agg(F.sum("score")).first()[0] - 1) < 1e-9
    rounds = [p for p in plans if "score" in p]
    assert rounds and max(p.split("InMemoryRelation")[0].count("Exchange hashpartitioning") for p in rounds) <= 2


def test_costly_rows_are_dealt_in_bounded_tasks(spark, tmp_path, monkeypatch):
    from caselens import session
    monkeypatch.setattr(session, "ROWS_PER_TASK", 100, raising=False)
    spark.range(5000).coalesce(1).write.parquet(f"{tmp_path}/one")
    rows = session.spread(spark.read.parquet(f"{tmp_path}/one"))
    sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 5000 and max(sizes) <= 200
    assert rows.distinct().count() == 5000
