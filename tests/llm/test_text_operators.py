"""Operators on texts against plain versions of themselves, and their edge cases."""

import hashlib
import html
import itertools
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from caselens.llm import (
    decontaminate, induced_sorting, licenses, main_text, ngram_join, personal_data, repeated_spans,
    toxicity,
)

from .conftest import edge_texts, prose


def test_suffix_arrays_equal_sorted_suffixes():
    rng = np.random.default_rng(1)
    for case in range(200):
        s = np.append(rng.integers(1, rng.integers(2, 6), rng.integers(1, 60)), 0)
        if case % 3 == 0:
            s = np.append(np.tile(s[:-1], 3), 0)
        order = induced_sorting.suffix_array(s)
        assert order.tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())
        common = induced_sorting.permuted_common_prefixes(s, order, 8)
        for a, b in itertools.pairwise(order.tolist()):
            same = 0
            while same < 8 and b + same < len(s) and a + same < len(s) and s[a + same] == s[b + same]:
                same += 1
            assert common[b] == same


def plain_repeats(rows):
    data = [(t or "").encode() for _, t in rows]
    counts = Counter(d[i:i + 200] for d in data for i in range(len(d) - 199))
    out = []
    for (doc, _), d in zip(rows, data, strict=True):
        gone = bytearray(len(d))
        for i in range(len(d) - 199):
            if counts[d[i:i + 200]] > 1:
                gone[i:i + 200] = b"\1" * 200
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        out.append((doc, len(d), sum(gone), len(re.findall(b"\1+", bytes(gone))),
                    hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def test_repeated_spans(spark, edge_docs, no_docs, monkeypatch):
    shared = prose(7, 60)
    rows = [(i, t if i != 8 else prose(3, 900)) for i, t in edge_texts()] + [
        (20, prose(21, 50) + shared + prose(22, 50)), (21, prose(23, 10) + shared),
        (22, "ab" * 400), (23, "x" * 199), (24, "y" * 200), (25, "z" * 201),
        (26, shared[:210] + "q" + shared[210:])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert Counter(map(tuple, repeated_spans.remove_repeats(docs).collect())) == plain_repeats(rows)
    monkeypatch.setattr(repeated_spans, "GROUP_MOST", 1)
    monkeypatch.setattr(repeated_spans, "BROADCAST_ROWS", 0)
    assert Counter(map(tuple, repeated_spans.remove_repeats(docs).collect())) == plain_repeats(rows)
    assert repeated_spans.remove_repeats(no_docs).count() == 0
    assert repeated_spans.remove_repeats(edge_docs).count() == len(edge_texts())


def gram_set(text, k):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall("[^\x20\x09-\x0d]+", lowered)
    if len(words) < k:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i:i + k]) for i in range(len(words) - k + 1))


def plain_groups(rows, k, num, den):
    sets = [gram_set(t, k) for _, t in rows]
    number = {g: i for i, g in enumerate(g for g, n in Counter(itertools.chain(*sets)).items() if n > 1)}
    held = np.zeros((len(rows), len(number)), np.float32)
    for i, grams in enumerate(sets):
        held[i, [number[g] for g in grams if g in number]] = 1
    common = held @ held.T
    size = np.array([len(g) for g in sets])
    linked = (den * common >= num * (size[:, None] + size - common)) & (common > 0)
    of = list(range(len(rows)))

    def root(i):
        while of[i] != i:
            i = of[i]
        return i

    for i, j in np.argwhere(linked).tolist():
        of[root(j)] = root(i)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(doc, least.get(root(i), doc))
    return Counter((doc, len(sets[i]), least.get(root(i)) if sets[i] else doc)
                   for i, (doc, _) in enumerate(rows))


@pytest.mark.parametrize("k,num,den", [(3, 90, 100), (5, 8, 10)])
def test_ngram_join_equals_all_pairs(spark, k, num, den):
    rng = random.Random(k)
    rows = [r for r in edge_texts() if r[0] != 8]
    for group in range(12):
        words = prose(100 + group, rng.choice([6, 12, 40, 120, 200])).split()
        rows.append((1000 + 20 * group, " ".join(words)))
        for copy in range(1, 9):
            own = list(words)
            for _ in range(rng.randint(0, max(1, len(words) // 25))):
                own[rng.randrange(len(own))] = f"edit{rng.randint(0, 5)}"
            if rng.random() < 0.3:
                own = own[:-rng.randint(1, max(1, len(own) // 12))]
            rows.append((1000 + 20 * group + copy, " ".join(own)))
    rows += [(5000 + i, prose(300 + i, 20) + " " + prose(9, 40)) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = ngram_join.ngram_groups(docs, k, num, den)
    assert Counter(tuple(r) for r in got.select("doc_id", "n_shingles", "component_id").collect()
                   ) == plain_groups(rows, k, num, den)


def test_ngram_join_keeps_chains_under_every_lead(spark):
    rows = []
    for chain in range(300):
        p = [f"w{chain}x{i}" for i in range(27)]
        x = [*p[:-1], f"last{chain}"]
        rows += [(3 * chain + i, " ".join(t)) for i, t in enumerate((p, x, [f"first{chain}", *x[1:]]))]
    got = ngram_join.ngram_groups(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, 100)
    assert {r.doc_id: r.component_id for r in got.collect()} == {i: i // 3 * 3 for i in range(900)}


@pytest.mark.parametrize(("k", "num", "den", "most"), [(3, 90, 100, 7), (5, 8, 10, 8)])
def test_ngram_join_of_one_group_of_many_near_copies(spark, k, num, den, most):
    """Edits around the similarity: some copies link with the text, some only with another copy."""
    rng, base = random.Random(k), prose(77, 150).split()
    rows = []
    for i in range(2000):
        own = list(base)
        for _ in range(rng.randint(0, most)):
            at = rng.randrange(len(own))
            own[at:at + 1] = rng.choice([[], [f"e{rng.randint(0, 30)}"], [own[at], f"e{rng.randint(0, 30)}"]])
        rows.append((i, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = ngram_join.ngram_groups(docs, k, num, den).select("doc_id", "n_shingles", "component_id")
    want = plain_groups(rows, k, num, den)
    assert Counter(tuple(r) for r in got.collect()) == want
    assert 2 < len({c for _, _, c in want}) < 1500


def test_ngram_join_takes_no_grams_of_copies_edited_on_their_own(spark, monkeypatch):
    """Two copies with a long passage in common leave the other copies of their group settled."""
    rng, base = random.Random(12), [f"w{i}" for i in range(400)]
    passage, rows = [f"p{i}" for i in range(60)], []
    for i in range(302):
        own = list(base)
        for at in rng.sample(range(0, 400, 6), 8 if i < 2 else rng.randint(10, 13)):
            own[at] = f"e{i}x{at}"
        rows.append((i, " ".join(own[:200] + (passage if i < 2 else []) + own[200:])))
    rows.append((302, " ".join(base)))
    written, stored = {}, ngram_join.stored

    def counting(df, name):
        df = stored(df, name)
        written[name] = max(written.get(name, 0), df.count())
        return df

    monkeypatch.setattr(ngram_join, "stored", counting)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = ngram_join.ngram_groups(docs, 5, 8, 10).select("doc_id", "n_shingles", "component_id")
    want = plain_groups(rows, 5, 8, 10)
    assert Counter(tuple(r) for r in got.collect()) == want
    assert len({c for _, _, c in want}) > 250 and written["left"] > 250
    assert written["differences"] < 20 * len(rows) and written["shared"] < len(rows)


def test_ngram_join_edges(edge_docs, no_docs):
    assert ngram_join.ngram_groups(no_docs).count() == 0
    got = {r.doc_id: r for r in ngram_join.ngram_groups(edge_docs).collect()}
    assert got[2].component_id == 1 and got[10].component_id == 9
    assert (got[3].n_shingles, got[3].component_id, got[4].n_shingles) == (0, 3, 0)


def plain_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        before, row[0] = row[0], i
        for j, b in enumerate(text, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (a != b))
    return min(row)


def test_decontamination(spark, edge_docs, no_docs):
    rng = random.Random(4)
    items = [(i, prose(50 + i, rng.randint(15, 50))) for i in range(6)] + [(9, None), (10, ""), (11, "tiny")]
    rows = []
    for i, text in items[:6]:
        for share in (0.0, 0.05, 0.09, 0.2, 0.5):
            own = list(text)
            for _ in range(int(share * len(own))):
                at = rng.randrange(len(own))
                own[at:at + 1] = rng.choice(["", "#", own[at] + "#"])
            rows.append((len(rows), prose(len(rows) + 500, 40) + " " + "".join(own).upper() + "\n"
                         + prose(len(rows) + 700, 40)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: {x.item_id: x.edits for x in r["_items"]} for r in
           decontaminate.find_benchmark_items(docs, bench).collect()}
    for doc, text in rows:
        want = {i: plain_distance(t, text.lower().replace("\n", " ")) for i, t in items[:6]}
        assert got[doc] == {i: e for i, e in want.items() if e <= int(
            min(decontaminate.EDIT_SHARE * len(dict(items)[i]), (len(dict(items)[i]) - 8) // 8))}
    assert decontaminate.find_benchmark_items(no_docs, bench).count() == 0
    assert decontaminate.find_benchmark_items(edge_docs, bench.limit(0)).where("size(_items) > 0").count() == 0
    found = decontaminate.find_benchmark_items(edge_docs, bench)
    assert found.count() == len(edge_texts()) and set(edge_docs.columns) | {"_items"} == set(found.columns)


def test_short_items_are_whole_texts(spark):
    bench = spark.createDataFrame([(1, "Yes"), (2, " yes"), (3, "ß1"), (4, "a b"), (5, "x"), (6, " ")],
                                  "item_id long, text string")
    rows = [(1, "\n YES "), (2, "yes sir"), (3, "SS1"), (4, "a\tb"), (5, "x"), (6, ""), (7, None),
            (8, "  "), (9, "xx"), (10, prose(1, 50) + " yes")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = {r.doc_id: [x.item_id for x in r["_items"]] for r in
           decontaminate.find_benchmark_items(docs, bench).collect()}
    assert {i: x for i, x in got.items() if x} == {1: [1, 2], 3: [3], 4: [4], 5: [5]}
    assert len(got) == len(rows)


def test_memory_of_very_long_texts_follows_hits():
    rng = np.random.default_rng(3)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz    "))
    items = [(i, "".join(rng.choice(letters, 60))) for i in range(3000)]
    table, = decontaminate.prepare(items, decontaminate.Q, decontaminate.EDIT_SHARE)
    text = "".join(rng.choice(letters, 2_000_000))
    text = text[:1_500_000] + items[7][1] + text[1_500_000:]
    data = np.frombuffer(text.encode(), np.uint8)
    points, firsts = decontaminate.folded(data, np.array([0, len(data)]))
    tracemalloc.start()
    found = decontaminate.matches(points, firsts, table)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (0, 7, 0) in found and len(found) == 1
    assert peak < 50 * len(points)  # a counter for each stretch and item would alone take 94 MB


def test_decontamination_keeps_the_budget_at_every_length_and_folds_case(spark):
    rng = random.Random(8)
    items, rows = [], []
    for size in [*range(6, 45), 81, 100, 201]:
        text = "".join(rng.choice("bcdfghjklm") for _ in range(size))
        own, edits = list(text), int(0.12 * size)
        for n in range(edits):  # evenly spread: no gram longer than the bound's is left whole
            own[(n + 1) * size // (edits + 1)] = "#"
        items.append((size, text))
        rows.append((size, "xyz " * 30 + "".join(own) + " zyx" * 30))
    greek, cyrillic, sharp = "Το φως της αυγής έπεσε στη θάλασσα", "Съешь ещё этих мягких булок", "große Straße am weißen Fluß"
    items += [(1001, greek), (1002, cyrillic), (1003, sharp)]
    rows += [(i, "ab\n" + t.upper() + "\tcd") for i, t in items[-3:]]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: {x.item_id: x.edits for x in r["_items"]} for r in
           decontaminate.find_benchmark_items(docs, bench).collect()}
    folded = {i: t.casefold() for i, t in items}
    for doc, text in rows:
        want = {i: plain_distance(t, re.sub(r"\s", " ", text.casefold())) for i, t in folded.items()}
        assert got[doc] == {i: e for i, e in want.items() if e <= int(0.12 * len(folded[i]) + 1e-9)}
        assert got[doc][doc] == (0 if doc > 1000 else int(0.12 * doc))


def test_license_words_and_labels(spark, edge_docs, no_docs):
    texts = ["Licensed under the Apache License, Version 2.0.", "MIT-License mit  license x", None, "",
             "SPDX-License-Identifier: GPL-3.0-only", "cc by-nc 4.0 and CC BY", "gnu general public license s"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan_licenses(docs).collect()}
    assert (got[1].n_words, got[1].n_base, got[1].first_word, got[1].last_word) == (5, 2, 0, 2)
    assert got[0].base_labels == "apache" and got[0].labels == "apache"
    assert (got[2].n_words, got[2].first_word, got[2].score, got[3].labels) == (0, None, 0.0, "")
    assert got[4].labels == "gpl" and got[5].labels == "cc-by,cc-by-nc" and got[6].n_base == 1
    assert licenses.scan_licenses(no_docs).count() == 0
    assert licenses.scan_licenses(edge_docs).count() == len(edge_texts())
    assert len(licenses.rules()) > 200
    inside = licenses.detections("released under the mit license", frozenset(["mit"]), licenses.rules())
    assert len(inside) == 1 and inside[0][0] == "mit"


def sample(nodes, rng):
    """A text that the parsed pattern matches; zero-width parts are left out."""
    out = ""
    for op, arg in nodes:
        kind = str(op)
        if kind == "LITERAL":
            out += chr(arg)
        elif kind in ("NOT_LITERAL", "ANY"):
            out += "q"
        elif kind == "IN":
            op, arg = rng.choice(arg) if str(arg[0][0]) != "NEGATE" else ("LITERAL", ord("7"))
            out += (chr(arg) if str(op) == "LITERAL" else chr(rng.randint(*arg)) if str(op) == "RANGE"
                    else rng.choice(" \n\u00a0") if "SPACE" in str(arg) and "NOT" not in str(arg) else "u")
        elif kind == "SUBPATTERN":
            out += sample(arg[-1], rng)
        elif kind == "BRANCH":
            out += sample(rng.choice(arg[1]), rng)
        elif "REPEAT" in kind:
            low, high, item = arg
            out += "".join(sample(item, rng) for _ in range(rng.randint(low, min(int(high), low + 1))))
        else:
            assert kind in ("ASSERT", "ASSERT_NOT", "AT"), kind
    return out


def test_license_gates_lose_no_match():
    rng, scanner = random.Random(6), licenses.Scanner()
    every = frozenset().union(*[r.gate for r in scanner.rules])
    texts = ["licensed under the LGPLv3", "Licensed under LGPLv2.1 or", "covered by the AGPLv3", "GPLv1",
             "released under the General Public License, version 2", "do what the fork you want to",
             "llama2 community license", "see elastic.co/licensing", "cecill.info", "fdlv1 gnu fdlv1.3",
             "huggingface.co/a/b/license", "joinup.ec.europa.eu/x/eupl", "public domain dedication and license"]
    for rule in scanner.rules:
        parsed = re._parser.parse(rule.pattern.pattern)
        for before, after in itertools.product(("", "x", "\u00e9", "7"), ("", "s", "2", "\u00e9")):
            texts.append(before + sample(parsed, rng) + after)
    found = 0
    for text in texts:
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text)
        want = licenses.detections(lowered, every, scanner.rules)
        data = np.frombuffer(text.encode(), np.uint8)
        got = scanner.scan(data, np.array([0, len(data)]))[0]
        assert set(got[5].split(",")) - {""} == {w[0] for w in want} | (set(got[4].split(",")) - {""}), text
        assert got[6] == max([w[3] for w in want] + [0.6] * bool(got[4]), default=0.0), text
        found += bool(want)
    assert found > 0.6 * len(texts)


def plain_spans(t):
    out = [(m.start(), m.end(), "email") for m in re.finditer(
        r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t)
            if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        digits = re.sub("[^0-9]", "", m[0])
        if 12 <= len(digits) <= 19 and personal_data.luhn(digits):
            out.append((m.start(), m.end(), "card"))
    out += [(m.start(), m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t)
            if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], personal_data.KINDS.index(s[2])))


def test_strict_spans_equal_the_patterns():
    rng = random.Random(3)
    for _ in range(5000):
        text = "".join(rng.choice("a1234.@+ -()b5%\n") for _ in range(rng.randint(0, 45)))
        assert personal_data.base_spans(text) == plain_spans(text)
    assert personal_data.luhn("4539578763621486") and not personal_data.luhn("4539578763621487")


def test_personal_data(spark, edge_docs, no_docs):
    texts = ["call (555) 123-4567 or +1 (269) 555-3296", "mail a.b@c.example.com", None,
             "order 555-123-4567x", "card 4539 5787 6362 1486", "10.0.0.300 and 10.0.0.3"] * 5
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in personal_data.find_personal_data(docs, personal_data.fit(docs)).collect()}
    for doc, text in enumerate(texts):
        strict = ",".join(f"{k}:{b}:{e}" for b, e, k in plain_spans(text or ""))
        assert got[doc].base_sha256 == hashlib.sha256(strict.encode()).hexdigest()
        assert set(filter(None, strict.split(","))) <= set(got[doc].spans.split(","))
    assert got[0].n_phone == 1 and got[4].n_card == 1 and got[5].n_ip == 1
    assert personal_data.find_personal_data(no_docs, personal_data.fit(no_docs)).count() == 0
    assert personal_data.find_personal_data(edge_docs, personal_data.fit(edge_docs)).count() == len(edge_texts())


def test_reliabilities_follow_the_votes():
    good, bad = "phone:1,1,0,1,0,1,0,0,2", "phone:0,-1,0,0,-1,-1,0,0,2"
    likely, table = personal_data.estimate([(good, 80), (bad, 20)])
    assert likely[good] > 0.9 > 0.1 > likely[bad] and table.shape == (6, 2, 3)
    beta = personal_data.train_classifier([(good, 80), (bad, 20)], likely)
    assert personal_data._features(good) @ beta > 0 > personal_data._features(bad) @ beta


PAGE = """<html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header>Top</header><nav><ul><li><a href=x>Menu</a></li></ul></nav><div class="ad">Buy</div>%s
<div id="comments"><p>Nice!</p></div><aside>Side</aside><form>Send<input></form><footer>&copy; F</footer></body></html>"""


def test_main_text(spark):
    article = "<article><h1>Head&amp;line</h1><p>One <b>bo</b>ld\n word<br>next<p>Two&nbsp;x</p></article>"
    assert main_text.main_text(PAGE % article) == "Head&line One bold word next Two x"
    plain = "".join(f"<p>{prose(i, 30)}</p>" for i in range(4))
    assert main_text.main_text(PAGE % plain) == " ".join(prose(i, 30) for i in range(4))
    cut = (PAGE % article)[:(PAGE % article).index("</article>")]
    assert main_text.main_text(cut) == "Head&line One bold word next Two x"
    for odd in (None, "", "   ", "<p", "<!-- x", "<script>never ends", "<div class='ad'>x"):
        assert main_text.main_text(odd) == ""
    assert main_text.main_text("a < b and c > d " * 20) == " ".join(["a < b and c > d"] * 20)
    rows = [(1, "u", PAGE % article, "t0", 3), (1, "u", PAGE % article, "t0", 3), (2, None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = main_text.extract_main_text(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"] and got.count() == 3
    assert {(r.page_id, r.n_chars) for r in got.collect()} == {(1, 34), (2, 0)}
    assert main_text.extract_main_text(pages.limit(0)).count() == 0


def tag_filter(page):
    """The article of a given page by its tags alone; the given pages drop only class ad inside."""
    page = re.sub(r"(?s)<!--.*?-->|<(script|style)\b.*?</\1>|<div class=\"ad\">.*?</div>", "", page)
    inside = "\n".join(re.findall(r"(?s)<(?:article|main)\b[^>]*>(.*?)</(?:article|main)>", page))
    inside = re.sub(r"(?s)<(nav|aside|footer|header|form)\b.*?</\1>", "", inside)
    inside = re.sub(r"</?(?:h[1-6]|p|div|br|li|ul|ol|section|blockquote|pre|table|tr|td)\b[^>]*>", " ", inside)
    return " ".join(html.unescape(re.sub(r"<[^>]*>", "", inside)).split())


def test_windows_alone_find_the_article():
    """Without the article tags the windows choose the same lines, the tags confirm them."""
    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist()
    for page in pages:
        found = main_text.main_text(page)
        assert found == main_text.main_text(re.sub(r"<(/?)(?:article|main)\b[^>]*>", r"<\1div>", page))
        assert found == tag_filter(page)


def test_class_names_of_main_text():
    body = f"<h1>T</h1><p>{prose(1, 40)}</p>"
    want = "T " + prose(1, 40)
    for kept in ("<div class='site has-sidebar'>%s</div>", "<article class='post comments-open'>%s</article>",
                 "<div class='search-enabled'><article>%s</article></div>",
                 "<div class='sidebar'><article>%s</article></div>", "<article class='comments'>%s</article>",
                 "<div class='site-footer'>x</div><article>%s<p class='ad-slot-2'>y</p></article>",
                 "<article>%s<div class='comment-body'>n</div></article><div id='comments'><article>c</article></div>",
                 "<div><p>teaser</p></div><article>%s</article><p>" + "more " * 40 + "</p>",
                 "<article>teaser</article><div>%s</div>"):
        assert main_text.main_text(kept % body) == want, kept


def test_network_gradients():
    net, rng = toxicity.Network(3), np.random.default_rng(0)
    for name in net.p:
        net.p[name] = net.p[name].astype(np.float64)
    x = rng.standard_normal((5, 3, toxicity.WIDTH))
    mask = np.ones((5, 3))
    mask[3:, 1] = 0
    wanted = np.array([1.0, 0.0, 1.0])

    def loss():
        logit = net.forward(x, mask, keep=True)[0]
        return np.mean(np.logaddexp(0, logit) - wanted * logit)

    grad, d_x = net.backward(x, mask, wanted)
    for name in ("xf", "hf", "cb", "hb", "att", "att_v", "out", "out_b"):
        flat, at = net.p[name].reshape(-1), rng.integers(net.p[name].size)
        was = flat[at]
        flat[at] = was + 1e-3
        up = loss()
        flat[at] = was - 1e-3
        down = loss()
        flat[at] = was
        assert abs((up - down) / 2e-3 - grad[name].reshape(-1)[at]) < 2e-3
    was = x[1, 0, 2]
    x[1, 0, 2] = was + 1e-3
    up = loss()
    x[1, 0, 2] = was - 1e-3
    assert abs((up - loss()) / 2e-3 - d_x[1, 0, 2]) < 2e-3


def test_toxicity_learns_words_and_beginnings(spark, edge_docs, no_docs):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(700):
        words = prose(i, rng.randint(5, 60)).split()
        bad = i % 4 == 0
        if bad:
            words[rng.randrange(len(words))] = rng.choice(["blasted", f"grum{rng.choice('abcdefgh')}{rng.choice('xyz')}"])
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marked = spark.createDataFrame([*labels, (None, 1, 1), (3, 0, None)], "doc_id long, quality int, toxic int")
    net = toxicity.train_network(docs, marked)
    scored = {r.doc_id: r["_score"] for r in toxicity.score_toxicity(docs, net).collect()}
    import zlib
    held = [i for i in range(700) if zlib.crc32(str(i).encode()) % 4 == 2]
    right = sum((scored[i] >= 0.3) == (i % 4 == 0) for i in held)
    assert right >= 0.9 * len(held)
    got = toxicity.score_toxicity(edge_docs, net)
    assert got.count() == len(edge_texts()) and got.where("_score < 0 or _score > 1").count() == 0
    assert got.where("doc_id in (3, 4, 5)").agg({"_score": "max"}).first()[0] == 0
    assert toxicity.score_toxicity(no_docs, toxicity.train_network(no_docs, marked)).count() == 0
