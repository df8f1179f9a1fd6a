import random

import pytest

WORDS = ("amber birch copper delta ember forest garden harbor island jungle kernel lantern meadow "
         "needle orchard pepper quartz river saddle timber umbrella valley willow yonder").split()

# Names that operators use for their own columns.
INNER = ("_pass _place _weight _order _block _n _whole _budget _passes _edge _last _room _row _s "
         "_source _t _items _found _score").split()


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edge_texts():
    """Nulls, empty and blank texts, ties, repeated rows, a very long text and odd bytes."""
    base = prose(1, 60)
    return [(1, base), (2, base), (2, base), (3, None), (4, ""), (5, " \n\t"), (None, prose(2, 30)),
            (None, None), (6, base.replace("a", "e", 1)), (7, "ß漢字 " * 40), (8, prose(3, 20000)),
            (9, "word"), (10, "WORD"), (11, "a\x00b   c"), (12, prose(4, 5))]


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Edge rows with columns whose names operators use inside."""
    rows = [(i, t, "en", "src0", 1, 7, "x", *range(90, 90 + len(INNER))) for i, t in edge_texts()]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, "
              "shard long, component_id string, " + ", ".join(
            f"{name} long" for name in INNER)).repartition(3)


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)
