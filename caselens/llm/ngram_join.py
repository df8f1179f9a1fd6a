"""Exact Jaccard join of word n-gram sets by vertical partitioning.

The global order of n-grams is the order of their 64-bit hashes. It is cut into fragments
(ranges), and a set falls apart into one piece per fragment. Both halves of the join work
on pieces:

* Candidates. Linked sets differ in few n-grams. With more fragments than that number, at
  least one fragment holds the same n-grams in both sets. Sets are therefore found by the
  hash of a whole piece, about ten n-grams at a similarity of 0.9, and not by one n-gram:
  common words, lines and passages bring no candidates.
* Counting. Overlaps are counted in each of a few wide fragments separately and summed per
  pair, and the pair is kept by whole-number comparison.

Equal sets are one node from the start. In a group that shares a piece, every set is first
compared with one set of the group, that with the most shared pieces (usually the text all
others were copied from). What remains are pairs in different components. They are found
again by the same means in the differences to that lead: sets that added or removed too few
grams in common with others go, the others meet by their rarest difference. No link that
could join components is left out, and a group of copies costs about one comparison per
member.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import blocks
from .components import components
from .storage import small_or_not, stored

COUNTING_PARTS = 4
_CHECK = np.uint64(0xA0761D6478BD642F)


@lru_cache(maxsize=8)
def _classes(num: int, den: int) -> tuple[tuple[int, int, int, int], ...]:
    """Size classes as (least size, fragments, usual empty fragments, pieces that agree
    beyond a pair's difference).

    A linked pair that differs in d grams has ``fragments - d`` equal pieces, all but the
    empty ones with a key: at least the last number less d.
    """
    out, low = [], 1
    while low < 1 << 40:
        high = max(low + 1, low * 3 // 2)
        most = 2 * (high - 1) * (den - num) // (den + num)
        empty = 0 if not most else 2 + most // 6
        agree = most + 1 + (0 if not most else 1 + most // 4)
        out.append((low, agree + empty, empty, agree))
        low = high
    return tuple(out)


def piece_keys(grams: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the pieces by which a sorted set is found, and for each its class and the
    number of keys that a linked set shares with it there (in the low 20 bits).

    A set works in its size class and in the next one when it can be linked into it. Empty
    pieces give no key; in the rare set that has too many of them for the argument above,
    they do.
    """
    n, classes, out, needs = len(grams), _classes(num, den), [], []
    widest = n * (num + den) * (den - num) // (num * (den + num))
    at = next(i for i in range(len(classes)) if classes[i + 1][0] > n)
    running = np.zeros(n + 1, np.uint64)
    np.cumsum(blocks.mix(grams ^ _CHECK), out=running[1:])
    high_bits = grams >> np.uint64(32)
    while True:
        _, count, empty, agree = classes[at]
        order = (high_bits * np.uint64(count)) >> np.uint64(32)
        cuts = np.searchsorted(order, np.arange(count + 1, dtype=np.uint64))
        sums = running[cuts[1:]] - running[cuts[:-1]]
        places = np.arange(count, dtype=np.uint64) + np.uint64(at << 40)
        keys = blocks.mix(sums + blocks.mix(places + np.uint64(1)))
        full = cuts[1:] > cuts[:-1]
        out.append(keys if count - full.sum() > empty else keys[full])
        needs.append(np.full(len(out[-1]), at << 20 | max(1, agree - widest)))
        at += 1
        if n * den < num * classes[at][0]:
            return np.concatenate(out), np.concatenate(needs)


def _sets(batch: pa.RecordBatch, k: int) -> Iterator[tuple[int, np.ndarray]]:
    row = 0
    for _, _, data, offsets in blocks.text_blocks(batch.column("text")):
        words, firsts = blocks.word_hashes(data, offsets)
        for grams in blocks.shingle_sets(words, firsts, k):
            yield row, grams
            row += 1


def _set_id(grams: np.ndarray) -> tuple[int, int]:
    a = blocks.mix(grams + _CHECK).sum(dtype=np.uint64) + np.uint64(len(grams))
    b = blocks.mix(grams ^ (_CHECK >> np.uint64(3))).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def _describe(k: int):
    def run(batches):
        for batch in batches:
            n, first, second = [], [], []
            for _, grams in _sets(batch, k):
                a, b = _set_id(grams)
                n.append(len(grams))
                first.append(a)
                second.append(b)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("rid"), pa.array(n, pa.int64()),
                 pa.array(first, pa.int64()), pa.array(second, pa.int64())],
                ["id", "rid", "n", "set_id", "proof"])
    return run


def _pieces(k: int, num: int, den: int):
    def run(batches):
        for batch in batches:
            keys, sets, needs = [], [], []
            for _, grams in _sets(batch, k):
                if len(grams):
                    key, need = piece_keys(grams, num, den)
                    keys.append(key.astype(np.int64))
                    needs.append(need.astype(np.int32))
                    sets.append(np.full(len(key), _set_id(grams)[0]))
            if keys:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(c)) for c in (keys, sets, needs)],
                    ["key", "set_id", "need"])
    return run


def _fragments(k: int):
    """Token pieces in the wide fragments, for rows whose text has the wanted set."""
    def run(batches):
        for batch in batches:
            wanted = batch.column("set_id").to_pylist()
            sets, parts, grams_of = [], [], []
            for row, grams in _sets(batch, k):
                if _set_id(grams)[0] != wanted[row]:
                    continue
                cuts = np.searchsorted(
                    grams, np.arange(1, COUNTING_PARTS, dtype=np.uint64)
                    * np.uint64((1 << 64) // COUNTING_PARTS))
                for part, piece in enumerate(np.split(grams, cuts)):
                    sets.append(wanted[row])
                    parts.append(part)
                    grams_of.append(piece.astype(np.int64))
            if sets:
                ends = np.cumsum([0, *map(len, grams_of)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sets, pa.int64()), pa.array(parts, pa.int32()),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(grams_of)))],
                    ["set_id", "part", "grams"])
    return run


def _token_pieces(pairs: DataFrame, texts: DataFrame, sets: DataFrame, k: int) -> DataFrame:
    """(set_id, part, grams) of the sets of ``pairs``; every part is there, also an empty one."""
    wanted = pairs.select(F.col("a").alias("set_id")).union(pairs.select("b")).distinct()
    rows = small_or_not(stored(sets.join(wanted, "set_id").select("rid", "set_id"), "wanted"))
    # A repeated id can bring one set twice; the copies are equal, one is enough.
    return texts.select("rid", "text").join(rows, "rid").mapInArrow(
        _fragments(k), "set_id long, part int, grams array<long>").dropDuplicates(["set_id", "part"])


def _side_by_side(pairs: DataFrame, pieces: DataFrame) -> DataFrame:
    """Both pieces of each pair (a, b) in each part: ``grams`` and ``_other``."""
    return small_or_not(pairs).join(
        pieces.select(F.col("set_id").alias("a"), "part", "grams"), "a").join(
        pieces.select(F.col("set_id").alias("b"), "part", F.col("grams").alias("_other")), ["b", "part"])


def _counted(pairs: DataFrame, pieces: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, na, nb, shared): the overlap of each pair, summed over the wide fragments."""
    partial = _side_by_side(pairs, pieces).select(
        "a", "b", F.size(F.array_intersect("grams", "_other")).cast("long").alias("shared"))
    sizes = sets.select("set_id", "n")
    return partial.groupBy("a", "b").agg(F.sum("shared").alias("shared")).join(
        sizes.select(F.col("set_id").alias("a"), F.col("n").alias("na")), "a").join(
        sizes.select(F.col("set_id").alias("b"), F.col("n").alias("nb")), "b")


def _links(counted: DataFrame, num: int, den: int) -> DataFrame:
    """The counted pairs at the similarity or above."""
    return counted.where(F.col("shared") * (den + num) >= (F.col("na") + F.col("nb")) * num).select("a", "b")


def _outside(rows: DataFrame, *values: tuple[str, str, bool]) -> DataFrame:
    """Adds the least (or greatest) values of the other components in the row's group ``b``.

    ``values`` are (column, new column, whether the least). A group needs two numbers for each:
    the best one, and the best one of another component than the best. Rows of groups of one
    component go.
    """
    picks = {name: (value, F.min if lowest else F.max) for value, name, lowest in values}
    best = rows.groupBy("b", "component").agg(*[pick(value).alias(name) for name, (value, pick) in picks.items()])
    first = best.groupBy("b").agg(F.count("*").alias("_c"), *[
        pick(F.struct(name, "component")).alias(f"_1{name}") for name, (_, pick) in picks.items()])
    second = best.join(first.where("_c > 1"), "b").groupBy("b").agg(*[c for name, (_, pick) in picks.items() for c in (
        F.first(f"_1{name}").alias(f"_1{name}"),
        pick(F.when(F.col("component") != F.col(f"_1{name}.component"), F.col(name))).alias(f"_2{name}"))])
    return rows.join(small_or_not(stored(second, "outside")), "b").select(*rows.columns, *[
        F.when(F.col("component") == F.col(f"_1{name}.component"), F.col(f"_2{name}")).otherwise(
            F.col(f"_1{name}.{name}")).alias(name) for name in picks])


# Two rows x, y can be linked when x.e <= y.g, x.f <= y.p and the same with x and y exchanged.
_HAS_PARTNER = "least_e <= g and e <= most_g and least_f <= p and f <= most_p"


def _bounded(rows: DataFrame, twice: int) -> DataFrame:
    """Adds the bounds f, g and p that follow from ``added``, ``removed`` and ``e``."""
    return rows.withColumns({
        "f": F.col("e") - twice * F.col("removed"), "p": twice * F.col("added") - F.col("e"),
        "g": twice * (F.col("added") + F.col("removed")) - F.col("e")})


def _with_partners(rows: DataFrame, twice: int) -> DataFrame:
    """The rows that can be linked with a set of another component of their group, by counts."""
    return _outside(_bounded(rows, twice), ("e", "least_e", True), ("f", "least_f", True),
                    ("g", "most_g", False), ("p", "most_p", False)).where(_HAS_PARTNER)


def _difference(known: DataFrame, pieces: DataFrame, *sides: tuple[Column, int]) -> DataFrame:
    """(b, set_id, grams, new): grams of each set of ``known`` and its lead b by which they differ,
    as a list in each part."""
    marked = F.array(*[F.struct(grams.alias("grams"), F.lit(new).alias("new")) for grams, new in sides])
    return _side_by_side(known.select(F.col("set_id").alias("a"), "b"), pieces).select(
        "b", F.col("a").alias("set_id"), F.inline(marked)).where(F.size("grams") > 0)


def _grams_of(known: DataFrame, lists: DataFrame) -> DataFrame:
    """(b, set_id, gram, new) of the rows of ``known``; lists of the others are not opened."""
    return lists.join(small_or_not(known.select("b", "set_id")), ["b", "set_id"], "left_semi").select(
        "b", "set_id", F.explode("grams").alias("gram"), "new")


def _narrowed(known: DataFrame, lists: DataFrame, twice: int) -> DataFrame:
    """The rows of ``known`` that still have partners when only those of their grams (``lists``) count
    that another set of the group, which is left too, has as well; repeated while many go."""
    columns, before, rows = known.columns, None, known.count()
    while rows and (before is None or 4 * rows <= 3 * before):
        alone = _grams_of(known, lists).groupBy("b", "gram").agg(
            F.count("*").alias("_m"), F.min("set_id").alias("set_id"), F.min("new").alias("new")).where(
            "_m = 1").groupBy("b", "set_id").agg(
            F.sum("new").alias("_a"), F.sum(1 - F.col("new")).alias("_r"))
        held = known.join(small_or_not(stored(alone, "alone")), ["b", "set_id"], "left").withColumns({
            "added": F.col("all_added") - F.coalesce("_a", F.lit(0)),
            "removed": F.col("all_removed") - F.coalesce("_r", F.lit(0))})
        known = stored(_with_partners(held, twice).select(columns), "known")
        before, rows = rows, known.count()
    return known


def _unsettled(led: DataFrame, grouped: DataFrame, counted: DataFrame,
               pieces: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of different components that share a piece and can still be linked.

    Everything is measured from the lead b of a group. Dx, the difference of x to b, is what x
    added (grams of x alone, ax of them) and what it removed (grams of b alone, rx). With
    ex = (den + num) |Dx| - (den - num) |x|, two sets are linked when
    2 (den + num) |Dx and Dy| >= ex + ey. Added grams meet only added ones, removed ones only
    removed ones, so |Dx and Dy| <= min(ax, ay) + min(rx, ry), where only grams count that other
    open sets of the group have too. Written with fx = ex - 2 (den + num) rx,
    px = 2 (den + num) ax - ex and gx = 2 (den + num) (ax + rx) - ex, a pair needs ex <= gy,
    ey <= gx, fx <= py and fy <= px. So

    * x needs a partner of another component within these bounds. In a large group nearly
      every gram of b is removed by several copies, but a set that is not linked with b needs
      added grams in common with its partner: most copies that were edited on their own go by
      counts alone, without being paired.
    * Added grams are counted within the group among the sets that are left, again and again
      while many go. Only what then remains brings its removed grams, and is counted so too.
    * Of these, a pair meets by the first gram that both hold in the order of rarity, and the
      bounds are taken with what each side holds from there on.
    """
    labelled = led.join(small_or_not(grouped.withColumnRenamed("node", "set_id")), "set_id",
                        "left").select(
        "key", "set_id", "b", F.coalesce("component", "set_id").alias("component"))
    # Both uses of a key meet in one exchange.
    labelled = labelled.repartition("key")
    mixed = labelled.groupBy("key").agg(
        F.min("component").alias("_p"), F.max("component").alias("_q")).where("_p < _q")
    left = stored(labelled.where("set_id != b").join(mixed.select("key"), "key").select(
        "set_id", "b", "component").distinct(), "left")
    if left.isEmpty():
        return left.select(F.col("set_id").alias("a"), "b").limit(0)
    both = left.select("set_id").union(left.select("b")).distinct()
    single = pieces.join(small_or_not(stored(both, "open")), "set_id", "left_semi").select(
        "set_id", "part", F.explode("grams").alias("_g")).groupBy("part", "_g").agg(
        F.count("*").alias("_m"), F.min("set_id").alias("set_id")).where("_m = 1").groupBy(
        "set_id").agg(F.count("*").alias("s"))
    single = small_or_not(stored(single, "single"))
    far = counted.select(F.col("a").alias("_x"), F.col("b").alias("_y"), "na", "nb", "shared")
    both_sides, twice = den + num, 2 * (den + num)
    known = left.withColumns({"_x": F.least("set_id", "b"), "_y": F.greatest("set_id", "b")}).join(
        small_or_not(stored(far, "far")), ["_x", "_y"]).join(single, "set_id", "left").withColumn(
        "n", F.when(F.col("set_id") == F.col("_x"), F.col("na")).otherwise(F.col("nb"))).withColumns({
            "all_added": F.col("n") - F.col("shared"),
            "all_removed": F.col("na") + F.col("nb") - F.col("n") - F.col("shared")}).select(
        "b", "set_id", "component", "n", "all_added", "all_removed",
        (F.col("all_added") - F.coalesce("s", F.lit(0))).alias("added"),
        F.col("all_removed").alias("removed"),
        (both_sides * (F.col("all_added") + F.col("all_removed")) - (den - num) * F.col("n")).alias("e"))
    known = stored(known, "known")
    columns = known.columns
    for _ in range(2):
        known = stored(_with_partners(known, twice).select(columns), "known")
    new, gone = F.array_except("grams", "_other"), F.array_except("_other", "grams")
    known = _narrowed(known, stored(_difference(known, pieces, (new, 1)), "added"), twice)
    lists = stored(_difference(known, pieces, (new, 1), (gone, 0)), "differences")
    known = _narrowed(known, lists, twice)
    differences = _grams_of(known, lists).repartition("b", "gram")
    common = differences.groupBy("b", "gram").agg(F.count("*").alias("_f"), F.min("set_id").alias("_p")).where(
        "_f > 1").select("b", "gram", "_f")
    common = stored(differences.join(common, ["b", "gram"]), "shared")
    held = common.groupBy("b", "set_id").agg(F.sum("new").alias("added"), F.sum(1 - F.col("new")).alias("removed"))
    fit = stored(_with_partners(known.drop("added", "removed", "all_added", "all_removed").join(
        small_or_not(stored(held, "held")), ["b", "set_id"]), twice), "fit")
    # What a set holds from a gram on, in the order of rarity that all sets of the group share.
    rarest = Window.partitionBy("b", "set_id").orderBy("_f", "gram").rowsBetween(0, Window.unboundedFollowing)
    rare = common.join(small_or_not(fit.drop("added", "removed", "f", "g", "p")), ["b", "set_id"]).withColumns({
        "added": F.sum("new").over(rarest), "removed": F.sum(1 - F.col("new")).over(rarest)})
    rare = stored(_bounded(rare, twice).where(_HAS_PARTNER).select(
        "b", "gram", "set_id", "component", "n", "e", "f", "g", "p"), "rare")
    x, y = rare.alias("x"), rare.alias("y")
    return x.join(y, (F.col("x.b") == F.col("y.b")) & (F.col("x.gram") == F.col("y.gram"))
                  & (F.col("x.set_id") < F.col("y.set_id"))
                  & (F.col("x.component") != F.col("y.component"))
                  & (F.least("x.n", "y.n") * den >= F.greatest("x.n", "y.n") * num)
                  & (F.col("x.e") <= F.col("y.g")) & (F.col("y.e") <= F.col("x.g"))
                  & (F.col("x.f") <= F.col("y.p")) & (F.col("y.f") <= F.col("x.p"))).select(
        F.col("x.set_id").alias("a"), F.col("y.set_id").alias("b")).distinct()


def ngram_groups(docs: DataFrame, k: int = 5, num: int = 8, den: int = 10,
                 doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Groups of documents linked by den * |A and B| >= num * |A or B| of their k-word sets.

    Words are runs without ASCII white space, A-Z lowered. Returns one row per input row:
    doc_id, n_shingles, set_id (equal sets share it) and component_id, the smallest doc_id
    reachable by links. A text with fewer than k words is one gram; a null, empty or blank
    text has no grams, links with nothing and is its own component. A null doc_id keeps its
    row and is never the smallest. Other columns are not read. Sets are compared by 64-bit
    gram hashes; two different sets with one set hash stop the job by an error.
    """
    source = docs.select(F.col(doc_id).alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    rid: Column = F.xxhash64(F.coalesce(F.col("id").cast("string"), F.col("text")))
    texts = source.select("id", rid.alias("rid"), "text")
    kind = source.schema["id"].dataType.simpleString()
    described = stored(texts.mapInArrow(
        _describe(k), f"id {kind}, rid long, n long, set_id long, proof long"), "described")
    sets = stored(described.where("n > 0").groupBy("set_id").agg(
        F.min("n").alias("n"), F.min("rid").alias("rid"), F.min("id").alias("least"),
        F.min("proof").alias("_p"), F.max("proof").alias("_q")).select(
        "set_id", "rid", "least", F.when(F.col("_p") == F.col("_q"), F.col("n")).otherwise(
            F.raise_error(F.lit("two gram sets share a hash")).cast("bigint")).alias("n")), "sets")

    # One exchange serves both sides: keys of one set only go, others meet their sets. Rows
    # are two numbers and stream through, so a large group costs its task time, not memory.
    keyed = texts.select("text").mapInArrow(
        _pieces(k, num, den), "key long, set_id long, need int").repartition("key")
    # All columns are used on both sides, else they would be pruned on one and the exchange
    # could not be shared.
    shared = keyed.groupBy("key").agg(
        F.min("set_id").alias("_p"), F.max("set_id").alias("_q"),
        F.min("need").alias("_r")).where("_p < _q and _r >= 0")
    met = stored(keyed.join(shared.select("key"), "key").distinct(), "met")
    # A set that shares fewer keys than a linked set would share with it links with none:
    # texts that have a passage or some lines in common go here. Of the others, a linked pair
    # still meets when each set leaves out its most frequent keys, one less than they share.
    able = small_or_not(stored(met.groupBy("set_id", "need").agg(F.count("*").alias("_n")).withColumn(
        "_most", F.col("_n") + 1 - F.col("need").bitwiseAND(0xFFFFF)).where("_most > 0").drop("_n"), "able"))
    met = met.join(able, ["set_id", "need"]).repartition("key")
    counts = met.groupBy("key").agg(F.count("*").alias("_m")).where("_m > 1")
    rarest = Window.partitionBy("set_id", "need").orderBy("_m", "key")
    kept = met.join(counts, "key").withColumn("_r", F.row_number().over(rarest)).where(
        F.col("_r") <= F.col("_most")).select("key", "set_id").repartition("key")
    members = stored(kept.join(kept.groupBy("key").agg(F.count("*").alias("_m")).where("_m > 1"),
                               "key"), "members")
    weight = small_or_not(stored(members.groupBy("set_id").agg(
        F.sum("_m").alias("weight")), "weight"))
    weighed = members.join(weight, "set_id").select("key", "set_id", "weight").repartition("key")
    led = stored(weighed.join(weighed.groupBy("key").agg(
        F.max(F.struct("weight", "set_id")).getField("set_id").alias("b")), "key").select(
        "key", "set_id", "b"), "led")
    first = stored(led.where("set_id != b").select(
        F.least("set_id", "b").alias("a"), F.greatest("set_id", "b").alias("b")).distinct(), "first")
    pieces = stored(_token_pieces(first, texts, sets, k), "pieces")
    counted = stored(_counted(first, pieces, sets), "counted")
    links = stored(_links(counted, num, den), "links")
    grouped = components(links)
    rest = stored(_unsettled(led, grouped, counted, pieces, num, den).join(
        first, ["a", "b"], "left_anti"), "rest")
    if not rest.isEmpty():
        more = stored(_counted(rest, pieces, sets), "more")
        grouped = components(links.union(_links(more, num, den)))

    named = sets.join(grouped.withColumnRenamed("node", "set_id"), "set_id", "left").select(
        "set_id", "least", F.coalesce("component", "set_id").alias("_c"))
    least = named.groupBy("_c").agg(F.min("least").alias("component_id"))
    of_set = named.join(least, "_c").select("set_id", "component_id")
    return described.join(of_set, "set_id", "left").select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("set_id")).alias("set_id"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
        .alias("component_id"))
