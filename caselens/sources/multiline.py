"""Merging continuation lines into the event line above them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..functions.columns import is_blank
from ..operators.ordered import BLOCK_LINES, carry_forward
from ..operators.skew import GROUP_ROWS_PER_TASK
from ..session import cut_lineage

MAX_CONTINUATION_LINES = 2000
MAX_BLOCK_CHARS = 1_000_000

_UNIT = ("source_id string, line_no long, raw string, first_line string, "
         "continuation_lines int, truncated boolean, orphan boolean")


def starts_block(start_regex: str):
    """A vectorised predicate with Python's regex rules, anchored at the line start."""
    pattern = re.compile(start_regex)

    @pandas_udf("boolean")
    def matches(raw: pd.Series) -> pd.Series:
        return raw.map(lambda text: pattern.match(text) is not None)

    return matches


class _OpenBlock:
    """The block being built; the caps keep it bounded whatever the input is."""

    def __init__(self, key, line_no, text, orphan):
        self.key, self.line_no, self.orphan = key, line_no, orphan
        self.texts, self.chars = [text], len(text)

    def fits(self, text: str, max_cont: int, max_chars: int) -> bool:
        return len(self.texts) <= max_cont and self.chars + len(text) <= max_chars

    def add(self, text: str) -> None:
        self.texts.append(text)
        self.chars += len(text)

    def row(self, truncated: bool) -> tuple:
        return (self.key[0], self.line_no, "\n".join(self.texts), self.texts[0],
                len(self.texts) - 1, truncated, self.orphan)


def merge_multiline(lines: DataFrame, start_regex: str,
                    max_cont: int = MAX_CONTINUATION_LINES,
                    max_chars: int = MAX_BLOCK_CHARS,
                    lines_per_task: int = GROUP_ROWS_PER_TASK,
                    piece_lines: int = BLOCK_LINES) -> DataFrame:
    """Blocks of a start line and its continuation lines, one row per block.

    Columns: source_id, line_no (first line), raw (joined), first_line,
    continuation_lines, truncated, orphan. Blank lines neither join nor end a block and
    are left out, as are lines above the first start line (``stray_lines``).

    Blocks are the unit of distribution, not files: every line knows its start line by a
    carry over line blocks, the rows are partitioned by that start line, and one task
    streams through its blocks with memory for a single capped block. A run of more than
    ``lines_per_task`` lines without a start line is first cut where the limits cut it
    (``_giant_cuts``) and then partitioned by those cuts.
    """
    block = ["source_id", "_start"]
    known = with_start_line(lines, start_regex).where(F.col("_start").isNotNull())
    giants = cut_lineage(known.groupBy(*block).agg(F.count(F.lit(1)).alias("_lines")).where(
        F.col("_lines") > lines_per_task).select(*block))
    if giants.isEmpty():
        return _stream_blocks(known.withColumn("_cut", F.col("_start")), max_cont, max_chars)
    # At most all lines / lines_per_task rows.
    giants = F.broadcast(giants)
    cuts = _giant_cuts(known.join(giants, block, "left_semi"), max_cont, max_chars, piece_lines)
    rest = known.join(giants, block, "left_anti").withColumn("_cut", F.col("_start"))
    giant_rows = known.join(giants, block, "left_semi").join(cuts, [*block, "line_no"])
    merged = _stream_blocks(giant_rows.select(*rest.columns), max_cont, max_chars)
    # All but the last part of a giant block were cut by the limits, all but the first are orphans.
    ends = cuts.groupBy("source_id", F.col("_cut").alias("line_no")).agg(
        F.first("_start").alias("_start"))
    last = ends.groupBy(*block).agg(F.max("line_no").alias("_last"))
    flagged = (merged.join(ends, ["source_id", "line_no"]).join(last, block)
               .withColumn("truncated", F.col("line_no") < F.col("_last"))
               .withColumn("orphan", F.col("line_no") > F.col("_start")))
    return _stream_blocks(rest, max_cont, max_chars).unionByName(
        flagged.select(*merged.columns))


def _stream_blocks(rows: DataFrame, max_cont: int, max_chars: int) -> DataFrame:
    """Join the lines of each ``_cut`` in line order, within the limits."""
    columns = [c.split()[0] for c in _UNIT.split(", ")]

    def merge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block: _OpenBlock | None = None
        for frame in frames:
            done = []
            for source, start, line_no, text in zip(
                    frame["source_id"], frame["_cut"], frame["line_no"], frame["raw"]):
                key = (source, start)
                if block is not None and block.key == key:
                    if block.fits(text, max_cont, max_chars):
                        block.add(text)
                        continue
                    done.append(block.row(truncated=True))
                    block = _OpenBlock(key, line_no, text, orphan=True)
                    continue
                if block is not None:
                    done.append(block.row(truncated=False))
                block = _OpenBlock(key, line_no, text, orphan=False)
            if done:
                yield pd.DataFrame(done, columns=columns, dtype=object)
        if block is not None:
            yield pd.DataFrame([block.row(truncated=False)], columns=columns, dtype=object)

    return (rows.repartition("source_id", "_cut")
            .sortWithinPartitions("source_id", "_cut", "line_no")
            .mapInPandas(merge, _UNIT))


def _jumps(sizes: np.ndarray, max_cont: int, max_chars: int) -> np.ndarray:
    """For a part that begins at each line, the line at which the next part begins."""
    upto = np.cumsum(sizes)
    at = np.arange(len(sizes))
    by_chars = np.searchsorted(upto, upto - sizes + max_chars, side="right")
    return np.maximum(np.minimum(by_chars, at + max_cont + 1), at + 1)


def _giant_cuts(rows: DataFrame, max_cont: int, max_chars: int, piece_lines: int) -> DataFrame:
    """source_id, _start, line_no → _cut, the first line of the part the line belongs to.

    Where the limits cut depends on every cut before. The lines are divided into pieces,
    each seen together with the end of the piece before it. A piece maps "the open part
    began at line a" to "the part open at my end began at line b"; lines with one
    b are ranges, as many as a part may have lines at most. Maps of neighbours are composed pairwise (``_entries``); then every
    piece walks from its known beginning.
    """
    block = ["source_id", "_start"]
    piece = max(piece_lines, max_cont + 1)
    narrow = rows.select(*block, "line_no", F.length("raw").alias("_n")).withColumn(
        "_span", F.floor(F.col("line_no") / F.lit(piece)))
    before = Window.partitionBy(*block).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    offsets = narrow.groupBy(*block, "_span").agg(F.count(F.lit(1)).alias("_c")).select(
        *block, "_span", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_offset"))
    index = F.col("_offset") + F.row_number().over(
        Window.partitionBy(*block, "_span").orderBy("line_no")) - 1
    indexed = narrow.join(offsets, [*block, "_span"]).withColumn("_i", index)
    own = F.floor(F.col("_i") / F.lit(piece))
    in_tail = F.col("_i") % piece >= piece - (max_cont + 1)
    pieces = indexed.select(*block, "line_no", "_n", "_i", F.explode(
        F.when(in_tail, F.array(own, own + 1)).otherwise(F.array(own))).alias("_piece"))
    key = [*block, "_piece"]
    with_own = pieces.withColumn("_has_own", F.max(
        F.floor(F.col("_i") / F.lit(piece)) == F.col("_piece")).over(Window.partitionBy(*key)))
    pieces = with_own.where("_has_own").drop("_has_own")

    def ends(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("_i")
        jump = _jumps(frame["_n"].to_numpy(), max_cont, max_chars)
        last = np.arange(len(jump))
        for i in range(len(jump) - 1, -1, -1):
            if jump[i] < len(jump):
                last[i] = last[jump[i]]
        index = frame["_i"].to_numpy()
        number = int(frame["_piece"].iloc[0])
        starts = int((index < number * piece).sum()) or 1  # lines that may open the piece
        target = index[last[:starts]]
        edge = np.flatnonzero(np.diff(target)) + 1
        return pd.DataFrame({
            "source_id": frame["source_id"].iloc[0], "_start": frame["_start"].iloc[0],
            "_piece": number, "_lo": index[np.r_[0, edge]],
            "_hi": index[np.r_[edge, starts] - 1], "_to": target[np.r_[0, edge]]})

    ranges = pieces.groupBy(*key).applyInPandas(
        ends, "source_id string, _start long, _piece long, _lo long, _hi long, _to long")

    entries = _entries(ranges, block)

    def walk(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("_i")
        index, line = frame["_i"].to_numpy(), frame["line_no"].to_numpy()
        jump = _jumps(frame["_n"].to_numpy(), max_cont, max_chars)
        at = int(index.searchsorted(frame["_entry"].iloc[0]))
        cut = np.zeros(len(index), dtype="int64")
        while at < len(index):
            cut[at:jump[at]] = line[at]
            at = int(jump[at])
        mine = index >= int(frame["_piece"].iloc[0]) * piece
        return pd.DataFrame({
            "source_id": frame["source_id"].iloc[0], "_start": frame["_start"].iloc[0],
            "line_no": line[mine], "_cut": cut[mine]})

    return pieces.join(entries, key).groupBy(*key).applyInPandas(
        walk, "source_id string, _start long, line_no long, _cut long")


def _entries(ranges: DataFrame, block: list[str]) -> DataFrame:
    """The line at which the part open at the begin of each piece began: block, _piece, _entry.

    The maps of two neighbouring pieces make one map of both, with the ranges of the left one,
    and so on up to whole blocks, in as many rounds as the number of pieces has binary digits.
    On the way down a left half is
    entered where both are, a right half where the map of its left one leads.
    """
    levels = [cut_lineage(ranges.withColumnRenamed("_piece", "_node"))]
    top = levels[0].agg(F.max("_node")).first()[0] or 0
    half = F.floor(F.col("_node") / F.lit(2)).alias("_node")
    while top:
        left = levels[-1].where("_node % 2 = 0").select(*block, half, "_lo", "_hi", F.col("_to").alias("_mid"))
        right = levels[-1].where("_node % 2 = 1").select(
            *block, half, F.col("_lo").alias("_from"), F.col("_hi").alias("_until"), "_to")
        # A left half without a right one ends its block: nothing is entered after it.
        both = left.join(right, [*block, "_node"]).where("_mid between _from and _until")
        levels.append(cut_lineage(both.select(*block, "_node", "_lo", "_hi", "_to")))
        top //= 2
    entries = levels[0].select(*block).distinct().select(
        *block, F.lit(0).cast("bigint").alias("_node"), F.lit(0).cast("bigint").alias("_entry"))
    for maps in reversed(levels[:-1]):
        led = maps.where("_node % 2 = 0").select(*block, half, "_lo", "_hi", "_to")
        over = (entries.join(led, [*block, "_node"], "left")
                .where("_to is null or _entry between _lo and _hi"))
        entries = over.select(*block, F.explode(F.array(
            F.struct((2 * F.col("_node")).alias("node"), F.col("_entry").alias("entry")),
            F.struct((2 * F.col("_node") + 1).alias("node"), F.col("_to").alias("entry")))).alias("_c")).select(
            *block, F.col("_c.node").alias("_node"), F.col("_c.entry").alias("_entry")).where(
            "_entry is not null")
    return entries.withColumnRenamed("_node", "_piece")


def with_start_line(lines: DataFrame, start_regex: str) -> DataFrame:
    """Non-blank lines with ``_start``, the line number of their block's first line."""
    text = lines.where(~is_blank(F.col("raw"))).select("source_id", "line_no", "raw")
    marked = text.withColumn("_is_start", starts_block(start_regex)(F.col("raw")))
    return carry_forward(marked, ["source_id"], "line_no",
                         F.when(F.col("_is_start"), F.col("line_no")), "_start").drop("_is_start")


def stray_lines(lines: DataFrame, start_regex: str) -> DataFrame:
    """Non-blank lines above the first start line of their source."""
    return with_start_line(lines, start_regex).where(F.col("_start").isNull()).drop("_start")
