"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one per block element; lines of menus, adverts, forms, comments
and the like go. The rest weigh their text, outside articles only if most of it is no link.
The weights are summed over sliding windows of lines: where the sum surges a stretch of text
begins, where it dives to nothing the stretch ends, and the lines between are kept, together
with weighted lines that directly lead up to the surge, such as a title. The edges of a named
article or main element end windows and stretches. Stretches inside and outside named
articles are weighed against each other; the article loses only to far more text.
"""

from __future__ import annotations

import html
import re
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

WINDOW = 3
SURGE = 120
LINK_SHARE = 0.5
OUTSIDE_TIMES = 4

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|svg|iframe|xmp|math)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>"
    r"|</?[a-zA-Z][^>]*(?:>|\Z)|<[!?][^>]*(?:>|\Z)", re.S | re.I)
_HINT = re.compile(r"(?:class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_SPACE = re.compile(r"\s+")

DROPPED = frozenset(
    "nav header footer aside form button select menu dialog head title label input fieldset "
    "option datalist object canvas audio video map".split())
DROPPED_WORDS = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising banner breadcrumb breadcrumbs "
    "comment comments commentlist complementary consent contentinfo cookie cookies disclaimer "
    "discussion disqus footer form gdpr header masthead menu modal nav navbar navigation "
    "newsletter notice notices overlay pager pagination popup promo promotion recommended "
    "related replies reply respond search share sharing sidebar sidebars signup skip social "
    "sponsor sponsored subscribe subscription tags toolbar widget widgets".split())
# Words that may stand beside a dropped word in one class name.
STRUCTURE_WORDS = frozenset(
    "area bar block body bottom box button buttons container content group inner item items left "
    "link links list main outer page panel right section site slot top wrap wrapper".split())
# Parts that hold articles of their own, written by readers or pointing elsewhere.
FOREIGN_WORDS = frozenset(
    "comment comments commentlist discussion disqus recommended related replies reply respond".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt "
    "fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main "
    "menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title "
    "tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


def _unwanted(name: str, rest: str) -> tuple[bool, bool]:
    """(whether an element is dropped, whether articles inside it are dropped with it).

    A class name counts as a whole: site-footer and ad-slot-2 are dropped, has-sidebar and
    comments-open say something about a page and are not.
    """
    if name in DROPPED:
        return True, False
    if name in ("html", "body", "main") or "=" not in rest:
        return False, False
    if re.search(r"\bhidden\b(?!\s*=)|aria-hidden\s*=\s*\"?true|display\s*:\s*none", rest, re.I):
        return True, True
    dropped, foreign = False, False
    for m in _HINT.finditer(rest):
        for token in (m[1] or m[2] or m[3] or "").split():
            words = {w.lower() for w in _PART.findall(token) if not w.isdigit()}
            if words & DROPPED_WORDS and words <= DROPPED_WORDS | STRUCTURE_WORDS:
                dropped, foreign = True, foreign or bool(words & FOREIGN_WORDS)
    return dropped, foreign


class _Lines:
    """Lines of a page: text, characters inside links, and the article part they stand in."""

    def __init__(self):
        self.rows: list[tuple[str, int, int]] = []
        self.text: list[str] = []
        self.linked = 0

    def add(self, piece: str, link: bool) -> None:
        self.text.append(piece)
        self.linked += len(piece.strip()) if link else 0

    def end(self, dropped: bool, part: int) -> None:
        text = _SPACE.sub(" ", html.unescape("".join(self.text))).strip()
        if text and not dropped:
            self.rows.append((text, self.linked, part))
        self.text, self.linked = [], 0


def page_lines(page: str) -> list[tuple[str, int, int]]:
    """The lines that are not dropped, with odd parts inside named articles, even ones outside."""
    lines, at = _Lines(), 0
    skip, foreign, depth, article, link, part = "", False, 0, 0, 0, 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            lines.add(page[at:m.start()], link > 0)
        at = m.end()
        if not m["name"]:
            continue
        name, closes = m["name"].lower(), bool(m["end"])
        if name == "br":
            lines.add(" ", False)
            continue
        if name in BLOCKS:
            lines.end(bool(skip), part)
        if name in VOID:
            continue
        if name == "a":
            link = 0 if closes else 1
        opens_article = name in ("article", "main") and not closes
        unwanted, holds_foreign = (False, False) if closes else _unwanted(name, m["rest"])
        if skip and opens_article and not foreign and not unwanted:
            skip, depth = "", 0  # what holds an article is no menu, or was never closed
        if skip:
            if name == skip:
                depth += -1 if closes else 1
                skip = skip if depth else ""
        elif unwanted and not (opens_article and not article):
            skip, foreign, depth = name, holds_foreign, 1
        elif name in ("article", "main"):
            article = max(0, article + (-1 if closes else 1))
            part += (part % 2) != (article > 0)
    if at < len(page):
        lines.add(page[at:], link > 0)
    lines.end(bool(skip), part)
    return lines.rows


def stretches(lines: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """(begin, end) of the lines between a surge and the next dive, part by part."""
    weights = [len(text) if part % 2 or linked <= LINK_SHARE * len(text) else 0
               for text, linked, part in lines]
    kept, low = [], 0
    for _, group in groupby(lines, key=lambda line: line[2]):
        high = low + len(list(group))
        sums = [sum(weights[i:min(i + WINDOW, high)]) for i in range(low, high)]
        i = low
        while i < high:
            if sums[i - low] < SURGE or not weights[i]:
                i += 1
                continue
            begin = i
            while begin > low and weights[begin - 1]:
                begin -= 1
            while i < high and sums[i - low]:
                i += 1
            kept.append((begin, i))
        low = high
    return [(b, e) for begin, end in kept for b, e in _weighted(weights, begin, end)]


def _weighted(weights: list[int], begin: int, end: int) -> list[tuple[int, int]]:
    """The runs of weighted lines between two places."""
    runs, i = [], begin
    for has, group in groupby(weights[begin:end], key=bool):
        n = len(list(group))
        if has:
            runs.append((i, i + n))
        i += n
    return runs


def main_text(page: str | None) -> str:
    """The kept lines of a page in page order, joined by one space.

    Without a surge on the whole page its article is short: all its lines are kept, or all
    lines of a page that names no article.
    """
    lines = page_lines(page or "")
    inside: list[str] = []
    outside: list[str] = []
    for begin, end in stretches(lines):
        (inside if lines[begin][2] % 2 else outside).extend(t for t, _, _ in lines[begin:end])
    named = inside or [text for text, _, part in lines if part % 2]
    if sum(map(len, outside)) > OUTSIDE_TIMES * sum(map(len, named)):
        return " ".join(outside)
    return " ".join(named or [text for text, linked, _ in lines if linked <= LINK_SHARE * len(text)])


def extract_main_text(pages: DataFrame, column: str = "html") -> DataFrame:
    """All columns of ``pages`` but the html, plus ``text`` and ``n_chars`` (code points).

    A null, empty or text-less page gives an empty text. Columns named like the two results
    are replaced by them. Whole pages are read; nothing is cut.
    """
    kept = [f for f in pages.schema.fields if f.name not in (column, "text", "n_chars")]
    names = [f.name for f in kept]

    def run(batches):
        for batch in batches:
            found = [main_text(p.as_py()) for p in batch.column("_page")]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(batch.schema.get_field_index(n)) for n in names],
                 pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())],
                [*names, "text", "n_chars"])

    rows = pages.select(*[F.col(f"`{n}`") for n in names], F.col(f"`{column}`").alias("_page"))
    return rows.mapInArrow(run, StructType(
        [*kept, StructField("text", StringType()), StructField("n_chars", LongType())]))
