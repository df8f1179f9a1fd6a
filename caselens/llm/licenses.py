"""License scans by ordered signature rules.

A rule is a pattern with a label, a priority and a gate: words and word beginnings of which
every match holds one, so that the pattern is tried only on texts with one of them. Rules come from a table of license families, written by hand,
and from sentence forms: the name, the name with a version, a grant, an SPDX tag, an address.
Detections inside a detection of the same or a higher priority are suppressed.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass
from itertools import accumulate, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType, DoubleType

from . import blocks

# Phrases every scan looks for by words, and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by",
        "mit license": "mit"}

# label: (gate of the name, gate of the address, name pattern, SPDX identifiers, address pattern)
# Gates hold whole words, or beginnings of words where a pattern is open to the right. A word
# is a run of a-z and 0-9; a first word open to the left (a host's) is no gate. Beginnings
# have 3 to 5 characters.
FAMILIES = {
    "gpl": ("public gpl*", "licen*", r"(?:gnu\s+)?(?:general\s+public\s+licen[sc]e|gpl)", r"gpl-[123]\.0(?:-only|-or-later|\+)?", r"gnu\.org/licenses/(?:old-licenses/)?gpl"),
    "lgpl": ("lesser library lgpl*", "licen*", r"(?:gnu\s+)?(?:(?:lesser|library)\s+general\s+public\s+licen[sc]e|lgpl)", r"lgpl-[23]\.[01](?:-only|-or-later|\+)?", r"gnu\.org/licenses/(?:old-licenses/)?lgpl"),
    "agpl": ("affero agpl*", "licen*", r"(?:gnu\s+)?(?:affero\s+general\s+public\s+licen[sc]e|agpl)", r"agpl-[13]\.0(?:-only|-or-later)?", r"gnu\.org/licenses/agpl"),
    "gfdl": ("documentation fdl*", "licen*", r"gnu\s+(?:free\s+documentation\s+licen[sc]e|fdl)", r"gfdl-1\.[123](?:-only|-or-later)?", r"gnu\.org/licenses/fdl"),
    "apache": ("apache", "licen*", r"apache(?:\s+software)?\s+licen[sc]e", r"apache-[12]\.[01]", r"apache\.org/licenses"),
    "mit": ("mit expat", "licen*", r"(?:mit|expat)(?:\s*/\s*x11)?\s+licen[sc]e", r"mit(?:-0)?", r"opensource\.org/licenses?/mit"),
    "bsd": ("bsd", "licen*", r"(?:(?:new|modified|simplified|[234]-clause|original)\s+)?bsd(?:\s+[0-9]-clause)?\s+licen[sc]e", r"(?:0bsd|bsd-[1234]-clause)", r"opensource\.org/licenses?/bsd"),
    "mpl": ("mozilla", "mpl*", r"mozilla\s+public\s+licen[sc]e", r"mpl-[12]\.[01]", r"mozilla\.org/mpl"),
    "epl": ("eclipse", "legal", r"eclipse\s+public\s+licen[sc]e", r"epl-[12]\.0", r"eclipse\.org/legal/epl"),
    "edl": ("eclipse", "documents", r"eclipse\s+distribution\s+licen[sc]e", r"edl-1\.0", r"eclipse\.org/org/documents/edl"),
    "cddl": ("development", "licen*", r"common\s+development\s+and\s+distribution\s+licen[sc]e", r"cddl-1\.[01]", r"opensource\.org/licenses?/cddl"),
    "cpl": ("common", "licen*", r"common\s+public\s+licen[sc]e", r"cpl-1\.0", r"opensource\.org/licenses?/cpl"),
    "ipl": ("ibm", "licen*", r"ibm\s+public\s+licen[sc]e", r"ipl-1\.0", r"opensource\.org/licenses?/ibmpl"),
    "eupl": ("european", "europa", r"european\s+union\s+public\s+licen[sc]e", r"eupl-1\.[012]", r"joinup\.ec\.europa\.eu/[^\s]*eupl"),
    "isc": ("isc", "licen*", r"isc\s+licen[sc]e", r"isc", r"opensource\.org/licenses?/isc"),
    "zlib": ("zlib libpng", "licen*", r"(?:zlib|libpng)(?:\s*/\s*libpng)?\s+licen[sc]e", r"(?:zlib|libpng-2\.0)", r"zlib\.net/zlib_license"),
    "bsl-boost": ("boost", "licen*", r"boost\s+software\s+licen[sc]e", r"bsl-1\.0", r"boost\.org/license"),
    "busl": ("business", "bsl11*", r"business\s+source\s+licen[sc]e", r"busl-1\.1", r"mariadb\.com/bsl11"),
    "sspl": ("server", "licen*", r"server\s+side\s+public\s+licen[sc]e", r"sspl-1\.0", r"mongodb\.com/licensing/server-side"),
    "elastic": ("elastic", "licen*", r"elastic\s+licen[sc]e", r"elastic-2\.0", r"elastic\.co/licensing"),
    "unlicense": ("unlic*", "org*", r"(?:the\s+)?unlicense", r"unlicense", r"unlicense\.org"),
    "cc0": ("cc0* zero*", "publicdomain", r"(?:cc0|creative\s+commons\s+zero)", r"cc0-1\.0", r"creativecommons\.org/publicdomain/zero"),
    "cc-by": ("cc commons", "licen*", r"(?:cc[\s-]+by|creative\s+commons\s+attribution)(?![\s-]+(?:nc|nd|sa|non|no|share))", r"cc-by-[1234]\.[05]", r"creativecommons\.org/licenses/by/"),
    "cc-by-sa": ("cc commons", "licen*", r"(?:cc[\s-]+by-sa|creative\s+commons\s+attribution[\s-]+share[\s-]*alike)", r"cc-by-sa-[1234]\.[05]", r"creativecommons\.org/licenses/by-sa/"),
    "cc-by-nc": ("cc commons", "licen*", r"(?:cc[\s-]+by-nc|creative\s+commons\s+attribution[\s-]+non[\s-]*commercial)(?![\s-]+(?:nd|sa|no|share))", r"cc-by-nc-[1234]\.[05]", r"creativecommons\.org/licenses/by-nc/"),
    "cc-by-nd": ("cc commons", "licen*", r"(?:cc[\s-]+by-nd|creative\s+commons\s+attribution[\s-]+no[\s-]*deriv\w*)", r"cc-by-nd-[1234]\.[05]", r"creativecommons\.org/licenses/by-nd/"),
    "cc-by-nc-sa": ("cc commons", "licen*", r"(?:cc[\s-]+by-nc-sa|creative\s+commons\s+attribution[\s-]+non[\s-]*commercial[\s-]+share[\s-]*alike)", r"cc-by-nc-sa-[1234]\.[05]", r"creativecommons\.org/licenses/by-nc-sa/"),
    "cc-by-nc-nd": ("cc commons", "licen*", r"(?:cc[\s-]+by-nc-nd|creative\s+commons\s+attribution[\s-]+non[\s-]*commercial[\s-]+no[\s-]*deriv\w*)", r"cc-by-nc-nd-[1234]\.[05]", r"creativecommons\.org/licenses/by-nc-nd/"),
    "artistic": ("artistic", "licen*", r"artistic\s+licen[sc]e", r"artistic-[12]\.0", r"opensource\.org/licenses?/artistic"),
    "psf": ("python psf", "python", r"(?:python\s+software\s+foundation|psf)\s+licen[sc]e", r"psf-2\.0", r"docs\.python\.org/[^\s]*license"),
    "php": ("php", "licen*", r"php\s+licen[sc]e", r"php-3\.0?1?", r"php\.net/license"),
    "ruby": ("ruby", "lang", r"ruby\s+licen[sc]e", r"ruby", r"ruby-lang\.org/[^\s]*license"),
    "wtfpl": ("wtfpl* want*", "net*", r"(?:wtfpl|do\s+what\s+the\s+f\w+\s+you\s+want)", r"wtfpl", r"wtfpl\.net"),
    "ofl": ("sil", "sil", r"sil\s+open\s+font\s+licen[sc]e", r"ofl-1\.[01]", r"scripts\.sil\.org/ofl"),
    "odbl": ("database", "licen*", r"open\s+database\s+licen[sc]e", r"odbl-1\.0", r"opendatacommons\.org/licenses/odbl"),
    "odc-by": ("commons", "licen*", r"open\s+data\s+commons\s+attribution\s+licen[sc]e", r"odc-by-1\.0", r"opendatacommons\.org/licenses/by"),
    "pddl": ("dedication", "licen*", r"public\s+domain\s+dedication\s+and\s+licen[sc]e", r"pddl-1\.0", r"opendatacommons\.org/licenses/pddl"),
    "afl": ("academic", "licen*", r"academic\s+free\s+licen[sc]e", r"afl-[123]\.[012]", r"opensource\.org/licenses?/afl"),
    "osl": ("open", "licen*", r"open\s+software\s+licen[sc]e", r"osl-[123]\.[01]", r"opensource\.org/licenses?/osl"),
    "ms-pl": ("microsoft", "licen*", r"microsoft\s+public\s+licen[sc]e", r"ms-pl", r"opensource\.org/licenses?/ms-pl"),
    "ms-rl": ("microsoft", "licen*", r"microsoft\s+reciprocal\s+licen[sc]e", r"ms-rl", r"opensource\.org/licenses?/ms-rl"),
    "upl": ("universal", "licen*", r"universal\s+permissive\s+licen[sc]e", r"upl-1\.0", r"opensource\.org/licenses?/upl"),
    "ncsa": ("ncsa", "licen*", r"(?:university\s+of\s+illinois\s*/\s*)?ncsa\s+(?:open\s+source\s+)?licen[sc]e", r"ncsa", r"opensource\.org/licenses?/ncsa"),
    "postgresql": ("postgresql", "licen*", r"postgresql\s+licen[sc]e", r"postgresql", r"opensource\.org/licenses?/postgresql"),
    "openssl": ("openssl", "licen*", r"openssl\s+licen[sc]e", r"openssl", r"openssl\.org/source/license"),
    "w3c": ("w3c", "consortium", r"w3c\s+software(?:\s+notice\s+and)?\s+licen[sc]e", r"w3c", r"w3\.org/consortium/legal"),
    "vim": ("vim", "sourceforge", r"vim\s+licen[sc]e", r"vim", r"vimdoc\.sourceforge\.net"),
    "beerware": ("beer beerware", "freebsd", r"beer-?ware\s+licen[sc]e", r"beerware", r"people\.freebsd\.org/~phk"),
    "mulan": ("mulan", "coscl", r"mulan\s+(?:psl|permissive\s+software\s+licen[sc]e)", r"mulanpsl-[12]\.0", r"license\.coscl\.org\.cn"),
    "cecill": ("cecill", "info*", r"cecill(?:-[bc])?(?:\s+free\s+software)?\s+licen[sc]e", r"cecill-(?:[12]\.[01]|[bc])", r"cecill\.info"),
    "openrail": ("openr* rail*", "co", r"(?:creativeml\s+)?open\s*rail(?:-m)?(?:\s+licen[sc]e)?", r"openrail", r"huggingface\.co/[^\s]*license"),
    "llama": ("llama*", "meta", r"llama\s*[0-9.]*\s+community\s+licen[sc]e", r"llama[0-9.]*", r"llama\.meta\.com/[^\s]*license"),
    "public-domain": ("domai*", "publicdomain", r"(?:in|into|to)\s+the\s+public\s+domain", r"publicdomain", r"creativecommons\.org/publicdomain/mark"),
    "proprietary": ("reser* proprietary", "scancode", r"(?:all\s+rights\s+reserved|proprietary\s+and\s+confidential)", r"licenseref-proprietary", r"licenseref-scancode-proprietary"),
}
_GRANT = r"(?:(?:re)?licen[sc]ed|released|distributed|available|published|provided|covered)\s+(?:only\s+)?(?:under|by)(?:\s+the)?(?:\s+terms(?:\s+and\s+conditions)?\s+of(?:\s+the)?)?\s+"
_VERSION = r"[\s,(]*(?:version|v)[\s.]*[0-9]+(?:\.[0-9]+)*"
# Priority, weight and form of the sentences made from a family; {n}, {i}, {u} are its columns.
FORMS = (
    (5, 0.98, r"spdx-license-identifier:\s*[^\n]*?(?<![a-z0-9.-]){i}(?![a-z0-9.-])"),
    (4, 0.95, _GRANT + r"{n}(?:" + _VERSION + r")?"),
    (3, 0.9, r"(?:https?://)?(?:www\.)?{u}"),
    (2, 0.8, r"(?<![a-z0-9]){n}" + _VERSION),
    (1, 0.7, r"(?<![a-z0-9]){n}(?![a-z0-9])"),
)
_TAG_GATE = "identifier"


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    weight: float
    gate: frozenset
    pattern: re.Pattern


def rules() -> list[Rule]:
    """All rules, highest priority first, in the order of the table within a priority."""
    out = []
    for priority, weight, form in FORMS:
        for label, (gate, host, name, tag, address) in FAMILIES.items():
            words = {5: _TAG_GATE, 3: host}.get(priority, gate).split()
            pattern = form.replace("{n}", name).replace("{i}", tag).replace("{u}", address)
            out.append(Rule(label, priority, weight, frozenset(words), re.compile(pattern)))
    return out


def detections(text: str, words: frozenset, table: list[Rule]) -> list[tuple[str, int, int, float]]:
    """(label, start, end, weight) that no detection of the same or a higher priority holds."""
    kept: list[tuple[str, int, int, float]] = []
    for _, level in groupby(table, key=lambda r: r.priority):
        found = sorted(((m.start(), -m.end(), i, rule) for i, rule in enumerate(level)
                        if rule.gate & words for m in rule.pattern.finditer(text)),
                       key=lambda f: f[:3])
        kept.sort(key=lambda k: k[1])
        starts = [k[1] for k in kept]
        reach = list(accumulate((k[2] for k in kept), max))
        here = -1
        for start, end, _, rule in found:
            above = bisect_right(starts, start)
            if max(here, reach[above - 1] if above else -1) < -end:
                kept.append((rule.label, start, -end, rule.weight))
                here = -end
    return kept


def _word_hash(word: str) -> np.uint64:
    data = np.frombuffer(word.encode(), np.uint8)
    return blocks.word_hashes(data, np.array([0, len(data)]), _SEPARATOR)[0][0]


_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
_GATE_SEPARATOR = _SEPARATOR.copy()
_GATE_SEPARATOR[0x80:] = True
SCHEMA = StructType([
    StructField("n_words", LongType()), StructField("n_base", LongType()),
    StructField("first_word", LongType()), StructField("last_word", LongType()),
    StructField("base_labels", StringType()), StructField("labels", StringType()),
    StructField("score", DoubleType())])


class Scanner:
    """Rules and phrases prepared for blocks of texts."""

    def __init__(self):
        self.rules = rules()
        gates = sorted(set().union(*[r.gate for r in self.rules]))
        # Length of the beginnings (0: whole words) with their hashes in order.
        self.gates = []
        for length in sorted({len(g) - 1 if g[-1] == "*" else 0 for g in gates}):
            here = [g for g in gates if (len(g) - 1 if g[-1] == "*" else 0) == length]
            hashes = np.array([_word_hash(g.rstrip("*")) for g in here])
            order = np.argsort(hashes)
            self.gates.append((length, hashes[order], [here[i] for i in order]))
        self.phrases = [([_word_hash(w) for w in p.split()], label) for p, label in BASE.items()]

    def _gates_in(self, lowered: np.ndarray, offsets: np.ndarray) -> dict[int, set[str]]:
        """The gate words and beginnings that occur in each row of a block."""
        starts, ends, firsts = blocks.word_spans(lowered, offsets, _GATE_SEPARATOR)
        running = blocks.prefix_hash(lowered)
        seen: dict[int, set[str]] = {}
        for length, hashes, names in self.gates:
            long = np.flatnonzero(ends - starts >= length)
            words = blocks.span_hash(running, starts[long],
                                     starts[long] + length if length else ends[long])
            spot = np.minimum(np.searchsorted(hashes, words), len(hashes) - 1)
            gated = np.flatnonzero(hashes[spot] == words)
            row = np.searchsorted(firsts, long[gated], side="right") - 1
            for r, g in np.unique(np.stack([row, spot[gated]]), axis=1).T.tolist():
                seen.setdefault(r, set()).add(names[g])
        return seen

    def scan(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple]:
        lowered = blocks.LOWER[data]
        words, firsts = blocks.word_hashes(data, offsets, _SEPARATOR)
        n = len(offsets) - 1
        places: dict[int, list[int]] = {}
        base: dict[int, set[str]] = {}
        for phrase, label in self.phrases:
            at = np.arange(max(0, len(words) - len(phrase) + 1))
            for i, h in enumerate(phrase):
                at = at[words[at + i] == h]
            row = np.searchsorted(firsts, at, side="right") - 1
            for r, a in zip(row.tolist(), at.tolist(), strict=True):
                if a + len(phrase) <= firsts[r + 1]:
                    places.setdefault(r, []).append(a - int(firsts[r]))
                    base.setdefault(r, set()).add(label)
        seen = self._gates_in(lowered, offsets)
        out = []
        for r in range(n):
            found = detections(
                lowered[offsets[r]:offsets[r + 1]].tobytes().decode("utf-8", "replace"),
                frozenset(seen[r]), self.rules) if r in seen else []
            at, labels = places.get(r, []), base.get(r, set())
            score = max([w for *_, w in found] + [0.6] * bool(labels), default=0.0)
            out.append((int(firsts[r + 1] - firsts[r]), len(at), min(at, default=None),
                        max(at, default=None), ",".join(sorted(labels)),
                        ",".join(sorted(labels | {f[0] for f in found})), score))
        return out


def scan_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the counts, word places, labels and score of every whole text.

    A null or empty text has no words, no labels and score 0; repeated rows are scanned
    each; other columns are not read.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(batches):
        scanner = Scanner()
        for batch in batches:
            found = [row for _, _, data, offsets in blocks.text_blocks(batch.column("text"))
                     for row in scanner.scan(data, offsets)]
            columns = list(zip(*found, strict=True)) if found else [[]] * len(SCHEMA)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]],
                ["doc_id", *SCHEMA.names])

    return rows.mapInArrow(run, StructType([rows.schema["doc_id"], *SCHEMA.fields]))
