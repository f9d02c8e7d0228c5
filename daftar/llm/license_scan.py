"""Licence scans by conditional compression.

A built-in pattern marks texts that may hold a licence; only these reach the tasks' Python.  There, the words within reach of a
licence word are cut, in any layout, into candidate blocks that overlap by half.  Every block is compressed
alone and with each template as raw zstandard dictionary, and templates are ranked by what they save.  Those that save too
little are done with; of the others the passages are sought from the block on by exact wording: at most some words may be missing
and some put between.  A passage so confirmed must get smaller by a share with its template, and of passages that overlap, the one whose
template saves the most bytes stays (of one template's, the closest in wording), so licences in a row are all reported.

One pass, no shuffle; the templates are a fixed table that travels with the tasks.
Defined cases: null or empty text has no candidate and no licence; a candidate that no
template explains is counted but names nothing; repeated rows are scanned each for itself; a very long
text is scanned whole, in time that grows with its licence words; equal savings go to the closest wording, then
to the first template; an empty table gives an empty one.  Extra columns of any name are left aside.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daftar.llm.license_templates import TEMPLATES, Template

#: Words that make their surroundings a candidate; the same in Java's and Python's notation.
#: Whatever isn't a letter or digit may stand between two words, since lines wrap and comments have marks.
TRIGGER = (
    r"(?i)licen[sc]e|copyright|permission[^a-z0-9]+(?:is[^a-z0-9]+hereby|to[^a-z0-9]+use)|redistribut|spdx|public[^a-z0-9]+domain"
    r"|rights[^a-z0-9]+reserved|creative[^a-z0-9]+commons|free[^a-z0-9]+software|(?<![a-z0-9])cc0?[ -](?:by|1)"
)
#: The share of a passage's words that must be there.
SHARE = 0.85
#: Words that may stand between a passage's first and last word without being in it: two and a share of its length.
EXTRA = 0.15
#: Least reduction of a passage's compressed size.
LEAST = 0.2
#: Words of a candidate block, and from one to the next.
BLOCK, STEP = 8, 4
#: Bytes that a template must save in a block to be sought in it.
FLOOR = 4

_TRIGGER, _WORD = re.compile(TRIGGER, re.ASCII), re.compile(r"[A-Za-z0-9]+")


class Passage:
    """A template's passage as words, and how far it may be stretched."""

    def __init__(self, template: int, text: str):
        self.template, self.words = template, [w.lower() for w in _WORD.findall(text)]
        n = len(self.words)
        self.least = next(k for k in range(n + 1) if k >= SHARE * n)
        self.span = int(n + 2 + EXTRA * n)
        self.heads = frozenset(self.words[: n - self.least + 1])  # what a passage with so many words missing may begin with
        self.bits: dict[str, int] = {}
        for j, w in enumerate(self.words):
            self.bits[w] = self.bits.get(w, 0) | 1 << j

    def common(self, words: list[str]) -> list[int]:
        """Bit sets by word; the zeros below place j of the i-th count what the first i words and j of the passage have in common, in order."""
        ones = (1 << len(self.words)) - 1
        rows = [ones]
        for w in words:
            v = rows[-1]
            u = v & self.bits.get(w, 0)
            rows.append(((v + u) | (v - u)) & ones)
        return rows

    def align(self, words: list[str]) -> list[tuple[int, int]] | None:
        """Places (in the passage, in the words) of a longest common sequence; None if it is too short."""
        rows, n = self.common(words), len(self.words)
        if n - rows[-1].bit_count() < self.least:
            return None
        held = lambda i, j: j - (rows[i] & ((1 << j) - 1)).bit_count()
        out, i, j = [], len(words), n
        while i and j:
            if held(i - 1, j) == held(i, j):
                i -= 1
            elif held(i, j - 1) == held(i, j):
                j -= 1
            else:
                i, j = i - 1, j - 1
                out.append((j, i))
        return out[::-1]

    def places(self, words: list[str], starts: Iterable[int], needs: tuple[str, ...]) -> Iterator[tuple[int, int, int, int]]:
        """(first, last, words wrong, words right) wherever the passage stands from one of the starts on."""
        done = 0  # the word after a passage that stood there word for word
        for s in starts:
            if s < done or words[s] not in self.heads:
                continue
            here = words[s : s + self.span]
            if sum(w in self.bits for w in here) < self.least or (pairs := self.align(here)) is None:
                continue
            got = iter([self.words[j] for j, _ in pairs])
            if not all(any(w == x for x in got) for w in needs):
                continue
            right, first, last = len(pairs), s + pairs[0][1], s + pairs[-1][1]
            extra = last + 1 - first - right
            if right == len(self.words) and not extra:
                done = last + 1
            if extra <= 2 + EXTRA * len(self.words):
                yield first, last, len(self.words) - right + extra, right


class Taken:
    """Stretches that don't overlap, in order."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []

    def add(self, start: int, end: int) -> bool:
        """Take a stretch unless it overlaps one that is taken."""
        i = bisect_right(self.starts, start)
        if (i and self.ends[i - 1] > start) or (i < len(self.starts) and self.starts[i] < end):
            return False
        self.starts.insert(i, start)
        self.ends.insert(i, end)
        return True


class Scanner:
    """Compressors and passages of the templates."""

    def __init__(self, templates: tuple[Template, ...] = TEMPLATES):
        self.templates = templates
        self.plain = zstandard.ZstdCompressor(level=6, write_content_size=False)
        self.with_template = []
        self.passages = [[Passage(k, p) for p in t.passages] for k, t in enumerate(templates)]
        self.reach = max((p.span for own in self.passages for p in own), default=0)
        for t in templates:
            body = "\n".join(" ".join(p.split()) for p in t.passages).lower().encode()
            content = zstandard.ZstdCompressionDict(body, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=6)
            self.with_template.append(zstandard.ZstdCompressor(dict_data=content, write_content_size=False, write_dict_id=False))

    def blocks(self, text: str) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
        """Places of the text's words, and (first, end) of the stretches of them that a passage with a licence word can lie in."""
        hits = [m.span() for m in _TRIGGER.finditer(text)]
        if not hits:
            return [], []
        words = [m.span() for m in _WORD.finditer(text)]
        starts, out = [a for a, _ in words], []
        for a, b in hits:
            lo, hi = max(0, bisect_right(starts, a) - 1 - self.reach), min(len(words), bisect_right(starts, b - 1) + self.reach)
            if out and lo <= out[-1][1]:
                out[-1] = (out[-1][0], hi)
            else:
                out.append((lo, hi))
        return words, out

    def saved(self, text: str, templates: Iterable[int]) -> tuple[int, dict[int, int]]:
        """Compressed size of a text, and how many bytes smaller it gets with each template."""
        data = " ".join(text.split()).lower().encode()
        plain = len(self.plain.compress(data))
        return plain, {k: plain - len(self.with_template[k].compress(data)) for k in templates}

    def candidates(self, words: list[str]) -> Iterator[tuple[int, list[int]]]:
        """Where each block begins, and the templates that save enough in it, the most first."""
        for at in range(0, max(1, len(words) - STEP), STEP):
            _, gains = self.saved(" ".join(words[at : at + BLOCK]), range(len(self.templates)))
            yield at, sorted((k for k, g in gains.items() if g >= FLOOR), key=lambda k: (-gains[k], k))

    def confirmed(self, words: list[str]) -> list[tuple[int, int, int, int]]:
        """(template, first, last, words wrong) of passages found by wording; those of one template don't overlap, the closest are there."""
        starts: dict[int, set[int]] = {}
        for at, ranked in self.candidates(words):
            for k in ranked:
                starts.setdefault(k, set()).update(range(at, min(len(words), at + BLOCK)))
        out = []
        for k, own in starts.items():
            found = {x for p in self.passages[k] for x in p.places(words, sorted(own), self.templates[k].needs)}
            taken = Taken()
            for first, last, wrong, _ in sorted(found, key=lambda x: (2 * x[2] - x[3], x[0], x[1])):
                if taken.add(first, last + 1):
                    out.append((k, first, last, wrong))
        return out

    def scan(self, text: str) -> tuple[int, list[tuple[int, int, str, float]]]:
        """How many stretches of candidates the text has, and (start, end, licence, reduction) of the passages confirmed in them, in order."""
        places, runs = self.blocks(text)
        out = []
        for lo, hi in runs:
            ranked = []
            for k, first, last, wrong in self.confirmed([text[a:b].lower() for a, b in places[lo:hi]]):
                start, end = places[lo + first][0], places[lo + last][1]
                plain, gains = self.saved(text[start:end], (k,))
                if gains[k] >= LEAST * plain:
                    ranked.append((-gains[k], wrong, k, start, end, gains[k] / plain))
            taken = Taken()
            out += sorted((start, end, self.templates[k].spdx, share) for _, _, k, start, end, share in sorted(ranked) if taken.add(start, end))
        return len(runs), out

    def name(self, text: str) -> tuple[str, float] | None:
        """The licence that a text's first confirmed passage states and the size reduction by its template."""
        found = self.scan(text)[1]
        return found[0][2:] if found else None


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """``(id_col, n_blocks, found array<struct<start,end,spdx,reduction>>)`` for every row."""
    rows = docs.select(F.col(id_col), F.when(F.col(text_col).rlike(TRIGGER), F.col(text_col)).alias("t"))
    place = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("spdx", pa.string()), ("reduction", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        for batch in batches:
            counts, found = [], []
            for value in batch.column(1):
                n, own = scanner.scan(value.as_py() or "")
                counts.append(n)
                found.append([dict(zip(("start", "end", "spdx", "reduction"), x, strict=True)) for x in own])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(found, pa.list_(place))], ["id", "n_blocks", "found"]
            )

    kind = docs.schema[id_col].dataType.simpleString()
    found = "array<struct<start:bigint,end:bigint,spdx:string,reduction:double>>"
    return rows.mapInArrow(run, f"id {kind}, n_blocks long, found {found}").withColumnRenamed("id", id_col)


def report(docs: DataFrame) -> DataFrame:
    """One row per document: stretches of candidates, confirmed passages, and the licences they state."""
    names = F.array_sort(F.array_distinct(F.transform("found", lambda x: x["spdx"])))
    return scan(docs).select(
        "doc_id", "n_blocks", F.size("found").cast("long").alias("n_confirmed"), F.array_join(names, ",").alias("licenses")
    )
