"""License scans by conditional compression.

Candidate blocks are where the words of a template align with those of a text, whatever lines, comment marks and
paragraphs they are spread over: at least the share of a template's word pairs that its allowed differences must leave
is found, near one place. Each block is compressed alone and with templates as zstandard raw dictionaries: the more a
template says what the block says, the more its bytes shrink. Templates are ranked by that reduction, and winners are
confirmed word for word:

* ``exact``: no difference but case, punctuation and white space;
* ``variant``: few differences, none of them in a number or in a word that tells licenses apart;
* ``unmatched``: neither; ``license`` is null then, and ``nearest`` names the template of the fewest differences.

Templates are whole license texts, their parts and headers, and the sentences by which a text says it is under a license.
Lines that mention licensing and lie in no block are blocks of their own, as a whole and by the sentences in them.
Templates that share too few words with a block to be confirmed are not compressed with it, for want of a chance; of
the others all are compared, in the order of their ranks, until none can have fewer differences.

The candidate filter is a SQL expression, so only texts that mention licensing reach Python, whole.  A worker
remembers the answers for a bounded number of distinct single lines.

Defined cases: a null or empty text has no line; each line that mentions licensing gives one row or lies in the block of
another, also when lines or rows repeat; of overlapping blocks the one of most template words less differences
stands; of templates with equally many differences the better ranked stands; a line of over twice the words of the longest
template has no nearest one; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, replace
from difflib import SequenceMatcher
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleweave.llm.common import slices
from ruleweave.llm.license_texts import TEMPLATES, statements, whole_texts

#: What may stand between two words of a mention: blanks, line ends and comment marks.
_GAP = r"[\s#*/;%>|,-]+"
MENTION = (
    r"(?i)licen[cs]|copyright|permission (is hereby|is granted|to use copy)|redistribution and use|creative commons|\bcc0\b|\bcc by\b"
    r"|all rights reserved|free and unencumbered|free software|without any express or implied warranty|waived all|subject to the terms|gplv[23]|\bspdx\b"
).replace(" ", _GAP)
#: Words whose change means another license, in any template, and in one of few words.
TELLING = frozenset("mit apache gnu gpl lgpl agpl lesser affero bsd mozilla mpl eclipse epl cc0 boost unlicense attribution sharealike noncommercial noderivatives".split())
TELLING_IN_NOTICES = TELLING | frozenset("cc by sa nc nd public general clause".split())
NOTICE_WORDS = 40
LEVEL = 19
#: Differing words a variant may have, in hundredths of the template's words.
VARIANT = 34
CACHED = 50_000
#: Templates of fewer words are looked for in lines and over line ends, longer ones anywhere.
LONG = 24

_MENTION = re.compile(MENTION)
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_WORD = re.compile(r"[^\W_]+(?:\.\d+)*")


def wording(text: str) -> list[str]:
    return _WORD.findall(text.lower())


@dataclass(frozen=True)
class Found:
    nearest: str | None
    plain_bytes: int
    with_bytes: int
    n_edits: int
    differences: tuple[str, ...]
    verdict: str
    n_words: int = 0
    n_lines: int = 1

    @property
    def license(self) -> str | None:
        return None if self.verdict == "unmatched" else self.nearest


_ORDER = {"exact": 0, "variant": 1, "unmatched": 2}


class Scanner:
    """Templates as raw dictionaries."""

    def __init__(self, templates: dict[str, tuple[str, ...]] = TEMPLATES, more: bool = True):
        import zstandard

        #: Those that a block without a license is compared with; the sentences and whole texts only where they can be confirmed.
        self.plain = list(range(sum(len(texts) for texts in templates.values())))
        said = [(name, t) for name, texts in templates.items() for t in texts]
        if more:
            said += [(name, t) for name, t in whole_texts().items()] + [(name, t) for name, texts in statements().items() for t in texts]
        self.templates = [(name, wording(t)) for name, t in said]
        self.bags = [Counter(words) for _, words in self.templates]
        self.most = 2 * max(len(words) for _, words in self.templates)
        raw = [t for _, t in said]
        self.pairs: dict[tuple[str, str], list[tuple[int, int]]] = defaultdict(list)
        for k, (_, words) in enumerate(self.templates):
            for at, pair in enumerate(zip(words, words[1:], strict=False)):
                self.pairs[pair].append((k, at))
        self.alone = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
        dictionaries = [zstandard.ZstdCompressionDict(t.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT) for t in raw]
        self.given = [zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False) for d in dictionaries]

    def ranked(self, block: str, among: list[int] | None = None) -> tuple[int, list[tuple[int, int]]]:
        """Bytes of the block alone, and (bytes, template number), smallest first."""
        data = block.encode("utf-8", "replace")
        among = range(len(self.given)) if among is None else among
        return len(self.alone.compress(data)), sorted((len(self.given[k].compress(data)), k) for k in among)

    def least_edits(self, said: Counter, n_said: int, k: int) -> int:
        """A bound that the differences of a block from a template can't be below: the words they don't share."""
        shared = sum((said & self.bags[k]).values())
        return max(len(self.templates[k][1]), n_said) - shared

    def compared(self, block: str, among: list[int] | None = None) -> Found:
        """The template of the fewest differences from a block."""
        said, best = wording(block), None
        bag = Counter(said)
        alone, order = self.ranked(block, among)
        for rank, (size, k) in enumerate(order):
            name, words = self.templates[k]
            if best is not None and self.least_edits(bag, len(said), k) >= best.n_edits:
                continue
            edits = [(op, words[a:b], said[c:d]) for op, a, b, c, d in SequenceMatcher(None, words, said, autojunk=False).get_opcodes() if op != "equal"]
            n = sum(max(len(x), len(y)) for _, x, y in edits)
            if best is None or n < best.n_edits:
                telling = TELLING_IN_NOTICES if len(words) <= NOTICE_WORDS else TELLING
                told = any(w in telling or any(ch.isdigit() for ch in w) for _, x, y in edits for w in (*x, *y))
                verdict = "exact" if not n else "variant" if 100 * n <= VARIANT * len(words) and not told else "unmatched"
                diff = tuple(" ".join([*(f"-{w}" for w in x), *(f"+{w}" for w in y)]) for _, x, y in edits)
                best = Found(name, alone, size, n, diff, verdict, len(words))
        return best

    def chances(self, block: str) -> list[int]:
        """Templates that a block shares enough words with to be confirmed, or else the plain ones."""
        bag = Counter(wording(block))
        n = sum(bag.values())
        able = [k for k, (_, words) in enumerate(self.templates) if 100 * self.least_edits(bag, n, k) <= VARIANT * len(words)]
        return able or self.plain

    def line(self, line: str) -> Found:
        """The best answer for a line, as a whole or by a sentence of it."""
        sentences = [s for s in _SENTENCE.split(line) if _MENTION.search(s)]
        units = [u for u in dict.fromkeys([line, *sentences]) if len(wording(u)) <= self.most]
        if not units:
            return Found(None, len(self.alone.compress(line.encode("utf-8", "replace"))), 0, 0, (), "unmatched")
        return min((self.compared(u, self.chances(u)) for u in units), key=lambda f: (_ORDER[f.verdict], f.n_edits, -f.plain_bytes))

    def places(self, words: list[str], crosses) -> Iterator[tuple[int, int, int]]:
        """(template, first word, word after the last) where a template's word pairs align with a text's.

        A confirmed block keeps at least 1 - 2 * VARIANT / 100 of them, with starts that differ by no more than its
        edits. Short templates count only where crosses says that they run over a line end.
        """
        hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for i, pair in enumerate(zip(words, words[1:], strict=False)):
            for k, at in self.pairs.get(pair, ()):
                hits[k].append((i - at, i))
        for k, found in hits.items():
            n = len(self.templates[k][1])
            least, slack = max(1, (n - 1) * (100 - 2 * VARIANT) // 100), n * VARIANT // 100
            if len(found) < least:
                continue
            found.sort()
            starts = [s for s, _ in found]
            at = 0
            while at + least <= len(found):
                if starts[at + least - 1] - starts[at] > 2 * slack:
                    at += 1
                    continue
                end = bisect_left(starts, starts[at] + 2 * slack + 1, at)
                own = found[at:end]
                middle = own[len(own) // 2][0]
                first = max(0, min(middle, min(i for _, i in own)))
                last = min(len(words), max(middle + n, max(i for _, i in own) + 2))
                if last - first <= n + 2 * slack + 2 and (n >= LONG or crosses(first, last)):
                    yield k, first, last
                at = end

    @staticmethod
    def _rank(found: Found) -> tuple[bool, int, int]:
        """Confirmed blocks first, then those of most template words less differences, then shorter ones."""
        return found.verdict == "unmatched", found.n_edits - found.n_words, found.n_lines

    def answer(self, line: str, known: dict[str, Found]) -> Found:
        """The answer for a line on its own; known has those of other lines."""
        best = known.get(line)
        if best is None:
            best = self.line(line)
            if len(known) >= CACHED:
                known.clear()
            if len(line) <= 2000:
                known[line] = best
        return best

    def blocks(self, text: str, lines: list[str], known: dict[str, Found]) -> list[tuple[int, Found]]:
        """(line number, answer) of the confirmed blocks that align anywhere in a text, no two over one line."""
        spans, words, line_of = [], [], []
        at = 0
        for number, line in enumerate(lines):
            for m in _WORD.finditer(line.lower()):
                words.append(m.group())
                line_of.append(number)
                spans.append((at + m.start(), at + m.end()))
            at += len(line) + 1
        same = len(text.lower()) == len(text)  # else places in the lowered text are not those in the text
        wanted: dict[tuple[int, int], list[int]] = defaultdict(list)
        for k, first, last in self.places(words, lambda a, b: line_of[a] != line_of[b - 1]):
            wanted[first, last].append(k)
        found = []
        for (first, last), among in wanted.items():
            block = text[spans[first][0] : spans[last - 1][1]] if same else " ".join(words[first:last])
            best = self.compared(block, among)
            begun, ended = line_of[first], line_of[last - 1]
            if best.verdict == "variant" and best.n_words < LONG and any(self.answer(x, known).license for x in lines[begun : ended + 1]):
                continue  # a line of it is confirmed as it stands
            if best.verdict != "unmatched":
                found.append((begun, replace(best, n_lines=ended - begun + 1)))
        kept: list[tuple[int, Found]] = []
        for begun, best in sorted(found, key=lambda x: (self._rank(x[1]), x[0])):
            if all(begun + best.n_lines <= b or b + f.n_lines <= begun for b, f in kept):
                kept.append((begun, best))
        return sorted(kept, key=lambda x: x[0])

    def scan(self, text: str, known: dict[str, Found]) -> Iterator[tuple[int, Found]]:
        """(line number, answer) of the blocks of a text; known has the answers for single lines."""
        lines = text.split("\n")
        blocks = dict(self.blocks(text, lines, known))
        ends = list(accumulate(len(line) + 1 for line in lines))
        told: dict[int, int] = {}  # line where a mention begins: the line where it ends, which may be another
        for m in _MENTION.finditer(text):
            told.setdefault(bisect_right(ends, m.start()), bisect_right(ends, m.end() - 1))
        covered = 0
        for at in sorted({*blocks, *told}):
            if at in blocks:
                covered = at + blocks[at].n_lines
                yield at, blocks[at]
            elif at >= covered:
                last = min([told[at], *(b - 1 for b in blocks if b > at)])
                yield at, replace(self.answer("\n".join(lines[at : last + 1]), known), n_lines=last - at + 1)


@lru_cache(maxsize=1)
def scanner() -> Scanner:
    return Scanner()


def candidates(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """keys and text of the rows that mention licensing."""
    return docs.filter(F.col(text).rlike(MENTION)).select(*keys, F.col(text).alias("_text"))


def scan(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """keys, line_no (from 0), n_lines, license, nearest, plain_bytes, with_bytes, n_edits, differences and verdict of every block."""
    answer = pa.schema(
        [("line_no", pa.int32()), ("n_lines", pa.int32()), ("license", pa.string()), ("nearest", pa.string()), ("plain_bytes", pa.int64())]
        + [("with_bytes", pa.int64()), ("n_edits", pa.int32()), ("differences", pa.list_(pa.string())), ("verdict", pa.string())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Found] = {}
        for batch in slices(batches):
            found = [(i, at, f) for i, t in enumerate(batch.column("_text").to_pylist()) for at, f in scanner().scan(t, known)]
            taken = batch.select(batch.schema.names[:-1]).take(pa.array([i for i, _, _ in found], pa.int64()))
            rows = [(at, f.n_lines, f.license, f.nearest, f.plain_bytes, f.with_bytes, f.n_edits, list(f.differences), f.verdict) for _, at, f in found]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(answer)
            made = [pa.array(list(c), f.type) for c, f in zip(columns, answer, strict=True)]
            yield pa.RecordBatch.from_arrays([*taken.columns, *made], names=[*taken.schema.names, *answer.names])

    fields = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys)
    more = "line_no int, n_lines int, license string, nearest string, plain_bytes bigint, with_bytes bigint, n_edits int, differences array<string>, verdict string"
    return candidates(docs, keys, text).mapInArrow(run, f"{fields}, {more}")
