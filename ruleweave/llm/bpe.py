"""BPE encoding by forced-boundary splitting, and decoding.

Two adjacent bytes that are next to each other inside no vocabulary token can never end up in one token,
so a word is certain to be cut between them.  ``Codec`` finds these pairs once from the vocabulary, cuts
every word there, encodes the fragments independently by their merges and puts the ids together.

The tokenizer file says how a text becomes words (its normalizer, its added tokens, its pre-tokenizer);
those steps are the library's, called with the file's own settings.  Where neither of the two can look over a
space or a line feed, texts are cut there first.  A worker encodes the pieces, words and fragments it has not seen
yet many at a time and remembers the others, in stores of bounded size.

Defined cases: a null text is an empty one and has no ids; an added token's string in a text becomes that
token, as the library does by default (the leftmost, the longest of several there); rows that repeat are
encoded one by one; an empty table gives an empty result; other input columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleweave.llm.common import slices

#: Pieces, words and fragments that a worker remembers, each at about 300 bytes: some 180 MB in all.
CACHED = 200_000
#: The letters that stand for bytes have numbers below this.
LETTERS = 512
#: Longer pieces are encoded anew in each batch.
LONGEST_CACHED = 64
#: Characters of texts that are taken apart at a time.
WINDOW = 1_000_000


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = [b for b in range(256) if b not in set(plain)]
    return [chr(b) if b in set(plain) else chr(256 + moved.index(b)) for b in range(256)]


class Codec:
    """Encoder and decoder for one tokenizer file."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer, models, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        model = said["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        self.inner = Tokenizer(models.BPE(self.vocab, merges))
        self.last = Tokenizer(models.BPE(self.vocab, merges, end_of_word_suffix=self.suffix)) if self.suffix else self.inner
        self.inner.pre_tokenizer = self.last.pre_tokenizer = pre_tokenizers.WhitespaceSplit()  # one fragment from the next
        library = Tokenizer.from_file(path)
        self.normalizer, self.plain_decoder = library.normalizer, library.decoder is None
        self.pattern = regex.compile(self._pattern(said["pre_tokenizer"]))
        self.pattern_or_blank = regex.compile(" |" + self._pattern(said["pre_tokenizer"]))
        self.added = {t["content"]: t["id"] for t in said["added_tokens"]}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if self.added else None
        self.cut_at_blanks = self._blanks_part(said)
        self.inside = self._inside()
        self.inside_at = np.zeros(LETTERS * LETTERS, dtype=bool)
        self.inside_at[[ord(p[0]) * LETTERS + ord(p[1]) for p in self.inside]] = True
        self.letters = byte_letters()
        byte_of = {c: b for b, c in enumerate(self.letters)}
        self.surface = {i: self._surface(t, byte_of) for t, i in self.vocab.items()}
        self.surface.update({i: t.encode() for t, i in self.added.items()})
        self.joint = b" " if self.plain_decoder else b""
        self.fragments: dict[tuple[str, bool], tuple[bytes, bytes]] = {}
        self.words: dict[str, tuple[bytes, bytes]] = {}
        self.pieces: dict[str, tuple[bytes, bytes]] = {}

    def _blanks_part(self, said: dict) -> bool:
        """Whether spaces and line feeds reach no token and part a text for certain.

        Known for files whose words hold no white space, whose normalizer does nothing but composing (a blank
        composes with nothing), lowering letters and making white space one space, and whose added tokens have no blank.
        """
        # The normalizer steps that treat the two sides of a blank independently.
        known = ({"type": "NFC"}, {"type": "Lowercase"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "})
        steps = (said["normalizer"] or {}).get("normalizers", [said["normalizer"]] if said["normalizer"] else [])
        split = [x for x in said["pre_tokenizer"].get("pretokenizers", []) if x["type"] == "Split"]
        drops = len(split) == 1 and split[0]["invert"] and split[0]["behavior"] == "Removed" and self.pattern.findall(" \n \n") == []
        return drops and all(x in known for x in steps) and not any(set(" \n") & set(t) for t in self.added)

    @staticmethod
    def _pattern(pre: dict) -> str:
        """The pattern whose matches are the words: the file's own, or that of byte-level files."""
        for step in pre.get("pretokenizers", []):
            if step["type"] == "Split":
                return step["pattern"]["Regex"]
        # Fixed value: the published pattern of byte-level vocabularies.
        return r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def _bare(self, token: str) -> str:
        return token[: -len(self.suffix)] if self.suffix and token.endswith(self.suffix) else token

    def _inside(self) -> set[str]:
        """Pairs of adjacent letters that occur inside at least one token."""
        return {bare[i : i + 2] for t in self.vocab if t not in self.added for bare in [self._bare(t)] for i in range(len(bare) - 1)}

    def _surface(self, token: str, letters: dict[str, int]) -> bytes:
        """What a token decodes to where the file names no decoder: its letters as they stand."""
        if self.plain_decoder:
            return token.encode()
        return bytes(letters[c] for c in token)

    def split(self, word: str) -> list[str]:
        """The word's fragments between forced boundaries."""
        cuts = [i for i in range(1, len(word)) if word[i - 1 : i + 1] not in self.inside]
        return [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)], strict=True)]

    def _learn_fragments(self, wanted: set[tuple[str, bool]]) -> None:
        """Each fragment's ids, merged on its own, and what they decode to; the flag says that it ends its word."""
        for model, flag in ((self.inner, False), (self.last, True)):
            own = [f for f, last in wanted if last == flag]
            for at in range(0, len(own), 10_000):
                part = own[at : at + 10_000]
                found = model.encode(" ".join(part), add_special_tokens=False)
                ids = np.array(found.ids, dtype="<u4")
                ends = np.searchsorted(np.array(found.word_ids, dtype=np.int64), np.arange(len(part)), side="right").tolist()
                raw, surface, start = ids.tobytes(), [self.surface[i] for i in found.ids], 0
                for fragment, end in zip(part, ends, strict=True):
                    self.fragments[fragment, flag] = raw[4 * start : 4 * end], self.joint.join(surface[start:end])
                    start = end

    def _joined(self, parts: list[tuple[bytes, bytes]]) -> tuple[bytes, bytes]:
        """Ids, and what they decode to, of one thing after another."""
        if len(parts) == 1:
            return parts[0]
        return b"".join([i for i, _ in parts]), self.joint.join([d for i, d in parts if i])

    def _learn_words(self, wanted: list[str]) -> None:
        """Ids of pre-tokens, fragment by fragment, and what they decode to."""
        letters = self.letters
        plain = [w if w.isascii() and w.isprintable() and " " not in w else "".join([letters[b] for b in w.encode()]) for w in wanted]
        line = " ".join(plain)
        at = np.frombuffer(line.encode("utf-16-le"), dtype="<u2").astype(np.int32)
        cuts = np.flatnonzero(~self.inside_at[at[:-1] * LETTERS + at[1:]]) + 1  # on both sides of each blank, and at forced boundaries
        borders = [0, *cuts.tolist(), len(line)]
        fragments, known, own = [line[a:b] for a, b in zip(borders, borders[1:], strict=False)], self.fragments, [[]]
        for f, after in zip(fragments, [*fragments[1:], " "], strict=True):
            if f == " ":
                own.append([])
            else:
                own[-1].append((f, after == " "))
        self._learn_fragments({f for fs in own for f in fs if f not in known})
        for word, fs in zip(wanted, own, strict=True):
            self.words[word] = known[fs[0]] if len(fs) == 1 else self._joined([known[f] for f in fs])

    def _parted(self, text: str) -> list[str | int]:
        """Words of a text, and the ids of the added tokens in it."""
        out: list[str | int] = []
        for k, part in enumerate(self.special.split(text) if self.special else [text]):  # every second part is an added token
            if k % 2:
                out.append(self.added[part])
            elif part:
                out += self.pattern.findall(self.normalizer.normalize_str(part) if self.normalizer else part)
        return out

    def _together(self, pieces: list[str]) -> dict[str, list[str | int]]:
        """Words of pieces without blanks and added tokens, found in one go over all of them."""
        out: list[list[str | int]] = [[]]
        joined = " ".join(pieces)
        for word in self.pattern_or_blank.findall(self.normalizer.normalize_str(joined) if self.normalizer else joined):
            if word == " ":
                out.append([])
            else:
                out[-1].append(word)
        return dict(zip(pieces, out, strict=True))

    def _learn(self, wanted: list[str]) -> None:
        """Ids of pieces as little-endian unsigned 32-bit numbers, and the bytes they decode to."""
        plain: list[str] = []
        if self.cut_at_blanks:
            every = "".join(wanted)
            simple = every.isprintable() and not any(t in every for t in self.added)
            plain = wanted if simple else [p for p in wanted if p.isprintable() and not any(t in p for t in self.added)]
        parts = self._together(plain) if plain else {}
        if len(plain) < len(wanted):
            parts.update((p, self._parted(p)) for p in wanted if p not in parts)
        known, pieces = self.words, self.pieces
        if words := list({w for ws in parts.values() for w in ws if w.__class__ is str and w not in known}):
            self._learn_words(words)
        for piece, words in parts.items():
            if len(words) == 1 and words[0] in known:
                pieces[piece] = known[words[0]]
            else:
                pieces[piece] = self._joined([known[w] if w.__class__ is str else (w.to_bytes(4, "little"), self.surface[w]) for w in words])

    def _windows(self, text: str) -> Iterator[list[str]]:
        """The text's pieces, those of about WINDOW characters at a time."""
        if not self.cut_at_blanks:
            yield [text] if text else []
            return
        text, at = text.replace("\n", " "), 0
        while at < len(text):
            end = text.find(" ", at + WINDOW)
            end = end if end >= 0 else len(text)
            yield [p for p in text[at:end].split(" ") if p]
            at = end

    def round_trips(self, texts: list[str | None]) -> Iterator[tuple[bytes, bytes]]:
        """For each text its ids as little-endian unsigned 32-bit numbers, and the UTF-8 text they decode to."""
        held: list[list[str]] = []
        size = 0

        def flush() -> list[tuple[bytes, bytes]]:
            for store in (self.pieces, self.words, self.fragments):
                if len(store) > CACHED:
                    store.clear()
            known, out = self.pieces, []
            fresh = list({p for ps in held for p in ps if p not in known})
            if fresh:
                self._learn(fresh)
            for ps in held:
                out.append(self._joined([known[p] for p in ps]))
            for p in fresh:
                if len(p) > LONGEST_CACHED:
                    del known[p]
            held.clear()
            return out

        finish = lambda d: d if self.plain_decoder else d.decode("utf-8", "replace").encode()
        for text in texts:
            if len(text or "") > WINDOW:
                yield from ((i, finish(d)) for i, d in flush())
                size, ids, decoded = 0, [], []
                for window in self._windows(text):
                    held.append(window)
                    i, d = flush()[0]
                    ids.append(i)
                    decoded.append(d)
                yield b"".join(ids), finish(self.joint.join([d for i, d in zip(ids, decoded, strict=True) if i]))
                continue
            held.extend(self._windows(text) if text else [[]])
            size += len(text or "")
            if size > WINDOW:
                yield from ((i, finish(d)) for i, d in flush())
                size = 0
        yield from ((i, finish(d)) for i, d in flush())

    def encode(self, text: str | None) -> array:
        """Ids of a text as unsigned 32-bit numbers."""
        ids = array("I")
        ids.frombytes(next(self.round_trips([text]))[0])
        return ids

    def decode(self, ids) -> str:
        """The text of ids, added tokens included."""
        return self.joint.join([self.surface[i] for i in ids]).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def _mapped(docs: DataFrame, path: str, keys: tuple[str, ...], text: str, columns: str, made) -> DataFrame:
    """keys and the columns that made gives of (ids, decoded) of every row's text."""
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in slices(batches):
            found = made(list(c.round_trips(batch.column("_text").to_pylist())))
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*kept, *found], names=[*batch.schema.names[:-1], *names])

    fields = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys)
    return docs.select(*keys, F.col(text).alias("_text")).mapInArrow(run, f"{fields}, {columns}")


def encode_texts(docs: DataFrame, path: str, keys: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """keys, ids (little-endian unsigned 32-bit numbers, as binary) and decoded of every row of docs."""
    made = lambda found: [pa.array([i for i, _ in found], pa.binary()), pa.array([d.decode() for _, d in found], pa.string())]
    return _mapped(docs, path, keys, text, "ids binary, decoded string", made)


def digests(docs: DataFrame, path: str, keys: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """keys, n_tokens, ids_sha256 and decoded_sha256 of every row of docs; ids and texts stay in the worker that made them."""

    def made(found: list[tuple[bytes, bytes]]) -> list[pa.Array]:
        digest = lambda k: pa.array([hashlib.sha256(f[k]).hexdigest() for f in found], pa.string())
        return [pa.array([len(i) // 4 for i, _ in found], pa.int64()), digest(0), digest(1)]

    return _mapped(docs, path, keys, text, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", made)
