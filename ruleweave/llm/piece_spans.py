"""SentencePiece encoding that keeps offsets, and decoding.

A text is normalised by the longest prefix at each place that the model's compiled character map knows, and every byte
of the normalised text remembers the source byte that it came from. Pieces are then byte pair merges of the
normalised text, and each is projected through that alignment to a span of source bytes: begin is the source place of
its first byte, end that of the byte after its last one. A character without a piece falls back to one piece a byte, of
which the last covers the character and the others are empty spans before it.

A blank follows another character inside no piece (checked when a model is loaded), so texts part there for certain: a
worker merges the words it has not seen yet many at a time and remembers the others, in a store of bounded size. Where
the map is empty and a text is well-formed and without U+2581, the alignment is a sum of piece lengths.

Defined cases: a null text is an empty one and has no pieces; bytes that aren't UTF-8 become U+FFFD one by one; control
pieces' strings in a text are ordinary text; rows that repeat are encoded one by one; an empty table gives an empty
result; other input columns are not read, so their names can't clash. Models with other merges than byte pairs, without
byte fallback or with user-defined or unused pieces are refused.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleweave.llm.common import slices

#: Words that a worker remembers, each at about 400 bytes: some 120 MB.
CACHED = 300_000
#: Longer fragments are merged one by one with a heap, and not remembered.
TOGETHER = 64
#: Bytes of a text that are taken apart at a time.
WINDOW = 1_000_000
BLANK = "▁".encode()
BAD = "�".encode()
#: Above every rank of a piece.
NEVER = np.int64(1 << 40)
# Field numbers and piece types of the published model format.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
BYTE_PAIRS = 2

codecs.register_error("ruleweave-each-byte", lambda e: ("�", e.start + 1))


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a serialised message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(raw):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(kind) or number()
        yield key >> 3, raw[at : at + size]
        at += size


class CharacterMap:
    """The compiled map of a normalizer: a double-array trie of source strings and what replaces them."""

    def __init__(self, compiled: bytes):
        size = struct.unpack_from("<I", compiled)[0] if compiled else 0
        self.units = np.frombuffer(compiled, "<u4", size // 4, 4).tolist() if size else []
        self.strings = compiled[4 + size :] if size else b""

    def longest(self, raw: bytes, at: int) -> tuple[bytes, int]:
        """What replaces the longest known prefix of raw from at, and its length; length 0 where none is known."""
        units, found, node = self.units, (b"", 0), 0
        if not units:
            return found
        offset = lambda u: (u >> 10) << ((u & 0x200) >> 6)
        node ^= offset(units[0])
        for end in range(at, len(raw)):
            c = raw[end]
            node ^= c
            if node >= len(units) or units[node] & 0x800000FF != c:
                break
            unit = units[node]
            node ^= offset(unit)
            if unit >> 8 & 1:
                start = units[node] & 0x7FFFFFFF
                found = self.strings[start : self.strings.index(b"\0", start)], end + 1 - at
        return found


class Normalizer:
    """Normalised bytes of a text, and the source place of each of them and of the end."""

    def __init__(self, spec: dict):
        self.map = CharacterMap(spec.get(2, b""))
        self.prefix, self.squeeze, escape = (bool(spec.get(k, 1)) for k in (3, 4, 5))
        self.blank = BLANK if escape else b" "
        #: Nothing but blanks changes, in a well-formed text.
        self.identity = not self.map.units and not self.squeeze and self.prefix and escape

    def _step(self, raw: bytes, at: int) -> tuple[bytes, int]:
        new, size = self.map.longest(raw, at)
        if size:
            return new, size
        lead = raw[at]
        size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        one = raw[at : at + size]
        try:
            one.decode()
        except UnicodeDecodeError:
            return BAD, 1
        return one, size

    def aligned(self, raw: bytes) -> tuple[bytes, np.ndarray]:
        out, places, at = bytearray(), [], 0

        def put(piece: bytes) -> None:
            out.extend(piece)
            places.extend([at] * len(piece))

        if self.squeeze:
            while at < len(raw) and (step := self._step(raw, at))[0] == b" ":
                at += step[1]
        if at >= len(raw):
            return b"", np.zeros(1, np.int64)
        if self.prefix:
            put(self.blank)
        after_blank = self.squeeze
        while at < len(raw):
            new, size = self._step(raw, at)
            if after_blank:
                new = new.lstrip(b" ")
            if new:
                put(new.replace(b" ", self.blank))
                after_blank = self.squeeze and new.endswith(b" ")
            at += size
        if self.squeeze:
            while out.endswith(self.blank):
                at = places[len(out) - len(self.blank)]
                del out[-len(self.blank) :], places[-len(self.blank) :]
        return bytes(out), np.array([*places, at], np.int64)


class Pieces:
    """Encoder and decoder for one model file. In what it merges, a space stands for U+2581."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            parts = list(_fields(f.read()))
        said = [dict(_fields(v)) for k, v in parts if k == PIECES]
        trainer = next((dict(_fields(v)) for k, v in parts if k == TRAINER), {})
        self.normalizer = Normalizer(next((dict(_fields(v)) for k, v in parts if k == NORMALIZER), {}))
        kinds = [p.get(3, NORMAL) for p in said]
        if trainer.get(3) != BYTE_PAIRS or kinds.count(BYTE) != 256 or set(kinds) - {NORMAL, UNKNOWN, CONTROL, BYTE} or self.normalizer.blank != BLANK:
            raise ValueError("needs a byte pair model with byte fallback, escaped blanks and no user-defined or unused pieces")
        own = {p[1]: i for i, p in enumerate(said) if kinds[i] == NORMAL}
        self.byte_id = {int(p[1][3:5], 16): i for i, p in enumerate(said) if kinds[i] == BYTE}
        self.surface = [b"" if k == CONTROL else trainer.get(44, b" \xe2\x81\x87 ") if k == UNKNOWN else b"" if k == BYTE else p[1].replace(BLANK, b" ") for p, k in zip(said, kinds, strict=True)]
        for b, i in self.byte_id.items():
            self.surface[i] = bytes([b])
        self.bytes = set(self.byte_id.values())
        self.plain = {i for i, k in enumerate(kinds) if k == NORMAL}
        self.decimal = [b"%d" % i for i in range(len(said))]
        #: Bytes that a piece has more in the normalised text than in its surface.
        self.more = np.array([2 * p[1].count(BLANK) if k == NORMAL else 0 for p, k in zip(said, kinds, strict=True)], np.int64)
        self.sizes = np.array([len(p[1]) for p in said], "<u4")
        spelled = {s.decode().replace("▁", " "): i for s, i in own.items()}
        parted = all(" " not in s.lstrip(" ") for s in spelled)
        lone = not any("\n" in s for s in spelled)  # a line feed is in no piece, so it parts words as well
        self.fragment = re.compile(rb"(?s).+" if not parted else rb" +[^ \n]*|[^ \n]+|\n" if lone else rb" +[^ ]*|[^ ]+")
        #: Numbers of characters: those of their pieces, then others that occur inside pieces only.
        self.number = {s: i for s, i in spelled.items() if len(s) == 1}
        for c in sorted({c for s in spelled for c in s} - set(self.number)):
            self.number[c] = len(said) + len(self.number)
        for b, i in self.byte_id.items():  # a byte that is a character is its own piece
            self.sizes[i] = 1
            if b < 0x80:
                self.number.setdefault(chr(b), i)
        score = {i: struct.unpack("<f", said[i].get(2, b"\0\0\0\0"))[0] for i in own.values()}
        order = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        self.rank = np.full(len(said) + 1, NEVER)
        for i, s in score.items():
            self.rank[i] = order[s]
        symbols = {**spelled, **self.number}
        pairs = {}
        for s, i in spelled.items():
            for k in range(1, len(s)):
                if s[:k] in symbols and s[k:] in symbols:
                    pairs[symbols[s[:k]] << 32 | symbols[s[k:]]] = i
        self.pairs = pairs
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ids = np.array([pairs[k] for k in self.pair_keys.tolist()] + [len(said)], np.int64)
        self.unknown = np.int64(len(said) + len(self.number) + 1)
        self.number_at = np.full(max(map(ord, self.number)) + 1, self.unknown)
        for c, i in self.number.items():
            self.number_at[ord(c)] = i
        #: fragment: (number of ids, ids joined by commas, ids, their bytes in the normalised text, surface)
        self.known: dict[bytes, tuple[int, bytes, bytes, bytes, bytes]] = {}

    # merging

    def _merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece of each two neighbours, or the number after the last piece."""
        key = left << 32 | right
        at = np.searchsorted(self.pair_keys, key)
        at[at == len(self.pair_keys)] = 0
        return self.pair_ids[np.where(self.pair_keys[at] == key, at, len(self.pair_keys))]

    def _merge_together(self, words: list[str]) -> tuple[np.ndarray, list[int]]:
        """Symbols of the words after all merges, and where each word's begin: best score first, then leftmost."""
        points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        sym = np.where(points < len(self.number_at), self.number_at[np.minimum(points, len(self.number_at) - 1)], self.unknown)
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        last = np.append(word[1:] != word[:-1], True)
        joint = np.where(last, len(self.rank) - 1, self._merged(sym, np.append(sym[1:], 0)))
        ended = []
        while len(sym):
            rank = self.rank[joint]
            starts = np.flatnonzero(np.insert(word[1:] != word[:-1], 0, True))
            best = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(sym))))
            done = best == NEVER
            if done.any():
                ended.append((word[done], sym[done]))
                rank, best, sym, word, joint = (x[~done] for x in (rank, best, sym, word, joint))
            at = np.flatnonzero(rank == best)
            if not len(at):
                continue
            at = at[np.insert(word[at][1:] != word[at][:-1], 0, True)]
            sym[at] = joint[at]
            stays = np.ones(len(sym), bool)
            stays[at + 1] = False
            now = at - np.arange(len(at))  # one symbol before it went for each earlier merge
            sym, word, joint = sym[stays], word[stays], joint[stays]
            for place in (now, now - 1):  # the pairs that the new symbol is in
                place = place[(place >= 0)]
                after = np.minimum(place + 1, len(sym) - 1)
                meet = (after > place) & (word[after] == word[place])
                joint[place] = np.where(meet, self._merged(sym[place], sym[after]), len(self.rank) - 1)
        word, sym = np.concatenate([w for w, _ in ended]), np.concatenate([s for _, s in ended])
        order = np.argsort(word, kind="stable")
        return sym[order], np.searchsorted(word[order], np.arange(len(words) + 1)).tolist()

    def _merge_long(self, text: str) -> list[int]:
        """The same merges of one long fragment, by a heap of neighbours."""
        sym = [self.number.get(c, int(self.unknown)) for c in text]
        after, before, heap = list(range(1, len(sym) + 1)), list(range(-1, len(sym) - 1)), []

        def offer(a: int) -> None:
            if a >= 0 and after[a] < len(sym):
                joint = self.pairs.get(sym[a] << 32 | sym[after[a]])
                if joint is not None:
                    heapq.heappush(heap, (int(self.rank[joint]), a, joint, sym[a], sym[after[a]]))

        for a in range(len(sym) - 1):
            offer(a)
        while heap:
            _, a, joint, left, right = heapq.heappop(heap)
            b = after[a]
            if sym[a] != left or b >= len(sym) or sym[b] != right:
                continue
            sym[a], sym[b], after[a] = joint, -1, after[b]
            if after[b] < len(sym):
                before[after[b]] = a
            offer(a)
            offer(before[a])
        return [s for s in sym if s >= 0]

    def _spelled(self, text: str, symbols: list[int]) -> tuple[list[int], list[int]]:
        """ids and their bytes: of a character without a piece one id a byte, of which the last has its length."""
        ids, sizes, at = [], [], 0
        for s in symbols:
            if s < len(self.decimal):
                ids.append(s)
                sizes.append(int(self.sizes[s]))
                at += len(self.surface[s].decode())
            else:
                raw = text[at].encode()
                ids += [self.byte_id[b] for b in raw]
                sizes += [*[0] * (len(raw) - 1), len(raw)]
                at += 1
        return ids, sizes

    def _keep(self, fragments: list[bytes], ids: np.ndarray, sizes: np.ndarray, bounds: list[int]) -> None:
        """Remember what the fragments become; the ids of each lie between its bounds."""
        raw_ids, raw_sizes, flat, known = ids.astype("<u4").tobytes(), sizes.astype("<u4").tobytes(), ids.tolist(), self.known
        decimals, surfaces = [self.decimal[i] for i in flat], [self.surface[i] for i in flat]
        for f, a, b in zip(fragments, bounds, bounds[1:], strict=False):
            if b - a == 1:
                known[f] = 1, decimals[a], raw_ids[4 * a : 4 * b], raw_sizes[4 * a : 4 * b], surfaces[a]
            else:
                known[f] = b - a, b",".join(decimals[a:b]), raw_ids[4 * a : 4 * b], raw_sizes[4 * a : 4 * b], b"".join(surfaces[a:b])

    def _learn(self, fragments: list[bytes]) -> None:
        short = [f for f in fragments if len(f) <= TOGETHER]
        for at in range(0, len(short), 20_000):
            own = short[at : at + 20_000]
            words = [f.decode() for f in own]
            symbols, bounds = self._merge_together(words)
            odd = symbols >= len(self.decimal)
            self._keep(own, np.where(odd, 0, symbols), self.sizes[np.where(odd, 0, symbols)], bounds)
            for k in np.unique(np.searchsorted(bounds, np.flatnonzero(odd), side="right") - 1).tolist():
                ids, sizes = self._spelled(words[k], symbols[bounds[k] : bounds[k + 1]].tolist())
                self._keep([own[k]], np.array(ids), np.array(sizes), [0, len(ids)])
        for f in fragments:
            if len(f) > TOGETHER:
                ids, sizes = self._spelled(f.decode(), self._merge_long(f.decode()))
                self._keep([f], np.array(ids), np.array(sizes), [0, len(ids)])

    # whole texts

    def _windows(self, raw: bytes) -> tuple[Iterator[list[bytes]], np.ndarray | None]:
        """The text's fragments, those of about WINDOW bytes at a time, and the alignment where it is no mere sum."""
        if self.normalizer.identity and BLANK not in raw and _well_formed(raw):
            normal, places = b" " + raw if raw else b"", None
        else:
            normal, places = self.normalizer.aligned(raw)
            normal = normal.replace(BLANK, b" ")

        def parts() -> Iterator[list[bytes]]:
            at = 0
            while at < len(normal):
                end = at + WINDOW
                while 0 < (end := normal.find(b" ", end)) and normal[end - 1 : end] == b" ":
                    end += 1
                end = end if end > 0 and self.fragment.pattern.startswith(b" ") else len(normal)
                yield self.fragment.findall(normal[at:end])
                at = end

        return parts(), places

    def encoded(self, texts: list[bytes | None]) -> Iterator[tuple[list[tuple], np.ndarray | None]]:
        """For each text what is known of its fragments in order, and its alignment."""
        held: list[list[bytes]] = []
        size = 0

        def flush() -> list[list[tuple]]:
            known = self.known
            fresh = [f for f in dict.fromkeys(f for fs in held for f in fs) if f not in known]
            if fresh:
                self._learn(fresh)
            out = [[known[f] for f in fs] for fs in held]
            held.clear()
            self._tidy(fresh)
            return out

        for raw in texts:
            raw = raw or b""
            windows, places = self._windows(raw)
            if places is None and len(raw) < WINDOW:
                held.append(next(windows, []))
                size += len(raw)
            else:
                yield from ((found, None) for found in flush())
                size, whole = 0, []
                for fragments in windows:
                    held.append(fragments)
                    whole += flush()[0]
                yield whole, places
            if size > WINDOW:
                yield from ((found, None) for found in flush())
                size = 0
        yield from ((found, None) for found in flush())

    def _tidy(self, fresh: list[bytes]) -> None:
        """Forget long fragments, and everything once the store is full."""
        if len(self.known) > CACHED:
            self.known.clear()
        for f in fresh:
            if len(f) > TOGETHER:
                self.known.pop(f, None)

    def spans(self, found: list[tuple], places: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids of one text and the source bytes, from begin to end, of each."""
        ids = np.frombuffer(b"".join([f[2] for f in found]), "<u4")
        sizes = np.frombuffer(b"".join([f[3] for f in found]), "<u4").astype(np.int64)
        if places is None:
            sizes = sizes - self.more[ids]
            if len(sizes):  # the prefix before the text has no source byte
                sizes[0] -= 1
            ends = np.cumsum(sizes)
            return ids, ends - sizes, ends
        ends = np.cumsum(sizes)
        return ids, places[ends - sizes], places[ends]

    def text_of(self, found: list[tuple]) -> bytes:
        """What the ids of one text decode to: their surfaces without the prefix."""
        said = b"".join([f[4] for f in found])
        return said[1:] if self.normalizer.prefix and said.startswith(b" ") else said

    def decode(self, ids) -> str:
        """The text of any ids: control pieces are silent, bytes that make no character are U+FFFD each."""
        strip, seen = self.normalizer.prefix or self.normalizer.squeeze, False
        out: list[bytes] = []
        run: list[bytes] = []  # bytes one after another, which may make characters together

        def ended() -> None:
            if run:
                out.append(b"".join(run).decode("utf-8", "ruleweave-each-byte").encode())
                run.clear()

        for i in ids:
            said = self.surface[i]
            if i in self.bytes:
                run.append(said)
                continue
            ended()
            if strip and not seen and not out and i in self.plain and said.startswith(b" "):
                seen = not self.normalizer.squeeze
                said = said[1:]
            if said:
                out.append(said)
        ended()
        return b"".join(out).decode()


def _well_formed(raw: bytes) -> bool:
    if raw.isascii():
        return True
    try:
        raw.decode()
    except UnicodeDecodeError:
        return False
    return True


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def _mapped(docs: DataFrame, path: str, keys: tuple[str, ...], text: str, columns: str, made) -> DataFrame:
    """keys and the columns that made gives of the model and each row's (fragments, alignment)."""
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for batch in slices(batches):
            rows = [made(model, found, places) for found, places in model.encoded(batch.column("_text").to_pylist())]
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            types = [f.type for f in out]
            found = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*kept, *found], names=[*batch.schema.names[:-1], *names])

    arrow = {"bigint": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32()), "array<bigint>": pa.list_(pa.int64())}
    out = [pa.field(c.split()[0], arrow[c.split()[1]]) for c in columns.split(", ")]
    fields = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys)
    return docs.select(*keys, F.col(text).cast("binary").alias("_text")).mapInArrow(run, f"{fields}, {columns}")


def encode_spans(docs: DataFrame, path: str, keys: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """keys, ids, begins and ends (source bytes of each id) and decoded of every row of docs."""

    def made(model: Pieces, found: list[tuple], places: np.ndarray | None) -> tuple:
        ids, begins, ends = model.spans(found, places)
        return ids.astype(np.int32), begins, ends, model.text_of(found).decode("utf-8", "ruleweave-each-byte")

    return _mapped(docs, path, keys, text, "ids array<int>, begins array<bigint>, ends array<bigint>, decoded string", made)


def digests(docs: DataFrame, path: str, keys: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """keys, n_tokens, ids_sha256, decoded_sha256 and spans_crc32 of every row of docs.

    spans_crc32 is that of each id's begin and end in turn, as little-endian unsigned 32-bit numbers.
    """

    def made(model: Pieces, found: list[tuple], places: np.ndarray | None) -> tuple:
        ids, begins, ends = model.spans(found, places)
        spans = zlib.crc32(np.column_stack([begins, ends]).astype("<u4").tobytes())
        listed = hashlib.sha256(b",".join([f[1] for f in found])).hexdigest()
        said = model.text_of(found)
        return len(ids), listed, hashlib.sha256(said).hexdigest(), spans

    return _mapped(docs, path, keys, text, "n_tokens bigint, ids_sha256 string, decoded_sha256 string, spans_crc32 bigint", made)
