"""Best-fit packing of token pieces into sequences, refined by swap-based local search.

``tokenize`` turns documents into pieces of at most ``capacity`` tokens; only longer documents are cut.
``pack`` gives every piece a sequence and a place.  Pieces are dealt to shards of bounded size at random
(a hash of their row number, so equal or hot keys spread); each shard packs best-fit decreasing and then
searches: a bin gives up documents one for one, two for one or by a move whenever that raises the sum of
squared fills, until low bins are empty and go.  Bins that stay underfull are taken apart, and their pieces
are dealt anew with those of other shards; once that saves no bin, only the lowest bin of each shard is, until one
shard holds what is left.

No step sees more than one shard of pieces, and only lengths are looked at; shards are balanced whatever
the keys.  The result says nothing about which documents share a sequence, only that they fit.

Defined cases: a null or empty text is one piece that holds the end token alone; rows that repeat are
packed one by one; an empty table gives an empty result; other columns of the pieces are carried along,
``sequence_id``, ``offset`` and names that start with ``_pack_`` are refused.
"""

from __future__ import annotations

import json
from array import array
from bisect import bisect_right, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleweave.llm.bpe import byte_letters
from ruleweave.llm.common import cut, slices

CAPACITY = 1024
END_TOKEN = 2
#: Pieces a shard holds about; one task packs one shard at a time.
SHARD = 4096
#: A bin this full is not taken apart for the next round.
FULL_ENOUGH = 0.998
#: Underfull bins among which the local search looks for a step at a time; the windows overlap by half.
WINDOW = 64


# ---- tokens ---------------------------------------------------------------------------------------


class ByteTokenizer:
    """Encoder for a byte-level vocabulary file; an added token's string in a text becomes that token."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        self.added = {t["content"]: t["id"] for t in said["added_tokens"]}
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        ranks = {bytes(byte_of[c] for c in t): i for t, i in said["model"]["vocab"].items() if t not in self.added}
        # Fixed value: the published pattern of byte-level vocabularies.
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.plain = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens=self.added)

    def encode(self, text: str) -> list[int]:
        return self.plain.encode(text, allowed_special="all")


@lru_cache(maxsize=2)
def byte_tokenizer(path: str) -> ByteTokenizer:
    return ByteTokenizer(path)


def cut_points(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens; the first piece takes the remainder."""
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def tokenize(docs: DataFrame, path: str, keys: tuple[str, ...] = ("doc_id",), text: str = "text", capacity: int = CAPACITY, end: int = END_TOKEN) -> DataFrame:
    """keys, piece, start, length and ids (little-endian unsigned 32-bit numbers) of all pieces of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = byte_tokenizer(path)
        for batch in slices(batches):
            row, piece, start, length, ids = [], [], [], [], []
            for r, text in enumerate(batch.column("_text").to_pylist()):
                found = array("I", t.encode(text or ""))
                found.append(end)
                for k, (s, n) in enumerate(cut_points(len(found), capacity)):
                    row.append(r)
                    piece.append(k)
                    start.append(s)
                    length.append(n)
                    ids.append(found[s : s + n].tobytes())
            taken = batch.select(batch.schema.names[:-1]).take(pa.array(row, pa.int64()))
            made = [pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays([*taken.columns, *made], names=[*taken.schema.names, "piece", "start", "length", "ids"])

    fields = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys)
    return docs.select(*keys, F.col(text).alias("_text")).mapInArrow(run, f"{fields}, piece int, start bigint, length bigint, ids binary")


# ---- one shard ------------------------------------------------------------------------------------


class Bins:
    """Bins of one shard; each holds item numbers, and fill is the sum of their sizes."""

    def __init__(self, sizes: list[int], capacity: int):
        self.sizes, self.capacity = sizes, capacity
        self.items: list[list[int]] = []
        self.fill: list[int] = []

    def best_fit(self) -> None:
        """Longest first, each into the fullest bin that takes it."""
        rooms: list[tuple[int, int]] = []  # (room, bin), ascending
        for item in sorted(range(len(self.sizes)), key=lambda i: (-self.sizes[i], i)):
            size = self.sizes[item]
            at = bisect_right(rooms, (size, -1))
            if at < len(rooms):
                room, b = rooms.pop(at)
                self.items[b].append(item)
                self.fill[b] += size
            else:
                b, room = len(self.items), self.capacity
                self.items.append([item])
                self.fill.append(size)
            if room > size:
                insort(rooms, (room - size, b))

    def _place(self, a: int, b: int, given: tuple[int, ...], taken: tuple[int, ...]) -> None:
        """Bin a gives items to bin b and takes others back."""
        for i in given:
            self.items[a].remove(i)
        for i in taken:
            self.items[b].remove(i)
        self.items[a] += taken
        self.items[b] += given
        moved = sum(self.sizes[i] for i in given) - sum(self.sizes[i] for i in taken)
        self.fill[a] -= moved
        self.fill[b] += moved

    def _better(self, a: int, b: int) -> bool:
        """The step that raises squared fill most by sending tokens from a to the fuller b; whether there is one."""
        room, best, step = self.capacity - self.fill[b], 0, None
        sizes = self.sizes
        in_a = {sizes[i]: i for i in self.items[a]}
        in_b = {sizes[i]: i for i in self.items[b]}
        b_sorted = sorted(in_b)
        for size, i in in_a.items():
            if best < size <= room:  # move
                best, step = size, ((i,), ())
            at = bisect_right(b_sorted, size - best - 1)  # one for one: gain size - other, over best and within room
            while at:
                other = b_sorted[at - 1]
                if size - other > room:
                    break
                best, step = size - other, ((i,), (in_b[other],))
                at -= 1
        own = sorted(self.items[a], key=lambda i: sizes[i])
        for x in range(len(own)):  # two for one
            for y in range(x + 1, len(own)):
                two = sizes[own[x]] + sizes[own[y]]
                at = bisect_right(b_sorted, two - best - 1)
                while at:
                    other = b_sorted[at - 1]
                    if two - other > room:
                        break
                    best, step = two - other, ((own[x], own[y]), (in_b[other],))
                    at -= 1
        if step is None or self.fill[b] + best < self.fill[a]:
            return False
        self._place(a, b, *step)
        return True

    def search(self) -> None:
        """Empties low bins into fuller ones while squared fill rises, WINDOW underfull bins of neighbouring fill at a time.

        Every step raises the sum of squared fills, so it ends by itself: with a walk over all windows that gains nothing.
        """
        gained = True
        while gained:
            gained = False
            underfull = [b for b in range(len(self.items)) if self.items[b] and self.fill[b] < FULL_ENOUGH * self.capacity]
            underfull.sort(key=lambda b: (self.fill[b], b))
            for at in range(0, max(1, len(underfull) - WINDOW // 2), WINDOW // 2):
                low = sorted((b for b in underfull[at : at + WINDOW] if self.items[b]), key=lambda b: (self.fill[b], b))
                for k, a in enumerate(low):
                    for b in reversed(low[k + 1 :]):
                        while self.items[a] and self.fill[b] < self.capacity and self.fill[b] >= self.fill[a] and self._better(a, b):
                            gained = True
                        if not self.items[a]:
                            break


def pack_sizes(sizes: list[int], capacity: int = CAPACITY) -> tuple[list[int], list[int], list[int]]:
    """Of each item: its bin, its offset there and the bin's fill."""
    bins = Bins(sizes, capacity)
    bins.best_fit()
    bins.search()
    bin_of, offset, fill = [0] * len(sizes), [0] * len(sizes), [0] * len(sizes)
    for b, items in enumerate(bins.items):
        at = 0
        for i in sorted(items):
            bin_of[i], offset[i], fill[i] = b, at, bins.fill[b]
            at += sizes[i]
    return bin_of, offset, fill


# ---- all pieces -----------------------------------------------------------------------------------


def _round(pieces: DataFrame, shards: int, number: int, capacity: int) -> DataFrame:
    """Deals the pieces to shards and packs each."""
    spread = F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(number)), F.lit(shards))
    dealt = pieces.withColumn("_pack_shard", spread)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        bin_of, offset, fill = pack_sizes(pdf["length"].tolist(), capacity)
        shard = int(pdf["_pack_shard"].iloc[0])
        pdf["sequence_id"] = np.asarray(bin_of, dtype=np.int64) + (number << 56) + (shard << 20)
        pdf["offset"] = np.asarray(offset, dtype=np.int64)
        pdf["_pack_full"] = np.asarray(fill) >= FULL_ENOUGH * capacity
        pdf["_pack_lowest"] = np.asarray(bin_of) == bin_of[int(np.argmin(fill))]
        return pdf.drop(columns="_pack_shard")

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return dealt.groupBy("_pack_shard").applyInPandas(run, f"{fields}, sequence_id bigint, offset bigint, _pack_full boolean, _pack_lowest boolean")


def pack(pieces: DataFrame, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """pieces with sequence_id and offset. pieces should be read from files, as it is read several times.

    Leave token columns out of pieces: rows travel to their shards.
    """
    own = pieces.columns
    reserved = [c for c in own if c.startswith("_pack_") or c in ("sequence_id", "offset")]
    if reserved:
        raise ValueError(f"reserved column names: {reserved}")
    whole = pieces.filter(F.col("length") == capacity).withColumns(
        {"sequence_id": F.monotonically_increasing_id().bitwiseOR(F.lit(1 << 62)), "offset": F.lit(0).cast("long")}
    )
    out = whole
    rest, number, bins_before = pieces.filter(F.col("length") < capacity), 0, None
    left = rest.count()
    while left:
        number += 1
        shards = -(-left // shard)
        packed = cut(_round(rest, shards, number, capacity), "packing")
        if shards == 1:
            return out.unionByName(packed.select(*own, "sequence_id", "offset"))
        bins = packed.select("sequence_id").distinct().count()
        saved = bins_before is None or bins < bins_before
        again = ~F.col("_pack_full") if saved else F.col("_pack_lowest")  # each shard's lowest bin, until one shard holds them
        out = out.unionByName(packed.filter(~again).select(*own, "sequence_id", "offset"))
        rest = packed.filter(again)
        bins_before = rest.select("sequence_id").distinct().count()
        rest = rest.select(*own)
        left = rest.count()
    return out


def sequences(pieces: DataFrame, packed: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The packed token sequences: sequence_id, ids and the lengths of the pieces inside, in order.

    keys and piece must name a piece; a sequence holds at most ``capacity`` tokens, so a group is bounded.
    """
    placed = packed.select(*keys, "piece", "sequence_id", "offset").join(pieces.select(*keys, "piece", "length", "ids"), [*keys, "piece"])
    ordered = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    grouped = placed.groupBy("sequence_id").agg(ordered.alias("p"))
    joined = F.aggregate("p", F.lit(b""), lambda acc, x: F.concat(acc, x["ids"]))
    return grouped.select("sequence_id", joined.alias("ids"), F.transform("p", lambda x: x["length"]).alias("lengths"))
