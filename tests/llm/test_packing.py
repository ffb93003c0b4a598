import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ruleweave.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
HARD = ["", None, "<|endoftext|> x<|endoftext|>", "İstanbul ½ 中文 😀 don't I'LL \t\n x", "a" * 5000, "\x00 b\r\n\r\n  c   "]


def test_ids_are_those_of_the_tokenizers_library(spark):
    library = Tokenizer.from_file(PATH)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(HARD)], "doc_id long, text string, piece string")
    got = packing.tokenize(docs.select("doc_id", "text"), PATH).orderBy("doc_id", "piece").collect()
    for i, text in enumerate(HARD):
        mine = [r for r in got if r.doc_id == i]
        ids = library.encode(text or "", add_special_tokens=False).ids + [packing.END_TOKEN]
        assert b"".join(r.ids for r in mine) == b"".join(x.to_bytes(4, "little") for x in ids)
        assert [r.start for r in mine] == [sum(r.length for r in mine[:k]) for k in range(len(mine))]
        assert all(r.length == 1024 for r in mine[1:])


def test_local_search_saves_bins_and_keeps_every_item():
    saved = 0
    for seed in range(6):
        rng = random.Random(seed)
        sizes = [rng.randint(150, 600) for _ in range(400)]
        plain = packing.Bins(sizes, 1024)
        plain.best_fit()
        bin_of, offset, fill = packing.pack_sizes(sizes)
        for b in set(bin_of):
            inside = sorted((offset[i], sizes[i]) for i in range(len(sizes)) if bin_of[i] == b)
            at = 0
            for o, n in inside:
                assert o == at
                at += n
            assert at <= 1024
        saved += len(plain.items) - len(set(bin_of))
    assert saved > 0


def test_one_for_one_two_for_one_and_moves():
    for a, b, emptied in (([3], [5], True), ([5, 2], [6, 1], False), ([2, 2], [5, 3], False)):
        bins = packing.Bins(a + b, 10)
        bins.items, bins.fill = [list(range(len(a))), list(range(len(a), len(a + b)))], [sum(a), sum(b)]
        before = sum(f * f for f in bins.fill)
        assert bins._better(0, 1)
        assert sum(f * f for f in bins.fill) > before and max(bins.fill) <= 10
        assert (not bins.items[0]) == emptied


def test_pack_is_gapless_over_shards_with_copies_and_nulls(spark):
    rng = random.Random(1)
    rows = [(None if i % 3 == 0 else i % 7, rng.choice([1, 1024, rng.randint(1, 1023)]), i) for i in range(600)]
    pieces = spark.createDataFrame(rows, "doc_id long, length long, row int")
    got = packing.pack(packing.cut(pieces, "t"), shard=64).collect()
    assert sorted(r.row for r in got) == list(range(600))
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 1024
    alone = len(set(packing.pack_sizes([r[1] for r in rows])[0]))
    assert len(by) <= alone * 1.01 + 2  # as one shard would do


def test_pack_of_unpackable_and_of_no_pieces(spark):
    same = packing.cut(spark.range(300).select("id", F.lit(600).cast("long").alias("length")), "t")
    assert packing.pack(same, shard=32).select("sequence_id").distinct().count() == 300
    assert packing.pack(packing.cut(same.limit(0), "t")).count() == 0


def test_search_looks_at_all_underfull_bins():
    rng = random.Random(4)
    sizes = [rng.randint(300, 520) for _ in range(600)]  # two or three to a bin, many bins underfull
    bins = packing.Bins(sizes, 1024)
    bins.best_fit()
    before = sum(f * f for f in bins.fill)
    assert sum(f < packing.FULL_ENOUGH * 1024 for f in bins.fill) > packing.WINDOW
    bins.search()
    assert sum(f * f for f in bins.fill) > before and sum(bins.fill) == sum(sizes) and max(bins.fill) <= 1024


def test_reserved_names_are_refused(spark):
    for name in ("_pack_x", "offset"):
        with pytest.raises(ValueError):
            packing.pack(spark.createDataFrame([(1, 2)], f"length long, {name} int"))


def test_sequences_hold_the_tokens_in_order(spark):
    docs = spark.createDataFrame([(i, f"word {i} " * (i % 50)) for i in range(60)], "doc_id long, text string")
    pieces = packing.cut(packing.tokenize(docs, PATH), "t")
    packed = packing.pack(packing.cut(pieces.drop("ids"), "t"))
    whole = packing.sequences(pieces, packed, ("doc_id",)).collect()
    ids = {(r.doc_id, r.piece): r.ids for r in pieces.collect()}
    for s in whole:
        inside = sorted((r.offset, ids[r.doc_id, r.piece]) for r in packed.collect() if r.sequence_id == s.sequence_id)
        assert bytes(s.ids) == b"".join(x for _, x in inside) and sum(s.lengths) * 4 == len(s.ids)
