import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ruleweave.llm import simhash


def brute_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall("[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(codes):
    parent = {c: c for c in codes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    own = list(codes)
    for i, a in enumerate(own):
        for b in own[:i]:
            if (a ^ b).bit_count() <= 2:
                ra, rb = find(a), find(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {c: find(c) for c in own}


def test_fingerprints_equal_the_definition():
    rng = random.Random(0)
    texts = [None, "", " \n", "One", "one TWO", "ÀÉ a b c d", *[" ".join(rng.choices(["a", "b", "Cé", "d,"], k=n)) for n in (3, 4, 17, 5000)]]
    for t in texts:
        assert simhash.fingerprint(t) == brute_fingerprint(t), t


@pytest.mark.parametrize("crowded", [1, 4, 32])
def test_components_equal_brute_force_in_dense_balls(spark, crowded, monkeypatch):
    monkeypatch.setattr(simhash, "PAIRED_GROUP", crowded)
    rng = random.Random(crowded)
    codes = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(50):
            code = centre
            for _ in range(rng.randrange(6)):
                code ^= 1 << rng.randrange(64)
            codes.add(code)
    codes |= {rng.getrandbits(64) for _ in range(100)} | {0, (1 << 64) - 1, 1 << 63}
    signed = {int(np.uint64(c).astype(np.int64)): c for c in codes}
    found = simhash.components(simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long"))).collect()
    want = brute_components(codes)
    groups = {}
    for c, root in want.items():
        groups.setdefault(root, set()).add(c)
    got = {}
    for r in found:
        got.setdefault(r.component, set()).add(signed[r.node])
    assert {frozenset(g) for g in got.values()} == {frozenset(g) for g in groups.values() if len(g) > 1}


def test_chains_keep_every_pair_within_the_threshold(spark):
    rng = random.Random(9)
    pairs = []
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for _ in range(rng.randrange(3)):
            b ^= 1 << rng.randrange(64)
        pairs.append((int(np.uint64(a).astype(np.int64)), int(np.uint64(b).astype(np.int64))))
    df = spark.createDataFrame(pairs, "a long, b long")
    for segments in simhash.SEGMENTS:
        key = lambda c: simhash._keys(F.col(c), 2, segments)  # noqa: B023, E731
        starts = F.sequence(F.lit(0), F.lit(segments - 1))
        kept = F.exists(starts, lambda s: (F.get(key("a"), s) == F.get(key("b"), s)) & simhash._within_budgets(F.col("a"), F.col("b"), s, 2, segments))  # noqa: B023
        assert df.filter(~kept).count() == 0


def test_key_width_follows_the_number_of_fingerprints():
    widths = [simhash.equal_chain(2, m) * 64 // m for m in simhash.SEGMENTS]
    assert widths == sorted(widths) == [24, 28, 30, 31]
    assert [simhash.segments_for(n) for n in (1, 1 << 24, (1 << 24) + 1, 1 << 29, 1 << 40)] == [8, 8, 16, 32, 64]


@pytest.mark.parametrize("segments", [16, 64])
def test_any_number_of_segments_finds_the_same_components(spark, segments):
    rng = random.Random(segments)
    codes = {rng.getrandbits(64) for _ in range(60)}
    for c in list(codes):
        codes.add(c ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64))
    signed = {int(np.uint64(c).astype(np.int64)): c for c in codes}
    found = simhash.components(simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long"), segments=segments)).collect()
    want = {c: r for c, r in brute_components(codes).items()}
    got = {signed[r.node]: signed[r.component] for r in found}
    for a in codes:
        for b in codes:
            assert (want[a] == want[b]) == (got.get(a, a) == got.get(b, b))


def test_hot_values_stay_where_they_are(spark, monkeypatch):
    from ruleweave.llm import common

    left = spark.range(50_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), "id")
    right = spark.range(0, 50_000, 2).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")).unionByName(spark.createDataFrame([(7, 14)], "k long, v long"))
    assert common.hot_values(left, "k") == [7]
    for how in ("inner", "left"):
        got = common.join_hot(left, right, "k", how).select("id", "v").orderBy("id").collect()
        assert got == left.join(right, "k", how).select("id", "v").orderBy("id").collect()


def test_documents_with_nulls_copies_and_clashing_names(spark):
    rows = [(5, None, "x"), (3, "", "x"), (9, "a b c d e", "x"), (9, "a b c d e", "x"), (None, "A b C d e", "x"), (None, "other words here now", "x"), (7, "one", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted((r.doc_id is not None and r.doc_id or -1, r.component_id or -1) for r in simhash.near_duplicates(docs).collect())
    assert got == sorted([(5, 3), (3, 3), (9, 9), (9, 9), (-1, 9), (-1, -1), (7, 7)])
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_keep_first_keeps_one_row_of_each_group(spark):
    rows = [(5, None), (3, ""), (9, "a b c d e"), (9, "a b c d e"), (None, "A b C d e"), (None, "other words here now"), (None, "other words here now"), (7, "one"), (7, "quite different text"), (8, "one")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n long")
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    got = sorted((r.doc_id or -1, (r.text or "").lower()) for r in kept.collect())
    assert got == [(-1, "other words here now"), (3, ""), (7, "one"), (7, "quite different text"), (9, "a b c d e")]
    assert simhash.keep_first(docs.limit(0)).count() == 0
