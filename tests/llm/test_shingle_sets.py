import random

import pytest

import corpus_pipeline
from ruleweave.llm import shingle_sets, simhash


def brute_set(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_components(texts):
    sets = [brute_set(t) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or (a and b and 5 * len(a & b) >= 4 * len(a | b)):
                ra, rb = find(i), find(j)
                parent[max(ra, rb)] = min(ra, rb)
    return {find(i) for i in range(len(texts))}


def near_copies(seed):
    """Groups of copies with a few words changed, some sharing one passage, with short and empty texts."""
    rng = random.Random(seed)
    word = lambda: "w%d" % rng.randrange(5000)
    passage, texts = [word() for _ in range(40)], [None, "", "One two", "one TWO", "one three"]
    for group in range(12):
        base = [word() for _ in range(rng.randrange(30, 200))] + (passage if group % 2 else [])
        for _ in range(rng.randrange(1, 9)):
            copy = list(base)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    return texts


@pytest.mark.parametrize("crowded", [1, 32])
def test_links_equal_brute_force(spark, crowded, monkeypatch):
    monkeypatch.setattr(shingle_sets, "PAIRED_GROUP", crowded)
    monkeypatch.setattr(shingle_sets, "COMMON", crowded)
    texts = near_copies(crowded)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id for r in simhash.keep_first(docs, similarity=80).collect()}
    assert got == brute_components(texts) and len(got) < len(texts) - 8


def test_the_pipeline_stage_drops_near_copies(spark):
    base = ["word%d" % i for i in range(100)]
    copy = [*base[:50], "changed", *base[51:]]
    docs = spark.createDataFrame([(1, " ".join(base), 1), (2, " ".join(copy), 1), (3, " ".join(reversed(base)), 1)], "doc_id long, text string, n long")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {1, 3}


def test_repeated_and_null_keys(spark):
    rows = [(5, None), (3, ""), (9, "a b c d e"), (9, "a b c d e"), (None, "A b C d e"), (None, "other words here now"), (7, "one"), (7, "quite different text"), (8, "one")]
    docs = spark.createDataFrame([(*r, [1]) for r in rows], "doc_id long, text string, grams array<int>")
    kept = simhash.keep_first(docs, similarity=80)
    assert kept.columns == docs.columns
    got = sorted((r.doc_id or -1, (r.text or "").lower()) for r in kept.collect())
    assert got == [(-1, "other words here now"), (3, ""), (7, "one"), (7, "quite different text"), (9, "a b c d e")]
    assert simhash.keep_first(docs.limit(0), similarity=80).count() == 0


def test_a_shingle_in_nine_of_ten_texts_stays_where_it_is(spark, monkeypatch):
    """A passage that nearly all texts share is a hot key: its rows meet its size without a shuffle, and no pair is lost."""
    monkeypatch.setattr(shingle_sets, "hot_sizes", lambda sizes, key, n: [r[0] for r in sizes.filter(f"{n} > 5").collect()])
    rng = random.Random(9)
    passage = "this one passage is everywhere"
    texts = []
    for i in range(60):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([0, 2, 30]))]
        texts.append(" ".join([*base, passage] if i % 10 else base))
        if i % 7 == 0:
            texts.append(texts[-1] + " end")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in simhash.keep_first(docs, similarity=80).collect()} == brute_components(texts)


def large_texts():
    """Texts of some thousand words that share only a part, and near copies of a few of them, larger and smaller."""
    rng = random.Random(3)
    word = lambda: "w%d" % rng.randrange(50_000)
    passage = [word() for _ in range(1_200)]
    texts = [" ".join([*passage, *(word() for _ in range(rng.randrange(2_000, 3_200)))]) for _ in range(12)]
    texts += [" ".join(t.split()[: len(t.split()) * 9 // 10]) for t in texts[:3]] + [texts[3].replace("w1", "w2", 40), " ".join(texts[4].split()[:2_100])]
    return texts


def test_large_sets_are_moved_only_where_their_wide_sketches_agree(spark, monkeypatch):
    """A sketch of 1,024 bits lets every pair of large sets through; all of them were moved to be compared."""
    monkeypatch.setattr(shingle_sets, "PAIRED_GROUP", 4)
    monkeypatch.setattr(shingle_sets, "COMMON", 1_000)
    met, write = [], shingle_sets.cut
    monkeypatch.setattr(shingle_sets, "cut", lambda df, tag, *held: (out := write(df, tag, *held), met.append(out.count()) if tag == "sets-pairs" else None)[0])
    texts = large_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in simhash.keep_first(docs, similarity=80).collect()} == brute_components(texts) != set(range(len(texts)))
    assert met and sum(met) <= 12


def test_fingerprints_tie_first_and_tied_pairs_are_not_looked_at_again(spark, monkeypatch):
    """The named method has its step: pairs of its links, confirmed by sets; the rest of the near copies is found by the sets."""
    base = ["word%d" % i for i in range(2_000)]
    texts = [" ".join(base), " ".join([*base, "end"]), " ".join([*base[:1_000], *(f"other{i}" for i in range(100)), *base[1_000:]]), "one", "a b c", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    given, confirm = [], shingle_sets.confirmed
    monkeypatch.setattr(shingle_sets, "confirmed", lambda pairs, *more: (out := confirm(pairs, *more), given.append((pairs.count(), out.count())))[0])
    assert {r.doc_id for r in simhash.keep_first(docs, similarity=80).collect()} == brute_components(texts) == {0, 3, 4, 5}
    codes = [simhash.fingerprint(t) for t in texts]
    near = sum((a ^ b).bit_count() <= 2 for i, a in enumerate(codes) for b in codes[:i])
    assert near >= 1 and given[0] == (near, near)
