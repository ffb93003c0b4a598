import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ruleweave.llm import best_position

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def split(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    """Every score of every document, plainly: (item, rank, doc, score)."""
    held = [(i, Counter(split(t))) for i, t in docs if split(t)]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in held:
            m = 100 - 90 + (90 * sum(c.values()) * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(split(text)) if t in c)
            if score > 0:
                scored.append((-score, i is not None, i or 0, i))
        out += [(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_terms_are_the_pattern_s_matches(text):
    assert best_position.terms(text.encode("utf-8", "replace")) == [t.encode() for t in split(text.encode("utf-8", "replace").decode())]


@pytest.mark.parametrize("first", [1, 2, 16])
def test_best_positions_equal_all_scores(monkeypatch, first):
    """Random lists with many ties; fewer places are read than there are where the scores part."""
    monkeypatch.setattr(best_position, "FIRST_DEPTH", first)
    rng = random.Random(first)
    saved = 0
    for _ in range(300):
        docs, k = rng.randrange(1, 60), rng.randrange(1, 12)
        rows = [(t, d, rng.choice([1, 2, 2, 3, 50, 400])) for t in range(rng.randrange(1, 5)) for d in range(docs) if rng.random() < rng.choice([0.1, 0.9])]
        lists = best_position.Lists(*(np.array(x, np.int64) for x in zip(*rows, strict=True))) if rows else best_position.Lists(*[np.zeros(0, np.int64)] * 3)
        order = np.array(rng.sample(range(docs), docs))
        own = [x for x in map(lists.of, range(5)) if x]
        best, scores, read = best_position.best_positions(own, order, k)
        totals = Counter()
        for _, d, w in rows:
            totals[d] += w
        want = sorted((-s, order[d], d) for d, s in totals.items())[:k]
        assert sorted(zip((-scores).tolist(), order[best].tolist(), best.tolist(), strict=True)) == want
        assert read <= len(rows)
        saved += len(rows) - read
    assert saved > 0


def test_search_stops_before_the_end_of_the_lists():
    impact = np.concatenate([np.arange(10_000, 0, -1)] * 2)
    doc, term = np.concatenate([np.arange(10_000)] * 2), np.repeat([0, 1], 10_000)
    lists = best_position.Lists(term, doc, impact)
    best, scores, read = best_position.best_positions([lists.of(0), lists.of(1)], np.arange(10_000), 10)
    assert sorted(best.tolist()) == list(range(10)) and read < 100


@pytest.mark.parametrize(("shard", "block"), [(2_000_000, 200_000), (40, 200_000), (40, 20)])
def test_operator_equals_all_scores(spark, monkeypatch, shard, block):
    """One or many shards and blocks; nulls, repeated ids and rows, ties, a very long text, clashing names."""
    monkeypatch.setattr(best_position, "SHARD", shard)
    monkeypatch.setattr(best_position, "BLOCK_TERMS", block)
    rng = random.Random(5)
    vocabulary = ["one", "Two", "drei", "été", "v4", "的", "the", "the", "rare" + "x" * 50]
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 30)))) for i in range(60)]
    docs += [(60, None), (61, ""), (62, "-- ,,"), (None, "one Two"), (7, docs[7][1]), (7, docs[7][1]), (63, "the " * 30_000 + "one")]
    items = [(0, "one two, DREI!"), (1, "Été 的 v4"), (2, None), (3, "unknown words"), (4, "the the the"), (5, "rare" + "x" * 50 + " one"), (None, "two"), (5, "two")]
    d = spark.createDataFrame([(*r, "clash", 1) for r in docs], "doc_id long, text string, shard string, score int")
    q = spark.createDataFrame([(*r, "clash", 1) for r in items], "item_id long, text string, query string, rank int")
    got = sorted((tuple(r) for r in best_position.search(d, q).collect()), key=repr)
    assert got == brute(docs, items)
    assert best_position.search(d.limit(0), q).count() == 0 == best_position.search(d, q.limit(0)).count()
