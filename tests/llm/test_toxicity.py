import random

import numpy as np
import pytest

from ruleweave.llm import toxicity as tox


def brute_kernel(a: str, b: str) -> float:
    """The normalised kernel by its definition: all subsequences of three symbols within a span."""

    def features(w):
        s, out = list(tox.symbols(w)), {}
        for i in range(len(s)):
            for j in range(i + 1, len(s)):
                for k in range(j + 1, len(s)):
                    if k - i < tox.SPAN:
                        out[s[i], s[j], s[k]] = out.get((s[i], s[j], s[k]), 0) + tox.DECAY ** (k - i - 2)
        return out

    fa, fb = features(a), features(b)
    dot = lambda x, y: sum(v * y.get(u, 0) for u, v in x.items())
    return dot(fa, fb) / (dot(fa, fa) * dot(fb, fb)) ** 0.5


def test_kernel_equals_the_definition():
    words = ["idiot", "idxiot", "aaaa", "a", "ab", "réeux", "worthlessness"]
    got = tox.dense(words).kernel(tox.dense(words))
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            assert got[i, j] == pytest.approx(brute_kernel(a, b), abs=1e-9)


def test_collapsed_table_equals_the_landmark_sum():
    rng = random.Random(0)
    syllables = ["an", "ti", "er", "on", "sh", "le"]
    clean = ["".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(200)]
    bad = ["moron", "scum", "idiot"]
    model = tox.fit_machine(bad, clean, np.ones(3), landmarks=64)
    assert (model.margins(bad) > 0.5).all()
    assert (model.margins(clean) > 0).mean() < 0.02
    assert model.margins(["idxiot", "morron", "i" + "diot" * 30]).min() > model.margins(clean).mean()


def test_sentences_and_their_units():
    assert tox.plain("i.d.i-o_t!") == "idiot" and tox.plain("1d10t") == "idiot" and tox.plain("2024") == "" and tox.plain("...") == ""
    assert tox.sentences("You i d i o t there. The id iot!\nNo more words") == [
        ["you", "i", "d", "i", "o", "t", "there.", "youi", "id", "di", "io", "ot", "idiot"],
        ["the", "id", "iot!", "theid", "idiot!"],
        ["no", "more", "words"],
    ]
    assert tox.sentences(None) == [] == tox.sentences(" \n ")


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(3)
    syllables = ["an", "ti", "er", "on", "sh", "le", "ou", "nd"]
    rows = []
    for i in range(400):
        words = ["".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(40)]
        toxic = i % 5 == 1
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(40), rng.choice(["moron", "scum", "lowei" + rng.choice(syllables)]))
        rows.append((i, " ".join(words) + ".", int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_held_out_accuracy_gaps_and_odd_rows(spark, labelled):
    docs = labelled.select("doc_id", "text")
    odd = [(1000, None), (1001, ""), (1002, "you m.o.r.o.n here"), (1003, "a m o r o n and a s c u m and s-c-u-m"), (None, "an er"), (None, "an er"), (1004, "moron scum " + "on er " * 20000), (1005, "an er. you mor on and sc um on"), (1006, "the morxon er. an scxum")]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    model = tox.fit(docs, labelled.filter("doc_id < 320").select("doc_id", "toxic"))
    got = tox.score(docs, model).collect()
    assert len(got) == 409 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    by = {r.doc_id: r for r in got}
    held = labelled.filter("doc_id >= 320").collect()
    assert np.mean([by[r.doc_id].predicted == r.toxic for r in held]) > 0.95
    assert by[1000].score == by[1001].score < 0.5 and by[1003].predicted == 1 and by[1004].predicted == 1
    assert by[1002].score > by[1000].score and by[1005].score > by[1000].score and by[1006].score > by[1000].score


def test_no_labels_and_no_rows(labelled):
    docs = labelled.select("doc_id", "text")
    assert tox.fit(docs, labelled.filter("toxic = 0").select("doc_id", "toxic")) is None
    assert tox.score(docs, None).filter("predicted = 1").count() == 0 and tox.score(docs.limit(0), None).count() == 0
