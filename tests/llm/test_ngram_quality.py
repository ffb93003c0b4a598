import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ruleweave.llm import ngram_quality as lm

TRUSTED = ["the cat sat on the mat", "the hat", "a cat, a hat and the mat", "then that cat sat", "éèê 中文 the", "the cat sat on the mat", ""]
OTHER = ["the ### mat", "zzz qqq", "tha", None]


def brute_force(trusted: list[str], texts: list[str]) -> dict[int, float]:
    """Interpolated modified Kneser-Ney over symbol tuples, by the definition."""
    vocabulary = {s for t in texts for s in [*map(ord, t or ""), lm.END]}
    tuples = lambda t: [tuple(s) for x in [list(lm.symbols(t))] for s in zip(*(x[i:] for i in range(lm.ORDER)), strict=False)]
    tables = {lm.ORDER: Counter(g for t in trusted for g in tuples(t))}
    for k in range(lm.ORDER - 1, 0, -1):
        tables[k] = Counter(g[1:] for g in tables[k + 1])

    def discount(k: int) -> list[float]:
        c = Counter(tables[k].values())
        n1, n2, n3, n4 = (c[i] for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 else 0.5
        raw = (1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5)
        return [min(max(d, 0.05), i - 0.05) for i, d in zip((1, 2, 3), raw, strict=True)]

    ds = {k: discount(k) for k in tables}

    def p(g: tuple) -> float:
        if not g:
            return 1 / len(vocabulary)
        k = len(g)
        same = {x: c for x, c in tables[k].items() if x[:-1] == g[:-1]}
        if not same:
            return p(g[1:])
        total = sum(same.values())
        left = sum(ds[k][min(c, 3) - 1] for c in same.values())
        c = same.get(g, 0)
        return (c - ds[k][min(c, 3) - 1] if c else 0) / total + left / total * p(g[1:])

    return {i: math.exp(-sum(math.log(p(g)) for g in tuples(t)) / len(tuples(t))) for i, t in enumerate(texts)}


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else None, "x") for i, t in enumerate(TRUSTED + OTHER)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n string")


@pytest.fixture(scope="module")
def trusted(spark):
    return spark.createDataFrame([(i,) for i in range(len(TRUSTED))] + [(0,), (None,)], "doc_id long")


def test_perplexities_equal_the_definition(docs, trusted):
    want = brute_force(TRUSTED, TRUSTED + OTHER)
    got = {r.doc_id: r.perplexity for r in lm.score(docs, trusted).collect()}
    assert len(got) == len(want)
    for i, p in want.items():
        assert got[i] == pytest.approx(p, rel=1e-9), i


def test_blocks_rows_and_windows_of_any_size_give_the_same(docs, trusted, monkeypatch):
    want = {r.doc_id: r.perplexity for r in lm.score(docs, trusted).collect()}
    for name, value in (("BLOCK_CHARS", 30), ("ROW_CHARS", 10), ("WINDOW", 5)):
        monkeypatch.setattr(lm, name, value)
    rows = docs.select("doc_id", "lang", "text", F.when(F.col("doc_id") < len(TRUSTED), F.crc32(F.coalesce("text", F.lit(""))) % 2).cast("int").alias("fold"))
    table = lm.probabilities(lm.counts(rows.coalesce(1)))
    got = {r.doc_id: r.perplexity for r in lm.perplexities(rows.coalesce(1), table, ("doc_id", "lang")).collect()}
    assert got == pytest.approx(want)


def test_probabilities_of_a_context_sum_to_one(spark):
    context = int(next(lm.grams("the "))[1][3])
    every = "abcdehxyz \x03"
    rows = [(i, context, ord(c), 5 if c == "e" else 1 if c in "ab" else 0) for i, c in enumerate(every)]
    table = lm.probabilities(spark.createDataFrame(rows, "gram long, context long, last long, n long"), ("n",))
    assert sum(math.exp(r.n) for r in table.collect()) == pytest.approx(1.0)


def test_every_script_is_told_apart_and_long_texts_are_whole(spark):
    import random

    rng = random.Random(5)
    words = {"ru": "мама мыла раму и пила чай под окном старого дома".split(), "zh": "今天 天气 很好 我们 一起 去 公园 散步 吧".split()}
    said = [(i, " ".join(rng.choices(words[lang], k=25)), lang) for i, lang in enumerate(["ru", "zh"] * 40)]
    mixed = lambda lang: " ".join("".join(rng.sample(w, len(w)))[::-1] for w in rng.choices(words[lang], k=40))
    bad = [(100, "".join(rng.sample("абвгдежзиклмнопрстуфхц " * 9, 150)), "ru"), (101, "".join(chr(0x4E00 + rng.randrange(5000)) for _ in range(90)), "zh"), (102, mixed("ru"), "ru")]
    long = [(103, " ".join(rng.choices(words["ru"], k=200_000)), "ru"), (104, "щ" * 1_200_000, "ru")]
    rows = spark.createDataFrame(said + bad + long, "doc_id long, text string, lang string")
    kept = {r.doc_id: r.kept for r in lm.score(rows, rows.filter("doc_id < 80").select("doc_id"), quantile=1.0).collect()}
    assert not any(kept[i] for i in (100, 101, 102, 104)) and kept[103] and all(kept[i] for i in range(80))


def test_quantile_by_language(spark):
    scored = spark.range(1, 1001).select(F.when(F.col("id") % 4 == 0, "de").otherwise("en").alias("lang"), F.col("id").cast("double").alias("perplexity"))
    got = {r.lang: r.bound for r in lm.quantiles(scored, 0.9).collect()}
    assert got["de"] == pytest.approx(900, rel=0.002) and got["en"] == pytest.approx(899, rel=0.002) and got[None] == pytest.approx(900, rel=0.002)


def test_keep_clean_keeps_columns_and_rejects_symbols(spark, docs, trusted):
    many = docs.unionByName(spark.createDataFrame([(100, "#$%&!~ " * 30, "en", "y")], docs.schema))
    kept = lm.keep_clean(many, trusted, quantile=1.0)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert 100 not in ids and set(range(len(TRUSTED))) <= ids


def test_no_rows_and_no_trusted_rows(docs, trusted):
    assert lm.score(docs.limit(0), trusted).count() == 0
    vocabulary = {s for t in TRUSTED + OTHER for s in [*map(ord, t or ""), lm.END]}
    rows = lm.score(docs, trusted.limit(0)).collect()
    assert len(rows) == docs.count() and all(r.kept and r.perplexity == pytest.approx(len(vocabulary)) for r in rows)


def test_equal_perplexities_at_the_bound_are_kept(spark):
    rows = spark.createDataFrame([(i, "the same text each time", "en") for i in range(9)], "doc_id long, text string, lang string")
    judged = lm.score(rows, rows.filter("doc_id < 4"), quantile=0.5).collect()
    assert len({r.perplexity for r in judged}) == 1
    assert len({r.kept for r in judged}) == 1


def test_the_bound_is_the_quantile_of_held_out_trusted_text(spark, docs, trusted):
    import random
    import zlib

    rng = random.Random(1)
    said = [" ".join(rng.choices("the cat sat on a mat and then that hat".split(), k=30)) for _ in range(40)]
    rows = [*enumerate(said), (40, "the " * 60), (41, " ".join("".join(rng.sample(w, len(w))) for w in " ".join(said[:2]).split()))]
    texts = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")
    judged = {r.doc_id: r for r in lm.score(texts, texts.filter("doc_id < 40"), quantile=1.0).collect()}
    folds = [[t for t in said if zlib.crc32(t.encode()) % lm.FOLDS == f] for f in range(lm.FOLDS)]
    want = max(p for f in range(lm.FOLDS) for p in brute_force([t for g, own in enumerate(folds) if g != f for t in own], folds[f]).values())
    assert judged[0].bound == pytest.approx(want, rel=2 * lm.BIN)
    assert judged[41].perplexity > judged[41].bound and not judged[41].kept
    assert all(judged[i].kept for i in range(40))
