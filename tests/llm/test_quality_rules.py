import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ruleweave.llm import quality_rules as qr

WORD = re.compile("[^\x20\x09-\x0D]+")


def brute(text):
    """Measurements and failing rules of a text, by their definitions."""
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    m = {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in qr.SYMBOLS for c in text), "n_lines": len(lines),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered),
    }
    failing = {
        "too_short": m["n_words"] < 20, "repeated_windows": 100 * m["n_repeat_words"] > 30 * m["n_words"], "symbol_heavy": 2 * m["n_symbols"] > m["n_words"],
        "word_length": m["n_words"] > 0 and not 2 * m["n_words"] <= m["word_chars"] <= 16 * m["n_words"], "repeated_lines": m["n_lines"] >= 3 and 2 * m["n_dup_lines"] > m["n_lines"],
    }
    return m, failing


TEXTS = [
    None, "", " \n\t ", "one two", "a b c d e f g h " * 3, "a b c d e f g h i " + "a b c d e f g h i", " ".join(f"w{i}" for i in range(40)),
    "x y " * 30, "#$% " * 25, "same line here\n" * 5 + "other", "é中文 🙂 " * 20, "a" * 400 + " b" * 30, "w " * 20_000 + " ".join(f"v{i}" for i in range(20_000)),
    " ".join(f"w{i % 23}" for i in range(90)), " ".join(["no", "break"] * 30), "line\r\nline\r\nline\r\n" + "p q r s t " * 5, "a b c d e f g h",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "one two", "x"), (3, "one two", "x"), (3, "one two", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_words string")


def test_measurements_and_bits_equal_the_definitions(docs):
    got = qr.ledger(docs).collect()
    assert len(got) == len(TEXTS) + 3
    for r in got[: len(TEXTS)]:
        m, failing = brute(TEXTS[r.doc_id])
        assert {k: r[k] for k in m} == m, TEXTS[r.doc_id]
        assert r.fail_bits == sum(qr.BIT[name] for name, fails in failing.items() if fails)


def test_policies_read_the_bits_and_keep_columns(docs):
    kept = qr.keep_passing(docs, qr.PRODUCTION_POLICY)
    assert kept.columns == docs.columns
    want = sorted(i for i, t in enumerate(TEXTS) if not any(brute(t)[1].values()))
    assert want and sorted(r.doc_id for r in kept.collect()) == want
    base = qr.apply_policy(qr.ledger(docs), qr.BASE_POLICY, "base").filter("base").count()
    assert base == sum(not (f["too_short"] or f["repeated_windows"]) for _, f in map(brute, TEXTS))
    assert qr.keep_passing(docs.limit(0), qr.PRODUCTION_POLICY).count() == 0 == qr.ledger(docs.limit(0)).count()


def test_ablations_equal_applying_each_smaller_policy(docs):
    rows = qr.ledger(docs)
    for policy in (qr.PRODUCTION_POLICY, qr.BASE_POLICY):
        found = {r.rule: r for r in qr.ablations(rows, policy).collect()}
        assert set(found) == set(policy.rules)
        for rule in policy.rules:
            others = qr.Policy("less", tuple(x for x in policy.rules if x != rule))
            count = lambda p: qr.apply_policy(rows, p).filter("kept").count()
            r = found[rule]
            assert (r.n_kept, r.n_kept_without) == (count(policy), count(others))
            assert r.n_failed == rows.filter(F.col("fail_bits").bitwiseAND(F.lit(qr.BIT[rule])) != 0).count() and r.n_failed_alone == r.n_kept_without - r.n_kept
    assert qr.ablations(rows.limit(0), qr.BASE_POLICY).count() == 0
    alone = {r.sole_bit: r["count"] for r in qr.sole_rule(rows, qr.PRODUCTION_POLICY).groupBy("sole_bit").count().collect() if r.sole_bit}
    found = {1 << qr_bit: r.n_failed_alone for r in qr.ablations(rows, qr.PRODUCTION_POLICY).collect() for qr_bit in [qr.BIT[r.rule].bit_length() - 1] if r.n_failed_alone}
    assert alone == found


def test_bits_are_never_shared():
    assert len({bit for bit, _, _ in qr.RULES}) == len(qr.RULES) == len({name for _, name, _ in qr.RULES})
