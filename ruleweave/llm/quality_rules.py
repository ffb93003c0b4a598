"""Rule bitmask ledger: every rule is evaluated once, policies and ablations only read the stored bits.

``ledger`` keeps, for each row, the measurements and one long whose bit i says that rule i failed.
``apply_policy`` decides by a versioned policy, a mask of the rules that reject.  ``ablations`` tells
what each rule of a policy does on its own, from one aggregation over the distinct bit patterns.

Defined cases: a null or empty text has no words, all measurements 0, and fails ``too_short``; rows
that repeat are judged one by one; an empty table gives an empty ledger; columns of the input that
are not asked for do not reach the ledger, so no name can clash.  Everything is row-local SQL: no
shuffle, and memory is bounded by the longest text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleweave.llm.common import let, words

WINDOW_WORDS = 8
SYMBOLS = "#*$%&|<>"

#: Bit number, name and failing condition of each rule. Bits are never reused or renumbered.
RULES: tuple[tuple[int, str, str], ...] = (
    (0, "too_short", "n_words < 20"),
    (1, "repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    (2, "symbol_heavy", "2 * n_symbols > n_words"),
    (3, "word_length", "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 16 * n_words)"),
    (4, "repeated_lines", "n_lines >= 3 AND 2 * n_dup_lines > n_lines"),
)
BIT = {name: 1 << bit for bit, name, _ in RULES}


@dataclass(frozen=True)
class Policy:
    """A versioned choice of rules; a row is kept if none of them failed."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum({BIT[r] for r in self.rules})


BASE_POLICY = Policy("base-1", ("too_short", "repeated_windows"))
PRODUCTION_POLICY = Policy("production-1", tuple(name for _, name, _ in RULES))


def _covered(windows: Column) -> Column:
    """How many word positions lie in windows that occur at least twice."""

    def among(sorted_windows: Column) -> Column:
        same = lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))
        twice = F.filter(
            sorted_windows,
            lambda x, i: F.when(i > 0, same(F.get(sorted_windows, i - 1), x)).otherwise(False) | same(F.get(sorted_windows, i + 1), x),
        )
        starts = F.sort_array(F.transform(twice, lambda x: x["p"]))
        nothing = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW_WORDS).alias("last"))
        return F.aggregate(
            starts,
            nothing,
            lambda acc, p: F.struct((acc["n"] + F.least(F.lit(WINDOW_WORDS), p - acc["last"])).alias("n"), p.alias("last")),
            lambda acc: acc["n"],
        )

    placed = F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("p")))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(let(F.sort_array(placed), among))


def repeated_words(word_array: Column) -> Column:
    """Words in 8-word windows found twice or more in the text, the first included.

    A window's hash joins the hashes of its two halves, so each of three passes hashes two longs a word.
    """
    paired = lambda h, step: F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + step)))
    whole = lambda h: let(
        h, lambda one: let(paired(one, 1), lambda two: let(paired(two, 2), lambda four: F.slice(paired(four, 4), 1, F.size(four) - (WINDOW_WORDS - 1))))
    )
    return F.when(F.size(word_array) <= WINDOW_WORDS, F.lit(0)).otherwise(let(whole(F.transform(word_array, lambda w: F.xxhash64(w))), _covered))


def _measured(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))

    def of(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeated_words(w).cast("long").alias("n_repeat_words"),
        )

    def of_lines(x: Column) -> Column:
        return F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))

    return F.struct(let(words(text), of).alias("w"), let(lines, of_lines).alias("l"), F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"))


def ledger(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """keys, the measurements and fail_bits of every row of docs."""
    measured = docs.select(*keys, _measured(F.coalesce(F.col(text), F.lit(""))).alias("_m"))
    flat = measured.select(*keys, "_m.w.n_words", "_m.w.word_chars", "_m.n_symbols", "_m.l.n_lines", "_m.l.n_dup_lines", "_m.w.n_repeat_words")
    bits = F.lit(0).cast("long")
    for bit, _, failing in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(failing), F.lit(1 << bit)).otherwise(F.lit(0)).cast("long"))
    return flat.withColumn("fail_bits", bits)


def apply_policy(rows: DataFrame, policy: Policy, into: str = "kept") -> DataFrame:
    """Adds the policy's verdict, from the stored bits alone."""
    return rows.withColumn(into, F.col("fail_bits").bitwiseAND(F.lit(policy.mask)) == 0)


def sole_rule(rows: DataFrame, policy: Policy, into: str = "sole_bit") -> DataFrame:
    """Adds the bit of the one rule without which the policy would keep a row it rejects; 0 where there is none such.

    Summed up by bit it is what ``ablations`` tells of each rule's rows that only it fails.
    """
    bits = F.col("fail_bits").bitwiseAND(F.lit(policy.mask))
    return rows.withColumn(into, F.when(F.bit_count(bits) == 1, bits).otherwise(F.lit(0).cast("long")))


def keep_passing(docs: DataFrame, policy: Policy, text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that the policy keeps."""
    whole = docs.select(F.struct("*").alias("row"), F.col(text).alias("text"))
    return apply_policy(ledger(whole, ("row",)), policy).filter("kept").select("row.*")


def ablations(rows: DataFrame, policy: Policy) -> DataFrame:
    """For each rule of the policy: rows it fails, rows only it fails, and rows kept without it.

    One pass counts rows by masked bit pattern (at most 2**rules of them); the rest reads that table.
    """
    patterns = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(policy.mask)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(BIT[r]).cast("long").alias("bit")) for r in policy.rules])
    each = patterns.select("bits", "n", F.explode(rules).alias("r")).select("bits", "n", "r.rule", "r.bit")
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("long")
    return each.groupBy("rule").agg(
        F.lit(policy.version).alias("policy_version"),
        total(F.col("bits").bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        total(F.col("bits") == F.col("bit")).alias("n_failed_alone"),
        total(F.col("bits").isin(0) | (F.col("bits") == F.col("bit"))).alias("n_kept_without"),
        total(F.col("bits") == 0).alias("n_kept"),
    )
