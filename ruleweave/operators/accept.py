"""Acceptance of proposed constraints: literal evidence, operative words and figures, each refusal with its reason.

A proposal is one row beside the text of its document, so all of it is expressions over that row and nothing moves. The tests
run in a fixed order and the first that fails gives the reason; what is accepted carries the quote as the document has
it, never as it was proposed.

proposals has rule_id, action, parameter ("months", "dollars" or null), effect, evidence_quote, repaired_quote, operative_quote,
max, value_text, hard_max, hard_max_text, hard_max_quote, figure_year, cap_can_rise, elements_untestable, obligation_text,
key_value, requirement and text.

Defined cases: a null text or quote is not found; a null figure needs no words; empty and blank wordings count as none; rows
that repeat are judged one by one; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleweave.functions import text as tx
from ruleweave.operators.trace import plain_number

#: Characters of a source kept on each side of a rule's own quote.
WINDOW = 14_000
# Words by which a quote forbids, requires, depends on others' conduct, or lets a cap move.
FORBIDS = (
    r"(?i)\b(unlawful|illegal|prohibit\w*|forbid\w*|forbidden|shall not|may not|must not|cannot|can not|can no longer|not (?:be )?(?:permitted|allowed)"
    r"|no (?:person|landlord|lessor|owner|agent)\b[^.]*\b(?:shall|may))\b"
)
REQUIRES = r"(?i)\b(shall|must|required?|requires|has to|have to|obligated)\b"
CONDITIONAL = (
    r"(?i)\b(as part of an? (?:contract|agreement)|contract, combination|combination in the form|conspir\w*|agreement (?:among|between|with)|coerc\w*|collu\w*"
    r"|two or more (?:persons|landlords|users|competitors))\b"
)
ADJUSTABLE = r"(?i)\b(adjust\w*|consumer price index|cpi|indexed|index(?:ing|ation)?)\b"
# The reasons.
NOT_THERE = "the quote is not in the source document"
NO_PARAMETER = "this action has no parameter a limit could apply to"
HARD_NOT_THERE = "the quote given for hard_max is not in the source document"
BELOW = "hard_max is below max"
NO_YEAR = "the year given for the figure is not in the quote"
NO_BAN_WORDS = "the quote offered as a ban contains no words that forbid"
NO_DUTY = "an obligation with no stated duty"
NO_DUTY_WORDS = "the quote offered as a duty contains no words that require"


def source_window(text: Column, start: Column, end: Column, window: int = WINDOW) -> Column:
    """The whole of a short text, else what stands around a span; offsets are never taken from it."""
    first = F.greatest(F.lit(0), start - window)
    around = F.substr(text, first + 1, F.least(F.length(text), end + window) - first)
    return F.when((F.length(text) <= 2 * window) | start.isNull() | end.isNull(), F.left(text, F.lit(2 * window))).otherwise(around)


def proposal_key(version: str, model: str, *parts: Column) -> Column:
    """What names a proposal: a digest of all it depends on."""
    return F.sha2(F.to_json(F.array(F.lit(version), F.lit(model), *[p.cast("string") for p in parts])), 256)


def read_quantity(text: Column, parameter: Column) -> Column:
    """The one figure that words state in a parameter's unit."""
    return F.when(parameter == "months", tx.single(tx.parse_months(text))).when(parameter == "dollars", tx.single(tx.parse_dollars(text)))


def _blank(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def _figure_problem(n: Column, words: Column, name: str, within: Column, parameter: Column) -> Column:
    """Why a figure can't be taken from its words; null if it can, or if there is none."""
    inside = F.coalesce(tx.contains_text(within, words), F.lit(False))
    read = read_quantity(words, parameter)
    return F.when(n.isNotNull(), F.when(~inside, f"the words given for {name} are not inside the quote")
        .when(read.isNull(), F.concat(F.lit(f'no single figure could be read from the words given for {name}: "'), words, F.lit('"')))
        .when(read != n, F.concat(F.lit(f"the words given for {name} read as "), plain_number(read), F.lit(", the proposal says "), plain_number(n))))


def judge_proposals(proposals: DataFrame) -> DataFrame:
    """proposals with reason (null: accepted) and, of the accepted, constraint: the record to store."""
    col = F.col
    quote = lambda name: tx.verify_quote(col("text"), F.coalesce(name, F.lit("")))
    failed = lambda v: F.coalesce(v["method"], F.lit("failed")) == "failed"
    seen = proposals.withColumns({"_own": quote("evidence_quote"), "_repaired": F.when(col("repaired_quote").isNotNull(), quote("repaired_quote")), "_wider": F.when(col("operative_quote").isNotNull(), quote("operative_quote"))})
    first = F.when(~failed(col("_own")), col("_own")).when(~failed(col("_repaired")), F.struct(F.lit("repaired").alias("method"), col("_repaired.span_start").alias("span_start"), col("_repaired.quoted_span").alias("quoted_span")))
    seen = seen.withColumn("_found", first)
    operative = lambda q: F.when(col("effect") == "prohibit", q.rlike(FORBIDS)).when(col("effect") == "obligation", q.rlike(REQUIRES)).otherwise(F.lit(True))
    wider = F.struct(F.lit("repaired").alias("method"), col("_wider.span_start").alias("span_start"), col("_wider.quoted_span").alias("quoted_span"))
    takes = ~operative(col("_found.quoted_span")) & ~failed(col("_wider")) & operative(col("_wider.quoted_span"))
    seen = seen.withColumn("_found", F.when(F.coalesce(takes, F.lit(False)), wider).otherwise(col("_found"))).withColumn("_quote", col("_found.quoted_span"))

    inside = F.coalesce(tx.contains_text(col("_quote"), col("hard_max_text")), F.lit(False))
    second = F.when(col("hard_max").isNotNull() & _blank(col("hard_max_quote")).isNotNull() & ~inside, quote("hard_max_quote"))
    seen = seen.withColumn("_second", second)
    hard_within = F.when(~failed(col("_second")), col("_second.quoted_span")).otherwise(col("_quote"))
    limit, ban, duty = (col("effect") == e for e in ("limit", "prohibit", "obligation"))
    reasons = [
        F.when(col("_found").isNull(), NOT_THERE),
        F.when(limit & col("parameter").isNull(), NO_PARAMETER),
        F.when(limit, _figure_problem(col("max"), col("value_text"), "max", col("_quote"), col("parameter"))),
        F.when(limit & col("_second").isNotNull() & failed(col("_second")), HARD_NOT_THERE),
        F.when(limit, _figure_problem(col("hard_max"), col("hard_max_text"), "hard_max", hard_within, col("parameter"))),
        F.when(limit & (col("hard_max") < col("max")), BELOW),
        F.when(limit & col("figure_year").isNotNull() & ~F.coalesce(F.regexp_like(col("_quote"), F.concat(F.lit(r"\b"), col("figure_year").cast("string"), F.lit(r"\b"))), F.lit(False)), NO_YEAR),
        F.when(ban & ~col("_quote").rlike(FORBIDS), NO_BAN_WORDS),
        F.when(duty & _blank(col("obligation_text")).isNull(), NO_DUTY),
        F.when(duty & ~col("_quote").rlike(REQUIRES), NO_DUTY_WORDS),
    ]
    judged = seen.withColumn("reason", F.coalesce(*reasons))
    marker = F.nullif(F.regexp_extract("_quote", CONDITIONAL, 1), F.lit(""))
    moves = F.coalesce(col("cap_can_rise"), F.lit(False)) | col("_quote").rlike(ADJUSTABLE) | F.concat_ws(" ", F.coalesce("key_value", F.lit("")), F.coalesce("requirement", F.lit(""))).rlike(ADJUSTABLE)
    only = lambda cond, value: F.when(cond, value)
    record = F.struct(
        F.concat_ws(":", "rule_id", "effect", F.substring(F.sha2("_quote", 256), 1, 6)).alias("constraint_id"), "rule_id", "action", "effect", only(limit, col("parameter")).alias("parameter"),
        only(limit, col("max")).alias("max"), only(limit & col("max").isNotNull(), col("value_text")).alias("value_text"), only(limit, col("hard_max")).alias("hard_max"),
        only(limit & col("hard_max").isNotNull(), col("hard_max_text")).alias("hard_max_text"), only(limit, col("_second.quoted_span")).alias("hard_max_quote"), only(limit, moves).alias("open_above"), only(limit, col("figure_year")).alias("figure_year"),
        only(ban, F.coalesce(_blank(col("elements_untestable")), F.concat(F.lit('the quoted text names "'), marker, F.lit('"')))).alias("elements_untestable"), only(duty, _blank(col("obligation_text"))).alias("obligation_text"),
        col("_quote").alias("evidence_quote"), col("_found.span_start").alias("span_start"), (col("_found.span_start") + F.length("_quote")).alias("span_end"), col("_found.method").alias("verification_method"),
        F.when(limit & (col("max").isNotNull() | col("hard_max").isNotNull()), "parsed").otherwise("none").alias("value_check"),
    )
    return judged.withColumn("constraint", F.when(col("reason").isNull(), record)).drop("_own", "_repaired", "_wider", "_found", "_quote", "_second")


def accepted(judged: DataFrame) -> DataFrame:
    """The constraints to store, each id once: of a rule's proposals with one quote and effect the first by number stands."""
    return judged.filter("constraint IS NOT NULL").groupBy("constraint.constraint_id").agg(F.min_by("constraint", "proposal_no").alias("c")).select("c.*")


def withheld_counts(judged: DataFrame) -> DataFrame:
    """(effect, reason, n): how often each refusal was given; figures in reasons are left out."""
    plain = F.regexp_replace("reason", r'(: ".*"|read as .*)$', "")
    return judged.filter("reason IS NOT NULL").groupBy("effect", plain.alias("reason")).agg(F.count("*").alias("n"))
