"""What lists, forms and notes show: fields of rules and candidates, messages of inputs, first of repeats, samples, notes of cases.

Defined cases: null inputs of a form count as empty; of rows with one key and place in the order the least whole row stands;
an empty table gives an empty result, but a case without results still has its notes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ruleweave.functions.dates import date_floor, derive_status, is_full_date
from ruleweave.operators.answers import plural

# The messages of a form.
BAD_DATE = "Enter the date as year-month-day, for example 2026-10-01."
SHOWN = ("team_rule_id", "jurisdiction", "level", "category", "status", "title", "requirement", "citation", "legal_status", "enacted_date", "effective_date", "conflict_flag", "conflict_note")
TOLD = ("id", "title", "citation", "requirement", "key_value", "legal_status", "enacted_date", "effective_date", "source_doc_id", "source_origin")


def rule_view(rules: DataFrame, as_of: Column) -> DataFrame:
    """What is shown of a rule: its fields, its level and its status on the day."""
    level = F.when(F.contains("jurisdiction", F.lit(",")), "city").otherwise("state")
    status = derive_status(*[F.col(c) for c in ("legal_status", "enacted_date", "effective_date", "repeal_date")], as_of)
    seen = rules.withColumns({"level": level, "status": status})
    return seen.select(*[c for c in SHOWN if c in seen.columns])


def candidate_payload(candidates: DataFrame) -> DataFrame:
    """What is told of a candidate when its cell is grouped."""
    return candidates.select(F.col("candidate_id").alias("id"), *[c for c in TOLD if c in candidates.columns])


def date_problem(text: Column) -> Column:
    """Why a text is no full date; null if it is one."""
    return F.when(~is_full_date(F.coalesce(text, F.lit(""))), BAD_DATE)


def parameter_problem(text: Column, label: str, unit: str, low: float, high: float, low_excluded: bool = True) -> Column:
    """Why a text is no amount of a parameter; null if it is one."""
    said = F.trim(F.coalesce(text, F.lit("")))
    n = F.when(said.rlike(r"^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$"), said.try_cast("double"))
    low_text, high_text = f"{low:g}", f"{high:g}"
    under = n <= low if low_excluded else n < low
    return (
        F.when(said == "", f"Enter {label.lower()} in {unit}.").when(n.isNull(), f"{label} must be a number of {unit}.")
        .when(under, f"{label} must be {'more than' if low_excluded else 'at least'} {low_text} {unit}.").when(n > high, f"{label} must be at most {high_text} {unit}.")
    )


def require_date(text: Column) -> Column:
    """The text if it is a full date; the query fails where it is not."""
    return F.when(is_full_date(F.coalesce(text, F.lit(""))), text).otherwise(F.raise_error(F.concat(F.lit("Query date must be YYYY-MM-DD, got: "), F.coalesce(text, F.lit("null")))).cast("string"))


def dedupe_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the order, summed up where its rows are."""
    one = F.struct(*order, *[c for c in rows.columns if c not in order])
    return rows.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.min(one).alias("_r")).select("_r.*").select(*rows.columns)


def sample_message(items: Column, n: int = 5) -> Column:
    """The first items and, if there are more, how many there are in all."""
    more = F.when(F.size(items) > n, F.concat(F.lit(", ... ("), F.size(items).cast("string"), F.lit(" total)"))).otherwise("")
    return F.concat(F.array_join(F.slice(items, 1, n), ", "), more)


def tracked_cases(cases: DataFrame) -> DataFrame:
    """(case_id, last_day, place): each case at the latest of its dates, in order of that date; those whose latest is no full date are left out."""
    last = cases.groupBy("case_id").agg(F.max("date").alias("last_day")).filter(is_full_date(F.col("last_day")))
    return last.withColumn("place", F.row_number().over(W.orderBy("last_day", "case_id")))


def upcoming_first(rows: DataFrame) -> DataFrame:
    """Rules not yet in effect, the soonest first; those without a date last."""
    return rows.filter("status = 'not_yet_effective'").orderBy(F.asc_nulls_last("effective_date"), "team_rule_id")


def suggestions(rows: DataFrame, found: Column, order: list[str], n: int = 8) -> DataFrame:
    """The first rows that a search shows."""
    return rows.filter(found).orderBy(*order).limit(n)


def share_of_span(day: Column, start: Column, end: Column) -> Column:
    """Where a day lies between two, from 0 to 1; partial dates count from their first day."""
    of = lambda d: F.unix_date(date_floor(d))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (of(day) - of(start)) / (of(end) - of(start))))


def case_notes(cases: DataFrame, rules: DataFrame, per_date: DataFrame, scopes: DataFrame, sets: DataFrame) -> DataFrame:
    """(case_id, notes): what a case selected, where and when it was evaluated and what came out.

    cases: (case_id, type, rule_ids, dates, states); per_date: (case_id, as_of, result, n); scopes: (case_id, n), the places looked
    at; sets: (case_id, n_affected, n_flagged).
    """
    named = cases.select("case_id", F.posexplode("rule_ids").alias("pos", "team_rule_id")).join(rules.select("team_rule_id", "title", "legal_status"), "team_rule_id", "left")
    is_rule = F.concat(F.col("team_rule_id"), F.lit(' is "'), "title", F.lit('" (legal status '), "legal_status", F.when(F.col("legal_status") == "failed", "; the rule failed and is not in force").otherwise(""), F.lit(")."))
    told = named.groupBy("case_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "team_rule_id", F.when(F.col("title").isNotNull(), is_rule).otherwise(F.concat("team_rule_id", F.lit(" resolved to no rule."))).alias("said"), F.col("title").isNotNull().alias("known")))).alias("picks")
    )
    counts = per_date.groupBy("case_id", "as_of").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("result", "n"))), lambda x: F.concat(x["result"], F.lit(" "), x["n"].cast("string"))), ", ").alias("said"))
    by_date = counts.groupBy("case_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("as_of").cast("string"), "said"))).alias("counts"))
    joined = cases.join(told, "case_id", "left").join(by_date, "case_id", "left").join(scopes.withColumnRenamed("n", "n_scope"), "case_id", "left").join(sets, "case_id", "left")
    dates = F.array_distinct("dates")
    picked = F.transform("picks", lambda p: F.concat(p["team_rule_id"], F.lit(" -> "), F.when(p["known"], p["team_rule_id"]).otherwise("no rule")))
    selected = F.concat(F.lit("Selected "), F.coalesce(F.nullif(F.array_join(picked, "; "), F.lit("")), F.lit("nothing")), F.lit("."))
    when = F.when(F.col("type") == "as_of", F.array_join(dates, " and ")).otherwise(F.get(dates, F.lit(0)))
    where = F.when(F.size("states") > 0, F.concat(F.lit(" in "), F.array_join("states", ", "))).otherwise("")
    evaluated = F.concat(F.lit("Evaluated on "), when, F.lit(" over "), plural(F.coalesce("n_scope", F.lit(0)), "address", "addresses"), where, F.lit("."))
    results = F.transform(dates, lambda d: F.concat(F.lit("Results on "), d, F.lit(": "), F.coalesce(F.try_element_at("counts", d), F.lit("none")), F.lit(".")))
    ended = F.concat(plural(F.coalesce("n_affected", F.lit(0)), "address", "addresses"), F.lit(" affected, "), F.coalesce("n_flagged", F.lit(0)).cast("string"), F.lit(" flagged for conflict."))
    none = F.array().cast("array<string>")
    parts = F.concat(F.array(selected), F.coalesce(F.transform("picks", lambda p: p["said"]), none), F.array(evaluated), results, F.array(ended))
    return joined.select("case_id", F.array_join(parts, " ").alias("notes"))
