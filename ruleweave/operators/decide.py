"""PASS, REQUIRE, REVIEW or BLOCK for requests: results of rules against typed constraints.

A request is a row of places with an action and a value (null for actions without a parameter); its key is
address_id, as_of and value.  Constraints are few: they are put into one array a rule and joined once, so every
judgement is an expression over that array and the only shuffle is the grouping of a request's rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleweave.functions.dates import date_floor, is_full_date
from ruleweave.functions.logic import let
from ruleweave.operators.common import broadcast_if_small

KEY = ["address_id", "as_of", "value"]
RANK = {"PASS": 0, "REQUIRE": 1, "REVIEW": 2, "BLOCK": 3}
ITEM = "struct<kind:string,code:string,effect:string,constraint_no:int>"
SUPPLIABLE = ("units", "year_built")


def constraint_arrays(constraints: DataFrame) -> DataFrame:
    """(rule_id, action, cs): each rule's constraints in their order."""
    one = F.struct("constraint_no", "effect", "max", "hard_max", "open_above", "figure_year", "elements_untestable")
    return constraints.groupBy("rule_id", "action").agg(F.array_sort(F.collect_list(one)).alias("cs"))


def judge_limit(c: Column, value: Column, as_of: Column) -> Column:
    """violated, satisfied or review (not computable) for a limit."""
    above = F.coalesce(value > c["max"], F.lit(False))
    other_year = F.coalesce(c["figure_year"] != F.year(as_of), F.lit(False))
    return (
        F.when(other_year, "review")
        .when(value <= c["max"], "satisfied")
        .when(value > c["hard_max"], "violated")
        .when(above & c["hard_max"].isNull() & ~c["open_above"], "violated")
        .otherwise("review")
    )


def judge(cs: Column, value: Column, as_of: Column) -> Column:
    """Findings of one rule's constraints; a rule without any is itself a review item."""

    def one(c: Column) -> Column:
        limit = judge_limit(c, value, as_of)
        kind = F.when(c["effect"] == "prohibit", F.when(c["elements_untestable"].isNull(), "violated").otherwise("review")).when(c["effect"] == "limit", limit).when(c["effect"] == "obligation", "obligation")
        code = F.when(kind == "review", F.when(c["effect"] == "prohibit", "conditional_prohibition").otherwise("limit_not_computable"))
        return F.struct(kind.alias("kind"), code.alias("code"), c["effect"].alias("effect"), c["constraint_no"].alias("constraint_no")).cast(ITEM)

    found = F.filter(F.transform(cs, one), lambda x: x["kind"].isNotNull())
    return F.when(F.coalesce(F.size(cs), F.lit(0)) <= 0, F.array(_item("review", "constraint_not_modeled"))).otherwise(found)


def _item(kind: str, code: str | Column) -> Column:
    null = F.lit(None)
    return F.struct(F.lit(kind).alias("kind"), (F.lit(code) if isinstance(code, str) else code).alias("code"), null.cast("string").alias("effect"), null.cast("int").alias("constraint_no")).cast(ITEM)


def has(items: Column, kind: str) -> Column:
    return F.exists(items, lambda x: x["kind"] == kind)


def decision_of(items: Column) -> Column:
    """The decision findings alone give."""
    return F.when(has(items, "violated"), "BLOCK").when(has(items, "review"), "REVIEW").when(has(items, "obligation"), "REQUIRE").otherwise("PASS")


def rule_items(results: DataFrame, constraints: DataFrame) -> DataFrame:
    """Per request and rule: items (findings and review items), upcoming would_be, and what a review could be settled by.

    results are the rows of ``results_for`` with action and value.
    """
    arrays = broadcast_if_small(constraint_arrays(constraints).withColumnRenamed("rule_id", "team_rule_id"))
    joined = results.join(arrays, ["team_rule_id", "action"], "left")
    none = F.array().cast(f"array<{ITEM}>")
    flagged = lambda found: F.when(F.col("conflict_flag") & ~has(found, "violated"), F.array(_item("review", "conflict"))).otherwise(none)
    applying = let(judge(F.col("cs"), F.col("value"), F.col("as_of")), lambda found: F.concat(found, flagged(found)))
    code = F.when(F.col("reason_code").isin("missing_fact", "cutoff_ambiguous"), F.col("reason_code")).otherwise("unverifiable_condition")
    items = F.when(F.col("result") == "applies", applying).when(F.col("result") == "unknown", F.array(_item("review", code))).otherwise(none)
    starts = F.when(is_full_date(F.col("effective_date")), date_floor(F.col("effective_date"))).otherwise(F.col("as_of"))
    later = let(judge(F.col("cs"), F.col("value"), starts), decision_of)
    settled = F.when(F.col("result") == "unknown", F.array_intersect(F.array(*[F.lit(f) for f in SUPPLIABLE]), "missing_facts"))
    return joined.withColumns(
        {"items": items, "would_be": F.when((F.col("result") == "not_yet_effective") & F.col("cs").isNotNull(), later), "resolvable_by": F.coalesce(settled, F.array().cast("array<string>"))}
    )


def gap_counts(places: DataFrame, gaps: DataFrame) -> DataFrame:
    """Requests whose jurisdictions have a known gap in their category, with the number of gaps."""
    reach = places.select(*KEY, F.col("action").alias("category"), F.explode(F.array_compact(F.array("state", "legal_city"))).alias("jurisdiction"))
    return reach.join(broadcast_if_small(gaps), ["jurisdiction", "category"]).groupBy(*KEY).agg(F.count("*").alias("n_gaps"))


def with_gaps(places: DataFrame, gaps: DataFrame) -> DataFrame:
    """places with gaps, the sentences of the known gaps of their jurisdictions in their category, by jurisdiction.

    gaps: (jurisdiction, category, text). A place has two jurisdictions, so the small table is looked up twice.
    """
    said = broadcast_if_small(gaps.groupBy("jurisdiction", "category").agg(F.min("text").alias("text")))
    found = places
    for level in ("state", "legal_city"):
        one = said.select(F.col("jurisdiction").alias(level), F.col("category").alias("action"), F.struct("jurisdiction", "text").alias(f"_{level}_gap"))
        found = found.join(one, [level, "action"], "left")
    every = F.array_sort(F.array_compact(F.array("_state_gap", "_legal_city_gap")))
    return found.withColumn("gaps", F.transform(every, lambda g: F.coalesce(g["text"], F.lit("")))).drop("_state_gap", "_legal_city_gap")


def decide(places: DataFrame, results: DataFrame, constraints: DataFrame, gaps: DataFrame) -> DataFrame:
    """One row a request: decision, permit, its rules' items and the gaps it lies in.

    rules holds, for each rule with items or an upcoming result, its id, items, would_be and resolvable_by. Requests and
    their rules meet in one grouping by the key; a request without a rule is there by its own row.
    """
    rows = rule_items(results.filter(F.col("category") == F.col("action")), constraints)  # results of such places have no others
    one = F.struct("team_rule_id", "title", "result", "items", "would_be", "resolvable_by", "effective_date")
    kept = rows.filter((F.size("items") > 0) | F.col("result").isin("pending", "not_yet_effective")).select(*KEY, one.alias("_rule"))
    asked = with_gaps(places, gaps).select(*KEY, F.struct("legal_city", "action", "gaps").alias("_place"))
    both = kept.unionByName(asked, allowMissingColumns=True).groupBy(*KEY)
    met = both.agg(F.array_sort(F.collect_list("_rule")).alias("rules"), F.first("_place", ignorenulls=True).alias("_place"))
    filled = met.select(*KEY, "_place.legal_city", "_place.action", "rules", "_place.gaps").withColumn("n_gaps", F.size("gaps").cast("long"))
    alone = let(F.flatten(F.transform("rules", lambda r: r["items"])), decision_of)
    decision = let(alone, lambda d: F.when((F.col("n_gaps") > 0) & (d != "BLOCK"), "REVIEW").otherwise(d))
    return filled.withColumn("decision", decision).withColumn("permit", F.col("decision").isin("PASS", "REQUIRE"))


def determining(decided: DataFrame) -> DataFrame:
    """The rows that fixed each decision: violations, a review a rule, or duties and kept limits."""
    rows = decided.select(*KEY, "decision", F.explode("rules").alias("r")).select(*KEY, "decision", "r.team_rule_id", "r.title", F.posexplode("r.items").alias("pos", "i"))
    wanted = (
        ((F.col("decision") == "BLOCK") & (F.col("i.kind") == "violated"))
        | ((F.col("decision") == "REQUIRE") & F.col("i.kind").isin("obligation", "satisfied"))
        | ((F.col("decision") == "PASS") & (F.col("i.kind") == "satisfied"))
    )
    firm = rows.filter(wanted).select(*KEY, "decision", "team_rule_id", "title", F.col("i.effect").alias("effect"), F.col("i.kind").alias("outcome"), F.col("i.constraint_no").alias("constraint_no"))
    review = decided.filter("decision = 'REVIEW'").select(*KEY, "decision", F.explode("rules").alias("r"))
    first = F.get(F.filter("r.items", lambda x: x["kind"] == "review"), F.lit(0))
    open_rows = review.withColumn("i", first).filter("i IS NOT NULL").select(
        *KEY, "decision", "r.team_rule_id", "r.title", F.col("i.effect").alias("effect"), F.lit("unresolved").alias("outcome"), F.col("i.constraint_no").alias("constraint_no")
    )
    return firm.unionByName(open_rows)


def review_items(decided: DataFrame) -> DataFrame:
    """Every review item of every request; a known gap is one without a rule."""
    rows = decided.select(*KEY, F.explode("rules").alias("r")).select(*KEY, F.col("r.team_rule_id").alias("rule_id"), F.col("r.resolvable_by").alias("resolvable_by"), F.explode("r.items").alias("i"))
    ruled = rows.filter("i.kind = 'review'").select(*KEY, "rule_id", F.col("i.code").alias("code"), F.array_join("resolvable_by", ",").alias("resolvable_by"))
    gapped = decided.filter("n_gaps > 0").select(*KEY, F.lit(None).cast("string").alias("rule_id"), F.lit("coverage_gap").alias("code"), F.lit("").alias("resolvable_by"), F.explode(F.sequence(F.lit(1).cast("long"), "n_gaps")))
    return ruled.unionByName(gapped.drop("col"))


def obligations(decided: DataFrame) -> DataFrame:
    rows = decided.select(*KEY, F.explode("rules").alias("r")).select(*KEY, F.col("r.team_rule_id").alias("rule_id"), F.explode("r.items").alias("i"))
    return rows.filter("i.kind = 'obligation'").select(*KEY, "rule_id", F.col("i.constraint_no").alias("constraint_no"))


def upcoming(decided: DataFrame) -> DataFrame:
    """Rules that do not apply yet, and what an enacted one would decide."""
    rows = decided.select(*KEY, F.explode("rules").alias("r")).filter(F.col("r.result").isin("pending", "not_yet_effective"))
    return rows.select(*KEY, F.col("r.team_rule_id").alias("rule_id"), F.col("r.result").alias("status"), F.col("r.would_be").alias("would_be"))


def decision_counts(decided: DataFrame, *by: str) -> DataFrame:
    """How many requests got each decision; zero where none did."""
    names = {d: F.count_if(F.col("decision") == d).alias(f"n_{d.lower()}") for d in RANK}
    return decided.groupBy(*by).agg(*names.values())


def city_groups(decided: DataFrame) -> DataFrame:
    """Decision counts of each legal city; places without one are a group of their own, last."""
    per = decision_counts(decided.withColumn("city", F.coalesce("legal_city", F.lit("City not resolved"))), "city")
    return per.withColumn("last", F.col("city") == "City not resolved")
