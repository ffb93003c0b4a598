"""How each rule came to its result for a request, step by step.

Steps are made from what the one evaluation of a rule gave: its status, the verdict, reason and deciding conditions of its
coverage, the precedence found in its window and the findings of its constraints. Nothing is decided again. Rules that reach
a place and those that don't come from two joins with the small rule table, so no step needs a shuffle of its own.

Defined cases: a request whose category has no rule has no trace; a rule without constraints for the action leaves what it
requires to review; a request without a value is one of no value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleweave.functions.logic import let
from ruleweave.operators.answers import explained, filled
from ruleweave.operators.apply import results_for
from ruleweave.operators.common import broadcast_if_small, level_of, state_of
from ruleweave.operators.decide import judge_limit

STEP = "struct<check:string,outcome:string,detail:string>"
FINDING = "struct<kind:string,code:string,constraint_no:int,detail:string>"
# The sentences of findings.
LIMITS = {
    "other_year": "The source states the limit{text} for {year}; the figure for {asked} is not in the data. The request is {shown}.",
    "within": "{shown} is within the limit of {max} {unit}{text}.",
    "over_all": "{shown} exceeds the highest limit the text allows in any case, {hard} {unit}{hard_text}.",
    "over": "{shown} exceeds the limit of {max} {unit}{text}.",
    "between": "The limit is {max} {unit}{text} in general and up to {hard} {unit}{hard_text} in cases the data cannot tell apart. The request is {shown}.",
    "moves": "The limit of {max} {unit}{text} may be adjusted upward over time and the adjusted figure is not in the data. The request is {shown}.",
    "none": "The limit{any_text} cannot be computed from the data. The request is {shown}.",
}
PROHIBITS = "{citation} prohibits this action."
CONDITIONAL = "A ban that holds only together with elements the engine cannot observe: {elements}."


def plain_number(value: Column) -> Column:
    """A number without a fraction of zero."""
    return F.when(value == F.floor(value), F.floor(value).cast("string")).otherwise(value.cast("string"))


def told_constraints(constraints: DataFrame) -> DataFrame:
    """(team_rule_id, action, told): each rule's constraints in their order with their wordings."""
    one = F.struct(
        "constraint_no", "effect", "max", "hard_max", "open_above", "figure_year", "elements_untestable", "value_text", "hard_max_text", "obligation_text", "evidence_quote",
    )
    return constraints.groupBy(F.col("rule_id").alias("team_rule_id"), "action").agg(F.array_sort(F.collect_list(one)).alias("told"))


def limit_detail(c: Column, value: Column, as_of: Column, unit: Column) -> Column:
    """Why a limit is kept, broken or open."""
    said = lambda text: F.coalesce(F.concat(F.lit(' "'), text, F.lit('"')), F.lit(""))
    kind = judge_limit(c, value, as_of)
    name = (
        F.when(F.coalesce(c["figure_year"] != F.year(as_of), F.lit(False)), "other_year").when(kind == "satisfied", "within")
        .when((kind == "violated") & F.coalesce(value > c["hard_max"], F.lit(False)), "over_all").when(kind == "violated", "over")
        .when(c["max"].isNotNull() & c["hard_max"].isNotNull(), "between").when(c["max"].isNotNull() & c["open_above"], "moves").otherwise("none")
    )
    template = F.element_at(F.create_map(*[F.lit(x) for pair in LIMITS.items() for x in pair]), name)
    return filled(
        template, any_text=said(F.coalesce(c["value_text"], c["hard_max_text"], c["evidence_quote"])), text=said(c["value_text"]), hard_text=said(c["hard_max_text"]), year=c["figure_year"], asked=F.year(as_of),
        shown=F.coalesce(F.concat(plain_number(value), F.lit(" "), unit), F.lit("no value")), max=plain_number(c["max"]), hard=plain_number(c["hard_max"]), unit=unit,
    )


def findings(told: Column, value: Column, as_of: Column, unit: Column, citation: Column, requirement: Column) -> Column:
    """What each constraint of an applying rule says about a request, in words; without any, the rule needs review."""

    def one(c: Column) -> Column:
        ban = c["effect"] == "prohibit"
        firm = c["elements_untestable"].isNull()
        kind = F.when(ban, F.when(firm, "violated").otherwise("review")).when(c["effect"] == "limit", judge_limit(c, value, as_of)).when(c["effect"] == "obligation", "obligation")
        code = F.when(kind == "review", F.when(ban, "conditional_prohibition").otherwise("limit_not_computable"))
        detail = (
            F.when(ban & firm, filled(PROHIBITS, citation=citation)).when(ban, filled(CONDITIONAL, elements=c["elements_untestable"]))
            .when(c["effect"] == "limit", limit_detail(c, value, as_of, unit)).otherwise(F.coalesce(c["obligation_text"], requirement))
        )
        return F.struct(kind.alias("kind"), code.alias("code"), c["constraint_no"].alias("constraint_no"), detail.alias("detail")).cast(FINDING)

    missing = F.struct(F.lit("review").alias("kind"), F.lit("constraint_not_modeled").alias("code"), F.lit(None).cast("int").alias("constraint_no"), requirement.alias("detail")).cast(FINDING)
    found = F.filter(F.transform(told, one), lambda x: x["kind"].isNotNull())
    return F.when(F.coalesce(F.size(told), F.lit(0)) <= 0, F.array(missing)).otherwise(found)


def _step(check: str, outcome: str | Column, detail: Column) -> Column:
    return F.struct(F.lit(check).alias("check"), (F.lit(outcome) if isinstance(outcome, str) else outcome).alias("outcome"), detail.alias("detail")).cast(STEP)


def _steps(units: Column) -> Column:
    col = F.col
    place, texts = F.coalesce("legal_city", "state"), F.array_join("cov.deciding", "; ")
    unresolved, failed = col("reason_code") == "jurisdiction_unresolved", col("status") == "failed"
    covers = filled("The rule covers {rule}, which includes {place}.", rule=col("jurisdiction"), place=place)
    unknown_city = filled("The rule covers {rule}; the property's city could not be resolved within {state}.", rule=col("jurisdiction"), state=col("state"))
    first = F.when(unresolved, _step("jurisdiction", "unknown", unknown_city)).otherwise(_step("jurisdiction", "matched", covers))
    status = _step("status", F.when(col("status") == "in_force", "matched").otherwise("not_matched"), filled("On {as_of} the rule is {status}.", as_of=col("as_of"), status=F.replace("status", F.lit("_"), F.lit(" "))))
    unmet, exempt, is_open = (F.coalesce(x, F.lit(False)) for x in (col("cov.reason") == "requirement_not_met", col("cov.reason") == "exempt", col("cov.value").isNull()))
    coverage = (
        F.when(unmet, _step("coverage", "not_matched", F.concat(F.lit("A coverage requirement is not met: "), texts)))
        .when(is_open, _step("coverage", "unknown", F.concat(F.lit("Cannot be settled from the data: "), texts)))
        .otherwise(_step("coverage", "matched", F.lit("The coverage requirements are met.")))
    )
    no_exemption = F.concat(F.lit("No stated exemption is established"), F.when(is_open, " (some cannot be tested from the data)").otherwise(""), F.lit("."))
    exemption = F.when(
        col("cov.exempts"),
        F.when(exempt, _step("exemption", "matched", F.concat(F.lit("An exemption holds: "), texts))).otherwise(_step("exemption", F.when(is_open, "unknown").otherwise("not_matched"), no_exemption)),
    )
    displaced, undecided = col("result") == "superseded", col("reason_code") == "local_coverage_unknown"
    why = F.when(displaced | undecided, col("explanation")).otherwise(F.coalesce("conflict_note", F.lit("Possible conflict with another rule.")))
    precedence = F.when(displaced | undecided | col("conflict_flag"), _step("precedence", F.when(displaced, "matched").otherwise("unknown"), why))
    outcome = lambda f: F.when(f["kind"] == "review", "unknown").when(f["kind"] == "satisfied", "not_matched").otherwise("matched")
    nothing = _step("constraint", "not_matched", F.lit("The verified constraints have no effect on this action."))
    judged = findings(col("told"), col("value"), col("as_of"), units, col("citation"), col("requirement"))
    constraint = F.when(
        col("result") == "applies", let(judged, lambda fs: F.when(F.size(fs) == 0, F.array(nothing)).otherwise(F.transform(fs, lambda f: _step("constraint", outcome(f), f["detail"]))))
    ).otherwise(F.array().cast(f"array<{STEP}>"))
    whole = F.concat(F.array_compact(F.array(first, status, coverage, exemption, precedence)), constraint)
    return F.when(failed | unresolved, F.array(first, status)).otherwise(whole)


def trace(requests: DataFrame, rules: DataFrame, constraints: DataFrame, units: dict[str, str]) -> DataFrame:
    """(address_id, as_of, action, value, rule_id, title, result, steps) of every rule that reaches a request's place in its category.

    requests are places with action and value; units names the unit of each action's parameter.
    """
    told = broadcast_if_small(told_constraints(constraints))
    results = explained(results_for(requests, rules, told=True)).join(told, ["team_rule_id", "action"], "left")
    unit = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in units.items() for x in pair]), F.col("action")), F.lit(""))
    return results.select("address_id", "as_of", "action", "value", F.col("team_rule_id").alias("rule_id"), "title", "result", _steps(unit).alias("steps"))


def trace_outside(requests: DataFrame, rules: DataFrame) -> DataFrame:
    """The same of the category's rules that don't reach the place: one step says where the rule holds and where the place is."""
    known = rules.select(F.col("category").alias("action"), F.col("team_rule_id").alias("rule_id"), "title", "jurisdiction")
    every = requests.join(broadcast_if_small(known), "action")
    level = level_of(F.col("jurisdiction"))
    reached = F.when(level == "state", F.col("jurisdiction") == F.col("state")).otherwise(
        F.coalesce(F.col("jurisdiction") == F.col("legal_city"), F.lit(False)) | ((F.col("method") == "unresolved") & (state_of(F.col("jurisdiction")) == F.col("state")))
    )
    where = filled("The rule covers {rule}; the property is in {place}.", rule=F.col("jurisdiction"), place=F.coalesce("legal_city", "state"))
    steps = F.array(_step("jurisdiction", "not_matched", where))
    return every.filter(~F.coalesce(reached, F.lit(False))).select("address_id", "as_of", "action", "value", "rule_id", "title", F.lit("not_applicable").alias("result"), steps.alias("steps"))
