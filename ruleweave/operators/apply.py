"""Which rules reach which places on which dates, with precedence and conflicts.

``places`` has address_id, state, legal_city, method, units, year_built and as_of (a date): every row is one
question, so several dates are just several rows.  ``rules`` is the rule table.  Only pairs that can matter are
made: a state rule meets the places of its state, a city rule those of its city, and, where a place's city is
unresolved, those of its state.  Every other pair is not_applicable by outside_jurisdiction and is never built;
counts of them follow from the table sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ruleweave.functions.dates import date_floor, status_on
from ruleweave.functions.logic import coverage, let, missing_facts, prepare, unknown_reason
from ruleweave.operators.common import broadcast_if_small, level_of, state_of

PAIR = ["address_id", "as_of"]


def applicability_join(places: DataFrame, rules: DataFrame) -> DataFrame:
    """places joined with the rules that reach them; city_unknown marks pairs of an unresolved city.

    One equi-join on a place's reaching keys: its state's rules, its city's, or all city rules of its state. Where
    places carry an action, a key also names the category of rules it asks about, so rules of others are never joined;
    precedence only looks within a category.
    """
    level, state = level_of(F.col("jurisdiction")), state_of(F.col("jurisdiction"))
    keyed = rules.withColumns({"level": level, "_key": F.explode(F.when(level == "state", F.array(F.concat(F.lit("s:"), "jurisdiction"))).otherwise(F.array(F.concat(F.lit("c:"), "jurisdiction"), F.concat(F.lit("u:"), state))))})
    if "action" in places.columns:
        keyed = keyed.withColumn("_key", F.concat("_key", F.lit("|"), "category"))
    unresolved = F.col("method") == "unresolved"
    keys = F.array_compact(F.array(F.concat(F.lit("s:"), "state"), F.concat(F.lit("c:"), "legal_city"), F.when(unresolved, F.concat(F.lit("u:"), "state"))))
    if "action" in places.columns:
        keys = F.transform(keys, lambda k: F.concat(k, F.lit("|"), F.col("action")))
    reach = places.withColumn("_key", F.explode(keys))
    joined = reach.join(broadcast_if_small(keyed), "_key").withColumn("city_unknown", F.startswith(F.col("_key"), F.lit("u:")))
    # A city that is known although the method says unresolved would match twice; the unknown one counts.
    twice = unresolved & F.startswith(F.col("_key"), F.lit("c:"))
    return joined.filter(~F.coalesce(twice, F.lit(False))).drop("_key")


def prepared(rules: DataFrame) -> DataFrame:
    """The rule table with the first days of its dates and its conditions' thresholds, computed once a rule."""
    first = {f"_{c}_on": date_floor(F.col(f"{c}_date")) for c in ("enacted", "effective", "repeal")}
    return rules.withColumns({**first, "_requires": prepare(F.col("requires")), "_exempt": F.transform("exempt_if", prepare)})


def apply_rules(places: DataFrame, rules: DataFrame, told: bool = False) -> DataFrame:
    """result, reason_code, missing_facts and caveats of each reaching pair, each rule on its own.

    Asked to tell, it also gives cov: the coverage's value, its reason, the deciding conditions' texts and whether there are
    exemptions, all out of the one evaluation.
    """
    pairs = applicability_join(places, prepared(rules))
    status = status_on(F.col("legal_status"), F.col("_enacted_on"), F.col("_effective_on"), F.col("_repeal_on"), F.col("as_of"))
    none = F.array().cast("array<string>")

    def judged(e: Column) -> Column:
        status, covered, unknown = e["status"], e["cov"]["value"], e["cov"]["unknown"]
        steps: list[tuple[Column, str, Column]] = [
            (status == "failed", "not_applicable", F.lit("status_failed")),
            (F.col("city_unknown"), "unknown", F.lit("jurisdiction_unresolved")),
            (~covered, "not_applicable", e["cov"]["reason"]),
            (status == "pending", "pending", F.lit("status_pending")),
            (status == "not_yet_effective", "not_yet_effective", F.lit("status_not_yet_effective")),
            (covered, "applies", F.lit("covered")),
        ]
        answer = F.struct(F.lit("unknown").alias("result"), unknown_reason(unknown).alias("reason_code"), missing_facts(unknown).alias("missing_facts"))
        for cond, name, code in reversed(steps):
            missing = F.array(F.lit("legal_city")) if name == "unknown" else missing_facts(unknown) if name in ("pending", "not_yet_effective") else none
            answer = F.when(cond, F.struct(F.lit(name).alias("result"), code.alias("reason_code"), missing.alias("missing_facts"))).otherwise(answer)
        heard = F.when((status == "failed") | F.col("city_unknown"), none).otherwise(e["cov"]["caveats"])
        cov = [F.struct(e["cov"]["value"].alias("value"), e["cov"]["reason"].alias("reason"), e["cov"]["deciding"].alias("deciding"), (F.size("_exempt") > 0).alias("exempts")).alias("cov")] if told else []
        return F.struct(status.alias("status"), answer.alias("answer"), heard.alias("caveats"), *cov)

    cov = coverage(*[F.col(c) for c in ("_requires", "_exempt", "units", "year_built", "as_of")])
    found = pairs.withColumn("_found", let(F.struct(status.alias("status"), cov.alias("cov")), judged))
    kept = [c for c in found.columns if not c.startswith("_") and c not in ("city_unknown", "requires", "exempt_if")]
    return found.select(*kept, "_found.status", "_found.answer.result", "_found.answer.reason_code", "_found.answer.missing_facts", "_found.caveats", *(["_found.cov"] if told else []))


def apply_precedence(results: DataFrame, told: bool = False) -> DataFrame:
    """Results after local rules displace yielding state rules, with conflict flags and notes.

    Asked to tell, it also gives local: the local rule of the lowest id that displaces a rule or leaves it open.
    All rules of one place, date and category are one window: a handful of rows, however many places there are.
    """
    group = W.partitionBy(*PAIR, "category")
    city, state = F.col("level") == "city", F.col("level") == "state"
    any_of = lambda cond: F.coalesce(F.max(cond).over(group), F.lit(False))
    local_applies, local_unknown = any_of(city & (F.col("result") == "applies")), any_of(city & (F.col("result") == "unknown"))
    yields = state & (F.col("relation") == "yields_to_stricter_local")
    displaced = yields & F.col("result").isin("applies", "unknown") & local_applies
    undecided = yields & (F.col("result") == "applies") & ~local_applies & local_unknown
    if told:
        known = F.struct("team_rule_id", "title", "jurisdiction")
        first = lambda result: F.min(F.when(city & (F.col("result") == result), known)).over(group)
        results = results.withColumn("local", F.when(displaced, first("applies")).when(undecided, first("unknown")))
    changed = results.withColumns({"_displaced": displaced, "_undecided": undecided})
    ranked = changed.withColumns(
        {
            "result": F.when(F.col("_displaced"), "superseded").when(F.col("_undecided"), "unknown").otherwise(F.col("result")),
            "reason_code": F.when(F.col("_displaced"), "superseded_by_local").when(F.col("_undecided"), "local_coverage_unknown").otherwise(F.col("reason_code")),
            "missing_facts": F.when(F.col("_displaced") | F.col("_undecided"), F.array().cast("array<string>")).otherwise(F.col("missing_facts")),
        }
    ).drop("_displaced", "_undecided")
    here = F.col("result") != "not_applicable"
    bars = state & (F.col("relation") == "preempts_local") & here
    known = F.struct("team_rule_id", "title", "jurisdiction")
    others = lambda cond: F.array_sort(F.collect_list(F.when(cond, known)).over(group))
    met = ranked.withColumns({"_locals": others(city & here), "_bars": others(bars)})
    name = lambda x: F.concat(F.lit("Possible conflict with "), x["title"], F.lit(" ("), x["jurisdiction"], F.lit(", "), x["team_rule_id"], F.lit(")"))
    from_state = F.when(bars, F.transform("_locals", lambda x: F.concat(name(x), F.lit(": this rule's text bars conflicting local ordinances."))))
    from_city = F.when(city & here, F.transform("_bars", lambda x: F.concat(name(x), F.lit(", which bars conflicting local ordinances."))))
    none = F.array().cast("array<string>")
    found = F.coalesce(from_state, from_city, none)
    own = F.when(F.col("conflict_flag") & F.col("conflict_note").isNotNull(), F.array("conflict_note")).otherwise(none)
    noted = met.withColumns({"_found": found, "_parts": F.concat(own, found)})
    flagged = here & (F.col("conflict_flag") | (F.size("_found") > 0))
    return noted.withColumns(
        {"conflict_flag": flagged, "conflict_note": F.when(flagged & (F.size("_parts") > 0), F.array_join("_parts", " "))}
    ).drop("_locals", "_bars", "_found", "_parts")


def results_for(places: DataFrame, rules: DataFrame, told: bool = False) -> DataFrame:
    """apply_rules and apply_precedence together."""
    return apply_precedence(apply_rules(places, rules, told), told)


def result_counts(results: DataFrame, n_places: DataFrame, n_rules: int) -> DataFrame:
    """(as_of, result, n), the pairs outside a rule's jurisdiction counted from the table sizes.

    n_places: (as_of, places).
    """
    made = results.groupBy("as_of", "result").agg(F.count("*").alias("n"))
    total = made.groupBy("as_of").agg(F.sum("n").alias("made"))
    outside = n_places.join(total, "as_of", "left").select("as_of", F.lit("not_applicable").alias("result"), (F.col("places") * n_rules - F.coalesce("made", F.lit(0))).alias("n"))
    return made.unionByName(outside).groupBy("as_of", "result").agg(F.sum("n").alias("n")).filter("n > 0")
