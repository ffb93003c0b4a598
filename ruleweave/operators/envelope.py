"""Envelopes: a decision swept over an amount, a missing fact and the calendar, equal neighbours joined.

Each sweep turns its candidate points into rows (an amount is a value, a fact or a date is a place row), decides
all of them in one job, and joins neighbours of equal outcome by a running count of changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ruleweave.functions.dates import date_floor, is_full_date
from ruleweave.operators.apply import applicability_join, results_for
from ruleweave.operators.decide import decide


def islands(points: DataFrame, keys: list[str], order: str, same: str) -> DataFrame:
    """points with island, the number of changes of ``same`` so far within keys."""
    w = W.partitionBy(*keys).orderBy(order)
    changed = F.when(F.lag(same).over(w).eqNullSafe(F.col(same)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return points.withColumn("_changed", changed).withColumn("island", F.sum("_changed").over(w)).drop("_changed")


def _decided(places: DataFrame, rules: DataFrame, constraints: DataFrame, gaps: DataFrame, values: list[float | None]) -> DataFrame:
    """Decisions of places (with action) at each of the values; rules are applied once for all of them."""
    results = results_for(places, rules)
    each = F.explode(F.array(*[F.lit(v).cast("double") for v in values]))
    return decide(places.withColumn("value", each), results.withColumn("value", each), constraints, gaps)


def amount_ends(constraints: DataFrame, action: str, low: float, high: float) -> list[float]:
    """Ends of the intervals between which no limit of the action changes its verdict; constraints are a small table."""
    bounds = constraints.filter(F.col("action") == action).select(F.explode(F.array_compact(F.array("max", "hard_max"))).alias("b")).distinct()
    return sorted(r["b"] for r in bounds.filter((F.col("b") > low) & (F.col("b") < high)).collect()) + [high]


def amount_axis(places: DataFrame, rules: DataFrame, constraints: DataFrame, gaps: DataFrame, low: float, high: float, action: str, keys: list[str] | None = None) -> DataFrame:
    """keys, from_value, to_value and decision: the action's amount axis cut where the decision changes.

    An interval holds its upper end; the first starts above low.
    """
    keys = keys or ["address_id", "as_of"]
    points = _decided(places, rules, constraints, gaps, amount_ends(constraints, action, low, high))
    joined = islands(points, keys, "value", "decision").groupBy(*keys, "island").agg(F.max("value").alias("to_value"), F.first("decision").alias("decision"))
    before = F.lag("to_value").over(W.partitionBy(*keys).orderBy("to_value"))
    return joined.withColumn("from_value", F.coalesce(before, F.lit(low))).drop("island")


def permit_reason(intervals: DataFrame) -> DataFrame:
    """Why no amount is permitted: a bound that cannot be computed, or a ban; null where one is."""
    return intervals.groupBy("address_id", "as_of").agg(
        F.when(F.bool_or(F.col("decision").isin("PASS", "REQUIRE")), None).when(F.bool_or(F.col("decision") == "REVIEW"), "bound_not_computable").otherwise("prohibited").alias("reason")
    )


def unit_candidates(rules: DataFrame, category: str) -> list[int]:
    """Unit counts around every threshold of the category's rules; between them no condition changes."""
    conditions = rules.filter(F.col("category") == category).select(F.explode(F.concat("requires", F.flatten("exempt_if"))).alias("c"))
    around = conditions.filter("c.fact = 'units'").select(F.explode(F.array(F.col("c.value") - 1, F.col("c.value"), F.col("c.value") + 1)).alias("v"))
    return sorted({1, *(r["v"] for r in around.filter("v >= 1").distinct().collect())})


def units_axis(places: DataFrame, rules: DataFrame, constraints: DataFrame, gaps: DataFrame, action: str, value: float | None) -> DataFrame:
    """from_units, to_units and decision for places that lack a unit count a rule's review asks for."""
    lacking = places.filter("units IS NULL")
    asked = _decided(lacking, rules, constraints, gaps, [value])
    asks = asked.filter(F.exists("rules", lambda r: F.array_contains(r["resolvable_by"], "units"))).select("address_id", "as_of")
    tried = lacking.join(asks, ["address_id", "as_of"], "left_semi").withColumn("units", F.explode(F.array(*[F.lit(v) for v in unit_candidates(rules, action)])))
    # A place asked with several counts is several places: the count becomes part of the id.
    keyed = tried.withColumns({"address_id": F.struct("address_id", "units")})
    points = _decided(keyed, rules, constraints, gaps, [value]).select("address_id.address_id", "as_of", F.col("address_id.units").alias("units"), "decision")
    joined = islands(points, ["address_id", "as_of"], "units", "decision").groupBy("address_id", "as_of", "island").agg(F.min("units").alias("from_units"), F.first("decision").alias("decision"))
    after = F.lead("from_units").over(W.partitionBy("address_id", "as_of").orderBy("from_units"))
    return joined.withColumn("to_units", after - 1).drop("island")


def change_points(places: DataFrame, rules: DataFrame) -> DataFrame:
    """(address_id, day, label, rule_id): full dates on which a rule that reaches a place is enacted, starts or ends."""
    reached = applicability_join(places, rules).filter("NOT city_unknown AND legal_status <> 'failed'")
    dated = reached.select("address_id", "category", "team_rule_id", "title", F.expr("stack(3, enacted_date, 'is enacted', effective_date, 'takes effect', repeal_date, 'is repealed') AS (said, what)"))
    full = dated.filter(is_full_date(F.col("said")))
    return full.select("address_id", "category", date_floor(F.col("said")).alias("day"), F.concat_ws(" ", "title", "what").alias("label"), F.col("team_rule_id").alias("rule_id")).distinct()


def timeline(places: DataFrame, rules: DataFrame, constraints: DataFrame, gaps: DataFrame, action: str, value: float | None) -> DataFrame:
    """from_day, to_day (null: open) and decision of each place over all dates. places has one row an address."""
    own = rules.filter(F.col("category") == action)
    years = constraints.filter((F.col("action") == action) & F.col("figure_year").isNotNull()).select(F.col("rule_id").alias("rule_id"), F.explode(F.array("figure_year", F.col("figure_year") + 1)).alias("y"))
    points = change_points(places, own).select("address_id", "day", "rule_id")
    reached = applicability_join(places, own).filter("NOT city_unknown AND legal_status <> 'failed'").select("address_id", F.col("team_rule_id").alias("rule_id"))
    figures = reached.join(F.broadcast(years), "rule_id").select("address_id", F.make_date(F.col("y"), F.lit(1), F.lit(1)).alias("day"), "rule_id")  # two rows a dated figure
    days = points.unionByName(figures).groupBy("address_id").agg(F.array_sort(F.collect_set("day")).alias("_days"))
    known = places.join(days, "address_id", "left").withColumn("_days", F.coalesce("_days", F.array().cast("array<date>")))
    spans = F.transform(
        F.concat(F.array(F.lit(None).cast("date")), F.col("_days")), lambda d, i: F.struct(d.alias("day"), F.date_sub(F.get("_days", i), 1).alias("to_day"))
    )
    asked = known.withColumn("_span", F.explode(spans)).withColumns({"day": F.col("_span.day"), "to_day": F.col("_span.to_day")}).drop("_days", "_span")
    asked = asked.withColumn("as_of", F.coalesce("day", "to_day", "as_of"))
    points = _decided(asked.drop("day", "to_day"), rules, constraints, gaps, [value]).select("address_id", "as_of", "decision")
    placed = asked.select("address_id", "as_of", "day", "to_day").join(points, ["address_id", "as_of"])
    joined = islands(placed, ["address_id"], "as_of", "decision").groupBy("address_id", "island").agg(
        F.min_by("day", "as_of").alias("from_day"), F.max_by("to_day", "as_of").alias("to_day"), F.first("decision").alias("decision")
    )
    return joined.drop("island")
