"""One envelope of a request over all that it leaves open: the amount, each fact the record lacks, and the calendar.

Every candidate is a point, a row of the request with one thing changed: the amounts' own point, a unit count or a year
beside a threshold, a day on which a rule or a dated figure changes. Rules are applied once over all points. At each point a
rule row judges every end of the amount axis, as a mask of what its constraints say there; the masks of a point's rules meet
in one window, which gives the decisions, and from them the bound between two unequal neighbours is tied to the first
constraint whose rule takes part in either. Points of an axis are then joined while their outcomes have one shape.

The three shuffles are by a place's rules, by point and by request. What belongs to jurisdictions and categories (days,
thresholds, gaps) is looked up in small tables, so days never need a join back.

Defined cases: a request with a value keeps it on the fact and time axes, one without is open and sweeps the amounts there
too; a fact axis is there only where the fact is missing and some rule's review says it would settle it; a request that no
rule reaches has one interval and one span; equal days carry all their causes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ruleweave.functions.dates import date_floor, is_full_date
from ruleweave.functions.logic import let
from ruleweave.operators.apply import results_for
from ruleweave.operators.common import broadcast_if_small
from ruleweave.operators.decide import RANK, judge, with_gaps
from ruleweave.operators.envelope import amount_ends
from ruleweave.operators.trace import told_constraints

FACTS = ("units", "year_built")
#: The earliest year that is tried, and the least number of units.
FLOORS = {"units": 1, "year_built": 1600}
VIOLATED, REVIEW, DUTY, KEPT = 8, 4, 2, 1
MARK = "struct<rule_id:string,seq:int,day:date,label:string>"
POINT = "struct<axis:string,k:int,fact:int,day:date,to_day:date,causes:array<string>,labels:array<string>>"


def marks(rules: DataFrame, constraints: DataFrame) -> DataFrame:
    """(jurisdiction, action, marks): the days on which a jurisdiction's rules of a category change, with rule and label."""
    own = rules.filter("legal_status <> 'failed'")
    events = F.array(*[F.struct(F.lit(i).alias("seq"), F.col(f"{c}_date").alias("said"), F.lit(w).alias("what")) for i, (c, w) in enumerate((("enacted", "is enacted"), ("effective", "takes effect"), ("repeal", "is repealed")))])
    each = own.select("jurisdiction", F.col("category").alias("action"), F.col("team_rule_id").alias("rule_id"), "title", F.explode(events).alias("e")).filter(is_full_date(F.col("e.said")))
    of_rules = each.select("jurisdiction", "action", "rule_id", "e.seq", date_floor(F.col("e.said")).alias("day"), F.concat_ws(" ", "title", "e.what").alias("label"))
    figures = constraints.filter("figure_year IS NOT NULL").select("constraint_no", "rule_id", "action", "figure_year")
    cited = own.select("jurisdiction", F.col("category").alias("action"), F.col("team_rule_id").alias("rule_id"), "citation").join(broadcast_if_small(figures), ["rule_id", "action"])
    ends = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), (F.col("figure_year") + i).alias("y"), F.lit(w).alias("what")) for i, w in enumerate(("starts to apply", "stops applying"))]))
    said = F.concat(F.lit("the figure "), "citation", F.lit(" states for "), F.col("figure_year").cast("string"), F.lit(" "), F.col("e.what"))
    of_figures = cited.withColumn("e", ends).select("jurisdiction", "action", "rule_id", (3 + 2 * F.col("constraint_no") + F.col("e.i")).alias("seq"), F.make_date("e.y", F.lit(1), F.lit(1)).alias("day"), said.alias("label"))
    one = F.struct("rule_id", "seq", "day", "label").cast(MARK)
    return of_rules.unionByName(of_figures).groupBy("jurisdiction", "action").agg(F.array_sort(F.collect_list(one)).alias("marks"))


def thresholds(rules: DataFrame) -> DataFrame:
    """(action, units, years, ages): the distinct thresholds of a category's conditions."""
    each = rules.select(F.col("category").alias("action"), F.explode(F.concat("requires", F.flatten("exempt_if"))).alias("c"))
    of = lambda fact, value, name: F.collect_set(F.when(F.col("c.fact") == fact, value)).alias(name)
    return each.groupBy("action").agg(of("units", F.col("c.value"), "_units"), of("year_built", F.substring("c.date", 1, 4).cast("int"), "_years"), of("building_age_years", F.col("c.years"), "_ages"))


def _around(values: Column, fact: str) -> Column:
    """Each value and its two neighbours, distinct and in order."""
    three = F.flatten(F.transform(values, lambda v: F.array(v - 1, v, v + 1)))
    return F.array_sort(F.array_distinct(F.filter(three, lambda v: v >= FLOORS[fact])))


def points(requests: DataFrame, rules: DataFrame, constraints: DataFrame, gaps: DataFrame) -> DataFrame:
    """A row a point: the request's place with one thing changed, its id a struct(address_id, axis, k), and base, what the request is."""
    days = broadcast_if_small(marks(rules, constraints))
    placed = with_gaps(requests, gaps).join(broadcast_if_small(thresholds(rules)), "action", "left")
    for level in ("state", "legal_city"):
        placed = placed.join(days.select(F.col("jurisdiction").alias(level), "action", F.col("marks").alias(f"_{level}")), [level, "action"], "left")
    none = lambda kind: F.array().cast(f"array<{kind}>")
    placed = placed.withColumn("_marks", F.array_sort(F.concat(F.coalesce("_state", none(MARK)), F.coalesce("_legal_city", none(MARK)))))
    placed = placed.withColumn("_days", F.array_sort(F.array_distinct(F.transform("_marks", lambda m: m["day"]))))
    null = F.lit(None)

    def point(axis: str, k: Column, fact: Column = null, day: Column = null, to_day: Column = null, on: Column | None = None) -> Column:
        own = none(MARK) if on is None else on
        causes, labels = (F.array_distinct(F.transform(own, lambda m: m[f])) for f in ("rule_id", "label"))
        return F.struct(F.lit(axis).alias("axis"), k.cast("int").alias("k"), fact.cast("int").alias("fact"), day.cast("date").alias("day"), to_day.cast("date").alias("to_day"), causes.alias("causes"), labels.alias("labels")).cast(POINT)

    ages = F.transform(F.coalesce("_ages", none("double")), lambda a: F.year("as_of") - a.cast("int"))
    tried = {
        "units": F.array_sort(F.array_distinct(F.concat(F.array(F.lit(FLOORS["units"])), _around(F.coalesce("_units", none("int")), "units")))),
        "year_built": _around(F.concat(F.coalesce("_years", none("int")), ages), "year_built"),
    }
    of_fact = lambda f: F.transform(tried[f], lambda v, i: point(f, i, fact=v))
    every = [F.array(point("amount", F.lit(0)))]
    every += [F.when(F.col(f).isNull(), of_fact(f)).otherwise(none(POINT)) for f in FACTS]
    starts = F.concat(F.array(null.cast("date")), F.col("_days"))
    on = lambda d: F.filter("_marks", lambda m: m["day"] == d)
    every.append(F.transform(starts, lambda d, i: point("time", i, day=d, to_day=F.date_sub(F.get("_days", i), 1), on=F.when(d.isNotNull(), on(d)).otherwise(none(MARK)))))
    base = F.struct("as_of", "value", "units", "year_built", F.size("gaps").alias("n_gaps")).alias("base")
    rows = placed.select("address_id", "state", "legal_city", "method", "action", "units", "year_built", "as_of", base, F.explode(F.concat(*every)).alias("point"))
    axis = F.col("point.axis")
    changed = {f: F.when(axis == f, F.col("point.fact")).otherwise(F.col(f)) for f in FACTS}
    changed["as_of"] = F.when(axis == "time", F.coalesce("point.day", "point.to_day", "as_of")).otherwise(F.col("as_of"))
    return rows.withColumns({**changed, "address_id": F.struct("address_id", axis.alias("axis"), F.col("point.k").alias("k"))})


def _mask(value: Column) -> Column:
    """What a rule row says at an amount, as bits."""

    def bits(found: Column) -> Column:
        bit = lambda kind, n: F.when(F.exists(found, lambda x: x["kind"] == kind), n).otherwise(0)
        broken = F.exists(found, lambda x: x["kind"] == "violated")
        open_ = F.when(F.exists(found, lambda x: x["kind"] == "review") | (F.col("conflict_flag") & ~broken), REVIEW).otherwise(0)
        return bit("violated", VIOLATED) + open_ + bit("obligation", DUTY) + bit("satisfied", KEPT)

    return F.when(F.col("result") == "applies", let(judge(F.col("told"), value, F.col("as_of")), bits)).when(F.col("result") == "unknown", REVIEW).otherwise(0)


def _rank(mask: Column) -> Column:
    return F.when(mask >= VIOLATED, RANK["BLOCK"]).when(mask >= REVIEW, RANK["REVIEW"]).when(mask >= DUTY, RANK["REQUIRE"]).otherwise(RANK["PASS"])


def _determines(decision: Column, mask: Column) -> Column:
    """Whether a rule row fixes a decision."""
    has = lambda bits: mask.bitwiseAND(F.lit(bits)) > 0
    return F.when(decision == RANK["BLOCK"], has(VIOLATED)).when(decision == RANK["REVIEW"], has(REVIEW)).when(decision == RANK["REQUIRE"], has(DUTY | KEPT)).otherwise(has(KEPT))


def outcomes(rows: DataFrame, rules: DataFrame, constraints: DataFrame, ends: list[float]) -> DataFrame:
    """Of every point: d, the decisions' ranks at the ends; fixed, that at the request's value; bounds, the constraint behind
    each change; and which facts a review asks for."""
    told = broadcast_if_small(told_constraints(constraints))
    results = results_for(rows, rules).join(told, ["team_rule_id", "action"], "left")
    at = [F.lit(float(e)) for e in ends] + [F.col("base.value")]
    n = len(ends)
    kept = ["address_id", "point", "base"]
    masks = {f"m{i}": _mask(v) for i, v in enumerate(at)}
    bound = "struct<constraint_no:int,rule_id:string,citation:string,text:string>"

    def bounding(end: float) -> Column:
        own = F.filter("told", lambda c: (c["max"] == end) | (c["hard_max"] == end))
        text = lambda c: F.when(c["max"] == end, c["value_text"]).otherwise(c["hard_max_text"])
        return F.get(F.transform(own, lambda c: F.struct(c["constraint_no"], F.col("team_rule_id"), F.col("citation"), text(c)).cast(bound)), F.lit(0))

    asks = {f"asks_{f}": (F.col("result") == "unknown") & F.array_contains("missing_facts", f) for f in FACTS}
    judged = results.select(*kept, *[m.alias(k) for k, m in masks.items()], *[a.alias(k) for k, a in asks.items()], *[bounding(e).alias(f"c{i}") for i, e in enumerate(ends[:-1])])
    alone = rows.select(*kept)  # a point that no rule reaches is there all the same
    both = judged.unionByName(alone, allowMissingColumns=True)
    same = W.partitionBy("address_id")
    gap = F.when(F.col("base.n_gaps") > 0, RANK["REVIEW"]).otherwise(RANK["PASS"])
    ranked = both.withColumns({f"d{i}": F.greatest(F.max(F.coalesce(_rank(F.col(f"m{i}")), F.lit(0))).over(same), gap) for i in range(n + 1)})
    began = None
    bounds = {}
    for i in range(n - 1):
        fixes = _determines(F.col(f"d{i}"), F.col(f"m{i}"))
        began = fixes if began is None else F.when(F.col(f"d{i - 1}") != F.col(f"d{i}"), fixes).otherwise(began)
        next_open = F.col(f"m{i + 1}").bitwiseAND(F.lit(REVIEW)) > 0
        part = began | next_open | _determines(F.col(f"d{i + 1}"), F.col(f"m{i + 1}"))
        bounds[f"b{i}"] = F.when((F.col(f"d{i}") != F.col(f"d{i + 1}")) & part, F.col(f"c{i}"))
    met = ranked.select(*kept, *[f"d{i}" for i in range(n + 1)], *asks, *[b.alias(k) for k, b in bounds.items()]).groupBy("address_id")
    sums = [F.first("point").alias("point"), F.first("base").alias("base"), *[F.first(f"d{i}").alias(f"d{i}") for i in range(n + 1)]]
    sums += [F.coalesce(F.bool_or(a), F.lit(False)).alias(a) for a in asks] + [F.min(b).alias(b) for b in bounds]
    null = F.lit(None).cast(bound)
    found = met.agg(*sums)
    arrays = F.array(*[F.col(f"d{i}") for i in range(n)]).cast("array<int>"), F.array(*[F.col(b) for b in bounds], null)
    return found.select("address_id", "point", "base", *asks, F.col(f"d{n}").alias("fixed"), arrays[0].alias("d"), arrays[1].alias("bounds"))


def _intervals(low: float, ends: list[float]) -> Column:
    """The amount axis of a point, neighbours of one decision joined: a bound ends its interval, which holds it."""
    names = F.array(*map(F.lit, sorted(RANK, key=RANK.get)))
    to = F.array(*[F.lit(float(e)) for e in ends])
    d = F.col("d")
    lasts = F.filter(F.sequence(F.lit(0), F.lit(len(ends) - 1)), lambda j: F.coalesce(F.get(d, j) != F.get(d, j + 1), F.lit(True)))

    def each(lasts: Column) -> Column:
        one = lambda j, t: F.struct(
            F.coalesce(F.get(to, F.get(lasts, t - 1)), F.lit(float(low))).alias("from"), F.get(to, j).alias("to"), F.get(names, F.get(d, j)).alias("decision"),
            F.get(d, j).isin(RANK["PASS"], RANK["REQUIRE"]).alias("permit"), F.get(F.col("bounds"), j).alias("bound"),
        )
        return F.transform(lasts, one)

    return let(lasts, each)


def envelope(requests: DataFrame, rules: DataFrame, constraints: DataFrame, gaps: DataFrame, action: str, limits: tuple[float, float] | None) -> DataFrame:
    """One row a request (address_id, as_of, with the action and a value or none): decision, permitted, reason, decides and timeline.

    limits are the ends of the action's parameter, the lower one excluded; none for an action without one. permitted holds the
    amount intervals at the request's date, each with the constraint that ends it. decides holds, for each fact asked
    for, the regions of its values, and timeline the spans of days with what causes each; both with a decision, or with
    intervals where the amount is open.
    """
    ends = amount_ends(constraints, action, *limits) if limits else []
    low = limits[0] if limits else 0.0
    own = rules.filter(F.col("category") == action)
    found = outcomes(points(requests, own, constraints, gaps), own, constraints, ends)
    names = F.array(*map(F.lit, sorted(RANK, key=RANK.get)))
    kind = "array<struct<from:double,to:double,decision:string,permit:boolean,bound:struct<constraint_no:int,rule_id:string,citation:string,text:string>>>"
    intervals = (_intervals(low, ends) if ends else F.lit(None)).cast(kind)
    is_open = F.col("base.value").isNull() if limits else F.lit(False)
    flat = found.select(F.col("address_id.address_id").alias("address_id"), F.col("address_id.axis").alias("axis"), F.col("address_id.k").alias("k"), "point", "base", *[f"asks_{f}" for f in FACTS], intervals.alias("amounts"), F.get(names, F.col("fixed")).alias("at_value"))
    shaped = flat.withColumns({"decision": F.when(~is_open, F.col("at_value")), "intervals": F.when(is_open, F.col("amounts"))})
    shape = F.concat_ws("|", F.coalesce("decision", F.lit("")), F.array_join(F.transform("intervals", lambda i: F.concat_ws(":", i["from"], i["to"], i["decision"])), ","))
    request = ["address_id", F.col("base.as_of")]
    whole = W.partitionBy(*request)
    asked = lambda f: F.max(F.when(F.col("axis") == "amount", F.col(f"asks_{f}"))).over(whole)
    wanted = shaped.withColumns({"shape": shape, **{f"_{f}": asked(f) for f in FACTS}})
    for f in FACTS:
        wanted = wanted.filter((F.col("axis") != f) | F.coalesce(F.col(f"_{f}"), F.lit(False)))
    order = W.partitionBy(*request, "axis").orderBy("k")
    kept = wanted.withColumn("_new", ~F.coalesce(F.lag("shape").over(order) == F.col("shape"), F.lit(False))).filter("_new")
    after = lambda c: F.lead(c).over(order)
    spans = kept.withColumns({"to_fact": after("point.fact") - 1, "to_day": F.date_sub(after("point.day"), 1)})
    year_open = (F.col("axis") == "year_built") & (F.row_number().over(order) == 1)
    spans = spans.withColumn("from_fact", F.when(~year_open, F.col("point.fact")))
    region = F.struct("k", F.col("from_fact").alias("from"), F.col("to_fact").alias("to"), "decision", "intervals")
    as_of = F.col("base.as_of")
    current = F.coalesce(F.col("point.day") <= as_of, F.lit(True)) & F.coalesce(as_of <= F.col("to_day"), F.lit(True))
    span = F.struct("k", F.col("point.day").alias("from"), F.col("to_day").alias("to"), current.alias("current"), "decision", "intervals", F.col("point.causes").alias("causes"), F.array_join("point.labels", "; ").alias("label"))
    rows = spans.select("address_id", as_of.alias("as_of"), "axis", region.alias("region"), span.alias("span"), "decision", "amounts").groupBy("address_id", "as_of")
    amount = F.col("axis") == "amount"
    one = rows.agg(
        F.max(F.when(amount, F.col("decision"))).alias("decision"),
        F.first(F.when(amount, F.col("amounts")), ignorenulls=True).alias("permitted"),
        *[F.array_sort(F.collect_list(F.when(F.col("axis") == f, F.col("region")))).alias(f"by_{f}") for f in FACTS],
        F.array_sort(F.collect_list(F.when(F.col("axis") == "time", F.col("span")))).alias("timeline"),
    )
    permits = F.exists("permitted", lambda i: i["permit"])
    reason = F.when(F.col("permitted").isNotNull() & ~permits, F.when(F.exists("permitted", lambda i: i["decision"] == "REVIEW"), "bound_not_computable").otherwise("prohibited"))
    return one.withColumn("reason", reason)
