"""Three-valued conditions over facts known to an interval.

A condition is a struct(fact, op, date, years, value, name, text).  Its value is a nullable boolean: null means
that the data cannot tell.  AND and OR over arrays are Spark's own three-valued forall and exists, so an absent
list must be an empty array.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ruleweave.functions.dates import date_ceil, date_floor, minus_months

CONDITION = "struct<fact:string,op:string,date:string,years:double,value:int,name:string,text:string>"
OPS = ("lt", "lte", "gt", "gte", "eq")
REVERSED = {"lt": "gt", "lte": "gte", "gt": "lt", "gte": "lte", "eq": "eq"}


def compare(op: Column, a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    """op between fact [a1, a2] and threshold [b1, b2]: true or false only if it is so for all their values."""
    sure = lambda yes, no: F.when(yes, True).when(no, False)
    return (
        F.when(op == "lt", sure(a2 < b1, a1 >= b2))
        .when(op == "lte", sure(a2 <= b1, a1 > b2))
        .when(op == "gt", sure(a1 > b2, a2 <= b1))
        .when(op == "gte", sure(a1 >= b2, a2 < b1))
        .when(op == "eq", sure((a1 == a2) & (b1 == b2) & (a1 == b1), (a2 < b1) | (a1 > b2)))
    )


def reverse_op(op: Column) -> Column:
    return F.when(op.isin("lt", "lte"), F.regexp_replace(op, "^l", "g")).when(op.isin("gt", "gte"), F.regexp_replace(op, "^g", "l")).otherwise(op)


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def day(date: Column) -> Column:
    return F.unix_date(date)


def prepare(conditions: Column) -> Column:
    """Conditions with their thresholds as whole numbers, made once a rule instead of once a pair.

    A date becomes the days of its two edges; an age keeps its months and reverses its operator, as an age
    over N years is a building date under the day N years ago.
    """

    def one(c: Column) -> Column:
        low, high = day(date_floor(c["date"])), day(date_ceil(c["date"]))
        dated = c["fact"] == "year_built"
        aged = c["fact"] == "building_age_years"
        b1 = F.when(dated, F.when(c["op"].isin("lte", "gt"), high).otherwise(low)).otherwise(c["value"])
        b2 = F.when(dated, F.when(c["op"].isin("lt", "gte"), low).otherwise(high)).otherwise(c["value"])
        months = F.floor(c["years"] * 12 + 0.5).cast("int")
        op = F.when(aged, reverse_op(c["op"])).otherwise(c["op"])
        return F.struct(c["fact"].alias("fact"), op.alias("op"), b1.alias("b1"), b2.alias("b2"), months.alias("months"), c["name"].alias("name"), c["text"].alias("text"))

    return F.transform(conditions, one)


def evaluate(c: Column, units: Column, year_built: Column, as_of: Column, caveat: bool, units_min: Column | None = None, units_max: Column | None = None) -> Column:
    """struct(value, kind, fact, text) of one prepared condition; kind and fact say why a value is unknown.

    caveat is what a caveat counts as: true among requirements, false in an exemption group. With units_min
    and units_max, bounds may settle a condition on an unknown number of units.
    """
    counts, aged = c["fact"] == "units", c["fact"] == "building_age_years"
    least = units if units_min is None else F.coalesce(units, units_min)
    most = units if units_min is None else F.coalesce(units, F.when(units_min.isNotNull(), F.coalesce(units_max, F.lit(2**31 - 1))))
    a1 = F.when(counts, least).otherwise(day(F.make_date(year_built, F.lit(1), F.lit(1))))
    a2 = F.when(counts, most).otherwise(day(F.make_date(year_built, F.lit(12), F.lit(31))))
    cutoff = day(minus_months(as_of, c["months"]))
    b1, b2 = F.when(aged, cutoff).otherwise(c["b1"]), F.when(aged, cutoff).otherwise(c["b2"])
    compared = let(F.struct(a1.alias("a1"), a2.alias("a2"), b1.alias("b1"), b2.alias("b2")), lambda x: compare(c["op"], x["a1"], x["a2"], x["b1"], x["b2"]))
    value = F.when(c["fact"] == "caveat", F.lit(caveat)).when(c["fact"] != "unavailable", compared)
    kind = F.when(c["fact"] == "unavailable", "unavailable").when(counts | year_built.isNull(), "missing").otherwise("ambiguous")
    fact = F.when(c["fact"] == "unavailable", c["name"]).when(counts, "units").when(year_built.isNull(), "year_built")
    return let(value, lambda v: F.struct(v.alias("value"), F.when(v.isNull(), kind).alias("kind"), F.when(v.isNull(), fact).alias("fact"), c["text"].alias("text")))


def coverage(requires: Column, exempt_if: Column, units: Column, year_built: Column, as_of: Column, **bounds: Column) -> Column:
    """struct(value, reason, unknown, caveats, deciding): whether a rule covers the facts, and why not or why unknown.

    requires and exempt_if hold prepared conditions. deciding has the conditions that fixed the verdict, out of the same
    values: the requirements that fail, those of the exemptions that hold, the open ones, or all requirements.
    """
    needed = F.transform(requires, lambda c: evaluate(c, units, year_built, as_of, True, **bounds))
    groups = F.transform(exempt_if, lambda g: F.transform(g, lambda c: evaluate(c, units, year_built, as_of, False, **bounds)))
    met = lambda items: F.forall(items, lambda x: x["value"])
    unknown = lambda items: F.filter(items, lambda x: x["value"].isNull())
    texts = lambda items: F.transform(F.filter(items, lambda c: c["fact"] == "caveat"), lambda c: c["text"])

    def judged(e: Column) -> Column:
        required, exempt = met(e["needed"]), F.exists(e["groups"], met)
        failing, holding = F.filter(e["needed"], lambda x: ~x["value"]), F.flatten(F.filter(e["groups"], lambda g: met(g)))
        open_groups = F.flatten(F.transform(F.filter(e["groups"], lambda g: met(g).isNull()), unknown))
        still_open = F.concat(unknown(e["needed"]), open_groups)
        deciding = F.when(~required, failing).when(exempt, holding).when((required & ~exempt).isNull(), still_open).otherwise(e["needed"])
        return F.struct(
            (required & ~exempt).alias("value"),
            F.when(~required, "requirement_not_met").when(exempt, "exempt").alias("reason"),
            still_open.alias("unknown"),
            F.transform(deciding, lambda x: x["text"]).alias("deciding"),
            F.array_distinct(F.concat(texts(requires), texts(F.flatten(exempt_if)))).alias("caveats"),
        )

    return let(F.struct(needed.alias("needed"), groups.alias("groups")), judged)


def missing_facts(unknown: Column) -> Column:
    """Sorted distinct facts of unknown conditions that name one."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(unknown, lambda x: x["fact"]), lambda f: f.isNotNull())))


def unknown_reason(unknown: Column) -> Column:
    has = lambda kind: F.exists(unknown, lambda x: x["kind"] == kind)
    return F.when(has("missing"), "missing_fact").when(has("ambiguous"), "cutoff_ambiguous").otherwise("unverifiable_condition")
