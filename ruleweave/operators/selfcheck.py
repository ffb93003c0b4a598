"""What is wrong with an export, in words, and the change case that a document's rules make.

Each kind of failure is a table of those it concerns, counted in place, of which the first few are named in their order; so no
list of all that failed is ever made. A kind without any gives no row.

Defined cases: empty lookups concern every address; null dates make no case of two dates; an empty table gives no failure but
the missing rules'.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleweave.functions.dates import date_ceil
from ruleweave.operators.common import broadcast_if_small

#: How many of a kind are named.
NAMED = 5
# The sentences of the failures; {n} is how many there are and {first} the first of them.
KINDS = {
    "orphan_rows": "lookup row(s) point at a rule that is not exported: {first}", "uncovered": "lookups do not cover address(es): {first}", "unresolved": "{n} unresolved jurisdiction stack(s): {first}",
    "inactive": "pending or failed rule(s) with an affirmative or open result: {first}", "not_in_force": '"applies" result for rule(s) not in force at {as_of}: {first}',
    "stale": "exported rule(s) whose quote does not match the source document: {first}", "no_rules": "zero rules exported",
}


def told(found: DataFrame, name: str, kind: str, order: str | None = None, **values: Column) -> DataFrame:
    """(kind, n, text) of the distinct names of a kind of failure; no row where there are none."""
    each = found.select(F.col(name).cast("string").alias("name"), F.col(order or name).alias("order")).distinct()
    first = each.orderBy("order", "name").limit(NAMED).agg(F.array_sort(F.collect_list(F.struct("order", "name"))).alias("f"))
    both = each.agg(F.count("*").alias("n")).join(first)  # one row each
    named = F.array_join(F.transform("f", lambda x: x["name"]), ", ")
    said = F.concat(named, F.when(F.col("n") > NAMED, F.concat(F.lit(", ... ("), F.col("n").cast("string"), F.lit(" total)"))).otherwise(""))
    text = F.lit(KINDS[kind])
    for k, v in {"n": F.col("n").cast("string"), "first": said, **values}.items():
        text = F.replace(text, F.lit("{" + k + "}"), v)
    return both.filter("n > 0").select(F.lit(kind).alias("kind"), "n", text.alias("text"))


def failures(records: DataFrame, lookups: DataFrame, addresses: DataFrame, stacks: DataFrame, as_of: Column, stale: DataFrame | None = None) -> DataFrame:
    """(kind, n, text): each kind of failure of an export.

    records: (team_rule_id, status) of exported rules; lookups: (address_id, team_rule_id, result); addresses: (address_id);
    stacks: (address_id, method); stale: (team_rule_id) of rules whose quote is no longer in its source.
    """
    known = broadcast_if_small(records.select("team_rule_id", "status"))
    rows = lookups.join(known, "team_rule_id", "left")
    pair = F.concat(F.col("address_id").cast("string"), F.lit("->"), "team_rule_id")
    open_results = F.col("result").isin("applies", "unknown", "superseded")
    found = [
        told(rows.filter("status IS NULL").withColumn("name", pair), "name", "orphan_rows"),
        told(addresses.join(lookups.select("address_id").distinct(), "address_id", "left_anti"), "address_id", "uncovered"),
        told(stacks.filter("method = 'unresolved'"), "address_id", "unresolved"),
        told(rows.filter(F.col("status").isin("pending", "failed") & open_results).withColumn("name", F.concat("team_rule_id", F.lit(" is "), "status", F.lit(" but has result "), "result")), "name", "inactive"),
        told(rows.filter("result = 'applies' AND status <> 'in_force'").withColumn("name", F.concat("team_rule_id", F.lit(" ("), "status", F.lit(")"))), "name", "not_in_force", as_of=as_of.cast("string")),
        records.agg(F.count("*").alias("n")).filter("n = 0").select(F.lit("no_rules").alias("kind"), F.col("n"), F.lit(KINDS["no_rules"]).alias("text")),
    ]
    if stale is not None:
        found.append(told(stale, "team_rule_id", "stale"))
    return reduce(DataFrame.unionByName, found)


def cases_of_documents(rules: DataFrame, as_of: Column) -> DataFrame:
    """(doc, type, before, after): the change case of each document that rules come from or are supported by.

    If some of its rules take effect after the day, the case compares the day with that after the last of them; else it
    looks at the day alone. rules has source_doc_id, also_supported_by (an array) and effective_date.
    """
    cited = rules.select("effective_date", F.explode(F.array_distinct(F.concat(F.array("source_doc_id"), F.coalesce("also_supported_by", F.array().cast("array<string>"))))).alias("doc"))
    last = cited.groupBy("doc").agg(F.max(date_ceil(F.col("effective_date"))).alias("last"))
    later = F.coalesce(F.col("last") > as_of, F.lit(False))
    return last.select("doc", F.when(later, "as_of").otherwise("boundary").alias("type"), as_of.alias("before"), F.when(later, F.date_add("last", 1)).alias("after"))
