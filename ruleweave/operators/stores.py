"""Stores of candidates, constraints and sources: cells, merges of runs, rejections, known gaps, counts and comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleweave.operators.common import broadcast_if_small


def cells(candidates: DataFrame) -> DataFrame:
    """(jurisdiction, category, ids): the candidates of each cell, in id order. A cell's ids are few by nature."""
    return candidates.groupBy("jurisdiction", "category").agg(F.array_sort(F.collect_list("candidate_id")).alias("ids"))


def bucket_by_team_id(groups: DataFrame) -> DataFrame:
    """(cell, team_rule_id, member_ids, pick): groups whose primaries name one rule put together; the first group's pick stays.

    groups: (cell, group_no, member_ids, primary_id, team_rule_id).
    """
    members = F.array_sort(F.collect_list(F.struct("group_no", "member_ids")))
    per = groups.groupBy("cell", "team_rule_id").agg(members.alias("m"), F.min_by("primary_id", "group_no").alias("pick"))
    return per.select("cell", "team_rule_id", F.flatten(F.transform("m", lambda x: x["member_ids"])).alias("member_ids"), "pick")


def replace_by_document(old: DataFrame, fresh: DataFrame, processed: DataFrame, doc: str = "source_doc_id") -> DataFrame:
    """What a partial run leaves: old rows of documents it did not process, and the fresh ones."""
    return old.join(processed.select(doc).distinct(), doc, "left_anti").select(old.columns).unionByName(fresh)


def merge_constraints(old: DataFrame, fresh: DataFrame, done_rules: DataFrame, rules: DataFrame) -> DataFrame:
    """Old constraints of rules that still exist and were not done again, and the fresh ones. All name a rule by rule_id."""
    kept = old.join(done_rules.select("rule_id").distinct(), "rule_id", "left_anti").join(rules.select(F.col("team_rule_id").alias("rule_id")).distinct(), "rule_id", "left_semi")
    return kept.select(old.columns).unionByName(fresh)


def move_rejected(constraints: DataFrame, rejected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The constraints that stay, and those a review rejected, with a reason. rejected: (constraint_id, reason)."""
    small = broadcast_if_small(rejected.groupBy("constraint_id").agg(F.max("reason").alias("_why")))
    gone = constraints.join(small, "constraint_id").withColumn("reason", F.concat(F.lit("rejected in lead review: "), F.col("_why"))).drop("_why")
    return constraints.join(small, "constraint_id", "left_anti"), gone


def counts_by(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n"))


def without(rows: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """Keys of rows that nothing in others has: rules without a constraint, addresses without a result."""
    return rows.select(key).distinct().join(others.select(key).distinct(), key, "left_anti")


def compare_sets(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """(key, side): what is missing from the actual keys, and what is in them unexpected."""
    one = lambda a, b, side: without(a, b, key).withColumn("side", F.lit(side))
    return one(expected, actual, "missing").unionByName(one(actual, expected, "unexpected"))


def is_readable(status: Column, text_file: Column, supplemental: Column) -> Column:
    """Whether a listed source can be read: its text was supplied, or it was captured."""
    return F.coalesce((status == "ok") & (text_file != ""), F.lit(False)) | F.coalesce(supplemental, F.lit(False))


def source_counts(manifest: DataFrame) -> DataFrame:
    """(jurisdiction, sources_read, sources_unreadable) of a manifest with readable."""
    return manifest.groupBy("jurisdiction").agg(F.count_if("readable").alias("sources_read"), F.count_if(~F.col("readable")).alias("sources_unreadable"))


def known_gaps(manifest: DataFrame, selections: DataFrame, rules: DataFrame, categories: list[str]) -> DataFrame:
    """(jurisdiction, category, text): what is unknown rather than empty, the first reason of each.

    First, labels (label, case_id, jurisdiction, category) that select no rule; then jurisdictions of which no listed
    source is readable, for each category without a stored rule.
    """
    have = rules.select("jurisdiction", "category").distinct()
    named = selections.filter("jurisdiction IS NOT NULL AND category IS NOT NULL").join(have, ["jurisdiction", "category"], "left_anti")
    first = named.groupBy("jurisdiction", "category").agg(F.min(F.struct("case_id", "label")).alias("c"))
    named_so = F.replace("category", F.lit("_"), F.lit(" "))
    said = F.concat(F.col("jurisdiction"), F.lit(": no "), named_so, F.lit(" rule could be extracted, although change test "), F.col("c.case_id"), F.lit(" names "), F.col("c.label"), F.lit("."))
    by_label = first.select("jurisdiction", "category", F.lit(1).alias("rank"), said.alias("text"))
    closed = source_counts(manifest).filter("sources_read = 0 AND jurisdiction <> ''")
    each = closed.withColumn("category", F.explode(F.array(*map(F.lit, categories)))).join(have, ["jurisdiction", "category"], "left_anti")
    none = F.concat(F.col("jurisdiction"), F.lit(": none of its "), F.col("sources_unreadable").cast("string"), F.lit(" listed sources could be read, and no "), named_so, F.lit(" rule is stored for it."))
    by_source = each.select("jurisdiction", "category", F.lit(2).alias("rank"), none.alias("text"))
    return by_label.unionByName(by_source).groupBy("jurisdiction", "category").agg(F.min_by("text", "rank").alias("text"))


def timing_quantiles(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """Median and largest of a measure."""
    return rows.groupBy(*by).agg(F.percentile(value, 0.5).alias("median"), F.max(value).alias("largest"))


def clamp(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))
