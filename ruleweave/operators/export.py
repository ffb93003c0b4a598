"""Export rows, rule links, invariants and content versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleweave.operators.common import level_of, state_of


def lookup_rows(results: DataFrame) -> DataFrame:
    """Results that are exported: all but not_applicable."""
    return results.filter("result <> 'not_applicable'")


# The relations of a state rule's own precedence text that name local rules.
LOCAL_RELATIONS = ("yields_to_stricter_local", "preempts_local")


def rule_links(rules: DataFrame) -> DataFrame:
    """(team_rule_id, linked): a state rule whose relation names local rules and the city rules of its category, each way, in id order."""
    sides = rules.select("team_rule_id", "category", state_of(F.col("jurisdiction")).alias("state"), level_of(F.col("jurisdiction")).alias("level"), "relation")
    states = sides.filter((F.col("level") == "state") & F.col("relation").isin(*LOCAL_RELATIONS)).select(F.col("team_rule_id").alias("state_rule"), "category", "state")
    pairs = states.join(sides.filter("level = 'city'").select(F.col("team_rule_id").alias("city_rule"), "category", "state"), ["category", "state"])
    each = F.explode(F.array(F.struct(F.col("state_rule").alias("a"), F.col("city_rule").alias("b")), F.struct(F.col("city_rule").alias("a"), F.col("state_rule").alias("b"))))
    return pairs.select(each.alias("p")).groupBy(F.col("p.a").alias("team_rule_id")).agg(F.array_sort(F.collect_list("p.b")).alias("linked"))


def exportable_split(rules: DataFrame, docs: DataFrame) -> DataFrame:
    """rules with withheld: the first reason not to export a rule; null if there is none.

    rules has verified, quoted_span, span_start, span_end and source_doc_id; docs has doc_id and text.
    """
    literal = F.substr(F.col("text"), F.col("span_start") + 1, F.col("span_end") - F.col("span_start")) == F.col("quoted_span")
    joined = rules.join(docs.select(F.col("doc_id").alias("source_doc_id"), "text"), "source_doc_id", "left")
    why = F.when(~F.coalesce("verified", F.lit(False)), "not_verified").when(F.col("text").isNull(), "source_document_missing").when(~F.coalesce(literal, F.lit(False)), "quote_does_not_match_source")
    return joined.withColumn("withheld", why).drop("text")


def empty_cells(rules: DataFrame, categories: list[str]) -> DataFrame:
    """Jurisdiction and category pairs without any rule; the vocabularies are closed and short."""
    have = rules.groupBy("jurisdiction").agg(F.collect_set("category").alias("have"))
    every = F.array(*[F.lit(c) for c in categories])
    return have.select("jurisdiction", F.explode(F.array_except(every, "have")).alias("category"))


def selfcheck_metrics(rules: DataFrame, constraints: DataFrame, results: DataFrame) -> DataFrame:
    """(metric, n): counts and violations of invariants."""
    one = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("metric"), "n")
    by = lambda df, col, name: df.groupBy(col).agg(F.count("*").alias("n")).select(F.concat(F.lit(name + ":"), F.col(col)).alias("metric"), "n")
    distinct = lambda df, col, name: df.agg(F.count_distinct(col).alias("n")).select(F.lit(name).alias("metric"), "n")
    parts = [
        one(rules, "rules"), by(rules, "legal_status", "status"), by(rules, "category", "category"), one(constraints, "constraints"), distinct(constraints, "rule_id", "rules_with_constraint"),
        by(results, "result", "result"), distinct(results.filter("conflict_flag"), "team_rule_id", "conflict_rules"), one(results.filter("result = 'applies' AND status <> 'in_force'"), "inactive_affirmative"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def ruleset_version(content: DataFrame) -> DataFrame:
    """One digest of (team_rule_id, content) in id order; a rule table is small by nature."""
    lines = F.array_sort(F.collect_list(F.struct("team_rule_id", "content")))
    return content.agg(lines.alias("l")).select(F.sha2(F.array_join(F.transform("l", lambda x: F.concat_ws("=", x["team_rule_id"], x["content"])), "\n"), 256).alias("version"))
