"""Queries of the stores over the driver's tables, with the SQL each is compared with."""

from __future__ import annotations

from pyspark.sql import functions as F

from ruleweave.operators import stores


def _read(spark, sf_dir, table):
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _parts(spark, sf_dir):
    """Order lines as candidates: the part's supplier is the jurisdiction, the ship mode's number the category."""
    return _read(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("jurisdiction"), (F.col("l_partkey") % 4).alias("category"), F.concat_ws("#", "l_orderkey", "l_linenumber", "l_partkey").alias("candidate_id"), F.col("l_orderkey").alias("source_doc_id")
    )


def candidate_cells(spark, sf_dir):
    found = stores.cells(_parts(spark, sf_dir))
    return found.select("jurisdiction", "category", F.size("ids").alias("n"), F.md5(F.array_join("ids", ",")).alias("digest"))


def team_buckets(spark, sf_dir):
    lines = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").distinct()
    groups = lines.groupBy(F.col("l_orderkey").alias("cell"), F.col("l_linenumber").alias("group_no")).agg(F.min("l_partkey").alias("primary_id"), F.array_sort(F.collect_list("l_partkey")).alias("member_ids"))
    found = stores.bucket_by_team_id(groups.withColumn("team_rule_id", F.col("primary_id") % 2))
    return found.select("cell", "team_rule_id", F.array_join("member_ids", ",").alias("members"), "pick")


def replaced_candidates(spark, sf_dir):
    old = _parts(spark, sf_dir).select("candidate_id", "source_doc_id")
    done = _read(spark, sf_dir, "orders").filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("source_doc_id"))
    fresh = done.select(F.concat(F.lit("new#"), F.col("source_doc_id").cast("string")).alias("candidate_id"), "source_doc_id")
    found = stores.replace_by_document(old, fresh, done)
    return found.groupBy("source_doc_id").agg(F.count("*").alias("n"), F.min("candidate_id").alias("first"))


def _constraints(spark, sf_dir):
    return _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("constraint_id"), F.col("o_custkey").alias("rule_id"), F.col("o_orderstatus").alias("effect"))


def merged_constraints(spark, sf_dir):
    old = _constraints(spark, sf_dir)
    rules = _read(spark, sf_dir, "customer").filter("c_custkey % 7 <> 0").select(F.col("c_custkey").alias("team_rule_id"))
    done = rules.filter("team_rule_id % 5 = 0").select(F.col("team_rule_id").alias("rule_id"))
    fresh = done.select((-F.col("rule_id")).alias("constraint_id"), "rule_id", F.lit("N").alias("effect"))
    return stores.merge_constraints(old, fresh, done, rules)


def rejected_constraints(spark, sf_dir):
    rejected = _read(spark, sf_dir, "orders").filter("o_orderkey % 9 = 0").select(F.col("o_orderkey").alias("constraint_id"), F.lit("read again").alias("reason"))
    kept, gone = stores.move_rejected(_constraints(spark, sf_dir), rejected)
    return kept.withColumn("reason", F.lit(None).cast("string")).unionByName(gone)


def constraints_by_effect(spark, sf_dir):
    return stores.counts_by(_constraints(spark, sf_dir), "effect")


def rules_without_constraint(spark, sf_dir):
    rules = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("rule_id"))
    return stores.without(rules, _constraints(spark, sf_dir), "rule_id")


def compared_sets(spark, sf_dir):
    expected = _read(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("id"))
    actual = _read(spark, sf_dir, "orders").filter("o_totalprice > 200000").select(F.col("o_orderkey").alias("id"))
    return stores.compare_sets(expected, actual, "id")


def _manifest(spark, sf_dir):
    k = F.col("s_suppkey")
    readable = stores.is_readable(F.when(k % 3 == 0, "ok").otherwise("failed"), F.when(k % 2 == 0, "x.txt").otherwise(""), k % 11 == 0)
    return _read(spark, sf_dir, "supplier").select(F.concat(F.lit("J"), (k % 40).cast("string")).alias("jurisdiction"), readable.alias("readable"))


def source_counts(spark, sf_dir):
    return stores.source_counts(_manifest(spark, sf_dir))


def derived_gaps(spark, sf_dir):
    nations = _read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"))
    place = F.concat(F.lit("J"), F.col("k").cast("string"))
    selections = nations.select(F.concat(F.lit("L"), F.col("k").cast("string")).alias("label"), F.concat(F.lit("T"), (F.col("k") % 3).cast("string")).alias("case_id"), F.when(F.col("k") % 4 != 0, place).alias("jurisdiction"), F.lit("fee").alias("category"))
    rules = nations.filter("k % 2 = 0").select(place.alias("jurisdiction"), F.when(F.col("k") % 3 == 0, "fee").otherwise("rent").alias("category"))
    return stores.known_gaps(_manifest(spark, sf_dir), selections, rules, ["fee", "rent"])


def timing_quantiles(spark, sf_dir):
    return stores.timing_quantiles(_read(spark, sf_dir, "orders"), "o_totalprice", "o_orderpriority")


QUERIES = {
    f.__name__: f
    for f in (
        candidate_cells, team_buckets, replaced_candidates, merged_constraints, rejected_constraints, constraints_by_effect, rules_without_constraint, compared_sets, source_counts, derived_gaps, timing_quantiles,
    )
}

_MANIFEST = "m AS (SELECT 'J' || s_suppkey % 40 AS j, (s_suppkey % 3 = 0 AND s_suppkey % 2 = 0) OR s_suppkey % 11 = 0 AS r FROM supplier)"

ORACLE_SQL = {
    "candidate_cells": "SELECT l_suppkey AS jurisdiction, l_partkey % 4 AS category, CAST(count(*) AS INT) AS n, md5(string_agg(id, ',' ORDER BY id)) AS digest FROM (SELECT *, l_orderkey || '#' || l_linenumber || '#' || l_partkey AS id FROM lineitem) GROUP BY 1, 2",
    "team_buckets": """WITH g AS (SELECT l_orderkey AS cell, l_linenumber AS no, min(p) AS pick, string_agg(p, ',' ORDER BY p) AS members FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey AS p FROM lineitem) GROUP BY 1, 2)
SELECT cell, pick % 2 AS team_rule_id, string_agg(members, ',' ORDER BY no) AS members, arg_min(pick, no) AS pick FROM g GROUP BY cell, pick % 2""",
    "replaced_candidates": """WITH d AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 3 = 0), a AS (SELECT l_orderkey AS k, l_orderkey || '#' || l_linenumber || '#' || l_partkey AS id FROM lineitem WHERE l_orderkey NOT IN (SELECT k FROM d) UNION ALL SELECT k, 'new#' || k FROM d)
SELECT k AS source_doc_id, count(*) AS n, min(id) AS first FROM a GROUP BY k""",
    "merged_constraints": """SELECT o_orderkey AS constraint_id, o_custkey AS rule_id, o_orderstatus AS effect FROM orders WHERE o_custkey % 7 <> 0 AND o_custkey % 5 <> 0 AND o_custkey IN (SELECT c_custkey FROM customer)
UNION ALL SELECT -c_custkey, c_custkey, 'N' FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey % 5 = 0""",
    "rejected_constraints": "SELECT o_orderkey AS constraint_id, o_custkey AS rule_id, o_orderstatus AS effect, CASE WHEN o_orderkey % 9 = 0 THEN 'rejected in lead review: read again' END AS reason FROM orders",
    "constraints_by_effect": "SELECT o_orderstatus AS effect, count(*) AS n FROM orders GROUP BY 1",
    "rules_without_constraint": "SELECT c_custkey AS rule_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
    "compared_sets": """WITH e AS (SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_quantity > 45), a AS (SELECT DISTINCT o_orderkey AS id FROM orders WHERE o_totalprice > 200000)
SELECT id, 'missing' AS side FROM (SELECT id FROM e EXCEPT SELECT id FROM a) UNION ALL SELECT id, 'unexpected' FROM (SELECT id FROM a EXCEPT SELECT id FROM e)""",
    "source_counts": f"WITH {_MANIFEST} SELECT j AS jurisdiction, count(*) FILTER (r) AS sources_read, count(*) FILTER (NOT r) AS sources_unreadable FROM m GROUP BY j",
    "derived_gaps": f"""WITH {_MANIFEST}, h AS (SELECT 'J' || n_nationkey AS j, CASE WHEN n_nationkey % 3 = 0 THEN 'fee' ELSE 'rent' END AS c FROM nation WHERE n_nationkey % 2 = 0),
a AS (SELECT 'J' || n_nationkey AS j, 'fee' AS c, 1 AS rank, 'J' || n_nationkey || ': no fee rule could be extracted, although change test T' || n_nationkey % 3 || ' names L' || n_nationkey || '.' AS text FROM nation WHERE n_nationkey % 4 <> 0
 UNION ALL SELECT j, c, 2, j || ': none of its ' || n || ' listed sources could be read, and no ' || c || ' rule is stored for it.' FROM (SELECT j, count(*) AS n FROM m GROUP BY j HAVING NOT bool_or(r)), (VALUES ('fee'), ('rent')) AS v(c))
SELECT j AS jurisdiction, c AS category, arg_min(text, rank) AS text FROM a WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.j = a.j AND h.c = a.c) GROUP BY j, c""",
    "timing_quantiles": "SELECT o_orderpriority, quantile_cont(o_totalprice, 0.5) AS median, max(o_totalprice) AS largest FROM orders GROUP BY 1",
}
