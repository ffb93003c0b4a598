"""Queries of supplied facts, export checks and replaced rows, with the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import functions as F

from ruleweave.operators import export, facts
from ruleweave.plans import fixtures as fx
from ruleweave.plans import oracle
from ruleweave.sources import files

def overlay_facts(spark, sf_dir):
    """Every second place is asked about with facts of the caller's, some of them other than recorded."""
    key = F.col("address_id")
    given = F.when(key % 2 == 0, F.struct((key % 4 + 1).cast("int").alias("units"), F.when(key % 4 == 0, F.lit(1980)).alias("year_built")))
    laid = facts.overlay_facts(fx.addresses(spark, sf_dir).withColumn("given", given))
    return laid.select("address_id", "units", "units_source", "year_built", "year_built_source", F.array_join("conflicts", ",").alias("conflicts"))


def exportable_split(spark, sf_dir):
    """Quotes of documents: some unverified, some of no document, some no longer what the document says."""
    docs, key = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), F.col("doc_id")
    end = F.when(key % 5 == 0, 51).otherwise(50)
    cites = docs.select(
        key.alias("rule_no"), F.when(key % 11 == 0, -key - 1).otherwise(key).alias("source_doc_id"), (key % 7 != 0).alias("verified"),
        F.substring("text", 11, 40).alias("quoted_span"), F.lit(10).alias("span_start"), end.alias("span_end"),
    )
    return export.exportable_split(cites, docs).select("rule_no", "withheld")


def upsert_rows(spark, sf_dir):
    """Every tenth order replaced by a row of status X, and one new order."""
    old = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderstatus")
    new = old.filter("o_orderkey % 10 = 0").withColumn("o_orderstatus", F.lit("X"))
    return files.upsert(old, new.unionByName(spark.createDataFrame([(-1, "N")], "o_orderkey long, o_orderstatus string")), "o_orderkey")


QUERIES = {f.__name__: f for f in (overlay_facts, exportable_split, upsert_rows)}

ORACLE_SQL = {
    "overlay_facts": f"""WITH {oracle.ADDRESSES}, g AS (SELECT address_id, units AS ru, year_built AS ry, CASE WHEN address_id % 2 = 0 THEN CAST(address_id % 4 + 1 AS INT) END AS gu, CASE WHEN address_id % 4 = 0 THEN 1980 END AS gy FROM addr)
SELECT address_id, coalesce(ru, gu) AS units, CASE WHEN ru IS NOT NULL THEN 'record' WHEN gu IS NOT NULL THEN 'caller' ELSE 'missing' END AS units_source,
 CAST(coalesce(ry, gy) AS INT) AS year_built, CASE WHEN ry IS NOT NULL THEN 'record' WHEN gy IS NOT NULL THEN 'caller' ELSE 'missing' END AS year_built_source,
 concat_ws(',', CASE WHEN ru <> gu THEN 'units' END, CASE WHEN ry <> gy THEN 'year_built' END) AS conflicts FROM g""",
    "exportable_split": """WITH c AS (SELECT doc_id AS rule_no, CASE WHEN doc_id % 11 = 0 THEN -doc_id - 1 ELSE doc_id END AS src, substr(text, 11, 40) AS q FROM documents)
SELECT rule_no, CASE WHEN rule_no % 7 = 0 THEN 'not_verified' WHEN d.text IS NULL THEN 'source_document_missing' WHEN rule_no % 5 = 0 AND substr(d.text, 11, 41) <> q THEN 'quote_does_not_match_source' END AS withheld FROM c LEFT JOIN documents d ON d.doc_id = c.src""",
    "upsert_rows": "SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders UNION ALL SELECT -1, 'N'",
}
