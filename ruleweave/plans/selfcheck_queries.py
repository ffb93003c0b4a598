"""Queries of self-checks and of documents' change cases, with the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import functions as F

from ruleweave.functions.dates import derive_status
from ruleweave.operators import selfcheck
from ruleweave.operators.apply import results_for
from ruleweave.plans import fixtures as fx
from ruleweave.plans import oracle


def selfcheck_failures(spark, sf_dir):
    """The places' lookups with faults planted by address: a strange rule, an open result of a pending one, no rows at all."""
    day = F.lit(fx.AS_OF).cast("date")
    records = fx.rules(spark).select("team_rule_id", derive_status(*[F.col(c) for c in ("legal_status", "enacted_date", "effective_date", "repeal_date")], day).alias("status"))
    rows = results_for(fx.places(spark, sf_dir), fx.rules(spark)).filter("result <> 'not_applicable'").select("address_id", "team_rule_id", "result")
    k = F.col("address_id")
    bent = rows.filter(k % 13 != 0).select("address_id", F.when(k % 7 == 0, "R99").otherwise(F.col("team_rule_id")).alias("team_rule_id"), F.when((k % 5 == 0) & F.col("result").isin("pending", "not_yet_effective"), "applies").otherwise(F.col("result")).alias("result"))
    places = fx.addresses(spark, sf_dir)
    return selfcheck.failures(records, bent, places.select("address_id"), places.select("address_id", "method"), day)


def document_cases(spark, sf_dir):
    """Suppliers as documents of the parts they deliver, whose rules take effect on days made of their numbers, some partial."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_partkey", F.col("l_suppkey").cast("string").alias("s")).distinct()
    p = F.col("l_partkey")
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (p % 1200).cast("int")), "yyyy-MM-dd")
    said = F.when(p % 4 == 0, F.substring(day, 1, 7)).when(p % 4 == 1, day).when(p % 40 == 2, F.substring(day, 1, 4))
    rules = lines.groupBy("l_partkey").agg(F.min("s").alias("source_doc_id"), F.collect_set("s").alias("also_supported_by")).withColumn("effective_date", said)
    return selfcheck.cases_of_documents(rules, F.lit(fx.AS_OF).cast("date"))


QUERIES = {f.__name__: f for f in (selfcheck_failures, document_cases)}

_STATUS = "CASE WHEN ls = 'failed' THEN 'failed' WHEN ls = 'pending' OR coalesce(en > as_of, FALSE) THEN 'pending' WHEN coalesce(re <= as_of, FALSE) THEN 'failed' WHEN coalesce(ef > as_of, FALSE) THEN 'not_yet_effective' ELSE 'in_force' END"


def _kind(kind: str, source: str, text: str, order: str = "name") -> str:
    few = f"(SELECT string_agg(name, ', ' ORDER BY {order}) FROM (SELECT * FROM x ORDER BY {order} LIMIT 5))"
    said = f"{few} || CASE WHEN count(*) > 5 THEN ', ... (' || count(*) || ' total)' ELSE '' END"
    return f"(WITH x AS ({source}) SELECT '{kind}' AS kind, count(*) AS n, {text.replace('@', said)} AS text FROM x HAVING count(*) > 0)"


ORACLE_SQL = {
    "selfcheck_failures": f"""WITH {oracle.applied()}, rec AS (SELECT rid, {_STATUS} AS status FROM rules, dates),
lk AS (SELECT address_id, CASE WHEN address_id % 7 = 0 THEN 'R99' ELSE rid END AS rid, CASE WHEN address_id % 5 = 0 AND result IN ('pending', 'not_yet_effective') THEN 'applies' ELSE result END AS result FROM flg WHERE result <> 'not_applicable' AND address_id % 13 <> 0),
j AS (SELECT lk.*, rec.status FROM lk LEFT JOIN rec USING (rid))
{' UNION ALL '.join([
    _kind("orphan_rows", "SELECT DISTINCT address_id || '->' || rid AS name FROM j WHERE status IS NULL", "'lookup row(s) point at a rule that is not exported: ' || @"),
    _kind("uncovered", "SELECT CAST(address_id AS VARCHAR) AS name, address_id AS o FROM addr WHERE address_id NOT IN (SELECT address_id FROM lk)", "'lookups do not cover address(es): ' || @", "o"),
    _kind("unresolved", "SELECT CAST(address_id AS VARCHAR) AS name, address_id AS o FROM addr WHERE method = 'unresolved'", "count(*) || ' unresolved jurisdiction stack(s): ' || @", "o"),
    _kind("inactive", "SELECT DISTINCT rid || ' is ' || status || ' but has result ' || result AS name FROM j WHERE status IN ('pending', 'failed') AND result IN ('applies', 'unknown', 'superseded')", "'pending or failed rule(s) with an affirmative or open result: ' || @"),
    _kind("not_in_force", "SELECT DISTINCT rid || ' (' || status || ')' AS name FROM j WHERE result = 'applies' AND status <> 'in_force'", "'\"applies\" result for rule(s) not in force at " + fx.AS_OF + ": ' || @"),
])}""",
    "document_cases": f"""WITH l AS (SELECT DISTINCT l_partkey AS p, CAST(l_suppkey AS VARCHAR) AS doc, DATE '2024-01-01' + CAST(l_partkey % 1200 AS INT) AS d FROM lineitem),
c AS (SELECT doc, CASE WHEN p % 4 = 0 THEN last_day(d) WHEN p % 4 = 1 THEN d WHEN p % 40 = 2 THEN make_date(year(d), 12, 31) END AS e FROM l), m AS (SELECT doc, max(e) AS e FROM c GROUP BY doc)
SELECT doc, CASE WHEN e > DATE '{fx.AS_OF}' THEN 'as_of' ELSE 'boundary' END AS type, DATE '{fx.AS_OF}' AS before, CASE WHEN e > DATE '{fx.AS_OF}' THEN CAST(e + INTERVAL 1 DAY AS DATE) END AS after FROM m""",
}
