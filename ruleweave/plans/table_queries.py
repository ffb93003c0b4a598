"""Queries of the text and table operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ruleweave.functions import text as tx
from ruleweave.operators import consolidate, portfolio
from ruleweave.plans.rule_queries import _DEP, _decided
from ruleweave.sources import files


def _read(spark, sf_dir, table):
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def verify_quote_exact(spark, sf_dir):
    """A quote cut from each document must be found where it first stands."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", F.substring("text", 21, 60).alias("quote"))
    found = tx.verify_quote(F.col("text"), F.col("quote"))
    return docs.withColumn("v", found).select("doc_id", "v.method", F.col("v.span_start").cast("long").alias("span_start"), "v.quoted_span")


def verify_quote_normalized(spark, sf_dir):
    """The same quote with its spaces doubled and its commas' neighbours curled is still found."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", F.trim(F.substring(F.regexp_replace("text", r"\s+", " "), 1, 50)).alias("plain"))
    bent = docs.withColumn("quote", F.replace("plain", F.lit(" "), F.lit("  "))).withColumn("v", tx.verify_quote(F.col("text"), F.col("quote")))
    return bent.select("doc_id", (F.col("v.method") != "failed").alias("found"))


def contains_text(spark, sf_dir):
    pages = _read(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return pages.select("doc_id", tx.contains_text(F.col("text"), F.when(F.col("lang") == "en", "of the").otherwise("de  la")).alias("found"))


def number_candidates(spark, sf_dir):
    """Distinct line items numbered within their order."""
    lines = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").distinct()
    return consolidate.number_candidates(lines, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey"])


def choose_primary(spark, sf_dir):
    lines = _read(spark, sf_dir, "lineitem")
    ident = F.concat_ws("#", *[F.lpad(F.col(c).cast("string"), 9, "0") for c in ("l_linenumber", "l_partkey", "l_suppkey")])
    members = lines.select("l_orderkey", ident.alias("candidate_id"), (F.col("l_returnflag") != "N").alias("verified"), (F.col("l_linestatus") == "O").alias("official"), (F.col("l_linenumber") == 2).alias("picked"))
    return consolidate.choose_primary(members, ["l_orderkey"])


def distinct_dates(spark, sf_dir):
    """Ship dates of an order's parts, some of them known to the month or year only."""
    day = F.date_format("l_shipdate", "yyyy-MM-dd")
    said = F.when(F.col("l_partkey") % 3 == 0, F.substring(day, 1, 4)).when(F.col("l_partkey") % 3 == 1, F.substring(day, 1, 7)).otherwise(day)
    grouped = _read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(said).alias("dates"))
    return grouped.select("l_orderkey", F.array_join(consolidate.distinct_dates(F.col("dates")), ",").alias("dates"))


def close_dates(spark, sf_dir):
    grouped = _read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set(F.col("o_orderdate").cast("date")).alias("days"))
    return grouped.select("o_custkey", F.size(consolidate.close_dates(F.col("days"))).cast("long").alias("n_close"))


def nearest_points(spark, sf_dir):
    days = _read(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("day"), F.col("o_orderkey").cast("string").alias("label"))
    return portfolio.nearest_points(days, F.lit("1998-01-15").cast("date"))


def sort_rows(spark, sf_dir):
    rows = _decided(spark, sf_dir, "deposit", 2.0).select("address_id", "legal_city", "decision")
    return portfolio.page(portfolio.sort_rows(rows, "decision")).select("address_id", "legal_city", "decision")


def text_filter(spark, sf_dir):
    nations = _read(spark, sf_dir, "nation")
    return nations.filter(tx.text_filter([F.col("n_name"), F.col("n_nationkey").cast("string")], " nation_1 ")).select("n_nationkey", "n_name")


def events_json(spark, sf_dir):
    events = _read(spark, sf_dir, "events")
    return events.select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k")) if "event_id" in events.columns else events.select("ts", F.get_json_object("props", "$.k").try_cast("int").alias("k"))


def doc_dedupe(spark, sf_dir):
    """One document of each source and language: the one of the lowest id, as the origin of highest rank wins."""
    docs = _read(spark, sf_dir, "documents").select(F.concat_ws("/", "source", "lang").alias("key"), "doc_id", "n_chars")
    return files.first_of_each(docs, "key", "doc_id")


QUERIES = {
    f.__name__: f
    for f in (
        verify_quote_exact, verify_quote_normalized, contains_text,
        number_candidates, choose_primary, distinct_dates, close_dates, nearest_points,
        sort_rows, text_filter, events_json, doc_dedupe,
    )
}

_LAST_LINE = "CASE WHEN l_partkey % 3 = 0 THEN substr(d, 1, 4) WHEN l_partkey % 3 = 1 THEN substr(d, 1, 7) ELSE d END"

ORACLE_SQL = {
    "verify_quote_exact": """WITH q AS (SELECT doc_id, text, trim(substr(text, 21, 60)) AS s FROM documents)
SELECT doc_id, CASE WHEN length(s) >= 20 THEN 'exact' ELSE 'failed' END AS method, CASE WHEN length(s) >= 20 THEN instr(text, s) - 1 END AS span_start, CASE WHEN length(s) >= 20 THEN s END AS quoted_span FROM q""",
    "verify_quote_normalized": r"SELECT doc_id, length(trim(substr(regexp_replace(text, '\s+', ' ', 'g'), 1, 50))) >= 20 AS found FROM documents",
    "contains_text": r"SELECT doc_id, contains(trim(regexp_replace(translate(text, '‘’′“”″–—', '''''''\"\"\"--'), '\s+', ' ', 'g')), CASE WHEN lang = 'en' THEN 'of the' ELSE 'de la' END) AS found FROM documents".replace('\\"', '"'),
    "number_candidates": "WITH l AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem) SELECT *, l_orderkey || '#' || row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS candidate_id FROM l",
    "choose_primary": """WITH m AS (SELECT l_orderkey, lpad(CAST(l_linenumber AS VARCHAR), 9, '0') || '#' || lpad(CAST(l_partkey AS VARCHAR), 9, '0') || '#' || lpad(CAST(l_suppkey AS VARCHAR), 9, '0') AS id,
 l_returnflag <> 'N' AS v, l_linestatus = 'O' AS o, l_linenumber = 2 AS p FROM lineitem)
SELECT l_orderkey, id AS primary_id FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY v DESC, (v AND o) DESC, p DESC, id) AS n FROM m) WHERE n = 1""",
    "distinct_dates": f"""WITH s AS (SELECT DISTINCT l_orderkey, {_LAST_LINE} AS x FROM (SELECT *, strftime(l_shipdate, '%Y-%m-%d') AS d FROM lineitem))
SELECT l_orderkey, string_agg(x, ',' ORDER BY x) AS dates FROM s WHERE NOT EXISTS (SELECT 1 FROM s o WHERE o.l_orderkey = s.l_orderkey AND o.x <> s.x AND starts_with(o.x, s.x)) GROUP BY l_orderkey""",
    "close_dates": """WITH d AS (SELECT DISTINCT o_custkey, CAST(o_orderdate AS DATE) AS x FROM orders), n AS (SELECT *, x - lag(x) OVER w AS a, lead(x) OVER w - x AS b FROM d WINDOW w AS (PARTITION BY o_custkey ORDER BY x))
SELECT o_custkey, count(*) FILTER (coalesce(a < 366, FALSE) OR coalesce(b < 366, FALSE)) AS n_close FROM n GROUP BY o_custkey""",
    "nearest_points": "SELECT CAST(o_orderdate AS DATE) AS day, CAST(o_orderkey AS VARCHAR) AS label FROM orders ORDER BY abs(date_diff('day', DATE '1998-01-15', CAST(o_orderdate AS DATE))), 1, 2 LIMIT 8",
    "sort_rows": f"WITH {_DEP} SELECT address_id, legal_city, decision FROM dec ORDER BY CASE decision WHEN 'BLOCK' THEN 0 WHEN 'REVIEW' THEN 1 WHEN 'REQUIRE' THEN 2 ELSE 3 END, legal_city NULLS LAST, address_id LIMIT 50",
    "text_filter": "SELECT n_nationkey, n_name FROM nation WHERE contains(lower(n_name || ' ' || CAST(n_nationkey AS VARCHAR)), 'nation_1')",
    "events_json": "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events",
    "doc_dedupe": "SELECT source || '/' || lang AS key, min(doc_id) AS doc_id, arg_min(n_chars, doc_id) AS n_chars FROM documents GROUP BY 1",
}
