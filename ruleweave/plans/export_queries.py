"""Queries of exports and their checks over the driver's tables, with the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import functions as F

from ruleweave.functions.dates import derive_status
from ruleweave.operators import export_files as ex
from ruleweave.operators import validate
from ruleweave.plans import fixtures as fx
from ruleweave.plans import oracle

PARTS = 8


def _orders(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select(F.col("o_orderkey").alias("id"), F.struct("o_orderstatus", "o_custkey").alias("about"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")).alias("first"))


def canonical_lines(spark, sf_dir):
    """Orders as key-sorted JSON, dealt to ranges: every line, and that it lies in the part its key says."""
    rows = ex.lines(_orders(spark, sf_dir), "id", PARTS)
    return rows.select("id", "line")


def export_digest(spark, sf_dir):
    """The digest of the exported orders, whatever partitions they lie in."""
    rows = ex.lines(_orders(spark, sf_dir), "id", PARTS)
    return ex.tree_digest(rows)


def export_order(spark, sf_dir):
    """The exported parts are sorted and without repeats, over their borders too: nothing is found but what is planted in part 3."""
    rows = ex.lines(_orders(spark, sf_dir), "id", PARTS)
    planted = F.when(F.col("id") == rows.filter("part = 3").agg(F.min("id")).first()[0], F.lit(-1).cast(rows.schema["id"].dataType)).otherwise(F.col("id"))
    found = ex.order_problems(rows.withColumn("id", planted), "id", F.lpad(F.col("part").cast("string"), 6, "0"))
    return found.select(F.col("place").cast("int").alias("part"), "problem", "n")


def rule_records(spark, sf_dir):
    """Every place's rules as exported records: the rule table's, told for the states that have customers."""
    rules = fx.rules(spark)
    status = derive_status(*[F.col(c) for c in ("legal_status", "enacted_date", "effective_date", "repeal_date")], F.lit(fx.AS_OF).cast("date"))
    records = ex.to_record(rules, ex.linked_rules(rules), status)
    states = fx.addresses(spark, sf_dir).groupBy("state").agg(F.count("*").alias("places"))
    state = F.trim(F.regexp_extract("jurisdiction", r"([^,]*)$", 1))
    told = records.withColumn("state", state).join(F.broadcast(states), "state")  # five regions
    return told.select("team_rule_id", "level", "status", F.array_join("overrides", ",").alias("overrides"), "interaction", "places")


SCHEMA = {
    "required": ["id", "kind", "note"],
    "properties": {
        "id": {"type": "number", "minimum": 0}, "kind": {"type": "string", "enum": ["A", "B", "N"]}, "note": {"type": ["string", "null"], "minLength": 3}, "day": {"type": "string", "pattern": r"^\d{4}-\d{2}-\d{2}$"},
        "share": {"type": "number", "minimum": 0, "maximum": 1}, "list": {"type": "array", "items": {"type": "string"}},
    },
}


def row_faults(spark, sf_dir):
    """Line items as JSON with faults planted by their numbers; several in one row are all told."""
    k = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_returnflag").distinct()
    put = lambda every, wrong, right: F.when(k % every == 0, wrong).otherwise(right)
    quoted = F.concat(F.lit('"'), "l_returnflag", F.lit('"'))
    # flags are A, N and R; R is none of the values a kind may have
    parts = F.array_compact(F.array(
        put(11, F.lit(None), put(13, F.lit('"id":-1'), put(17, F.lit('"id":"x"'), F.concat(F.lit('"id":'), k.cast("string"))))), F.concat(F.lit('"kind":'), quoted),
        put(19, F.lit('"note":"no"'), put(23, F.lit('"note":null'), F.lit('"note":"long"'))), put(29, F.lit('"day":"1/2/2026"'), F.lit('"day":"2026-01-02"')),
        put(31, F.lit('"share":1.5'), F.lit('"share":0.5')), put(37, F.lit('"list":["a",1]'), F.lit('"list":["a"]')), F.when(k % 41 == 0, F.lit('"other":{"a":1}')),
    ))
    line = F.when(k % 43 == 0, F.lit("[1]")).otherwise(F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}")))
    rows = lines.withColumn("line", line)
    return validate.problems(rows, "line", SCHEMA).select("l_orderkey", "l_linenumber", "l_returnflag", "path", "code")


def repeated_lines(spark, sf_dir):
    return validate.repeated_keys(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_orderkey", "l_suppkey")


QUERIES = {f.__name__: f for f in (canonical_lines, export_digest, export_order, rule_records, row_faults, repeated_lines)}

_LINE = """'{"about":{"o_custkey":' || o_custkey || ',"o_orderstatus":"' || o_orderstatus || '"},"first":' || CASE WHEN o_orderkey % 5 <> 0 THEN '"' || o_orderpriority || '"' ELSE 'null' END || ',"id":' || o_orderkey || '}'"""
_LANES = ", ".join(f"sum(CAST('0x' || substr(h, {16 * i + 1}, 16) AS UBIGINT)::HUGEINT) % 18446744073709551616 AS s{i}" for i in range(4))

ORACLE_SQL = {
    "canonical_lines": f"SELECT o_orderkey AS id, {_LINE} AS line FROM orders",
    "export_digest": f"WITH h AS (SELECT sha256({_LINE}) AS h FROM orders), s AS (SELECT count(*) AS n, {_LANES} FROM h) SELECT n, sha256(n || '|' || s0 || '|' || s1 || '|' || s2 || '|' || s3) AS digest FROM s",
    "export_order": "SELECT CAST(3 AS INT) AS part, 'border_not_sorted' AS problem, CAST(1 AS BIGINT) AS n",
    "rule_records": f"""WITH {oracle.base()}, s AS (SELECT *, CASE WHEN ls = 'failed' THEN 'failed' WHEN ls = 'pending' OR coalesce(en > as_of, FALSE) THEN 'pending' WHEN coalesce(re <= as_of, FALSE) THEN 'failed' WHEN coalesce(ef > as_of, FALSE) THEN 'not_yet_effective' ELSE 'in_force' END AS status FROM rules, dates),
m AS (SELECT a.rid, string_agg(b.rid, ',' ORDER BY b.rid) AS o, bool_or(CASE WHEN a.is_city THEN b.relation ELSE a.relation END = 'yields_to_stricter_local') AS y, bool_or(CASE WHEN a.is_city THEN b.relation ELSE a.relation END = 'preempts_local') AS p FROM rules a JOIN rules b ON a.cat = b.cat AND a.st = b.st AND a.is_city <> b.is_city
  AND CASE WHEN a.is_city THEN b.relation ELSE a.relation END IN ('yields_to_stricter_local', 'preempts_local') GROUP BY a.rid)
SELECT rid AS team_rule_id, CASE WHEN is_city THEN 'city' ELSE 'state' END AS level, status, coalesce(o, '') AS overrides, CASE WHEN o IS NULL THEN NULL WHEN NOT is_city THEN CASE relation WHEN 'preempts_local' THEN 'Its text bars conflicting local ordinances; flagged for review.' ELSE 'Yields to a stricter local rule where one applies.' END
  ELSE concat_ws(' ', CASE WHEN y THEN 'A state rule of this category yields to this local rule.' END, CASE WHEN p THEN 'A state rule of this category bars conflicting local ordinances; flagged for review.' END) END AS interaction, places
FROM s LEFT JOIN m USING (rid) JOIN (SELECT state, count(*) AS places FROM addr GROUP BY state) c ON c.state = st""",
    "row_faults": """WITH x AS (SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag, l_orderkey * 8 + l_linenumber AS k FROM lineitem)
SELECT l_orderkey, l_linenumber, l_returnflag, path, code FROM (
SELECT *, unnest([struct_pack(path := 'id', code := 'required', hit := k % 11 = 0), struct_pack(path := 'id', code := 'minimum', hit := k % 13 = 0 AND k % 11 <> 0), struct_pack(path := 'id', code := 'type', hit := k % 17 = 0 AND k % 13 <> 0 AND k % 11 <> 0), struct_pack(path := 'kind', code := 'enum', hit := l_returnflag = 'R'),
 struct_pack(path := 'note', code := 'minLength', hit := k % 19 = 0), struct_pack(path := 'day', code := 'pattern', hit := k % 29 = 0), struct_pack(path := 'share', code := 'maximum', hit := k % 31 = 0), struct_pack(path := 'list', code := 'items', hit := k % 37 = 0), struct_pack(path := 'other', code := 'unknown', hit := k % 41 = 0)], recursive := TRUE) FROM x WHERE k % 43 <> 0) WHERE hit
UNION ALL SELECT l_orderkey, l_linenumber, l_returnflag, '', 'not_an_object' FROM x WHERE k % 43 = 0""",
    "repeated_lines": "SELECT l_orderkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
}
