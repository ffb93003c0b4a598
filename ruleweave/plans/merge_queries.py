"""Queries of the field-level merge over order lines as candidates, with the SQL they are compared with.

A line item is a candidate of its order's cell. Status, dates, values and flags follow from its keys, so that groups
hold peers that sharpen, lend and contradict each other's dates, verified or not, in every mix.
"""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ruleweave.operators import consolidate as co
from ruleweave.operators import merge
from ruleweave.operators.common import dealt

VERSION = "g1"
TOLD = ["legal_status", "enacted_date", "effective_date", "source_doc_id"]
PART_ROWS = 200_000
CONDITION = "struct<fact:string,text:string>"


def _line_keys(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("l_orderkey AS k", "l_linenumber AS n", "l_partkey AS p", "l_suppkey AS s")


def parts_of(spark, sf_dir):
    """As many partitions as a shuffle has, more where they would hold over PART_ROWS lines, so that tasks sum up as much at any size."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-_line_keys(spark, sf_dir).count() // PART_ROWS))


def _lines(spark, sf_dir):
    """Lines dealt by cell with what groups them.

    They are dealt while rows are four numbers, so that what sums up, windows or joins cells moves no wider rows; by number, as rows
    get wide in the same task and small partitions must not be put together.
    """
    k, n, p, s = (F.col(c) for c in "knps")
    lines = dealt(_line_keys(spark, sf_dir).withColumn("cell", F.concat(F.lit("O"), k.cast("string"))), "cell", parts_of(spark, sf_dir)).distinct()
    return lines.select(*"knps", "cell", F.concat_ws("#", k, n, p, s).alias("candidate_id"), F.concat(F.lit("T"), (p % 3).cast("string")).alias("team_rule_id"), (n % 3 != 0).alias("verified"), (s % 2 == 0).alias("official"))


def _whole(lines):
    """Lines with what candidates say."""
    k, n, p, s = (F.col(c) for c in "knps")
    day = F.date_add(F.lit("2000-01-01").cast("date"), ((k % 5000) + F.when(n == 4, 40).otherwise(0)).cast("int"))
    later = F.date_add(F.lit("2000-01-01").cast("date"), ((k % 5000) + 180 + F.when(s % 5 == 4, (p % 3) * 200).otherwise(0)).cast("int"))
    # a date's text is its day; its month and year are the text's beginning
    told = lambda d, chars: F.substring(d.cast("string"), 1, chars)
    status = F.when(p % 11 == 0, "failed").when(s % 3 == 0, "pending").otherwise("enacted")
    caveat, units = F.struct(F.lit("caveat").alias("fact"), F.lit("seasonal").alias("text")), F.struct(F.lit("units").alias("fact"), F.concat(F.lit("units over "), (p % 9).cast("string")).alias("text"))
    return lines.select(
        *[c for c in lines.columns if c not in "knps"],
        status.alias("legal_status"),
        F.when(status != "pending", F.when(p % 4 == 1, told(day, 4)).when(p % 4 == 2, told(day, 7)).when(p % 4 == 3, told(day, 10))).alias("enacted_date"),
        F.when(s % 5 == 3, told(later, 7)).when(s % 5 > 1, told(later, 10)).alias("effective_date"),
        F.when(p % 5 == 1, " Alpha ").when(p % 5 == 2, "alpha").when(p % 5 == 3, F.concat(F.lit("Beta"), (p % 3).cast("string"))).when(p % 5 == 4, "").alias("key_value"),
        F.when(p % 2 == 0, F.array(caveat)).otherwise(F.array(caveat, units)).alias("requires"),
        F.when(p % 6 == 0, F.array(F.array(caveat))).otherwise(F.array().cast(f"array<array<{CONDITION}>>")).alias("exempt_if"),
        F.concat(F.lit("D"), s.cast("string")).alias("source_doc_id"),
        (p % 13 == 0).alias("conflict_flag"),
        F.when(p % 13 == 0, F.concat(F.lit("note "), (s % 3).cast("string"))).alias("conflict_note"),
        F.when(p % 3 != 0, F.concat(F.lit("read in D"), s.cast("string"))).alias("status_basis"),
    )


def candidates(spark, sf_dir):
    return _whole(_lines(spark, sf_dir).withColumn("picked", F.col("n") == 2))


def states(spark, sf_dir):
    """Documents of first lines also write the day that their order's rule takes effect."""
    day = F.date_add(F.lit("2000-01-01").cast("date"), ((F.col("k") % 5000) + 180).cast("int"))
    few = _line_keys(spark, sf_dir).filter("n <= 2").select("s", (F.col("k") % 5000).alias("k"))
    return few.select(F.concat(F.lit("D"), F.col("s").cast("string")).alias("source_doc_id"), F.date_format(day, "yyyy-MM-dd").alias("date"))


def cached_groupings(spark, sf_dir):
    """Kept answers: none for every third cell, one that leaves an id out for every fifth, an outdated key for every seventh."""
    rows = candidates(spark, sf_dir)
    keys = merge.payload_keys(rows, VERSION, TOLD).select("cell", "key")
    number = F.substring("cell", 2, 20).cast("long")
    parts = rows.withColumn("number", number).withColumn("group_no", (F.element_at(F.split("candidate_id", "#"), 3).cast("long") % 2).cast("string"))
    told = parts.filter("number % 3 <> 0").select("cell", "number", "candidate_id", "group_no")
    of_group = W.partitionBy("cell", "group_no")
    told = told.withColumns({"primary_id": F.min("candidate_id").over(of_group), "last": F.max("candidate_id").over(of_group)})
    told = told.withColumn("last", F.max("last").over(W.partitionBy("cell")))  # of the group's last, so that one sort serves both
    whole = told.join(keys, "cell").filter("number % 5 <> 0 OR candidate_id <> last")
    return whole.select(F.when(F.col("number") % 7 == 0, F.concat("key", F.lit("-"))).otherwise(F.col("key")).alias("key"), "group_no", F.col("candidate_id").alias("member_id"), "primary_id")


def _shown(merged, *group):
    said = F.array_join(F.transform("requires", lambda c: c["text"]), "|")
    flat = merged.withColumn("coverage", F.concat(said, F.lit("/"), F.size("exempt_if").cast("string")))
    return flat.select(*group, "candidate_id", "legal_status", "enacted_date", "effective_date", "coverage", "key_value", "status_basis", "conflict_flag", "conflict_note", "n_members")


def merged_rules(spark, sf_dir):
    """Every order's candidates as one rule."""
    return _shown(merge.merge_groups(candidates(spark, sf_dir), ["cell"], states(spark, sf_dir), parts_of(spark, sf_dir)), "cell")


def rule_support(spark, sf_dir):
    """What the merged rule of every order finds support in beside its primary."""
    rows = candidates(spark, sf_dir)
    found = merge.supported_by(rows, co.choose_primary(rows, ["cell"]).withColumnRenamed("primary_id", "candidate_id"), ["cell"])
    return found.select("cell", "candidate_id", "source_doc_id", "verified")


def grouped_cells(spark, sf_dir):
    """Groups of every cell, from the kept answers or one a candidate."""
    groups, _ = merge.group_cells(candidates(spark, sf_dir), cached_groupings(spark, sf_dir), VERSION, TOLD, co.grouping_problem, parts_of(spark, sf_dir))
    return groups


def grouping_failures(spark, sf_dir):
    return merge.group_cells(candidates(spark, sf_dir), cached_groupings(spark, sf_dir), VERSION, TOLD, co.grouping_problem, parts_of(spark, sf_dir))[1]


def consolidated_rules(spark, sf_dir):
    """Cells grouped, groups of one rule put together, and every bucket merged."""
    # null cells have no rule; said here, so that all that use the candidates share their shuffle
    lines = _lines(spark, sf_dir).filter("cell IS NOT NULL")
    return _shown(merge.consolidate_cached(lines, cached_groupings(spark, sf_dir), VERSION, TOLD, states(spark, sf_dir), parts_of(spark, sf_dir), _whole), "cell", "bucket")


QUERIES = {f.__name__: f for f in (merged_rules, rule_support, grouped_cells, grouping_failures, consolidated_rules)}

_CANDIDATES = """l AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS n, l_partkey AS p, l_suppkey AS s FROM lineitem),
d AS (SELECT *, DATE '2000-01-01' + CAST(k % 5000 + CASE WHEN n = 4 THEN 40 ELSE 0 END AS INT) AS a, DATE '2000-01-01' + CAST(k % 5000 + 180 + CASE WHEN s % 5 = 4 THEN p % 3 * 200 ELSE 0 END AS INT) AS b FROM l),
c0 AS (SELECT 'O' || k AS cell, k, p, k || '#' || n || '#' || p || '#' || s AS id, 'T' || p % 3 AS team, n % 3 <> 0 AS verified, s % 2 = 0 AS official, n = 2 AS picked,
  CASE WHEN p % 11 = 0 THEN 'failed' WHEN s % 3 = 0 THEN 'pending' ELSE 'enacted' END AS ls, 'D' || s AS doc, p % 13 = 0 AS cf, CASE WHEN p % 13 = 0 THEN 'note ' || s % 3 END AS cn, CASE WHEN p % 3 <> 0 THEN 'read in D' || s END AS sb,
  CASE p % 4 WHEN 1 THEN strftime(a, '%Y') WHEN 2 THEN strftime(a, '%Y-%m') WHEN 3 THEN strftime(a, '%Y-%m-%d') END AS en0, CASE s % 5 WHEN 3 THEN strftime(b, '%Y-%m') WHEN 2 THEN strftime(b, '%Y-%m-%d') WHEN 4 THEN strftime(b, '%Y-%m-%d') END AS ef,
  CASE p % 5 WHEN 1 THEN ' Alpha ' WHEN 2 THEN 'alpha' WHEN 3 THEN 'Beta' || p % 3 WHEN 4 THEN '' END AS kv, p % 2 = 0 AS bare, CASE WHEN p % 2 = 0 THEN 'seasonal' ELSE 'seasonal|units over ' || p % 9 END || '/' || CASE WHEN p % 6 = 0 THEN 1 ELSE 0 END AS cov FROM d),
c AS (SELECT *, CASE WHEN ls <> 'pending' THEN en0 END AS en FROM c0),
states AS (SELECT DISTINCT 'D' || s AS doc, strftime(DATE '2000-01-01' + CAST(k % 5000 + 180 AS INT), '%Y-%m-%d') AS v FROM l WHERE n <= 2)"""


def _merged(states: bool) -> str:
    """CTEs from m (candidates with gid) to fin, one row a gid."""
    floor = "CAST(CASE length({0}) WHEN 4 THEN {0} || '-01-01' WHEN 7 THEN {0} || '-01' ELSE {0} END AS DATE)"
    second = "EXISTS (SELECT 1 FROM states x WHERE x.doc = e.ddoc AND x.v = o2.v)" if states else "FALSE"
    return f"""
p AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY gid ORDER BY NOT verified, NOT (verified AND official), NOT picked, id) = 1),
v AS (SELECT * FROM m WHERE verified),
st AS (SELECT gid, count(DISTINCT ls) AS kinds, bool_or(ls = 'failed') AS f, bool_or(ls = 'enacted') AS e, bool_or(ls = 'enacted' AND (en IS NOT NULL OR ef IS NOT NULL)) AS de FROM v GROUP BY gid),
rs AS (SELECT p.gid, p.ls AS own, CASE WHEN coalesce(kinds, 0) < 2 OR (f AND e) THEN p.ls WHEN f THEN 'failed' WHEN de THEN 'enacted' ELSE p.ls END AS status, coalesce(kinds, 0) >= 2 AND ((f AND e) OR (NOT f AND NOT de)) AS conflict FROM p LEFT JOIN st USING (gid)),
gv AS (SELECT v.* FROM v JOIN rs USING (gid) WHERE status <> own AND v.ls = status AND (status = 'failed' OR en IS NOT NULL OR ef IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY gid ORDER BY id) = 1),
e0 AS (SELECT p.gid, CASE WHEN gv.gid IS NULL THEN p.en ELSE gv.en END AS oen, CASE WHEN gv.gid IS NULL THEN p.ef ELSE gv.ef END AS oef, coalesce(gv.doc, p.doc) AS ddoc FROM p LEFT JOIN gv USING (gid)),
peers AS (SELECT v.gid, v.en, v.ef, v.doc FROM v JOIN rs USING (gid) WHERE v.ls = status),
e AS (SELECT e0.*, coalesce((SELECT min(q.en) FROM peers q WHERE q.gid = e0.gid AND q.en <> oen AND starts_with(q.en, oen) AND NOT EXISTS (SELECT 1 FROM peers z WHERE z.gid = q.gid AND z.en <> q.en AND starts_with(z.en, q.en))), oen) AS enacted FROM e0),
l1 AS (SELECT q.gid, q.ef, q.doc FROM peers q JOIN e USING (gid) WHERE oef IS NULL AND enacted IS NOT NULL AND q.ef IS NOT NULL AND (q.en IS NULL OR starts_with(q.en, enacted) OR starts_with(enacted, q.en))),
l2 AS (SELECT q.gid, q.ef, q.doc FROM peers q JOIN e USING (gid) WHERE oef IS NULL AND q.ef IS NOT NULL),
o1 AS (SELECT gid, min(ef) AS v FROM l1 a WHERE NOT EXISTS (SELECT 1 FROM l1 z WHERE z.gid = a.gid AND z.ef <> a.ef AND starts_with(z.ef, a.ef)) GROUP BY gid HAVING count(DISTINCT ef) = 1),
o2 AS (SELECT gid, min(ef) AS v FROM l2 a WHERE NOT EXISTS (SELECT 1 FROM l2 z WHERE z.gid = a.gid AND z.ef <> a.ef AND starts_with(z.ef, a.ef)) GROUP BY gid HAVING count(DISTINCT ef) = 1),
g AS (SELECT e.*, o1.v AS w1, CASE WHEN o1.v IS NULL AND {second} THEN o2.v END AS w2 FROM e LEFT JOIN o1 USING (gid) LEFT JOIN o2 ON o2.gid = e.gid),
d1 AS (SELECT gid, string_agg(DISTINCT doc, ', ' ORDER BY doc) AS t FROM l1 GROUP BY gid), d2 AS (SELECT gid, string_agg(DISTINCT doc, ', ' ORDER BY doc) AS t FROM l2 GROUP BY gid),
sharp AS (SELECT DISTINCT gid, ef AS v FROM peers a WHERE ef IS NOT NULL AND NOT EXISTS (SELECT 1 FROM peers z WHERE z.gid = a.gid AND z.ef <> a.ef AND starts_with(z.ef, a.ef))),
near AS (SELECT DISTINCT a.gid, a.v FROM sharp a JOIN sharp b ON a.gid = b.gid AND a.v <> b.v AND abs(date_diff('day', {floor.format('a.v')}, {floor.format('b.v')})) < 366),
neard AS (SELECT gid, v, '"' || v || '" (' || string_agg(DISTINCT doc, ', ' ORDER BY doc) || ')' AS t FROM near JOIN (SELECT gid, ef AS v, doc FROM peers) USING (gid, v) GROUP BY gid, v),
nearn AS (SELECT gid, 'effective_date differs: ' || string_agg(t, ' vs ' ORDER BY v) AS t FROM neard GROUP BY gid HAVING count(*) >= 2),
std AS (SELECT gid, ls, '"' || ls || '" (' || string_agg(DISTINCT doc, ', ' ORDER BY doc) || ')' AS t FROM v GROUP BY gid, ls),
stn AS (SELECT gid, 'legal_status differs: ' || string_agg(t, ' vs ' ORDER BY ls) AS t FROM std JOIN rs USING (gid) WHERE conflict GROUP BY gid),
own AS (SELECT gid, cn AS t, 0 AS rank, min(id) AS o FROM m WHERE cn IS NOT NULL GROUP BY gid, cn),
nt AS (SELECT gid, string_agg(t, '; ' ORDER BY rank, o) AS t FROM (SELECT * FROM own UNION ALL SELECT gid, t, 1, '' FROM stn UNION ALL SELECT gid, t, 2, '' FROM nearn) GROUP BY gid),
cv AS (SELECT * FROM v WHERE NOT bare QUALIFY row_number() OVER (PARTITION BY gid ORDER BY id) = 1),
kv0 AS (SELECT m.gid, trim(m.kv) AS t, m.id <> p.id AS other, m.id FROM m JOIN p USING (gid) WHERE m.verified AND trim(m.kv) <> ''),
kv1 AS (SELECT * FROM kv0 QUALIFY row_number() OVER (PARTITION BY gid, lower(t) ORDER BY other, id) = 1),
kv2 AS (SELECT * FROM kv1 QUALIFY row_number() OVER (PARTITION BY gid ORDER BY other, id) <= 3),
kv3 AS (SELECT gid, string_agg(t, '; ' ORDER BY other, id) AS t FROM kv2 GROUP BY gid),
agg AS (SELECT gid, bool_or(cf) AS cf, count(*) AS n FROM m GROUP BY gid),
fin AS (SELECT p.gid, p.id AS candidate_id, rs.status AS legal_status, g.enacted AS enacted_date, coalesce(g.oef, w1, w2) AS effective_date, CASE WHEN p.bare AND cv.gid IS NOT NULL THEN cv.cov ELSE p.cov END AS coverage,
  coalesce(kv3.t, p.kv) AS key_value, nullif(concat_ws(' ', p.sb, '[' || nullif(concat_ws('; ', CASE WHEN gv.gid IS NOT NULL THEN 'legal_status ' || rs.status || ' from ' || gv.doc END,
    CASE WHEN w1 IS NOT NULL THEN 'effective_date ' || w1 || ' from ' || d1.t END, CASE WHEN w2 IS NOT NULL THEN 'effective_date ' || w2 || ' from ' || d2.t || ', a date ' || g.ddoc || ' also states' END,
    CASE WHEN gv.gid IS NOT NULL AND gv.en IS DISTINCT FROM p.en AND g.enacted IS NOT NULL THEN 'enacted_date ' || g.enacted || ' from ' || gv.doc END,
    CASE WHEN gv.gid IS NOT NULL AND gv.ef IS DISTINCT FROM p.ef AND g.oef IS NOT NULL THEN 'effective_date ' || g.oef || ' from ' || gv.doc END,
    CASE WHEN p.bare AND cv.gid IS NOT NULL THEN 'coverage from ' || cv.doc END), '') || ']'), '') AS status_basis,
  agg.cf OR rs.conflict OR nearn.t IS NOT NULL AS conflict_flag, nt.t AS conflict_note, agg.n AS n_members
  FROM p JOIN rs USING (gid) JOIN g USING (gid) JOIN agg USING (gid) LEFT JOIN gv USING (gid) LEFT JOIN d1 USING (gid) LEFT JOIN d2 USING (gid) LEFT JOIN nearn USING (gid) LEFT JOIN nt USING (gid) LEFT JOIN cv USING (gid) LEFT JOIN kv3 USING (gid))"""


_GROUPED = """t AS (SELECT cell, k, count(*) AS n FROM c GROUP BY cell, k),
usable AS (SELECT cell FROM t WHERE n > 1 AND k % 3 <> 0 AND k % 5 <> 0 AND k % 7 <> 0),
gr AS (SELECT c.cell, CASE WHEN u.cell IS NULL THEN id ELSE CAST(p % 2 AS VARCHAR) END AS group_no, id AS member_id, CASE WHEN u.cell IS NULL THEN id ELSE min(id) OVER (PARTITION BY c.cell, p % 2) END AS primary_id FROM c LEFT JOIN usable u ON u.cell = c.cell)"""
_SHOWN = "candidate_id, legal_status, enacted_date, effective_date, coverage, key_value, status_basis, conflict_flag, conflict_note, n_members"

ORACLE_SQL = {
    "merged_rules": f"WITH {_CANDIDATES}, m AS (SELECT *, cell AS gid FROM c), {_merged(True)} SELECT gid AS cell, {_SHOWN} FROM fin",
    "rule_support": f"WITH {_CANDIDATES} SELECT cell, id AS candidate_id, doc AS source_doc_id, verified FROM c QUALIFY row_number() OVER (PARTITION BY cell ORDER BY NOT verified, NOT (verified AND official), NOT picked, id) > 1",
    "grouped_cells": f"WITH {_CANDIDATES}, {_GROUPED} SELECT * FROM gr",
    "grouping_failures": f"WITH {_CANDIDATES}, {_GROUPED} SELECT cell, 'grouping not cached (offline); kept one rule per candidate' AS error FROM t WHERE n > 1 AND cell NOT IN (SELECT cell FROM usable)",
    "consolidated_rules": f"""WITH {_CANDIDATES}, {_GROUPED},
gp AS (SELECT c.*, group_no, primary_id FROM c JOIN gr ON gr.cell = c.cell AND gr.member_id = c.id),
tm AS (SELECT cell, group_no, primary_id, team AS bucket FROM gp QUALIFY row_number() OVER (PARTITION BY cell, group_no ORDER BY NOT verified, NOT (verified AND official), id <> primary_id, id) = 1),
pk AS (SELECT cell, bucket, arg_min(primary_id, group_no) AS pick FROM tm GROUP BY cell, bucket),
m AS (SELECT gp.* REPLACE (gp.id = pk.pick AS picked), tm.bucket, gp.cell || '|' || tm.bucket AS gid FROM gp JOIN tm USING (cell, group_no) JOIN pk ON pk.cell = gp.cell AND pk.bucket = tm.bucket), {_merged(True)}
SELECT split_part(gid, '|', 1) AS cell, split_part(gid, '|', 2) AS bucket, {_SHOWN} FROM fin""",
}
