"""Queries of explanations, decision sentences, batches by id and served constraints, with the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import functions as F

from ruleweave.operators import answers, trace
from ruleweave.operators.apply import results_for
from ruleweave.plans import fixtures as fx
from ruleweave.plans import oracle
from ruleweave.plans.rule_queries import REQUESTS, _asked, _decided
from ruleweave.plans.wordings import quoted

VERSION = "v1"


def explanations(spark, sf_dir):
    """Whole explanations on three dates, so that rules are pending, waiting, in force and repealed."""
    rows = answers.explained(results_for(fx.places(spark, sf_dir, fx.DATES), fx.rules(spark), told=True))
    return rows.select("address_id", "as_of", "team_rule_id", "explanation")


def _steps(rows):
    each = rows.select("address_id", "action", "rule_id", "result", F.posexplode("steps").alias("step", "s"))
    return each.select("address_id", "action", "rule_id", "result", "step", "s.check", "s.outcome", "s.detail")


def decision_trace(spark, sf_dir):
    """Every step of every rule that reaches a request, for three actions."""
    return _steps(trace.trace(_asked(spark, sf_dir, (fx.AS_OF,), REQUESTS), fx.rules(spark), fx.constraints(spark), fx.UNITS))


def decision_trace_outside(spark, sf_dir):
    return _steps(trace.trace_outside(_asked(spark, sf_dir, (fx.AS_OF,), REQUESTS), fx.rules(spark)))


def decision_summary(spark, sf_dir):
    found = answers.summary(_decided(spark, sf_dir, "deposit", 2.0)).select("address_id", F.lit("deposit").alias("action"), "n_points", "summary")
    return found.unionByName(answers.summary(_decided(spark, sf_dir, "algo")).select("address_id", F.lit("algo").alias("action"), "n_points", "summary"))


def top_reason(spark, sf_dir):
    found = answers.top_reason(_decided(spark, sf_dir, "deposit", 2.0))
    return found.select("address_id", "decision", "top_reason", F.array_join("determining_rule_ids", ",").alias("determining"))


def _requests(spark, sf_dir):
    """Every third customer is asked about twice, and every tenth id is of no customer."""
    ids = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("k"))
    again = F.explode(F.when(F.col("k") % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return ids.withColumn("u", again).select((-F.col("k") * 2 + F.col("u")).alias("pos"), F.when(F.col("k") % 10 == 0, -F.col("k")).otherwise(F.col("k")).alias("address_id"))


def batch_by_ids(spark, sf_dir):
    places = _asked(spark, sf_dir, (fx.AS_OF,), {"deposit": 2.0})
    asked, _ = answers.registered(_requests(spark, sf_dir), places.select("address_id"))
    rows = answers.batch(_decided(spark, sf_dir, "deposit", 2.0), asked)
    return rows.select("pos", "address_id", "decision", "top_reason").orderBy("pos")


def batch_unknown_ids(spark, sf_dir):
    return answers.registered(_requests(spark, sf_dir), fx.addresses(spark, sf_dir))[1].select("pos", "error")


def merged_change_points(spark, sf_dir):
    return answers.merge_change_points(answers.change_points(fx.places(spark, sf_dir), fx.rules(spark)))


def decision_ids(spark, sf_dir):
    rows = _asked(spark, sf_dir, (fx.AS_OF,), {"deposit": 2.0, "algo": None})
    request = [F.col("address_id"), F.col("action"), F.col("as_of").cast("string").alias("as_of")]
    return rows.select("address_id", "action", answers.ruleset_digest(VERSION, *request).alias("decision_id"))


def affected_cities(spark, sf_dir):
    """Legal cities of the customers with an order over 300,000."""
    ids = spark.read.parquet(f"{sf_dir}/orders.parquet").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("address_id")).distinct()
    return answers.cities_of(ids, fx.addresses(spark, sf_dir))


def low_confidence_places(spark, sf_dir):
    confidence = F.when(F.col("address_id") % 4 == 0, 0.7).otherwise(0.95)
    return fx.addresses(spark, sf_dir).select("address_id", answers.low_confidence(F.col("method"), confidence).alias("low"))


def served_constraints(spark, sf_dir):
    """Constraints quoting documents: some of another category, another document or words that are not there."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id"), "text")
    k = F.col("doc_id")
    rules = docs.select(k.alias("team_rule_id"), F.when(k % 3 == 0, "fee").otherwise("deposit").alias("category"), F.when(k % 7 == 0, k + 1).otherwise(k).alias("source_doc_id"))
    quote = F.when(k % 5 == 0, F.concat(F.substring("text", 6, 30), F.lit("~"))).otherwise(F.substring("text", 6, 30))
    cites = docs.select(
        k.alias("rule_id"), F.lit("deposit").alias("action"), k.alias("source_doc_id"), quote.alias("evidence_quote"), F.lit(5).alias("span_start"), F.lit(35).alias("span_end"),
        F.when(k % 2 == 0, F.substring("text", 1, 10)).alias("hard_max_quote"),
    )
    return answers.served_constraints(cites, rules, docs).select("rule_id")


QUERIES = {
    f.__name__: f
    for f in (
        explanations, decision_trace, decision_trace_outside, decision_summary, top_reason, batch_by_ids, batch_unknown_ids, merged_change_points, decision_ids, affected_cities, low_confidence_places, served_constraints,
    )
}


# The expected wordings are stated here once more, apart from those of the code.
_DECIDING = """dt AS (SELECT u.address_id, u.as_of, u.rid, string_agg(CASE WHEN req_false AND grp = 0 AND v IS FALSE THEN txt WHEN NOT req_false AND ex_true AND grp > 0 AND g IS TRUE THEN txt
    WHEN NOT req_false AND NOT ex_true AND (req_null OR ex_null) AND v IS NULL AND (grp = 0 OR g IS NULL) THEN txt WHEN NOT req_false AND NOT ex_true AND NOT req_null AND NOT ex_null AND grp = 0 THEN txt END, '@' ORDER BY grp, pos) AS texts,
    bool_or(req_false) AS req_false, bool_or(ex_true) AS ex_true, bool_or(req_null OR ex_null) AND NOT bool_or(req_false) AND NOT bool_or(ex_true) AS is_open
    FROM unk u JOIN grps USING (address_id, as_of, rid, grp) JOIN cov USING (address_id, as_of, rid) GROUP BY ALL),
cav AS (SELECT rid, string_agg(txt, '; ' ORDER BY grp, pos) AS caveats FROM conds WHERE fact = 'caveat' GROUP BY rid),
lo0 AS (SELECT address_id, as_of, cat, min(CASE WHEN r0 = 'applies' THEN rid END) AS ra, min(CASE WHEN r0 = 'unknown' THEN rid END) AS ru FROM res WHERE is_city GROUP BY ALL),
ex0 AS (SELECT f.*, f.title || ' (' || f.jur || ')' AS who, lo.title || ' (' || lo.jur || ')' AS loc, coalesce(dt.is_open, FALSE) AS is_open, coalesce(dt.req_false, FALSE) AS rf, coalesce(dt.ex_true, FALSE) AS et, replace(dt.texts, '@', '; ') AS plain, '"' || replace(dt.texts, '@', '"; "') || '"' AS quoted, cav.caveats,
    replace(replace(replace(replace(replace(f.missing_facts, 'legal_city', 'the legal city'), 'units', 'the unit count'), 'year_built', 'the year built'), 'owner_occupied', 'whether the owner lives there'), ',', ', ') AS lacks
    FROM flg f LEFT JOIN dt USING (address_id, as_of, rid) LEFT JOIN cav USING (rid) LEFT JOIN lo0 l ON l.address_id = f.address_id AND l.as_of = f.as_of AND l.cat = f.cat
    LEFT JOIN rules lo ON lo.rid = CASE f.reason_code WHEN 'superseded_by_local' THEN l.ra WHEN 'local_coverage_unknown' THEN l.ru END),
ex AS (SELECT *, CASE reason_code
    WHEN 'covered' THEN who || ' applies to this address as of ' || as_of || '; every coverage condition is met and no exemption holds.'
    WHEN 'status_failed' THEN who || ' is not law as of ' || as_of || ': ' || CASE WHEN ls = 'failed' THEN 'it failed to pass' ELSE 'it was repealed ' || repeal END || '.'
    WHEN 'status_pending' THEN who || ' is only pending as of ' || as_of || ' and is not in force; it would cover this address in ' || jur || ' if enacted.'
    WHEN 'status_not_yet_effective' THEN who || ' is enacted but takes effect ' || effective || ', after ' || as_of || '; it is not yet in force at this address.'
    WHEN 'exempt' THEN who || ' does not apply as of ' || as_of || ': an exemption holds (' || quoted || ').'
    WHEN 'requirement_not_met' THEN who || ' does not apply as of ' || as_of || ': a coverage requirement is not met (' || quoted || ').'
    WHEN 'missing_fact' THEN 'Cannot tell whether ' || who || ' applies as of ' || as_of || ': the data for this address does not include ' || replace(lacks, 'registered', 'registered') || ' (' || quoted || ').'
    WHEN 'cutoff_ambiguous' THEN 'Cannot tell whether ' || who || ' applies as of ' || as_of || ': the building year alone does not settle the date test (' || quoted || ').'
    WHEN 'unverifiable_condition' THEN 'Cannot tell whether ' || who || ' applies as of ' || as_of || ': it depends on facts the dataset does not hold (' || replace(lacks, 'publicly_funded', 'publicly funded') || '): ' || quoted || '.'
    WHEN 'superseded_by_local' THEN who || ' yields to a local rule where one governs; ' || loc || ' applies at this address as of ' || as_of || ', so the state rule is superseded.' || CASE WHEN rid = 'R16' THEN ' Source wording: "a city may go further"' ELSE '' END
    WHEN 'local_coverage_unknown' THEN who || ' yields to a stricter local rule; whether ' || loc || ' covers this address as of ' || as_of || ' is unknown, so it cannot be said which rule governs.'
    WHEN 'jurisdiction_unresolved' THEN 'Cannot tell whether ' || who || ' applies as of ' || as_of || ': the city containing this address could not be determined (missing: the legal city).' END
  || CASE WHEN result IN ('pending', 'not_yet_effective') AND is_open THEN ' Coverage is also undetermined: ' || quoted || CASE WHEN lacks <> '' THEN ' (missing: ' || lacks || ')' ELSE '' END || '.' ELSE '' END
  || CASE WHEN caveats IS NOT NULL AND status <> 'failed' AND reason_code <> 'jurisdiction_unresolved' THEN ' Caveats: ' || caveats || '.' ELSE '' END
  || CASE WHEN result <> 'not_applicable' AND is_city AND method = 'postal_fallback' THEN ' The legal city of this address was taken from its mailing city because the geocoder found no match; low confidence.' ELSE '' END AS explanation FROM ex0)"""

_REQ3 = [("algo", None), ("deposit", 2.0), ("fee", 40.0)]


def _trace_sql() -> str:
    wordings = oracle.values("words", "no, vt, ht, ot", [(k, *v) for k, v in fx.WORDINGS.items()])
    unit = "CASE action WHEN 'deposit' THEN 'months' WHEN 'fee' THEN 'dollars' ELSE '' END"
    number = "CASE WHEN {0} = floor({0}) THEN CAST(CAST({0} AS BIGINT) AS VARCHAR) ELSE CAST({0} AS VARCHAR) END"
    v, mx, hard = (number.format(c) for c in ("value", "mx", "hard"))
    shown, vt, ht = f"CASE WHEN value IS NULL THEN 'no value' ELSE {v} || ' ' || {unit} END", """coalesce(' "' || vt || '"', '')""", """coalesce(' "' || ht || '"', '')"""
    return f"""WITH {oracle.decided(_REQ3)}, {_DECIDING}, {wordings},
e AS (SELECT DISTINCT ex.*, q.action, q.value FROM ex JOIN req q ON ex.address_id = q.address_id AND ex.as_of = q.as_of AND ex.cat = q.action),
f AS (SELECT found.*, vt, ht, ot FROM found LEFT JOIN words USING (no)),
k AS (SELECT address_id, action, rid, coalesce(no, -1) AS no, CASE WHEN kind = 'review' THEN 'unknown' WHEN kind = 'satisfied' THEN 'not_matched' ELSE 'matched' END AS outcome, CASE
  WHEN no IS NULL THEN 'What ' || rid || ' asks' WHEN effect = 'prohibit' AND untestable IS NULL THEN 'Code ' || rid || ' prohibits this action.'
  WHEN effect = 'prohibit' THEN 'A ban that holds only together with elements the engine cannot observe: ' || untestable || '.' WHEN effect = 'obligation' THEN coalesce(ot, 'What ' || rid || ' asks')
  WHEN coalesce(fy <> year(as_of), FALSE) THEN 'The source states the limit' || {vt} || ' for ' || fy || '; the figure for ' || year(as_of) || ' is not in the data. The request is ' || {shown} || '.'
  WHEN kind = 'satisfied' THEN {shown} || ' is within the limit of ' || {mx} || ' ' || {unit} || {vt} || '.'
  WHEN kind = 'violated' AND hard IS NOT NULL THEN {shown} || ' exceeds the highest limit the text allows in any case, ' || {hard} || ' ' || {unit} || {ht} || '.'
  WHEN kind = 'violated' THEN {shown} || ' exceeds the limit of ' || {mx} || ' ' || {unit} || {vt} || '.'
  WHEN mx IS NOT NULL AND hard IS NOT NULL THEN 'The limit is ' || {mx} || ' ' || {unit} || {vt} || ' in general and up to ' || {hard} || ' ' || {unit} || {ht} || ' in cases the data cannot tell apart. The request is ' || {shown} || '.'
  WHEN mx IS NOT NULL AND open_above THEN 'The limit of ' || {mx} || ' ' || {unit} || {vt} || ' may be adjusted upward over time and the adjusted figure is not in the data. The request is ' || {shown} || '.'
  ELSE 'The limit cannot be computed from the data. The request is ' || {shown} || '.' END AS detail FROM f WHERE kind IS NOT NULL),
more AS (SELECT * FROM e WHERE status <> 'failed' AND reason_code <> 'jurisdiction_unresolved'),
s AS (SELECT address_id, action, rid, result, 0 AS a, 0 AS b, 'jurisdiction' AS "check", CASE WHEN reason_code = 'jurisdiction_unresolved' THEN 'unknown' ELSE 'matched' END AS outcome,
    'The rule covers ' || jur || CASE WHEN reason_code = 'jurisdiction_unresolved' THEN '; the property''s city could not be resolved within ' || state ELSE ', which includes ' || coalesce(legal_city, state) END || '.' AS detail FROM e
  UNION ALL SELECT address_id, action, rid, result, 1, 0, 'status', CASE WHEN status = 'in_force' THEN 'matched' ELSE 'not_matched' END, 'On ' || as_of || ' the rule is ' || replace(status, '_', ' ') || '.' FROM e
  UNION ALL SELECT address_id, action, rid, result, 2, 0, 'coverage', CASE WHEN rf THEN 'not_matched' WHEN is_open THEN 'unknown' ELSE 'matched' END,
    CASE WHEN rf THEN 'A coverage requirement is not met: ' || plain WHEN is_open THEN 'Cannot be settled from the data: ' || plain ELSE 'The coverage requirements are met.' END FROM more
  UNION ALL SELECT address_id, action, rid, result, 3, 0, 'exemption', CASE WHEN et AND NOT rf THEN 'matched' WHEN is_open THEN 'unknown' ELSE 'not_matched' END,
    CASE WHEN et AND NOT rf THEN 'An exemption holds: ' || plain WHEN is_open THEN 'No stated exemption is established (some cannot be tested from the data).' ELSE 'No stated exemption is established.' END
    FROM more WHERE rid IN (SELECT rid FROM conds WHERE grp > 0)
  UNION ALL SELECT address_id, action, rid, result, 4, 0, 'precedence', CASE WHEN result = 'superseded' THEN 'matched' ELSE 'unknown' END,
    CASE WHEN result = 'superseded' OR reason_code = 'local_coverage_unknown' THEN explanation ELSE coalesce(conflict_note, 'Possible conflict with another rule.') END FROM more WHERE result = 'superseded' OR reason_code = 'local_coverage_unknown' OR conflict_flag
  UNION ALL SELECT m.address_id, m.action, m.rid, m.result, 5, k.no, 'constraint', k.outcome, k.detail FROM more m JOIN k ON k.address_id = m.address_id AND k.action = m.action AND k.rid = m.rid WHERE result = 'applies'
  UNION ALL SELECT address_id, action, rid, result, 5, 0, 'constraint', 'not_matched', 'The verified constraints have no effect on this action.' FROM more m
    WHERE result = 'applies' AND NOT EXISTS (SELECT 1 FROM k WHERE k.address_id = m.address_id AND k.action = m.action AND k.rid = m.rid))
SELECT address_id, action, rid AS rule_id, result, CAST(row_number() OVER (PARTITION BY address_id, action, rid ORDER BY a, b) - 1 AS INT) AS step, "check", outcome, detail FROM s"""


def _summary_sql() -> str:
    same = "i.address_id = d.address_id AND i.as_of = d.as_of AND i.action = d.action AND i.value IS NOT DISTINCT FROM d.value"
    heads = ""
    for decision, (one, many) in answers.HEADS.items():
        put = lambda t: f"replace(replace({quoted(t)}, '{{n}}', CAST(n AS VARCHAR)), '{{as_of}}', CAST(as_of AS VARCHAR))"
        heads += f" WHEN decision = '{decision}' THEN CASE WHEN n = 1 THEN {put(one)} ELSE {put(many)} END"
    return f"""WITH {oracle.decided([("deposit", 2.0), ("algo", None)])},
g AS (SELECT d.*, count(DISTINCT CASE WHEN kind = 'violated' THEN rid END) AS nv, count(*) FILTER (kind = 'review') AS nr, count(*) FILTER (kind = 'obligation') AS no, count(*) FILTER (kind = 'satisfied') AS ns, count(*) FILTER (code = 'coverage_gap') AS ng
  FROM dec d LEFT JOIN items i ON {same} GROUP BY ALL),
up AS (SELECT address_id, as_of, action, value, string_agg(title || CASE WHEN result = 'pending' THEN ' (pending, not enacted)' ELSE ' (effective ' || coalesce(effective, 'on a later date') || ')' END, '; ' ORDER BY rid) AS t
  FROM (SELECT DISTINCT address_id, as_of, action, value, rid, title, result, effective FROM rc WHERE result IN ('pending', 'not_yet_effective')) GROUP BY ALL),
n AS (SELECT g.*, up.t, CASE decision WHEN 'BLOCK' THEN nv WHEN 'REVIEW' THEN nr WHEN 'REQUIRE' THEN no ELSE ns END AS n FROM g LEFT JOIN up ON up.address_id = g.address_id AND up.as_of = g.as_of AND up.action = g.action AND up.value IS NOT DISTINCT FROM g.value)
SELECT address_id, action, n AS n_points, CASE WHEN decision = 'PASS' AND n > 0 THEN 'No modeled constraint is violated: the request is within the ' || CASE WHEN n = 1 THEN 'modeled limit' ELSE n || ' modeled limits' END || ' in force for this action at this property on ' || as_of || '.'{heads}
 ELSE replace({quoted(answers.PASSED)}, '{{as_of}}', CAST(as_of AS VARCHAR)) END || coalesce(' Not yet in force: ' || t || '.', '')
 || CASE WHEN ng > 0 THEN ' Known coverage gaps: ' || (SELECT string_agg(txt, ' ' ORDER BY jur) FROM gaps WHERE gaps.cat = action AND gaps.jur IN (state, legal_city)) WHEN decision = 'PASS' THEN {quoted(answers.COVERED)} ELSE '' END AS summary FROM n"""


_TOP = f"""{oracle.decided([("deposit", 2.0)])},
w AS (SELECT d.address_id, d.decision, d.as_of, i.rid, min(i.title) AS title, arg_min(kind, coalesce(no, 99)) AS kind FROM dec d JOIN items i ON i.address_id = d.address_id AND i.as_of = d.as_of AND i.action = d.action AND i.rid IS NOT NULL
  AND CASE d.decision WHEN 'BLOCK' THEN kind = 'violated' WHEN 'REVIEW' THEN kind = 'review' WHEN 'REQUIRE' THEN kind IN ('obligation', 'satisfied') ELSE kind = 'satisfied' END GROUP BY ALL),
t AS (SELECT d.address_id, d.decision, coalesce(arg_min(w.title, w.rid) || ': ' || CASE arg_min(kind, w.rid) WHEN 'review' THEN 'unresolved' ELSE arg_min(kind, w.rid) END,
   (SELECT arg_min(txt, jur) FROM gaps WHERE gaps.cat = d.action AND gaps.jur IN (d.state, d.legal_city)),
   replace({quoted(answers.PASSED)}, '{{as_of}}', CAST(d.as_of AS VARCHAR))) AS top_reason, coalesce(string_agg(w.rid, ',' ORDER BY w.rid), '') AS determining FROM dec d LEFT JOIN w USING (address_id) GROUP BY d.address_id, d.decision, d.as_of, d.action, d.state, d.legal_city)"""
_REQUESTS = "rq AS (SELECT -c_custkey * 2 + u AS pos, CASE WHEN c_custkey % 10 = 0 THEN -c_custkey ELSE c_custkey END AS address_id FROM customer, range(2) AS t(u) WHERE u = 0 OR c_custkey % 3 = 0)"
_CITY = "c_custkey % 50 <> 0 AND c_custkey % 23 <> 0"

ORACLE_SQL = {
    "explanations": f"WITH {oracle.applied(fx.DATES)}, {_DECIDING} SELECT address_id, as_of, rid AS team_rule_id, explanation FROM ex",
    "decision_trace": _trace_sql(),
    "decision_trace_outside": f"""WITH {oracle.base()} SELECT address_id, cat AS action, rid AS rule_id, 'not_applicable' AS result, 0 AS step, 'jurisdiction' AS "check", 'not_matched' AS outcome, 'The rule covers ' || jur || '; the property is in ' || coalesce(legal_city, state) || '.' AS detail
 FROM addr a, rules r WHERE cat IN ('algo', 'deposit', 'fee') AND NOT coalesce((NOT is_city AND jur = state) OR (is_city AND jur = legal_city) OR (is_city AND method = 'unresolved' AND st = state), FALSE)""",
    "decision_summary": _summary_sql(),
    "top_reason": f"WITH {_TOP} SELECT * FROM t",
    "batch_by_ids": f"WITH {_TOP}, {_REQUESTS} SELECT pos, address_id, decision, top_reason FROM rq JOIN t USING (address_id) ORDER BY pos",
    "batch_unknown_ids": f"WITH {_REQUESTS} SELECT pos, 'not in registry: ' || address_id AS error FROM rq WHERE address_id < 0",
    "merged_change_points": f"""WITH {oracle.base()}, e AS (SELECT jur, is_city, title, unnest([enacted, effective, repeal]) AS date, unnest(['is enacted', 'takes effect', 'is repealed']) AS what FROM rules WHERE ls <> 'failed'),
p AS (SELECT DISTINCT state, legal_city FROM addr)
SELECT DISTINCT date, day(CAST(date AS DATE)) || ' ' || strftime(CAST(date AS DATE), '%b') || ' ' || year(CAST(date AS DATE)) || ': ' || title || ' ' || what AS label
FROM e JOIN p ON jur = state OR (is_city AND jur = legal_city) WHERE regexp_matches(date, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$')""",
    "decision_ids": f"""SELECT c_custkey AS address_id, action, 'dec_' || substr(sha256('{{"address_id":' || c_custkey || ',"action":"' || action || '","as_of":"{fx.AS_OF}"}}' || '{VERSION}'), 1, 16) AS decision_id FROM customer, (VALUES ('deposit'), ('algo')) AS a(action)""",
    "affected_cities": f"""SELECT CASE WHEN {_CITY} THEN n_name || ', ' || r_name END AS city, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
 WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000) GROUP BY 1 ORDER BY n DESC, city""",
    "low_confidence_places": "SELECT c_custkey AS address_id, (c_custkey % 50 <> 0 AND c_custkey % 37 = 0) OR c_custkey % 4 = 0 AS low FROM customer",
    "served_constraints": "SELECT doc_id AS rule_id FROM documents WHERE doc_id % 3 <> 0 AND doc_id % 7 <> 0 AND doc_id % 5 <> 0",
}
