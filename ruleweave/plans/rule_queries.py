"""Queries that apply the rule table to the places derived from the customers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleweave.functions import dates as dt
from ruleweave.functions import logic
from ruleweave.operators import apply, decide, diff, envelope, export
from ruleweave.plans import fixtures as fx
from ruleweave.plans import oracle

REQUESTS = {"algo": None, "deposit": 2.0, "fee": 40.0}


def _results(spark: SparkSession, sf_dir: str, dates: tuple[str, ...] = (fx.AS_OF,)) -> DataFrame:
    return apply.results_for(fx.places(spark, sf_dir, dates), fx.rules(spark))


def _asked(spark: SparkSession, sf_dir: str, dates: tuple[str, ...], requests: dict[str, float | None]) -> DataFrame:
    one = F.explode(F.array(*[F.struct(F.lit(a).alias("action"), F.lit(v).cast("double").alias("value")) for a, v in requests.items()]))
    return fx.places(spark, sf_dir, dates).withColumn("_r", one).select("*", "_r.action", "_r.value").drop("_r")


def _decided(spark: SparkSession, sf_dir: str, action: str, value: float | None = None, dates: tuple[str, ...] = (fx.AS_OF,)) -> DataFrame:
    places = _asked(spark, sf_dir, dates, {action: value})
    return decide.decide(places, apply.results_for(places, fx.rules(spark)), fx.constraints(spark), fx.gaps(spark))


def derive_status(spark, sf_dir):
    days = F.explode(F.array(*[F.lit(d).cast("date") for d in fx.DATES]))
    rows = fx.rules(spark).withColumn("as_of", days)
    status = dt.derive_status(*[F.col(c) for c in ("legal_status", "enacted_date", "effective_date", "repeal_date", "as_of")])
    return rows.select("team_rule_id", "as_of", status.alias("status"))


PARTIALS = ("2024", "2024-02", "2023-02", "2024-02-29", "2023-02-29", "1999-12", "2024-13", "2024-00", "24", "2024-1", "x", None)


def partial_date_bounds(spark, sf_dir):
    said = spark.createDataFrame([(p,) for p in PARTIALS], "said string")
    return said.select("said", dt.date_floor(F.col("said")).alias("first_day"), dt.date_ceil(F.col("said")).alias("last_day"), dt.valid_partial_date(F.col("said")).alias("valid"))


def interval_compare(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size", F.explode(F.array(*[F.lit(o) for o in logic.OPS])).alias("op"))
    a2, b2 = F.col("p_size") + F.col("p_partkey") % 3, 20 + F.col("p_partkey") % 2 * 5
    return part.select("p_partkey", "op", logic.compare(F.col("op"), F.col("p_size"), a2, F.lit(20), b2).alias("verdict"))


def minus_months(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"))
    return o.select("o_orderkey", dt.minus_months(F.col("d"), (F.col("o_orderkey") % 40).cast("int")).alias("before"))


def apply_results(spark, sf_dir):
    alone = apply.apply_rules(fx.places(spark, sf_dir), fx.rules(spark))
    return alone.select("address_id", "team_rule_id", "result", "reason_code", F.array_join("missing_facts", ",").alias("missing_facts"))


def apply_precedence(spark, sf_dir):
    done = _results(spark, sf_dir, fx.DATES)
    return done.select("address_id", "as_of", "team_rule_id", "result", "reason_code", F.array_join("missing_facts", ",").alias("missing_facts"))


def apply_conflicts(spark, sf_dir):
    return _results(spark, sf_dir).filter("conflict_flag").select("address_id", "team_rule_id", "conflict_note")


def lookup_rows(spark, sf_dir):
    rows = export.lookup_rows(_results(spark, sf_dir))
    return rows.select("address_id", "team_rule_id", "result", "conflict_flag")


def result_counts(spark, sf_dir):
    places = fx.places(spark, sf_dir, fx.DATES)
    n = places.groupBy("as_of").agg(F.count("*").alias("places"))
    return apply.result_counts(apply.results_for(places, fx.rules(spark)), n, len(fx.RULES))


def rule_links(spark, sf_dir):
    return export.rule_links(fx.rules(spark)).select("team_rule_id", F.array_join("linked", ",").alias("linked"))


def batch_decisions(spark, sf_dir):
    places = _asked(spark, sf_dir, (fx.AS_OF,), REQUESTS)
    # One request an address and action: the action joins the key as part of the id.
    keyed = places.withColumn("address_id", F.struct("address_id", "action"))
    done = decide.decide(keyed, apply.results_for(keyed, fx.rules(spark)), fx.constraints(spark), fx.gaps(spark))
    return done.select("address_id.address_id", "action", "as_of", "value", "decision", "permit")


def decision_counts(spark, sf_dir):
    return decide.decision_counts(_decided(spark, sf_dir, "deposit", 2.0, fx.DATES), "as_of")


def determining_rules(spark, sf_dir):
    rows = decide.determining(_decided(spark, sf_dir, "deposit", 1.5))
    return rows.select("address_id", "decision", "team_rule_id", "effect", "outcome", F.col("constraint_no"))


def review_items(spark, sf_dir):
    return decide.review_items(_decided(spark, sf_dir, "deposit", 2.0)).select("address_id", "rule_id", "code", "resolvable_by")


def obligations(spark, sf_dir):
    return decide.obligations(_decided(spark, sf_dir, "deposit", 1.5)).select("address_id", "rule_id", "constraint_no")


def would_be(spark, sf_dir):
    return decide.upcoming(_decided(spark, sf_dir, "algo", None, ("2025-12-31",))).select("address_id", "rule_id", "status", "would_be")


def city_groups(spark, sf_dir):
    return decide.city_groups(_decided(spark, sf_dir, "deposit", 2.0))


def known_gaps(spark, sf_dir):
    places = _asked(spark, sf_dir, (fx.AS_OF,), {"fee": None})
    return decide.gap_counts(places, fx.gaps(spark)).select("address_id", "n_gaps")


def change_points(spark, sf_dir):
    return envelope.change_points(fx.places(spark, sf_dir), fx.rules(spark)).select("address_id", "day", "label")


def envelope_amount(spark, sf_dir):
    places = fx.places(spark, sf_dir, ("2026-05-01",)).withColumn("action", F.lit("deposit"))
    axis = envelope.amount_axis(places, fx.rules(spark), fx.constraints(spark), fx.gaps(spark), 0.0, 12.0, "deposit")
    return axis.select("address_id", "from_value", "to_value", "decision")


def envelope_fact(spark, sf_dir):
    places = fx.places(spark, sf_dir).withColumn("action", F.lit("deposit"))
    return envelope.units_axis(places, fx.rules(spark), fx.constraints(spark), fx.gaps(spark), "deposit", 2.0).select("address_id", "from_units", "to_units", "decision")


def envelope_timeline(spark, sf_dir):
    places = fx.places(spark, sf_dir).withColumn("action", F.lit("algo"))
    return envelope.timeline(places, fx.rules(spark), fx.constraints(spark), fx.gaps(spark), "algo", None)


def _case_results(spark, sf_dir):
    return diff.case_results(fx.cases(spark), fx.addresses(spark, sf_dir), fx.rules(spark))


def diff_as_of(spark, sf_dir):
    found = diff.changed_results(_case_results(spark, sf_dir)).filter("affected")
    return found.select("case_id", "address_id", "team_rule_id", "flagged")


def diff_counts(spark, sf_dir):
    return diff.counts_per_date(_case_results(spark, sf_dir))


def diff_affected(spark, sf_dir):
    return diff.affected_sets(_case_results(spark, sf_dir))


LABELS = ["AFRICA-RENT-1", "N-RENT-P2", "NATION_1-FEE-3", "NATION_17-DEP-4", "bad label", "EUROPE-ALGO-P12", "NOWHERE-FEE-9"]
CODES = {"RENT": "rent", "ALGO": "algo", "DEP": "deposit", "FEE": "fee"}


def selector_resolve(spark, sf_dir):
    labels = spark.createDataFrame([(x.replace("_", ""),) for x in LABELS], "label string")
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").join(F.broadcast(spark.read.parquet(f"{sf_dir}/region.parquet")), F.col("n_regionkey") == F.col("r_regionkey"))  # five regions
    cities = nations.select(F.concat(F.translate("n_name", "_", ""), F.lit(", "), "r_name").alias("jurisdiction"))
    places = cities.unionByName(spark.read.parquet(f"{sf_dir}/region.parquet").select(F.col("r_name").alias("jurisdiction")))
    parsed = diff.parse_labels(labels, spark.createDataFrame(list(CODES.items()), "code string, category string"))
    return diff.resolve_places(parsed, places).select("label", "category", "proposal", "jurisdiction")


def changed_ids(spark, sf_dir):
    """Places whose decision differs between two dates."""
    done = _decided(spark, sf_dir, "algo", None, fx.DATES[1:])
    per = done.groupBy("address_id").pivot("as_of", [fx.DATES[1], fx.DATES[2]]).agg(F.first("decision"))
    return per.filter(F.col(fx.DATES[1]) != F.col(fx.DATES[2])).select("address_id", F.col(fx.DATES[1]).alias("before"), F.col(fx.DATES[2]).alias("after"))


def was_map(spark, sf_dir):
    """Every rule of a place with its result before and now; null where it was or is not_applicable."""
    done = _results(spark, sf_dir, fx.DATES[1:]).filter("result <> 'not_applicable'")
    on = lambda d, name: done.filter(F.col("as_of") == F.lit(d).cast("date")).select("address_id", "team_rule_id", F.col("result").alias(name))
    both = on(fx.DATES[1], "was").join(on(fx.DATES[2], "now"), ["address_id", "team_rule_id"], "full_outer")
    change = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "gone").when(F.col("was") != F.col("now"), "changed").otherwise("same")
    return both.withColumn("change", change)


def empty_cells(spark, sf_dir):
    return export.empty_cells(fx.rules(spark), list(fx.ACTIONS) + ["rent"])


def selfcheck_metrics(spark, sf_dir):
    return export.selfcheck_metrics(fx.rules(spark), fx.constraints(spark), _results(spark, sf_dir))


def ruleset_version(spark, sf_dir):
    return export.ruleset_version(fx.rules(spark).select("team_rule_id", F.concat_ws("|", "jurisdiction", "category", "legal_status").alias("content")))


QUERIES = {
    f.__name__: f
    for f in (
        derive_status, partial_date_bounds, interval_compare, minus_months, apply_results, apply_precedence, apply_conflicts, lookup_rows, result_counts, rule_links,
        batch_decisions, decision_counts, determining_rules, review_items, obligations, would_be, city_groups, known_gaps, change_points, envelope_amount, envelope_fact,
        envelope_timeline, diff_as_of, diff_counts, diff_affected, selector_resolve, changed_ids, was_map, empty_cells, selfcheck_metrics, ruleset_version,
    )
}

_ONE = oracle.applied()
_ALL = oracle.applied(fx.DATES)
_DEP = oracle.decided([("deposit", 2.0)])
_DEP15 = oracle.decided([("deposit", 1.5)])
_partials = oracle.values("p", "said", [(p,) for p in PARTIALS])
_CASES = [(c[0], c[1], r, d, s) for c in fx.CASES for r in c[2] for d in c[3] for s in (c[4] or [None])]
_FOUND = (
    oracle.applied(("2026-10-01", "2027-07-02")) + ",\n" + oracle.values("cs", "case_id, type, rid, d, st0", _CASES)
    + ",\nfound AS (SELECT case_id, type, f.* FROM flg f JOIN cs ON f.rid = cs.rid AND f.as_of = CAST(cs.d AS DATE) WHERE result <> 'not_applicable' AND (st0 IS NULL OR st0 = state))"
    + ",\nper AS (SELECT case_id, type, address_id, rid, CASE WHEN type = 'as_of' THEN count(*) < 2 OR count(DISTINCT result) > 1 ELSE TRUE END AS affected, bool_or(conflict_flag) AS flagged FROM found GROUP BY case_id, type, address_id, rid)"
)
_CMP = "CASE op WHEN 'lt' THEN CASE WHEN a2 < b1 THEN TRUE WHEN a1 >= b2 THEN FALSE END WHEN 'lte' THEN CASE WHEN a2 <= b1 THEN TRUE WHEN a1 > b2 THEN FALSE END WHEN 'gt' THEN CASE WHEN a1 > b2 THEN TRUE WHEN a2 <= b1 THEN FALSE END WHEN 'gte' THEN CASE WHEN a1 >= b2 THEN TRUE WHEN a2 < b1 THEN FALSE END ELSE CASE WHEN a1 = a2 AND b1 = b2 AND a1 = b1 THEN TRUE WHEN a2 < b1 OR a1 > b2 THEN FALSE END END"
_ISLANDS = """isl AS (SELECT *, sum(ch) OVER (PARTITION BY address_id ORDER BY k) AS island FROM (SELECT *, CASE WHEN lag(decision) OVER (PARTITION BY address_id ORDER BY k) = decision THEN 0 ELSE 1 END AS ch FROM pts))"""


def _amount_sql() -> str:
    ends = [("deposit", v) for v in (1.0, 1.5, 2.0, 3.0, 12.0)]
    return f"""WITH {oracle.decided(ends, ("2026-05-01",))}, pts AS (SELECT address_id, value AS k, decision FROM dec), {_ISLANDS},
m AS (SELECT address_id, island, max(k) AS to_value, any_value(decision) AS decision FROM isl GROUP BY ALL)
SELECT address_id, coalesce(lag(to_value) OVER (PARTITION BY address_id ORDER BY to_value), 0.0) AS from_value, to_value, decision FROM m"""


def _units_sql() -> str:
    """The same decisions with each candidate count put in place of the missing one."""
    head = oracle.decided([("deposit", 2.0)])
    asked = f"WITH {head} SELECT DISTINCT address_id FROM items WHERE contains(missing_facts, 'units') AND kind = 'review' AND address_id IN (SELECT address_id FROM addr WHERE units IS NULL)"
    widened = head.replace("addr AS (", "addr0 AS (", 1).replace(
        ",\nrules0(", f""",\naddr AS (SELECT a.address_id * 1000 + u AS address_id, state, legal_city, method, CAST(u AS INT) AS units, year_built FROM addr0 a, (VALUES (1), (2), (3), (4), (5)) AS t(u) WHERE a.address_id IN ({asked})),\nrules0(""", 1
    )
    return f"""WITH {widened}, pts AS (SELECT address_id // 1000 AS address_id, address_id % 1000 AS k, decision FROM dec), {_ISLANDS},
m AS (SELECT address_id, island, min(k) AS f, any_value(decision) AS decision FROM isl GROUP BY ALL)
SELECT address_id, CAST(f AS INT) AS from_units, CAST(lead(f) OVER (PARTITION BY address_id ORDER BY f) - 1 AS INT) AS to_units, decision FROM m"""


def _timeline_sql() -> str:
    """Decisions at every full date of the category's rules and the day before the first; all places share them."""
    days = sorted({d for r in fx.RULES if r[2] == "algo" and r[3] != "failed" for d in r[4:7] if d and len(d) == 10})
    before = oracle.literal("1900-01-01")
    head = oracle.decided([("algo", None)], ("1900-01-01", *days))
    return f"""WITH {head},
reach AS (SELECT DISTINCT a.address_id, d FROM addr a JOIN rules r ON (NOT is_city AND jur = state) OR (is_city AND jur = legal_city), unnest([r.enacted, r.effective, r.repeal]) AS t(d)
   WHERE r.cat = 'algo' AND r.ls <> 'failed' AND length(d) = 10 UNION SELECT address_id, {before} FROM addr),
pts AS (SELECT address_id, CAST(d AS DATE) AS k, decision FROM reach JOIN dec USING (address_id) WHERE dec.as_of = CAST(d AS DATE)), {_ISLANDS},
m AS (SELECT address_id, island, min(k) AS f, any_value(decision) AS decision FROM isl GROUP BY ALL)
SELECT address_id, CASE WHEN f = CAST({before} AS DATE) THEN NULL ELSE f END AS from_day, CAST(lead(f) OVER (PARTITION BY address_id ORDER BY f) - INTERVAL 1 DAY AS DATE) AS to_day, decision FROM m"""


ORACLE_SQL = {
    "derive_status": f"WITH {oracle.base(fx.DATES)} SELECT rid AS team_rule_id, as_of, CASE WHEN ls = 'failed' THEN 'failed' WHEN ls = 'pending' OR coalesce(en > as_of, FALSE) THEN 'pending' WHEN coalesce(re <= as_of, FALSE) THEN 'failed' WHEN coalesce(ef > as_of, FALSE) THEN 'not_yet_effective' ELSE 'in_force' END AS status FROM rules, dates",
    "partial_date_bounds": f"WITH {_partials}, f AS (SELECT said, CASE WHEN regexp_matches(said, '^[0-9]{{4}}(-(0[1-9]|1[0-2])(-[0-9]{{2}})?)?$') THEN try_cast(CASE length(said) WHEN 4 THEN said || '-01-01' WHEN 7 THEN said || '-01' ELSE said END AS DATE) END AS first_day FROM p) SELECT said, first_day, CASE length(said) WHEN 4 THEN make_date(year(first_day), 12, 31) WHEN 7 THEN last_day(first_day) ELSE first_day END AS last_day, first_day IS NOT NULL AS valid FROM f",
    "interval_compare": f"SELECT p_partkey, op, {_CMP} AS verdict FROM (SELECT p_partkey, op, p_size AS a1, p_size + p_partkey % 3 AS a2, 20 AS b1, 20 + p_partkey % 2 * 5 AS b2 FROM part, (VALUES ('lt'), ('lte'), ('gt'), ('gte'), ('eq')) AS o(op))",
    "minus_months": "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) - to_months(CAST(o_orderkey % 40 AS INT)) AS DATE) AS before FROM orders",
    "apply_results": f"WITH {_ONE} SELECT address_id, rid AS team_rule_id, r0 AS result, reason0 AS reason_code, missing0 AS missing_facts FROM res",
    "apply_precedence": f"WITH {_ALL} SELECT address_id, as_of, rid AS team_rule_id, result, reason_code, missing_facts FROM flg",
    "apply_conflicts": f"WITH {_ONE} SELECT address_id, rid AS team_rule_id, conflict_note FROM flg WHERE conflict_flag",
    "lookup_rows": f"WITH {_ONE} SELECT address_id, rid AS team_rule_id, result, conflict_flag FROM flg WHERE result <> 'not_applicable'",
    "result_counts": f"WITH {_ALL}, every AS (SELECT as_of, coalesce(result, 'not_applicable') AS result FROM addr CROSS JOIN rules CROSS JOIN dates LEFT JOIN (SELECT address_id, rid, as_of, result FROM flg) f USING (address_id, rid, as_of)) SELECT as_of, result, count(*) AS n FROM every GROUP BY ALL",
    "rule_links": f"WITH {oracle.base()} SELECT a.rid AS team_rule_id, string_agg(b.rid, ',' ORDER BY b.rid) AS linked FROM rules a JOIN rules b ON a.cat = b.cat AND a.st = b.st AND a.is_city <> b.is_city AND CASE WHEN a.is_city THEN b.relation ELSE a.relation END IN ('yields_to_stricter_local', 'preempts_local') GROUP BY a.rid",
    "batch_decisions": f"WITH {oracle.decided(list(REQUESTS.items()))} SELECT address_id, action, as_of, value, decision, decision IN ('PASS', 'REQUIRE') AS permit FROM dec",
    "decision_counts": f"WITH {oracle.decided([('deposit', 2.0)], fx.DATES)} SELECT as_of, count(*) FILTER (decision = 'PASS') AS n_pass, count(*) FILTER (decision = 'REQUIRE') AS n_require, count(*) FILTER (decision = 'REVIEW') AS n_review, count(*) FILTER (decision = 'BLOCK') AS n_block FROM dec GROUP BY as_of",
    "determining_rules": f"""WITH {_DEP15}, j AS (SELECT i.*, decision FROM items i JOIN dec d ON i.address_id = d.address_id)
SELECT address_id, decision, rid AS team_rule_id, effect, kind AS outcome, no AS constraint_no FROM j WHERE (decision = 'BLOCK' AND kind = 'violated') OR (decision = 'REQUIRE' AND kind IN ('obligation', 'satisfied')) OR (decision = 'PASS' AND kind = 'satisfied')
UNION ALL SELECT address_id, decision, rid, effect, 'unresolved', no FROM (SELECT *, row_number() OVER (PARTITION BY address_id, rid ORDER BY no NULLS LAST) AS n FROM j WHERE decision = 'REVIEW' AND kind = 'review' AND rid IS NOT NULL) WHERE n = 1""",
    "review_items": f"WITH {_DEP} SELECT address_id, rid AS rule_id, code, CASE WHEN rid IS NULL OR code IN ('conflict', 'limit_not_computable', 'constraint_not_modeled', 'conditional_prohibition') THEN '' ELSE concat_ws(',', CASE WHEN contains(missing_facts, 'units') THEN 'units' END, CASE WHEN contains(missing_facts, 'year_built') THEN 'year_built' END) END AS resolvable_by FROM items WHERE kind = 'review'",
    "obligations": f"WITH {_DEP15} SELECT address_id, rid AS rule_id, no AS constraint_no FROM items WHERE kind = 'obligation'",
    "would_be": f"""WITH {oracle.decided([('algo', None)], ('2025-12-31',))}, up AS (SELECT *, CASE WHEN length(effective) = 10 THEN ef ELSE as_of END AS starts_on FROM rc WHERE result IN ('pending', 'not_yet_effective')), {oracle._findings('uf', 'up', 'starts_on', 'TRUE')}
SELECT address_id, rid AS rule_id, result AS status, CASE WHEN result = 'not_yet_effective' AND count(no) > 0 THEN CASE WHEN bool_or(kind = 'violated') THEN 'BLOCK' WHEN bool_or(kind = 'review') THEN 'REVIEW' WHEN bool_or(kind = 'obligation') THEN 'REQUIRE' ELSE 'PASS' END END AS would_be FROM uf GROUP BY address_id, rid, result""",
    "city_groups": f"WITH {_DEP} SELECT coalesce(legal_city, 'City not resolved') AS city, count(*) FILTER (decision = 'PASS') AS n_pass, count(*) FILTER (decision = 'REQUIRE') AS n_require, count(*) FILTER (decision = 'REVIEW') AS n_review, count(*) FILTER (decision = 'BLOCK') AS n_block, legal_city IS NULL AS last FROM dec GROUP BY legal_city",
    "known_gaps": f"WITH {oracle.decided([('fee', None)])} SELECT address_id, count(*) AS n_gaps FROM items WHERE code = 'coverage_gap' GROUP BY address_id",
    "change_points": f"WITH {oracle.base()} SELECT DISTINCT address_id, CAST(u.d AS DATE) AS day, title || ' ' || u.what AS label FROM addr JOIN rules r ON (NOT is_city AND jur = state) OR (is_city AND jur = legal_city), unnest([{{'d': r.enacted, 'what': 'is enacted'}}, {{'d': r.effective, 'what': 'takes effect'}}, {{'d': r.repeal, 'what': 'is repealed'}}]) AS t(u) WHERE ls <> 'failed' AND length(u.d) = 10 AND NOT (is_city AND method = 'unresolved')",
    "envelope_amount": _amount_sql(),
    "envelope_fact": _units_sql(),
    "envelope_timeline": _timeline_sql(),
    "diff_as_of": f"WITH {_FOUND} SELECT case_id, address_id, rid AS team_rule_id, flagged FROM per WHERE affected",
    "diff_counts": f"WITH {_FOUND} SELECT case_id, as_of, result, count(*) AS n FROM found GROUP BY ALL",
    "diff_affected": f"WITH {_FOUND}, pa AS (SELECT case_id, address_id, bool_or(affected) AS a, bool_or(flagged) AS f FROM per GROUP BY ALL) SELECT case_id, count(*) FILTER (a) AS n_affected, count(*) FILTER (f) AS n_flagged FROM pa GROUP BY case_id",
    "selector_resolve": f"""WITH {oracle.values('l', 'label', [(x.replace('_', ''),) for x in LABELS])}, {oracle.values('codes', 'code, category', list(CODES.items()))},
j AS (SELECT replace(n_name, '_', '') || ', ' || r_name AS jur, upper(replace(n_name, '_', '')) AS city FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT r_name, NULL FROM region),
s AS (SELECT label, upper(split_part(label, '-', 1)) AS place, upper(split_part(label, '-', 2)) AS code, upper(split_part(label, '-', 3)) LIKE 'P%' AS proposal FROM l WHERE regexp_matches(label, '^([A-Za-z]+)-([A-Za-z]+)-([A-Za-z]*[0-9]+)$')),
h AS (SELECT label, jur, CASE WHEN city IS NULL THEN 1 WHEN place = city[1] THEN 2 ELSE 3 END AS tier FROM s JOIN j ON (city IS NULL AND upper(jur) = place) OR starts_with(city, place)),
h2 AS (SELECT label, jur, tier FROM h UNION ALL SELECT label, jur, 3 FROM h WHERE tier = 2),
t AS (SELECT label, tier, min(jur) AS jur FROM h2 GROUP BY ALL HAVING count(*) = 1), b AS (SELECT label, min_by(jur, tier) AS jur FROM t GROUP BY label)
SELECT s.label, category, proposal, b.jur AS jurisdiction FROM s LEFT JOIN codes USING (code) LEFT JOIN b ON b.label = s.label""",
    "changed_ids": f"WITH {oracle.decided([('algo', None)], fx.DATES[1:])} SELECT a.address_id, a.decision AS before, b.decision AS after FROM dec a JOIN dec b ON a.address_id = b.address_id WHERE a.as_of = DATE '{fx.DATES[1]}' AND b.as_of = DATE '{fx.DATES[2]}' AND a.decision <> b.decision",
    "was_map": f"WITH {oracle.applied(fx.DATES[1:])}, w AS (SELECT address_id, rid, result FROM flg WHERE as_of = DATE '{fx.DATES[1]}' AND result <> 'not_applicable'), n AS (SELECT address_id, rid, result FROM flg WHERE as_of = DATE '{fx.DATES[2]}' AND result <> 'not_applicable') SELECT address_id, rid AS team_rule_id, w.result AS was, n.result AS now, CASE WHEN w.result IS NULL THEN 'new' WHEN n.result IS NULL THEN 'gone' WHEN w.result <> n.result THEN 'changed' ELSE 'same' END AS change FROM w FULL OUTER JOIN n USING (address_id, rid)",
    "empty_cells": f"WITH {oracle.base()}, c(cat) AS (VALUES ('algo'), ('deposit'), ('fee'), ('rent')) SELECT j.jur AS jurisdiction, c.cat AS category FROM (SELECT DISTINCT jur FROM rules) j, c WHERE NOT EXISTS (SELECT 1 FROM rules r WHERE r.jur = j.jur AND r.cat = c.cat)",
    "selfcheck_metrics": f"""WITH {_ONE}, {oracle.values('cons', 'no, rid, action, effect, mx, hard, open_above, fy, untestable', [(i, *c) for i, c in enumerate(fx.CONSTRAINTS)])}
SELECT 'rules' AS metric, count(*) AS n FROM rules UNION ALL SELECT 'status:' || ls, count(*) FROM rules GROUP BY ls UNION ALL SELECT 'category:' || cat, count(*) FROM rules GROUP BY cat
UNION ALL SELECT 'constraints', count(*) FROM cons UNION ALL SELECT 'rules_with_constraint', count(DISTINCT rid) FROM cons UNION ALL SELECT 'result:' || result, count(*) FROM flg GROUP BY result
UNION ALL SELECT 'conflict_rules', count(DISTINCT rid) FROM flg WHERE conflict_flag UNION ALL SELECT 'inactive_affirmative', count(*) FROM flg WHERE result = 'applies' AND status <> 'in_force'""",
    "ruleset_version": f"WITH {oracle.base()} SELECT sha256(string_agg(rid || '=' || jur || '|' || cat || '|' || ls, chr(10) ORDER BY rid)) AS version FROM rules",
}
