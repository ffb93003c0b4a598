"""Queries of lists, forms, notes and selections over the driver's tables, with the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import functions as F

from ruleweave.functions import text as tx
from ruleweave.operators import answers, diff, stores, views
from ruleweave.plans import fixtures as fx
from ruleweave.plans import oracle
from ruleweave.plans.merge_queries import _CANDIDATES, candidates
from ruleweave.plans.rule_queries import CODES, _case_results, _decided


def _read(spark, sf_dir, table):
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def candidate_payloads(spark, sf_dir):
    return views.candidate_payload(candidates(spark, sf_dir)).select("id", "legal_status", "enacted_date", "effective_date", "source_doc_id")


def form_problems(spark, sf_dir):
    """Amounts and dates as typed: orders' prices as texts, some bent."""
    k, price = F.col("o_orderkey"), F.col("o_totalprice").cast("decimal(12,2)").cast("string")
    amount = F.when(k % 7 == 0, " ").when(k % 7 == 1, F.concat(price, F.lit("x"))).when(k % 7 == 2, F.concat(F.lit("-"), price)).otherwise(F.concat(F.lit(" "), price))
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    typed = F.when(k % 5 == 0, F.substring(day, 1, 7)).when(k % 5 == 1, F.replace(day, F.lit("-"), F.lit("/"))).otherwise(day)
    return _read(spark, sf_dir, "orders").select("o_orderkey", views.parameter_problem(amount, "Fee", "dollars", 0, 100000).alias("amount"), views.date_problem(typed).alias("day"))


def first_of_repeats(spark, sf_dir):
    lines = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", "l_partkey").distinct()
    return views.dedupe_first(lines, ["l_orderkey", "l_suppkey"], ["l_linenumber", "l_partkey"])


def sample_messages(spark, sf_dir):
    orders = _read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("ids"))
    return orders.select("o_custkey", views.sample_message(F.transform("ids", lambda i: i.cast("string"))).alias("said"))


def tracked_cases(spark, sf_dir):
    """Customers as cases with the days of their orders, some of them partial."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    rows = _read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("case_id"), F.when(F.col("o_orderkey") % 9 == 0, F.substring(day, 1, 7)).otherwise(day).alias("date"))
    return views.tracked_cases(rows)


def span_shares(spark, sf_dir):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    said = F.when(F.col("o_orderkey") % 3 == 0, F.substring(day, 1, 4)).when(F.col("o_orderkey") % 3 == 1, F.substring(day, 1, 7)).otherwise(day)
    return _read(spark, sf_dir, "orders").select("o_orderkey", F.round(views.share_of_span(said, F.lit("1993"), F.lit("1997-06")), 9).alias("share"))


def selected_rules(spark, sf_dir):
    """Rules that labels made of regions, categories and numbers name; a proposal names those not enacted."""
    regions = _read(spark, sf_dir, "region").select(F.col("r_name").alias("jurisdiction"))
    each = regions.withColumn("code", F.explode(F.array(*map(F.lit, CODES)))).withColumn("number", F.explode(F.array(F.lit("1"), F.lit("P2"))))
    labels = each.select(F.concat_ws("-", F.initcap("jurisdiction"), "code", "number").alias("label"))
    parsed = diff.parse_labels(labels, spark.createDataFrame(list(CODES.items()), "code string, category string"))
    return diff.select_rules(diff.resolve_places(parsed, regions), fx.rules(spark))


def rules_of_documents(spark, sf_dir):
    """Suppliers as documents: line items' parts cite one and are supported by another."""
    lines = _read(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()
    rules = lines.groupBy(F.col("l_partkey").alias("team_rule_id")).agg(F.min("l_suppkey").alias("source_doc_id"), F.collect_set("l_suppkey").alias("also_supported_by"))
    documents = _read(spark, sf_dir, "supplier").filter("s_suppkey % 4 = 1").select(F.col("s_suppkey").alias("doc"))
    return diff.select_by_document(documents, rules)


def case_notes(spark, sf_dir):
    """The notes of every change case over the customers' places."""
    found, cases = _case_results(spark, sf_dir), fx.cases(spark)
    places = fx.addresses(spark, sf_dir)
    wanted = cases.select("case_id", "states").withColumn("state", F.explode_outer("states"))
    per_state = places.groupBy(F.col("state").alias("s")).agg(F.count("*").alias("n"))
    scopes = wanted.join(per_state, F.col("state").isNull() | (F.col("state") == F.col("s"))).groupBy("case_id").agg(F.sum("n").alias("n"))
    return views.case_notes(cases, fx.rules(spark), diff.counts_per_date(found), scopes, diff.affected_sets(found))


def affected_ids(spark, sf_dir):
    """The places that each case affects, and whether it is flagged there."""
    per = diff.changed_results(_case_results(spark, sf_dir)).groupBy("case_id", "address_id").agg(F.bool_or("affected").alias("affected"), F.bool_or("flagged").alias("flagged"))
    return per.filter("affected OR flagged")


def pressed_decisions(spark, sf_dir):
    """Decisions of the two kinds that are pressed, with their counts in words."""
    chosen = answers.decision_filter(_decided(spark, sf_dir, "deposit", 2.0), ["REVIEW", "BLOCK"])
    per = chosen.groupBy("legal_city").agg(F.count_if(F.col("decision") == "BLOCK").alias("b"), F.count_if(F.col("decision") == "REVIEW").alias("r"))
    named = F.array(F.struct(F.lit("blocked").alias("name"), F.col("b").alias("n")), F.struct(F.lit("to review").alias("name"), F.col("r").alias("n")))
    return per.select("legal_city", answers.count_words(named).alias("said"), answers.plural(F.col("b") + F.col("r"), "place").alias("places"))


def safe_links(spark, sf_dir):
    k = F.col("page_id")
    url = F.when(k % 3 == 0, F.replace("url", F.lit("http"), F.lit("HTTP"))).when(k % 3 == 1, F.concat(F.lit("javascript:"), "url")).otherwise(F.col("url"))
    return _read(spark, sf_dir, "pages").select("page_id", tx.safe_href(url).alias("href"), stores.clamp(k / 100).alias("share"))


QUERIES = {
    f.__name__: f
    for f in (
        candidate_payloads, form_problems, first_of_repeats, sample_messages, tracked_cases, span_shares, selected_rules, rules_of_documents, case_notes, affected_ids, pressed_decisions, safe_links,
    )
}

_DAY = "strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d')"
_FLOOR = "CAST(CASE o_orderkey % 3 WHEN 0 THEN strftime(CAST(o_orderdate AS DATE), '%Y-01-01') WHEN 1 THEN strftime(CAST(o_orderdate AS DATE), '%Y-%m-01') ELSE strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') END AS DATE)"
_PICKS = oracle.values("cs", "case_id, type, pos, rid", [(c[0], c[1], i, r) for c in fx.CASES for i, r in enumerate(c[2])])


def _case_sql() -> str:
    """CTEs of the cases' results by date: fr (case, place, rule, date, result, flag), cd (case, type, date)."""
    dates = tuple(sorted({d for c in fx.CASES for d in c[3]}))
    cd = oracle.values("cd0", "case_id, type, d, pos", [(c[0], c[1], d, i) for c in fx.CASES for i, d in enumerate(c[3])])
    st = oracle.values("st", "case_id, state", [(c[0], s) for c in fx.CASES for s in c[4] or []])
    return f"""{oracle.applied(dates)}, {_PICKS}, {cd}, {st}, cd AS (SELECT *, CAST(d AS DATE) AS as_of FROM cd0),
fr AS (SELECT cs.case_id, cs.type, f.address_id, f.rid, f.as_of, f.result, f.conflict_flag FROM cs JOIN cd USING (case_id) JOIN flg f ON f.rid = cs.rid AND f.as_of = cd.as_of
  WHERE f.result <> 'not_applicable' AND (f.state IN (SELECT state FROM st WHERE st.case_id = cs.case_id) OR cs.case_id NOT IN (SELECT case_id FROM st))),
nd AS (SELECT case_id, count(DISTINCT d) AS nd FROM cd GROUP BY 1),
ch AS (SELECT fr.case_id, address_id, rid, CASE WHEN fr.type = 'as_of' THEN nd >= 2 AND (count(DISTINCT result) > 1 OR count(DISTINCT as_of) < 2) ELSE TRUE END AS affected, bool_or(conflict_flag) AS flagged FROM fr JOIN nd USING (case_id) GROUP BY fr.case_id, fr.type, address_id, rid, nd),
af AS (SELECT case_id, address_id, bool_or(affected) AS affected, bool_or(flagged) AS flagged FROM ch GROUP BY ALL)"""


ORACLE_SQL = {
    "candidate_payloads": f"WITH {_CANDIDATES} SELECT id, ls AS legal_status, en AS enacted_date, ef AS effective_date, doc AS source_doc_id FROM c",
    "form_problems": f"""SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'Enter fee in dollars.' WHEN o_orderkey % 7 = 1 THEN 'Fee must be a number of dollars.' WHEN o_orderkey % 7 = 2 THEN 'Fee must be more than 0 dollars.' WHEN CAST(o_totalprice AS DECIMAL(12,2)) > 100000 THEN 'Fee must be at most 100000 dollars.' END AS amount,
 CASE WHEN length({_DAY}) <> 10 OR o_orderkey % 5 IN (0, 1) THEN 'Enter the date as year-month-day, for example 2026-10-01.' END AS day FROM orders""",
    "first_of_repeats": "SELECT DISTINCT l_orderkey, l_suppkey, l_linenumber, l_partkey FROM lineitem QUALIFY rank() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_linenumber, l_partkey) = 1",
    "sample_messages": "SELECT o_custkey, array_to_string(list_sort(list(o_orderkey))[:5], ', ') || CASE WHEN count(*) > 5 THEN ', ... (' || count(*) || ' total)' ELSE '' END AS said FROM orders GROUP BY o_custkey",
    "tracked_cases": f"SELECT o_custkey AS case_id, last_day, CAST(row_number() OVER (ORDER BY last_day, o_custkey) AS INT) AS place FROM (SELECT o_custkey, max(CASE WHEN o_orderkey % 9 = 0 THEN left({_DAY}, 7) ELSE {_DAY} END) AS last_day FROM orders GROUP BY 1) WHERE length(last_day) = 10",
    "span_shares": f"SELECT o_orderkey, round(least(1.0, greatest(0.0, date_diff('day', DATE '1993-01-01', {_FLOOR})::DOUBLE / date_diff('day', DATE '1993-01-01', DATE '1997-06-01'))), 9) AS share FROM orders",
    "selected_rules": f"""WITH {oracle.base()}, l AS (SELECT r_name, code, cat, num FROM region, (VALUES ('RENT', 'rent'), ('ALGO', 'algo'), ('DEP', 'deposit'), ('FEE', 'fee')) AS c(code, cat), (VALUES ('1'), ('P2')) AS n(num) WHERE NOT contains(r_name, ' '))
SELECT left(r_name, 1) || lower(substr(r_name, 2)) || '-' || code || '-' || num AS label, rid AS team_rule_id FROM l JOIN rules ON jur = r_name AND rules.cat = l.cat WHERE CASE WHEN num = 'P2' THEN ls <> 'enacted' ELSE ls = 'enacted' END""",
    "rules_of_documents": "SELECT DISTINCT l_suppkey AS doc, l_partkey AS team_rule_id FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 4 = 1)",
    "affected_ids": f"WITH {_case_sql()} SELECT * FROM af WHERE affected OR flagged",
    "case_notes": f"""WITH {_case_sql()}, sc AS (SELECT c.case_id, count(*) AS n FROM (SELECT DISTINCT case_id FROM cd) c JOIN addr a ON a.state IN (SELECT state FROM st WHERE st.case_id = c.case_id) OR c.case_id NOT IN (SELECT case_id FROM st) GROUP BY 1),
pk AS (SELECT case_id, string_agg(rid || ' -> ' || rid, '; ' ORDER BY pos) AS s, string_agg(rid || ' is "' || title || '" (legal status ' || ls || CASE WHEN ls = 'failed' THEN '; the rule failed and is not in force' ELSE '' END || ').', ' ' ORDER BY pos) AS t FROM cs JOIN rules USING (rid) GROUP BY case_id),
rs1 AS (SELECT case_id, as_of, result, count(*) AS n FROM fr GROUP BY ALL), rs2 AS (SELECT cd.case_id, cd.pos, cd.d, string_agg(result || ' ' || n, ', ' ORDER BY result) AS t FROM cd LEFT JOIN rs1 USING (case_id, as_of) GROUP BY ALL),
rt AS (SELECT case_id, string_agg('Results on ' || d || ': ' || coalesce(t, 'none') || '.', ' ' ORDER BY pos) AS t FROM rs2 GROUP BY 1),
dt2 AS (SELECT case_id, any_value(type) AS type, string_agg(d, ' and ' ORDER BY pos) AS ds, arg_min(d, pos) AS d1 FROM cd GROUP BY 1), sts AS (SELECT case_id, string_agg(state, ', ') AS t FROM st GROUP BY 1),
na AS (SELECT case_id, count(*) FILTER (affected) AS a, count(*) FILTER (flagged) AS f FROM af GROUP BY 1)
SELECT d.case_id, concat_ws(' ', 'Selected ' || coalesce(pk.s, 'nothing') || '.', pk.t, 'Evaluated on ' || CASE WHEN type = 'as_of' THEN ds ELSE d1 END || ' over ' || coalesce(sc.n, 0) || CASE WHEN sc.n = 1 THEN ' address' ELSE ' addresses' END || CASE WHEN sts.t IS NULL THEN '' ELSE ' in ' || sts.t END || '.', rt.t,
 coalesce(na.a, 0) || CASE WHEN na.a = 1 THEN ' address' ELSE ' addresses' END || ' affected, ' || coalesce(na.f, 0) || ' flagged for conflict.') AS notes
FROM dt2 d LEFT JOIN pk USING (case_id) LEFT JOIN sc USING (case_id) LEFT JOIN rt USING (case_id) LEFT JOIN sts USING (case_id) LEFT JOIN na USING (case_id)""",
    "pressed_decisions": f"""WITH {oracle.decided([("deposit", 2.0)])}, p AS (SELECT legal_city, count(*) FILTER (decision = 'BLOCK') AS b, count(*) FILTER (decision = 'REVIEW') AS r FROM dec WHERE decision IN ('BLOCK', 'REVIEW') GROUP BY 1)
SELECT legal_city, concat_ws(', ', CASE WHEN b > 0 THEN b || ' blocked' END, CASE WHEN r > 0 THEN r || ' to review' END) AS said, (b + r) || CASE WHEN b + r = 1 THEN ' place' ELSE ' places' END AS places FROM p""",
    "safe_links": "SELECT page_id, CASE page_id % 3 WHEN 0 THEN CASE WHEN regexp_matches(replace(url, 'http', 'HTTP'), '^(?i)https?://') THEN replace(url, 'http', 'HTTP') END WHEN 2 THEN CASE WHEN regexp_matches(url, '^(?i)https?://') THEN url END END AS href, greatest(0.0, least(1.0, page_id / 100.0))::DOUBLE AS share FROM pages",
}
