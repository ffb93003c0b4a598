"""Queries of the whole envelope, flattened to rows, with the SQL they are compared with.

The SQL decides every point by itself: places with each fact put in place of the missing one, on every day that matters.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ruleweave.operators import whole_envelope
from ruleweave.plans import fixtures as fx
from ruleweave.plans import oracle
from ruleweave.plans.rule_queries import _asked


def _flat(rows):
    """(address_id, axis, pos, start, stop, outcome, told): one row an interval, region or span."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit("-"))
    shape = lambda x: F.coalesce(x["decision"], F.array_join(F.transform(x["intervals"], lambda i: F.concat_ws(":", i["from"], i["to"], i["decision"])), ","))
    bound = lambda b: F.coalesce(F.concat_ws("|", b["rule_id"], b["citation"], F.coalesce(b["text"], F.lit("-"))), F.lit("-"))
    row = lambda axis, x, outcome, told: F.struct(F.lit(axis).alias("axis"), text(x["from"]).alias("start"), text(x["to"]).alias("stop"), outcome.alias("outcome"), told.alias("told"))
    amounts = F.transform("permitted", lambda i: row("amount", i, i["decision"], bound(i["bound"])))
    region = lambda f: F.transform(f"by_{f}", lambda r: row(f, r, shape(r), F.lit("-")))
    regions = [region(f) for f in whole_envelope.FACTS]
    spans = F.transform("timeline", lambda s: row("time", s, shape(s), F.concat_ws("|", s["current"].cast("string"), F.array_join(s["causes"], ","), s["label"])))
    every = [F.transform(a, lambda x, i: F.struct(i.alias("pos"), x.alias("x"))) for a in (amounts, *regions, spans)]
    none = F.array().cast("array<struct<pos:int,x:struct<axis:string,start:string,stop:string,outcome:string,told:string>>>")
    return rows.select("address_id", F.explode(F.concat(*[F.coalesce(e, none) for e in every])).alias("e")).select("address_id", "e.pos", "e.x.*")


def _envelope(spark, sf_dir, action, value, limits):
    requests = _asked(spark, sf_dir, (fx.AS_OF,), {action: value})
    return whole_envelope.envelope(requests, fx.rules(spark), fx.constraints(spark), fx.gaps(spark), action, limits)


def envelope_open(spark, sf_dir):
    """Deposits of no amount yet: amounts, units, years and days, each with its amounts."""
    return _flat(_envelope(spark, sf_dir, "deposit", None, fx.ACTIONS["deposit"]))


def envelope_fixed(spark, sf_dir):
    """A fee of 40, with a figure that holds for one year."""
    return _flat(_envelope(spark, sf_dir, "fee", 40.0, fx.ACTIONS["fee"]))


def envelope_plain(spark, sf_dir):
    """An action without a parameter."""
    return _flat(_envelope(spark, sf_dir, "algo", None, None))


def envelope_reasons(spark, sf_dir):
    rows = _envelope(spark, sf_dir, "deposit", None, fx.ACTIONS["deposit"])
    return rows.select("address_id", F.size("permitted").alias("n_intervals"), F.exists("permitted", lambda i: i["permit"]).alias("permits"), "reason")


QUERIES = {f.__name__: f for f in (envelope_open, envelope_fixed, envelope_plain, envelope_reasons)}

#: Thresholds of each category, and the marks of its rules: jurisdiction, rule, order, day, label. Stated by hand.
_UNITS = {"deposit": (1, 2, 3, 4, 5), "fee": (1,), "algo": (1, 2, 3, 4)}
_YEARS = {"deposit": (2005, 2006, 2007, 2010, 2011, 2012), "fee": (1977, 1978, 1979), "algo": ()}
_MARKS = {
    "deposit": [
        ("MIDDLE EAST", "R12", 0, "1990-01-01", "Rule R12 is enacted"), ("MIDDLE EAST", "R12", 1, "1990-01-01", "Rule R12 takes effect"), ("MIDDLE EAST", "R12", 2, "2026-06-30", "Rule R12 is repealed"),
        ("AMERICA", "R15", 0, "2010-01-01", "Rule R15 is enacted"), ("AMERICA", "R15", 1, "2011-01-01", "Rule R15 takes effect"),
    ],
    "fee": [
        ("MIDDLE EAST", "R13", 0, "2024-01-01", "Rule R13 is enacted"), ("MIDDLE EAST", "R13", 3, "2026-01-01", "the figure Code R13 states for 2026 starts to apply"),
        ("MIDDLE EAST", "R13", 4, "2027-01-01", "the figure Code R13 states for 2026 stops applying"),
    ],
    "algo": [
        ("AMERICA", "R04", 0, "2025-10-06", "Rule R04 is enacted"), ("AMERICA", "R04", 1, "2026-01-01", "Rule R04 takes effect"), ("NATION_1, AMERICA", "R05", 1, "2025-07-03", "Rule R05 takes effect"),
        ("NATION_6, AMERICA", "R06", 1, "2026-12-01", "Rule R06 takes effect"), ("ASIA", "R07", 0, "2026-07-20", "Rule R07 is enacted"), ("ASIA", "R07", 1, "2027-07-01", "Rule R07 takes effect"),
        ("NATION_2, ASIA", "R08", 1, "2026-01-01", "Rule R08 takes effect"), ("EUROPE", "R09", 1, "2026-01-01", "Rule R09 takes effect"),
    ],
}
_ENDS = {"deposit": (0.0, [1.0, 1.5, 2.0, 3.0, 12.0]), "fee": (0.0, [50.0, 10000.0]), "algo": (0.0, [])}


def _day_before(day: str) -> str:
    return f"CAST(DATE '{day}' - INTERVAL 1 DAY AS DATE)"


def _points(action: str, value: float | None) -> str:
    """CTEs up to axis_rows: the outcome of every point; fixed is whether the request has a value or the action no parameter."""
    low, ends = _ENDS[action]
    fixed = value is not None or not ends
    asked = [(action, e) for e in ends] + ([(action, value)] if fixed else [])
    days = sorted({m[3] for m in _MARKS[action]})
    head = oracle.decided(asked, (fx.AS_OF,))
    head = head.replace("dates AS (SELECT CAST(d AS DATE) AS as_of FROM dates0)", "dates AS (SELECT CAST(d AS DATE) AS as_of FROM dates0 UNION SELECT d FROM (VALUES " + ", ".join(f"(DATE '{d}'), ({_day_before(d)})" for d in days) + ") AS t(d))" if days else "dates AS (SELECT CAST(d AS DATE) AS as_of FROM dates0)", 1)
    variants = [("units", u, "CAST({} AS INT)", "year_built") for u in _UNITS[action]] + [("year_built", y, "units", "CAST({} AS INT)") for y in _YEARS[action]]
    parts = ["SELECT address_id * 10000 AS address_id, state, legal_city, method, units, year_built FROM addr0"]
    for i, (fact, v, units, years) in enumerate(variants):
        parts.append(f"SELECT address_id * 10000 + {i + 1}, state, legal_city, method, {units.format(v)}, {years.format(v)} FROM addr0 WHERE {fact} IS NULL")
    head = head.replace("addr AS (", "addr0 AS (", 1).replace(",\nrules0(", ",\naddr AS (" + " UNION ALL ".join(parts) + "),\nrules0(", 1)
    table = oracle.values("variants", "vno, fact, v", [(i + 1, f, v) for i, (f, v, _, _) in enumerate(variants)] or [(-1, "none", 0)])
    at = "value IS NULL" if value is None else f"value = {value}"
    marks = oracle.values("marks", "jur, rid, seq, day, label", _MARKS[action])
    names = ", ".join(str(e) for e in ends)
    n = len(ends)
    shape = "decs[1]" if fixed else "array_to_string(iv, ',')"
    return f"""WITH {head}, {table}, {marks},
dd AS (SELECT address_id, as_of, list(decision ORDER BY value) FILTER (NOT ({at} AND {fixed})) AS ds, list(decision) FILTER ({at} AND {fixed}) AS decs FROM dec GROUP BY ALL),
lasts AS (SELECT *, [j FOR j IN range(1, {n + 1}) IF j = {n} OR ds[j] <> ds[j + 1]] AS ls FROM dd),
ivs AS (SELECT *, [CASE WHEN t = 1 THEN CAST({low} AS DOUBLE) ELSE CAST([{names or 'NULL'}][ls[t - 1]] AS DOUBLE) END || ':' || CAST([{names or 'NULL'}][ls[t]] AS DOUBLE) || ':' || ds[ls[t]] FOR t IN range(1, len(ls) + 1)] AS iv FROM lasts),
o AS (SELECT *, address_id // 10000 AS aid, address_id % 10000 AS vno, {shape} AS outcome FROM ivs),
asks AS (SELECT address_id // 10000 AS aid, bool_or(contains(missing_facts, 'units')) AS units, bool_or(contains(missing_facts, 'year_built')) AS year_built FROM items WHERE kind = 'review' AND address_id % 10000 = 0 AND as_of = DATE '{fx.AS_OF}' GROUP BY 1),
facts AS (SELECT o.aid, fact AS axis, v, outcome FROM o JOIN variants USING (vno) JOIN asks ON asks.aid = o.aid WHERE o.as_of = DATE '{fx.AS_OF}' AND CASE fact WHEN 'units' THEN asks.units ELSE asks.year_built END),
fisl AS (SELECT *, CASE WHEN lag(outcome) OVER w = outcome THEN 0 ELSE 1 END AS fresh FROM facts WINDOW w AS (PARTITION BY aid, axis ORDER BY v)),
fout AS (SELECT aid, axis, row_number() OVER w - 1 AS pos, CASE WHEN axis = 'year_built' AND row_number() OVER w = 1 THEN '-' ELSE CAST(v AS VARCHAR) END AS start, coalesce(CAST(lead(v) OVER w - 1 AS VARCHAR), '-') AS stop, outcome, '-' AS told
   FROM fisl WHERE fresh = 1 WINDOW w AS (PARTITION BY aid, axis ORDER BY v)),
reach AS (SELECT address_id AS aid, m.* FROM addr0 a JOIN marks m ON m.jur = a.state OR m.jur = a.legal_city),
causes AS (SELECT aid, CAST(day AS DATE) AS day, string_agg(DISTINCT rid, ',' ORDER BY rid) AS rids, string_agg(label, '; ' ORDER BY rid, seq) AS labels FROM reach GROUP BY ALL),
starts AS (SELECT aid, day FROM causes UNION ALL SELECT address_id, NULL FROM addr0),
spans AS (SELECT aid, day, lead(day) OVER (PARTITION BY aid ORDER BY day NULLS FIRST) AS nxt FROM starts),
tj AS (SELECT s.aid, s.day, o.outcome FROM spans s JOIN o ON o.aid = s.aid AND o.vno = 0 AND o.as_of = coalesce(s.day, CAST(nxt - INTERVAL 1 DAY AS DATE), DATE '{fx.AS_OF}')),
tisl AS (SELECT *, CASE WHEN lag(outcome) OVER (PARTITION BY aid ORDER BY day NULLS FIRST) = outcome THEN 0 ELSE 1 END AS fresh FROM tj),
tk AS (SELECT *, row_number() OVER w - 1 AS pos, CAST(lead(day) OVER w - INTERVAL 1 DAY AS DATE) AS stop FROM tisl WHERE fresh = 1 WINDOW w AS (PARTITION BY aid ORDER BY day NULLS FIRST)),
tout AS (SELECT tk.aid, 'time' AS axis, pos, coalesce(CAST(tk.day AS VARCHAR), '-') AS start, coalesce(CAST(stop AS VARCHAR), '-') AS stop, outcome,
   CASE WHEN coalesce(tk.day <= DATE '{fx.AS_OF}', TRUE) AND coalesce(DATE '{fx.AS_OF}' <= stop, TRUE) THEN 'true' ELSE 'false' END || '|' || coalesce(rids, '') || '|' || coalesce(labels, '') AS told FROM tk LEFT JOIN causes ON causes.aid = tk.aid AND causes.day = tk.day),
base AS (SELECT * FROM o WHERE vno = 0 AND as_of = DATE '{fx.AS_OF}'),
av AS (SELECT aid, t, unnest.e AS stop, CASE WHEN t = 1 THEN {low} ELSE CAST([{names or 'NULL'}][ls[t - 1]] AS DOUBLE) END AS start, CAST([{names or 'NULL'}][CASE WHEN t = 1 THEN 1 ELSE ls[t - 1] + 1 END] AS DOUBLE) AS first_at, ds[ls[t]] AS decision, ds[ls[t] + 1] AS after,
   CAST([{names or 'NULL'}][ls[t] + 1] AS DOUBLE) AS next_at FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS t FROM base) q, LATERAL (SELECT CAST([{names or 'NULL'}][q.ls[q.t]] AS DOUBLE) AS e) AS unnest WHERE {n} > 0),
part AS (SELECT address_id // 10000 AS aid, value, rid, bool_or(kind = 'violated') AS nv, bool_or(kind = 'review') AS nr, bool_or(kind = 'obligation') AS no, bool_or(kind = 'satisfied') AS ns FROM items WHERE rid IS NOT NULL AND address_id % 10000 = 0 AND as_of = DATE '{fx.AS_OF}' GROUP BY ALL),
inv AS (SELECT av.aid, t, rid FROM av JOIN part p ON p.aid = av.aid AND p.value = first_at AND CASE decision WHEN 'BLOCK' THEN nv WHEN 'REVIEW' THEN nr WHEN 'REQUIRE' THEN no OR ns ELSE ns END
   UNION SELECT av.aid, t, rid FROM av JOIN part p ON p.aid = av.aid AND p.value = next_at AND (nr OR CASE after WHEN 'BLOCK' THEN nv WHEN 'REVIEW' THEN nr WHEN 'REQUIRE' THEN no OR ns ELSE ns END)),
bnd AS (SELECT av.aid, av.t, arg_min(c.rid || '|Code ' || c.rid || '|' || coalesce(CASE WHEN c.mx = av.stop THEN w.vt ELSE w.ht END, '-'), c.no) AS told FROM av JOIN inv USING (aid, t) JOIN cons c ON c.rid = inv.rid AND c.action = '{action}' AND (c.mx = av.stop OR c.hard = av.stop) LEFT JOIN words w USING (no) WHERE after IS NOT NULL GROUP BY av.aid, av.t),
aout AS (SELECT av.aid, 'amount' AS axis, t - 1 AS pos, CAST(CAST(start AS DOUBLE) AS VARCHAR) AS start, CAST(stop AS VARCHAR) AS stop, decision AS outcome, coalesce(told, '-') AS told FROM av LEFT JOIN bnd USING (aid, t))"""


def _envelope_sql(action: str, value: float | None) -> str:
    words = oracle.values("words", "no, vt, ht, ot", [(k, *v) for k, v in fx.WORDINGS.items()])
    every = "SELECT * FROM fout UNION ALL SELECT * FROM tout UNION ALL SELECT * FROM aout"
    return _points(action, value).replace("WITH ", f"WITH {words}, ", 1) + f" SELECT aid AS address_id, axis, CAST(pos AS INT) AS pos, start, stop, outcome, told FROM ({every})"


ORACLE_SQL = {
    "envelope_open": _envelope_sql("deposit", None),
    "envelope_fixed": _envelope_sql("fee", 40.0),
    "envelope_plain": _envelope_sql("algo", None),
    "envelope_reasons": f"""{_points("deposit", None).replace("WITH ", "WITH " + oracle.values("words", "no, vt, ht, ot", [(k, *v) for k, v in fx.WORDINGS.items()]) + ", ", 1)}
SELECT aid AS address_id, CAST(count(*) AS INT) AS n_intervals, bool_or(outcome IN ('PASS', 'REQUIRE')) AS permits, CASE WHEN bool_or(outcome IN ('PASS', 'REQUIRE')) THEN NULL WHEN bool_or(outcome = 'REVIEW') THEN 'bound_not_computable' ELSE 'prohibited' END AS reason FROM aout GROUP BY aid""",
}
