"""DuckDB SQL the rule queries are compared with: conditions flattened to rows, three-valued logic by counting."""

from __future__ import annotations

from ruleweave.plans import fixtures as fx


def literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).upper()
    return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)


def values(name: str, columns: str, rows: list[tuple]) -> str:
    return f"{name}({columns}) AS (VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)})"


def flat_conditions() -> list[tuple]:
    """rule, group (0: requirements), fact, op, date, years, value, name, place, text."""
    out = []
    for r in fx.RULES:
        for g, items in enumerate([r[9], *r[10]]):
            out += [(r[0], g, *c[:6], pos, c[6]) for pos, c in enumerate(items)]
    return out


FLOOR = "CAST(CASE length({0}) WHEN 4 THEN {0} || '-01-01' WHEN 7 THEN {0} || '-01' ELSE {0} END AS DATE)"
CEIL = "CASE length({0}) WHEN 4 THEN CAST({0} || '-12-31' AS DATE) WHEN 7 THEN last_day(CAST({0} || '-01' AS DATE)) ELSE CAST({0} AS DATE) END"
NO_DATE = "CAST(NULL AS VARCHAR)"

ADDRESSES = """addr AS (SELECT c_custkey AS address_id, r_name AS state,
  CASE WHEN c_custkey % 50 = 0 OR c_custkey % 23 = 0 THEN NULL ELSE n_name || ', ' || r_name END AS legal_city,
  CASE WHEN c_custkey % 50 = 0 THEN 'unresolved' WHEN c_custkey % 37 = 0 THEN 'postal_fallback' ELSE 'geocoder' END AS method,
  CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE CAST(c_custkey % 40 + 1 AS INT) END AS units,
  CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE CAST(1940 + c_custkey % 85 AS INT) END AS year_built
  FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey)"""


def base(dates: tuple[str, ...] = (fx.AS_OF,)) -> str:
    """CTEs addr, rules, conds and dates."""
    rules = [(r[0], r[1], r[2], fx.title(r[0]), *r[3:8], r[8], f"own note of {r[0]}" if r[8] else None) for r in fx.RULES]
    return ",\n".join(
        [
            ADDRESSES,
            values("rules0", "rid, jur, cat, title, ls, enacted, effective, repeal, relation, own, note", rules),
            f"rules AS (SELECT *, contains(jur, ',') AS is_city, trim(split_part(jur, ',', -1)) AS st, {FLOOR.format('enacted')} AS en, {FLOOR.format('effective')} AS ef, {FLOOR.format('repeal')} AS re FROM rules0)",
            values("conds", "rid, grp, fact, op, dt, years, val, nm, pos, txt", flat_conditions()),
            values("dates0", "d", [(d,) for d in dates]),
            "dates AS (SELECT CAST(d AS DATE) AS as_of FROM dates0)",
        ]
    )


def applied(dates: tuple[str, ...] = (fx.AS_OF,)) -> str:
    """CTEs up to res (each rule alone), fin (after precedence) and flg (with conflicts)."""
    lo, hi = FLOOR.format("dt"), CEIL.format("dt")
    return (
        base(dates)
        + f""",
pairs AS (SELECT a.*, r.*, as_of, (method = 'unresolved' AND is_city AND st = state) AS cu,
    CASE WHEN ls = 'failed' THEN 'failed' WHEN ls = 'pending' OR coalesce(en > as_of, FALSE) THEN 'pending' WHEN coalesce(re <= as_of, FALSE) THEN 'failed'
         WHEN coalesce(ef > as_of, FALSE) THEN 'not_yet_effective' ELSE 'in_force' END AS status
  FROM addr a, rules r, dates WHERE (NOT is_city AND jur = state) OR (is_city AND jur = legal_city) OR (method = 'unresolved' AND is_city AND st = state)),
ops AS (SELECT p.address_id, p.as_of, p.rid, grp, fact, nm, pos, txt,
    CASE fact WHEN 'building_age_years' THEN replace(replace(replace(op, 'l', '#'), 'g', 'l'), '#', 'g') ELSE op END AS op2,
    CASE WHEN fact = 'units' THEN units ELSE date_diff('day', DATE '1900-01-01', make_date(year_built, 1, 1)) END AS a1,
    CASE WHEN fact = 'units' THEN units ELSE date_diff('day', DATE '1900-01-01', make_date(year_built, 12, 31)) END AS a2,
    CASE fact WHEN 'units' THEN val WHEN 'year_built' THEN date_diff('day', DATE '1900-01-01', CASE WHEN op IN ('lte', 'gt') THEN {hi} ELSE {lo} END)
         WHEN 'building_age_years' THEN date_diff('day', DATE '1900-01-01', CAST(p.as_of - to_months(CAST(round(years * 12) AS INT)) AS DATE)) END AS b1,
    CASE fact WHEN 'units' THEN val WHEN 'year_built' THEN date_diff('day', DATE '1900-01-01', CASE WHEN op IN ('lt', 'gte') THEN {lo} ELSE {hi} END)
         WHEN 'building_age_years' THEN date_diff('day', DATE '1900-01-01', CAST(p.as_of - to_months(CAST(round(years * 12) AS INT)) AS DATE)) END AS b2,
    year_built IS NULL AS no_year FROM pairs p JOIN conds c ON p.rid = c.rid),
vals AS (SELECT *, CASE fact WHEN 'unavailable' THEN NULL WHEN 'caveat' THEN grp = 0 ELSE
    CASE op2 WHEN 'lt' THEN CASE WHEN a2 < b1 THEN TRUE WHEN a1 >= b2 THEN FALSE END WHEN 'lte' THEN CASE WHEN a2 <= b1 THEN TRUE WHEN a1 > b2 THEN FALSE END
      WHEN 'gt' THEN CASE WHEN a1 > b2 THEN TRUE WHEN a2 <= b1 THEN FALSE END WHEN 'gte' THEN CASE WHEN a1 >= b2 THEN TRUE WHEN a2 < b1 THEN FALSE END
      ELSE CASE WHEN a1 = a2 AND b1 = b2 AND a1 = b1 THEN TRUE WHEN a2 < b1 OR a1 > b2 THEN FALSE END END END AS v FROM ops),
unk AS (SELECT *, CASE WHEN v IS NOT NULL THEN NULL WHEN fact = 'unavailable' THEN 'unavailable' WHEN fact = 'units' OR no_year THEN 'missing' ELSE 'ambiguous' END AS kind,
    CASE WHEN v IS NOT NULL THEN NULL WHEN fact = 'unavailable' THEN nm WHEN fact = 'units' THEN 'units' WHEN no_year THEN 'year_built' END AS missing FROM vals),
grps AS (SELECT address_id, as_of, rid, grp, CASE WHEN bool_or(v IS FALSE) THEN FALSE WHEN bool_or(v IS NULL) THEN NULL ELSE TRUE END AS g FROM unk GROUP BY ALL),
cov AS (SELECT address_id, as_of, rid, coalesce(bool_or(g IS FALSE) FILTER (grp = 0), FALSE) AS req_false, coalesce(bool_or(g IS NULL) FILTER (grp = 0), FALSE) AS req_null,
    coalesce(bool_or(g IS TRUE) FILTER (grp > 0), FALSE) AS ex_true, coalesce(bool_or(g IS NULL) FILTER (grp > 0), FALSE) AS ex_null FROM grps GROUP BY ALL),
why AS (SELECT u.address_id, u.as_of, u.rid, bool_or(kind = 'missing') AS k_missing, bool_or(kind = 'ambiguous') AS k_amb, string_agg(DISTINCT missing, ',' ORDER BY missing) AS missing
  FROM unk u JOIN grps g USING (address_id, as_of, rid, grp) WHERE v IS NULL AND (grp = 0 OR g IS NULL) GROUP BY ALL),
res AS (SELECT p.*, coalesce(req_false, FALSE) OR coalesce(ex_true, FALSE) AS c_false, coalesce(req_null, FALSE) OR coalesce(ex_null, FALSE) AS c_null,
    CASE WHEN status = 'failed' THEN 'not_applicable' WHEN cu THEN 'unknown' WHEN req_false OR ex_true THEN 'not_applicable' WHEN status = 'pending' THEN 'pending'
         WHEN status = 'not_yet_effective' THEN 'not_yet_effective' WHEN req_null OR ex_null THEN 'unknown' ELSE 'applies' END AS r0,
    CASE WHEN status = 'failed' THEN 'status_failed' WHEN cu THEN 'jurisdiction_unresolved' WHEN req_false THEN 'requirement_not_met' WHEN ex_true THEN 'exempt'
         WHEN status = 'pending' THEN 'status_pending' WHEN status = 'not_yet_effective' THEN 'status_not_yet_effective'
         WHEN req_null OR ex_null THEN CASE WHEN k_missing THEN 'missing_fact' WHEN k_amb THEN 'cutoff_ambiguous' ELSE 'unverifiable_condition' END ELSE 'covered' END AS reason0,
    CASE WHEN status = 'failed' THEN '' WHEN cu THEN 'legal_city' WHEN req_false OR ex_true THEN '' ELSE coalesce(missing, '') END AS missing0
  FROM pairs p LEFT JOIN cov USING (address_id, as_of, rid) LEFT JOIN why USING (address_id, as_of, rid)),
loc AS (SELECT address_id, as_of, cat, bool_or(r0 = 'applies') AS l_app, bool_or(r0 = 'unknown') AS l_unk FROM res WHERE is_city GROUP BY ALL),
fin AS (SELECT res.*, CASE WHEN NOT is_city AND relation = 'yields_to_stricter_local' AND r0 IN ('applies', 'unknown') AND l_app THEN 'superseded'
        WHEN NOT is_city AND relation = 'yields_to_stricter_local' AND r0 = 'applies' AND l_unk THEN 'unknown' ELSE r0 END AS result,
    CASE WHEN NOT is_city AND relation = 'yields_to_stricter_local' AND r0 IN ('applies', 'unknown') AND l_app THEN 'superseded_by_local'
        WHEN NOT is_city AND relation = 'yields_to_stricter_local' AND r0 = 'applies' AND l_unk THEN 'local_coverage_unknown' ELSE reason0 END AS reason_code
  FROM res LEFT JOIN loc USING (address_id, as_of, cat)),
clash AS (SELECT s.address_id, s.as_of, s.rid AS a, c.rid AS b, 'Possible conflict with ' || c.title || ' (' || c.jur || ', ' || c.rid || '): this rule''s text bars conflicting local ordinances.' AS na,
    'Possible conflict with ' || s.title || ' (' || s.jur || ', ' || s.rid || '), which bars conflicting local ordinances.' AS nb
  FROM fin s JOIN fin c USING (address_id, as_of, cat) WHERE NOT s.is_city AND s.relation = 'preempts_local' AND s.result <> 'not_applicable' AND c.is_city AND c.result <> 'not_applicable'),
notes AS (SELECT address_id, as_of, rid, string_agg(n, ' ' ORDER BY o) AS n FROM (SELECT address_id, as_of, a AS rid, na AS n, b AS o FROM clash UNION ALL SELECT address_id, as_of, b, nb, a FROM clash) GROUP BY ALL),
flg AS (SELECT fin.*, CASE WHEN result IN ('superseded') OR reason_code = 'local_coverage_unknown' THEN '' ELSE missing0 END AS missing_facts,
    result <> 'not_applicable' AND (own OR n IS NOT NULL) AS conflict_flag,
    CASE WHEN result <> 'not_applicable' THEN nullif(concat_ws(' ', CASE WHEN own THEN note END, n), '') END AS conflict_note FROM fin LEFT JOIN notes USING (address_id, as_of, rid))"""
    )


def decided(requests: list[tuple[str, float | None]], dates: tuple[str, ...] = (fx.AS_OF,)) -> str:
    """CTEs up to items (one row a finding or review item) and dec (one row a request)."""
    cons = [(i, *c) for i, c in enumerate(fx.CONSTRAINTS)]
    return (
        applied(dates)
        + ",\n"
        + values("cons", "no, rid, action, effect, mx, hard, open_above, fy, untestable", cons)
        + ",\n"
        + values("gaps", "jur, cat, txt", fx.GAPS)
        + ",\n"
        + values("req0", "action, v0", [tuple(r) for r in requests])
        + f""",
req AS (SELECT address_id, state, legal_city, as_of, action, CAST(v0 AS DOUBLE) AS value FROM addr, dates, req0),
rc AS (SELECT f.*, q.action, q.value, c.no, c.effect, c.mx, c.hard, c.open_above, c.fy, c.untestable FROM flg f JOIN req q ON f.address_id = q.address_id AND f.as_of = q.as_of AND f.cat = q.action
   LEFT JOIN cons c ON c.rid = f.rid AND c.action = q.action),
{_findings('found', 'rc', 'as_of', "result = 'applies'")},
viol AS (SELECT DISTINCT address_id, as_of, action, value, rid FROM found WHERE kind = 'violated'),
items AS (SELECT address_id, as_of, action, value, rid, title, kind, code, effect, no, missing_facts FROM found WHERE kind IS NOT NULL
  UNION ALL SELECT address_id, as_of, action, value, rid, title, 'review', CASE WHEN reason_code IN ('missing_fact', 'cutoff_ambiguous') THEN reason_code ELSE 'unverifiable_condition' END, NULL, NULL, missing_facts
    FROM (SELECT DISTINCT address_id, as_of, action, value, rid, title, reason_code, result, missing_facts FROM rc) WHERE result = 'unknown'
  UNION ALL SELECT d.address_id, d.as_of, d.action, d.value, d.rid, d.title, 'review', 'conflict', NULL, NULL, ''
    FROM (SELECT DISTINCT address_id, as_of, action, value, rid, title, result, conflict_flag FROM rc) d LEFT JOIN viol v ON d.address_id = v.address_id AND d.as_of = v.as_of AND d.action = v.action AND d.value IS NOT DISTINCT FROM v.value AND d.rid = v.rid
    WHERE result = 'applies' AND conflict_flag AND v.rid IS NULL
  UNION ALL SELECT address_id, as_of, action, value, NULL, NULL, 'review', 'coverage_gap', NULL, NULL, '' FROM req JOIN gaps ON gaps.cat = action AND gaps.jur IN (state, legal_city)),
dec AS (SELECT q.*, CASE WHEN bool_or(kind = 'violated') THEN 'BLOCK' WHEN bool_or(kind = 'review') THEN 'REVIEW' WHEN bool_or(kind = 'obligation') THEN 'REQUIRE' ELSE 'PASS' END AS decision
  FROM req q LEFT JOIN items i ON q.address_id = i.address_id AND q.as_of = i.as_of AND q.action = i.action AND q.value IS NOT DISTINCT FROM i.value GROUP BY q.address_id, q.state, q.legal_city, q.as_of, q.action, q.value)"""
    )


def _findings(name: str, source: str, day: str, where: str) -> str:
    limit = f"""CASE WHEN coalesce(fy <> year({day}), FALSE) THEN 'review' WHEN value <= mx THEN 'satisfied' WHEN value > hard THEN 'violated'
      WHEN value > mx AND hard IS NULL AND NOT open_above THEN 'violated' ELSE 'review' END"""
    kind = f"""CASE WHEN no IS NULL THEN 'review' WHEN effect = 'prohibit' THEN CASE WHEN untestable IS NULL THEN 'violated' ELSE 'review' END
      WHEN effect = 'limit' THEN {limit} WHEN effect = 'obligation' THEN 'obligation' END"""
    return f"""{name} AS (SELECT *, CASE WHEN kind <> 'review' THEN NULL WHEN no IS NULL THEN 'constraint_not_modeled' WHEN effect = 'prohibit' THEN 'conditional_prohibition' ELSE 'limit_not_computable' END AS code
  FROM (SELECT *, {kind} AS kind FROM {source} WHERE {where}))"""
