"""Queries of places resolved from cached answers, with the SQL they are compared with.

Every customer has a cached entry of one to three attempts whose matches follow from the key: in the state or not, in one place or
several, without a place, with the state in the address only. The SQL reads the same JSON by its own functions.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ruleweave.operators import resolve

# place, county and state of a match, by number; {k} is the customer's key
_MATCHES = (
    '{"matchedAddress":"{k} ELM ST, ALBA, CA, 9410","geographies":{"Incorporated Places":[{"BASENAME":"Alba"}],"Counties":[{"NAME":"North"}],"States":[{"STUSAB":"ca"}]}}',
    '{"matchedAddress":"{k} ELM ST, ALBA, CA 9411","geographies":{"Incorporated Places":[{"BASENAME":"Alba"}],"Counties":[{"NAME":"South"},{"NAME":"West"}]}}',
    '{"matchedAddress":"{k} ELM ST, BRIO, CA, 9412","geographies":{"Incorporated Places":[{"BASENAME":"Brio"}],"States":[{"STUSAB":"CA"}]}}',
    '{"matchedAddress":"{k} ELM ST, ALBA, NY, 1001","geographies":{"Incorporated Places":[{"BASENAME":"Alba"}],"States":[{"STUSAB":"NY"}]}}',
    '{"matchedAddress":"{k} ELM ST, CA","geographies":{"Counties":[{"NAME":"East"}],"Incorporated Places":[]}}',
    '{"geographies":{}}',
)
# the numbers of the matches of an attempt
_ANSWERS = ((0, 1), (0, 2), (3,), (4,), (), (2, 1, 0), (5, 3), (1,))
_VARIANTS = ("as_given", "without_zip", "unit_removed")


def _answer(numbers) -> str:
    return '{"result":{"addressMatches":[' + ",".join(_MATCHES[i] for i in numbers) + "]}}"


def cache(spark, sf_dir):
    k = F.col("c_custkey")
    pick = lambda shift: F.element_at(F.array(*[F.lit(_answer(a)) for a in _ANSWERS]), (F.floor(k / shift) % len(_ANSWERS) + 1).cast("int"))
    attempt = lambda i, shift: F.concat(F.lit('{"variant":"' + _VARIANTS[i] + '","response":'), pick(shift), F.lit("}"))
    tried = F.array_join(F.slice(F.array(attempt(0, 1), attempt(1, 8), attempt(2, 3)), F.lit(1), (k % 3 + 1).cast("int")), ",")
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").filter("c_custkey % 11 <> 0")
    return rows.select(k.alias("address_id"), F.replace(F.concat(F.lit('{"attempts":['), tried, F.lit("]}")), F.lit("{k}"), k.cast("string")).alias("entry"))


def addresses(spark, sf_dir):
    k = F.col("c_custkey")
    city = F.when(k % 5 == 0, " Brio ").when(k % 5 == 1, "San Ysidro").when(k % 5 == 2, "Dorchester").otherwise("Alba")
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(k.alias("address_id"), F.lit("CA").alias("state"), city.alias("postal_city"))


def cached_places(spark, sf_dir):
    return resolve.resolve_cached(addresses(spark, sf_dir), cache(spark, sf_dir))


def cached_match_states(spark, sf_dir):
    """Every match of every attempt, with its state, from the geography or from the address."""
    rows = cache(spark, sf_dir).select("address_id", F.posexplode(resolve.cached_matches(F.col("entry"))).alias("attempt_no", "a"))
    return rows.select("address_id", "attempt_no", F.posexplode("a.matches").alias("match_no", "m")).select("address_id", "attempt_no", "match_no", "m.state", "m.place", "m.county")


QUERIES = {f.__name__: f for f in (cached_places, cached_match_states)}

_CHOICES = "[" + ", ".join("'" + _answer(a) + "'" for a in _ANSWERS) + "]"
_CACHE = f"""e AS (SELECT c_custkey AS k, replace('{{"attempts":[' || array_to_string([
    '{{"variant":"as_given","response":' || ({_CHOICES})[c_custkey % 8 + 1] || '}}', '{{"variant":"without_zip","response":' || ({_CHOICES})[c_custkey // 8 % 8 + 1] || '}}', '{{"variant":"unit_removed","response":' || ({_CHOICES})[c_custkey // 3 % 8 + 1] || '}}'][:c_custkey % 3 + 1], ',') || ']}}', '{{k}}', c_custkey::VARCHAR) AS entry FROM customer WHERE c_custkey % 11 <> 0),
a AS (SELECT k, unnest(json_extract(entry, '$.attempts[*]')) AS a, generate_subscripts(json_extract(entry, '$.attempts[*]'), 1) - 1 AS an FROM e),
m AS (SELECT k, an, a->>'$.variant' AS variant, unnest(json_extract(a, '$.response.result.addressMatches[*]')) AS m, generate_subscripts(json_extract(a, '$.response.result.addressMatches[*]'), 1) - 1 AS mn FROM a),
x AS (SELECT k, an, mn, variant, m->>'$.matchedAddress' AS said, m->>'$.geographies."Incorporated Places"[0].BASENAME' AS place, m->>'$.geographies.Counties[0].NAME' AS county,
  coalesce(upper(m->>'$.geographies.States[0].STUSAB'), nullif(regexp_extract(m->>'$.matchedAddress', ',\\s*([A-Z]{{2}})\\s*,?\\s*\\d{{0,5}}\\s*$', 1), '')) AS state FROM m)"""

ORACLE_SQL = {
    "cached_match_states": f"WITH {_CACHE} SELECT k AS address_id, CAST(an AS INT) AS attempt_no, CAST(mn AS INT) AS match_no, state, place, county FROM x",
    "cached_places": f"""WITH {_CACHE}, ad AS (SELECT c_custkey AS k, CASE c_custkey % 5 WHEN 0 THEN 'Brio' WHEN 1 THEN 'San Ysidro' WHEN 2 THEN 'Dorchester' ELSE 'Alba' END AS city, c_custkey % 11 <> 0 AS asked, c_custkey % 3 + 1 AS n FROM customer),
g AS (SELECT *, CASE city WHEN 'San Ysidro' THEN 'San Diego, CA' ELSE city || ', CA' END AS legal FROM ad),
i AS (SELECT * FROM x WHERE state = 'CA'),
s AS (SELECT k, an, any_value(variant) AS variant, arg_min(struct_pack(p := place, c := county, s := said), mn) AS f FROM i GROUP BY k, an HAVING count(DISTINCT coalesce(place, '')) = 1),
s1 AS (SELECT k, arg_min(variant, an) AS variant, arg_min(f, an) AS f FROM s GROUP BY k),
b AS (SELECT i.k, variant, county, said FROM i JOIN g USING (k) WHERE place || ', CA' = legal QUALIFY row_number() OVER (PARTITION BY i.k ORDER BY an, mn) = 1)
SELECT g.k AS address_id, 'CA' AS state, CASE WHEN s1.k IS NOT NULL THEN f.c WHEN b.k IS NOT NULL THEN b.county END AS county, CASE WHEN s1.k IS NOT NULL THEN f.p || ', CA' WHEN asked THEN legal END AS legal_city,
 CASE WHEN s1.k IS NOT NULL OR b.k IS NOT NULL THEN 'geocoder' WHEN asked THEN 'postal_fallback' ELSE 'unresolved' END AS method, CASE WHEN s1.k IS NOT NULL THEN CASE s1.variant WHEN 'as_given' THEN 0.95 ELSE 0.85 END WHEN b.k IS NOT NULL THEN 0.7 WHEN asked THEN 0.5 ELSE 0.0 END::DOUBLE AS confidence,
 CASE WHEN s1.k IS NOT NULL THEN f.s WHEN b.k IS NOT NULL THEN b.said END AS matched_address,
 CASE WHEN s1.k IS NOT NULL THEN 'Census geocoder match (' || s1.variant || ')' || CASE WHEN f.p IS NULL THEN '; no incorporated place in the response (unincorporated)' ELSE '' END
  WHEN b.k IS NOT NULL THEN 'Census geocoder returned candidates in more than one place (' || b.variant || '); kept the candidate in the postal city.'
  WHEN asked THEN 'Postal fallback: the geocoder gave no unambiguous match for ' || n || ' address variants in CA; legal city from the postal ' || CASE city WHEN 'San Ysidro' THEN 'neighbourhood table' ELSE 'city name' END || '.' ELSE 'no cached answer' END AS note
FROM g LEFT JOIN s1 USING (k) LEFT JOIN b ON b.k = g.k""",
}
