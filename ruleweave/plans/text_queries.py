"""Queries of the text functions over wordings that the tables' keys choose, with the SQL each is compared with."""

from __future__ import annotations

from pyspark.sql import functions as F

from ruleweave.functions import text as tx
from ruleweave.operators import consolidate, resolve
from ruleweave.operators.common import dealt
from ruleweave.plans import fixtures as fx
from ruleweave.plans import wordings as w


def _parts(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("k"))


def parse_header(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", tx.parse_header(F.concat(w.worded(F.col("doc_id"), w.HEADERS), "text")).alias("h")).select("doc_id", "h.*")


def normalize_citation(spark, sf_dir):
    return _parts(spark, sf_dir).select("k", tx.normalize_citation(w.worded(F.col("k"), w.CITATIONS)).alias("plain"))


def team_rule_id(spark, sf_dir):
    said = [w.worded(F.col("k"), x) for x in (w.PLACES, w.CATEGORIES, w.CITATIONS)]
    return _parts(spark, sf_dir).select("k", tx.team_rule_id(*said).alias("team_rule_id"))


def citation_in_source(spark, sf_dir):
    return _parts(spark, sf_dir).select("k", tx.citation_in_source(w.worded(F.col("k"), w.CITATIONS), w.worded(F.col("k"), w.SOURCES)).alias("found"))


def parse_quantity(spark, sf_dir):
    # keys are few bytes and lie in few files; the work on each is spread
    return dealt(_parts(spark, sf_dir), "k").select("k", tx.single(tx.parse_months(w.worded(F.col("k"), w.MONTHS))).alias("months"))


def parse_dollars(spark, sf_dir):
    return _parts(spark, sf_dir).select("k", tx.single(tx.parse_dollars(w.worded(F.col("k"), w.DOLLARS))).alias("dollars"))


def unit_bounds(spark, sf_dir):
    return _parts(spark, sf_dir).select("k", tx.unit_bounds(w.worded(F.col("k"), w.UNITS)).alias("b")).select("k", "b.units_min", "b.units_max")


def html_text(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    shown = tx.html_to_text(F.concat("html", w.worded(F.col("page_id"), w.PAGES)))
    return pages.select("page_id", F.length(shown).cast("long").alias("n_chars"), F.md5(shown).alias("digest"))


def build_variants(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("k"))
    zip_code = F.when(F.col("k") % 4 != 0, F.lpad((F.col("k") % 90000).cast("string"), 5, "0"))
    made = rows.select("k", F.posexplode(resolve.build_variants(w.worded(F.col("k"), w.STREETS), F.lit("Town"), F.lit("CA"), zip_code)).alias("n", "v"))
    return made.select("k", "n", "v.variant", "v.query")


def resolve_status(spark, sf_dir):
    """Orders of a customer as candidates of one law; the lowest is the primary."""
    status = F.when(F.col("o_orderkey") % 5 == 0, "failed").when(F.col("o_orderkey") % 3 == 0, "pending").otherwise("enacted")
    few = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", status.alias("s"), (F.col("o_custkey") * 10 + F.col("o_orderkey") % 4).alias("law"))
    grouped = few.groupBy("law").agg(F.min_by("s", "o_orderkey").alias("own"), F.collect_set("s").alias("kinds"), F.bool_or((F.col("s") == "enacted") & (F.col("o_orderkey") % 2 == 0)).alias("dated"))
    return grouped.select("law", consolidate.resolve_status(F.col("own"), F.col("kinds"), F.col("dated")).alias("r")).select("law", "r.status", "r.conflict")


def grouping_problem(spark, sf_dir):
    """Lines of an order grouped by a rule that for most orders breaks something."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("cell"), F.col("l_linenumber").cast("int").alias("n")).distinct()
    named = lambda n: F.concat(F.col("cell").cast("string"), F.lit("#"), n.cast("string"))
    members = lines.select("cell", named(F.col("n")).alias("candidate_id"))
    kind, n = F.col("cell") % 5, F.col("n")
    primary = F.when((kind == 4) & (n == 1), F.lit(0)).otherwise(n)
    own = lines.filter(~((kind == 1) & (n == 1))).select("cell", n.alias("group_no"), named(n).alias("member_id"), named(primary).alias("primary_id"))
    again = lines.filter((kind == 2) & (n == 1)).select("cell", F.lit(99).alias("group_no"), named(n).alias("member_id"), named(n).alias("primary_id"))
    strange = lines.filter((kind == 3) & (n == 1)).select("cell", F.lit(98).alias("group_no"), F.lit("zz").alias("member_id"), F.lit("zz").alias("primary_id"))
    return consolidate.grouping_problem(own.unionByName(again).unionByName(strange), members)


def chunk_documents(spark, sf_dir):
    chunks = consolidate.chunk_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), 4000, 300)
    return chunks.select("doc_id", "chunk", "start", "end", F.md5("text").alias("digest"))


def resolve_places(spark, sf_dir):
    """Lookups of customers: some agree on a place, some name several, some match nothing, some were never made."""
    n = F.col("address_id")
    a = fx.addresses(spark, sf_dir).select("address_id", "state", F.concat(F.lit("P"), (n % 4).cast("string")).alias("postal_city"))
    asked = a.filter("address_id % 6 <> 5").select("address_id", "state", F.explode(F.sequence(F.lit(1), (n % 3 + 1).cast("int"))).alias("m"))
    place = F.when(n % 7 == 0, F.lit(None)).otherwise(F.concat(F.lit("P"), F.when(n % 2 == 0, n % 4).otherwise((n + F.col("m")) % 4).cast("string")))
    nothing = n % 13 == 0
    attempts = asked.select(
        "address_id", F.lit(1).alias("attempt_no"), F.when(n % 5 == 0, "without_zip").otherwise("as_given").alias("variant"),
        F.when(nothing, F.lit(None)).when(n % 11 == 0, "ELSEWHERE").otherwise(F.upper("state")).alias("matched_state"), F.when(~nothing, place).cast("string").alias("place"),
        F.when(~nothing, F.concat(F.lit("C"), (n % 3).cast("string"))).alias("county"),
    )
    return resolve.resolve(attempts, a)


QUERIES = {
    f.__name__: f
    for f in (
        parse_header, normalize_citation, team_rule_id, citation_in_source, parse_quantity, parse_dollars, unit_bounds, html_text, build_variants, resolve_status, grouping_problem,
        chunk_documents, resolve_places,
    )
}

_DASHES = "‐‑‒–—―−"
_PLAIN = r"trim(regexp_replace(regexp_replace(replace(lower({c}), '§', ' '), '\b(?:sections?|sec)\b\.?', ' ', 'g'), '\s+', ' ', 'g'))"
_NAMES = "['one', 'first', 'two', 'three', 'four', 'five', 'six', 'seven', 'eight', 'nine', 'ten', 'eleven', 'twelve']"
_NUMBER = r"(\d+(?:\.\d+)?|one|first|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve)"
_VALUE = f"coalesce(TRY_CAST(x AS DOUBLE), CAST(([1, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12])[list_position({_NAMES}, x)] AS DOUBLE))"
_CITED = w.worded_sql("p_partkey", w.CITATIONS)
_DASHED = f"translate({{c}}, '{_DASHES}', '{'-' * len(_DASHES)}')"


def _months_sql() -> str:
    steps = [(rf"\b{_NUMBER} and (?:one|a) half\b", f"{_VALUE} + 0.5"), (r"\b(\d+) 1/2\b", "CAST(x AS DOUBLE) + 0.5"), (r"\b(one half|half (?:of )?(?:a|one) month)\b", "0.5::DOUBLE")]
    steps += [(r"\b(twice|double)\b", "2.0::DOUBLE"), (rf"\b{_NUMBER} (?:times|months?\b)", _VALUE)]
    fold = f"trim(regexp_replace(translate(lower({w.worded_sql('p_partkey', w.MONTHS)}), '‘’′-{_DASHES}', '''''''{' ' * (1 + len(_DASHES))}'), '\\s+', ' ', 'g'))"
    sql = rf"WITH t0 AS (SELECT p_partkey AS k, regexp_replace({fold}, '\btimes (?:the )?(?:one|a|1) month(?:''s|s'')?(?: rent)?', ' times ', 'g') AS t, []::DOUBLE[] AS f FROM part)"
    for i, (pattern, value) in enumerate(steps):
        sql += f", t{i + 1} AS (SELECT k, regexp_replace(t, '{pattern}', ' ', 'g') AS t, list_concat(f, list_transform(regexp_extract_all(t, '{pattern}', 1), lambda x: {value})) AS f FROM t{i})"
    return sql + f" SELECT k, CASE WHEN len(list_distinct(f)) = 1 THEN f[1] END AS months FROM t{len(steps)}"


def _entity_sql() -> str:
    named = " ".join(f"WHEN e = '{n}' THEN {w.quoted(c)}" for n, c in tx.ENTITIES.items())
    number = "CASE WHEN regexp_matches(e, '^#x[0-9a-f]+$') THEN TRY_CAST('0x' || substr(e, 3) AS BIGINT) WHEN regexp_matches(e, '^#[0-9]+$') THEN TRY_CAST(substr(e, 2) AS BIGINT) END"
    return f"CASE WHEN {number} IS NOT NULL THEN chr(CAST({number} AS INT)) {named} END"


def _html_sql() -> str:
    sql = f"WITH a0 AS (SELECT page_id, html || {w.worded_sql('page_id', w.PAGES)} AS t FROM pages)"
    # RE2 has no back references: each hidden element by itself, in the order they stand, as none holds another here
    hidden = "|".join(rf"<{tag}\b[\s\S]*?</{tag}>" for tag in ("script", "style", "noscript", "svg", "head"))
    return (
        sql
        + rf", a1 AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(t, '(?i){hidden}', ' ', 'g'), '(?i)<(br|/p|/div|/li|/h[1-6]|/tr|/section|/article)\b[^>]*>', chr(10), 'g'), '<[^>]+>', ' ', 'g') AS t FROM a0)"
        + r", a2 AS (SELECT page_id, p, i, lower(regexp_extract(p, '^(#x?[0-9A-Fa-f]+|[A-Za-z]+);', 1)) AS e FROM (SELECT page_id, unnest(string_split(t, '&')) AS p, generate_subscripts(string_split(t, '&'), 1) AS i FROM a1))"
        + f", a3 AS (SELECT page_id, string_agg(CASE WHEN i = 1 THEN p WHEN c IS NULL THEN '&' || p ELSE c || substr(p, length(e) + 2) END, '' ORDER BY i) AS t FROM (SELECT *, {_entity_sql()} AS c FROM a2) GROUP BY page_id)"
        + r", a4 AS (SELECT page_id, regexp_replace(regexp_replace(t, '[ \t\x{00a0}]+', ' ', 'g'), '[ \r\f\x0B]*\n[ \r\f\x0B]*', chr(10), 'g') AS t FROM a3)"
        + r", a5 AS (SELECT page_id, regexp_replace(regexp_replace(t, '\n{3,}', chr(10) || chr(10), 'g'), '^[\s\x0B\x{feff}]+|[\s\x0B\x{feff}]+$', '', 'g') AS t FROM a4)"
        + " SELECT page_id, length(t) AS n_chars, md5(t) AS digest FROM a5"
    )


_UNIT_STEPS = [
    (r"(?i)(\d+)\s*(?:-|to)\s*(\d+)\s*-?\s*units?\b", "{1}", "{2}"),
    (r"(?i)>\s*(\d+)\s*-?\s*units?\b", "{1} + 1", "NULL"),
    (r"(?i)(\d+)\s*\+\s*units?\b", "{1}", "NULL"),
    (r"(?i)(\d+)\s*units?\s+or\s+more", "{1}", "NULL"),
]


def _units_sql() -> str:
    low, high = "", ""
    for pattern, least, most in _UNIT_STEPS:
        got = lambda e: e.replace("{1}", f"CAST(regexp_extract(d, '{pattern}', 1) AS INT)").replace("{2}", f"CAST(regexp_extract(d, '{pattern}', 2) AS INT)")  # noqa: B023, E731
        low += f" WHEN regexp_matches(d, '{pattern}') THEN {got(least)}"
        high += f" WHEN regexp_matches(d, '{pattern}') THEN {got(most)}"
    word = r"(?i)\b(two|three|four|five|six|seven|eight|nine|ten)\s+or\s+more\b"
    low += f" WHEN regexp_matches(d, '{word}') THEN list_position(['', 'two', 'three', 'four', 'five', 'six', 'seven', 'eight', 'nine', 'ten'], lower(regexp_extract(d, '{word}', 1)))"
    high += f" WHEN regexp_matches(d, '{word}') THEN NULL"
    one = " WHEN len(ones) = 1 THEN CAST(ones[1] AS INT)"
    # RE2 looks at no neighbours: separators are doubled, so that one match may eat what the next one needs
    ones = r"regexp_extract_all(regexp_replace(d, '([^A-Za-z0-9.])', '\1\1', 'g'), '(?:^|[^\d.])(\d+)\s{0,2}U(?:$|[^A-Za-z]|[A-Z]$|G(?:$|[^A-Za-z0-9_]))', 1)"
    return f"WITH u AS (SELECT p_partkey AS k, trim({w.worded_sql('p_partkey', w.UNITS)}) AS d FROM part), o AS (SELECT k, d, {ones} AS ones FROM u) SELECT k, CASE{low}{one} END::INT AS units_min, CASE{high}{one} END::INT AS units_max FROM o"


def _variants_sql() -> str:
    clean = lambda c: rf"regexp_replace(trim({c}), '\s+', ' ', 'g')"
    no_unit = clean(f"regexp_replace(core, '{resolve.UNIT}', '', 'g')")
    ranged = resolve.RANGE
    return rf"""WITH s AS (SELECT c_custkey AS k, {clean(w.worded_sql('c_custkey', w.STREETS))} AS s, CASE WHEN c_custkey % 4 <> 0 THEN ' ' || lpad(CAST(c_custkey % 90000 AS VARCHAR), 5, '0') ELSE '' END AS z FROM customer),
c AS (SELECT *, regexp_matches(s, '{ranged}') AS r, regexp_replace(s, '{ranged}', '\1 \3') AS core FROM s),
n AS (SELECT *, {no_unit} AS nu FROM c),
v AS (SELECT k, unnest([0, 1, 2, 3, 4, 5, 6]) AS i, unnest(['as_given', 'without_zip', 'ordinal_zero_removed', 'range_first', 'range_last', 'unit_removed', 'house_letter_removed']) AS variant,
  unnest([s || ', Town, CA' || z, s || ', Town, CA', regexp_replace(s, '{resolve.ZERO_ORDINAL}', '\1', 'g') || ', Town, CA', CASE WHEN r THEN core || ', Town, CA' END,
    CASE WHEN r THEN regexp_replace(s, '{ranged}', '\2 \3') || ', Town, CA' END, nu || ', Town, CA', regexp_replace(nu, '{resolve.HOUSE_LETTER}', '\1') || ', Town, CA']) AS query FROM n),
f AS (SELECT *, row_number() OVER (PARTITION BY k, query ORDER BY i) AS nth FROM v WHERE query IS NOT NULL)
SELECT k, CAST(row_number() OVER (PARTITION BY k ORDER BY i) - 1 AS INT) AS n, variant, query FROM f WHERE nth = 1"""


ORACLE_SQL = {
    "parse_header": rf"SELECT doc_id, nullif(regexp_extract(h, '(?m)^SOURCE:[ \t]*(\S+)[ \t]*$', 1), '') AS source_url, trim(nullif(regexp_extract(h, '(?m)^RETRIEVED:[ \t]*(\S.*)$', 1), '')) AS retrieved_at FROM (SELECT doc_id, substr({w.worded_sql('doc_id', w.HEADERS)} || text, 1, 2000) AS h FROM documents)",
    "normalize_citation": f"SELECT p_partkey AS k, {_PLAIN.format(c=_CITED)} AS plain FROM part",
    "team_rule_id": f"""WITH c AS (SELECT p_partkey AS k, {w.worded_sql('p_partkey', w.PLACES)} AS j, {w.worded_sql('p_partkey', w.CATEGORIES)} AS cat, {_PLAIN.format(c=_CITED)} AS plain FROM part)
SELECT k, concat_ws('-', upper(trim(split_part(j, ',', -1))), CASE WHEN contains(j, ',') THEN regexp_replace(regexp_replace(upper(trim(split_part(j, ',', 1))), '[^A-Z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') END,
 CASE cat {' '.join(f"WHEN '{c}' THEN '{x}'" for c, x in tx.CATEGORY_CODES.items())} END, substr(sha256(concat_ws('|', j, cat, plain)), 1, 6)) AS team_rule_id FROM c""",
    "citation_in_source": rf"""WITH c AS (SELECT p_partkey AS k, regexp_extract_all({_DASHED.format(c=_CITED)}, '(?:^|[^\w(])(\d[0-9A-Za-z]*(?:[.:-][0-9A-Za-z]+)*)', 1) AS t, {_DASHED.format(c=w.worded_sql('p_partkey', w.SOURCES))} AS s FROM part)
SELECT k, len(t) > 0 AND len(list_filter(t, lambda x: NOT contains(s, x))) = 0 AS found FROM c""",
    "parse_quantity": _months_sql(),
    "parse_dollars": rf"""WITH t AS (SELECT p_partkey AS k, regexp_replace({w.worded_sql('p_partkey', w.DOLLARS)}, '\s+', ' ', 'g') AS t FROM part),
f AS (SELECT k, list_distinct(list_transform(list_concat(regexp_extract_all(t, '\$\s?(\d[\d,]*(?:\.\d+)?)', 1), regexp_extract_all(t, '(?i)\b(\d[\d,]*(?:\.\d+)?)\s+dollars\b', 1)), lambda x: CAST(replace(x, ',', '') AS DOUBLE))) AS f FROM t)
SELECT k, CASE WHEN len(f) = 1 THEN f[1] END AS dollars FROM f""",
    "unit_bounds": _units_sql(),
    "html_text": _html_sql(),
    "build_variants": _variants_sql(),
    "resolve_status": """WITH s AS (SELECT o_custkey * 10 + o_orderkey % 4 AS law, o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'failed' WHEN o_orderkey % 3 = 0 THEN 'pending' ELSE 'enacted' END AS s FROM orders),
g AS (SELECT law, arg_min(s, o_orderkey) AS own, count(DISTINCT s) AS n, bool_or(s = 'enacted') AS e, bool_or(s = 'failed') AS f, bool_or(s = 'enacted' AND o_orderkey % 2 = 0) AS dated FROM s GROUP BY law)
SELECT law, CASE WHEN n < 2 OR (e AND f) THEN own WHEN f THEN 'failed' WHEN dated THEN 'enacted' ELSE own END AS status, n > 1 AND ((e AND f) OR (NOT f AND NOT dated)) AS conflict FROM g""",
    "grouping_problem": """WITH l AS (SELECT DISTINCT l_orderkey AS cell, l_linenumber AS n FROM lineitem)
SELECT cell, CASE WHEN NOT bool_or(n = 1) THEN NULL WHEN cell % 5 = 1 THEN 'id left out' WHEN cell % 5 = 2 THEN 'id in two groups' WHEN cell % 5 = 3 THEN 'unknown id' WHEN cell % 5 = 4 THEN 'primary outside its group' END AS problem FROM l GROUP BY cell""",
    "chunk_documents": r"""WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS (SELECT doc_id, t, 0 AS chunk, 0 AS start, NULL::INT AS fin FROM d),
c AS (SELECT doc_id, t, chunk, start, CASE WHEN start + 4000 >= length(t) THEN length(t) WHEN regexp_matches(h, '\n\n') THEN start + 2000 + length(regexp_extract(h, '^(?s:.*)\n\n')) WHEN regexp_matches(h, '\n') THEN start + 2000 + length(regexp_extract(h, '^(?s:.*)\n')) ELSE start + 4000 END::INT AS fin
  FROM (SELECT *, substr(t, start + 2001, 2000) AS h FROM s)
 UNION ALL
 SELECT doc_id, t, chunk, start, CASE WHEN start + 4000 >= length(t) THEN length(t) WHEN regexp_matches(h, '\n\n') THEN start + 2000 + length(regexp_extract(h, '^(?s:.*)\n\n')) WHEN regexp_matches(h, '\n') THEN start + 2000 + length(regexp_extract(h, '^(?s:.*)\n')) ELSE start + 4000 END::INT AS fin
  FROM (SELECT doc_id, t, chunk, start, substr(t, start + 2001, 2000) AS h FROM (
    SELECT doc_id, t, chunk + 1 AS chunk, (CASE WHEN nl > 0 AND nl < fin - back THEN back + nl ELSE back END)::INT AS start FROM (
      SELECT *, instr(substr(t, back + 1, fin - back), chr(10)) AS nl FROM (SELECT *, greatest(start + 1, fin - 300) AS back FROM c WHERE fin < length(t))))))
SELECT doc_id, chunk, start, fin AS "end", md5(substr(t, start + 1, fin - start)) AS digest FROM c""",
    "resolve_places": """WITH a AS (SELECT c_custkey AS n, r_name AS state, 'P' || CAST(c_custkey % 4 AS VARCHAR) AS postal FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey),
t AS (SELECT n, state, postal, m, CASE WHEN n % 7 = 0 THEN NULL ELSE 'P' || CAST(CASE WHEN n % 2 = 0 THEN n % 4 ELSE (n + m) % 4 END AS VARCHAR) END AS place FROM a, unnest(range(1, CAST(n % 3 + 2 AS INT))) AS u(m) WHERE n % 6 <> 5),
g AS (SELECT n, count(DISTINCT coalesce(place, '')) AS k, min(coalesce(place, '')) AS place, coalesce(bool_or(place = postal), FALSE) AS has FROM t WHERE n % 11 <> 0 AND n % 13 <> 0 GROUP BY n),
r AS (SELECT a.*, tr.n IS NOT NULL AS tried, coalesce(k, 0) = 1 AS sure, coalesce(k > 1 AND has, FALSE) AS amb, place, CASE WHEN a.n % 5 = 0 THEN 'without_zip' ELSE 'as_given' END AS variant FROM a LEFT JOIN g USING (n) LEFT JOIN (SELECT DISTINCT n FROM t) tr ON tr.n = a.n)
SELECT n AS address_id, state, CASE WHEN sure OR amb THEN 'C' || CAST(n % 3 AS VARCHAR) END AS county, CASE WHEN sure THEN CASE WHEN place <> '' THEN place || ', ' || state END WHEN tried THEN postal || ', ' || state END AS legal_city,
 CASE WHEN sure OR amb THEN 'geocoder' WHEN tried THEN 'postal_fallback' ELSE 'unresolved' END AS method,
 CAST(CASE WHEN sure THEN CASE WHEN n % 5 = 0 THEN 0.85 ELSE 0.95 END WHEN amb THEN 0.7 WHEN tried THEN 0.5 ELSE 0.0 END AS DOUBLE) AS confidence,
 CASE WHEN sure THEN 'one place by ' || variant || CASE WHEN place = '' THEN ', unincorporated' ELSE '' END WHEN amb THEN 'several places by ' || variant || ', the postal city kept' WHEN tried THEN 'no place by 1 variants, postal city' ELSE 'no attempt' END AS note FROM r""",
}
