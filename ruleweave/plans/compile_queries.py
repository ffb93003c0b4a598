"""Queries of acceptance and increments over documents, with the SQL they are compared with.

A clause is put behind every document's own text, so quotes are looked for in whole texts; what is proposed about it bends the clause in
ways that follow from the id. The SQL looks at texts, quotes and words itself.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ruleweave.functions import mentions
from ruleweave.operators import accept, increments

#: Clause, effect, figure, words of the figure, highest figure, its words.
CLAUSES = [
    ("No owner of the block may ask for more than 2 months of rent in advance.", "limit", 2.0, "2 months", None, None),
    ("The sum is held to 3 months of rent, adjusted each spring by the board.", "limit", 3.0, "3 months", 4.0, "4 months"),
    ("It is unlawful to set a price together with two or more competitors.", "prohibit", None, None, None, None),
    ("Whoever lets a room must hand over a signed copy within a week.", "obligation", None, None, None, None),
    ("In 2026 the charge is 2 months, and 5 months for furnished rooms.", "limit", 2.0, "2 months", 5.0, "5 months"),
    ("The list of rooms is kept at the desk of the third floor office.", "prohibit", None, None, None, None),
    ("The list of keys is kept at the desk of the second floor office.", "obligation", None, None, None, None),
]


def _documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("k"), F.coalesce("text", F.lit("")).alias("own"))
    pick = lambda i, kind="string": F.element_at(F.array(*[F.lit(c[i]).cast(kind) for c in CLAUSES]), (F.col("k") % len(CLAUSES) + 1).cast("int"))
    names = {"clause": pick(0), "effect": pick(1), "max": pick(2, "double"), "value_text": pick(3), "hard_max": pick(4, "double"), "hard_max_text": pick(5)}
    return docs.withColumns(names).withColumn("text", F.concat("own", F.lit("\n"), "clause"))


def _proposals(spark, sf_dir):
    k, null = F.col("k"), F.lit(None).cast("string")
    rows = _documents(spark, sf_dir)
    return rows.select(
        "k", F.concat(F.lit("R"), k.cast("string")).alias("rule_id"), F.lit("deposit").alias("action"), F.when(k % 11 != 0, "months").alias("parameter"), "effect",
        F.when(k % 5 == 0, F.concat("clause", F.lit(" Or so."))).otherwise(F.col("clause")).alias("evidence_quote"), F.when(k % 10 == 0, F.col("clause")).alias("repaired_quote"), null.alias("operative_quote"),
        F.when(k % 13 == 0, F.col("max") + 1).otherwise(F.col("max")).alias("max"), F.when(k % 17 == 0, "7 months").otherwise(F.col("value_text")).alias("value_text"),
        F.when(k % 19 == 0, F.lit(1.0)).otherwise(F.col("hard_max")).alias("hard_max"), F.when(k % 19 == 0, "2 months").otherwise(F.col("hard_max_text")).alias("hard_max_text"), null.alias("hard_max_quote"),
        F.when(k % 7 == 4, F.when(k % 2 == 0, 2026).otherwise(2027)).alias("figure_year"), (k % 23 == 0).alias("cap_can_rise"), null.alias("elements_untestable"),
        F.when(k % 3 != 0, "hand over a copy").otherwise(" ").alias("obligation_text"), null.alias("key_value"), F.lit("asks for it").alias("requirement"), "text", F.lit(1).alias("proposal_no"),
    )


def judged_proposals(spark, sf_dir):
    """Why each proposal is refused, and what is stored of the others."""
    rows = accept.judge_proposals(_proposals(spark, sf_dir))
    return rows.select("rule_id", "reason", "constraint.max", "constraint.hard_max", "constraint.open_above", "constraint.elements_untestable", "constraint.obligation_text", "constraint.span_start", "constraint.span_end", "constraint.verification_method")


def withheld_reasons(spark, sf_dir):
    return accept.withheld_counts(accept.judge_proposals(_proposals(spark, sf_dir)))


def accepted_constraints(spark, sf_dir):
    return accept.accepted(accept.judge_proposals(_proposals(spark, sf_dir))).select("constraint_id", "effect", "value_check")


def source_windows(spark, sf_dir):
    """What stands around a span of every text, 300 characters on each side."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    start = F.when(F.col("doc_id") % 9 != 0, (F.length("text") / 2).cast("int"))
    return docs.select("doc_id", F.md5(accept.source_window(F.col("text"), start, start + 20, 300)).alias("window"))


def _chunks(spark, sf_dir, changed: bool):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "source")
    text = F.when((F.col("doc_id") % 4 == 0) & F.lit(changed), F.concat("text", F.lit(" changed"))).otherwise(F.col("text"))
    allowed = increments.allowed_jurisdictions(F.when(F.col("doc_id") % 3 != 0, F.concat("source", F.lit(", CA"))))
    rows = docs.select("doc_id", F.lit(0).alias("chunk"), text.alias("text"), allowed.alias("allowed"))
    return rows.withColumn("key", increments.chunk_key(F.col("text"), "p1", "m1", F.col("allowed")))


def _store(spark, sf_dir):
    """Answers of an earlier run over the texts as they were, but every seventh; some were put twice."""
    old = _chunks(spark, sf_dir, False).filter("doc_id % 7 <> 0")
    at = F.explode(F.when(F.col("doc_id") % 2 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return old.withColumn("at", at).select("key", F.col("at").cast("long").alias("at"), F.concat_ws(":", F.length("text"), "at").alias("answer"))


def increment_work(spark, sf_dir):
    """Distinct chunks that a second run has to ask about."""
    return increments.split(_chunks(spark, sf_dir, True), _store(spark, sf_dir))[1].select(F.md5("text").alias("text"), F.array_join("allowed", "|").alias("allowed"))


def increment_hits(spark, sf_dir):
    return increments.split(_chunks(spark, sf_dir, True), _store(spark, sf_dir))[0].select("doc_id", "answer")


def cached_documents(spark, sf_dir):
    return increments.cached_documents(_chunks(spark, sf_dir, True), _store(spark, sf_dir))


def verified_extracts(spark, sf_dir):
    """Quotes of documents: some bent, some repaired, some short, some of another jurisdiction."""
    k = F.col("doc_id")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    quote = F.trim(F.substring("text", 31, 60))
    rows = docs.select(
        "doc_id", "text", F.when(k % 3 == 0, "Alba, CA").when(k % 3 == 1, "CA").alias("own_jurisdiction"), F.when(k % 8 == 0, "Alba, NY").when(k % 8 == 1, "no place").otherwise("CA").alias("jurisdiction"), F.lit("Law").alias("title"),
        k.cast("string").alias("citation"), F.when(k % 5 == 0, F.concat(quote, F.lit(" ~~"))).when(k % 5 == 1, "short ~~").otherwise(quote).alias("quoted_span"), F.when(k % 10 == 0, quote).when(k % 10 == 1, "").alias("repaired_quote"),
    )
    return increments.verify_extracted(rows).select("doc_id", "verification", "dropped", F.md5("quoted_span").alias("quote"))


#: How a date is put behind a text, and how it is then worded.
DATED = [
    ("The rule is in force from {} on, says the clerk.", "stated"), ("Last amended by ordinance 41 (council file 7), with effect {}.", "amendment_note"),
    ("Rate of the year, {} through April 30, 2032: three per cent.", "period_start"), ("[Text of section as amended by ordinance 88, in use {} and later]", "version_note"), ("No day is named in this place.", "not_found"),
]


def _dated(spark, sf_dir):
    """Every document with a sentence behind it that words the day of its own number."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("own"))
    day = F.date_add(F.lit("2031-01-01").cast("date"), (F.col("doc_id") % 700).cast("int"))
    sentence = F.element_at(F.array(*[F.lit(s) for s, _ in DATED]), (F.col("doc_id") % len(DATED) + 1).cast("int"))
    worded = F.date_format(day, "MMMM d, yyyy")
    return docs.select("doc_id", F.concat("own", F.lit("\n"), F.replace(sentence, F.lit("{}"), worded)).alias("text"), F.date_format(day, "yyyy-MM-dd").alias("effective_date"), F.when(F.col("doc_id") % 2 == 0, "read").alias("status_basis"))


def effective_date_context(spark, sf_dir):
    return _dated(spark, sf_dir).select("doc_id", mentions.date_context(F.col("text"), F.col("effective_date")).alias("context"))


def guarded_dates(spark, sf_dir):
    return increments.guard_dates(_dated(spark, sf_dir)).select("doc_id", "effective_date", "status_basis")


QUERIES = {
    f.__name__: f
    for f in (
        judged_proposals, withheld_reasons, accepted_constraints, source_windows, increment_work, increment_hits, cached_documents, verified_extracts, effective_date_context, guarded_dates,
    )
}


def _literal(v):
    return "NULL" if v is None else repr(v) if isinstance(v, float) else "'" + v.replace("'", "''") + "'"


def _pick(i: int) -> str:
    return "CASE k % 7 " + " ".join(f"WHEN {n} THEN {_literal(c[i])}" for n, c in enumerate(CLAUSES)) + " END"


# Patterns and figures are read from the quotes themselves; the clauses have one figure a wording, in months.
_JUDGED = f"""d AS (SELECT doc_id AS k, coalesce(text, '') || chr(10) || {_pick(0).replace('k %', 'doc_id %')} AS text, {_pick(0).replace('k %', 'doc_id %')} AS clause FROM documents),
p AS (SELECT *, {_pick(1)} AS effect, CASE WHEN k % 11 <> 0 THEN 'months' END AS parameter, CASE WHEN k % 5 = 0 THEN clause || ' Or so.' ELSE clause END AS q0, CASE WHEN k % 10 = 0 THEN clause END AS q1,
  CAST({_pick(2)} AS DOUBLE) + CASE WHEN k % 13 = 0 THEN 1 ELSE 0 END AS mx, CASE WHEN k % 17 = 0 THEN '7 months' ELSE {_pick(3)} END AS vt, CASE WHEN k % 19 = 0 THEN 1.0 ELSE CAST({_pick(4)} AS DOUBLE) END AS hard,
  CASE WHEN k % 19 = 0 THEN '2 months' ELSE {_pick(5)} END AS ht, CASE WHEN k % 7 = 4 THEN CASE WHEN k % 2 = 0 THEN 2026 ELSE 2027 END END AS fy, CASE WHEN k % 3 <> 0 THEN 'hand over a copy' END AS ot FROM d),
f AS (SELECT *, CASE WHEN contains(text, q0) THEN q0 WHEN contains(text, q1) THEN q1 END AS q, CASE WHEN contains(text, q0) THEN 'exact' WHEN contains(text, q1) THEN 'repaired' END AS how FROM p),
n AS (SELECT *, CAST(nullif(regexp_extract(vt, '^(\\d+) months$', 1), '') AS DOUBLE) AS rv, CAST(nullif(regexp_extract(ht, '^(\\d+) months$', 1), '') AS DOUBLE) AS rh FROM f),
j AS (SELECT *, CASE WHEN q IS NULL THEN 'the quote is not in the source document' WHEN effect = 'limit' AND parameter IS NULL THEN 'this action has no parameter a limit could apply to'
  WHEN effect = 'limit' AND mx IS NOT NULL AND NOT contains(q, vt) THEN 'the words given for max are not inside the quote' WHEN effect = 'limit' AND mx IS NOT NULL AND rv <> mx THEN 'the words given for max read as ' || CAST(rv AS INT) || ', the proposal says ' || CAST(mx AS INT)
  WHEN effect = 'limit' AND hard IS NOT NULL AND NOT contains(q, ht) THEN 'the words given for hard_max are not inside the quote' WHEN effect = 'limit' AND hard IS NOT NULL AND rh <> hard THEN 'the words given for hard_max read as ' || CAST(rh AS INT) || ', the proposal says ' || CAST(hard AS INT)
  WHEN effect = 'limit' AND hard < mx THEN 'hard_max is below max' WHEN effect = 'limit' AND fy IS NOT NULL AND NOT contains(q, CAST(fy AS VARCHAR)) THEN 'the year given for the figure is not in the quote'
  WHEN effect = 'prohibit' AND NOT regexp_matches(q, '\\b(unlawful|prohibited|may not|shall not)\\b') THEN 'the quote offered as a ban contains no words that forbid' WHEN effect = 'obligation' AND ot IS NULL THEN 'an obligation with no stated duty'
  WHEN effect = 'obligation' AND NOT regexp_matches(q, '\\b(must|shall)\\b') THEN 'the quote offered as a duty contains no words that require' END AS reason FROM n)"""
_ALLOWED = "CASE WHEN doc_id % 3 <> 0 THEN [source || ', CA', 'CA'] ELSE [] END"
_CHUNKS = f"""c0 AS (SELECT doc_id, coalesce(text, '') AS old, coalesce(text, '') || CASE WHEN doc_id % 4 = 0 THEN ' changed' ELSE '' END AS new, source FROM documents),
c AS (SELECT doc_id, c0.old AS old, c0.new AS new, md5(old || '|' || array_to_string({_ALLOWED}, '|')) AS k0, md5(new || '|' || array_to_string({_ALLOWED}, '|')) AS k1 FROM c0), st AS (SELECT k0, min(length(old)) AS n FROM c WHERE doc_id % 7 <> 0 GROUP BY k0)"""
_DATED = "CASE doc_id % 5 " + " ".join(f"WHEN {i} THEN '{c}'" for i, (_, c) in enumerate(DATED)) + " END"
_DAY = "CAST(DATE '2031-01-01' + CAST(doc_id % 700 AS INT) AS VARCHAR)"

ORACLE_SQL = {
    "judged_proposals": f"""WITH {_JUDGED} SELECT 'R' || k AS rule_id, reason, CASE WHEN reason IS NULL AND effect = 'limit' THEN mx END AS max, CASE WHEN reason IS NULL AND effect = 'limit' THEN hard END AS hard_max,
 CASE WHEN reason IS NULL AND effect = 'limit' THEN k % 23 = 0 OR contains(q, 'adjusted') END AS open_above, CASE WHEN reason IS NULL AND effect = 'prohibit' AND contains(q, 'two or more competitors') THEN 'the quoted text names "two or more competitors"' END AS elements_untestable,
 CASE WHEN reason IS NULL AND effect = 'obligation' THEN ot END AS obligation_text, CASE WHEN reason IS NULL THEN CAST(instr(text, q) - 1 AS INT) END AS span_start, CASE WHEN reason IS NULL THEN CAST(instr(text, q) - 1 + length(q) AS INT) END AS span_end, CASE WHEN reason IS NULL THEN how END AS verification_method FROM j""",
    "withheld_reasons": f"WITH {_JUDGED} SELECT effect, regexp_replace(reason, 'read as .*$', '') AS reason, count(*) AS n FROM j WHERE reason IS NOT NULL GROUP BY 1, 2",
    "accepted_constraints": f"WITH {_JUDGED} SELECT 'R' || k || ':' || effect || ':' || substr(sha256(q), 1, 6) AS constraint_id, effect, CASE WHEN effect = 'limit' THEN 'parsed' ELSE 'none' END AS value_check FROM j WHERE reason IS NULL",
    "source_windows": """SELECT doc_id, md5(CASE WHEN length(text) <= 600 OR doc_id % 9 = 0 THEN left(text, 600) ELSE substr(text, greatest(0, length(text) // 2 - 300) + 1, least(length(text), length(text) // 2 + 320) - greatest(0, length(text) // 2 - 300)) END) AS window FROM documents""",
    "increment_work": f"WITH {_CHUNKS} SELECT DISTINCT md5(new) AS text, array_to_string({_ALLOWED}, '|') AS allowed FROM (SELECT c.doc_id, c.k1, c.new, c0.source FROM c JOIN c0 USING (doc_id)) WHERE k1 NOT IN (SELECT k0 FROM st)",
    "increment_hits": f"WITH {_CHUNKS} SELECT doc_id, st.n || ':1' AS answer FROM c JOIN st ON st.k0 = c.k1",
    "cached_documents": f"WITH {_CHUNKS} SELECT doc_id FROM c WHERE k1 IN (SELECT k0 FROM st)",
    "verified_extracts": """WITH q AS (SELECT doc_id, coalesce(text, '') AS text, trim(substr(coalesce(text, ''), 31, 60)) AS good FROM documents),
r AS (SELECT *, CASE doc_id % 3 WHEN 0 THEN 'Alba, CA' WHEN 1 THEN 'CA' END AS own, CASE doc_id % 8 WHEN 0 THEN 'Alba, NY' WHEN 1 THEN 'no place' ELSE 'CA' END AS jur, CASE doc_id % 5 WHEN 0 THEN good || ' ~~' WHEN 1 THEN 'short ~~' ELSE good END AS said, CASE doc_id % 10 WHEN 0 THEN good WHEN 1 THEN '' END AS again FROM q),
v AS (SELECT *, length(said) >= 20 AND contains(text, said) AS ok, coalesce(length(again) >= 20 AND contains(text, again), FALSE) AS ok2 FROM r)
SELECT doc_id, CASE WHEN ok THEN 'exact' WHEN ok2 THEN 'repaired' ELSE 'failed' END AS verification, CASE WHEN NOT CASE WHEN own IS NULL THEN regexp_matches(jur, '^([^,]+, )?[A-Z]{2}$') ELSE jur IN (own, 'CA') END
  THEN 'dropped "Law" (' || doc_id || '): jurisdiction "' || jur || '" is not allowed' || CASE own WHEN 'Alba, CA' THEN ' (Alba, CA, CA)' WHEN 'CA' THEN ' (CA)' ELSE '' END
  WHEN NOT ok AND NOT ok2 AND length(said) < 20 AND coalesce(length(again), 0) < 20 THEN 'dropped "Law" (' || doc_id || '): quote shorter than 20 characters' END AS dropped,
 md5(CASE WHEN ok THEN said WHEN ok2 THEN again WHEN length(said) >= 20 THEN said WHEN length(again) >= 20 THEN again END) AS quote FROM v""",
    "effective_date_context": f"SELECT doc_id, {_DATED} AS context FROM documents",
    "guarded_dates": f"""SELECT doc_id, CASE WHEN c NOT IN ('amendment_note', 'period_start') THEN d END AS effective_date, nullif(concat_ws(' ', CASE WHEN doc_id % 2 = 0 THEN 'read' END, CASE c WHEN 'amendment_note' THEN '[effective_date ' || d || ' not used: the document gives it only as the date of the latest amendment]'
 WHEN 'period_start' THEN '[effective_date ' || d || ' not used: the document gives it only as the start of a rate period]' WHEN 'version_note' THEN '[effective_date ' || d || ' is the date the section''s current text took effect, per the code page''s version note]' END), '') AS status_basis FROM (SELECT doc_id, {_DATED} AS c, {_DAY} AS d FROM documents)""",
}
