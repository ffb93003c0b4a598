"""Answers a reader sees: explanations of results, reasons and sentences of decisions, change points, ids, batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleweave.operators.apply import applicability_join
from ruleweave.operators.common import broadcast_if_small

# Facts as a reader would say them.
FACT_WORDS = {"year_built": "the year built", "units": "the unit count", "legal_city": "the legal city", "owner_occupied": "whether the owner lives there"}
# The sentence of each reason; {who} is a rule's title and jurisdiction.
REASONS = {
    "covered": "{who} applies to this address as of {as_of}; every coverage condition is met and no exemption holds.",
    "status_pending": "{who} is only pending as of {as_of} and is not in force; it would cover this address in {jurisdiction} if enacted.",
    "status_not_yet_effective": "{who} is enacted but takes effect {effective}, after {as_of}; it is not yet in force at this address.",
    "status_failed": "{who} is not law as of {as_of}: {failure}.",
    "exempt": "{who} does not apply as of {as_of}: an exemption holds ({deciding}).",
    "requirement_not_met": "{who} does not apply as of {as_of}: a coverage requirement is not met ({deciding}).",
    "missing_fact": "Cannot tell whether {who} applies as of {as_of}: the data for this address does not include {missing} ({deciding}).",
    "cutoff_ambiguous": "Cannot tell whether {who} applies as of {as_of}: the building year alone does not settle the date test ({deciding}).",
    "unverifiable_condition": "Cannot tell whether {who} applies as of {as_of}: it depends on facts the dataset does not hold ({missing}): {deciding}.",
    "superseded_by_local": "{who} yields to a local rule where one governs; {local} applies at this address as of {as_of}, so the state rule is superseded.",
    "local_coverage_unknown": "{who} yields to a stricter local rule; whether {local} covers this address as of {as_of} is unknown, so it cannot be said which rule governs.",
    "jurisdiction_unresolved": "Cannot tell whether {who} applies as of {as_of}: the city containing this address could not be determined (missing: {missing}).",
}
# The parts of a decision's sentence, and the short names of months.
HEADS = {
    "BLOCK": ("Blocked: a rule in force at this property on {as_of} prohibits or caps this action as requested.", "Blocked: {n} rules in force at this property on {as_of} prohibit or cap this action as requested."),
    "REVIEW": ("Needs review: one point cannot be settled from the data and the verified constraints on {as_of}.", "Needs review: {n} points cannot be settled from the data and the verified constraints on {as_of}."),
    "REQUIRE": ("Nothing modeled is violated on {as_of}; one modeled duty attaches to this action.", "Nothing modeled is violated on {as_of}; {n} modeled duties attach to this action."),
}
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
PASSED = "No modeled constraint in force for this action at this property on {as_of}."

# Fixed value: what a city rule adds where the city came from the mailing address.
MAILED = " The legal city of this address was taken from its mailing city because the geocoder found no match; low confidence."
COVERED = " No known coverage gap for this category in these jurisdictions."


def filled(template: str | Column, **values: Column) -> Column:
    """A sentence with its places filled; a null value is written as nothing."""
    out = F.lit(template) if isinstance(template, str) else template
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def readable_fact(name: Column) -> Column:
    words = F.create_map(*[F.lit(x) for pair in FACT_WORDS.items() for x in pair])
    return F.coalesce(F.try_element_at(words, name), F.replace(name, F.lit("_"), F.lit(" ")))


def plural(n: Column, one: str, many: str | None = None) -> Column:
    """A count and its noun."""
    return F.concat(n.cast("string"), F.when(n == 1, f" {one}").otherwise(f" {many or one + 's'}"))


def quoted(texts: Column) -> Column:
    """Texts in quotation marks, one after the other."""
    return F.array_join(F.transform(texts, lambda t: F.concat(F.lit('"'), t, F.lit('"'))), "; ")


def explained(results: DataFrame) -> DataFrame:
    """results (as ``results_for`` gives them when asked to tell) with explanation.

    That is the sentence of the reason, with the conditions that decided; for a rule that is not in force, what leaves its
    coverage open; its caveats; and whether a city rule rests on a city taken from the mailing address.
    """
    named = lambda title, jurisdiction: F.concat(title, F.lit(" ("), jurisdiction, F.lit(")"))
    failure = F.when(F.col("legal_status") == "failed", "it failed to pass").otherwise(F.concat(F.lit("it was repealed "), "repeal_date"))
    template = F.try_element_at(F.create_map(*[F.lit(x) for pair in REASONS.items() for x in pair]), F.col("reason_code"))
    displaced, undecided = F.col("reason_code") == "superseded_by_local", F.col("reason_code") == "local_coverage_unknown"
    missing = F.array_join(F.transform("missing_facts", readable_fact), ", ")
    core = filled(
        template, who=named(F.col("title"), F.col("jurisdiction")), as_of=F.col("as_of"), jurisdiction=F.col("jurisdiction"), effective=F.col("effective_date"), failure=failure,
        missing=missing, local=named(F.col("local.title"), F.col("local.jurisdiction")), deciding=quoted(F.col("cov.deciding")),
    )
    wording = F.when(displaced & F.col("relation_text").isNotNull(), filled(' Source wording: "{text}"', text=F.col("relation_text")))
    waits = F.col("result").isin("pending", "not_yet_effective") & F.col("cov.value").isNull() & (F.size("cov.deciding") > 0)
    lacking = F.when(F.size("missing_facts") > 0, filled(" (missing: {missing})", missing=missing)).otherwise("")
    open_question = F.when(waits, F.concat(F.lit(" Coverage is also undetermined: "), quoted(F.col("cov.deciding")), lacking, F.lit(".")))
    caveats = F.when(F.size("caveats") > 0, F.concat(F.lit(" Caveats: "), F.array_join("caveats", "; "), F.lit(".")))
    mailed = F.when((F.col("result") != "not_applicable") & (F.col("level") == "city") & (F.col("method") == "postal_fallback") & ~displaced & ~undecided, F.lit(MAILED))
    parts = [F.coalesce(x, F.lit("")) for x in (core, wording, open_question, caveats, mailed)]
    return results.withColumn("explanation", F.concat(*parts))


def summary(decided: DataFrame) -> DataFrame:
    """decided with n_points, the points its sentence counts, and summary, the sentence with what is not yet in force."""
    items = F.flatten(F.transform("rules", lambda r: F.transform(r["items"], lambda i: F.struct(r["team_rule_id"].alias("rule"), i["kind"].alias("kind")))))
    of = lambda kind: F.filter(items, lambda i: i["kind"] == kind)
    violated = F.size(F.array_distinct(F.transform(of("violated"), lambda i: i["rule"])))
    kept = F.size(of("satisfied"))
    n = (
        F.when(F.col("decision") == "BLOCK", violated).when(F.col("decision") == "REVIEW", F.size(of("review")) + F.col("n_gaps"))
        .when(F.col("decision") == "REQUIRE", F.size(of("obligation"))).otherwise(kept)
    )
    within = F.when(F.col("n_points") == 1, "modeled limit").otherwise(F.concat(F.col("n_points").cast("string"), F.lit(" modeled limits")))
    head = F.when((F.col("decision") == "PASS") & (F.col("n_points") > 0), filled("No modeled constraint is violated: the request is within the {within} in force for this action at this property on {as_of}.", within=within, as_of=F.col("as_of")))
    for decision, (one, many) in HEADS.items():
        head = head.when(F.col("decision") == decision, filled(F.when(F.col("n_points") == 1, one).otherwise(many), n=F.col("n_points"), as_of=F.col("as_of")))
    head = head.otherwise(filled(PASSED, as_of=F.col("as_of")))
    soon = F.filter("rules", lambda r: r["result"].isin("pending", "not_yet_effective"))
    coming = F.transform(soon, lambda r: F.concat(r["title"], F.when(r["result"] == "pending", " (pending, not enacted)").otherwise(F.concat(F.lit(" (effective "), F.coalesce(r["effective_date"], F.lit("on a later date")), F.lit(")")))))
    later = F.when(F.size(coming) > 0, F.concat(F.lit(" Not yet in force: "), F.array_join(coming, "; "), F.lit("."))).otherwise("")
    gaps = F.when(F.col("n_gaps") > 0, F.concat(F.lit(" Known coverage gaps: "), F.array_join("gaps", " "))).when(F.col("decision") == "PASS", COVERED).otherwise("")
    return decided.withColumn("n_points", n.cast("long")).withColumn("summary", F.concat(head, later, gaps))


def top_reason(decided: DataFrame) -> DataFrame:
    """decided with top_reason and determining_rule_ids: the first rule that fixed the decision and how, else the gap that needs review."""
    wanted = {"BLOCK": ("violated",), "REQUIRE": ("obligation", "satisfied"), "PASS": ("satisfied",), "REVIEW": ("review",)}
    kinds = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for pair in wanted.items() for x in pair])
    fixing = F.filter(
        F.transform("rules", lambda r: F.struct(r["team_rule_id"].alias("id"), r["title"].alias("title"), F.get(F.filter(r["items"], lambda i: F.array_contains(F.element_at(kinds, F.col("decision")), i["kind"])), F.lit(0))["kind"].alias("kind"))),
        lambda r: r["kind"].isNotNull(),
    )
    first = F.get(fixing, F.lit(0))
    outcome = F.when(first["kind"] == "review", "unresolved").otherwise(first["kind"])
    reason = F.when(first.isNotNull(), F.concat(first["title"], F.lit(": "), outcome)).when(F.col("n_gaps") > 0, F.get("gaps", F.lit(0))).otherwise(filled(PASSED, as_of=F.col("as_of")))
    return decided.withColumns({"top_reason": reason, "determining_rule_ids": F.transform(fixing, lambda r: r["id"])})


def change_points(places: DataFrame, rules: DataFrame) -> DataFrame:
    """(state, legal_city, date, label): distinct full dates on which a rule that reaches a place changes. One row a place is enough."""
    events = F.array(*[F.struct(F.col(f"{c}_date").alias("date"), F.lit(w).alias("what")) for c, w in (("enacted", "is enacted"), ("effective", "takes effect"), ("repeal", "is repealed"))])
    distinct = places.select("state", "legal_city", "method", *[c for c in ("action",) if c in places.columns]).distinct()
    reach = applicability_join(distinct, rules.filter("legal_status <> 'failed'")).filter("NOT city_unknown")
    each = reach.select("state", "legal_city", "title", F.explode(events).alias("e")).filter(F.col("e.date").rlike(r"^\d{4}-\d{2}-\d{2}$"))
    day = F.to_date("e.date")
    human = F.concat_ws(" ", F.dayofmonth(day), F.element_at(F.array(*map(F.lit, MONTHS)), F.month(day)), F.year(day))
    return each.select("state", "legal_city", F.col("e.date").alias("date"), F.concat(human, F.lit(": "), "title", F.lit(" "), "e.what").alias("label")).distinct()


def merge_change_points(points: DataFrame) -> DataFrame:
    """(date, label) of all places, each once."""
    return points.select("date", "label").distinct()


def ruleset_digest(version: str, *parts: Column) -> Column:
    """A decision's id: a digest of its canonical request and of the version of the rules."""
    return F.concat(F.lit("dec_"), F.substring(F.sha2(F.concat(F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}), F.lit(version)), 256), 1, 16))


def registered(requests: DataFrame, places: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests (pos, address_id) with their places, in request order by pos, and those whose id is in no registry, with an error."""
    found = requests.join(places, "address_id")
    unknown = requests.join(places.select("address_id"), "address_id", "left_anti").withColumn("error", F.concat(F.lit("not in registry: "), F.col("address_id").cast("string")))
    return found, unknown


def batch(decided: DataFrame, requests: DataFrame) -> DataFrame:
    """pos, address_id, legal_city, decision, top_reason and determining_rule_ids of every request, a repeated id each time."""
    rows = top_reason(decided).select("address_id", "legal_city", "decision", "top_reason", "determining_rule_ids")
    return requests.select("pos", "address_id").join(rows, "address_id")


def decision_filter(decided: DataFrame, pressed: list[str]) -> DataFrame:
    """Rows of the chosen decisions; all where none is chosen."""
    return decided.filter(F.col("decision").isin(pressed)) if pressed else decided


def low_confidence(method: Column, confidence: Column) -> Column:
    return F.coalesce((method == "postal_fallback") | (confidence < 0.85), F.lit(False))


def count_words(counts: Column) -> Column:
    """Counts (array of struct(name, n)) that are not zero, in words, in their order."""
    return F.array_join(F.transform(F.filter(counts, lambda c: c["n"] > 0), lambda c: F.concat(c["n"].cast("string"), F.lit(" "), c["name"])), ", ")


def cities_of(ids: DataFrame, places: DataFrame) -> DataFrame:
    """(city, n): legal cities of the ids, the most frequent first, then by name; ids without a city count under null."""
    per = ids.join(places.select("address_id", F.col("legal_city").alias("city")), "address_id").groupBy("city").agg(F.count("*").alias("n"))
    return per.orderBy(F.desc("n"), F.asc_nulls_last("city"))


def served_constraints(constraints: DataFrame, rules: DataFrame, docs: DataFrame) -> DataFrame:
    """Constraints that may be served: their rule is there and of the action's category, cites the same document, and the
    evidence is still literally what the document says.

    constraints has rule_id, action, source_doc_id, evidence_quote, span_start, span_end and hard_max_quote; docs has doc_id
    and text.
    """
    known = rules.select(F.col("team_rule_id").alias("rule_id"), F.col("category").alias("_category"), F.col("source_doc_id").alias("_doc"))
    joined = constraints.join(broadcast_if_small(known), "rule_id").filter((F.col("_category") == F.col("action")) & (F.col("_doc") == F.col("source_doc_id"))).drop("_category", "_doc")
    texts = docs.select(F.col("doc_id").alias("source_doc_id"), "text")
    literal = F.substr(F.col("text"), F.col("span_start") + 1, F.col("span_end") - F.col("span_start")) == F.col("evidence_quote")
    hard = F.col("hard_max_quote").isNull() | F.contains(F.col("text"), F.col("hard_max_quote"))
    return joined.join(texts, "source_doc_id").filter(literal & hard).drop("text")
