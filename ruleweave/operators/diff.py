"""What a change of law or of date affects: results of the same rules at two dates, or at one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleweave.operators.apply import results_for
from ruleweave.operators.common import broadcast_if_small

# Fixed value: how a label is written: place, category code, and a number led by P for a proposal.
LABEL = r"^([A-Za-z]+)-([A-Za-z]+)-([A-Za-z]*\d+)$"


def case_results(cases: DataFrame, addresses: DataFrame, rules: DataFrame) -> DataFrame:
    """Results (other than not_applicable) of each case's rules at its dates, in its states.

    All rules are applied, as precedence needs them; only then are the case's chosen.
    """
    one_date = F.size(F.array_distinct(F.col("dates").cast("array<date>"))) < 2
    asked = cases.select("case_id", "type", "rule_ids", "states", one_date.alias("one_date"), F.explode(F.array_distinct(F.col("dates").cast("array<date>"))).alias("as_of"))
    dates = broadcast_if_small(asked.select("as_of").distinct())
    results = results_for(addresses.crossJoin(dates), rules)  # a handful of dates, each a full pass over the addresses
    chosen = broadcast_if_small(asked.select("case_id", "type", "states", "one_date", "as_of", F.explode("rule_ids").alias("team_rule_id")))
    joined = results.join(chosen, ["team_rule_id", "as_of"])
    return joined.filter("result <> 'not_applicable' AND (states IS NULL OR array_contains(states, state))")


def changed_results(found: DataFrame) -> DataFrame:
    """Per case, address and rule: whether it is affected, and whether it is flagged.

    A case of two dates affects what differs between them, nothing if they are one; absence is not_applicable. Another case affects
    whatever is not not_applicable.
    """
    per = found.groupBy("case_id", "type", "address_id", "team_rule_id", "one_date").agg(
        F.count_distinct("as_of").alias("n_dates"), F.count_distinct("result").alias("n_results"), F.bool_or("conflict_flag").alias("flagged"), F.array_sort(F.collect_list(F.struct("as_of", "result"))).alias("seen")
    )
    differs = ~F.col("one_date") & ((F.col("n_results") > 1) | (F.col("n_dates") < 2))
    return per.withColumn("affected", F.when(F.col("type") == "as_of", differs).otherwise(True))


def affected_sets(found: DataFrame) -> DataFrame:
    """(case_id, n_affected, n_flagged) by distinct address."""
    per = changed_results(found).groupBy("case_id", "address_id").agg(F.bool_or("affected").alias("affected"), F.bool_or("flagged").alias("flagged"))
    return per.groupBy("case_id").agg(F.count_if("affected").alias("n_affected"), F.count_if("flagged").alias("n_flagged"))


def counts_per_date(found: DataFrame) -> DataFrame:
    return found.groupBy("case_id", "as_of", "result").agg(F.count("*").alias("n"))


def parse_labels(labels: DataFrame, codes: DataFrame) -> DataFrame:
    """label with its place, category and whether it names a proposal (a number led by P). codes: (code, category)."""
    part = lambda i: F.regexp_extract("label", LABEL, i)
    split = labels.filter(F.col("label").rlike(LABEL)).withColumns({"place": F.upper(part(1)), "code": F.upper(part(2)), "proposal": F.upper(F.substring(part(3), 1, 1)) == "P"})
    return split.join(broadcast_if_small(codes), "code", "left").select("label", "place", "category", "proposal")


def resolve_places(parsed: DataFrame, jurisdictions: DataFrame) -> DataFrame:
    """The one jurisdiction a label's place names: a state, else city initials, else a city prefix.

    The first tier with a hit decides; where it has several the answer is null. jurisdictions: (jurisdiction). Each
    tier is an equi-join on a derived key.
    """
    names = jurisdictions.distinct()
    upper = F.upper("jurisdiction")
    city = F.regexp_extract(upper, r"^([^,]*)", 1)
    letters = F.regexp_replace(city, "[^A-Z]+", "")
    initials = F.array_join(F.transform(F.filter(F.split(city, "[^A-Z]+"), lambda w: w != ""), lambda w: F.substring(w, 1, 1)), "")
    is_city = F.contains(F.col("jurisdiction"), F.lit(","))
    prefixes = F.when(letters != "", F.transform(F.sequence(F.lit(1), F.length(letters)), lambda i: F.substr(letters, F.lit(1), i)))
    keys = (
        names.filter(~is_city).select("jurisdiction", upper.alias("place"), F.lit(1).alias("tier"))
        .unionByName(names.filter(is_city).select("jurisdiction", initials.alias("place"), F.lit(2).alias("tier")))
        .unionByName(names.filter(is_city).select("jurisdiction", F.explode(prefixes).alias("place"), F.lit(3).alias("tier")))
    )
    hits = parsed.join(broadcast_if_small(keys, 100_000), "place").groupBy("label", "tier").agg(F.count("*").alias("n"), F.min("jurisdiction").alias("jurisdiction"))
    first = hits.groupBy("label").agg(F.min_by(F.struct("n", "jurisdiction"), "tier").alias("hit"))
    return parsed.join(first.select("label", F.when(F.col("hit.n") == 1, F.col("hit.jurisdiction")).alias("jurisdiction")), "label", "left")


def select_rules(parsed: DataFrame, rules: DataFrame) -> DataFrame:
    """(label, team_rule_id): the rules of each label's jurisdiction and category; a proposal names those not enacted.

    parsed is what ``resolve_places`` gives.
    """
    wanted = parsed.filter("jurisdiction IS NOT NULL AND category IS NOT NULL").select("label", "jurisdiction", "category", "proposal")
    enacted = F.col("legal_status") == "enacted"
    hits = rules.select("team_rule_id", "jurisdiction", "category", "legal_status").join(broadcast_if_small(wanted), ["jurisdiction", "category"])
    return hits.filter(F.when(F.col("proposal"), ~enacted).otherwise(enacted)).select("label", "team_rule_id")


def select_by_document(documents: DataFrame, rules: DataFrame) -> DataFrame:
    """(doc, team_rule_id): the rules that a document is the source of or supports too. rules has also_supported_by, an array."""
    cited = rules.select("team_rule_id", F.explode(F.array_distinct(F.concat(F.array("source_doc_id"), F.coalesce("also_supported_by", F.array().cast("array<string>"))))).alias("doc"))
    return documents.select("doc").distinct().join(cited, "doc")
