"""Candidates of one law merged into one rule, field by field, with a record of what each field came from.

members has, beside the columns of its group, candidate_id, team_rule_id, verified, official (from the supplied corpus), picked
(the proposed primary), legal_status, enacted_date, effective_date, key_value, requires, exempt_if, source_doc_id,
conflict_flag, conflict_note and status_basis. A group is summed up where its rows are: only distinct statements (status and dates with
their document), notes and values are listed, and in cells of FEW_MEMBERS at most what each member says. What the others support is a
table of its own.

The order decides. Status comes first: a verified failed or dated enacted document beats pending ones, and enacted
against failed stays with the primary as a conflict. Only verified documents of the resolved status, the peers, may sharpen
or lend dates. An effective date is lent by peers that name the same enactment, or by any if the primary's document
writes that date too. Peers whose effective dates lie less than a year apart conflict.

Defined cases: a group without a verified member keeps its primary's fields; null texts are left out of notes and
values; repeated rows count once, as all is distinct; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ruleweave.functions.dates import date_floor
from ruleweave.functions.logic import let
from ruleweave.operators.common import dealt
from ruleweave.operators.consolidate import CLOSE_DAYS, distinct_dates, resolve_status

STATUSES = ("enacted", "failed", "pending")
FIELDS = (
    "candidate_id", "team_rule_id", "legal_status", "enacted_date", "effective_date", "key_value", "requires", "exempt_if", "source_doc_id", "status_basis", "verified",
)
#: Values of other documents that are kept beside the primary's, its own included.
MOST_VALUES = 3
#: Of cells of at most so many candidates, what a group's members say is listed where they lie sorted; larger ones are summed up.
FEW_MEMBERS = 64


def states_no_coverage(requires: Column, exempt_if: Column) -> Column:
    """Whether all conditions are caveats, or there are none."""
    return F.forall(F.concat(requires, F.flatten(exempt_if)), lambda c: c["fact"] == "caveat")


def primary_rank(verified: Column, official: Column, picked: Column, candidate_id: Column) -> Column:
    """The primary has the least: verified before others, of them official ones, then the pick, then the lowest id."""
    return F.struct(~verified, ~(verified & official), ~picked, candidate_id)


def _sums() -> dict[str, Column]:
    """What is kept of members beside their dates, notes and values; sums of sums are sums."""
    status, verified = F.col("m.legal_status"), F.col("m.verified")
    dates = F.struct("m.candidate_id", "m.enacted_date", "m.effective_date", "m.source_doc_id")
    dated = F.col("m.enacted_date").isNotNull() | F.col("m.effective_date").isNotNull()
    rank = primary_rank(verified, F.col("m.official"), F.col("m.picked"), F.col("m.candidate_id"))
    return {
        "p": F.min(F.when(F.col("m").isNotNull(), F.struct(rank.alias("rank"), *[F.col(f"m.{f}").alias(f) for f in FIELDS]))),
        "as_failed": F.min(F.when(verified & (status == "failed"), dates)),
        "as_enacted": F.min(F.when(verified & (status == "enacted") & dated, dates)),
        "covering": F.min(F.when(verified & ~states_no_coverage(F.col("m.requires"), F.col("m.exempt_if")), F.struct("m.candidate_id", "m.source_doc_id", "m.requires", "m.exempt_if"))),
        "flagged": F.bool_or("m.conflict_flag"),
        "n_members": F.count("m"),
    }


def _told(members: DataFrame, group: list[str]) -> DataFrame:
    """(group, kind, key, stated, said, id, m): each member whole with what it states if verified, and beside it its note and its
    verified value, of kinds of their own."""
    value = F.when(F.col("verified"), F.nullif(F.trim("key_value"), F.lit("")))
    used = [*FIELDS, "official", "picked", "conflict_flag"]
    stated = F.struct(F.col("legal_status").alias("status"), "effective_date", "enacted_date", "source_doc_id")
    of = lambda kind, key, said, m, stated: F.struct(F.lit(kind).alias("kind"), key.alias("key"), stated.alias("stated"), said.alias("said"), F.col("candidate_id").alias("id"), m.alias("m"))
    none, whole = F.lit(None).cast("string"), F.struct(*used)
    no_member, no_dates = (F.lit(None).cast(members.select(c.alias("c")).schema["c"].dataType) for c in (whole, stated))
    note = of("note", F.col("conflict_note"), F.col("conflict_note"), no_member, no_dates)
    all_three = F.array(of("member", none, none, whole, F.when(F.col("verified"), stated)), note, of("value", F.lower(value), value, no_member, no_dates))
    return members.select(*group, F.explode(all_three).alias("t")).select(*group, "t.*").filter("kind = 'member' OR key <> ''")


def _summed(members: DataFrame, group: list[str]) -> DataFrame:
    """One row a group: its members summed up, what its verified ones state, and notes and values in order of the lowest id that has them.

    What is alike is put together first, as streams of sorted rows, so that only distinct statements, notes and values are listed.
    """
    first = F.min(F.when(F.col("kind") != "member", F.struct("id", "said"))).alias("first")
    each = _told(members, group).groupBy(*group, "kind", "key", "stated").agg(*[c.alias(n) for n, c in _sums().items()], first)
    again = {"flagged": F.bool_or, "n_members": F.sum}
    of = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.col("first")))), lambda x: x["said"])
    return each.groupBy(*group).agg(*[again.get(n, F.min)(n).alias(n) for n in _sums()], F.collect_list("stated").alias("stated"), of("note").alias("notes"), of("value").alias("values"))


def _listed(members: DataFrame, group: list[str]) -> DataFrame:
    """What _summed gives, for groups of FEW_MEMBERS at most: the primary's row with lists of what all of them say.

    number is a member's place among the group's by all that primary_rank has but picked.
    As rows lie sorted by group, nothing is moved or sorted again. Each member's row holds the lists on the way, so groups must be few.
    """
    value, note, of = F.nullif(F.trim("key_value"), F.lit("")), F.nullif("conflict_note", F.lit("")), W.partitionBy(*group)
    dates = ["candidate_id", "enacted_date", "effective_date", "source_doc_id"]
    said = F.struct(*dates, F.col("legal_status").alias("status"), value.alias("value"))
    rank = primary_rank(F.col("verified"), F.col("official"), F.col("picked"), F.col("number"))
    covers = F.col("verified") & ~states_no_coverage(F.col("requires"), F.col("exempt_if"))
    every = members.withColumns({
        "stated": F.collect_list(F.when(F.col("verified"), said)).over(of),
        "notes": F.collect_list(F.when(note.isNotNull(), F.struct(F.col("candidate_id").alias("id"), note.alias("said")))).over(of),
        "covering": F.min(F.when(covers, F.struct("candidate_id", "source_doc_id", "requires", "exempt_if"))).over(of),
        "flagged": F.bool_or("conflict_flag").over(of),
        "n_members": F.count(F.lit(1)).over(of),
        "least": F.min(rank).over(of),
    }).filter(rank.eqNullSafe(F.col("least")))
    least = lambda test: F.array_min(F.transform(F.filter("stated", test), lambda x: F.struct(*[x[d].alias(d) for d in dates])))
    dated = lambda x: x["enacted_date"].isNotNull() | x["effective_date"].isNotNull()
    by_id = F.array_sort(F.transform(F.filter("stated", lambda x: x["value"].isNotNull()), lambda x: F.struct(x["candidate_id"].alias("id"), x["value"].alias("said"))))
    fresh = lambda texts: F.filter(texts, lambda v, i: ~F.exists(F.slice(texts, 1, i), lambda o: F.lower(o) == F.lower(v)))
    return every.select(
        *group, F.struct(*FIELDS).alias("p"), "stated", "covering", "flagged", "n_members",
        least(lambda x: x["status"] == "failed").alias("as_failed"),
        least(lambda x: (x["status"] == "enacted") & dated(x)).alias("as_enacted"),
        F.transform(F.array_sort("notes"), lambda x: x["said"]).alias("notes"),
        let(F.transform(by_id, lambda x: x["said"]), fresh).alias("values"),
    )


def _docs(rows: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.transform(rows, lambda x: x["source_doc_id"]))), ", ")


def _dates(rows: Column, field: str) -> Column:
    return distinct_dates(F.transform(rows, lambda x: x[field]))


def _offers(whole: DataFrame) -> DataFrame:
    """Resolved status, who gives it, its peers, and the effective dates they offer."""
    own = F.col("p.legal_status")
    statuses = F.array_sort(F.array_distinct(F.transform(F.filter("stated", lambda x: x["status"].isNotNull()), lambda x: x["status"])))
    resolved = whole.withColumn("statuses", statuses).withColumn("s", resolve_status(own, F.col("statuses"), F.col("as_enacted").isNotNull()))
    lent = F.when(F.col("s.status") != own, F.when(F.col("s.status") == "failed", F.col("as_failed")).otherwise(F.col("as_enacted")))
    peers = F.when(F.col("s.status").isin(*STATUSES), F.filter("stated", lambda x: x["status"] == F.col("s.status")))
    source = lambda field: F.when(F.col("giver").isNotNull(), F.col("giver")[field]).otherwise(F.col("p")[field])
    placed = resolved.withColumns({"giver": lent, "peers": peers}).withColumns({"own_enacted": source("enacted_date"), "own_effective": source("effective_date"), "dates_doc": source("source_doc_id")})

    # a verified primary that alone is verified neither sharpens nor lends to itself
    placed = placed.withColumn("peered", F.size("stated") > F.when(F.col("p.verified"), 1).otherwise(0))
    longer = lambda v: F.startswith(v, F.col("own_enacted")) & (v != F.col("own_enacted"))
    sharper = F.when(F.col("peered"), F.get(F.filter(_dates(F.col("peers"), "enacted_date"), longer), F.lit(0)))
    dated = placed.withColumn("enacted", F.coalesce(sharper, F.col("own_enacted")))
    same = lambda x: x["enacted_date"].isNull() | F.startswith(x["enacted_date"], F.col("enacted")) | F.startswith(F.col("enacted"), x["enacted_date"])
    lenders = F.filter("peers", lambda x: x["effective_date"].isNotNull())
    dated = dated.withColumn("lenders", F.when(F.col("peered") & F.col("own_effective").isNull(), lenders)).withColumn("close_lenders", F.when(F.col("enacted").isNotNull(), F.filter("lenders", same)))
    offers = dated.withColumns({"offer": _dates(F.col("close_lenders"), "effective_date"), "any_offer": _dates(F.col("lenders"), "effective_date")})
    single = lambda name: F.when(F.size(name) == 1, F.get(F.col(name), F.lit(0)))
    return offers.withColumns({"offer": single("offer"), "any_offer": single("any_offer")})


def merge_groups(members: DataFrame, group: list[str], states: DataFrame | None = None, parts: int | None = None) -> DataFrame:
    """One row a group: group, candidate_id of the primary, the merged fields, basis and conflicts, n_members.

    basis lists what came from another document and from which. states is (source_doc_id, date), the dates a
    document writes as ordinary statements. A group is summed up once; its row goes to the document and the date it asks for, one that
    asks for none to any place.
    """
    return _with_second(_fields(_summed(members, group), group), group, states, parts)


def _fields(summed: DataFrame, group: list[str]) -> DataFrame:
    """The merged fields of groups summed up, but for what documents state too: second is the text to add if dates_doc states any_offer."""
    none = F.array().cast("array<string>")
    given = _offers(summed).withColumn("effective", F.coalesce("own_effective", "offer"))

    changed = lambda field: ~F.col("giver")[field].eqNullSafe(F.col("p")[field])
    covered = F.when(states_no_coverage(F.col("p.requires"), F.col("p.exempt_if")) & F.col("covering").isNotNull(), F.col("covering"))
    said = [
        F.when(F.col("giver").isNotNull(), F.format_string("legal_status %s from %s", "s.status", "giver.source_doc_id")),
        F.when(F.col("offer").isNotNull(), F.concat(F.lit("effective_date "), "offer", F.lit(" from "), _docs(F.col("close_lenders")))),
        F.when(changed("enacted_date") & F.col("enacted").isNotNull() & F.col("giver").isNotNull(), F.format_string("enacted_date %s from %s", "enacted", "giver.source_doc_id")),
        F.when(changed("effective_date") & F.col("own_effective").isNotNull() & F.col("giver").isNotNull(), F.format_string("effective_date %s from %s", "effective", "giver.source_doc_id")),
        F.when(F.col("covering_other").isNotNull(), F.concat(F.lit("coverage from "), "covering_other.source_doc_id")),
    ]
    asks = F.col("offer").isNull() & F.col("any_offer").isNotNull()
    second = F.when(asks, F.concat(F.lit("effective_date "), "any_offer", F.lit(" from "), _docs(F.col("lenders")), F.lit(", a date "), "dates_doc", F.lit(" also states")))
    based = given.withColumn("covering_other", covered).withColumns({"before": F.array_compact(F.array(*said[:2])), "after": F.array_compact(F.array(*said[2:])), "second": second})

    offered = _dates(F.col("peers"), "effective_date")
    days = lambda a, b: F.coalesce(F.abs(F.datediff(date_floor(a), date_floor(b))) < CLOSE_DAYS, F.lit(False))
    close = F.when(F.col("peered"), let(offered, lambda every: F.filter(every, lambda a: F.exists(every, lambda b: (a != b) & days(a, b)))))
    docs_of = lambda v: _docs(F.filter("peers", lambda x: x["effective_date"] == v))
    quoted = lambda v, docs: F.concat(F.lit('"'), v, F.lit('" ('), docs, F.lit(")"))
    status_docs = lambda s: _docs(F.filter("stated", lambda x: x["status"] == s))
    noted = based.withColumn("close", F.when(F.size(close) >= 2, close))
    more = F.array_compact(
        F.array(
            F.when(F.col("s.conflict"), F.concat(F.lit("legal_status differs: "), F.array_join(F.transform("statuses", lambda s: quoted(s, status_docs(s))), " vs "))),
            F.when(F.col("close").isNotNull(), F.concat(F.lit("effective_date differs: "), F.array_join(F.transform("close", lambda v: quoted(v, docs_of(v))), " vs "))),
        )
    )
    notes = F.array_distinct(F.concat(F.coalesce("notes", none), more))
    first = F.when(F.col("p.verified"), F.nullif(F.trim("p.key_value"), F.lit("")))
    others = F.filter(F.coalesce("values", none), lambda v: first.isNull() | (F.lower(v) != F.lower(first)))
    values = F.slice(F.concat(F.array_compact(F.array(first)), others), 1, MOST_VALUES)
    return noted.select(
        *group,
        "p.candidate_id",
        "p.team_rule_id",
        "p.source_doc_id",
        F.col("s.status").alias("legal_status"),
        F.col("enacted").alias("enacted_date"),
        F.col("effective").alias("effective_date"),
        F.coalesce("covering_other.requires", "p.requires").alias("requires"),
        F.coalesce("covering_other.exempt_if", "p.exempt_if").alias("exempt_if"),
        F.coalesce(F.nullif(F.array_join(values, "; "), F.lit("")), "p.key_value").alias("key_value"),
        F.col("p.status_basis").alias("status_basis"),
        (F.col("flagged") | F.col("s.conflict") | F.col("close").isNotNull()).alias("conflict_flag"),
        F.nullif(F.array_join(notes, "; "), F.lit("")).alias("conflict_note"),
        "n_members",
        "before",
        "after",
        "second",
        F.when(asks, F.col("dates_doc")).otherwise(F.col(group[0]).cast("string")).alias("dates_doc"),
        F.when(asks, F.col("any_offer")).alias("any_offer"),
    )


def _with_second(fields: DataFrame, group: list[str], states: DataFrame | None, parts: int | None) -> DataFrame:
    none = F.array().cast("array<string>")
    fields = fields.withColumn("_too", F.lit(False)) if states is None else _stated_too(fields, states, parts)
    basis = F.concat("before", F.when(F.col("_too"), F.array("second")).otherwise(none), "after")
    joined = F.when(F.size("basis") > 0, F.concat(F.lit("["), F.array_join("basis", "; "), F.lit("]")))
    whole = fields.withColumn("basis", basis).withColumns({
        "effective_date": F.coalesce("effective_date", F.when(F.col("_too"), F.col("any_offer"))),
        "status_basis": F.when(joined.isNull(), F.col("status_basis")).otherwise(F.concat_ws(" ", F.nullif("status_basis", F.lit("")), joined)),
    })
    return whole.select(
        *group, "candidate_id", "team_rule_id", "source_doc_id", "legal_status", "enacted_date", "effective_date", "requires", "exempt_if", "key_value", "status_basis", "basis", "conflict_flag", "conflict_note", "n_members",
    )


def _stated_too(fields: DataFrame, states: DataFrame, parts: int | None) -> DataFrame:
    """fields with _too, whether dates_doc writes the day any_offer. Rows without a day ask nothing; their dates_doc spreads them."""
    known = states.select("source_doc_id", "date")
    if parts:
        fields, known = fields.repartition(parts, "dates_doc", "any_offer"), known.repartition(parts, "source_doc_id", "date")
    known = known.distinct().select(F.col("source_doc_id").alias("dates_doc"), F.col("date").alias("any_offer"), F.lit(True).alias("_too"))
    return fields.join(known, ["dates_doc", "any_offer"], "left").withColumn("_too", F.coalesce("_too", F.lit(False)))


def supported_by(members: DataFrame, merged: DataFrame, group: list[str]) -> DataFrame:
    """members but each group's primary, in which the merged rule also finds support."""
    primaries = merged.select(*group, F.col("candidate_id").alias("_primary"))
    return members.join(primaries, group, "left").filter(F.coalesce(F.col("candidate_id") != F.col("_primary"), F.lit(True))).drop("_primary")


def payload_keys(candidates: DataFrame, version: str, told: list[str]) -> DataFrame:
    """(cell, key, n): what names the grouping question about a cell: its candidates' told columns, in any order, and a version.

    Two 64-bit sums over rows are put together in each task before they meet, so a large cell is no row of its own.
    """
    row = F.to_json(F.struct("candidate_id", *told), {"ignoreNullFields": "false"})
    sums = [F.bit_xor(F.xxhash64(F.lit(s), row)) for s in ("a", "b")]
    per = candidates.groupBy("cell").agg(F.count("*").alias("n"), *[s.alias(f"_{i}") for i, s in enumerate(sums)])
    return per.select("cell", F.sha2(F.concat_ws("|", F.lit(version), "n", "_0", "_1"), 256).alias("key"), "n")


def _answers(candidates: DataFrame, cached: DataFrame, version: str, told: list[str], parts: int | None) -> tuple[DataFrame, DataFrame]:
    """(cell, key) of the cells that ask, those of two candidates or more, and (cell, group_no, member_id, primary_id) kept for them, dealt to parts by cell."""
    asked = payload_keys(candidates, version, told).filter("n > 1").select("cell", "key")
    # without a cell no answer counts; said here, so that all that use the answers share their shuffle
    kept = cached.join(asked.filter("cell IS NOT NULL"), "key").select("cell", F.col("group_no").cast("string").alias("group_no"), "member_id", "primary_id")
    return asked, dealt(kept, "cell", parts)


def group_cells(candidates: DataFrame, cached: DataFrame, version: str, told: list[str], problem, parts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(cell, group_no, member_id, primary_id) of every candidate, and (cell, error) of cells that fell back to one group each.

    cached is (key, group_no, member_id, primary_id), the answers kept. An answer counts if its key is the cell's and
    problem (``consolidate.grouping_problem``) finds none; a cell of one candidate needs no answer. Answers are dealt to parts by
    cell once; candidates that are dealt so are not moved.
    """
    asked, answers = _answers(candidates, cached, version, told, parts)
    fine = problem(answers, candidates.select("cell", "candidate_id")).filter("problem IS NULL").select("cell")
    own = [F.col("candidate_id").alias(c) for c in ("group_no", "member_id", "primary_id")]
    both = answers.withColumn("kept", F.lit(True)).unionByName(candidates.select("cell", *own, F.lit(False).alias("kept")))
    chosen = both.join(fine.withColumn("fine", F.lit(True)), "cell", "left").filter(F.col("kept") == F.coalesce("fine", F.lit(False)))
    failed = asked.join(fine, "cell", "left_anti").select("cell", F.lit("grouping not cached (offline); kept one rule per candidate").alias("error"))
    return chosen.select("cell", "group_no", "member_id", "primary_id"), failed


def consolidate(candidates: DataFrame, groups: DataFrame, states: DataFrame | None = None, parts: int | None = None) -> DataFrame:
    """The merged rules of all cells. Groups of a cell whose primaries name the same rule are one; the first group's pick stays.

    Groups come to the candidates as rows of their cell, so what is dealt to parts by cell is not moved. A candidate that no group
    holds is left out.
    """
    placed = _answered(candidates, groups).filter("g IS NOT NULL").select("*", "g.*")
    return merge_groups(_picked(_with_teams(placed)), ["cell", "bucket"], states, parts)


def consolidate_cached(
    candidates: DataFrame, cached: DataFrame, version: str, told: list[str], states: DataFrame | None = None, parts: int | None = None, whole: Callable[[DataFrame], DataFrame] = lambda rows: rows, few: int = FEW_MEMBERS,
) -> DataFrame:
    """The merged rules of all cells grouped as group_cells does with ``consolidate.grouping_problem``, judged in the pass that groups.

    whole adds to candidates the columns that only keys and merging need, so that rows are narrow while they are grouped. Cells of
    more than few candidates go the way of merge_groups, which lists no members; all others have short lists.
    """
    group = ["cell", "bucket"]
    _, answers = _answers(whole(candidates), cached, version, told, parts)
    # numbered before the pick is known, so that one sort serves all that is asked of a bucket
    order = W.partitionBy(*group).orderBy(~F.col("verified"), ~(F.col("verified") & F.col("official")), "candidate_id")
    short = _picked(_judged(_answered(candidates, answers).filter(F.col("in_cell") <= few)).withColumn("number", F.row_number().over(order)))
    # few cells, if any; written out, so that with none of them the long way is seen to be empty
    large = candidates.groupBy("cell").count().filter(F.col("count") > few).select("cell").repartition(1)
    long = _picked(_judged(_answered(candidates.join(large, "cell", "left_semi"), answers.join(large, "cell", "left_semi"))))
    fields = _fields(_listed(whole(short), group), group)
    return _with_second(fields.unionByName(_fields(_summed(whole(long), group), group)), group, states, parts)


def _answered(candidates: DataFrame, answers: DataFrame) -> DataFrame:
    """Candidates with a cell and an id, with the answer g to each, own_team (of the rows of its id), in_cell (how many) and fine: whether
    the answers name all ids of the cell once and no others."""
    told = answers.select("cell", F.col("member_id").alias("candidate_id"), F.struct("group_no", "primary_id").alias("g"))
    both = candidates.drop("picked").unionByName(told, allowMissingColumns=True)
    is_told, null = F.col("g").isNotNull(), F.col("candidate_id").isNull()
    of_id, of_cell = W.partitionBy("cell", "candidate_id"), W.partitionBy("cell")
    rank = F.when(~is_told, primary_rank(F.col("verified"), F.col("official"), F.lit(True), F.col("candidate_id")))
    counted = both.withColumns({"times": F.count("g").over(of_id), "known": F.bool_or(~is_told).over(of_id), "of": F.max("g").over(of_id), "own_team": F.min_by("team_rule_id", rank).over(of_id)})
    wrong = null | (F.col("times") != 1) | ~F.col("known")
    judged = counted.withColumns({"fine": ~F.bool_or(wrong).over(of_cell), "in_cell": F.count_if(~is_told).over(of_cell)}).filter(~is_told & ~null & F.col("cell").isNotNull())
    return judged.withColumn("g", F.col("of")).drop("of", "times", "known")


def _with_teams(placed: DataFrame) -> DataFrame:
    """placed (group_no and primary_id given) with its group's bucket, the rule its primary names, its pick, and whether the primary is inside."""
    own, of_group = F.col("candidate_id"), W.partitionBy("cell", "group_no")
    rank = primary_rank(F.col("verified"), F.col("official"), own == F.col("primary_id"), own)
    return placed.withColumns({"bucket": F.min_by("team_rule_id", rank).over(of_group), "pick": F.min("primary_id").over(of_group), "inside": F.bool_or(own == F.col("primary_id")).over(of_group)})


def _judged(answered: DataFrame) -> DataFrame:
    """Candidates in the groups of their cell's answers, or each its own if these are not fine.

    Answers that name every candidate once and no other are as many as the candidates, so what is left to judge, whether each
    group has its primary, is asked of the candidates.
    """
    own = F.col("candidate_id")
    either = lambda field, other: F.when(F.col("fine"), F.col(field)).otherwise(other)
    teams = _with_teams(answered.withColumns({"group_no": either("g.group_no", own), "primary_id": either("g.primary_id", own)}))
    outside = F.coalesce(F.bool_or(~F.col("inside")).over(W.partitionBy("cell")), F.lit(False))
    return teams.withColumn("fine", F.col("fine") & ~outside).withColumns({"bucket": either("bucket", F.col("own_team")), "pick": either("pick", own), "group_no": either("group_no", own)})


def _picked(teams: DataFrame) -> DataFrame:
    """Members of buckets; picked is the pick of a bucket's first group."""
    first = F.min_by("pick", "group_no").over(W.partitionBy("cell", "bucket"))
    return teams.withColumn("picked", F.col("candidate_id") == first).drop("pick", "group_no", "primary_id", "inside", "fine", "own_team", "g", "in_cell")
