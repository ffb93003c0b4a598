"""The field-level merge on groups made by hand, on odd rows and on empty tables."""

from ruleweave.operators import consolidate as co
from ruleweave.operators import merge

COLUMNS = (
    "cell string, candidate_id string, team_rule_id string, verified boolean, official boolean, picked boolean, legal_status string, enacted_date string, effective_date string, key_value string,"
    " requires array<struct<fact:string,text:string>>, exempt_if array<array<struct<fact:string,text:string>>>, source_doc_id string, conflict_flag boolean, conflict_note string, status_basis string"
)


def row(cell, n, status="enacted", enacted=None, effective=None, verified=True, official=True, picked=False, value=None, requires=(), doc=None, note=None, basis=None):
    return (cell, f"{cell}#{n}", "T", verified, official, picked, status, enacted, effective, value, [("units", r) for r in requires], [], doc or f"d{n}", note is not None, note, basis)


def merged(spark, rows, states=None):
    stated = spark.createDataFrame(states, "source_doc_id string, date string") if states else None
    return {r.cell: r for r in merge.merge_groups(spark.createDataFrame(rows, COLUMNS), ["cell"], stated).collect()}


def test_fields_come_from_the_documents_that_may_give_them(spark):
    found = merged(
        spark,
        [
            # a bill becomes law: the enacting document gives status and dates
            row("a", 1, "pending", picked=True), row("a", 2, "enacted", "2025-10-06", "2026-01-01"),
            # a date is sharpened, and a peer of the same enactment lends the other
            row("b", 1, enacted="2025-10", picked=True), row("b", 2, enacted="2025-10-06", effective="2026-02-01"),
            # a peer of another enactment lends nothing, unless the primary's document writes that day too
            row("c", 1, enacted="2020", picked=True), row("c", 2, enacted="2024", effective="2024-07-01"),
            row("d", 1, enacted="2020", picked=True), row("d", 2, enacted="2024", effective="2024-07-01"),
            # contradictions stay with the primary and are flagged
            row("e", 1, "failed", picked=True), row("e", 2, "enacted", "2025"),
            row("f", 1, effective="2026-01-01", picked=True), row("f", 2, effective="2026-03-01"), row("f", 3, effective="2030"),
            # an unverified member gives nothing
            row("g", 1, picked=True), row("g", 2, enacted="2025", effective="2025", verified=False, value="x", requires=["u"]),
            # coverage and values
            row("h", 1, picked=True, value="Ten", basis="read"), row("h", 2, value="ten ", requires=["u"]), row("h", 3, value="20"), row("h", 4, value="30"), row("h", 5, value="40"),
        ],
        [("d1", "2024-07-01")] ,
    )
    a, b, c = found["a"], found["b"], found["c"]
    assert (a.legal_status, a.enacted_date, a.effective_date) == ("enacted", "2025-10-06", "2026-01-01") and a.candidate_id == "a#1"
    assert a.status_basis == "[legal_status enacted from d2; enacted_date 2025-10-06 from d2; effective_date 2026-01-01 from d2]"
    assert (b.enacted_date, b.effective_date, b.status_basis) == ("2025-10-06", "2026-02-01", "[effective_date 2026-02-01 from d2]")
    assert c.effective_date == "2024-07-01" and c.status_basis.endswith("a date d1 also states]")  # d1 writes it
    assert found["e"].legal_status == "failed" and found["e"].conflict_note == 'legal_status differs: "enacted" (d2) vs "failed" (d1)'
    assert found["f"].conflict_note == 'effective_date differs: "2026-01-01" (d1) vs "2026-03-01" (d2)' and found["f"].effective_date == "2026-01-01"
    g, h = found["g"], found["h"]
    assert (g.enacted_date, g.effective_date, g.key_value, list(g.requires), g.status_basis) == (None, None, None, [], None)
    assert h.key_value == "Ten; 20; 30" and h.status_basis == "read [coverage from d2]" and [x.text for x in h.requires] == ["u"]


def test_without_stated_dates_another_enactment_lends_nothing(spark):
    found = merged(spark, [row("c", 1, enacted="2020", picked=True), row("c", 2, enacted="2024", effective="2024-07-01")])
    assert found["c"].effective_date is None and found["c"].basis == []


def test_a_large_group_repeats_and_nothing(spark):
    rows = [row("a", n, enacted="2025", value=f"v{n % 2}", note="same", doc="d") for n in range(2000)]
    found = merged(spark, [*rows, *rows[:5]])["a"]
    assert found.n_members == 2005 and found.key_value == "v0; v1" and found.conflict_note == "same" and found.candidate_id == "a#0"
    assert merged(spark, [row("z", 1)])["z"].key_value is None
    empty = spark.createDataFrame([], COLUMNS)
    assert merge.merge_groups(empty, ["cell"]).count() == 0


def test_kept_groupings_count_only_for_the_same_candidates(spark):
    rows = spark.createDataFrame([row("a", 1), row("a", 2), row("b", 1), row("b", 2), row("c", 1)], COLUMNS).drop("picked")
    told = ["legal_status"]
    keys = {r.cell: r.key for r in merge.payload_keys(rows, "v", told).collect()}
    cached = spark.createDataFrame([(keys["a"], "g", f"a#{n}", "a#1") for n in (1, 2)] + [(keys["b"], "g", "b#1", "b#1")], "key string, group_no string, member_id string, primary_id string")
    groups, failed = merge.group_cells(rows, cached, "v", told, co.grouping_problem)
    assert sorted((r.cell, r.group_no, r.member_id) for r in groups.collect()) == [("a", "g", "a#1"), ("a", "g", "a#2"), ("b", "b#1", "b#1"), ("b", "b#2", "b#2"), ("c", "c#1", "c#1")]
    assert [r.cell for r in failed.collect()] == ["b"]
    assert merge.group_cells(rows, cached, "w", told, co.grouping_problem)[1].count() == 2  # another version asks anew
    assert {(r.cell, r.n_members) for r in merge.consolidate(rows, groups).collect()} == {("a", 2), ("b", 2), ("c", 1)}  # groups of one rule are one


def test_cells_are_dealt_once_while_rows_are_narrow(spark):
    """Kept answers were made by five shuffles of whole candidates, and support merged all texts to know the primaries."""
    from ruleweave.plans import merge_queries as q

    folder = "/root/testdata/sf0.001"
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    kept = plan(q.cached_groupings(spark, folder))
    assert kept.count("Exchange hashpartitioning(") == kept.count("Exchange hashpartitioning(cell") <= 2
    assert "collect_set" not in plan(q.rule_support(spark, folder))


def _dealt(df):
    """The keys of each shuffle of a plan, and the widths of what the shuffles move."""
    import re

    plan = df._jdf.queryExecution().executedPlan().toString()
    return {re.sub(r"#\d+L?", "", keys).rpartition(", ")[0] for keys in re.findall(r"Exchange hashpartitioning\((.*?)\)", plan)}


def test_consolidated_candidates_are_moved_once_by_cell(spark):
    """Whole candidates were dealt by cell and id, by cell and group, and by cell and bucket, several times each."""
    from ruleweave.plans import merge_queries as q

    assert _dealt(q.consolidated_rules(spark, "/root/testdata/sf0.001")) <= {"cell", "key", "dates_doc, any_offer", "source_doc_id, date", "s, k"}


def test_grouping_problems_with_null_ids_and_groups(spark):
    answers = spark.createDataFrame([("a", "g", None, "x"), ("b", None, "b1", "b1"), ("c", "g", "c1", "c2"), ("c", "h", "c2", "c1"), ("e", "g", "e1", "e1"), ("f", "g", "f1", "f1")], "cell string, group_no string, member_id string, primary_id string")
    members = spark.createDataFrame([("a", None), ("b", "b1"), ("c", "c1"), ("c", "c2"), ("e", "e1"), ("e", "e1"), ("f", "f1"), ("f", "f2")], "cell string, candidate_id string")
    found = {r.cell: r.problem for r in co.grouping_problem(answers, members).collect()}
    assert found == {"a": "unknown id", "b": None, "c": "primary outside its group", "e": None, "f": "id left out"}


def test_support_is_all_but_the_primary(spark):
    members = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "1"), (None, "3"), ("c", None)], "cell string, candidate_id string")
    primaries = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "4")], "cell string, candidate_id string")
    assert sorted(map(str, (tuple(r) for r in merge.supported_by(members, primaries, ["cell"]).collect()))) == ["('a', '2')", "('c', None)", "(None, '3')"]


def test_groups_are_summed_up_once_also_for_stated_dates(spark):
    """Groups were summed up twice, once to know what documents should state and once with the answer."""
    rows = spark.createDataFrame([row("c", 1, enacted="2020", picked=True), row("c", 2, enacted="2024", effective="2024-07-01"), row("d", 3)], COLUMNS)
    states = spark.createDataFrame([("d1", "2024-07-01"), ("d1", "2024-07-01"), (None, "2024-07-01"), ("d", None)], "source_doc_id string, date string")
    found = merge.merge_groups(rows, ["cell"], states)
    assert found._jdf.queryExecution().executedPlan().toString().count("ObjectHashAggregate(") <= 2
    assert sorted((r.cell, r.effective_date, r.n_members) for r in found.collect()) == [("c", "2024-07-01", 2), ("d", None, 1)]  # a date stated twice is one


def test_cells_judged_while_they_are_grouped_are_those_of_group_cells(spark):
    """Short cells list what is said, large ones are summed up; both equal the way over group_cells."""
    cells = {"two": 2, "ok": 6, "out": 4, "strange": 3, "gone": 3, "wrong": 4, "null": 2, "big": 90, "bigger": 70}
    says = lambda c, n: dict(status=("enacted", "pending", "failed")[(n + len(c)) % 7 % 3], enacted=(None, "2024", "2024-05")[n % 3], effective=(None, "2025-01-01", "2025-03", "2029")[n % 4], verified=n % 5 != 0, official=n % 2 == 0, value=("Ten", " ten", "b", "", None, "c", "d")[n % 7], requires=("u",) * (n % 3 == 0), doc=f"d{n % 6}", note=("x", None, "y", "")[n % 4])
    made = [row(c, n, **says(c, n)) for c, most in cells.items() for n in range(most)]
    made = [(*r[:2], f"T{i % 2}", *r[3:]) for i, r in enumerate(made)] + [(None, "x#1", *row("x", 1)[2:]), ("null", None, *row("x", 1)[2:])]
    made += [row("lent", 1, enacted="2020", doc="d1"), row("lent", 2, enacted="2024", effective="2029", doc="d2")]
    rows = spark.createDataFrame([*made, made[2]], COLUMNS).drop("picked")  # a row of cell ok twice
    told = ["legal_status"]
    keys = {r.cell: r.key for r in merge.payload_keys(rows, "v", told).collect()}
    answers = [(keys[c], f"g{n % 2}", f"{c}#{n}", f"{c}#{n % 2}") for c, most in cells.items() for n in range(most) if c not in ("wrong", "gone")]
    answers = [a for a in answers if a[2] != "out#3"] + [(keys["strange"], "g0", "strange#9", "strange#0"), (keys["gone"], None, "gone#0", "gone#0")]
    answers += [(keys["wrong"], f"g{n % 2}", f"wrong#{n}", "wrong#0") for n in range(4)] + [(keys["two"], "g1", "two#0", "two#1")]
    cached = spark.createDataFrame(answers, "key string, group_no string, member_id string, primary_id string")
    states = spark.createDataFrame([(f"d{n}", d) for n in range(6) for d in ("2025-01-01", "2029")], "source_doc_id string, date string")
    plain = lambda df: sorted(map(str, df.collect()))
    want = plain(merge.consolidate(rows, merge.group_cells(rows, cached, "v", told, co.grouping_problem)[0], states))
    assert len(want) > len(cells) and any("also states" in r for r in want) and any("differs" in r for r in want)
    for few in (64, 2, 1000):
        assert plain(merge.consolidate_cached(rows, cached, "v", told, states, 4, few=few)) == want
    empty = spark.createDataFrame([], COLUMNS).drop("picked")
    assert merge.consolidate_cached(empty, cached, "v", told, states).count() == 0
