"""Messages of forms, required dates, samples, first of repeats and notes on rows made by hand."""

import pytest
from pyspark.sql import functions as F

from ruleweave.operators import views


def test_messages_of_a_form(spark):
    typed = [None, " ", "x", "0", "12.5", " 3 ", "1e1", "-1", "12", ".5", "Infinity"]
    got = {r.t: r.p for r in spark.createDataFrame([(t,) for t in typed], "t string").select("t", views.parameter_problem(F.col("t"), "Deposit", "months", 0, 12).alias("p")).collect()}
    empty, number, more, most = "Enter deposit in months.", "Deposit must be a number of months.", "Deposit must be more than 0 months.", "Deposit must be at most 12 months."
    assert got == {None: empty, " ": empty, "x": number, "0": more, "12.5": most, " 3 ": None, "1e1": None, "-1": more, "12": None, ".5": None, "Infinity": number}
    days = {r.t: r.p for r in spark.createDataFrame([(t,) for t in (None, "2026-02-30", "2026-02", "2026-02-28")], "t string").select("t", views.date_problem(F.col("t")).alias("p")).collect()}
    assert [days[t] is None for t in (None, "2026-02-30", "2026-02", "2026-02-28")] == [False, False, False, True]


def test_a_day_that_is_none_fails_the_query(spark):
    ok = spark.createDataFrame([("2026-01-01",)], "t string").select(views.require_date(F.col("t")).alias("d"))
    assert ok.first().d == "2026-01-01"
    with pytest.raises(Exception, match="Query date must be YYYY-MM-DD, got: 2026-1-1"):
        spark.createDataFrame([("2026-1-1",)], "t string").select(views.require_date(F.col("t"))).collect()


def test_first_of_repeats_and_samples(spark):
    rows = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 3, None), ("b", 3, "z"), (None, 1, "n")], "k string, n int, v string")
    assert sorted(map(tuple, views.dedupe_first(rows, ["k"], ["n"]).collect()), key=str) == [("a", 1, "y"), ("b", 3, None), (None, 1, "n")]
    assert views.dedupe_first(rows.limit(0), ["k"], ["n"]).count() == 0
    said = spark.createDataFrame([(["a"] * n,) for n in (0, 5, 6)], "i array<string>").select(views.sample_message(F.col("i")).alias("s"))
    assert [r.s for r in said.collect()] == ["", "a, a, a, a, a", "a, a, a, a, a, ... (6 total)"]


def test_order_of_cases_and_of_rules_to_come(spark):
    cases = spark.createDataFrame([("c", "2026-01-01"), ("c", "2027-01-01"), ("b", "2026-05-05"), ("a", "2026"), ("d", None)], "case_id string, date string")
    assert [(r.case_id, r.last_day, r.place) for r in views.tracked_cases(cases).orderBy("place").collect()] == [("b", "2026-05-05", 1), ("c", "2027-01-01", 2)]
    rules = spark.createDataFrame([("r2", "not_yet_effective", None), ("r1", "not_yet_effective", "2027"), ("r3", "in_force", "2020"), ("r0", "not_yet_effective", "2026-12")], "team_rule_id string, status string, effective_date string")
    assert [r.team_rule_id for r in views.upcoming_first(rules).collect()] == ["r0", "r1", "r2"]
    assert [r.team_rule_id for r in views.suggestions(rules, F.col("status") != "in_force", ["team_rule_id"], 2).collect()] == ["r0", "r1"]
