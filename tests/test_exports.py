"""Exports byte by byte, digests over partitions, planted breaks, validation, stores of answers and acceptance, on rows made by hand."""

import json
import random
from pathlib import Path

from pyspark.sql import functions as F

from ruleweave.operators import accept, export_files, increments, trace, validate
from ruleweave.operators.export_files import order_problems, tree_digest
from ruleweave.plans import fixtures as fx


def files_of(path):
    return {p.parent.name: p.read_bytes() for p in sorted(Path(path).glob("part=*/*.txt"))}


def test_two_runs_write_the_same_bytes_and_parts_follow_each_other(spark, tmp_path):
    rows = [(f"k{i:05d}", {"b": i, "a": None}, [("z", i)]) for i in range(3000)]
    kind = "id string, about struct<b:int,a:string>, more array<struct<y:string,x:int>>"
    random.Random(1).shuffle(rows)
    for run, n in (("one", 3), ("two", 11)):
        export_files.write(spark.createDataFrame(rows, kind).repartition(n), "id", str(tmp_path / run), 6)
    one, two = files_of(tmp_path / "one"), files_of(tmp_path / "two")
    assert one == two and len(one) == 6 and all(len(b) > 1000 for b in one.values())
    lines = b"".join(one[p] for p in sorted(one, key=lambda p: int(p[5:]))).decode().splitlines()
    assert lines == sorted(lines, key=lambda x: json.loads(x)["id"]) and len(lines) == 3000
    assert lines[7] == '{"about":{"a":null,"b":7},"id":"k00007","more":[{"x":7,"y":"z"}]}'


def test_a_digest_is_that_of_the_rows_and_not_of_their_partitions(spark):
    lines = [(f"line {i % 700}",) for i in range(2000)]
    of = lambda rows, n: tree_digest(spark.createDataFrame(rows, "line string").repartition(n)).first().digest
    assert of(lines, 1) == of(lines[::-1], 13)
    assert of(lines, 3) != of(lines[1:], 3) != of([("line 0",), *lines[1:-1], ("line x",)], 3)
    empty = tree_digest(spark.createDataFrame([], "line string")).first()
    assert empty.n == 0 and empty.digest


def test_breaks_in_and_between_partitions_are_found(spark):
    rows = [(p, 10 * p + i) for p in range(5) for i in range(10)]

    def found(rows):
        table = spark.createDataFrame(rows, "p int, k int").repartitionByRange(5, "p").sortWithinPartitions("p")
        return sorted((r.place, r.problem, r.n) for r in order_problems(table, "k", F.col("p").cast("string")).collect())

    assert found(rows) == []
    assert found([(p, 19 if (p, k) == (2, 20) else k) for p, k in rows]) == [("2", "border_repeated", 1)]
    assert found([(p, 5 if (p, k) == (3, 30) else k) for p, k in rows]) == [("3", "border_not_sorted", 1)]
    assert found([(p, 45 if (p, k) == (4, 46) else None if (p, k) == (0, 4) else k) for p, k in rows]) == [("0", "not_sorted", 2), ("4", "repeated", 1)]
    assert order_problems(spark.createDataFrame([], "k int"), "k").count() == 0


def test_files_are_judged_where_their_blocks_lie(spark, tmp_path):
    for name, ids in (("a", range(5)), ("b", range(5, 9)), ("c", range(8, 12))):
        spark.createDataFrame([(i,) for i in ids], "k int").coalesce(1).write.parquet(str(tmp_path / f"t/f={name}"))
    got = order_problems(spark.read.parquet(str(tmp_path / "t")).drop("f"), "k").collect()
    assert [(r.problem, "f=c" in r.place) for r in got] == [("border_repeated", True)]


SCHEMA = {"required": ["id", "kind"], "properties": {"id": {"type": "integer", "minimum": 1}, "kind": {"type": ["string", "null"], "enum": ["A", None], "pattern": "^A$"}, "l": {"type": "array", "items": {"type": "number"}}}}


def test_every_fault_of_a_row_is_told_once(spark):
    cases = {
        '{"id": 1, "kind": "A"}': [], '{"id": 1, "kind": null, "l": [1, 2.5]}': [], "{}": [("id", "required"), ("kind", "required")], '{"id": 0, "kind": "B", "l": ["x"], "z": 1, "y": 2}':
        [("id", "minimum"), ("kind", "enum"), ("kind", "pattern"), ("l", "items"), ("y", "unknown"), ("z", "unknown")], '{"id": "1", "kind": 3, "l": {}}': [("id", "type"), ("kind", "type"), ("l", "type")],
        "[1]": [("", "not_an_object")], "no json": [("", "not_an_object")], "": [("", "not_an_object")],
    }
    rows = spark.createDataFrame([(k,) for k in cases] + [(None,)], "line string")
    got = {r.line: [(f.path, f.code) for f in r.f] for r in rows.select("line", validate.faults(F.col("line"), SCHEMA).alias("f")).collect()}
    assert got == {**cases, None: [("", "not_an_object")]}
    assert validate.problems(rows.limit(0), "line", SCHEMA).count() == 0


def test_references_and_repeats(spark):
    rows = spark.createDataFrame([("a", ["b", "x"]), ("b", []), ("b", ["a"])], "id string, refs array<string>")
    assert [tuple(r) for r in validate.unknown_references(rows, "id", "refs").collect()] == [("a", "x")]
    assert [tuple(r) for r in validate.repeated_keys(rows, "id").collect()] == [("b", 2)]


def test_a_second_run_asks_only_about_what_changed(spark, tmp_path):
    path, asked = str(tmp_path / "store"), []

    def chunks(texts):
        rows = spark.createDataFrame([(d, i, t, ["CA"]) for d, ts in texts.items() for i, t in enumerate(ts)], "doc_id int, chunk int, text string, allowed array<string>")
        return rows.withColumn("key", increments.chunk_key(F.col("text"), "p1", "m1", F.col("allowed")))

    def ask(work):
        asked.append(sorted(r.text or "" for r in work.collect()))
        return work.select("key", F.concat(F.lit("answer to "), F.coalesce("text", F.lit(""))).alias("answer"))

    first = {1: ["one", "two"], 2: ["one"], 3: [None]}
    assert increments.cached_documents(chunks(first), increments.stored(spark, path)).count() == 0
    got = increments.run(chunks(first), path, ask, 1)
    assert sorted((r.doc_id, r.answer) for r in got.collect()) == [(1, "answer to one"), (1, "answer to two"), (2, "answer to one"), (3, "answer to ")]
    second = {1: ["one", "two, changed"], 2: ["one"], 3: [None], 4: []}
    increments.run(chunks(second), path, ask, 2)
    assert asked == [["", "one", "two"], ["two, changed"]]
    increments.put(chunks(first).select("key", F.lit(9).cast("long").alias("at"), F.lit("late").alias("answer")), path)
    assert "late" not in {r.answer for r in increments.run(chunks(second), path, ask, 3).collect()}
    assert sorted(r.doc_id for r in increments.cached_documents(chunks(second), increments.stored(spark, path)).collect()) == [1, 2, 3]


BAN, DUTY = "No owner shall use such software to set the rent of a unit.", "The owner must return the deposit within 21 days of the end."
FIELDS = (
    "rule_id string, action string, parameter string, effect string, evidence_quote string, repaired_quote string, operative_quote string, max double, value_text string, hard_max double, hard_max_text string,"
    " hard_max_quote string, figure_year int, cap_can_rise boolean, elements_untestable string, obligation_text string, key_value string, requirement string, text string, proposal_no int"
)


def judged(spark, *proposals):
    base = dict.fromkeys([f.split()[0] for f in FIELDS.split(", ")]) | {"rule_id": "R", "action": "deposit", "parameter": "dollars", "requirement": "r", "text": f"Heading of it all\n{BAN} {DUTY} A fee of $50 is the most; it is $75 for two."}
    rows = [tuple((base | p | {"proposal_no": i}).values()) for i, p in enumerate(proposals)]
    return accept.judge_proposals(spark.createDataFrame(rows, FIELDS)).orderBy("proposal_no")


def test_proposals_are_accepted_or_refused_with_their_reason(spark):
    fee, fee2 = "A fee of $50 is the most;", "it is $75 for two."
    got = judged(
        spark,
        {"effect": "prohibit", "evidence_quote": BAN}, {"effect": "prohibit", "evidence_quote": "Heading of it all\nNo", "operative_quote": BAN}, {"effect": "prohibit", "evidence_quote": DUTY}, {"effect": "obligation", "evidence_quote": DUTY, "obligation_text": " "},
        {"effect": "obligation", "evidence_quote": DUTY, "obligation_text": "return it"}, {"effect": "limit", "evidence_quote": fee, "max": 50.0, "value_text": "$50"}, {"effect": "limit", "evidence_quote": fee, "max": 40.0, "value_text": "$50"},
        {"effect": "limit", "evidence_quote": fee, "max": 50.0, "value_text": "A fee"}, {"effect": "limit", "evidence_quote": fee, "max": 50.0, "value_text": "$50", "hard_max": 75.0, "hard_max_text": "$75", "hard_max_quote": "the most; " + fee2},
        {"effect": "limit", "evidence_quote": fee, "max": 50.0, "value_text": "$50", "hard_max": 75.0, "hard_max_text": "$75", "hard_max_quote": "is not in the source at all"}, {"effect": "limit", "evidence_quote": "is not in the source at all"},
        {"effect": "limit", "evidence_quote": fee, "parameter": None}, {"effect": "none", "evidence_quote": fee}, {"effect": "limit", "evidence_quote": fee, "figure_year": 2026}, {"effect": "prohibit", "evidence_quote": None}, {"effect": "none", "evidence_quote": fee, "text": None},
    ).collect()
    reasons = [r.reason for r in got]
    assert reasons == [
        None, None, accept.NO_BAN_WORDS, accept.NO_DUTY, None, None, "the words given for max read as 50, the proposal says 40", 'no single figure could be read from the words given for max: "A fee"', None, accept.HARD_NOT_THERE, accept.NOT_THERE, accept.NO_PARAMETER, None,
        accept.NO_YEAR, accept.NOT_THERE, accept.NOT_THERE,
    ]
    wider, hard = got[1].constraint, got[8].constraint
    assert (wider.evidence_quote, wider.verification_method) == (BAN, "repaired") and got[0].constraint.constraint_id == wider.constraint_id
    assert (hard.max, hard.hard_max, hard.value_check) == (50.0, 75.0, "parsed") and hard.hard_max_quote.endswith(fee2)
    kept = accept.accepted(judged(spark, {"effect": "prohibit", "evidence_quote": BAN}, {"effect": "prohibit", "evidence_quote": BAN})).collect()
    assert len(kept) == 1


def test_trace_of_findings_in_words(spark):
    rows = trace.told_constraints(fx.constraints(spark)).filter("team_rule_id = 'R12'")
    said = rows.select(F.explode(trace.findings(F.col("told"), F.lit(2.5), F.lit("2026-05-01").cast("date"), F.lit("months"), F.lit("Code"), F.lit("asks"))).alias("f")).first().f
    assert said.detail == 'The limit is 2 months "two months" in general and up to 3 months "three months" in cases the data cannot tell apart. The request is 2.5 months.'
