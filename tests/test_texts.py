"""Texts and rows are read once, however often what is read is looked at."""

from pyspark.sql import functions as F

from ruleweave.functions import mentions
from ruleweave.functions import text as tx
from ruleweave.operators import validate


def times(spark, column, word):
    df = spark.sql("SELECT string(id) AS t, string(id) AS u FROM range(3)").select(column.alias("c"))
    return df._jdf.queryExecution().optimizedPlan().toString().count(word + "(")


def test_a_text_is_cut_at_its_dates_once(spark):
    """Each look at a mention's neighbourhood cut the whole text again."""
    context = mentions.date_context(F.col("t"), F.col("u"))
    assert times(spark, context, "regexp_extract_all") == times(spark, context, "split") == 1
    rows = [("In force from May 1, 2031. Rate, May 1, 2031 through June 1, 2032.", "2031-05-01"), ("Amended by 7, May 1, 2031. As amended May 1, 2031", "2031-05-01"), (None, "2031-05-01"), ("May 2031", "2031-05"), ("", None)]
    found = spark.createDataFrame(rows, "t string, u string").select(context).collect()
    assert [r[0] for r in found] == ["stated", "amendment_note", "not_found", "partial", "partial"]


def test_a_row_is_parsed_once_whatever_its_fields(spark):
    """Each check of each field parsed the row again."""
    schema = {"required": ["a"], "properties": {"a": {"type": "number", "minimum": 0, "maximum": 3}, "b": {"type": ["string", "null"], "minLength": 2, "enum": ["xx", "y", None]}}}
    assert times(spark, validate.faults(F.col("t"), schema), "try_parse_json") <= 1 and times(spark, validate.faults(F.col("t"), schema), "parse_json") <= 1
    lines = ['{"a":1,"b":"xx"}', '{"a":4,"b":"y"}', '{"b":null,"c":1}', '{"a":"1","b":"zz"}', "[1]", None, "{"]
    told = spark.createDataFrame(list(enumerate(lines)), "n int, t string").select("n", validate.faults(F.col("t"), schema).alias("f")).collect()
    assert {r.n: [tuple(x) for x in r.f] for r in told} == {
        0: [], 1: [("a", "maximum"), ("b", "minLength")], 2: [("a", "required"), ("c", "unknown")], 3: [("a", "type"), ("b", "enum")],
        **{n: [("", "not_an_object")] for n in (4, 5, 6)},
    }


def test_figures_are_taken_out_of_a_text_once(spark):
    """Each later wording took all earlier ones out again, twice as a single figure was asked for."""
    assert times(spark, tx.single(tx.parse_months(F.col("t"))), "regexp_extract_all") == 5
    rows = ["one and a half months", "2 1/2 months and twice", "half a month", "three times", "", None]
    found = [r[0] for r in spark.createDataFrame([(r,) for r in rows], "t string").select(tx.parse_months(F.col("t"))).collect()]
    assert found == [[1.5], [2.0, 2.5], [0.5], [3.0], [], None]
