"""Rule, constraint, gap and case tables for the driver's data, and places derived from its customers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleweave.operators import stores

RULE_SCHEMA = (
    "team_rule_id string, jurisdiction string, category string, title string, legal_status string, enacted_date string, effective_date string, repeal_date string,"
    " relation string, conflict_flag boolean, conflict_note string,"
    " requires array<struct<fact:string,op:string,date:string,years:double,value:int,name:string,text:string>>,"
    " exempt_if array<array<struct<fact:string,op:string,date:string,years:double,value:int,name:string,text:string>>>,"
    " relation_text string, citation string, requirement string"
)
CONSTRAINT_SCHEMA = "constraint_no int, rule_id string, action string, effect string, max double, hard_max double, open_above boolean, figure_year int, elements_untestable string, value_text string, hard_max_text string, obligation_text string, evidence_quote string"
#: Action: its parameter's exclusive minimum and maximum, or none.
ACTIONS = {"algo": None, "deposit": (0.0, 12.0), "fee": (0.0, 10000.0)}


def _units(op, value):
    return ("units", op, None, None, value, None, f"units {op} {value}")


def _built(op, date):
    return ("year_built", op, date, None, None, None, f"built {op} {date}")


def _age(op, years):
    return ("building_age_years", op, None, float(years), None, None, f"age {op} {years}")


def _unavailable(name):
    return ("unavailable", None, None, None, None, name, name)


def _caveat(text):
    return ("caveat", None, None, None, None, None, text)


N = None
# id, jurisdiction, category, legal status, enacted, effective, repeal, relation, own conflict, requires, exempt groups
RULES = [
    ("R01", "AFRICA", "rent", "enacted", "2020-01-01", "2020-07-01", N, "yields_to_stricter_local", False, [_units("gte", 5)], []),
    ("R02", "NATION_0, AFRICA", "rent", "enacted", "1979-06-13", "1979-06-13", N, "none_stated", False, [_built("lte", "1979-06-13")], []),
    ("R03", "NATION_5, AFRICA", "rent", "enacted", N, N, N, "none_stated", True, [], [[_units("lte", 2), _unavailable("owner_occupied")]]),
    ("R04", "AMERICA", "algo", "enacted", "2025-10-06", "2026-01-01", N, "preempts_local", False, [], []),
    ("R05", "NATION_1, AMERICA", "algo", "enacted", "2025-06", "2025-07-03", N, "none_stated", False, [], []),
    ("R06", "NATION_6, AMERICA", "algo", "enacted", "2026-02", "2026-12-01", N, "none_stated", False, [], []),
    ("R07", "ASIA", "algo", "enacted", "2026-07-20", "2027-07-01", N, "preempts_local", False, [], []),
    ("R08", "NATION_2, ASIA", "algo", "enacted", N, "2026-01-01", N, "none_stated", False, [], []),
    ("R09", "EUROPE", "algo", "pending", N, "2026-01-01", N, "none_stated", False, [_units("gte", 3)], []),
    ("R10", "EUROPE", "rent", "failed", N, N, N, "none_stated", False, [], []),
    ("R11", "EUROPE", "deposit", "enacted", "2000", "2000-01", N, "none_stated", False, [], [[_units("lt", 4), _caveat("seasonal")], [_age("lt", 15)]]),
    ("R12", "MIDDLE EAST", "deposit", "enacted", "1990-01-01", "1990-01-01", "2026-06-30", "none_stated", False, [], []),
    ("R13", "MIDDLE EAST", "fee", "enacted", "2024-01-01", "2027", N, "allows_stricter_local", False, [_built("gt", "1978-10")], []),
    ("R14", "NATION_4, MIDDLE EAST", "fee", "enacted", N, N, N, "none_stated", False, [_unavailable("registered")], []),
    ("R15", "AMERICA", "deposit", "enacted", "2010-01-01", "2011-01-01", N, "none_stated", False, [_age("gte", 20), _caveat("tenancy")], [[_units("eq", 2)]]),
    ("R16", "ASIA", "rent", "enacted", "2021-01-01", "2021-01-01", N, "yields_to_stricter_local", False, [], []),
    ("R17", "NATION_7, ASIA", "rent", "enacted", N, N, N, "none_stated", False, [_unavailable("publicly_funded")], []),
    ("R18", "NATION_12, ASIA", "rent", "enacted", N, N, N, "none_stated", False, [_built("eq", "1979")], []),
]
# rule, action, effect, max, hard max, open above, figure year, elements that cannot be tested
CONSTRAINTS = [
    ("R11", "deposit", "limit", 1.5, N, False, N, N),
    ("R11", "deposit", "obligation", N, N, False, N, N),
    ("R12", "deposit", "limit", 2.0, 3.0, False, N, N),
    ("R15", "deposit", "limit", 1.0, N, True, N, N),
    ("R05", "algo", "prohibit", N, N, False, N, N),
    ("R04", "algo", "prohibit", N, N, False, N, "as part of a conspiracy"),
    ("R08", "algo", "none", N, N, False, N, N),
    ("R13", "fee", "limit", 50.0, N, False, 2026, N),
]
#: How the source words a constraint's limit, its highest limit and its duty, by constraint number.
WORDINGS = {0: ("one and a half months", N, N), 1: (N, N, "keep it in a bank"), 2: ("two months", "three months", N), 3: ("one month", N, N), 7: ("50", N, N)}
#: What a rule that yields says about it.
RELATION_TEXTS = {"R16": "a city may go further"}
#: Action: the unit of its parameter.
UNITS = {"algo": "", "deposit": "months", "fee": "dollars"}
#: Labels of change cases, with the place and category they name.
SELECTIONS = [
    ("NATION_9-FEE-1", "C7", "NATION_9, MIDDLE EAST", "fee"), ("NATION_9-FEE-2", "C6", "NATION_9, MIDDLE EAST", "fee"), ("NATION_3-DEP-1", "C6", "NATION_3, EUROPE", "deposit"),
    ("NATION_2-ALGO-1", "C6", "NATION_2, ASIA", "algo"), ("ODD-1", "C6", N, N),
]
#: Listed sources: jurisdiction and whether it can be read.
MANIFEST = [("NATION_14, AFRICA", False), ("NATION_14, AFRICA", False), ("NATION_0, AFRICA", False), ("NATION_0, AFRICA", True), ("NATION_4, MIDDLE EAST", False)]
#: What is derived from the two, stated for comparison.
GAPS = [
    ("NATION_9, MIDDLE EAST", "fee", "NATION_9, MIDDLE EAST: no fee rule could be extracted, although change test C6 names NATION_9-FEE-2."),
    ("NATION_3, EUROPE", "deposit", "NATION_3, EUROPE: no deposit rule could be extracted, although change test C6 names NATION_3-DEP-1."),
    *[("NATION_14, AFRICA", c, f"NATION_14, AFRICA: none of its 2 listed sources could be read, and no {c} rule is stored for it.") for c in ("algo", "deposit", "fee", "rent")],
    *[("NATION_4, MIDDLE EAST", c, f"NATION_4, MIDDLE EAST: none of its 1 listed sources could be read, and no {c} rule is stored for it.") for c in ("algo", "deposit", "rent")],
]
# case, type, rule ids, dates, states
CASES = [
    ("C1", "as_of", ["R07"], ["2026-10-01", "2027-07-02"], ["ASIA"]),
    ("C2", "boundary", ["R05", "R06"], ["2026-10-01"], N),
    ("C3", "pending", ["R09"], ["2026-10-01"], ["EUROPE"]),
    ("C4", "negative", ["R10"], ["2026-10-01"], ["EUROPE"]),
    ("C5", "boundary", [], ["2026-10-01"], N),
]
DATES = ("2025-12-31", "2026-10-01", "2027-07-02")
AS_OF = "2026-10-01"


def title(rule_id: str) -> str:
    return f"Rule {rule_id}"


def rules(spark: SparkSession) -> DataFrame:
    rows = [(r[0], r[1], r[2], title(r[0]), *r[3:8], r[8], f"own note of {r[0]}" if r[8] else None, r[9], r[10], RELATION_TEXTS.get(r[0]), f"Code {r[0]}", f"What {r[0]} asks") for r in RULES]
    return spark.createDataFrame(rows, RULE_SCHEMA)


def constraints(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *c, *WORDINGS.get(i, (N, N, N)), f"quote {i}") for i, c in enumerate(CONSTRAINTS)], CONSTRAINT_SCHEMA)


def gaps(spark: SparkSession) -> DataFrame:
    """The known gaps, derived from the cases' labels and the listed sources."""
    manifest = spark.createDataFrame(MANIFEST, "jurisdiction string, readable boolean")
    selections = spark.createDataFrame(SELECTIONS, "label string, case_id string, jurisdiction string, category string")
    return stores.known_gaps(manifest, selections, rules(spark), sorted([*ACTIONS, "rent"]))


def cases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CASES, "case_id string, type string, rule_ids array<string>, dates array<string>, states array<string>")


def addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One place a customer: state and city from region and nation, facts from the key."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    nations = read("nation").join(read("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    key = F.col("c_custkey")
    joined = read("customer").select("c_custkey", "c_nationkey").join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    return joined.select(
        key.alias("address_id"),
        F.col("r_name").alias("state"),
        F.when((key % 50 != 0) & (key % 23 != 0), F.concat("n_name", F.lit(", "), "r_name")).alias("legal_city"),
        F.when(key % 50 == 0, "unresolved").when(key % 37 == 0, "postal_fallback").otherwise("geocoder").alias("method"),
        F.when(key % 3 != 0, (key % 40 + 1).cast("int")).alias("units"),
        F.when(key % 5 != 0, (1940 + key % 85).cast("int")).alias("year_built"),
    )


def places(spark: SparkSession, sf_dir: str, dates: tuple[str, ...] = (AS_OF,)) -> DataFrame:
    """Addresses, one row for each date asked about."""
    return addresses(spark, sf_dir).withColumn("as_of", F.explode(F.array(*[F.lit(d).cast("date") for d in dates])))
