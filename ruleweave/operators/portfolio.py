"""Orders, pages and neighbours of decision tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleweave.operators.decide import RANK


def decision_rank(column: str):
    """BLOCK first, PASS last."""
    return F.coalesce(*[F.when(F.col(column) == d, 3 - r) for d, r in RANK.items()])


def sort_rows(rows: DataFrame, key: str, descending: bool = False) -> DataFrame:
    """Rows by a key, then decision, city and id; rows without a city are last whichever way city is sorted."""
    first = decision_rank("decision") if key == "decision" else F.col(key)
    lead = first.desc_nulls_last() if descending else first.asc_nulls_last()
    return rows.orderBy(lead, decision_rank("decision"), F.col("legal_city").asc_nulls_last(), "address_id")


def page(rows: DataFrame, size: int = 50) -> DataFrame:
    """The first page of sorted rows, a top-k report."""
    return rows.limit(size)


def nearest_points(points: DataFrame, day, k: int = 8) -> DataFrame:
    """The k change points nearest a day, a top-k report; the earlier of two equally near wins."""
    near = points.withColumn("gap", F.abs(F.datediff("day", day))).orderBy("gap", "day", "label").limit(k)
    return near.orderBy("day", "label").drop("gap")
