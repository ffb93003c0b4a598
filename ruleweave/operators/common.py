"""Small helpers of the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules, constraints and cases are rows of under 4 kB; a broadcast of so many stays under 40 MB.
BROADCAST_ROWS = 10_000


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A side of a join that is sent whole if it has few rows; a larger one is left to Spark's shuffled joins.

    One job reads the few rows, or finds that there are more; the plans that use the side then hold its rows and not, once more
    for each use, the joins and groupings that made them.
    """
    few = df.limit(BROADCAST_ROWS + 1).collect()
    if len(few) <= min(rows, BROADCAST_ROWS):
        return F.broadcast(df.sparkSession.createDataFrame(few, df.schema))
    return F.broadcast(df) if rows > BROADCAST_ROWS and df.limit(rows + 1).count() <= rows else df


def dealt(df: DataFrame, key: str, parts: int | None = None) -> DataFrame:
    """Rows dealt by a key to parts, or as many as a shuffle has; by number, so that what else is dealt so lies beside them."""
    return df.repartition(parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def level_of(jurisdiction: Column) -> Column:
    return F.when(F.contains(jurisdiction, F.lit(",")), "city").otherwise("state")


def state_of(jurisdiction: Column) -> Column:
    """The state a jurisdiction lies in: the text after the comma, or the whole."""
    return F.trim(F.when(F.contains(jurisdiction, F.lit(",")), F.regexp_extract(jurisdiction, r",([^,]*)", 1)).otherwise(jurisdiction))
