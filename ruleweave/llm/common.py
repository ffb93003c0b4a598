"""Shared helpers: table access, cutting lineage, size-checked broadcasts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but these ASCII white-space characters.
SPACE_CLASS = r"[\x20\x09-\x0D]"
#: Rows of a join side that may be broadcast after they have been counted. A row of two longs takes
#: under 64 bytes in a hashed relation, so a broadcast stays under 32 MB.
BROADCAST_ROWS = 500_000
#: Rows of whole texts that a Python worker takes apart at a time, of the 64 MB that Spark sends it at once.
ROWS_AT_ONCE = 200
#: A key is hot with this share of a join side's rows; so at most 10,000 keys are.
HOT_SHARE = 1e-4


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the data folder; the path goes to Spark as it is."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """The same rows, fewer at a time, to bound what a Python worker makes of them at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


@lru_cache(maxsize=1)
def _local_dir() -> str:
    made = tempfile.mkdtemp(prefix="ruleweave-shared-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    return f"file://{made}"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, named by the session; one of this process only where it is all there is."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return _local_dir()


def cut(df: DataFrame, tag: str, held: list | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: later plans start from files that outlive executors.

    The table is added to held, of what is to be deleted once nothing reads it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._cut_path = path
    if held is not None:
        held.append(found)
    return found


def discard(*tables: DataFrame | None) -> None:
    """Delete what ``cut`` wrote, once nothing that is still to run reads it."""
    for df in tables:
        path = getattr(df, "_cut_path", None)
        if path:
            jvm, jsc = df.sparkSession._jvm, df.sparkSession._jsc
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(jsc.hadoopConfiguration()).delete(at, True)


def fits_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether df has few enough rows to be sent whole; counting stops beyond that."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only when df has been counted and is small; otherwise Spark shuffles both sides."""
    return F.broadcast(df) if fits_broadcast(df, rows) else df


def hot_values(df: DataFrame, column: str) -> list:
    """The values that a large share of df's rows has, counted after sums in each task: 1 / HOT_SHARE of them at most."""
    least = max(10_000, int(df.count() * HOT_SHARE))
    sizes = df.groupBy(column).agg(F.count("*").alias("_hot_n")).filter((F.col("_hot_n") > least) & F.col(column).isNotNull())
    return [r[0] for r in sizes.select(column).collect()]


def hot_sizes(sizes: DataFrame, column: str, n: str) -> list:
    """As ``hot_values``, from a table of how many rows (in column n) each value has."""
    least = max(10_000, int((sizes.agg(F.sum(n)).first()[0] or 0) * HOT_SHARE))
    return [r[0] for r in sizes.filter((F.col(n) > least) & F.col(column).isNotNull()).select(column).collect()]


def join_hot(left: DataFrame, right: DataFrame, on: str, how: str = "inner", hot: list | None = None) -> DataFrame:
    """left joined with right, which has each value of ``on`` once: left's hot values stay where they are.

    A value that a large share of left's rows has would go to one task. Such values' rows of right are few and are
    broadcast; the others meet by a shuffle. how is "inner" or "left"; hot are the values, if known.
    """
    hot = hot_values(left, on) if hot is None else hot
    if not hot:
        return left.join(right, on, how)
    spark = left.sparkSession
    keys = F.broadcast(spark.createDataFrame([(k,) for k in hot], f"`{on}` {dict(left.dtypes)[on]}"))
    few = F.broadcast(right.join(keys, on, "left_semi"))
    crowd = left.join(keys, on, "left_semi").join(few, on, how)
    return crowd.unionByName(left.join(keys, on, "left_anti").join(right.join(keys, on, "left_anti"), on, how))


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row, also where body uses it inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+"), "")
