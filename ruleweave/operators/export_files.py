"""Canonical export: rows as key-sorted JSON in range-sorted part files, a digest that no partitioning changes, and checks of order.

A row's JSON has its keys in order and its numbers as they print, so equal rows are equal bytes. Parts are cut at keys of a sample
that is drawn by a hash of the key, so they are the same for the same rows, whatever ran them; each part is one sorted
file. The digest adds up the rows' SHA-256 in four 64-bit lanes: sums are made in each task, meet in any order, and say
the same for any number of partitions.

Order and uniqueness over partitions are judged without moving rows: each partition tells its first and last key and its own
breaks, and only those few rows meet.

Defined cases: null values stay in the JSON; keys must not be null for the order checks, null ones count as breaks; equal
rows are told by their number; an empty table has the digest of no rows and no breaks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Sampled keys a part, of which each so-manieth is a border.
SAMPLED = 20


def sorted_keys(value: Column, kind: T.DataType) -> Column:
    """A value with the fields of its structs in order of their names, at any depth."""
    if isinstance(kind, T.StructType):
        inner = F.struct(*[sorted_keys(value[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)])
        return F.when(value.isNotNull(), inner)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda v: sorted_keys(v, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.map_from_entries(F.array_sort(F.map_entries(value)))
    return value


def canonical_json(df: DataFrame) -> Column:
    """A row's JSON: keys in order at any depth, nulls kept."""
    fields = [sorted_keys(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in sorted(df.schema.fields, key=lambda f: f.name)]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def tree_digest(rows: DataFrame, line: str = "line") -> DataFrame:
    """One row (n, digest): a digest of all lines and how often each is there, in no order."""
    lane = lambda i: F.conv(F.substring("_sha", 16 * i + 1, 16), 16, 10).cast("decimal(20,0)")
    sums = [F.coalesce(F.sum(lane(i)), F.lit(0)).cast("decimal(38,0)").alias(f"s{i}") for i in range(4)]
    found = rows.select(F.sha2(line, 256).alias("_sha")).agg(F.count("*").alias("n"), *sums)
    wrapped = [F.pmod(F.col(f"s{i}"), F.lit(str(2**64)).cast("decimal(38,0)")).cast("string") for i in range(4)]
    return found.select("n", F.sha2(F.concat_ws("|", F.col("n").cast("string"), *wrapped), 256).alias("digest"))


def borders(df: DataFrame, key: str, parts: int) -> list:
    """Keys that cut df into about so many equal ranges: of a sample drawn by the keys' hash, SAMPLED a part."""
    n = df.count()
    every = max(1, n // (parts * SAMPLED))
    drawn = df.filter(F.pmod(F.xxhash64(key), F.lit(every)) == 0).select(key).distinct().orderBy(key).limit(4 * parts * SAMPLED)
    sample = [r[0] for r in drawn.collect()]
    step = max(1, len(sample) // parts)
    return sample[step::step][: parts - 1]


def lines(df: DataFrame, key: str, parts: int) -> DataFrame:
    """(part, key, line) of df, dealt to parts by ranges of the key and in its order, a part in one task."""
    cuts = borders(df, key, parts)
    kind = df.schema[key].dataType
    part = F.size(F.filter(F.array(*[F.lit(c).cast(kind) for c in cuts]), lambda c: c <= F.col(key))) if cuts else F.lit(0)
    rows = df.select(part.alias("part"), F.col(key), canonical_json(df).alias("line"))
    return rows.repartition(max(1, len(cuts) + 1), "part").sortWithinPartitions("part", key, "line")


def write(df: DataFrame, key: str, path: str, parts: int) -> None:
    """df as text under a path, a folder ``part=i`` with one sorted file a range: the same bytes for the same rows."""
    lines(df, key, parts).select("part", F.col("line").alias("value")).write.partitionBy("part").mode("overwrite").text(path)


def partition_edges(df: DataFrame, key: str, place: Column | None = None) -> DataFrame:
    """(place, first, last, n, breaks, repeats) of each partition as it lies: rows not above the one before them, and equal to it.

    place orders the partitions; by default a file's name and where its block starts, or else the partition's number.
    """
    kind = df.schema[key].dataType.simpleString()
    seat = F.coalesce(place, F.lit("")) if place is not None else F.format_string("%s:%012d:%08d", F.coalesce(F.input_file_name(), F.lit("")), F.input_file_block_start(), F.when(F.input_file_name() == "", F.spark_partition_id()).otherwise(0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, first, last, n, breaks, repeats, out = None, None, None, 0, 0, 0, []
        keys = None
        for batch in batches:
            keys = batch.column(1).type
            for seat, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if seat != here or not n:
                    if n:
                        out.append((here, first, last, n, breaks, repeats))
                    here, first, n, breaks, repeats = seat, k, 1, int(k is None), 0
                else:
                    n += 1
                    if k is None or last is None or k < last:
                        breaks += 1
                    elif k == last:
                        repeats += 1
                last = k
        if n:
            out.append((here, first, last, n, breaks, repeats))
        if out:
            types = [pa.string(), keys, keys, pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=["place", "first", "last", "n", "breaks", "repeats"])

    return df.select(seat.alias("place"), F.col(key).alias("key")).mapInArrow(run, f"place string, first {kind}, last {kind}, n bigint, breaks bigint, repeats bigint")


def order_problems(df: DataFrame, key: str, place: Column | None = None) -> DataFrame:
    """(place, problem, n): breaks and repeats inside partitions and between one's last key and the next one's first.

    Only edges meet, a row a partition or block; strings are compared by code point, as Spark sorts them.
    """
    edges = partition_edges(df, key, place)
    before = F.lag("last").over(W.orderBy("place"))
    met = edges.withColumn("before", before)
    kinds = F.array(
        F.struct(F.lit("not_sorted").alias("problem"), F.col("breaks").alias("n")), F.struct(F.lit("repeated").alias("problem"), F.col("repeats").alias("n")),
        F.struct(F.lit("border_not_sorted").alias("problem"), F.when(F.col("before") > F.col("first"), 1).otherwise(0).cast("long").alias("n")),
        F.struct(F.lit("border_repeated").alias("problem"), F.when(F.col("before") == F.col("first"), 1).otherwise(0).cast("long").alias("n")),
    )
    return met.select("place", F.explode(kinds).alias("p")).select("place", "p.problem", "p.n").filter("n > 0")


def to_record(rules: DataFrame, linked: DataFrame, status: Column) -> DataFrame:
    """Exported records of rules: their fields with the status on the day, and overrides and interaction from the precedence text.

    linked is ``rule_links`` (team_rule_id, linked, relations), the rules of the other level that a rule meets.
    """
    # What a link says, on the state's side and on the city's.
    state = {"yields_to_stricter_local": "Yields to a stricter local rule where one applies.", "preempts_local": "Its text bars conflicting local ordinances; flagged for review."}
    city = {"yields_to_stricter_local": "A state rule of this category yields to this local rule.", "preempts_local": "A state rule of this category bars conflicting local ordinances; flagged for review."}
    said = lambda words: F.create_map(*[F.lit(x) for pair in words.items() for x in pair])
    both = rules.join(linked, "team_rule_id", "left")
    own = F.when(F.size("linked") > 0, F.try_element_at(said(state), F.col("relation")))
    met = F.filter(F.array(*[F.lit(r) for r in city]), lambda r: F.array_contains("relations", r))
    others = F.nullif(F.array_join(F.transform(met, lambda r: F.element_at(said(city), r)), " "), F.lit(""))
    level = F.when(F.contains("jurisdiction", F.lit(",")), "city").otherwise("state")
    return both.select(
        "team_rule_id", "jurisdiction", level.alias("level"), "category", status.alias("status"), "title", "requirement", F.coalesce("linked", F.array().cast("array<string>")).alias("overrides"),
        F.when(level == "state", own).otherwise(others).alias("interaction"), "effective_date", "citation", "conflict_flag", "conflict_note",
    )


def linked_rules(rules: DataFrame) -> DataFrame:
    """(team_rule_id, linked, relations): rules of one category and state on the two levels, where the state's names its relation to local ones."""
    level = F.contains("jurisdiction", F.lit(","))
    state = F.when(level, F.trim(F.regexp_extract("jurisdiction", r",([^,]*)$", 1))).otherwise(F.col("jurisdiction"))
    small = rules.select("team_rule_id", "category", "relation", state.alias("state"), level.alias("is_city"))
    states = small.filter(~F.col("is_city") & F.col("relation").isin("yields_to_stricter_local", "preempts_local")).select(F.col("team_rule_id").alias("s"), "category", "state", "relation")
    pairs = states.join(small.filter("is_city").select(F.col("team_rule_id").alias("c"), "category", "state"), ["category", "state"])
    both = pairs.select(F.col("s").alias("team_rule_id"), F.col("c").alias("other"), "relation").unionByName(pairs.select(F.col("c").alias("team_rule_id"), F.col("s").alias("other"), "relation"))
    return both.groupBy("team_rule_id").agg(F.array_sort(F.collect_set("other")).alias("linked"), F.collect_set("relation").alias("relations"))
