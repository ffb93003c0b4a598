"""Candidates of one law made one rule: numbering, primary choice, dates, status, grouping checks, chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CHUNK = 24_000
OVERLAP = 1_500
CLOSE_DAYS = 366


def number_candidates(rows: DataFrame, doc: str, order: list[str]) -> DataFrame:
    """rows with candidate_id, the document and a number in the given order (nulls last)."""
    n = F.row_number().over(W.partitionBy(doc).orderBy(*[F.asc_nulls_last(c) for c in order]))
    return rows.withColumn("candidate_id", F.concat(F.col(doc).cast("string"), F.lit("#"), n.cast("string")))


def choose_primary(members: DataFrame, group: list[str]) -> DataFrame:
    """One member a group: verified first, then official among them, then the model's pick, then the lowest id.

    members has candidate_id, verified, official and picked. The choice is an aggregate, so a large group is
    summed up where its rows are.
    """
    rank = F.struct(~F.col("verified"), ~(F.col("verified") & F.col("official")), ~F.col("picked"), "candidate_id")
    return members.groupBy(*group).agg(F.min_by("candidate_id", rank).alias("primary_id"))


def distinct_dates(dates: Column) -> Column:
    """Distinct partial dates in order, without those a longer one begins with."""
    every = F.array_distinct(F.filter(dates, lambda d: d.isNotNull()))
    return F.array_sort(F.filter(every, lambda d: ~F.exists(every, lambda o: (o != d) & F.startswith(o, d))))


def close_dates(days: Column) -> Column:
    """Distinct days that have another less than a year from them; two or more are a conflict."""
    every = F.array_sort(F.array_distinct(F.filter(days, lambda d: d.isNotNull())))
    return F.filter(every, lambda d, i: F.coalesce(F.datediff(d, F.get(every, i - 1)) < CLOSE_DAYS, F.lit(False)) | F.coalesce(F.datediff(F.get(every, i + 1), d) < CLOSE_DAYS, F.lit(False)))


def resolve_status(own: Column, statuses: Column, dated: Column) -> Column:
    """struct(status, conflict) of a group: its primary's own status, the distinct statuses of its verified members, and
    whether a verified enacted member has a date.

    Enacted with a date, or failed, beats pending. Enacted against failed, and enacted without a date, are conflicts that
    stay with the primary.
    """
    has = lambda s: F.array_contains(statuses, s)
    given = lambda status, conflict: F.struct(status.alias("status"), F.lit(conflict).alias("conflict"))
    return (
        F.when(F.size(statuses) < 2, given(own, False))
        .when(has("enacted") & has("failed"), given(own, True))
        .when(has("failed"), given(F.lit("failed"), False))
        .when(dated, given(F.lit("enacted"), False))
        .otherwise(given(own, True))
    )


def merge_values(values: Column, most: int = 3) -> Column:
    """Up to three values that differ in more than case, the first first, joined."""
    trimmed = F.filter(F.transform(values, F.trim), lambda v: v != "")
    fresh = F.filter(trimmed, lambda v, i: ~F.exists(F.slice(trimmed, 1, i), lambda o: F.lower(o) == F.lower(v)))
    return F.array_join(F.slice(fresh, 1, most), "; ")


def grouping_problem(answers: DataFrame, members: DataFrame) -> DataFrame:
    """(cell, problem): why a proposed grouping of a cell's candidates cannot be used; null if it can.

    answers: (cell, group_no, member_id, primary_id); members: (cell, candidate_id).
    """
    said = answers.select("cell", "group_no", F.col("member_id").alias("id"), "primary_id", F.lit(True).alias("told"))
    both = said.unionByName(members.select("cell", F.col("candidate_id").alias("id"), F.lit(False).alias("told")), allowMissingColumns=True)
    of_id, told, null = W.partitionBy("cell", "id"), F.col("told"), F.col("id").isNull()  # a null id is no other's
    counted = both.withColumns({"times": F.count_if(told).over(of_id), "known": F.bool_or(~told).over(of_id), "inside": F.bool_or(F.when(told, F.col("id") == F.col("primary_id"))).over(W.partitionBy("cell", "group_no"))})
    found = counted.groupBy("cell").agg(
        F.bool_or(F.col("times") > 1).alias("twice"), F.bool_or(told & (~F.col("known") | null)).alias("strange"), F.bool_or(~told & ((F.col("times") == 0) | null)).alias("left_out"), F.bool_or(F.when(told, ~F.col("inside"))).alias("outside"),
    )
    why = F.when(F.col("twice"), "id in two groups").when(F.col("strange"), "unknown id").when(F.col("left_out"), "id left out").when(F.col("outside"), "primary outside its group")
    return found.select("cell", why.alias("problem"))


def cut_text(text: str, most: int = CHUNK, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """[start, end) of a text's chunks: cut at the last blank line or newline of the second half, resumed after a newline."""
    if len(text) <= most:
        return [(0, len(text))]
    out, start = [], 0
    while True:
        end = start + most
        if end >= len(text):
            out.append((start, len(text)))
            return out
        for mark in ("\n\n", "\n"):
            at = text.rfind(mark, start + most // 2, end)
            if at >= 0:
                end = at + len(mark)
                break
        out.append((start, end))
        back = max(start + 1, end - overlap)
        line = text.find("\n", back, end)
        start = line + 1 if 0 <= line < end - 1 else back


def chunk_documents(docs: DataFrame, most: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, chunk, start, end, text) of every document's chunks."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, k, a, b, t[a:b]) for i, t in zip(pdf["doc_id"], pdf["text"].fillna(""), strict=True) for k, (a, b) in enumerate(cut_text(t, most, overlap))]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk", "start", "end", "text"])

    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, chunk int, start int, end int, text string")
