"""Typed scans and sinks: CSV, JSON lines, documents with headers, ingested files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleweave.functions.text import html_to_text, parse_header


def scan_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Quoted CSV with a header; a malformed row fails the job."""
    return spark.read.csv(path, schema=schema, header=True, multiLine=True, quote='"', escape='"', mode="FAILFAST", enforceSchema=False)


def digits(text: Column) -> Column:
    """A whole number of digits only, else null."""
    return F.when(F.trim(text).rlike(r"^\d+$"), F.trim(text).try_cast("int"))


def scan_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object a line; a malformed line fails the job, a blank one is skipped."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def scan_cache(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Cached entries; unreadable ones are misses."""
    return spark.read.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path).filter("_corrupt IS NULL").drop("_corrupt")


def scan_docs(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """Whole documents of a manifest (doc_id, text_file, status, url, retrieved_at), header lines before manifest values."""
    texts = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("text_file"), F.col("value").alias("text"))
    readable = manifest.filter("status = 'ok' AND text_file <> ''")
    head = parse_header(F.col("text"))
    joined = readable.join(texts, "text_file").withColumn("_h", head)
    return joined.select("doc_id", F.coalesce("_h.source_url", "url").alias("source_url"), F.coalesce("_h.retrieved_at", "retrieved_at").alias("retrieved_at"), "text")


def scan_ingested(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder as documents named by their content; pages are turned into text."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "[!.]*").load(path).filter(~F.endswith("path", F.lit("/index.json")))
    text = F.decode("content", "UTF-8")
    shown = F.when(F.startswith(F.lower(F.trim(text)), F.lit("<!doctype html")), html_to_text(text)).otherwise(text)
    return raw.select(F.concat(F.lit("X"), F.substring(F.sha2("content", 256), 1, 7)).alias("doc_id"), "path", shown.alias("text"))


def first_of_each(docs: DataFrame, key: str, rank: str) -> DataFrame:
    """The row of lowest rank for each key (official before supplemental before ingested)."""
    return docs.groupBy(key).agg(F.min_by(F.struct(*[c for c in docs.columns if c != key]), rank).alias("_r")).select(key, "_r.*")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with the rows of new in place of those of the same key."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def write_jsonl(rows: DataFrame, path: str, order: str) -> None:
    """Sorted JSON lines with nulls kept: range-sorted part files, in order by name."""
    rows.orderBy(order).write.option("ignoreNullFields", "false").mode("overwrite").json(path)
