"""Work by content: what a chunk depends on names it, so that only what is new is done again; and what is found is verified.

A store of answers is a table by key. Chunks whose key it has are hits; the others are the work of a run. Both are one
equi-join by key, whatever the store holds, and new answers are appended as files of one commit, which readers see whole or not
at all. A key that was put twice counts once, by its first answer.

Defined cases: null texts are empty ones; equal chunks of several documents are asked about once; an empty store makes all
chunks work; an empty table gives empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleweave.functions import mentions
from ruleweave.functions import text as tx
from ruleweave.operators.common import state_of

# Why a date is not taken, and what is noted of one that is.
REJECTED_DATES = {"amendment_note": "the document gives it only as the date of the latest amendment", "period_start": "the document gives it only as the start of a rate period"}
VERSION_DATE = "is the date the section's current text took effect, per the code page's version note"


def allowed_jurisdictions(jurisdiction: Column) -> Column:
    """A document's own jurisdiction and its state; none where it has none."""
    return F.when(jurisdiction.isNotNull(), F.array_distinct(F.array(jurisdiction, state_of(jurisdiction)))).otherwise(F.array().cast("array<string>"))


def chunk_key(text: Column, version: str, model: str, allowed: Column) -> Column:
    """A digest of everything that changes the answer about a chunk."""
    return F.sha2(F.to_json(F.struct(F.coalesce(text, F.lit("")).alias("text"), F.lit(version).alias("version"), F.lit(model).alias("model"), allowed.alias("allowed"))), 256)


def answered(store: DataFrame) -> DataFrame:
    """Each key of a store once, with its first answer. store: (key, at, answer)."""
    return store.groupBy("key").agg(F.min_by("answer", "at").alias("answer"))


def split(chunks: DataFrame, store: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The chunks that the store answers, with answer, and the distinct keys and texts of those it doesn't."""
    hits = chunks.join(answered(store), "key")
    work = chunks.join(store.select("key"), "key", "left_anti").groupBy("key").agg(F.min_by(F.struct("text", "allowed"), F.struct("doc_id", "chunk")).alias("t")).select("key", "t.text", "t.allowed")
    return hits, work


def cached_documents(chunks: DataFrame, store: DataFrame) -> DataFrame:
    """Documents all of whose chunks the store answers."""
    known = store.select("key").distinct().withColumn("known", F.lit(True))
    return chunks.join(known, "key", "left").groupBy("doc_id").agg(F.bool_and(F.coalesce("known", F.lit(False))).alias("whole")).filter("whole").select("doc_id")


def put(answers: DataFrame, path: str) -> None:
    """Append answers (key, at, answer) to the store at a path; a run that fails leaves nothing that is read."""
    answers.select("key", "at", "answer").write.mode("append").parquet(path)


def stored(spark: SparkSession, path: str) -> DataFrame:
    """The store at a path, empty where there is none yet."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], "key string, at long, answer string")
    return spark.read.schema("key string, at long, answer string").parquet(path)


def run(chunks: DataFrame, path: str, ask, at: int) -> DataFrame:
    """The answers to all chunks: those of the store at path, and of the others, which ask (key, text, allowed) is put to and whose
    answers (key, answer) join the store. at numbers the run."""
    spark = chunks.sparkSession
    _, work = split(chunks, stored(spark, path))
    put(ask(work).withColumn("at", F.lit(at).cast("long")), path)
    return split(chunks, stored(spark, path))[0]


def verify_extracted(rows: DataFrame) -> DataFrame:
    """Extracted rules with verification, quoted_span and dropped, why a row can't be kept.

    rows has text, own_jurisdiction (of the document), jurisdiction, title, citation, quoted_span and repaired_quote. A rule
    stays in the jurisdictions of its document, or has the shape of one; a quote that isn't there may be repaired
    once; an unverified rule is kept with a quote of enough characters.
    """
    allowed = allowed_jurisdictions(F.col("own_jurisdiction"))
    fits = F.when(F.col("own_jurisdiction").isNotNull(), F.array_contains(allowed, F.col("jurisdiction"))).otherwise(tx.is_jurisdiction(F.col("jurisdiction")))
    own, again = tx.verify_quote(F.col("text"), F.col("quoted_span")), tx.verify_quote(F.col("text"), F.coalesce("repaired_quote", F.lit("")))
    seen = rows.withColumns({"_own": own, "_again": again})
    verified, repaired = F.coalesce(F.col("_own.method") != "failed", F.lit(False)), F.coalesce(F.col("_again.method") != "failed", F.lit(False))
    long = lambda q: F.length(q) >= tx.SHORTEST_QUOTE
    kept = F.when(verified, F.col("_own.quoted_span")).when(repaired, F.col("_again.quoted_span")).when(long(F.col("quoted_span")), F.col("quoted_span")).when(long(F.col("repaired_quote")), F.col("repaired_quote"))
    label = F.concat(F.lit('dropped "'), "title", F.lit('" ('), "citation", F.lit(")"))
    listed = F.when(F.size(allowed) > 0, F.concat(F.lit(" ("), F.array_join(allowed, ", "), F.lit(")"))).otherwise("")
    outside = F.concat(label, F.lit(': jurisdiction "'), "jurisdiction", F.lit('" is not allowed'), listed)
    dropped = F.when(~F.coalesce(fits, F.lit(False)), outside).when(kept.isNull(), F.concat(label, F.lit(": quote shorter than 20 characters")))
    method = F.when(verified, F.col("_own.method")).when(repaired, "repaired").otherwise("failed")
    return seen.withColumns({"dropped": dropped, "verification": method, "quoted_span": kept}).drop("_own", "_again")


def appended(basis: Column, note: Column) -> Column:
    """A basis with a note in brackets behind it; without a note as it is."""
    return F.when(note.isNull(), basis).otherwise(F.concat_ws(" ", F.nullif(basis, F.lit("")), F.concat(F.lit("["), note, F.lit("]"))))


def guard_dates(rows: DataFrame) -> DataFrame:
    """rows with effective_date taken back where the text words it only as an amendment's date or a period's start, and status_basis
    saying so. rows has text, effective_date and status_basis."""
    context = F.when(F.col("effective_date").isNull(), "stated").otherwise(mentions.date_context(F.col("text"), F.col("effective_date")))
    seen = rows.withColumn("_context", context)
    why = F.try_element_at(F.create_map(*[F.lit(x) for pair in REJECTED_DATES.items() for x in pair]), F.col("_context"))
    note = F.when(why.isNotNull(), F.concat(F.lit("effective_date "), "effective_date", F.lit(" not used: "), why)).when(F.col("_context") == "version_note", F.concat(F.lit("effective_date "), "effective_date", F.lit(f" {VERSION_DATE}")))
    return seen.withColumns({"status_basis": appended(F.col("status_basis"), note), "effective_date": F.when(why.isNull(), F.col("effective_date"))}).drop("_context")
