"""Corpus pipeline: quality classifier, quality rules, near-dedup, best-fit packing.

Each stage takes what the one before kept, with the columns of documents, and its decision takes effect. The
last returns the packed pieces. ORACLE_SQL is None: a trained model, components of similar texts and local search have
no SQL form; tests/llm/test_pipeline.py holds the stages against brute-force versions.

Defined cases, of all stages: a null text is judged as an empty one; rows that repeat are judged one by one; rows with
a null id are rejected by the classifier only if all of them are; other columns travel along under their names (those
that start with ``_lm_``, ``_nd_`` or ``_pack_`` are reserved); empty documents give empty results; very long texts are
read whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleweave.llm import ngram_quality, packing, quality_rules, simhash
from ruleweave.llm.common import cut, read

ORACLE_SQL: str | None = None


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity under the trusted documents' model is within their language's bound."""
    trusted = read(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return ngram_quality.keep_clean(docs, trusted)


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule of the production policy rejects."""
    return quality_rules.keep_passing(docs, quality_rules.PRODUCTION_POLICY)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group connected by a five-word similarity of 0.8 or more.

    SimHash fingerprints at most two bits apart, found by the pigeonring filter, are tied first where the shingle sets confirm it.
    Near copies may differ in ten of 64 bits, so the rest is found by prefixes of the sets and sketches of them, and the sets
    confirm. Empty texts are one group; of rows with one id in one group any one stays.
    """
    return simhash.keep_first(docs, similarity=80)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of the documents left and its place in a sequence of at most 1024 tokens; an empty text is its end token."""
    pieces = packing.tokenize(docs, public_tokenizers.path("byte_bpe_50k.json"))
    digests = cut(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), "packing-pieces")
    return packing.pack(digests)


STAGES = [
    ("quality classifier", classify_quality),
    ("quality rules", apply_quality_rules),
    ("near-dedup", drop_near_duplicates),
    ("best-fit packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a data folder, each written and read again."""
    docs = read(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = cut(docs, f"pipeline-{number}")
    return docs
