"""Exact ranked lexical search by the Best Position Algorithm.

Every term of a query has an impact list: the documents that hold it, highest impact first. A query goes down its lists
side by side. A document met in one list is looked up in all the others at once, which gives its whole score and its
places there. The best position of a list is the last up to which every place has been seen, by going down or by a
look-up, so it runs ahead of the last place read. A document not seen yet scores at most the sum of the impacts at the
first places not seen; the search stops once that is strictly below the k-th score, so no tie is lost.

Lists are held by shards of documents. A shard has about SHARD postings, each task ranks its own documents for every
query, and the k best of each shard meet in two steps. So no list is ever whole in one task, however common its term,
and all documents are searched. Only statistics of the collection cross shards: the number of documents with a term and
of all terms, and the document frequency of the queries' terms.

Queries come in blocks of about BLOCK_TERMS terms; a block's terms are sent to all tasks, a few MB at most. There are as
many passes over the postings as blocks.

Defined cases: a null text has no term; a query without terms, or without a document that scores above 0, has no rows;
rows that repeat an id, or have none, are documents or queries of their own, and among equal scores those without id come
first; an empty table gives an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ruleweave.llm.common import cut, discard, slices

K = 10
#: Postings of a shard: some 100 MB with all that is made of them.
SHARD = 2_000_000
#: Terms of a block of queries, repeats in other queries included.
BLOCK_TERMS = 200_000
#: Places of every list read at first; each later step reads twice as many.
FIRST_DEPTH = 16
#: Parts in which a query's shard results meet first.
MEETING = 64
# Fixed value: bytes that are in no term part terms; A to Z are lowered.
_IN_TERMS = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))


def terms(raw: bytes | None) -> list[bytes]:
    """The terms of a text in order, repeats included."""
    return raw.translate(_IN_TERMS).split() if raw else []


def weight(n: int, df: int) -> int:
    """A term's weight among n documents of which df hold it."""
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


class Lists:
    """Impact lists of one shard: postings by term, highest impact first, and their places by document."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray):
        keep = impact > 0
        term, doc, impact = term[keep], doc[keep], impact[keep]
        down = np.lexsort((doc, -impact, term))
        self.doc, self.impact, sorted_term = doc[down], impact[down], term[down]
        self.terms, self.starts = np.unique(sorted_term, return_index=True)
        self.ends = np.append(self.starts[1:], len(sorted_term))
        place = np.arange(len(down)) - np.repeat(self.starts, self.ends - self.starts)
        across = np.lexsort((self.doc, sorted_term))  # the same lists by document, for look-ups
        self.by_doc, self.place = self.doc[across], place[across]

    def of(self, term: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        """(documents, impacts) downwards and (documents, places) by document; None if no document holds the term."""
        at = int(np.searchsorted(self.terms, term))
        if at == len(self.terms) or self.terms[at] != term:
            return None
        own = slice(int(self.starts[at]), int(self.ends[at]))
        return self.doc[own], self.impact[own], self.by_doc[own], self.place[own]


def best_positions(lists: list[tuple], order: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray, int]:
    """(documents, scores, places read) of the k best by score and then by order; scores are above 0.

    lists are those of ``Lists.of``; order has the rank of each document of the shard among equal scores.
    """
    seen = [np.zeros(len(docs), bool) for docs, _, _, _ in lists]
    best = [0] * len(lists)
    known = np.zeros(len(order), bool)
    docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    depth, step, read = 0, FIRST_DEPTH, 0
    while lists:
        fresh = [own[depth : depth + step] for own, _, _, _ in lists]
        read += sum(map(len, fresh))
        fresh = np.unique(np.concatenate(fresh))
        fresh = fresh[~known[fresh]]
        known[fresh] = True
        totals = np.zeros(len(fresh), np.int64)
        depth, bound = depth + step, 0
        for j, (_, impacts, by_doc, places) in enumerate(lists):
            at = np.minimum(np.searchsorted(by_doc, fresh), len(by_doc) - 1)  # direct accesses
            held = by_doc[at] == fresh
            found = places[at[held]]
            totals[held] += impacts[found]
            seen[j][found] = True
            rest = seen[j][best[j] :]
            open_at = int(np.argmin(rest)) if len(rest) else 0
            best[j] = best[j] + open_at if len(rest) and not rest[open_at] else len(seen[j])
            if best[j] < len(impacts):
                bound += int(impacts[best[j]])
        docs, scores = np.concatenate([docs, fresh]), np.concatenate([scores, totals])
        if len(docs) > k:
            top = np.lexsort((order[docs], -scores))[:k]
            docs, scores = docs[top], scores[top]
        if not bound or (len(docs) == k and bound < scores.min()):
            break
        step *= 2
    return docs, scores, read


def postings(docs: DataFrame, wanted: dict[bytes, int], key: str, text: str) -> DataFrame:
    """(key, n, terms, tfs) of every document with a term: how many it has, and the numbers and frequencies of the wanted ones."""
    sent = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = sent.value
        for batch in slices(batches):
            sizes, at, flat, counts, kept = [], [0], [], [], []
            for i, raw in enumerate(batch.column(1).to_pylist()):
                found = terms(raw)
                if not found:
                    continue
                own = Counter(found)
                held = own.keys() & number.keys()
                flat += [number[t] for t in held]
                counts += [own[t] for t in held]
                at.append(len(flat))
                sizes.append(len(found))
                kept.append(i)
            ends = pa.array(at, pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (flat, counts)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept, pa.int64())), pa.array(sizes, pa.int64()), *lists], names=["key", "n", "terms", "tfs"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("_key"), F.col(text).cast("binary").alias("_text")).mapInArrow(run, f"key {kind}, n bigint, terms array<int>, tfs array<int>")


def _ranked(shards: DataFrame, asked: list[tuple[int, list[int]]], weights: dict[int, int], total: tuple[int, int], k: int, kind: str) -> DataFrame:
    """(query, shard, key, score) of the k best of each shard for each query, given by number and terms."""
    sent = shards.sparkSession.sparkContext.broadcast((asked, weights, total))

    def run(own: pa.Table) -> pa.Table:
        queries, weighed, (n_docs, n_terms) = sent.value
        own = own.combine_chunks()
        keys, n = own.column("key"), own.column("n").to_numpy()
        held = own.column("terms").combine_chunks()
        sizes = held.value_lengths().to_numpy(zero_copy_only=False)
        term, tf = held.flatten().to_numpy().astype(np.int64), own.column("tfs").combine_chunks().flatten().to_numpy().astype(np.int64)
        doc = np.repeat(np.arange(len(n)), sizes)
        m = 100 - 90 + (90 * n * n_docs) // n_terms
        worth = np.zeros(max(weighed, default=0) + 1, np.int64)
        worth[list(weighed)] = list(weighed.values())
        lists = Lists(term, doc, worth[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc])))
        order = np.empty(len(n), np.int64)
        order[pc.sort_indices(keys, null_placement="at_start").to_numpy()] = np.arange(len(n))
        numbers, chosen, scores = [], [], []
        for number, asked_terms in queries:
            best, points, _ = best_positions([x for x in map(lists.of, asked_terms) if x], order, k)
            numbers += [number] * len(best)
            chosen.append(best)
            scores.append(points)
        chosen, scores = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (chosen, scores))
        shard = own.column("shard")[0].as_py()
        return pa.table({"query": pa.array(numbers, pa.int64()), "shard": pa.array([shard] * len(numbers), pa.int64()), "key": keys.take(pa.array(chosen)).combine_chunks(), "score": pa.array(scores, pa.int64())})

    return shards.groupBy("shard").applyInArrow(run, f"query bigint, shard bigint, key {kind}, score bigint")


def search(docs: DataFrame, queries: DataFrame, k: int = K, key: str = "doc_id", text: str = "text", query_key: str = "item_id", query_text: str = "text") -> DataFrame:
    """(query_key, rank, key, score) of the k documents of the highest scores above 0 for each row of queries."""
    spark = docs.sparkSession
    asked_rows = cut(queries.select(F.col(query_key).alias("item"), F.col(query_text).cast("binary").alias("said")).withColumn("query", F.monotonically_increasing_id()), "search-queries")
    bytes_asked = asked_rows.agg(F.sum(F.octet_length("said"))).first()[0] or 0
    blocks = max(1, -(-bytes_asked // (2 * BLOCK_TERMS)))  # a term and what parts it from the next take two bytes at least
    kind = docs.schema[key].dataType.simpleString()
    parts = []
    for block in range(blocks):
        own = asked_rows.filter(F.pmod(F.xxhash64("query"), F.lit(blocks)) == block)
        said = [(r["query"], list(dict.fromkeys(terms(bytes(r["said"] or b""))))) for r in own.select("query", "said").collect()]
        number = {t: i for i, t in enumerate(dict.fromkeys(t for _, ts in said for t in ts))}
        held = cut(postings(docs, number, key, text), "search-postings")
        n_docs, n_terms, n_postings = held.agg(F.count("*"), F.sum("n"), F.sum(F.size("terms"))).first()
        if not n_postings:
            discard(held)
            continue
        frequency = held.select(F.explode("terms").alias("term")).groupBy("term").count().collect()
        weights = {r["term"]: weight(n_docs, r["count"]) for r in frequency}
        shards = max(1, -(-n_postings // SHARD))
        dealt = held.filter(F.size("terms") > 0).withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)))
        asked = [(q, [number[t] for t in ts]) for q, ts in said if ts]
        parts.append(cut(_ranked(dealt, asked, weights, (n_docs, n_terms), k, kind), "search-shards"))
        discard(held)
    if not parts:
        found = spark.createDataFrame([], f"query bigint, shard bigint, key {kind}, score bigint")
    else:
        found = parts[0]
        for more in parts[1:]:
            found = found.unionByName(more)
    best = [F.desc("score"), F.asc_nulls_first("key")]
    first = Window.partitionBy("query", F.pmod("shard", F.lit(MEETING))).orderBy(*best)
    met = found.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= k)
    ranked = met.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*best))).filter(F.col("rank") <= k)
    return ranked.join(asked_rows.select("query", "item"), "query").select(F.col("item").alias(query_key), "rank", F.col("key").alias(key), "score")
