"""Quality classifier: an interpolated modified Kneser-Ney model of trusted text and language quantiles.

The model is over code points, ORDER at a time, none of them folded with another.  One pass over the texts counts
the n-grams of trusted rows and notes which n-grams occur anywhere; both are shuffled by n-gram, summed in each task
before.  Continuation counts, discounts, context weights and the interpolated probabilities are joins and groupings
of these counts, sharded by n-gram or context (``probabilities``).

Scores come from one sharded join, whatever the size: texts are put together in blocks of BLOCK_CHARS code points,
each block asks for its distinct n-grams once, these requests are joined with the probabilities by n-gram, and the
answers go back to the block, where each text's perplexity is the mean of its n-grams' log probabilities
(``perplexities``).  What is shuffled so grows with the texts, and a frequent n-gram is one row for each block.

A text is rejected when its perplexity lies above its language's bound, a quantile of the trusted texts' perplexities
in that language.  Those are held out: trusted texts are dealt to two folds by their content, and each is measured by
a model of the other fold's texts.  All three models are counted, made and asked for together.

All counts cover all rows; nothing is sampled or capped.

Defined cases: a null or empty text holds only its end and is scored like any other; a language without
trusted text, or a null one, is held to the bound of all languages; without any trusted row nothing is
rejected and the perplexity is that of the uniform model; a perplexity equal to the bound is kept; rows that repeat
are scored (and counted) one by one; an empty table gives an empty result; other columns are not read, except by
``keep_clean``, which carries them (names that start with ``_lm_`` are reserved).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleweave.llm.common import broadcast_if_small, cut, discard, fits_broadcast, slices

ORDER = 4
#: Bits of a code point; ORDER - 1 of them make a context in one long.
POINT_BITS = 21
END = 3
QUANTILE = 0.98
#: Copies of a text are in one fold, so none is measured by a model that has seen it.
FOLDS = 2
#: The counts of each model: of all trusted rows, and of those outside each fold.
MODELS = ("all", "without_0", "without_1")
#: Width of the bins of log perplexity in which quantiles are found.
BIN = 0.001
#: Code points of a block and of a row of it; a longer text is a row of its own.
BLOCK_CHARS = 32_000_000
ROW_CHARS = 256_000
#: Code points whose n-grams are held at a time.
WINDOW = 500_000


# ---- n-grams of a text ----------------------------------------------------------------------------


def symbols(text: str | None) -> np.ndarray:
    """The text's code points, ended by END and led by ORDER - 1 zeros."""
    points = np.frombuffer((text or "").encode("utf-32-le", "replace"), dtype="<u4").astype(np.int64)
    return np.concatenate([np.zeros(ORDER - 1, np.int64), points, np.array([END], np.int64)])


def grams(text: str | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Name, context and last symbol of the n-gram that ends at each symbol of the text, WINDOW of them at a time.

    The context is exact; the name is a 64-bit mix of both, so two of 1e9 n-grams share one with a chance of 3 %.
    """
    s = symbols(text)
    for at in range(0, len(s) - ORDER + 1, WINDOW):
        part = s[at : at + WINDOW + ORDER - 1]
        n = len(part) - ORDER + 1
        context = np.zeros(n, np.int64)
        for i in range(ORDER - 1):
            context = (context << POINT_BITS) | part[i : n + i]
        last = part[ORDER - 1 :]
        h = context.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + last.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        yield h.view(np.int64), context, last


class _Counts:
    """Distinct n-grams of many texts and their counts in each of ``columns`` classes."""

    def __init__(self, columns: int):
        self.columns, self.parts, self.size = columns, [], 0

    def add(self, name: np.ndarray, context: np.ndarray, last: np.ndarray, column: int | None) -> None:
        names, first, n = np.unique(name, return_index=True, return_counts=True)
        counts = np.zeros((len(names), self.columns), np.int64)
        if column is not None:
            counts[:, column] = n
        self.parts.append((names, context[first], last[first], counts))
        self.size += len(names)
        if len(self.parts) > 24:
            self.parts = [self.summed()]

    def summed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        every = [np.concatenate([p[i] for p in self.parts]) for i in range(4)]
        names, first, inverse = np.unique(every[0], return_index=True, return_inverse=True)
        counts = np.stack([np.bincount(inverse, weights=every[3][:, c], minlength=len(names)) for c in range(self.columns)], axis=1)
        return names, every[1][first], every[2][first], counts.astype(np.int64)


def _texts(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple]:
    for batch in slices(batches):
        yield from zip(*(batch.column(n).to_pylist() for n in names), strict=True)


def _grouped(rows: Iterator[tuple], chars: int) -> Iterator[tuple[int | None, list[np.ndarray]]]:
    """Class and joined n-grams of many short texts of one class, about ``chars`` at a time."""
    held: dict[int | None, list] = {}
    sizes: dict[int | None, int] = {}
    for text, column in rows:
        for g in grams(text):
            held.setdefault(column, []).append(g)
            sizes[column] = sizes.get(column, 0) + len(g[0])
            if sizes[column] > chars:
                yield column, [np.concatenate(x) for x in zip(*held.pop(column), strict=True)]
                sizes[column] = 0
    for column, parts in held.items():
        yield column, [np.concatenate(x) for x in zip(*parts, strict=True)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The partition's n-grams and how often trusted rows of each fold have them."""
    counts = _Counts(FOLDS)
    for column, joined in _grouped(_texts(batches, ("text", "fold")), WINDOW):
        counts.add(*joined, column)
    if counts.parts:
        names, context, last, n = counts.summed()
        for at in range(0, len(names), 100_000):
            part = slice(at, at + 100_000)
            columns = [names[part], context[part], last[part], *n[part].T]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=["gram", "context", "last", *[f"n_{f}" for f in range(FOLDS)]])


def counts(docs: DataFrame) -> DataFrame:
    """gram, context, last and the count of each of MODELS, of every n-gram of docs (text, fold; null for rows not trusted)."""
    folds = [f"n_{f}" for f in range(FOLDS)]
    found = docs.select("text", "fold").mapInArrow(_count, "gram bigint, context bigint, last bigint, " + ", ".join(f"{f} bigint" for f in folds))
    summed = found.groupBy("gram").agg(F.first("context").alias("context"), F.first("last").alias("last"), *[F.sum(f).alias(f) for f in folds])
    total = sum((F.col(f) for f in folds), F.lit(0))
    return summed.select("gram", "context", "last", total.alias("all"), *[(total - F.col(f)).alias(f"without_{k}") for k, f in enumerate(folds)])


# ---- the model ------------------------------------------------------------------------------------


def _shorter(context: Column, order: int) -> Column:
    """The context of n-grams of one symbol less than order: its first symbol is gone."""
    return context.bitwiseAND(F.lit((1 << POINT_BITS * (order - 2)) - 1))


def discounts(counted: DataFrame, models: tuple[str, ...]) -> dict[str, tuple[float, float, float]]:
    """Modified Kneser-Ney discounts of counts 1, 2 and 3 or more of each model, from the counts of counts."""
    few = counted.agg(*[F.coalesce(F.sum((F.col(m) == i).cast("long")), F.lit(0)).alias(f"{m}_{i}") for m in models for i in (1, 2, 3, 4)]).first()
    found = {}
    for m in models:
        n1, n2, n3, n4 = (few[f"{m}_{i}"] for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 else 0.5
        raw = (1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5)
        found[m] = tuple(min(max(d, 0.05), c - 0.05) for c, d in zip((1, 2, 3), raw, strict=True))
    return found


def probabilities(counted: DataFrame, models: tuple[str, ...] = MODELS) -> DataFrame:
    """gram and each model's log probability of every n-gram counted; those not seen get what shorter ones leave them.

    The shortest n-grams leave the rest to all symbols of the texts alike.
    """
    tables = {ORDER: cut(counted, "lm-counts")}
    for k in range(ORDER - 1, 0, -1):  # how many different symbols come before the n-gram in trusted text
        grouped = tables[k + 1].groupBy(_shorter(F.col("context"), k + 1).alias("context"), "last")
        tables[k] = cut(grouped.agg(*[F.sum((F.col(m) > 0).cast("long")).alias(m) for m in models]), "lm-counts")
    vocabulary = max(tables[1].count(), 1)
    lower: DataFrame | None = None
    for k in range(1, ORDER + 1):
        ds = discounts(tables[k], models)
        taken = {m: F.when(F.col(m) == 0, 0.0).when(F.col(m) == 1, ds[m][0]).when(F.col(m) == 2, ds[m][1]).otherwise(ds[m][2]) for m in models}
        sums = [F.sum(m).alias(f"{m}_total") for m in models] + [F.sum(taken[m]).alias(f"{m}_left") for m in models]
        contexts = tables[k].groupBy("context").agg(*sums)
        joined = tables[k].join(broadcast_if_small(contexts) if k == 1 else contexts, "context")
        if lower is not None:
            joined = joined.withColumn("short", _shorter(F.col("context"), k)).join(lower.withColumnsRenamed({"context": "short"}), ["short", "last"])
        rest = {m: F.lit(1 / vocabulary) if lower is None else F.col(f"p_{m}") for m in models}
        p = {m: F.when(F.col(f"{m}_total") > 0, (F.col(m) - taken[m] + F.col(f"{m}_left") * rest[m]) / F.col(f"{m}_total")).otherwise(rest[m]) for m in models}
        lower = joined.select(*(["gram"] if k == ORDER else ["context", "last"]), *[p[m].alias(f"p_{m}") for m in models])
    found = cut(lower.select("gram", *[F.log(f"p_{m}").alias(m) for m in models]), "lm-probabilities")
    discard(*tables.values())
    return found


# ---- scores ---------------------------------------------------------------------------------------


def _blocked(schema: pa.Schema):
    """Rows (block, texts, grams): the rows of a partition, packed, and last of each block its distinct n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = pa.schema([("block", pa.int64()), ("texts", pa.binary()), ("grams", pa.binary())])
        block, chars = TaskContext.get().partitionId() << 32, 0
        asked = _Counts(1)
        rows: list[dict] = []
        held = 0

        def packed() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(pa.RecordBatch.from_pylist(rows, schema=schema))
            for _, joined in _grouped(((r["_lm_text"], None) for r in rows), WINDOW):
                asked.add(*joined, None)
            return pa.RecordBatch.from_arrays([pa.array([block]), pa.array([sink.getvalue().to_pybytes()], pa.binary()), pa.array([b""], pa.binary())], schema=made)

        def ended() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([block]), pa.array([b""], pa.binary()), pa.array([asked.summed()[0].tobytes()], pa.binary())], schema=made)

        for batch in slices(batches):
            for row in batch.to_pylist():
                rows.append(row)
                held += len(row["_lm_text"] or "") + 1
                if held > ROW_CHARS:
                    yield packed()
                    chars, rows[:], held = chars + held, [], 0
                if chars > BLOCK_CHARS:
                    yield ended()
                    block, chars, asked = block + 1, 0, _Counts(1)
        if rows:
            yield packed()
        if asked.parts:
            yield ended()

    return run


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, gram) of the blocks' n-grams."""
    for batch in batches:
        for block, raw in zip(batch.column("block").to_pylist(), batch.column("grams").to_pylist(), strict=True):
            names = np.frombuffer(raw, dtype=np.int64)
            for at in range(0, len(names), 100_000):
                part = names[at : at + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), block)), pa.array(part)], names=["block", "gram"])


def perplexities(docs: DataFrame, table: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys, fold, perplexity and held_out of every row of docs (keys, text, fold).

    table is what ``probabilities`` made of docs' n-grams. held_out is the perplexity under the model without the
    row's fold, null for rows without one. docs must give the same rows in the same partitions when read again.
    """
    plain = docs.select(*keys, "fold", F.col("text").alias("_lm_text"))
    empty = plain.limit(0).toArrow().schema
    blocks = plain.mapInArrow(_blocked(empty), "block bigint, texts binary, grams binary").repartition("block")
    answers = blocks.mapInArrow(_asked, "block bigint, gram bigint").join(table.hint("merge"), "gram").select("block", "gram", *MODELS)

    def run(block: pa.Table, found: pa.Table) -> pa.Table:
        names = found.column("gram").to_numpy()
        order = np.argsort(names)
        names, logp = names[order], [found.column(m).to_numpy()[order] for m in MODELS]
        parts = []
        for raw in block.column("texts").to_pylist():
            if not raw:
                continue
            rows = pa.ipc.open_stream(raw).read_all()
            whole, held = [], []
            for text, fold in zip(rows.column("_lm_text").to_pylist(), rows.column("fold").to_pylist(), strict=True):
                n, sums = 0, [0.0, 0.0]
                for name, _, _ in grams(text):
                    at = np.searchsorted(names, name)
                    if len(names) <= at.max(initial=0) or (names[at] != name).any():
                        raise ValueError("a block's texts changed between two readings: give a table that was written")
                    n += len(name)
                    sums[0] += float(logp[0][at].sum())
                    if fold is not None:
                        sums[1] += float(logp[1 + fold][at].sum())
                whole.append(float(np.exp(-sums[0] / n)))
                held.append(None if fold is None else float(np.exp(-sums[1] / n)))
            parts.append(rows.drop_columns(["_lm_text"]).append_column("perplexity", pa.array(whole, pa.float64())).append_column("held_out", pa.array(held, pa.float64())))
        none = pa.schema([*(f for f in empty if f.name != "_lm_text"), ("perplexity", pa.float64()), ("held_out", pa.float64())])
        return pa.concat_tables([p.cast(none) for p in parts]) if parts else none.empty_table()

    fields = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys)
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, f"{fields}, fold int, perplexity double, held_out double")


def quantiles(scored: DataFrame, quantile: float) -> DataFrame:
    """(lang, bound): the quantile of perplexity in scored, by language and, under null, over all.

    Perplexities are counted in bins of their logarithm, so a language of any size is a few thousand rows.
    """
    bins = scored.groupBy("lang", F.ceil(F.log("perplexity") / BIN).alias("bin")).agg(F.count("*").alias("m"))
    both = bins.filter("lang IS NOT NULL").unionByName(bins.groupBy("bin").agg(F.sum("m").alias("m")).withColumn("lang", F.lit(None).cast("string")))
    per = both.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("bin", "m"))).alias("bins"), F.sum("m").alias("total"))
    need = F.ceil(F.col("total") * quantile)
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("bin"))
    step = lambda acc, b: F.struct((acc["seen"] + b["m"]).alias("seen"), F.coalesce(acc["bin"], F.when(acc["seen"] + b["m"] >= need, b["bin"])).alias("bin"))
    found = F.aggregate("bins", start, step, lambda acc: acc["bin"])
    return per.select("lang", F.exp(found * BIN).alias("bound"))


def _flagged(docs: DataFrame, trusted_ids: DataFrame, key: str, lang: str, text: str) -> DataFrame:
    """key, lang, text and fold (null for rows not trusted). docs stay in their partitions where the ids are few."""
    ids = trusted_ids.select(F.col(key).alias("_lm_key")).filter("_lm_key IS NOT NULL").distinct()
    few = fits_broadcast(ids)
    rows = docs.select(F.col(key).alias("key"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    fold = F.when(F.col("_lm_key").isNotNull(), F.crc32(F.coalesce("text", F.lit(""))) % FOLDS).cast("int")
    joined = rows.join(F.broadcast(ids) if few else ids, F.col("key") == F.col("_lm_key"), "left").select("key", "lang", "text", fold.alias("fold"))
    return joined if few else cut(joined, "lm-rows")


def score(docs: DataFrame, trusted_ids: DataFrame, key: str = "doc_id", lang: str = "lang", text: str = "text", quantile: float = QUANTILE) -> DataFrame:
    """key, lang, perplexity, bound and kept of every row of docs. trusted_ids has the keys of trusted rows in column key."""
    rows = _flagged(docs, trusted_ids, key, lang, text)
    table = probabilities(counts(rows))
    scored = cut(perplexities(rows, table, ("key", "lang")), "lm-scores")
    discard(table)
    bounds = cut(quantiles(scored.filter("fold IS NOT NULL").select("lang", F.col("held_out").alias("perplexity")), quantile), "lm-bounds")
    everywhere = next((r["bound"] for r in bounds.filter("lang IS NULL").collect()), None)  # one row at most
    own = broadcast_if_small(bounds.filter("lang IS NOT NULL").withColumnsRenamed({"lang": "_lm_lang", "bound": "_lm_bound"}))
    placed = scored.join(own, F.col("lang") == F.col("_lm_lang"), "left")
    bound = F.coalesce("_lm_bound", F.lit(everywhere).cast("double"))
    kept = F.coalesce(F.ceil(F.log("perplexity") / BIN) <= F.round(F.log(bound) / BIN), F.lit(True))
    return placed.select(F.col("key").alias(key), F.col("lang").alias(lang), "perplexity", bound.alias("bound"), kept.alias("kept"))


def keep_clean(docs: DataFrame, trusted_ids: DataFrame, key: str = "doc_id", **named) -> DataFrame:
    """The rows of docs, with all their columns, whose key is kept; rows with a null key are kept only if all of them are."""
    judged = score(docs, trusted_ids, key, **named)
    rejected = broadcast_if_small(judged.filter(~F.col("kept")).select(F.col(key).alias("_lm_key")).distinct())
    return docs.join(rejected, docs[key].eqNullSafe(F.col("_lm_key")), "left_anti")
