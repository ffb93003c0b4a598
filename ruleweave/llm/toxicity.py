"""Toxicity by a subsequence string-kernel support vector machine with Nystroem landmarks, trained on labelled sentences.

The kernel of two strings counts the subsequences of three symbols they share, each weighted by DECAY for
every symbol skipped within a span of SPAN, and is normalised.  A gap or an inserted character so only
weakens a likeness, and unseen endings of an insulting stem still match.  A sentence is the set of its units: its
words without marks, neighbours of up to BORDER letters joined over their blank ("id iot"), and spelled-out words
("i d i o t").  Most of a toxic sentence is harmless, so each sentence stands in the kernel by one unit that decides
it, as in multiple-instance machines: its margin is the largest of its units'.

Only documents are labelled.  Sentences of a clean document are clean.  A sentence of a toxic document counts as
toxic if it holds a witness, a unit that enough toxic documents use and hardly any clean one; its witness decides it.
The machine is trained on these sentences in the space spanned by LANDMARKS of them.  Then all clean sentences of the
sample are judged, each decided by the unit of its largest margin, and the machine is trained again with those it
mistook most.  Because the kernel's features are explicit, the landmarks' weights collapse into
one table of 64 ** 3 weights, and scoring a unit is a sum of lookups: the model has a fixed size of 1 MB.

Bounds, for fitting alone: SAMPLE_DOCS labelled documents, and of their labelled sentences TOXIC_SENTENCES,
CLEAN_SENTENCES and, in the second round, HARD_SENTENCES. All rows are scored, over their whole texts.

Defined cases: a null or empty text has no sentence and gets the score of a document without any likeness; rows
that repeat are scored one by one; of several labels of a key the largest holds; without labels of both kinds, or
without a witness, every score is 0; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleweave.llm.common import cut, discard, slices

#: Labelled documents used for fitting, chosen by a hash of their id.
SAMPLE_DOCS = 20_000
#: Labelled sentences of the sample that a machine is trained on, chosen by a hash of their words, and the clean ones
#: of the largest margins.
TOXIC_SENTENCES = 4_000
CLEAN_SENTENCES = 10_000
HARD_SENTENCES = 6_000
#: Times that the clean units of the largest margins are found and trained on.
ROUNDS = 2
LANDMARKS = 512
DECAY = 0.6
SPAN = 7
ALPHABET = 64
#: Neighbouring words of up to so many letters are also read as one.
BORDER = 3
#: What a unit without any letter gets, and the largest margins of a document without sentences.
NOTHING = -2.0
#: Raw words a worker remembers, about 40 MB.
CACHED = 250_000
#: Symbols of a word looked at in one piece; longer words are cut into overlapping pieces.
PIECE = 48

_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
_SPELLED = re.compile(r"(?<!\S)\w(?:[ \t]\w){3,}(?!\S)")
_MARKS = re.compile(r"[\W_]+")
_STEPS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]
_DIGITS = str.maketrans("0134579", "oieastg")  # written digits that stand for letters


def sentences(text: str | None) -> list[list[str]]:
    """The raw units of each sentence of a text: words, short neighbours joined, and spelled-out words joined."""
    out = []
    for sentence in _SENTENCE.split((text or "").lower()):
        units = sentence.split()
        if units:
            short = [len(w.rstrip(".,;:!?")) <= BORDER for w in units]
            joined = [units[i] + units[i + 1] for i in range(len(units) - 1) if short[i] and short[i + 1]]
            spelled = [re.sub(r"\s", "", m) for m in _SPELLED.findall(sentence)] if any(len(w) == 1 for w in units) else []
            out.append(units + joined + spelled)
    return out


def plain(word: str) -> str:
    """The word's letters; digits among letters are read as the letters they resemble."""
    bare = _MARKS.sub("", word)
    return bare.translate(_DIGITS) if not bare.isdigit() else ""


def symbols(word: str) -> np.ndarray:
    """Symbols of a plain word between a start and an end mark."""
    points = [ord(c) for c in word]
    return np.array([0, *[p - 96 if 97 <= p <= 122 else 28 + p % (ALPHABET - 28) for p in points], 27], dtype=np.int64)


def pieces(word: str) -> list[str]:
    return [word[i : i + PIECE] for i in range(0, max(1, len(word) - SPAN), PIECE - SPAN)] if len(word) > PIECE else [word]


def _features(coded: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Subsequence numbers and weights of words of one length, a row each; repeats are not yet summed."""
    index, weight, n = [], [], coded.shape[1]
    for a, b in _STEPS:
        if b < n:
            index.append((coded[:, : n - b] * ALPHABET + coded[:, a : n - b + a]) * ALPHABET + coded[:, b:])
            weight.append(np.full(n - b, DECAY ** (b - 2)))
    return np.concatenate(index, axis=1), np.concatenate(weight)


def _norms(index: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Root of each row's kernel with itself: repeated subsequences are summed before squaring."""
    order = np.argsort(index, axis=1)
    sorted_index, sorted_weight = np.take_along_axis(index, order, 1), weight[order]
    fresh = np.ones(index.shape, dtype=bool)
    fresh[:, 1:] = sorted_index[:, 1:] != sorted_index[:, :-1]
    starts = np.flatnonzero(fresh.ravel())
    sums = np.add.reduceat(sorted_weight.ravel(), starts)
    return np.sqrt(np.bincount(starts // index.shape[1], weights=sums * sums, minlength=len(index)))


def by_length(words: list[str]) -> Iterator[tuple[list[int], np.ndarray]]:
    """Numbers of words of one length, and their symbols, a row each; words of no letter are left out."""
    groups: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        if w:
            groups.setdefault(len(w), []).append(i)
    for own in groups.values():
        for at in range(0, len(own), 2048):
            yield own[at : at + 2048], np.stack([symbols(words[i]) for i in own[at : at + 2048]])


def dense(words: list[str]) -> np.ndarray:
    """Normalised features of few words as rows of a matrix over the subsequences they have."""
    rows, cols, vals = [], [], []
    for own, coded in by_length(words):
        index, weight = _features(coded)
        norm = _norms(index, weight)
        rows.append(np.repeat(own, index.shape[1]))
        cols.append(index.ravel())
        vals.append((weight[None, :] / norm[:, None]).ravel())
    return _Sparse(np.concatenate(rows), np.concatenate(cols), np.concatenate(vals), len(words))


@dataclass
class _Sparse:
    rows: np.ndarray
    cols: np.ndarray
    vals: np.ndarray
    n: int

    def kernel(self, other: _Sparse) -> np.ndarray:
        """All kernel values between two lists of words, one of other's words at a time."""
        out = np.zeros((self.n, other.n))
        for j in range(other.n):
            table = other.collapsed(np.eye(1, other.n, j)[0])
            out[:, j] = np.bincount(self.rows, weights=self.vals * table[self.cols], minlength=self.n)
        return out

    def collapsed(self, weights: np.ndarray) -> np.ndarray:
        """The weighted sum of the words' features as one table."""
        used = weights[self.rows] != 0
        return np.bincount(self.cols[used], weights=(self.vals * weights[self.rows])[used], minlength=ALPHABET**3)


# ---- fitting --------------------------------------------------------------------------------------


@dataclass
class Model:
    """The collapsed machine and the logistic fit that turns a document's margins into a score."""

    table: np.ndarray
    bias: float
    logistic: np.ndarray | None = None

    def margins(self, words: list[str]) -> np.ndarray:
        """The machine's margin of each plain word; NOTHING for those without letters."""
        out = np.full(len(words), NOTHING)
        long = [i for i, w in enumerate(words) if len(w) > PIECE]
        short = ["" if len(w) > PIECE else w for w in words]
        for own, coded in by_length(short):
            index, weight = _features(coded)
            out[own] = np.maximum(NOTHING, (self.table[index] @ weight) / _norms(index, weight) + self.bias)
        for i in long:
            out[i] = self.margins(pieces(words[i])).max()
        return out


def _spread(words: list[str], n: int) -> list[str]:
    """n of the words: the first half of them from the list's head, the rest evenly from its tail."""
    head, tail = words[: n // 2], words[n // 2 :]
    return head + tail[:: max(1, -(-len(tail) // (n - n // 2)))]


def fit_machine(positive: list[str], negative: list[str], often: np.ndarray, landmarks: int = LANDMARKS, ridge: float = 1e-4) -> Model:
    """Squared-hinge support vector machine in the landmarks' space, by Newton steps on its active set.

    often: how many documents have each positive word, its weight among the positive ones.
    """
    chosen = _spread(positive, landmarks // 2) + _spread(negative, landmarks // 2)
    marks, data = dense(chosen), dense(positive + negative)
    values, vectors = np.linalg.eigh(marks.kernel(marks))
    keep = values > 1e-6
    root = vectors[:, keep] / np.sqrt(values[keep])
    z = np.hstack([data.kernel(marks) @ root, np.ones((data.n, 1))])
    y = np.r_[np.ones(len(positive)), -np.ones(len(negative))]
    cost = np.r_[often / often.sum(), np.full(len(negative), 1 / len(negative))] * len(y) / 2
    penalty = ridge * len(y) * np.r_[np.ones(z.shape[1] - 1), 1e-3]
    w, active = np.zeros(z.shape[1]), np.ones(len(y), dtype=bool)
    for _ in range(30):
        za = z[active] * cost[active, None]
        w = np.linalg.solve(z[active].T @ za + np.diag(penalty), za.T @ y[active])
        now = y * (z @ w) < 1
        if (now == active).all():
            break
        active = now
    return Model(marks.collapsed(root @ w[:-1]).astype(np.float32), float(w[-1]))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton steps; the last weight is the constant."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = x.T @ (x * (p * (1 - p))[:, None]) + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(hess, x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def document_features(margins: list[float]) -> list[float]:
    """The two largest margins of all units of a document's sentences and the count of positive ones."""
    top = sorted(margins, reverse=True)[:2]
    top += [NOTHING] * (2 - len(top))
    return [*top, float(np.log1p(sum(m > 0 for m in margins)))]


def _plain_units(units: list[str]) -> set[str]:
    return {p for u in set(units) for p in pieces(plain(u)) if p}


def _unit_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Plain units of the partition with the toxic and clean documents that have them."""
    seen: dict[bool, Counter[str]] = {True: Counter(), False: Counter()}
    for batch in slices(batches):
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            seen[bool(toxic)].update(_plain_units([u for units in sentences(text) for u in units]))
    every = list(seen[True].keys() | seen[False].keys())
    for at in range(0, len(every), 50_000):
        part = every[at : at + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([seen[True][w] for w in part], pa.int64()), pa.array([seen[False][w] for w in part], pa.int64())], names=["unit", "n_toxic", "n_clean"])


def _margins_of(model: Model):
    """The margins of the units of all sentences of each text, with a cache of raw units."""
    cache: dict[str, float] = {}

    def run(texts: list[list[list[str]]]) -> list[list[float]]:
        fresh = list({u for t in texts for units in t for u in units if u not in cache})
        if len(cache) + len(fresh) > CACHED:
            cache.clear()
            fresh = list({u for t in texts for units in t for u in units})
        cache.update(zip(fresh, model.margins([plain(u) for u in fresh]).tolist(), strict=True))
        return [[cache[u] for units in t for u in units] for t in texts]

    return run


_SENTENCES = "toxic int, unit string, weight double, margin double"


def _sentence_batch(rows: list[tuple[int, str, float, float]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
    types = (pa.int32(), pa.string(), pa.float64(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=["toxic", "unit", "weight", "margin"])


def _labelled(sample: DataFrame, witnesses: dict[str, int]) -> DataFrame:
    """(toxic, unit, weight, margin): each labelled sentence of sample (text, toxic) by the unit that decides it.

    Witnesses (and the toxic documents that have them, the sentence's weight) decide toxic sentences; clean ones are
    decided by a unit chosen by its hash.
    """
    sent = sample.sparkSession.sparkContext.broadcast(witnesses)  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        known = sent.value
        for batch in slices(batches, 100):
            out = []
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                for s in sentences(text):
                    if toxic:
                        found = sorted(u for u in _plain_units(s) if u in known)
                        if found:
                            unit = max(found, key=known.__getitem__)
                            out.append((1, unit, float(known[unit]), 0.0))
                    else:
                        unit = plain(min(s, key=xxhash.xxh64_intdigest))
                        if unit:
                            out.append((0, pieces(unit)[0], 1.0, 0.0))
            yield _sentence_batch(out)

    return sample.mapInArrow(run, _SENTENCES)


def _judged(units: DataFrame, model: Model) -> DataFrame:
    """As ``_labelled``, of the distinct units of clean documents: each by its piece of the largest margin.

    A sentence is decided by the unit of its largest margin, so the hardest units are those of the hardest sentences; each is
    judged once, however many sentences have it.
    """
    sent = units.sparkSession.sparkContext.broadcast(model)  # 64 ** 3 floats, 1 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 20_000):
            parts = [pieces(u) for u in batch.column("unit").to_pylist()]
            flat = [p for ps in parts for p in ps]
            margins = np.asarray(sent.value.margins(flat), dtype=np.float64) if flat else np.zeros(0)
            out, at = [], 0
            for ps in parts:
                if ps:
                    best = at + int(np.argmax(margins[at : at + len(ps)]))
                    out.append((0, flat[best], 1.0, float(margins[best])))
                at += len(ps)
            yield _sentence_batch(out)

    return units.select("unit").mapInArrow(run, _SENTENCES)


def _chosen(found: DataFrame, toxic: int, n: int, order: list) -> list:
    """n of the sentences of one label; equal deciding units are one example that counts as often."""
    per = found.filter(F.col("toxic") == toxic).groupBy("unit").agg(F.sum("weight").alias("weight"), F.max("margin").alias("margin"))
    return per.orderBy(*order).limit(n).collect()


def _trained(positive: list, negative: list) -> Model | None:
    if not positive or not negative:
        return None
    clean = list(dict.fromkeys(r["unit"] for r in negative))
    return fit_machine([r["unit"] for r in positive], clean, np.sqrt(np.array([r["weight"] for r in positive])))


def _scored(docs: DataFrame, model: Model, keys: tuple[str, ...]) -> DataFrame:
    """keys and the document features f0, f1, f2 of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 64 ** 3 floats, 1 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        margins = _margins_of(sent.value)
        for batch in slices(batches):
            rows = [document_features(m) for m in margins([sentences(t) for t in batch.column("_tox_text").to_pylist()])]
            x = np.array(rows, dtype=np.float64).reshape(-1, 3)
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*kept, *[pa.array(x[:, i]) for i in range(3)]], names=[*batch.schema.names[:-1], "f0", "f1", "f2"])

    fields = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys)
    return docs.select(*keys, F.col("text").alias("_tox_text")).mapInArrow(run, f"{fields}, f0 double, f1 double, f2 double")


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", sample_docs: int = SAMPLE_DOCS) -> Model | None:
    """A model from labelled rows: labels has key and toxic (0 or 1); None without both kinds."""
    held: list[DataFrame] = []
    known = labels.filter(F.col(key).isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col(key).alias("_tox_key")).agg(F.max("toxic").alias("toxic"))
    chosen = F.broadcast(known.orderBy(F.xxhash64("_tox_key"), "_tox_key").limit(sample_docs))  # at most sample_docs rows
    sample = cut(docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(chosen, F.col("key") == F.col("_tox_key")).select("text", "toxic"), "tox-sample", held)
    kinds = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if not kinds.get(1) or not kinds.get(0):
        discard(*held)
        return None
    units = cut(sample.mapInArrow(_unit_counts, "unit string, n_toxic bigint, n_clean bigint").groupBy("unit").agg(F.sum("n_toxic").alias("n_toxic"), F.sum("n_clean").alias("n_clean")), "tox-units", held)
    share = kinds[1] / (kinds[0] + kinds[1])
    by_chance = math.log(max(units.count(), 2)) / -math.log(share)  # of so many units one may be in so many toxic documents only
    least = max(3, int(0.004 * kinds[1]), math.ceil(by_chance))
    witness = (F.col("n_toxic") >= least) & (F.col("n_toxic") * kinds[0] >= 20 * F.col("n_clean") * kinds[1]) & (F.col("n_toxic") >= 3 * F.col("n_clean"))
    witnesses = {r["unit"]: r["n_toxic"] for r in units.filter(witness).collect()}  # each in several of the sampled documents
    by_hash = [F.xxhash64("unit"), "unit"]
    first = cut(_labelled(sample, witnesses), "tox-first", held)
    toxic, clean = _chosen(first, 1, TOXIC_SENTENCES, by_hash), _chosen(first, 0, CLEAN_SENTENCES, by_hash)
    model = _trained(toxic, clean)
    if model is None:
        discard(*held)
        return None
    hard: list = []
    for _ in range(ROUNDS):
        judged = cut(_judged(units.filter("n_clean > 0"), model), "tox-judged", held)
        hard += _chosen(judged, 0, HARD_SENTENCES, [F.desc("margin"), "unit"])
        model = _trained(toxic, hard + clean)
    rows = _scored(sample, model, ("toxic",)).toPandas()  # at most sample_docs rows of four numbers, and their repeats
    model.logistic = fit_logistic(rows[["f0", "f1", "f2"]].to_numpy(), rows["toxic"].to_numpy(np.float64))
    discard(*held)
    return model


def score(docs: DataFrame, model: Model | None, keys: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """keys, score (0 to 1) and predicted of every row of docs."""
    if model is None:
        return docs.select(*keys, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    features = _scored(docs.select(*keys, F.col(text).alias("text")), model, keys)
    total = F.lit(float(model.logistic[-1]))
    for i in range(3):
        total = total + F.col(f"f{i}") * float(model.logistic[i])
    scored = features.select(*keys, (1 / (1 + F.exp(-total))).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
