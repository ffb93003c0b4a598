"""Near-duplicates by the exact Jaccard similarity of word shingle sets.

A text is the set of its SHINGLE_WORDS-word shingles, each a 64-bit hash, in ascending order.  Of two sets whose
similarity is at least SIMILARITY per cent, each has a shingle of the other among its first n - ceil(similarity * n) + 1
in any one order of all shingles, so an equi-join on these prefixes misses no pair.  Every candidate pair is then
confirmed by the size of the intersection; nothing is estimated.

Shingles that many prefixes share (a license line, a copied passage) would make a join emit all pairs of a group.
They are put last in the order, so they stay in the prefix only of a set that has little else.  Keys that are crowded
even then, mostly large groups of near copies, first tie each member to a central one.  Members that are not
similar to it may be similar to others of the key, but only to those whose sizes and sketches are close enough, which is
tested where the two would meet, so that other pairs are never rows.

Sets are distinct before any pairing: copies cost one row.  Only prefixes are written and shuffled; whole sets are made
again from the texts of candidates.  Candidates first have to pass bounds that lose no pair: their sizes, and sketches, in which
each shingle flips one bit, so that two differ in no more bits than the sets in shingles.  SKETCH bits tell nothing of sets of
some thousand shingles, whose bits are half set whatever they hold, so a larger set has a wide sketch too, of a bit or more a shingle.

Sets that are known to be connected (by SimHash, see ``simhash.set_classes``) take part, but pairs of them are not looked at again.

Defined cases: words are those of ``simhash``; a null or empty text has the empty set, similar only to itself; fewer
than SHINGLE_WORDS words make one shingle; repeats of a shingle count once; keys may be null and travel along; an empty table gives
empty results; columns other than keys and text aren't read, and keys may have any names but those this module gives.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleweave.llm.common import broadcast_if_small, cut, discard, hot_sizes, join_hot, let, slices

SHINGLE_WORDS = 5
#: Per cent.
SIMILARITY = 80
#: A key shared by more sets than this ties its members to a central one first.
PAIRED_GROUP = 8
#: A shingle in more prefixes than this is put last in the order.
COMMON = 32
#: Common shingles put last in the order, 8 bytes each in every Python worker. Any choice of them gives the same links.
LAST_SHINGLES = 500_000
#: Bits of a sketch.
SKETCH = 1024
SEED = 42
#: Sets of a bucket in which pairs are confirmed; of a thousand words each they take 8 MB. Fewer a bucket send partners to more buckets.
BUCKET = 1_000


def shingles(text: str | None, shingle: int = SHINGLE_WORDS) -> np.ndarray:
    """The distinct shingles of a text as signed longs, in ascending order."""
    found = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z and ASCII white space only
    if not found:
        return np.zeros(0, np.int64)
    if len(found) <= shingle:
        grams = [b" ".join(found)]
    else:
        grams = map(b" ".join, zip(*(found[i:] for i in range(shingle)), strict=False))
    return np.unique(np.array([xxhash.xxh64_intdigest(g, SEED) for g in grams], dtype=np.uint64).view(np.int64))


def prefix(n: int, similarity: int) -> int:
    """Shingles in the prefix of a set of n: n - ceil(similarity * n / 100) + 1; none of the empty set."""
    return n - (n * similarity + 99) // 100 + 1 if n else 0


def with_set(docs: DataFrame, keys: tuple[str, ...], text: str, most: Callable[[int], int] = int, last: np.ndarray | None = None) -> DataFrame:
    """keys, grams, n (the size of the shingle set), sketch, wide and fp, the hash that names the set.

    grams has the first most(n) shingles of the set, all of them by default; shingles in last (ascending) come behind
    all others. wide is a sketch of n bits, up to the next power of 2, and empty where SKETCH bits are as many.
    """
    behind = None if last is None else docs.sparkSession.sparkContext.broadcast(last)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            firsts, sizes, named, flipped, wide = [], [], [], [], []
            for t in batch.column("_text").to_pylist():
                own = shingles(t)
                sizes.append(len(own))
                flipped.append((np.bincount(own & (SKETCH - 1), minlength=SKETCH) & 1).astype(bool))
                bits = 1 << (len(own) - 1).bit_length() if len(own) > SKETCH else 0
                wide.append(np.packbits((np.bincount(own & (bits - 1), minlength=bits) & 1).astype(bool), bitorder="little").view(np.int64) if bits else own[:0])
                named.append(xxhash.xxh64_intdigest(own.tobytes(), SEED))
                if behind is not None:
                    common = np.isin(own, behind.value, assume_unique=True)
                    own = np.concatenate([own[~common], own[common]])
                firsts.append(own[: most(len(own))])
            lists = lambda rows: pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]).astype(np.int32)), pa.array(np.concatenate([np.zeros(0, np.int64), *rows])))
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            bits = np.packbits(np.array(flipped, bool).reshape(-1, SKETCH), axis=1, bitorder="little").view(np.int64)
            sketch = pa.ListArray.from_arrays(pa.array((np.arange(len(sizes) + 1) * (SKETCH // 64)).astype(np.int32)), pa.array(bits.ravel()))
            made = [lists(firsts), pa.array(sizes, pa.int32()), sketch, lists(wide), pa.array(np.array(named, dtype=np.uint64).view(np.int64))]
            yield pa.RecordBatch.from_arrays([*kept, *made], names=[*batch.schema.names[:-1], "grams", "n", "sketch", "wide", "fp"])

    fields = "".join(f"`{k}` {docs.schema[k].dataType.simpleString()}, " for k in keys)
    return docs.select(*keys, F.col(text).alias("_text")).mapInArrow(run, f"{fields}grams array<bigint>, n int, sketch array<bigint>, wide array<bigint>, fp bigint")


def _shared(sets: DataFrame, held: list) -> DataFrame:
    """(key, fp, n, m) of every key of sets (fp, n, grams) that m > 1 of them have."""
    rows = sets.select("fp", "n", F.explode("grams").alias("key"))
    sizes = cut(rows.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1"), "sets-sizes", held)
    return cut(join_hot(rows, sizes, "key", hot=hot_sizes(sizes, "key", "m")), "sets-shared", held)


def sketched(rows: DataFrame, ties: DataFrame | None = None) -> DataFrame:
    """(fp, n, sketch, wide, tie) of each distinct set; tie is the component that ties (node, component) gives it, if any."""
    sets = rows.select("fp", "n", "sketch", "wide").dropDuplicates(["fp"])
    if ties is None:
        return sets.withColumn("tie", F.lit(None).cast("long"))
    return sets.join(broadcast_if_small(ties.select(F.col("node").alias("fp"), F.col("component").alias("tie"))), "fp", "left")


def links(rows: DataFrame, texts: Callable[[DataFrame], DataFrame], similarity: int = SIMILARITY, ties: DataFrame | None = None) -> DataFrame:
    """Edges (a, b) between distinct sets that connect all pairs similar enough.

    rows has fp, n and, as grams, the prefix of every text's set; texts gives the texts, in a column text, of at least
    the rows with an fp in a table of them. Edges of paired keys are all such pairs; edges of crowded keys have the
    same components. ties (node, component) names sets that similar pairs are known to connect; an edge inside such a component
    may be no similar pair.
    """
    held: list[DataFrame] = []
    sets = cut(rows.select("fp", "n", "grams").dropDuplicates(["fp"]), "sets-distinct", held)
    sketches = cut(sketched(rows, ties), "sets-sketches", held)
    shared = _shared(sets, held)
    common = shared.filter(F.col("m") > COMMON).groupBy("key").agg(F.max("m").alias("m")).orderBy(F.desc("m"), "key").limit(LAST_SHINGLES).select("key").toPandas()
    if len(common):
        last = np.sort(common["key"].to_numpy(np.int64))
        touched = broadcast_if_small(cut(shared.filter(F.col("m") > COMMON).select("fp").distinct(), "sets-touched", held))
        again = with_set(texts(touched), (), "text", lambda n: prefix(n, similarity), last).join(touched, "fp", "left_semi")
        again = cut(again.dropDuplicates(["fp"]).select("fp", "n", "grams"), "sets-again", held)
        shared = _shared(sets.join(touched, "fp", "left_anti").unionByName(again), held)
    near = _near_sizes(similarity)
    ends = lambda rows, end, *more: rows.select("key", F.col("fp").alias(end), F.col("n").alias(f"n_{end}"), *more)
    paired = shared.filter(F.col("m") <= PAIRED_GROUP)
    pairs = ends(paired, "a").join(ends(paired, "b"), "key").filter("a < b").filter(near).select("a", "b")
    found = confirmed(pairs, sketches, texts, similarity)
    crowded = shared.filter(F.col("m") > PAIRED_GROUP).select("key", "fp", "n")
    if not crowded.limit(1).count():
        discard(*held)
        return found
    stars, placed, alone = _stars(crowded, sketches, texts, similarity, held)
    lone, members = _together(placed, alone, held)
    told = lambda rows, e: rows.join(sketches.select("fp", "sketch", "wide"), "fp").select("group", F.col("fp").alias(e), F.col("n").alias(f"n_{e}"), F.col("sketch").alias(f"of_{e}"), F.col("wide").alias(f"wide_{e}"))
    lone, members = told(lone, "b"), told(members, "a")
    meet = (lone["group"] == members["group"]) & near & (F.col("a") != F.col("b")) & _few_bits(similarity) & _few_wide(similarity)
    rest = lone.join(members, meet).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = confirmed(rest, sketches, texts, similarity)
    discard(*held)
    return found.unionByName(stars).unionByName(rest).distinct()


def _stars(crowded: DataFrame, sketches: DataFrame, texts: Callable[[DataFrame], DataFrame], similarity: int, held: list) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links of crowded keys' members to their key's hub; the rows of crowded (key, fp, n) with it; and those that have no link.

    Of a text and its copies, each with changes of its own, the text they were made from is similar to most, and two copies
    differ twice as much. Its prefix holds no change of its own. So two members of a key are tried as its hub, that with most
    crowded keys and that of whose prefix they are the largest share, and the one stays that has more links.
    """
    share = F.count("*") / F.greatest(F.first("n") - F.ceil(F.first("n") * similarity / 100) + 1, F.lit(1))
    weighed = crowded.join(cut(crowded.groupBy("fp").agg(share.alias("share"), F.count("*").alias("many")), "sets-weights", held), "fp")
    hubs = weighed.groupBy("key").agg(F.min(F.struct(-F.col("many"), F.col("fp")))["fp"].alias("wide"), F.min(F.struct(-F.col("share"), -F.col("many"), F.col("fp")))["fp"].alias("pure"), F.count("*").alias("m"))
    hubs = cut(hubs, "sets-hubs", held)
    hot = hot_sizes(hubs, "key", "m")
    tried = join_hot(crowded, hubs.select("key", "wide", "pure"), "key", hot=hot)
    tried = cut(tried.select("key", "fp", "n", F.explode(F.array_distinct(F.array("wide", "pure"))).alias("hub")), "sets-tried", held)
    stars = confirmed(tried.filter("fp <> hub").select(F.col("hub").alias("a"), F.col("fp").alias("b")), sketches, texts, similarity)
    tied = broadcast_if_small(stars.select(F.col("a").alias("hub"), F.col("b").alias("fp"), F.lit(True).alias("tied")))
    judged = cut(tried.join(tied, ["hub", "fp"], "left"), "sets-judged", held)
    won = judged.groupBy("key", "hub").agg(F.count("tied").alias("links")).groupBy("key").agg(F.max(F.struct("links", "hub"))["hub"].alias("won"))
    placed = join_hot(judged, cut(won, "sets-won", held), "key", hot=hot).filter("hub = won").drop("won")
    return stars, placed, placed.filter("tied IS NULL AND fp <> hub")


def _together(placed: DataFrame, alone: DataFrame, held: list) -> tuple[DataFrame, DataFrame]:
    """(group, fp, n) of the rows without a link and of all members they may be similar to.

    A group is a key, or all keys of one hub where that makes fewer pairs: copies of one text share many keys, and
    would meet in each.
    """
    alone = cut(alone.select("hub", "key", "fp", "n"), "sets-alone", held)
    members = cut(placed.join(broadcast_if_small(alone.select("key").distinct()), "key", "left_semi").select("hub", "key", "fp", "n"), "sets-members", held)
    sizes = lambda rows, name: rows.groupBy("hub", "key").agg(F.count("*").alias(name))
    by_key = sizes(alone, "x").join(sizes(members, "y"), ["hub", "key"]).groupBy("hub").agg(F.sum(F.col("x") * F.col("y")).alias("by_key"))
    distinct = lambda rows, name: rows.select("hub", "fp").distinct().groupBy("hub").agg(F.count("*").alias(name))
    by_hub = distinct(alone, "x").join(distinct(members, "y"), "hub").select("hub", (F.col("x") * F.col("y")).alias("by_hub"))
    whole = broadcast_if_small(cut(by_key.join(by_hub, "hub").select("hub", (F.col("by_hub") < F.col("by_key")).alias("whole")), "sets-wholes", held))
    group = F.when(F.col("whole"), F.struct(F.col("hub").alias("name"), F.lit(True).alias("whole"))).otherwise(F.struct(F.col("key").alias("name"), F.lit(False).alias("whole")))
    grouped = lambda rows: rows.join(whole, "hub").select(group.alias("group"), "fp", "n").distinct()
    return grouped(alone), grouped(members)


def _near_sizes(similarity: int) -> Column:
    return (F.col("n_a") * 100 >= F.col("n_b") * similarity) & (F.col("n_b") * 100 >= F.col("n_a") * similarity)


def _few_wide(similarity: int) -> Column:
    """As ``_few_bits`` of the sketches wide_a and wide_b; true where a set has none. A sketch of twice the bits is folded onto the other."""
    words = F.least(F.size("wide_a"), F.size("wide_b"))
    longer = F.greatest(F.size("wide_a"), F.size("wide_b"))
    folded = lambda c: F.when(F.size(c) > words, F.zip_with(F.slice(c, F.lit(1), words), F.slice(c, words + 1, words), lambda x, y: x.bitwiseXOR(y))).otherwise(F.col(c))
    differing = F.aggregate(F.zip_with(folded("wide_a"), folded("wide_b"), lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("long")), F.lit(0).cast("long"), lambda n, x: n + x)
    return F.when((words == 0) | (longer > words * 2), True).otherwise(differing * (100 + similarity) <= (F.col("n_a") + F.col("n_b")) * (100 - similarity))


def _few_bits(similarity: int) -> Column:
    """Whether the sketches of_a and of_b differ in no more bits than similar sets differ in shingles, in a few machine words."""
    differing = sum((F.bit_count(F.get("of_a", F.lit(i)).bitwiseXOR(F.get("of_b", F.lit(i)))) for i in range(SKETCH // 64)), F.lit(0))
    return differing * (100 + similarity) <= (F.col("n_a") + F.col("n_b")) * (100 - similarity)


def _within(similarity: int) -> Column:
    """Whether the sketches of_a and of_b can belong to similar sets, by pigeonring and then by all their bits.

    Sets similar enough differ in no more shingles than the budget. Then on the ring of sketch segments there is a
    start from which every chain of 1, 2, ... segments holds at most its share of the budget.
    """
    ring = SKETCH // 64
    budget = (F.col("n_a") + F.col("n_b")) * (100 - similarity) / (100 + similarity)
    differing = F.zip_with("of_a", "of_b", lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("long"))

    def chained(d: Column) -> Column:
        twice = F.concat(d, d)
        start = F.struct(F.lit(0).cast("long").alias("spent"), F.lit(0).alias("k"), F.lit(True).alias("keeps"))
        step = lambda acc, x: F.struct((acc["spent"] + x).alias("spent"), (acc["k"] + 1).alias("k"), (acc["keeps"] & ((acc["spent"] + x) * ring <= (acc["k"] + 1) * budget)).alias("keeps"))
        begun = lambda s: F.aggregate(F.slice(twice, s, ring), start, step, lambda acc: acc["keeps"])
        return F.exists(F.sequence(F.lit(1), F.lit(ring)), begun) & (F.aggregate(d, F.lit(0).cast("long"), lambda n, x: n + x) <= budget)

    return let(differing, chained)


def confirmed(pairs: DataFrame, sketches: DataFrame, texts: Callable[[DataFrame], DataFrame], similarity: int) -> DataFrame:
    """The pairs (a, b) of pairs that are similar enough, and those of them that have a tie in common, which need no look at their sets.

    Pairs are dealt to buckets by b. A set goes to each bucket that needs it once, however many pairs it has there, and
    a bucket has about BUCKET sets of its own. Only sets of pairs that all bounds let through are moved.
    """
    of = lambda end: sketches.select(F.col("fp").alias(end), F.col("n").alias(f"n_{end}"), F.col("sketch").alias(f"of_{end}"), F.col("tie").alias(f"tie_{end}"))
    wide = lambda end: sketches.filter(F.size("wide") > 0).select(F.col("fp").alias(end), F.col("wide").alias(f"wide_{end}"))
    held: list[DataFrame] = []
    tied = F.coalesce(F.col("tie_a") == F.col("tie_b"), F.lit(False))
    met = join_hot(cut(pairs.distinct(), "sets-candidates", held), of("a"), "a").join(of("b"), "b")
    near = cut(met.filter(tied | (_near_sizes(similarity) & _within(similarity))).select("a", "b", "n_a", "n_b", tied.alias("tied")), "sets-near", held)
    sure = cut(near.filter("tied").select("a", "b"), "sets-sure")
    large = F.least("n_a", "n_b") > SKETCH
    few = join_hot(near.filter(~F.col("tied") & large), wide("a"), "a").join(wide("b"), "b").filter(_few_wide(similarity))
    pairs = cut(near.filter(~F.col("tied") & ~large).select("a", "b").unionByName(few.select("a", "b")), "sets-pairs")
    discard(*held)
    held = [pairs]
    ends = cut(pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct(), "sets-ends", held)
    buckets = max(1, -(-ends.count() // BUCKET))
    dealt = pairs.withColumn("bucket", F.pmod(F.xxhash64("b"), F.lit(buckets)))
    need = dealt.select("bucket", F.explode(F.array("a", "b")).alias("fp")).distinct()
    whole = with_set(texts(broadcast_if_small(ends)), (), "text").select("fp", "grams")
    placed = whole.join(broadcast_if_small(cut(need, "sets-need", held)), "fp")

    def run(own: pa.Table, sets: pa.Table) -> pa.Table:
        grams = sets.column("grams").chunks  # as they came, so that a bucket's sets are there once
        at = {fp: (c, i) for c, chunk in enumerate(sets.column("fp").chunks) for i, fp in enumerate(chunk.to_pylist())}  # repeats of a set are equal
        of_set = lambda fp: grams[at[fp][0]][at[fp][1]].values.to_numpy()
        keep = []
        for a, b in zip(own.column("a").to_pylist(), own.column("b").to_pylist(), strict=True):
            x, y = of_set(a), of_set(b)
            keep.append(len(np.intersect1d(x, y, assume_unique=True)) * (100 + similarity) >= (len(x) + len(y)) * similarity)
        return own.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    found = dealt.groupBy("bucket").cogroup(placed.groupBy("bucket")).applyInArrow(run, "a bigint, b bigint")
    found = cut(found, "sets-links")
    discard(*held)
    return found.unionByName(sure)
