"""SimHash near-duplicates with pigeonring filtering.

A fingerprint is cut into m equal segments that lie on a ring.  If two fingerprints differ in at
most t bits, then on the ring there is a start from which every chain of 1, 2, ... segments holds at
most its share of the budget, chain * t / m bits of difference.  With t = 2 and 8 segments the
first three segments of such a chain must be equal, so candidates come from an equi-join on (start,
three segments); the longer chains are then checked one after the other, and only survivors reach the
full Hamming check.  The more fingerprints there are, the more and narrower the segments: from 24 equal bits
with 8 segments to 31 with 64, so that chance keys stay small.

Keys that many fingerprints share would make a join emit all pairs of a group.  Fingerprints that have
such a key take an exact way that stays linear: two fingerprints differ in at most two bits just when
they share a fingerprint at one bit or less from both, so each names itself and its 64 neighbours, and
all that name the same value are tied to the smallest of them.

Fingerprints are distinct before any pairing: exact copies and equal fingerprints cost one row.

Defined cases: a null or empty text has no shingle and fingerprint zero, linked like any other; one or
two words make one shingle; rows that repeat (also with equal or null ids) each get a row, and a null
id is never chosen as a component's name unless the component has no other; an empty table gives an
empty result; other columns of the input are carried by ``keep_first`` only, under their own names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleweave.llm import shingle_sets
from ruleweave.llm.common import broadcast_if_small, cut, discard, hot_sizes, hot_values, join_hot, slices

BITS = 64
THRESHOLD = 2
SHINGLE_WORDS = 3
#: Numbers of segments to choose from.
SEGMENTS = (8, 16, 32, 64)
#: A key shared by more fingerprints than this takes the linear way instead of pairs.
PAIRED_GROUP = 32
SEED = 42


def fingerprint(text: str | None, shingle: int = SHINGLE_WORDS) -> int:
    """Unsigned 64-bit SimHash of a text's word shingles, repeats included; 0 without words."""
    found = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z and ASCII white space only
    if not found:
        return 0
    if len(found) <= shingle:
        grams = [b" ".join(found)]
    else:
        grams = map(b" ".join, zip(*(found[i:] for i in range(shingle)), strict=False))
    hashes = np.array([xxhash.xxh64_intdigest(g, SEED) for g in grams], dtype=np.uint64)
    ones = np.zeros(BITS, dtype=np.int64)
    for start in range(0, len(hashes), 4096):
        block = hashes[start : start + 4096].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        codes = np.array([fingerprint(t) for t in batch.column("_text").to_pylist()], dtype=np.uint64).view(np.int64)
        kept = [batch.column(i) for i in range(batch.num_columns - 1)]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(codes)], names=[*batch.schema.names[:-1], "fp"])


def with_fingerprint(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """keys and fp, the fingerprint's 64 bits as a signed long."""
    fields = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys)
    return docs.select(*keys, F.col(text).alias("_text")).mapInArrow(_fingerprints, f"{fields}, fp bigint")


def equal_chain(threshold: int, segments: int) -> int:
    """Segments at a chain's start that must be equal: chain * threshold / segments is below 1."""
    return max(1, (segments - 1) // threshold)


def segments_for(n: int, threshold: int = THRESHOLD) -> int:
    """The fewest segments whose equal chains have as many values as there are fingerprints, else the most there are."""
    return next((m for m in SEGMENTS if n <= 1 << (equal_chain(threshold, m) * BITS // m)), SEGMENTS[-1])


def _from(fp: Column, start: Column, segments: int) -> Column:
    """The fingerprint turned so that the start's segment is its lowest."""
    by = start.cast("int") * (BITS // segments)
    return F.call_function("shiftrightunsigned", fp, by).bitwiseOR(F.when(by == 0, F.lit(0)).otherwise(F.call_function("shiftleft", fp, BITS - by)))


def _low(value: Column, bits: int) -> Column:
    return value if bits >= BITS else value.bitwiseAND(F.lit((1 << bits) - 1))


def _keys(fp: Column, threshold: int, segments: int) -> Column:
    """For each start, it and the segments of the equal chain from it, in one long."""
    bits = equal_chain(threshold, segments) * BITS // segments
    return F.transform(F.sequence(F.lit(0), F.lit(segments - 1)), lambda s: F.shiftleft(s.cast("long"), bits).bitwiseOR(_low(_from(fp, s, segments), bits)))


def _within_budgets(a: Column, b: Column, start: Column, threshold: int, segments: int) -> Column:
    """Whether all chains from start keep their proportional budgets."""
    turned = _from(a.bitwiseXOR(b), start, segments)
    keeps = F.lit(True)
    for length in range(equal_chain(threshold, segments) + 1, segments + 1):
        keeps = keeps & (F.bit_count(_low(turned, length * BITS // segments)) * segments <= length * threshold)
    return keeps


def links(codes: DataFrame, threshold: int = THRESHOLD, segments: int | None = None) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that connect all pairs at most threshold bits apart.

    codes holds each fingerprint once, in column fp. Edges of the paired keys are all such pairs; edges
    of crowded keys form stars with the same components. Stars need threshold 2, the production value.
    """
    if threshold != THRESHOLD:
        raise ValueError("the linear way beside the pairs is exact for a threshold of 2")
    segments = segments or segments_for(codes.count(), threshold)
    keyed = codes.select("fp", F.posexplode(_keys(F.col("fp"), threshold, segments)).alias("start", "key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("fp")).filter("n > 1")
    sizes = cut(sizes.select("key", "n"), "simhash-keys")
    hot = hot_sizes(sizes, "key", "n")
    paired = join_hot(keyed, sizes.filter(F.col("n") <= PAIRED_GROUP).select("key"), "key", hot=hot)
    left, right = paired.select("key", "start", F.col("fp").alias("a")), paired.select("key", F.col("fp").alias("b"))
    candidates = left.join(right, "key").filter("a < b").filter(_within_budgets(F.col("a"), F.col("b"), F.col("start"), threshold, segments))
    pairs = candidates.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= threshold).select("a", "b")
    crowded = join_hot(keyed, sizes.filter(F.col("n") > PAIRED_GROUP).select("key"), "key", hot=hot).select("fp").distinct()
    return pairs.unionByName(_stars(crowded)).distinct()


def _stars(codes: DataFrame) -> DataFrame:
    around = [F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63)).cast("long")) for i in range(BITS)]]
    named = codes.select("fp", F.explode(F.array(*around)).alias("value"))
    hubs = named.groupBy("value").agg(F.min("fp").alias("a"), F.count("*").alias("n")).filter("n > 1").select("value", "a")
    return named.join(hubs, "value").filter("fp <> a").select("a", F.col("fp").alias("b"))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node each node of edges (a, b) can reach.

    Each round every node takes the smallest name among its neighbours' and then the name its new name
    has itself, so chains shrink by doubling. Rounds are written to the shared folder; it stops when no
    name changes, and fails rather than return an unfinished result.
    """
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "components-edges")
    crowded = hot_values(both, "b")
    names = cut(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("component")), "components")
    for _ in range(max_rounds):
        near = join_hot(both, names.select(F.col("node").alias("b"), "component"), "b", hot=crowded).groupBy("a").agg(F.min("component").alias("near"))
        taken = names.join(near, names["node"] == near["a"], "left").select("node", "component", F.least("component", "near").alias("new"))
        taken = cut(taken, "components-taken")
        jump = names.select(F.col("node").alias("new"), F.col("component").alias("far"))
        stepped = join_hot(taken, jump, "new", "left").select("node", F.col("component").alias("old"), F.least("new", "far").alias("component"))
        stepped = cut(stepped, "components")
        done = not stepped.filter("component <> old").limit(1).count()
        discard(names, taken)
        if done:
            discard(both)
            return stepped.select("node", "component")
        names = stepped.select("node", "component")
        names._cut_path = stepped._cut_path
    raise RuntimeError("components did not settle")


def near_duplicates(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """keys, fp and component_id, the smallest first key reachable over links, of every row of docs."""
    rows = cut(with_fingerprint(docs, keys, text), "simhash-fp")
    return join_hot(rows, cut(classes(rows, keys[0]).drop("component"), "simhash-classes"), "fp")


def classes(rows: DataFrame, key: str) -> DataFrame:
    """(fp, component, component_id) of the fingerprints in rows; component is the group's smallest fingerprint."""
    codes = cut(rows.groupBy("fp").agg(F.min(key).alias("first")), "simhash-codes")
    return _placed(codes, components(links(codes.select("fp"))))


def fingerprint_pairs(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets in rows (fp, code) that tie all whose fingerprints, in code, are at most THRESHOLD bits apart.

    Sets of one fingerprint are tied to the first of them, and first ones by the links of their fingerprints.
    """
    coded = cut(rows.groupBy("fp").agg(F.min("code").alias("code")), "simhash-coded")
    firsts = cut(coded.groupBy("code").agg(F.min("fp").alias("first")), "simhash-firsts")
    same = join_hot(coded, firsts, "code").filter("fp <> first").select(F.col("first").alias("a"), F.col("fp").alias("b"))
    named = lambda end: firsts.select(F.col("code").alias(f"code_{end}"), F.col("first").alias(end))
    linked = cut(links(firsts.select(F.col("code").alias("fp"))).toDF("code_a", "code_b"), "simhash-linked")
    near = join_hot(linked, named("a"), "code_a").join(named("b"), "code_b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return same.unionByName(near)


def set_classes(docs: DataFrame, rows: DataFrame, key: str, text: str, similarity: int) -> DataFrame:
    """As ``classes``, of rows of ``shingle_sets.with_set`` over docs and, in code, their fingerprints: linked are sets whose similarity is so many per cent.

    Pairs that the fingerprints link come first, each confirmed by its sets. They leave out near copies whose fingerprints differ in more
    bits; these are found by the sets' prefixes, where what fingerprints have connected is not looked at again.
    """

    codes = cut(rows.groupBy("fp").agg(F.min(key).alias("first")), "simhash-codes")

    def texts(sets: DataFrame) -> DataFrame:
        """One text of each set, and those of other rows that have its key."""
        wanted = cut(codes.join(sets, "fp", "left_semi").select(F.col("first").alias("_nd_key")).distinct(), "simhash-wanted")
        return docs.join(broadcast_if_small(wanted), docs[key].eqNullSafe(F.col("_nd_key")), "left_semi").select(F.col(text).alias("text"))

    linked = shingle_sets.confirmed(fingerprint_pairs(rows), shingle_sets.sketched(rows), texts, similarity)
    edges = shingle_sets.links(rows, texts, similarity, components(linked))
    return _placed(codes, components(edges.unionByName(linked)))


def _placed(codes: DataFrame, named: DataFrame) -> DataFrame:
    placed = codes.join(named.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    placed = cut(placed, "simhash-placed")
    least = cut(placed.groupBy("component").agg(F.min("first").alias("component_id")), "simhash-least")
    return join_hot(placed, least, "component").select("fp", "component", "component_id")


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: int | None = None) -> DataFrame:
    """The rows of docs with all their columns, one of each near-duplicate group: the one with the smallest key.

    Groups are connected by fingerprints at most THRESHOLD bits apart or, where similarity is given, by texts whose
    five-word shingle sets have a Jaccard similarity of at least so many per cent, found exactly: by fingerprints first, and by
    prefixes of the sets where fingerprints miss a pair.

    Rows go by their key, so texts stay where they are unless many rows go. Keys that several rows share are
    told apart by fingerprint again; of rows with one key in one group any one stays.
    """
    if similarity is None:
        rows = cut(with_fingerprint(docs, (key,), text), "simhash-fp")
        named = cut(classes(rows, key), "simhash-classes")
    else:
        coded = with_fingerprint(docs.select(F.col(key).alias("_nd_key"), F.col(text).alias("_nd_text")), ("_nd_key", "_nd_text"), "_nd_text").withColumnRenamed("fp", "code")
        rows = shingle_sets.with_set(coded, ("_nd_key", "code"), "_nd_text", lambda n: shingle_sets.prefix(n, similarity))
        rows = cut(rows.withColumnRenamed("_nd_key", key), "simhash-sets")
        named = cut(set_classes(docs, rows, key, text, similarity), "simhash-classes")
        rows = rows.select(key, "fp")
    judged = join_hot(rows, named, "fp").select(F.col(key).alias("_nd_key"), (~F.col(key).eqNullSafe(F.col("component_id"))).alias("loses"))
    per_key = cut(judged.groupBy("_nd_key").agg(F.count("*").alias("n"), F.max("loses").alias("loses")).filter("n > 1 OR loses"), "simhash-keys")
    same = docs[key].eqNullSafe(F.col("_nd_key"))
    plain = docs.join(broadcast_if_small(per_key.select("_nd_key")), same, "left_anti")
    shared = per_key.filter("n > 1").select("_nd_key")
    if not shared.limit(1).count():
        return plain
    again = docs.join(broadcast_if_small(shared), same, "left_semi")
    again = with_fingerprint(again, tuple(docs.columns), text) if similarity is None else _set_named(again, tuple(docs.columns), text)
    again = again.toDF(*docs.columns, "_nd_fp_")
    named = named.toDF("_nd_fp", "_nd_component", "_nd_id")
    firsts = again.join(named, again["_nd_fp_"] == named["_nd_fp"]).filter(F.col(key).eqNullSafe(F.col("_nd_id")))
    one = firsts.groupBy("_nd_component").agg(F.min_by(F.struct(*docs.columns), "_nd_fp").alias("_nd_row")).select("_nd_row.*")
    return plain.unionByName(one)


def _set_named(docs: DataFrame, keys: tuple[str, ...], text: str) -> DataFrame:
    """keys and the name of the row's shingle set."""
    named = docs.toDF(*[f"_nd_{i}" for i in range(len(keys))])
    found = shingle_sets.with_set(named, tuple(named.columns), named.columns[keys.index(text)], lambda n: 0)
    return found.drop("grams", "n", "sketch", "wide")
