"""Chat formatting as a prefix tree.

Conversations that share their first turns share those turns' nodes: a node is a turn together with all turns
before it, named by a hash chained along the conversation.  Each node is formatted and tokenized once and
emitted once, depth first.  It carries the position its tokens have in every conversation through it and the
intervals of the emitted stream that its tokens attend to besides their own node: its ancestors'.

Depth-first order is the order of the conversations' paths of node names, a range sort.  In that order a
conversation adds just the turns after what it shares with the one before it, so its row says all that is
needed: shared turns are never gathered by node.  Shards of the sort are linked by a row each (the last path
and the token total of the shard before).  Rows stay in proportion to the turns.

The template marks turns by control strings.  In roles and texts an escape character breaks every control
string, and is doubled where it occurs itself, so reading back is exact.

Defined cases: a null text or role is an empty one; turns are ordered by turn, then role and text, and
repeated turns stay; rows without conv_id are one conversation; an empty table gives empty results; other
columns are not read.  A conversation's turns are put together in one row, as any formatter must, and a
node's row holds its path, so memory and rows grow with the square of a single conversation's turns.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ruleweave.llm.common import cut, slices
from ruleweave.llm.packing import byte_tokenizer

TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>\n"
ESCAPE = "\\"
#: Strings that control this template or common others; none of them survives inside a text.
CONTROL = ("<|", "|>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<s>", "</s>")
TRAINED_ROLE = "assistant"

_PART = re.compile(re.escape(TURN) + "(.*?)" + re.escape(SAYS) + "(.*?)" + re.escape(END), re.DOTALL)


def escape(text: str) -> str:
    text = text.replace(ESCAPE, ESCAPE * 2)
    for c in CONTROL:
        text = text.replace(c, c[0] + ESCAPE + c[1:])
    return text


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def paths(rows: DataFrame) -> DataFrame:
    """conv_id, turns (role and text in order) and nodes (the chained names of the turns) of every conversation."""
    said = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(said)).alias("turns"))

    def chained(turns: Column) -> Column:
        name = lambda last, t: F.substring(F.sha2(F.concat_ws(":", last, F.length(t["role"]).cast("string"), t["role"], t["text"]), 256), 1, 32)
        last = lambda acc: F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(""))
        return F.aggregate(turns, F.array().cast("array<string>"), lambda acc, t: F.concat(acc, F.array(name(last(acc), t))))

    return grouped.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"), chained(F.col("turns")).alias("nodes"))


def _shared(a: list[str], b: list[str]) -> int:
    """How many first nodes two paths share."""
    n = 0
    while n < len(a) and n < len(b) and a[n] == b[n]:
        n += 1
    return n


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted leaves of a shard, with its number, their order in it and what each shares with the one before."""
    shard, order, before = TaskContext.get().partitionId(), 0, []
    for batch in slices(batches):
        shared = []
        for nodes in batch.column("nodes").to_pylist():
            shared.append(_shared(before, nodes))
            before = nodes
        made = [pa.array([shard] * len(shared), pa.int32()), pa.array(range(order, order + len(shared)), pa.int64()), pa.array(shared, pa.int32())]
        order += len(shared)
        yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, "shard", "seq", "shared"])


_TOKENS = pa.schema(
    [("shard", pa.int32()), ("seq", pa.int64()), ("depth", pa.int32()), ("node", pa.string()), ("parent", pa.string()), ("role", pa.string()), ("ids", pa.binary())]
    + [(c, pa.int64()) for c in ("n_tokens", "loss_from", "loss_to", "before")]
)


def _added(leaves: DataFrame, tokenizer: str) -> DataFrame:
    """The turns each leaf adds, tokenized; the loss covers the text of a trained role."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_tokenizer(tokenizer).plain.encode_ordinary
        for batch in slices(batches):
            out = []
            for row in batch.to_pylist():
                before = 0
                for k in range(row["shared"], len(row["nodes"])):
                    role, text = row["turns"][k]["role"], row["turns"][k]["text"]
                    head, body, tail = encode(TURN + escape(role) + SAYS), encode(escape(text)), encode(END)
                    tokens = array("I", [*head, *body, *tail])
                    loss_to = len(head) + (len(body) if role == TRAINED_ROLE else 0)
                    parent = row["nodes"][k - 1] if k else None
                    out.append((row["shard"], row["seq"], k, row["nodes"][k], parent, role, tokens.tobytes(), len(tokens), len(head), loss_to, before))
                    before += len(tokens)
            columns = zip(*out, strict=True) if out else [[]] * len(_TOKENS)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, _TOKENS, strict=True)], schema=_TOKENS)

    more = "n_tokens bigint, loss_from bigint, loss_to bigint, before bigint"
    return leaves.mapInArrow(run, f"shard int, seq bigint, depth int, node string, parent string, role string, ids binary, {more}")


def _attended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Position and ancestor intervals of the turns a leaf adds, from the places of all its turns."""
    span = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
    for batch in slices(batches):
        nodes, starts, positions, attends = [], [], [], []
        for shared, parts in zip(batch.column("shared").to_pylist(), batch.column("parts").to_pylist(), strict=True):
            at, spans = 0, []
            for k, p in enumerate(parts):
                if k >= shared:
                    nodes.append(p["node"])
                    starts.append(p["start"])
                    positions.append(at)
                    attends.append([{"from": a, "to": b} for a, b in spans])
                at += p["n_tokens"]
                if spans and spans[-1][1] == p["start"]:
                    spans[-1] = (spans[-1][0], p["start"] + p["n_tokens"])
                else:
                    spans.append((p["start"], p["start"] + p["n_tokens"]))
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.string()), pa.array(starts, pa.int64()), pa.array(positions, pa.int64()), pa.array(attends, span)], names=["node", "start", "position", "attends"])


def tree(convs: DataFrame, tokenizer: str) -> DataFrame:
    """The emitted nodes of conversations as ``paths`` gives them, one row each.

    node, parent, depth, role, ids (little-endian unsigned 32-bit numbers), n_tokens, loss_from and loss_to
    (token numbers in the node), start (its place in the emitted stream), position (of its first token in a
    conversation) and attends (the stream's intervals of its ancestors).
    """
    leaves = convs.groupBy(F.element_at("nodes", -1).alias("leaf")).agg(F.first("turns").alias("turns"), F.first("nodes").alias("nodes"))
    shards = int(convs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = leaves.repartitionByRange(shards, "nodes").sortWithinPartitions("nodes")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ordered.schema.fields)
    linked = cut(ordered.mapInArrow(_linked, f"{fields}, shard int, seq bigint, shared int"), "chat-leaves")
    ends = linked.groupBy("shard").agg(F.max("nodes").alias("last"))  # a row for each shard
    previous = ends.select("shard", F.lag("last").over(W.orderBy("shard")).alias("last"))
    same = F.transform("nodes", lambda x, i: F.coalesce(x == F.get("last", i), F.lit(False)))
    at_border = F.coalesce(F.array_position(same, F.lit(False)).cast("int") - 1, F.lit(0))
    whole = F.forall(same, lambda x: x)
    shared = F.when((F.col("seq") > 0) | F.col("last").isNull(), F.col("shared")).when(whole, F.size("nodes")).otherwise(at_border)
    placed = linked.join(F.broadcast(previous), "shard").withColumn("shared", shared).drop("last")
    tokens = cut(_added(placed, tokenizer), "chat-tokens")
    per_leaf = tokens.groupBy("shard", "seq").agg(F.sum("n_tokens").alias("n"))
    within = per_leaf.select("shard", "seq", (F.sum("n").over(W.partitionBy("shard").orderBy("seq")) - F.col("n")).alias("leaf_at"))
    totals = per_leaf.groupBy("shard").agg(F.sum("n").alias("n"))
    bases = totals.select("shard", (F.sum("n").over(W.orderBy("shard")) - F.col("n")).alias("base"))
    start = F.col("base") + F.col("leaf_at") + F.col("before")
    sized = tokens.select("node", "shard", "seq", "before", "n_tokens").join(within, ["shard", "seq"]).join(F.broadcast(bases), "shard")
    starts = cut(sized.select("node", start.alias("start"), "n_tokens"), "chat-starts")
    along = placed.select("leaf", "shared", F.posexplode("nodes").alias("k", "node")).join(starts, "node")
    part = F.struct("k", "node", "start", "n_tokens")
    per_path = along.groupBy("leaf").agg(F.first("shared").alias("shared"), F.array_sort(F.collect_list(part)).alias("parts"))
    seen = per_path.mapInArrow(_attended, "node string, start bigint, position bigint, attends array<struct<from:bigint,to:bigint>>")
    return tokens.join(seen, "node").select("node", "parent", "depth", "role", "ids", "n_tokens", "loss_from", "loss_to", "start", "position", "attends")


def read_back(emitted: DataFrame, leaves: DataFrame, tokenizer: str) -> DataFrame:
    """For each of leaves (leaf, nodes): n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars.

    A leaf's conversation is taken from the emitted rows by its path; that they fill the leaf's attention
    intervals and positions without a gap is checked on the way.
    """
    along = leaves.select("leaf", F.posexplode("nodes").alias("k", "node"))
    found = along.join(emitted.select("node", "ids", "n_tokens", "loss_from", "loss_to", "start", "position", "attends"), "node")
    part = F.struct("k", "start", "position", "n_tokens", "loss_from", "loss_to", "ids")
    tip = F.when(F.col("node") == F.col("leaf"), F.struct("attends", "start"))
    whole = found.groupBy("leaf").agg(F.array_sort(F.collect_list(part)).alias("parts"), F.max(tip).alias("tip")).select("leaf", "parts", "tip.attends", F.col("tip.start").alias("leaf_start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = byte_tokenizer(tokenizer).plain.decode
        for batch in slices(batches):
            out = []
            for row in batch.to_pylist():
                formatted, trained, at = "", "", 0
                inside = [(a["from"], a["to"]) for a in row["attends"]]
                for p in row["parts"]:
                    ids = array("I")
                    ids.frombytes(p["ids"])
                    seen = p["start"] == row["leaf_start"] or any(a <= p["start"] and p["start"] + len(ids) <= b for a, b in inside)
                    if not seen or p["position"] != at or len(ids) != p["n_tokens"]:
                        raise ValueError(f"node {row['leaf']}: positions or attention intervals do not fit")
                    at += len(ids)
                    formatted += decode(list(ids))
                    trained += unescape(decode(list(ids[p["loss_from"] : p["loss_to"]])))
                turns = _PART.findall(formatted)
                said = "".join(f"{unescape(r)}\n{unescape(t)}\n" for r, t in turns)
                digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
                out.append({"leaf": row["leaf"], "n_turns": len(turns), "turns_sha256": digest(said), "loss_chars": len(trained), "loss_sha256": digest(trained), "formatted_chars": len(formatted)})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("leaf", pa.string()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]))

    return whole.mapInArrow(run, "leaf string, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
