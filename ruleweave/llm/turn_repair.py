"""Repair of conversation structure by a bidirectional shortest path over the edit lattice.

A conversation has to read as an optional system turn and then user and assistant turns by turns, or be empty. Edits go
over its rows in order: Keep (0), Rerole to user or assistant (1), Delete (2, the only edit of a blank or repeated row)
and Insert of an empty user or assistant turn anywhere (5); a truncated row that isn't deleted adds 5. The lattice has a
node for each number of rows gone through and each of the four states of the reading so far. A forward heap from the
start and a reverse heap from the ends settle nodes until their least costs together exceed the best meeting, so that
all crossings of that cost are finished; of these the least audit (the edits' initials in order) is taken. Labels are
settled by (cost, rows gone through, audit), in which each edit only grows, so a settled audit is the least of its cost.

Rows come in order from Spark's sort, and a worker keeps BLOCK of them and four readings (cost, audit and what the
repaired rows make so far): a longer conversation is crossed block by block, by the same search between each two states,
and the best reading that ends in each state goes on. Two audits of one cost to one state never are one the other's
beginning, so this is exact.

Defined cases: a null role or text is one space; rows go by turn, nulls first, then by role and text where turns are equal;
a null conversation id is one conversation; other columns, whatever their names, are not read; an empty table gives
an empty result; very long texts pass through as they are.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ruleweave.llm.common import ROWS_AT_ONCE, slices

#: Rows of a conversation that a worker holds at a time.
BLOCK = 256
#: What each edit costs, and what a truncated row adds.
PRICES = {"K": 0, "R": 1, "D": 2, "I": 5}
TRUNCATED = 5
#: State by state and role initial; 0 is the start, 1 a system turn, 2 a user turn, 3 an assistant turn.
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ENDS = (0, 3)
LEGAL = {"su", "ua", "au"}
NAMES = {"u": "user", "a": "assistant"}
#: The one role that may be added in each state.
NEXT = {q: r for (q, r) in STEP if r in NAMES}


def _row_edits(code: str) -> list[tuple[int, int, int, str]]:
    """(state, next state, price, initial) of the edits of a row.

    A row's code is its role's initial, o for others, in upper case if it is truncated, or x if it has to go.
    """
    found = [(q, q, PRICES["D"], "D") for q in range(4)]
    if code != "x":
        more = TRUNCATED * code.isupper()
        found += [(q, after, PRICES["K"] + more, "K") for (q, r), after in STEP.items() if r == code.lower()]
        found += [(q, after, PRICES["R"] + more, "R") for (q, r), after in STEP.items() if r in NAMES]
    return found


INSERTS = [(q, after, PRICES["I"], "I") for (q, r), after in STEP.items() if r in NAMES]
_AHEAD = {c: [[e for e in _row_edits(c) if e[0] == q] for q in range(4)] for c in "xsuaoSUAO"}
_BACK = {c: [[e for e in _row_edits(c) if e[1] == q] for q in range(4)] for c in "xsuaoSUAO"}


def _edges(codes: str, reverse: int, i: int, q: int) -> list[tuple[int, int, int, str]]:
    """(rows gone through, state, price, initial) of the neighbours of a node."""
    if reverse:
        rows = [(i - 1, a, price, letter) for a, _, price, letter in _BACK[codes[i - 1]][q]] if i else []
        return rows + [(i, a, price, letter) for a, b, price, letter in INSERTS if b == q]
    rows = [(i + 1, b, price, letter) for _, b, price, letter in _AHEAD[codes[i]][q]] if i < len(codes) else []
    return rows + [(i, b, price, letter) for a, b, price, letter in INSERTS if a == q]


@lru_cache(maxsize=20_000)
def search(codes: str, start: int = 0, ends: tuple[int, ...] = ENDS) -> tuple[int, str] | None:
    """Cost and audit of the cheapest edits of rows of these codes, from a state to one of the ends; None if there are none."""
    settled: tuple[dict, dict] = {}, {}
    heaps = [(0, 0, "", start)], [(0, -len(codes), "", q) for q in ends]
    heapq.heapify(heaps[1])
    best = float("inf")
    while heaps[0] and heaps[1] and heaps[0][0][0] + heaps[1][0][0] <= best:
        side = int(heaps[1][0][0] < heaps[0][0][0])
        own, other, heap = settled[side], settled[1 - side], heaps[side]
        cost, at, audit, q = heapq.heappop(heap)
        node = abs(at), q
        if node in own:
            continue
        own[node] = cost, audit
        if node in other:
            best = min(best, cost + other[node][0])
        for i, state, price, letter in _edges(codes, side, *node):
            if (i, state) in other:
                best = min(best, cost + price + other[i, state][0])
            if (i, state) not in own:
                heapq.heappush(heap, (cost + price, -i, letter + audit, state) if side else (cost + price, i, audit + letter, state))
    if best == float("inf"):
        return None
    ahead, back = settled
    met = [audit + back[node][1] for node, (cost, audit) in ahead.items() if node in back and cost + back[node][0] == best]
    for node, (cost, audit) in ahead.items():
        met += [audit + letter + back[i, q][1] for i, q, price, letter in _edges(codes, 0, *node) if (i, q) in back and cost + price + back[i, q][0] == best]
    return best, min(met)


class Digest:
    """SHA-256 of repaired turns as ``role:text``, joined by line feeds."""

    def __init__(self) -> None:
        self.sha, self.empty = hashlib.sha256(), True

    def copy(self) -> Digest:
        new = Digest()
        new.sha, new.empty = self.sha.copy(), self.empty
        return new

    def add(self, role: str, text: str) -> None:
        self.sha.update(f"{'' if self.empty else chr(10)}{role}:{text}".encode())
        self.empty = False

    def value(self) -> str:
        return self.sha.hexdigest()


class Turns:
    """The repaired turns themselves."""

    def __init__(self) -> None:
        self.turns: list[dict] = []

    def copy(self) -> Turns:
        new = Turns()
        new.turns = self.turns.copy()
        return new

    def add(self, role: str, text: str) -> None:
        self.turns.append({"role": role, "text": text})

    def value(self) -> list[dict]:
        return self.turns


class _Reading:
    """One conversation on its way: its counts, the rows of the block and the best reading that ends in each state."""

    def __init__(self, sink: type) -> None:
        self.readings = {0: (0, "", sink())}
        self.rows: list[tuple[str, str]] = []
        self.codes: list[str] = []
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.first = self.last = self.before = None
        self.turns = self.illegal = 0

    def add(self, turn, role: str, text: str, fault: str | None) -> None:
        if fault:
            self.counts[fault] += 1
        if turn is not None:
            self.first = turn if self.first is None else self.first
            self.turns += turn != self.last
            self.last = turn
        initial = role[:1]
        self.illegal += self.before is not None and self.before + initial not in LEGAL
        self.before = initial
        code = initial if initial in ("s", "u", "a") else "o"
        self.codes.append("x" if fault in ("blank", "duplicate") else code.upper() if fault else code)
        self.rows.append((role, text))
        if len(self.rows) > BLOCK:  # one is left, so that the last block has a row
            self._cross(BLOCK, [(q,) for q in range(4)])

    def _cross(self, n: int, ends: list[tuple[int, ...]]) -> None:
        codes, rows = "".join(self.codes[:n]), self.rows[:n]
        del self.codes[:n], self.rows[:n]
        after = {}
        for end in ends:
            ways = [(cost + way[0], audit + way[1], q, way[1]) for q, (cost, audit, _) in self.readings.items() if (way := search(codes, q, end))]
            if ways:
                cost, audit, q, own = min(ways)
                sink = self.readings[q][2].copy()
                after[end[0]] = cost, audit, self._apply(sink, q, own, rows)
        self.readings = after

    @staticmethod
    def _apply(sink, state: int, audit: str, rows: list[tuple[str, str]]):
        at = iter(rows)
        for letter in audit:
            if letter == "I":
                role, text = NAMES[NEXT[state]], ""
            else:
                role, text = next(at)
                if letter == "D":
                    continue
                role = NAMES[NEXT[state]] if letter == "R" else role
            state = STEP[state, role[0]]
            sink.add(role, text)
        return sink

    def ended(self) -> tuple:
        self._cross(len(self.rows), [ENDS])
        cost, audit, sink = self.readings[ENDS[0]]
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return gaps, *self.counts.values(), self.illegal, cost, audit, sink.value()


def faults(rows: DataFrame, conv: str = "conv_id") -> DataFrame:
    """(conv, turn, role, text, fault) of every row, dealt by conversation and in order; fault is the first of a row or null."""
    role, text = (F.coalesce(c, F.lit(" ")) for c in ("role", "text"))
    plain = rows.select(F.col(conv).alias("_conv"), F.col("turn").cast("long").alias("_turn"), role.alias("_role"), text.alias("_text")).repartition("_conv")
    seen = F.row_number().over(Window.partitionBy("_conv", "_role", "_text").orderBy(F.asc_nulls_first("_turn"))) > 1
    told = F.when(~F.col("_text").rlike(r"[^\x20\x09-\x0D]"), "blank").when(seen, "duplicate").when(~F.col("_text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), "truncated")
    again = F.coalesce(F.col("_fault") == "duplicate", F.lit(False))  # of equal rows of one turn the first is no repeat
    return plain.withColumn("_fault", told).sortWithinPartitions("_conv", F.asc_nulls_first("_turn"), "_role", "_text", again)


def _repaired(rows: DataFrame, conv: str, sink: type, column: str, arrow: pa.DataType, sql: str) -> DataFrame:
    ordered = faults(rows, conv)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [conv, "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", column]
        out: list[tuple] = []
        key, reading, kind = None, None, None

        def batch_of(found: list[tuple]) -> pa.RecordBatch:
            types = [kind, *[pa.int64()] * 6, pa.string(), arrow]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], t) for k, t in enumerate(types)], names=names)

        for batch in slices(batches, 20 * ROWS_AT_ONCE):
            kind = batch.column(0).type
            for row_key, turn, role, text, fault in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if reading is None or row_key != key:
                    if reading is not None:
                        out.append((key, *reading.ended()))
                    key, reading = row_key, _Reading(sink)
                reading.add(turn, role, text, fault)
            if out:
                yield batch_of(out)
                out = []
        if reading is not None:
            yield batch_of([(key, *reading.ended())])

    counts = ", ".join(f"{c} bigint" for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"))
    return ordered.mapInArrow(run, f"`{conv}` {rows.schema[conv].dataType.simpleString()}, {counts}, audit string, `{column}` {sql}")


def repair(rows: DataFrame, conv: str = "conv_id") -> DataFrame:
    """One row a conversation: its faults, the cost and audit of the cheapest repair, and the repaired turns, which are one row."""
    arrow = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
    return _repaired(rows, conv, Turns, "repaired", arrow, "array<struct<role:string,text:string>>")


def digests(rows: DataFrame, conv: str = "conv_id") -> DataFrame:
    """As ``repair``, with the SHA-256 of the repaired turns: they pass through a worker block by block and are never held together."""
    return _repaired(rows, conv, Digest, "repaired_sha256", pa.string(), "string")


def damaged(rows: DataFrame) -> DataFrame:
    """Rows of conversations with faults by a hash of id and turn: dropped, emptied, without full stops, twice, or with role user."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(said("text"), "[.!?]", "")).otherwise(said("text"))
    role: Column = F.when(kind == 4, "user").otherwise(said("role"))
    times = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.filter(kind != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("copy")).drop("copy")
