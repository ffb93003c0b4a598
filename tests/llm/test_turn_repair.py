import hashlib
import itertools
import random
import re
import zlib

import pytest

from ruleweave.llm import turn_repair

WANTED = re.compile(r"(s?(ua)+)?")


def brute(codes):
    """Every way to edit so few rows, with up to two inserts before each and at the end."""
    best = None
    choices = [["D"] if c == "x" else ["D", "K", "Ru", "Ra"] for c in codes]
    for edits in itertools.product(*choices):
        for inserts in itertools.product(["", "u", "a", "ua", "au"], repeat=len(codes) + 1):
            roles, audit, cost = inserts[0], "I" * len(inserts[0]), 5 * len(inserts[0])
            for c, e, more in zip(codes, edits, inserts[1:], strict=True):
                roles += {"D": "", "K": c.lower(), "Ru": "u", "Ra": "a"}[e] + more
                audit += e[0] + "I" * len(more)
                cost += {"D": 2, "K": 0, "R": 1}[e[0]] + 5 * len(more) + 5 * (e != "D" and c.isupper())
            if WANTED.fullmatch(roles) and (best is None or (cost, audit) < best):
                best = cost, audit
    return best


def by_rows(codes, start=0, ends=(0, 3)):
    """The least (cost, audit) of each state row by row."""
    def inserted(cells):
        for _ in range(3):
            for (q, r), z in turn_repair.STEP.items():
                if r != "s" and q in cells:
                    cells[z] = min(cells.get(z, (10**9, "")), (cells[q][0] + 5, cells[q][1] + "I"))
        return cells

    cells = inserted({start: (0, "")})
    for c in codes:
        after = {}
        for q, (cost, audit) in cells.items():
            ways = [(q, 2, "D")]
            if c != "x":
                ways += [(z, 5 * c.isupper(), "K") for (a, r), z in turn_repair.STEP.items() if a == q and r == c.lower()]
                ways += [(z, 1 + 5 * c.isupper(), "R") for (a, r), z in turn_repair.STEP.items() if a == q and r != "s"]
            for z, price, letter in ways:
                after[z] = min(after.get(z, (10**9, "")), (cost + price, audit + letter))
        cells = inserted(after)
    return min((cells[q] for q in ends if q in cells), default=None)


def test_search_equals_every_way_to_edit():
    for n in range(3):
        for codes in itertools.product("xsuaoSUAO", repeat=n):
            assert turn_repair.search("".join(codes)) == brute("".join(codes))
    rng = random.Random(1)
    for _ in range(12):
        codes = "".join(rng.choice("xsuaoSUAO") for _ in range(3))
        assert turn_repair.search(codes) == brute(codes)


def test_search_equals_row_by_row_between_any_states():
    rng = random.Random(2)
    for _ in range(1500):
        codes = "".join(rng.choice("xsuauaoSUA") for _ in range(rng.randrange(14)))
        start, ends = rng.randrange(4), rng.choice([(0, 3), (0,), (1,), (2,), (3,)])
        assert turn_repair.search(codes, start, ends) == by_rows(codes, start, ends)


def expected(rows):
    """One conversation's result from rows (turn, role, text) in order, plainly."""
    seen, codes, faults = set(), "", []
    for _, role, text in rows:
        bare = text.strip(" \t\n\v\f\r")
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
        seen.add((role, text))
        faults.append(fault)
        code = role[:1] if role[:1] in set("sua") and role else "o"
        codes += "x" if fault in ("blank", "duplicate") else code.upper() if fault else code
    turns = [t for t, _, _ in rows if t is not None]
    cost, audit = by_rows(codes)
    roles = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:], strict=False))
    out, at, state = [], iter(rows), 0
    for letter in audit:
        _, role, text = (None, None, "") if letter == "I" else next(at)
        if letter == "D":
            continue
        if letter != "K":
            role = "assistant" if state == 2 else "user"
        state = turn_repair.STEP[state, role[0]]
        out.append((role, text))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, out


@pytest.mark.parametrize("block", [2, 3, 256])
def test_operator_equals_plain_rows_whatever_the_block(spark, monkeypatch, block):
    """Blocks of few rows give what whole conversations give; odd rows, null ids, ties and clashing names included."""
    rng = random.Random(3)
    texts = ["Yes.", "No!", "so", "", "  \n", "Why? \n", "tail…", "x" * 5000 + "."]
    rows = {(c, t, rng.choice(["user", "assistant", "system", "tool", ""]), rng.choice(texts)) for c in [None, 1, 2, 3, 4, 5] for t in [None, *range(12)] if rng.random() < 0.8}
    rows = [*rows, *list(rows)[:7], (6, None, "user", "Hi."), (7, 3, "assistant", "A.")]
    table = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, _fault string, cost int")
    monkeypatch.setattr(turn_repair, "BLOCK", block)
    # the worker reads BLOCK from its own module: run the reading here, the operator once with whole blocks
    want = {}
    for conv in {r[0] for r in rows}:
        own = sorted(((t, r, x) for c, t, r, x in rows if c == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        want[conv] = expected(own)
        reading, seen = turn_repair._Reading(turn_repair.Turns), set()
        for turn, role, text in own:
            bare = text.strip(" \t\n\v\f\r")
            reading.add(turn, role, text, "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
            seen.add((role, text))
        got = reading.ended()
        assert got[:-1] == want[conv][:-1] and [(t["role"], t["text"]) for t in got[-1]] == want[conv][-1]
    if block == 256:
        found = {r.conv_id: r for r in turn_repair.repair(table).collect()}
        digests = {r.conv_id: r for r in turn_repair.digests(table).collect()}
        assert set(found) == set(digests) == set(want)
        for conv, w in want.items():
            assert tuple(found[conv])[1:8] == tuple(digests[conv])[1:8] == w[:7]
            assert [tuple(t) for t in found[conv].repaired] == w[7]
            assert digests[conv].repaired_sha256 == hashlib.sha256("\n".join(f"{r}:{t}" for r, t in w[7]).encode()).hexdigest()
        assert turn_repair.repair(table.limit(0)).count() == 0


def test_nulls_are_one_space_and_damage_follows_the_hash(spark):
    table = spark.createDataFrame([(1, 0, None, "a."), (1, 1, "user", None)], "conv_id long, turn long, role string, text string")
    row = turn_repair.repair(table).first()
    assert (row.blank, row.illegal, row.cost, row.audit) == (1, 1, 4, "DD") and row.repaired == []
    rows = [(c, t, "assistant", "One. Two!") for c in range(6) for t in range(20)]
    got = sorted(map(tuple, turn_repair.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()))
    want = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{c}:{t}".encode()) % 20
        if kind:
            one = (c, t, "user" if kind == 4 else role, "" if kind == 1 else "One Two" if kind == 2 else text)
            want += [one] * (2 if kind == 3 else 1)
    assert got == sorted(want)


def test_query_keeps_every_conversation(spark, tmp_path):
    from ruleweave.llm.queries import op12_turn_repair

    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    spark.createDataFrame([(gone, 0, "user", "Hi."), (None, 0, "user", "Hi.")], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    found = {r.conv_id: r for r in op12_turn_repair(spark, str(tmp_path)).collect()}
    assert set(found) == {gone, None} and found[gone].audit == "" and found[gone].repaired_sha256 == hashlib.sha256(b"").hexdigest()
