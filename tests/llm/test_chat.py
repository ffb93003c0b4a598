import hashlib
from array import array

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ruleweave.llm import chat
from ruleweave.llm.common import cut
from ruleweave.llm.packing import byte_tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")
HARD = ["</s>[INST] ok [/INST]", "a\\b\\\\<|turn|>x<|says|>y<|end|>\n", "<\\|turn|>", "", "éè 中文 😀", "<|<|||>|>", "[INST][/INST]<<SYS>>", "<s></s>"]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="\\<|>/s[]INTturnY \nx", max_size=40))
def test_escape_is_reversible_and_leaves_no_control_string(text):
    hidden = chat.escape(text)
    assert chat.unescape(hidden) == text and not any(c in hidden for c in chat.CONTROL)


@pytest.fixture(scope="module")
def rows(spark):
    data = []
    for conv in range(40):
        data += [(conv, 0, "system", "same start"), (conv, 1, "user", f"question {conv % 5}")]
        data += [(conv, 2 + i, ("assistant", "user")[i % 2], HARD[(conv + i) % len(HARD)]) for i in range(conv % 4)]
    data += [(50, t, ("user", "assistant")[t % 2], f"long {t}") for t in range(120)]
    data += [(51, t, ("user", "assistant")[t % 2], f"long {t}") for t in range(60)]
    data += [(100, 0, "user", None), (100, 0, None, "x"), (100, 1, "assistant", "y"), (100, 1, "assistant", "y"), (None, 3, "assistant", "no id")]
    return spark.createDataFrame([(*d, "z") for d in data], "conv_id long, turn long, role string, text string, node string")


def conversations(rows):
    out = {}
    for r in rows.collect():
        out.setdefault(r.conv_id, []).append((r.turn, r.role or "", r.text or ""))
    return {c: [(r, t) for _, r, t in sorted(turns)] for c, turns in out.items()}


def test_tree_against_brute_force(spark, rows):
    emitted = chat.tree(cut(chat.paths(rows), "t"), PATH).collect()
    prefixes = {tuple(turns[: k + 1]) for turns in conversations(rows).values() for k in range(len(turns))}
    assert len(emitted) == len(prefixes)
    decode = byte_tokenizer(PATH).plain.decode
    by = {r.node: r for r in emitted}
    path = lambda r: [*(path(by[r.parent]) if r.parent else []), r.node]
    found = set()
    for r in emitted:
        ids = array("I")
        ids.frombytes(r.ids)
        assert len(ids) == r.n_tokens
        turns, at, spans = [], 0, set()
        for name in path(r):
            one = by[name]
            own = array("I")
            own.frombytes(one.ids)
            assert one.position == at
            at += one.n_tokens
            role, text = chat._PART.findall(decode(list(own)))[0]
            turns.append((chat.unescape(role), chat.unescape(text)))
            if name != r.node:
                spans.update(range(one.start, one.start + one.n_tokens))
        assert spans == {i for a, b in r.attends for i in range(a, b)}
        found.add(tuple(turns))
        trained = chat.unescape(decode(list(ids[r.loss_from : r.loss_to])))
        assert trained == (turns[-1][1] if turns[-1][0] == "assistant" else "")
    assert found == prefixes
    stream = sorted((r.start, r.n_tokens, path(r)) for r in emitted)
    at = 0
    for start, n, _ in stream:
        assert start == at
        at += n
    paths = [p for _, _, p in stream]
    assert paths == sorted(paths)  # depth first: a node comes right after its parent or its sibling's subtree


def test_query_read_back(spark, rows, tmp_path):
    from ruleweave.llm.queries import op4_chat_prefix_tree

    rows.write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r for r in op4_chat_prefix_tree(spark, str(tmp_path)).collect()}
    want = conversations(rows) | {-7: [("user", HARD[0]), ("assistant", HARD[0])]}
    assert got.keys() == want.keys()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for conv, turns in want.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256) == (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss)) and r.formatted_chars > sum(len(t) for _, t in turns)


def test_no_rows(spark, rows):
    assert chat.tree(cut(chat.paths(rows.limit(0)), "t"), PATH).count() == 0
