import hashlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ruleweave.llm import bpe

WORD, BYTE = (public_tokenizers.path(f) for f in ("word_bpe_49k.json", "byte_bpe_50k.json"))
HARD = ["", "<|endoftext|> x<|startoftext|>y", "<|<|endoftext|>|>", "İstanbul ŒUVRE ﬁ ½ 中文 😀👍🏽 don't I'LL  \t\n x", "a" * 3000, "éèê" * 50, "\x00 b", "１２ ² ٣", " \r\n  hi "]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_round_trip_equals_the_library(path):
    library, mine = Tokenizer.from_file(path), bpe.codec(path)
    for text in HARD:
        want = library.encode(text, add_special_tokens=False).ids
        assert list(mine.encode(text)) == want
        assert mine.decode(want) == library.decode(want, skip_special_tokens=False)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.characters(max_codepoint=0x2FF), max_size=60))
def test_any_latin_text_equals_the_library(text):
    library, mine = Tokenizer.from_file(WORD), bpe.codec(WORD)
    assert list(mine.encode(text)) == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_no_token_spans_a_forced_boundary(path):
    mine = bpe.codec(path)
    for token in mine.vocab:
        if token not in mine.added:
            assert mine.split(mine._bare(token)) in ([mine._bare(token)], [""]) or len(mine._bare(token)) == 1


def test_many_added_tokens_long_texts_and_full_stores(monkeypatch):
    library, mine = Tokenizer.from_file(WORD), bpe.Codec(WORD)
    for text in ("ab<|endoftext|>" * 50_000, "one two\n " * 300_000, "x" * 70 + " y"):
        want = library.encode(text, add_special_tokens=False).ids
        ids, decoded = next(mine.round_trips([text]))
        assert ids == b"".join(i.to_bytes(4, "little") for i in want) and decoded.decode() == library.decode(want, skip_special_tokens=False)
    monkeypatch.setattr(bpe, "CACHED", 3)
    monkeypatch.setattr(bpe, "WINDOW", 20)
    texts = ["some words that fill it", None, "x" * 70, "and some words more, éèê", "", " ", "tab\tand\x85 other blanks"] * 3
    for text, (ids, decoded) in zip(texts, mine.round_trips(texts), strict=True):
        want = library.encode(text or "", add_special_tokens=False).ids
        assert ids == b"".join(i.to_bytes(4, "little") for i in want) and decoded.decode() == library.decode(want, skip_special_tokens=False)


def test_operator_over_nulls_copies_and_no_rows(spark):
    docs = spark.createDataFrame([(1, None, "a"), (1, "Hello", "b"), (1, "Hello", "b"), (None, "", "c")], "doc_id long, text string, ids string")
    got = bpe.encode_texts(docs, WORD).collect()
    assert sorted(len(r.ids) for r in got) == [0, 0, 4, 4] and sorted(r.decoded for r in got) == ["", "", "hello</w>", "hello</w>"]
    assert bpe.encode_texts(docs.limit(0), WORD).count() == 0


def test_query_digests(spark, tmp_path):
    from ruleweave.llm.queries import op3_bpe_round_trip

    spark.createDataFrame([(7, "Some text, twice. Some text!")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    row = op3_bpe_round_trip(spark, str(tmp_path)).first()
    library = Tokenizer.from_file(WORD)
    ids = library.encode("Some text, twice. Some text!", add_special_tokens=False).ids
    assert row.n_tokens == len(ids) and row.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
    assert row.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
