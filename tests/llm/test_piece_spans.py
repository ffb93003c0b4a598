import hashlib
import struct
import zlib

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from ruleweave.llm import piece_spans

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
HARD = [
    "", " ", "  a ", "héllo  wörld 😀 ▁x", "▁▁ ▁ a▁", "中文字" * 300, "x" * 3000, " \n\t  \r\nq <s> </s> <0x41>\n\n", "é " * 200, "ก็ไม่รู้ ﬁ ① İ", "a\x00b  \n  c", "word\nword word\n",
    b"ab\xff\xfecd \x00 x\xe2\x96", b"\xed\xa0\x80 \xf4\x90\x80\x80 \xc0\x80",
]


def agrees(model, raw):
    raw = raw.encode() if isinstance(raw, str) else raw
    found, places = next(model.encoded([raw]))
    ids, begins, ends = model.spans(found, places)
    want = LIBRARY.encode(raw, return_type="proto").pieces
    assert [(p.id, p.begin, p.end) for p in want] == list(zip(ids.tolist(), begins.tolist(), ends.tolist(), strict=True))
    assert model.text_of(found).decode() == LIBRARY.decode(ids.tolist()) == model.decode(ids.tolist())


@pytest.mark.parametrize("text", HARD)
def test_ids_spans_and_text_equal_the_library(text):
    agrees(piece_spans.pieces(PATH), text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab eE\n▁é中😀.,the "), max_size=80))
def test_any_text_equals_the_library(text):
    agrees(piece_spans.pieces(PATH), text)


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=40))
def test_any_bytes_equal_the_library(raw):
    agrees(piece_spans.pieces(PATH), raw)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 31999), st.integers(0, 260), st.sampled_from([28705, 259, 0, 1, 2])), max_size=12))
def test_any_ids_decode_as_in_the_library(ids):
    assert piece_spans.pieces(PATH).decode(ids) == LIBRARY.decode(ids)


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf", "identity"])
def test_compiled_character_map_and_alignment_equal_the_library(rule):
    """The library's own normalizers: longest prefixes, source places, blanks squeezed and stripped."""
    library = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=rule != "identity")
    spec = dict(piece_spans._fields(library.serialized_model_proto()))[piece_spans.NORMALIZER]
    mine = piece_spans.Normalizer(dict(piece_spans._fields(spec)))
    for text in ("ﬁ ①  x", "  Ａｌｌ Ｗｉｄｅ  ", "ｶﾞ が é é", "a​b　c", "", "   ", "ﷺ ŒUVRE ½", "ẹ́x"):
        normal, places = mine.aligned(text.encode())
        want, want_places = library.Normalize(text.encode(), with_offsets=True)
        assert normal == (want if isinstance(want, bytes) else want.encode()), text
        if text.strip():  # the library has no places for nothing
            assert places.tolist() == list(want_places), text


def test_long_texts_and_full_stores(monkeypatch):
    model = piece_spans.Pieces(PATH)
    monkeypatch.setattr(piece_spans, "CACHED", 5)
    monkeypatch.setattr(piece_spans, "WINDOW", 20)
    texts = ["some words that  fill\nit twice and more", None, "x" * 90, "and some words more, éèê ▁ of it", "", " " * 50, "a b c " * 30] * 2
    for text, (found, places) in zip(texts, model.encoded([None if t is None else t.encode() for t in texts]), strict=True):
        ids, begins, ends = model.spans(found, places)
        want = LIBRARY.encode((text or "").encode(), return_type="proto").pieces
        assert [(p.id, p.begin, p.end) for p in want] == list(zip(ids.tolist(), begins.tolist(), ends.tolist(), strict=True))


def test_refuses_other_models(tmp_path):
    path = tmp_path / "m.model"
    path.write_bytes(sentencepiece.SentencePieceNormalizer(rule_name="identity").serialized_model_proto())
    with pytest.raises(ValueError, match="byte fallback"):
        piece_spans.Pieces(str(path))


def test_operator_over_nulls_copies_clashes_and_no_rows(spark):
    docs = spark.createDataFrame([(1, None, "a"), (1, "Hé 😀", "b"), (1, "Hé 😀", "b"), (None, "", "c")], "doc_id long, text string, ids string")
    got = piece_spans.encode_spans(docs, PATH).collect()
    assert sorted(len(r.ids) for r in got) == [0, 0, 4, 4] or sorted(r.decoded for r in got) == ["", "", "Hé 😀", "Hé 😀"]
    raw = "Hé 😀".encode()
    for r in got:
        if r.ids:
            assert b"".join(raw[b:e] for b, e in zip(r.begins, r.ends, strict=True)) == raw
    assert piece_spans.encode_spans(docs.limit(0), PATH).count() == 0


def test_query_digests(spark, tmp_path):
    from ruleweave.llm.queries import op13_piece_spans

    text = "Some text, twice.\nSome text! 😀"
    spark.createDataFrame([(7, text), (8, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r.doc_id: r for r in op13_piece_spans(spark, str(tmp_path)).collect()}
    want = LIBRARY.encode(text.encode(), return_type="proto").pieces
    ids = [p.id for p in want]
    assert rows[7].n_tokens == len(ids) and rows[7].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert rows[7].decoded_sha256 == hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()
    assert rows[7].spans_crc32 == zlib.crc32(b"".join(struct.pack("<II", p.begin, p.end) for p in want))
    assert rows[8].n_tokens == 0 and rows[8].ids_sha256 == hashlib.sha256(b"").hexdigest()
