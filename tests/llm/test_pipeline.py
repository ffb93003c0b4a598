"""The stages in sequence over a small folder, against brute force, and every registered query over odd rows."""

import random

import corpus_pipeline
import duckdb
import pytest
from pyspark.sql import functions as F

from ruleweave.llm import ngram_quality, packing, quality_rules, queries, shingle_sets

SYLLABLES = ["an", "ti", "er", "on", "sh", "le", "ou", "nd", "the", "of"]


def prose(rng, n=60):
    return " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, at = random.Random(8), tmp_path_factory.mktemp("data")
    rows = [(i, prose(rng), "en" if i % 3 else "de") for i in range(60)]
    rows += [(100 + i, rows[i][1], "en") for i in range(5)]  # copies
    near = rows[7][1].split()
    near[30] = "changed"
    rows += [(120, " ".join(near), "en"), (121, prose(rng, 5), "en"), (122, "#$% | " * 60, "en"), (123, "", "en"), (124, None, None), (125, prose(rng, 30_000), "fr"), (None, prose(rng), "en"), (3, rows[3][1], "en")]
    docs = spark.createDataFrame([(i, t, x, "s", len(t or ""), "clash") for i, t, x in rows], "doc_id long, text string, lang string, source string, n_chars long, n_words string")
    docs.write.parquet(str(at / "documents.parquet"))
    labels = [(i, int(i < 50), int(i % 6 == 1)) for i in range(60)] + [(122, 0, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(at / "labels.parquet"))
    pages = [(1, "http://a.com/x?b=1&a=2", "<p>one</p>"), (2, "https://www.a.com/x/?a=2&b=1#t", "<p>two é</p>"), (3, "http://b.com", None), (4, "http://b.com/" + "y" * 3000, "z" * 300_000)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(at / "pages.parquet"))
    talk = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (2, 0, "user", "hi"), (2, 1, "assistant", None), (2, 1, "assistant", "x" * 50_000), (None, 0, None, "</s>")]
    spark.createDataFrame(talk, "conv_id long, turn int, role string, text string").write.parquet(str(at / "conversations.parquet"))
    items = [(1, rows[9][1]), (2, None), (None, "the of an"), (1, prose(rng, 400)), (3, "é unknown")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(at / "benchmark.parquet"))
    for t in ("documents", "labels", "pages", "conversations", "benchmark"):
        spark.read.parquet(str(at / f"{t}.parquet")).limit(0).write.parquet(str(at / "empty" / f"{t}.parquet"))
    return str(at)


def test_stages_decide_and_keep_the_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    trusted = spark.read.parquet(f"{folder}/labels.parquet").filter("quality = 1").select("doc_id")
    own = docs
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        before, own = own, corpus_pipeline.cut(stage(spark, own, folder), f"test-{number}")
        assert own.columns == docs.columns
        ids = lambda df: sorted(str(r.doc_id) for r in df.collect())
        if number == 0:
            judged = ngram_quality.score(before, trusted).filter(~F.col("kept")).select("doc_id").distinct()
            assert "122" not in ids(own) and set(ids(own)) == set(ids(before)) - set(ids(judged)) and len(ids(own)) >= 60
        if number == 1:
            assert ids(own) == ids(quality_rules.apply_policy(quality_rules.ledger(before), quality_rules.PRODUCTION_POLICY).filter("kept"))
        if number == 2:
            kept, texts = set(ids(own)), {str(r.doc_id): set(shingle_sets.shingles(r.text).tolist()) for r in before.collect()}
            alike = {a: {b for b in texts if len(texts[a] & texts[b]) * 100 >= 80 * len(texts[a] | texts[b])} for a in texts}
            for a in texts:  # one of each group, that of the smallest id
                seen, todo = set(), [a]
                while todo:
                    x = todo.pop()
                    if x not in seen:
                        seen.add(x)
                        todo += alike[x]
                first = min((x for x in seen if x != "None"), key=int, default="None")
                assert (a in kept) == (a == first), a
    packed = corpus_pipeline.STAGES[-1][1](spark, own, folder).collect()
    lengths = packing.tokenize(own, corpus_pipeline.public_tokenizers.path("byte_bpe_50k.json")).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    by: dict = {}
    for r in packed:
        by[r.doc_id] = by.get(r.doc_id, 0) + r.length
    assert by == {r.doc_id: r.n for r in lengths}
    whole = {}
    for r in packed:
        whole.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sum(n for _, n in v) <= 1024 and sorted(o for o, _ in v)[0] == 0 for v in whole.values())


def test_run_equals_the_stages_and_takes_no_documents(spark, folder):
    assert corpus_pipeline.run(spark, folder).select("doc_id", "piece", "length").distinct().count() > 0
    assert corpus_pipeline.run(spark, f"{folder}/empty").count() == 0


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n != "pipeline"])
def test_every_query_takes_odd_rows_and_empty_tables(spark, folder, name):
    rows = queries.QUERIES[name](spark, folder).collect()
    if name in queries.ORACLE_SQL:
        con = duckdb.connect()
        for t in ("documents", "pages", "conversations", "benchmark"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
        ran = con.execute(queries.ORACLE_SQL[name])
        columns = [d[0] for d in ran.description]
        assert sorted(map(repr, ran.fetchall())) == sorted(repr(tuple(r[c] for c in columns)) for r in rows)
    elif name not in ("op2_best_fit_packing", "op4_chat_prefix_tree", "op10_license_scan"):
        assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    empty = queries.QUERIES[name](spark, f"{folder}/empty").collect()
    assert len(empty) == (1 if name == "op4_chat_prefix_tree" else 0)


def test_op5_stores_what_an_independent_reader_reads(spark, folder):
    import hashlib
    import zlib

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").filter("doc_id >= 100").collect()}
    for r in queries.op5_ogg_media(spark, folder).filter("doc_id >= 100").collect():
        raw = (texts[r.doc_id] or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
