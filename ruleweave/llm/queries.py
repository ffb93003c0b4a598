"""One query for each training-data operator, and the SQL it is compared with where SQL can express it."""

from __future__ import annotations

import hashlib

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleweave.llm import best_position, bpe, chat, license_scan, ngram_quality, ogg, packing, piece_spans, quality_rules, simhash, toxicity, turn_repair, warc
from ruleweave.llm.common import cut, read


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements, failure bits and verdicts of every document under the production policy."""
    rows = quality_rules.ledger(read(spark, sf_dir, "documents"))
    judged = quality_rules.apply_policy(quality_rules.apply_policy(rows, quality_rules.BASE_POLICY, "base_kept"), quality_rules.PRODUCTION_POLICY)
    told = quality_rules.sole_rule(judged, quality_rules.PRODUCTION_POLICY)
    return told.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~F.col("base_kept")).alias("base_failed"), "kept", "fail_bits", "sole_bit"
    )


OP1_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT rid, i, array_to_string(ws[i:i+7], ' ') AS g FROM w, unnest(range(1, len(ws) - 6)) AS t(i)),
dup AS (SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
cov AS (SELECT rid, count(DISTINCT i + k) AS n FROM dup, range(8) AS s(k) GROUP BY rid),
m AS (SELECT w.rid, doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
             coalesce(cov.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN cov USING (rid)),
f AS (SELECT *, (n_words < 20)::INT AS f0, (100 * n_repeat_words > 30 * n_words)::INT AS f1, (2 * n_symbols > n_words)::INT AS f2,
             (n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 16 * n_words))::INT AS f3,
             (n_lines >= 3 AND 2 * n_dup_lines > n_lines)::INT AS f4 FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (f0 + f1 > 0) AS base_failed,
       (f0 + f1 + f2 + f3 + f4 = 0) AS kept, (f0 + 2 * f1 + 4 * f2 + 8 * f3 + 16 * f4)::BIGINT AS fail_bits,
       CASE WHEN f0 + f1 + f2 + f3 + f4 = 1 THEN f0 + 2 * f1 + 4 * f2 + 8 * f3 + 16 * f4 ELSE 0 END::BIGINT AS sole_bit FROM f
"""

def op2_best_fit_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """Every piece of every document and its place in a sequence of at most 1024 tokens."""
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    pieces = packing.tokenize(read(spark, sf_dir, "documents"), path)
    digests = cut(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), "packing-pieces")
    return packing.pack(digests)


def op3_bpe_round_trip(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """Digests of every document's ids and of the text they decode to."""
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    return bpe.digests(read(spark, sf_dir, "documents"), path)


def op4_chat_prefix_tree(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """Digests of every conversation as read back from the emitted prefix tree."""
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    convs = cut(chat.paths(rows), "chat-paths")
    ends = convs.select("conv_id", F.element_at("nodes", -1).alias("leaf"))
    leaves = convs.groupBy(F.element_at("nodes", -1).alias("leaf")).agg(F.first("nodes").alias("nodes"))
    emitted = cut(chat.tree(convs, path), "chat-tree")
    return ends.join(chat.read_back(emitted, leaves, path), "leaf").drop("leaf")


def op5_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's Ogg form and of the payload and features read back from it."""
    stored = ogg.read_back(ogg.store(read(spark, sf_dir, "documents")))
    return stored.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -ogg.BLOCK, ogg.BLOCK)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
        F.size("problems").alias("n_problems"),
        F.size("gaps").alias("n_gaps"),
    )


def op6_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as WARC records of several captures, not-modified revisits resolved.

    The pages have no protocol data, so the captures are made up by a rule over page_id, k seconds of a million apart:
    0, a revisit before any response (pages of even number); 1, a response; 2, a revisit; 3, a response with another body
    (pages of odd number); 4, a revisit that still has the first response's entity tag.
    """
    pages = read(spark, sf_dir, "pages").select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    page = F.coalesce("page_id", F.lit(0))
    captures = F.array(F.when(page % 2 == 0, F.lit(0)), F.lit(1), F.lit(2), F.when(page % 2 != 0, F.lit(3)), F.lit(4))
    rows = pages.select("*", F.substring(F.md5("html"), 1, 8).alias("tag"), F.explode(F.array_compact(captures)).alias("capture"))
    again, changed = F.col("capture").isin(0, 2, 4), F.col("capture") == 3
    fields = [
        F.concat(F.lit("Date: capture "), F.col("capture").cast("string")),
        F.concat(F.lit('ETag: "'), F.col("tag"), F.when(changed, "-2").otherwise(""), F.lit('"')),
    ]
    full = F.concat_ws("\r\n", F.lit("HTTP/1.1 200 OK"), F.lit("Content-Type: text/html; charset=utf-8"), F.lit("Cache-Control: max-age=3600"), *fields)
    unchanged = F.concat_ws("\r\n", F.lit("HTTP/1.1 304 Not Modified"), F.lit("Content-Type: text/plain"), F.lit("Cache-Control: max-age=60"), *fields)
    record = warc.record(
        F.when(again, "revisit").otherwise("response"),
        F.concat(F.lit("<urn:page:"), F.lpad(F.col("page_id").cast("string"), 12, "0"), F.lit(":"), F.col("capture").cast("string"), F.lit(">")),
        F.col("url"),
        F.date_format(F.timestamp_seconds(1_700_000_000 + F.col("page_id") + 1_000_000 * F.col("capture").cast("long")), "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        F.when(again, unchanged).otherwise(full),
        F.when(again, "").when(changed, F.concat("html", F.lit("<!-- changed -->"))).otherwise(F.col("html")),
    )
    found = warc.resolve(warc.parse(rows.select("page_id", "capture", record.alias("record")), ("page_id", "capture")), ("page_id", "capture"))
    lines = F.array_join(F.transform("headers", lambda h: F.concat(h["name"], F.lit(": "), h["value"])), "\n")
    return found.select("page_id", "capture", F.col("url_key").alias("canonical_url"), "kind", "outcome", "refers_to", lines.alias("headers"), "payload_sha256", "payload_bytes")


OP6_SQL = r"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, substr(md5(coalesce(html, '')), 1, 8) AS tag,
    regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare FROM pages),
c AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)), ':(80|443)$', ''), '^(www|m)\.', '')
    || regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') AS hostpath,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(bare, '^[^?]*\??(.*)$', 1), '&'),
        lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|ref|fbclid|gclid)(=|$)'))), '&') AS q FROM p),
r AS (SELECT page_id, k::INT AS capture, hostpath || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS u, k IN (0, 2, 4) AS again,
    page_id + 1000000 * k AS seconds, '<urn:page:' || lpad(CAST(page_id AS VARCHAR), 12, '0') || ':' || k || '>' AS rid,
    '"' || tag || CASE WHEN k = 3 THEN '-2' ELSE '' END || '"' AS tag, html || CASE WHEN k = 3 THEN '<!-- changed -->' ELSE '' END AS body
    FROM c, range(5) AS t(k) WHERE (k <> 0 OR coalesce(page_id, 0) % 2 = 0) AND (k <> 3 OR coalesce(page_id, 0) % 2 <> 0)),
f AS (SELECT *, last_value(CASE WHEN NOT again THEN struct_pack(rid := rid, tag := tag, sha := sha256(body), bytes := strlen(body)) END IGNORE NULLS)
    OVER (PARTITION BY u ORDER BY seconds, rid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM r)
SELECT page_id, capture, u AS canonical_url, CASE WHEN again THEN 'revisit' ELSE 'response' END AS kind,
    CASE WHEN NOT again THEN 'full' WHEN b IS NULL THEN 'unresolved' WHEN tag = b.tag THEN 'resolved' ELSE 'validator_mismatch' END AS outcome,
    CASE WHEN again AND tag = b.tag THEN b.rid END AS refers_to,
    'cache-control: max-age=' || CASE WHEN again THEN '60' ELSE '3600' END || chr(10) || 'content-type: '
      || CASE WHEN again AND (b IS NULL OR tag <> b.tag) THEN 'text/plain' ELSE 'text/html; charset=utf-8' END || chr(10)
      || 'date: capture ' || capture || chr(10) || 'etag: ' || tag AS headers,
    CASE WHEN NOT again THEN sha256(body) WHEN tag = b.tag THEN b.sha END AS payload_sha256,
    CASE WHEN NOT again THEN strlen(body) WHEN tag = b.tag THEN b.bytes END::BIGINT AS payload_bytes FROM f
"""


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity, bound and verdict of every document under a model of the documents labelled good."""
    trusted = read(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return ngram_quality.score(read(spark, sf_dir, "documents"), trusted)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; rows whose crc32 of the id is a multiple of five are never learned from."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    docs = read(spark, sf_dir, "documents")
    labels = read(spark, sf_dir, "labels").select("doc_id", "toxic").filter(~held_out)
    model = toxicity.fit(docs, labels)
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every document that mentions licensing, with its license and wording differences."""
    return license_scan.scan(read(spark, sf_dir, "documents"))


def op11_best_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item, by the Best Position Algorithm over all documents."""
    return best_position.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
WITH low AS (SELECT row_number() OVER () AS rid, doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
words AS (SELECT rid, doc_id, unnest(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM low),
d AS (SELECT rid, doc_id, count(*) AS n FROM words GROUP BY ALL),
s AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM d),
p AS (SELECT rid, term, count(*) AS tf FROM words GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * any_value(s.docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, s GROUP BY term),
asked AS (SELECT qid, item_id, unnest(list_distinct(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term FROM
    (SELECT row_number() OVER () AS qid, item_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM benchmark)),
scored AS (SELECT qid, item_id, rid, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * s.docs) // s.terms))))::BIGINT AS score
    FROM asked JOIN p USING (term) JOIN w USING (term) JOIN d USING (rid), s GROUP BY ALL)
SELECT item_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id NULLS FIRST)::INT AS rank FROM scored WHERE score > 0) WHERE rank <= 10
"""


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every conversation, damaged by a hash of its rows' ids and turns."""
    rows = read(spark, sf_dir, "conversations")
    ids, found = rows.select("conv_id").distinct(), turn_repair.digests(turn_repair.damaged(rows))
    every = ids.join(found.withColumnRenamed("conv_id", "_conv"), ids["conv_id"].eqNullSafe(F.col("_conv")), "left").drop("_conv")
    return every.na.fill(0, ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]).na.fill({"audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()})


#: Row by row, the best (cost, audit) of each state, with at most two inserts between rows: a third state would be one left before.
OP12_SQL = r"""
WITH RECURSIVE
bit AS (SELECT n, 0 AS k, n AS c FROM range(256) AS t(n) UNION ALL
    SELECT n, k + 1, xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END) FROM bit WHERE k < 8),
crc AS (SELECT list(c ORDER BY n) AS t FROM bit WHERE k = 8),
h AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(4294967295::BIGINT, list_reduce(list_transform(
        string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT),
        lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]::BIGINT), 4294967295::BIGINT)) % 20 AS kind FROM conversations, crc),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
        CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
    FROM h, range(2) AS t(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)),
e AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) > 1 AS again FROM d),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, again) AS i FROM e),
f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'blank' WHEN again THEN 'duplicate'
        WHEN NOT regexp_matches(text, '[.!?][ 	-
]*$') THEN 'truncated' END AS fault, left(role, 1) AS r,
        lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS b FROM o),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count_if(fault = 'blank')::BIGINT AS blank,
        count_if(fault = 'duplicate')::BIGINT AS duplicate, count_if(fault = 'truncated')::BIGINT AS truncated,
        count_if(b IS NOT NULL AND b || r NOT IN ('su', 'ua', 'au'))::BIGINT AS illegal, max(i) AS n FROM f GROUP BY conv_id),
step(q, r, z) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
more(q, z, k) AS (VALUES (0, 0, 0), (0, 2, 1), (0, 3, 2), (1, 1, 0), (1, 2, 1), (1, 3, 2), (2, 2, 0), (2, 3, 1), (3, 3, 0), (3, 2, 1)),
edit AS (SELECT conv_id, i, q, z, letter, price FROM (
    SELECT conv_id, i, q, q AS z, 'D' AS letter, 2 AS price FROM f, range(4) AS t(q)
    UNION ALL SELECT conv_id, i, q, z, 'K', CASE WHEN fault IS NULL THEN 0 ELSE 5 END FROM f JOIN step USING (r) WHERE coalesce(fault, '') NOT IN ('blank', 'duplicate')
    UNION ALL SELECT conv_id, i, q, z, 'R', CASE WHEN fault IS NULL THEN 1 ELSE 6 END FROM f, step WHERE step.r IN ('u', 'a') AND coalesce(fault, '') NOT IN ('blank', 'duplicate'))),
best AS (
    SELECT conv_id, 0::BIGINT AS i, z AS q, 5 * k AS cost, repeat('I', k) AS audit FROM counts, more WHERE more.q = 0
    UNION ALL
    SELECT conv_id, i, q, w.cost, w.audit FROM (
        SELECT best.conv_id, best.i + 1 AS i, more.z AS q, min(struct_pack(cost := best.cost + price + 5 * k, audit := best.audit || letter || repeat('I', k))) AS w
        FROM best JOIN edit ON best.conv_id IS NOT DISTINCT FROM edit.conv_id AND edit.i = best.i + 1 AND edit.q = best.q JOIN more ON more.q = edit.z
        GROUP BY best.conv_id, best.i, more.z)),
won AS (SELECT conv_id, w.cost AS cost, w.audit AS audit FROM (SELECT best.conv_id, min(struct_pack(cost := cost, audit := audit)) AS w
    FROM best JOIN counts ON best.conv_id IS NOT DISTINCT FROM counts.conv_id AND best.i = counts.n WHERE q IN (0, 3) GROUP BY best.conv_id)),
letters AS (SELECT conv_id, pos, substr(audit, pos, 1) AS letter, length(replace(left(audit, pos), 'I', ''))::BIGINT AS i, length(replace(left(audit, pos), 'D', '')) AS m
    FROM won, range(1, length(audit) + 1) AS t(pos)),
said AS (SELECT l.conv_id, m, letter, role, text, first_value(letter = 'K' AND r = 's') OVER (PARTITION BY l.conv_id ORDER BY m) AS s
    FROM letters l LEFT JOIN f ON l.conv_id IS NOT DISTINCT FROM f.conv_id AND l.i = f.i AND letter <> 'I' WHERE letter <> 'D'),
whole AS (SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (m - s::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' ||
    CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY m) AS t FROM said GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
    coalesce(illegal, 0) AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN counts ON c.conv_id IS NOT DISTINCT FROM counts.conv_id
LEFT JOIN won ON c.conv_id IS NOT DISTINCT FROM won.conv_id LEFT JOIN whole ON c.conv_id IS NOT DISTINCT FROM whole.conv_id
"""


def op13_piece_spans(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    """Digests of every document's pieces, of their spans in its bytes and of the text they decode to."""
    path = model or public_tokenizers.path("piece_bpe_32k.model")
    return piece_spans.digests(read(spark, sf_dir, "documents"), path)


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_bpe_round_trip": op3_bpe_round_trip,
    "op4_chat_prefix_tree": op4_chat_prefix_tree,
    "op5_ogg_media": op5_ogg_media,
    "op6_warc_revisits": op6_warc_revisits,
    "op7_simhash_near_dedup": op7_simhash_near_dedup,
    "op8_kneser_ney_quality": op8_kneser_ney_quality,
    "op9_toxicity": op9_toxicity,
    "op10_license_scan": op10_license_scan,
    "op11_best_position": op11_best_position,
    "op12_turn_repair": op12_turn_repair,
    "op13_piece_spans": op13_piece_spans,
    "pipeline": corpus_pipeline.run,
}
ORACLE_SQL = {
    "op1_quality_rules": OP1_SQL,
    "op6_warc_revisits": OP6_SQL,
    "op11_best_position": OP11_SQL,
    "op12_turn_repair": OP12_SQL,
}
