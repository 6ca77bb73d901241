"""The queries of the training-data operators and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chatstream.llm import chat_examples, collocations, decontaminate, edit_fingerprint, html_templates, langid, minhash, pieces, pii, resampling, shards, warc, weak_quality
from chatstream.llm.common import read

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_html_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_templates.main_texts(read(spark, sf_dir, "pages"))


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    return langid.identify(documents, langid.fit(documents))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.marked(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    scorer = weak_quality.train(documents, read(spark, sf_dir, "labels"))
    return weak_quality.scored(documents.select("doc_id", "text"), scorer).select("doc_id", "low", "toxic", "kept")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.found_digest(read(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(read(spark, sf_dir, "pages"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"), words=2)


def op8_edit_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_fingerprint.fingerprints(read(spark, sf_dir, "documents"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded_digest(read(spark, sf_dir, "documents"), tokenizer_path())


def op10_chat_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    return chat_examples.formatted_digest(rows.unionByName(extra))


def op11_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard_documents(read(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_html_templates, op2_langid, op3_decontaminate, op4_quality, op5_pii, op6_warc, op7_minhash, op8_edit_fingerprints, op9_sentencepiece, op10_chat_examples, op11_histogram_shards, op12_collocations, op13_resampling)}

#: CRC-32 of the bytes of ``x`` (a column of hexadecimal text ``hex``), byte by byte over a table made from the polynomial.
_CRC = """
crc_table AS MATERIALIZED (
  SELECT list(c ORDER BY i) AS crc_of FROM (
    SELECT i, list_reduce([1, 2, 3, 4, 5, 6, 7, 8], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c
    FROM (SELECT range AS i FROM range(256)))),
crcs AS MATERIALIZED (
  SELECT x, xor(list_reduce(list_transform(regexp_extract_all(hex, '..'), lambda p: ('0x' || p)::BIGINT),
    lambda c, b: xor(c >> 8, crc_of[xor(c & 255, b) + 1]), 4294967295::BIGINT), 4294967295) AS crc
  FROM (SELECT x, hex(encode(x)) AS hex FROM crc_input), crc_table)"""

ORACLE: dict[str, str] = {
    "op10_chat_examples": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
c AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS told,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
    sum(length(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), chr(10), '&#10;'))
      + length(replace(replace(text, '&', '&amp;'), '<', '&lt;')) + 15) AS formatted_chars
  FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(told) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256,
  formatted_chars::BIGINT AS formatted_chars FROM c""",
    "op11_histogram_shards": rf"""
WITH crc_input AS (SELECT DISTINCT coalesce(text, '') AS x FROM documents), {_CRC},
d AS (
  SELECT doc_id, strlen(x) + 8 AS size, coalesce(crc, 0) AS text_crc32, ('0x' || substr(md5(x), 1, 15))::BIGINT AS u
  FROM (SELECT doc_id, coalesce(text, '') AS x FROM documents) JOIN crcs USING (x)),
s AS (
  SELECT *, sum(size) OVER (ORDER BY u, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) AS upto, sum(size) OVER (ORDER BY u) AS group_upto,
    sum(size) OVER () AS total FROM d),
ends AS (SELECT upto AS place, upto = group_upto AS whole, total FROM s UNION ALL SELECT 0, true, max(total) FROM s),
wanted AS (SELECT k, (k * total) // 24 AS target, floor(total * 0.01 / 24) AS tolerance FROM range(1, 24) r(k), (SELECT max(total) AS total FROM s)),
near AS (
  SELECT k, min(target) AS target, min(tolerance) AS tolerance, first(place ORDER BY abs(place - target), place) AS row_end,
    first(place ORDER BY abs(place - target), place) FILTER (whole) AS group_end FROM wanted, ends GROUP BY k),
cut AS (SELECT CASE WHEN abs(group_end - target) <= tolerance THEN group_end ELSE row_end END AS place FROM near),
placed AS (SELECT *, (SELECT count(*) FROM cut WHERE place <= upto - size) AS shard FROM s)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'bytes' AS law, shard::INT AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY u, doc_id NULLS FIRST) - 1 AS slot, NULL::INT AS grown_shard FROM placed""",
    "op12_collocations": r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') AS ws FROM pieces),
windows AS MATERIALIZED (SELECT lang, unnest(ws) AS w1, unnest(list_concat(ws[2:], [NULL])) AS w2, unnest(list_concat(ws[3:], [NULL, NULL])) AS w3 FROM words WHERE len(ws) > 0),
f AS MATERIALIZED (
  SELECT lang, [w1] AS p, 1 AS m, count(*) AS n FROM windows WHERE w1 IS NOT NULL GROUP BY lang, w1
  UNION ALL SELECT lang, [w1, w2], 2, count(*) FROM windows WHERE w2 IS NOT NULL GROUP BY lang, w1, w2
  UNION ALL SELECT lang, [w1, w2, w3], 3, count(*) FROM windows WHERE w3 IS NOT NULL GROUP BY lang, w1, w2, w3),
totals AS (SELECT lang, sum(n) AS n FROM f WHERE m = 1 GROUP BY lang),
cuts AS (
  SELECT c.lang, c.p, c.n AS a, k, l.n AS l, r.n AS r, (1000000::HUGEINT * c.n * c.n) // (l.n::HUGEINT * r.n) AS score
  FROM f c JOIN range(1, 3) k(k) ON k < c.m JOIN f l ON l.lang = c.lang AND l.p = c.p[1:k] JOIN f r ON r.lang = c.lang AND r.p = c.p[k + 1:]
  WHERE c.n >= 10),
lowest AS (
  SELECT lang, p, a, first(l ORDER BY score, k) AS l, first(r ORDER BY score, k) AS r, min(score) AS score FROM cuts GROUP BY lang, p, a),
longer AS (SELECT lang, unnest([p[1:2], p[2:3]]) AS p, n FROM f WHERE m = 3 AND n >= 10),
held AS (SELECT lang, p, max(n) AS longest FROM longer GROUP BY lang, p),
ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(p, ' ')) AS rank, array_to_string(p, ' ') AS phrase, a, l, r, score
  FROM lowest LEFT JOIN held USING (lang, p) WHERE longest IS NULL OR len(p) > 2 OR 100 * longest < 50 * a)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000""",
    "op13_resampling": rf"""
WITH words AS MATERIALIZED (
  SELECT source, doc_id, unnest(ws) AS x FROM (
    SELECT source, doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws
    FROM (SELECT 0 AS source, doc_id, text FROM documents UNION ALL SELECT 1, NULL, text FROM benchmark))),
crc_input AS (SELECT DISTINCT x FROM words), {_CRC},
found AS (SELECT source, doc_id, crc % 10000 AS bucket FROM words JOIN crcs USING (x)),
counts AS (SELECT bucket, count(*) FILTER (source = 0) AS s, count(*) FILTER (source = 1) AS t FROM found GROUP BY bucket),
totals AS (SELECT coalesce(sum(s), 0) AS all_s, coalesce(sum(t), 0) AS all_t FROM counts),
gains AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (all_s + 10000)::DOUBLE / ((s + 1)::DOUBLE * (all_t + 10000)::DOUBLE)))::BIGINT AS gain FROM counts, totals),
weights AS (SELECT doc_id, count(*) AS n_features, sum(gain) AS weight FROM found JOIN gains USING (bucket) WHERE source = 0 GROUP BY doc_id),
scored AS (
  SELECT d.doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln(
    (('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT::DOUBLE + 0.5) / 4294967296)))::BIGINT AS score
  FROM documents d LEFT JOIN weights USING (doc_id)),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight::BIGINT AS weight, score::BIGINT AS score,
  CASE WHEN rank <= 10 * (SELECT count(*) FROM ranked) // 100 THEN rank END AS rank FROM scored LEFT JOIN ranked USING (doc_id)""",
}
