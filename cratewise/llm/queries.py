"""The registered queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from cratewise.llm import align, audit, bpe, html, langid, licences, multiindex, packing, quality, simhash, suffix, topk, wordbpe
from cratewise.llm.inputs import held_out, language_model, quality_model, table
from cratewise.llm.vectors import usable


def op1_threshold_topk(spark: SparkSession, folder: str) -> DataFrame:
    vectors = usable(table(spark, folder, "embeddings")).select("vec_id", F.transform("embedding", lambda x: F.floor(x * 1024)).alias("vector"))
    return topk.search(vectors.where("vec_id % 100 = 0"), vectors, 10)


OP1_SQL = """
WITH v AS (
  SELECT vec_id, [floor(1024 * CAST(x AS DOUBLE)) FOR x IN embedding] AS vector FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.vector, c.vector) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 10
"""


def op3_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cut = suffix.remove_repeats(table(spark, folder, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op4_multi_index(spark: SparkSession, folder: str) -> DataFrame:
    vectors = usable(table(spark, folder, "embeddings"))
    return multiindex.search(vectors.where("vec_id % 20 = 0"), vectors, 20)


def op2_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return langid.identify(docs, language_model(spark, folder)).select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score", "spans")


def op7_licence_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Documents have no paths; they are filed by source, language and thousand of their id."""
    place = [F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), F.floor(F.col("doc_id") / 1000).cast("string"), F.col("doc_id").cast("string")]
    return licences.scan(table(spark, folder, "documents").select("doc_id", F.concat_ws("/", *place).alias("path"), "text"))


def op8_html_crf(spark: SparkSession, folder: str) -> DataFrame:
    model = html.fit(html.labelled_pages())
    return html.extract(table(spark, folder, "pages"), model).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op9_quality_fm(spark: SparkSession, folder: str) -> DataFrame:
    scored = quality.score(table(spark, folder, "documents"), quality_model(spark, folder))
    return scored.select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= quality.GOOD).cast("int").alias("predicted"))


def op5_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = bpe.encode(table(spark, folder, "documents"), path, public_tokenizers.PATTERN)
    decoded = bpe.decode(encoded, path, keep=[(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256")])
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


def op10_best_two_fit(spark: SparkSession, folder: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op11_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """One row a document: tokens, groups and links of its two tokenizations."""
    return align.align(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_speculative_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """One row a document: digests of its ids and of their decoded text."""
    path = public_tokenizers.path("word_bpe_49k.json")
    encoded = wordbpe.encode(table(spark, folder, "documents"), path)
    decoded = wordbpe.decode(encoded, path, keep=[(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256")])
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_source_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of the two parts of each (lang, source) group, ranked."""
    return audit.divergences(table(spark, folder, "documents")).select("lang", "source", "part", "item", "value", "rank")


OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), groups AS (SELECT DISTINCT lang, source FROM d),
seen AS (SELECT row, lang, source, unnest(terms) AS term FROM d),
per AS (SELECT row, lang, source, term, count(*) AS n FROM seen GROUP BY ALL),
kept AS (SELECT lang, term, CAST(sum(n) AS BIGINT) AS total FROM per GROUP BY lang, term HAVING count(*) >= 30),
size AS (SELECT lang, count(*) AS v, CAST(sum(total) AS BIGINT) AS n_lang FROM kept GROUP BY lang),
counted AS (SELECT lang, source, term, CAST(sum(n) AS BIGINT) AS n FROM per JOIN kept USING (lang, term) GROUP BY ALL),
filled AS (
  SELECT g.lang, g.source, k.term, k.total, coalesce(c.n, 0) AS n, sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS n_group
  FROM groups g JOIN kept k ON g.lang = k.lang LEFT JOIN counted c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), p AS (
  SELECT lang, source, term, n, 1 + CAST(1000000000 * (n + 5) AS HUGEINT) // (n_group + 5 * v) AS p, 1 + CAST(1000000000 * (total + 5) AS HUGEINT) // (n_lang + 5 * v) AS q
  FROM filled JOIN size USING (lang)
), apart AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
), high AS (SELECT lang, source, term AS item, CAST(p - q AS BIGINT) AS value FROM p WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item)) AS INTEGER) AS rank FROM pairs
UNION ALL
SELECT lang, source, 'term', item, value, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item)) AS INTEGER) AS rank FROM high) WHERE rank <= 50
"""


#: name -> (query, DuckDB SQL for the same rows or None)
QUERIES = {
    "op1_threshold_topk": (op1_threshold_topk, OP1_SQL),
    "op2_language_id": (op2_language_id, None),
    "op3_suffix_dedup": (op3_suffix_dedup, None),
    "op4_multi_index": (op4_multi_index, None),
    "op5_byte_bpe": (op5_byte_bpe, None),
    "op6_simhash_near_dedup": (op6_simhash_near_dedup, None),
    "op7_licence_scan": (op7_licence_scan, None),
    "op8_html_crf": (op8_html_crf, None),
    "op9_quality_fm": (op9_quality_fm, None),
    "op10_best_two_fit": (op10_best_two_fit, None),
    "op11_token_alignment": (op11_token_alignment, None),
    "op12_speculative_bpe": (op12_speculative_bpe, None),
    "op13_source_audit": (op13_source_audit, OP13_SQL),
    "pipeline": (corpus_pipeline.run, corpus_pipeline.ORACLE_SQL),
}
