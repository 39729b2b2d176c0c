"""The registered queries of the document operators: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridx.llm import html_extract, language_id, media, minhash_dedup, mixing, packing, quality_lm, quality_rules, suffix_dedup, tokens


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target and taken for every document."""
    return mixing.taken_words(_table(spark, sf_dir, "documents")).drop("source")


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every document."""
    found = minhash_dedup.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and digests of every document's payload and stored form, its place in the shards, and its header's metadata."""
    found = media.media_columns(_table(spark, sf_dir, "documents"))
    digests = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    return found.select(*digests, "digest", "shard", "offset", "length", "width", "height", "bits")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred and score for every document."""
    docs = _table(spark, sf_dir, "documents")
    found = language_id.identify(docs, language_id.train(docs))
    return found.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 for every document."""
    found = suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text and n_chars of every page's main text."""
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit for every document: the last entry of its prefix table."""
    found = tokens.token_prefixes(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the measures, base_failed and kept for every document."""
    return quality_rules.measure(_table(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, perplexity, threshold and kept for every document; trusted are those labelled as of quality."""
    trusted = _table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return quality_lm.classify(_table(spark, sf_dir, "documents"), trusted)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per piece of every document: its tokens' place in a sequence and their checksum."""
    return packing.pack(_table(spark, sf_dir, "documents"))


def media_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can recompute of op3: sizes, the digest of the payload read back, and the header's metadata."""
    return op3_media_columns(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "width", "height", "bits")


def packed_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: documents packed, documents with a gap or an overlap in their pieces, sequences with one or overfull."""
    rows = op10_best_fit_packing(spark, sf_dir)
    spans = rows.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max(F.col("start") + F.col("length")).alias("end"), F.count("*").alias("pieces"), F.max("piece").alias("last"))
    documents = spans.agg(F.count("*").alias("documents"), F.count_if((F.col("n") != F.col("end")) | (F.col("pieces") != F.col("last") + 1) | (F.col("pieces") != F.ceil(F.col("n") / packing.LENGTH))).alias("torn"))
    places = rows.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"), F.count_distinct("offset").alias("places"), F.count("*").alias("pieces"))
    sequences = places.agg(F.count_if((F.col("n") != F.col("end")) | (F.col("places") != F.col("pieces")) | (F.col("n") > packing.LENGTH)).alias("wrong"))
    return documents.select("*", F.lit(1).alias("one")).join(sequences.select("*", F.lit(1).alias("one")), "one").drop("one")


QUERIES = {
    f.__name__: f
    for f in (
        op1_mix_sources,
        op2_near_dedup,
        op3_media_columns,
        op4_language_id,
        op5_suffix_dedup,
        op6_html_extract,
        op7_token_counts,
        op8_quality_rules,
        op9_quality_classifier,
        op10_best_fit_packing,
        media_payloads,
        packed_sequences,
    )
}
SQL = {
    "op1_mix_sources": mixing.SQL,
    "op2_near_dedup": minhash_dedup.SQL,
    "op5_suffix_dedup": suffix_dedup.SQL,
    "op8_quality_rules": quality_rules.SQL,
    "media_payloads": """
WITH d AS (
  SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents
), p AS (
  SELECT doc_id, octet_length(b) AS n, unhex(hex(b) || repeat('00', CASE WHEN octet_length(b) = 0 THEN 64 ELSE (64 - octet_length(b) % 64) % 64 END)) AS q FROM d
)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(octet_length(q) AS BIGINT) AS payload_bytes, sha256(q) AS payload_sha256, 64 AS width, CAST(octet_length(q) // 64 AS INTEGER) AS height, 8 AS bits FROM p
""",
    "packed_sequences": "SELECT count(*) AS documents, CAST(0 AS BIGINT) AS torn, CAST(0 AS BIGINT) AS wrong FROM documents",
}
