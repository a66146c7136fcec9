"""The subpackage's named queries, each with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import fingerprints, html_extract, language_id, lexical_search, license_scan, line_dedup, mixing, oracles, order_minhash, packing, quality_classifier, quality_rules, sentencepiece_codec, vector_codes
from tidewell.llm.sqlx import small_batches
from tidewell.session import load, materialize


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    rest = line_dedup.dedup(docs, counts="told")
    return rest.select("doc_id", "told.n_lines", "told.n_dropped", "told.n_near", F.char_length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    ratios = materialize(quality_rules.fit_log_ratio(docs, quality_rules.trusted(load(spark, sf_dir, "labels"))), "llr")
    return quality_rules.apply_rules(docs, ratios)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").withColumn("held_out", language_id.held_out(4, 2))
    model = language_id.fit(docs.where(~F.col("held_out")))
    judged = language_id.identify(docs.select("doc_id", "held_out", "text"), model)
    return judged.select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    described = materialize(quality_classifier.with_statistics(docs).drop("text").withColumn("held_out", language_id.held_out(3, 1)), "stats")
    labels = load(spark, sf_dir, "labels").where(~language_id.held_out(3, 1))
    model = quality_classifier.fit(described, labels)
    scored = quality_classifier.score(described, model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    found = license_scan.scan(docs, license_scan.fit(docs))
    sure = F.filter("licenses", lambda x: x["confirmed"])
    return found.select(
        "doc_id", F.size("licenses").alias("n_found"), F.size(sure).alias("n_confirmed"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(sure, lambda x: x["family"]))), ",").alias("families"),
        F.array_join(F.transform(sure, lambda x: x["paragraph"].cast("string")), ",").alias("paragraphs"),
    )


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    coded = sentencepiece_codec.encode(docs)
    back = sentencepiece_codec.decoded(coded, F.col("pieces"))
    return coded.select("doc_id", F.size("pieces").alias("n_pieces"), F.xxhash64("pieces").alias("pieces_hash"), back.eqNullSafe(F.col("text")).alias("lossless"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(load(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"))
    return mixed.select("doc_id", "source", "lang", "mixed.topic", "mixed.n_tokens", F.round("mixed.p", 9).alias("p"), "mixed.kept")


def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(load(spark, sf_dir, "documents"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(load(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


def op10_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = order_minhash.classify(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return classes.select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("kept"), "n_links")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = load(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    return vector_codes.compress(vectors).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = materialize(lexical_search.item_terms(load(spark, sf_dir, "benchmark")), "items")
    index = materialize(lexical_search.postings(load(spark, sf_dir, "documents"), terms=asked), "postings")
    return lexical_search.search(index, asked).select(F.col("item").alias("item_id"), "rank", F.col("doc").alias("doc_id"), "score")


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut_up = materialize(packing.pieces(load(spark, sf_dir, "documents")), "pieces")
    return packing.pack(cut_up).select(F.col("doc").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: small_batches(f) for f in (
        op1_line_dedup, op2_quality_rules, op3_language_id, op4_license_scans, op5_sentencepiece, op6_mixing, op7_document_fingerprints, op8_quality_classifier, op9_html_extraction, op10_order_minhash,
        op11_vector_codes, op12_lexical_search, op13_packing,
    )} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    own = {"op11_vector_codes": oracles.vector_codes(), "op12_lexical_search": oracles.LEXICAL_SEARCH}
    return own if corpus_pipeline.ORACLE_SQL is None else own | {"pipeline": corpus_pipeline.ORACLE_SQL}
