"""The corpus pipeline: five stages, each on all that its predecessor kept.

1. language: documents whose language is unknown or uncertain go.
2. line_dedup: repeated and nearly repeated lines go from all but their earliest
   place; a document that has no word left goes with its last line.
3. near_dedup: one document of each class of near duplicates stays.
4. mixing: documents are sampled so that sources, languages and topics have
   their target weights.
5. encode: pieces of each text, under merge-dropout.

Stages take odd rows as their operators do: null and empty texts are rejected by the
first stage; repeated rows keep the same lines, are one class of near duplicates and
draw one lot; of ties the smallest id stays; very long texts are read whole; an empty
table passes through all. All but the last stage return every column of their input,
whatever its name, and change none but ``text`` and ``n_chars``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import language_id, line_dedup, mixing, order_minhash, sentencepiece_codec
from tidewell.llm.sqlx import fresh, small_batches
from tidewell.session import load, materialize


@small_batches
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language_id.fit(docs.where(~language_id.held_out(4, 2)))
    lang, score = fresh(docs, "_lang"), fresh(docs, "_score")
    judged = language_id.identify(docs, model, lang_as=lang, score_as=score)
    return language_id.accepted(judged, lang_col=lang, score_col=score).select(docs.columns)


@small_batches
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    told = fresh(docs, "_told")
    rest = line_dedup.dedup(docs, counts=told)
    lost = F.col(told)["n_dropped"] > 0
    rest = rest.where(~lost | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        rest = rest.withColumn("n_chars", F.when(lost, F.char_length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return rest.select(docs.columns)


@small_batches
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return order_minhash.dedup(docs).select(docs.columns)


@small_batches
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    at = fresh(docs, "_mixed")
    return mixing.mix(docs, name=at).where(F.col(at)["kept"]).select(docs.columns)


@small_batches
def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    coded = sentencepiece_codec.encode(docs.select("doc_id", "lang", "source", "text"))
    return coded.select("doc_id", "lang", "source", F.size("pieces").alias("n_pieces"), "pieces")


STAGES = [("language", language), ("line_dedup", lines), ("near_dedup", near), ("mixing", mixture), ("encode", encoding)]

#: The stages are trained, iterated and sampled by hash; SQL does not express them. tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
