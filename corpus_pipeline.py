"""The corpus pipeline: quality, language, near-duplicates, packing; each stage's table is the next one's input."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treespark.llm import langid, packing, quality, shingles
from treespark.llm.common import shared_dir, small_side, written

#: No SQL form: the stages learn models, hash with XXH64 and tokenize.
ORACLE_SQL = None
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
MIN_LANGUAGE_SCORE = 0.5
#: Up to so many groups or rows are broadcast (24 bytes each); beyond, Spark shuffles.
MAX_BROADCAST_IDS = 1_000_000


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the quality classifier accepts."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.score_quality(docs.select(*COLUMNS), labels).where("quality_keep").select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents with a language: a letter, and a posterior of MIN_LANGUAGE_SCORE at least."""
    judged = langid.predict(docs.select(*COLUMNS), langid.train(docs))
    return judged.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_LANGUAGE_SCORE)).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the smallest doc_id of each group of near copies (five-word shingles, similarity 0.8 or more; candidates by SimHash within 2 bits, and by bands of min-hashes beyond), and of
    repeated rows of that id one; rows without an id stay."""
    docs = docs.select(*COLUMNS)
    rows = written(shingles.near_groups(docs).where("doc_id is not null"), "groups")
    firsts = rows.groupBy("group").agg(F.min(F.struct("doc_id", "text_id")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    grouped = written(rows.join(small_side(written(firsts, "firsts"), MAX_BROADCAST_IDS), "group"), "grouped")
    kept = F.struct("doc_id", "text_id") == F.col("first")
    gone = written(grouped.where(~kept).select("doc_id", "text_id").distinct(), "gone")
    key = [F.col("doc_id").eqNullSafe(F.col("_doc_id")), shingles.text_id().eqNullSafe(F.col("_text_id"))]
    named = lambda ids: small_side(ids, MAX_BROADCAST_IDS).toDF("_doc_id", "_text_id")
    left = docs.join(named(gone), key, "left_anti")
    twice = written(grouped.where(kept).groupBy("doc_id", "text_id").count().where("count > 1").select("doc_id", "text_id"), "twice")
    if twice.isEmpty():
        return left
    again = left.join(named(twice), key, "left_semi").groupBy("doc_id", shingles.text_id()).agg(F.min_by(F.struct(*COLUMNS), F.xxhash64(*COLUMNS)).alias("row"))
    return left.join(named(twice), key, "left_anti").unionByName(again.select(*[F.col(f"row.{c}").alias(c) for c in COLUMNS]))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row a token piece, with its sequence and place."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("language ID", language_id),
    ("SimHash near-dedup", near_dedup),
    ("best-fit packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over documents; each result is written as Parquet in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        path = f"{shared_dir(spark)}/treespark/stage-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
