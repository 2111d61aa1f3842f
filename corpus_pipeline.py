"""Corpus pipeline: toxicity, line dedup, near-dedup, decontamination, mixing, over the whole table of documents.

Each stage takes (spark, docs, sf_dir) and returns documents in the columns of the table; run() writes each stage's
result as Parquet into the shared folder and reads it again for the next. Every stage takes null ids, texts, languages
and sources, empty and very long texts, repeated rows, rows that share an id, and empty tables; columns beyond those of
the table are left out, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sketchmeans.llm.common import materialize, new_path, remove, scope
from sketchmeans.llm.decontaminate import decontaminate
from sketchmeans.llm.line_dedup import line_dedup
from sketchmeans.llm.minhash import near_duplicates
from sketchmeans.llm.mixing import mix
from sketchmeans.llm.toxicity import score, train

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
OTHERS = ("lang", "source", "n_chars")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the classifier doesn't call toxic; it learns from the labelled rows of its input.

    Each row is judged by its own text, so repeated rows go or stay together; a null text is judged as an empty one and
    stays null.
    """
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model, keep=OTHERS).where(F.col("predicted") == 0).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that ten or more share; n_chars counts the text that is left.

    Every row counts as one document. A null text becomes an empty one, and so does a text of shared lines alone.
    """
    return line_dedup(docs, keep=("lang", "source")).select("doc_id", "text", "lang", "source", F.char_length("text").cast("long").alias("n_chars"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest id.

    Rows of one id are one document: of these one row stays, that with the least hash (then text) of its values. Rows
    without id, and documents without words, have no duplicates and all stay.
    """
    found = near_duplicates(docs).select(F.col("doc_id").alias("id"), "kept").groupBy("id").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    found = materialize(found.where(F.col("kept")).select("id", F.when(F.col("id").isNull(), 1).otherwise(F.col("n")).alias("n")), "kept-ids")
    kept = docs.select(*COLUMNS).join(found, F.col("doc_id").eqNullSafe(F.col("id")))
    if found.where(F.col("n") > 1).isEmpty():
        return kept.select(*COLUMNS)
    row = F.struct(F.xxhash64(*COLUMNS), "text", "lang", "source", "n_chars")
    of_many = kept.where(F.col("n") > 1).groupBy("doc_id").agg(F.min(row).alias("row"))
    return kept.where(F.col("n") == 1).select(*COLUMNS).unionByName(of_many.select("doc_id", *[F.col(f"row.{c}").alias(c) for c in COLUMNS[1:]]))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that don't cover a benchmark item; each row is judged by its own text, a null or empty one stays."""
    out = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=OTHERS)
    return out.where(~F.col("contaminated")).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents drawn, with their topic, token count and probability.

    Null languages and sources are empty strings; rows of one id in one cell are drawn alike; documents of a cell without
    tokens stay.
    """
    out = mix(docs, keep=("text", "n_chars")).where(F.col("kept"))
    return out.select(*COLUMNS, "topic", "n_tokens", F.round("prob", 9).alias("prob"))


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", lines),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: The first stage is a trained network, which SQL can't express; tests/llm/test_pipeline.py holds every stage against
#: brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what a stage writes for itself goes once its result is written, and that once the next one's is."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        with scope(spark, f"stage-{name}"):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
