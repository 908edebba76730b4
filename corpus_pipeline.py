"""A training corpus from the documents table: five stages, each an operator of ``ridgeline.llm``.

``run`` applies the stages to ``documents``; each stage's rows are written as Parquet below the shared folder
and read again as the next stage's documents.  All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm import decontamination, linededup, neardup, packing, quality
from ridgeline.llm.kernels import unused
from ridgeline.llm.storage import Scratch, discarded


def _as_documents(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of documents, with the character count of the texts as they are now."""
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(*docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled documents and keeps those whose score reaches the threshold.

    Documents without text go: there is nothing to judge.  Without usable labels of both kinds nothing is rejected.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    sample = quality.training_rows(docs, labels, F.lit(True))
    inked = docs.where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if len({label for _, label in sample}) < 2:
        return inked
    (score,) = unused(docs, "score")
    scored = quality.score_documents(inked, quality.train(sample), keep=tuple(c for c in docs.columns if c != "doc_id"), score_col=score)
    return scored.where(F.col(score) >= quality.THRESHOLD).select(*docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines that repeat another one of the corpus; a document left without any text goes."""
    done = linededup.drop_repeated_lines(docs, linededup.repeated_lines(docs))
    return _as_documents(done.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")), docs)


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8) stays: that of the smallest id.

    Rows without an id stay, and rows of one id stay or go together.
    """
    gone = neardup.near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts benchmark passages out; a document that is mostly benchmark text, or has nothing else, goes."""
    clean = decontamination.remove_spans(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _as_documents(clean.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")), docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deals the documents into token-budget batches of length buckets."""
    return packing.pack(docs)


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_dedup_stage),
    ("near_dup", near_dup_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: The stages train a model and hash texts, which SQL can't express; tests/llm tests the operators against plain versions, run() itself only for whole and single rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; an empty table of documents gives none.

    Stages accept nulls in any column, empty and long texts, repeated rows and further columns, which all stages
    but the last pass on.  A stage's tables are deleted when the next one's rows are written.
    """
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before = docs
        with discarded():
            docs = scratch.write(stage(spark, before, sf_dir), name)
        scratch.drop(before)
    return docs
