"""A corpus pipeline: documents pass through five of the operators, each on all that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of ``documents``. ``run`` writes each stage's result to the shared folder and reads it for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewall.llm import _io, line_dedup, near_dedup, packing, pii, quality, tokens
from sievewall.llm.queries import BPE, heavy


def _counted(docs: DataFrame) -> DataFrame:
    """``docs`` with n_chars as the text has now."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is at least 0.7; those that the classifier rejects go."""
    return quality.keep(docs, quality.train(docs, _io.table(spark, sf_dir, "labels")))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat, exactly or nearly, an earlier line; no document goes."""
    return _counted(line_dedup.drop_lines(docs))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the least id."""
    gone = near_dedup.near_duplicates(docs, k=5).where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind in brackets."""
    return _counted(pii.redact(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document, with its place in a training sequence."""
    return packing.pack(docs, tokens.public_path(BPE))


STAGES = [("quality", quality_stage), ("line_dedup", line_stage), ("near_dedup", near_stage), ("pii", pii_stage), ("packing", packing_stage)]

#: Scores, near copies and places in sequences aren't for SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. What a stage wrote for itself goes when its result is written, and each result when the next one is."""
    docs, before = heavy(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with _io.scope():
            docs = _io.materialize(stage(spark, docs, sf_dir), name, keep=True)
        if before is not None:
            _io.discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
