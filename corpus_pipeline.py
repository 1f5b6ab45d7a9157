"""From raw documents to packed training sequences. Each stage takes what its predecessor kept, as a table.

All stages take texts of any length whole, judge repeated rows each for itself unless it is said otherwise, keep all columns
but the last, whatever their names, and give an empty table for an empty one. What null ids and texts, empty texts and ties
give is said with each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from readloom.llm.decontam import remove_contaminated
from readloom.llm.labelled import labelled_sample
from readloom.llm.neardup import without_near_duplicates
from readloom.llm.packing import pack
from readloom.llm.quality import drawn_documents
from readloom.llm.queries import tokenizer_path
from readloom.llm.secret_scan import redact
from readloom.llm.shared import written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are drawn by importance; the others go. Null and empty texts have weight 1, which good documents exceed
    and junk doesn't reach: they stay unless few documents are drawn. Equal sums are told apart by doc_id, null first."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return drawn_documents(docs, labelled_sample(docs, labels, "quality"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest doc_id. Null and empty texts, and rows with a null
    doc_id, are linked with nothing and stay. Of rows that share a doc_id, that of the smallest text stays."""
    return without_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item. Null and empty texts contain none; items with a null id or without words are
    in nothing. Each row is judged by its own text, so there are no ties, and null ids don't matter."""
    return remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked and n_chars set anew. Null and empty texts stay as they are (n_chars null and 0);
    overlapping spans are masked as one; null ids don't matter."""
    masked = redact(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else masked


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences, with their tokens. A null or empty text is one piece, of the end id; a null doc_id
    stays null; the order is the table's, so there are no ties."""
    return pack(docs, tokenizer_path())


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secrets), ("packing", packing)]

#: The stages train models and tokenize, which SQL can't express; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
