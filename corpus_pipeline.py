"""From raw documents to packed token sequences, by four operators of the llm subpackage.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept. All but the last return the
columns of docs; the last returns the pieces of the packed sequences.

Null and empty texts fail the quality rules and go; an empty table goes through as one. Rows with equal keys share one verdict of each stage; rows that
agree in key and text are one document to them, so they stay or go together. Null keys are documents of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drivelake.llm.common import dropped, stored, work_folder
from drivelake.llm.lines import dedup_lines
from drivelake.llm.near_dup import near_duplicates
from drivelake.llm.packing import pack_documents
from drivelake.llm.quality import keep_good


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weighed rules accept."""
    return keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier one has; those with no line left go."""
    out = dedup_lines(docs, drop_emptied=True).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group that shares eight in ten shingles of five words, directly or over others."""
    copies = near_duplicates(docs, words=5, percent=80).filter("NOT kept").select("doc_id").distinct()
    return docs.join(copies, "doc_id", "left_anti").select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 ids, with their ids."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("minhash_near_dedup", near_dedup), ("packing", packing)]

#: SQL can't express the tokenizer, the expectation-maximisation or the packing order.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; each result but the last is written and read again, and dropped when the next one is written."""
    docs, work = spark.read.parquet(f"{sf_dir}/documents.parquet"), work_folder(spark)
    for i, (name, stage) in enumerate(STAGES[:-1]):
        docs = stored(stage(spark, docs, sf_dir), work, name)
        if i:
            dropped(spark, work, STAGES[i - 1][0])
    return STAGES[-1][1](spark, docs, sf_dir)
