"""A corpus from raw documents to packed sequences: five stages, each one of the numbered operators.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept.
Between stages the documents are written as Parquet to the folder that the
cluster's machines share, and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandbase.llm.decontaminate import clean_documents
from strandbase.llm.linededup import dedup_lines, report_names
from strandbase.llm.packing import pack
from strandbase.llm.quality import keep_good
from strandbase.llm.shared import materialise, read_table
from strandbase.llm.simhash import keep_one


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps: good and not toxic."""
    return keep_good(docs, read_table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat earlier ones; a document all of whose text is such lines goes."""
    removed = F.col(report_names(docs.columns, "__line_")["n_removed"])
    cut = dedup_lines(docs, prefix="__line_").where((removed == 0) | (F.trim("text") != "") | F.col("text").isNull())
    changed = F.when(removed > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return cut.select(*(changed.alias(c) if c == "n_chars" else c for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    return clean_documents(docs, read_table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in their sequences."""
    return pack(docs, with_ids=False)


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("packing", packing)]

#: The first stage fits a model, which SQL can't; tests/llm has brute-force versions of all stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``: the rows of the last."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
