"""A training-corpus pipeline of five stages over ``documents``, each applying one operator of assayframe.llm.

Every stage takes and returns any rows of COLUMNS; other columns of its input, whatever their names, are left out. Any
column may be null. An empty table gives an empty table of the same columns. Repeated rows, and ties of doc_id, go
through all stages together: they are kept or dropped alike, as rows of one document. Texts are taken whole at any
length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayframe.llm import decontam, lines, near_dedup, packing, quality
from assayframe.llm.spark_io import discard, scratch, stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers of their language and source.

    A null or empty text has no words and goes; a null language or source is a group of its own.
    """
    return quality.quality(docs, carry=COLUMNS).where("kept").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines of recurring templates; n_chars follows the text.

    No row goes, a null text stays null, and a text may become empty. Near copies of each other stay whole, for the next
    stage to choose from. Where nothing is dropped n_chars stays, null too.
    """
    out = lines.line_dedup(docs)
    n_chars = F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", n_chars).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group linked by five-word shingles at a similarity of 0.8 or more.

    Null and empty texts are linked with nothing and stay; a row with a null doc_id is no group's first and stays too.
    """
    judged = near_dedup.near_duplicates(docs, shingle=5, percent=80)
    return docs.join(judged.where("NOT kept").select("doc_id").distinct(), "doc_id", "left_anti").select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark passages cover less than a twentieth of the words.

    Null and empty texts have no words and stay; an empty benchmark drops nothing.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontam.contamination(docs, items).where("NOT (n_hit > 0 AND 20 * n_hit >= n_words)").select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences of 2048 tokens; a null or empty text is one piece, its end id."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: Token ids are beyond SQL; tests/llm/test_pipeline.py holds the stages against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again by the next."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, step in STAGES[:-1]:
        with scratch() as keep:  # what a stage has stored goes when its result is written, and so does its input
            docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
            keep(docs)
        discard(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
