"""The corpus pipeline: language ID, line dedup, SimHash near-dedup, best-fit packing, each over all that the one before kept.

Every stage but the last returns the columns of documents. Rows that share a doc_id and a text stay or go together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm import langid, linededup, packing, simhash
from quillmesh.llm.queries import CAPACITY, SEPARATOR, word_spec
from quillmesh.storage import drop_since, materialize, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those that are rejected go. lang is the language found."""
    out = langid.identify(docs, langid.fit(docs)).filter("not _qm_rejected")
    return out.withColumn("lang", F.col("_qm_lang")).select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that three or more share, but for the largest doc_id's. None goes: an emptied one meets near_dedup."""
    out = linededup.dedup_lines(docs, min_docs=3, min_chars=20)
    out = out.withColumn("text", F.when(F.col("_qm_dropped") == 0, F.col("text")).otherwise(F.col("_qm_kept")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, Jaccard similarity of 0.8 or more to the one that stays."""
    return simhash.keep_one(docs, words=5, radius=10, similarity=0.8).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every token piece in sequences of the production capacity."""
    return packing.pack(docs, word_spec(), CAPACITY, SEPARATOR)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("packing", pack)]

#: SQL expresses neither the character models nor best-fit packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs, mark = spark.read.parquet(f"{sf_dir}/documents.parquet"), written()
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name)
            drop_since(spark, mark)  # a stage's own tables and its input, once its output is written
    return docs
