"""Views of the engine's inputs over plain tables: layouts and mentions out of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.functions.text import layout_content


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def layouts(spark: SparkSession, sf_dir: str, by_document: bool = False) -> DataFrame:
    """A layout per line, four a page; of five in turn one is a figure and one a table, whose line is the text in the image.

    by_document: documents are dealt by doc_id first, so that what follows by document, or by document and more, needs no other shuffle.
    """
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    lines = (docs.repartition("doc_id") if by_document else docs).select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("layout_id", "line"))
    turn = F.pmod(F.col("doc_id") + F.col("layout_id"), F.lit(5))
    out = lines.withColumn("modality", F.when(turn == 3, "figure").when(turn == 4, "table").otherwise("text"))
    out = out.withColumn("page_id", F.floor(F.col("layout_id") / 4).cast("int"))
    seen = F.col("modality") == "text"
    null = F.lit(None).cast("string")
    return out.select("doc_id", "layout_id", "page_id", "modality", F.when(seen, F.col("line")).alias("text"), F.when(~seen, F.col("line")).alias("ocr_text"), null.alias("vlm_text"), null.alias("caption"), null.alias("topic"))


def contents(spark: SparkSession, sf_dir: str, by_document: bool = True) -> DataFrame:
    """Layouts that say enough (F4), with their content."""
    return layouts(spark, sf_dir, by_document).withColumn("content", layout_content()).filter("content is not null")
