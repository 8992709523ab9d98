"""Files (S1-S12, K1-K7, B2): corpus and stage tables in JSON, images, answers, lists, metrics, reports."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.functions.text import truthy
from quillmesh.schemas import ANSWERS, BENCHMARK, CORPUS
from quillmesh.storage import materialize


def _fs(spark: SparkSession, path: str):
    """The file system of a path, and the path as it knows it."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at, jvm


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a JSON array."""
    return spark.read.schema(CORPUS).option("multiLine", True).json(path)


def layouts_of(docs: DataFrame) -> DataFrame:
    """A row per layout, keyed (doc_id, layout_id)."""
    return docs.select("doc_id", "doc_name", F.inline("layouts"))


def doc_id_of_file(pattern: str = r"doc_?(\d+)[_.]") -> Column:
    """The document's number in the file's name, not in its folders'."""
    return F.regexp_extract(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), pattern, 1).try_cast("int")


def stage(spark: SparkSession, path: str, schema: str, glob: str = "doc*.json") -> DataFrame:
    """Per-document stage files; a missing document has no rows. doc_id comes from the file's name."""
    return spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", glob).json(path).select("*", doc_id_of_file().alias("file_doc_id"))


def selected(df: DataFrame, one: int | None = None, start: int = 0, end: int = 0, some: Iterable[int] = ()) -> DataFrame:
    """One document, a range whose end 0 means all, a list."""
    if one is not None:
        return df.filter(F.col("doc_id") == one)
    if some := list(some):
        df = df.filter(F.col("doc_id").isin(some))
    # Fixed value: the end that 0 stands for.
    return df.filter((F.col("doc_id") >= start) & (F.col("doc_id") < (end or 999_999))) if start or end else df


def benchmark(spark: SparkSession, path: str) -> DataFrame:
    """Questions with question_id; those without one are dropped, the last of a repeated one stays."""
    rows = spark.read.schema(BENCHMARK).option("multiLine", True).json(path)
    keyed = rows.withColumn("question_id", F.coalesce(truthy(F.col("mh_id")), truthy(F.col("sq_id")), truthy(F.col("sh_id")))).filter("question_id is not null")
    placed = keyed.select(F.struct(*keyed.columns).alias("row"), F.monotonically_increasing_id().alias("at"))
    last = placed.groupBy("row.doc_id", "row.question_id").agg(F.max_by("row", "at").alias("last"))
    return last.select("last.*")


# Fixed value: how answer files are named.
ANSWER_FILE = r"doc_\d+\.json"


def answer_dir(spark: SparkSession, root: str) -> str | None:
    """A system's folder if it holds an answer file itself, else the first of its subfolders by name that does."""
    fs, at, _ = _fs(spark, root)
    if not fs.exists(at):
        return None
    below = sorted((str(s.getPath().getName()), s) for s in fs.listStatus(at) if s.isDirectory())
    for path in [at, *(s.getPath() for _, s in below)]:
        if any(re.fullmatch(ANSWER_FILE, str(s.getPath().getName())) for s in fs.listStatus(path) if s.isFile()):
            return str(path.toString())
    return None


def answers(spark: SparkSession, root: str, system: str) -> DataFrame:
    """A system's answers, doc_<id>.json in its answer folder; cost files don't count. No folder, no rows."""
    at = answer_dir(spark, root)
    if at is None:
        return spark.createDataFrame([], ANSWERS).select(F.lit(system).alias("system"), F.lit(None).cast("int").alias("doc_id"), F.inline("results"))
    read = spark.read.schema(ANSWERS).option("multiLine", True).option("pathGlobFilter", "doc_[0-9]*.json").json(at)
    read = read.select(F.lit(system).alias("system"), doc_id_of_file(r"^doc_(\d+)\.json$").alias("doc_id"), F.inline("results"))
    return read.filter("doc_id is not null")


def doc_ids(spark: SparkSession, path: str) -> DataFrame:
    """One document's number a line."""
    return spark.read.text(path).select(F.trim("value").try_cast("int").alias("doc_id")).filter("doc_id is not null")


def images(spark: SparkSession, path: str) -> DataFrame:
    """name and base64 content of every image below a folder."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return read.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.base64("content").alias("image"))


def page_image_name(doc_name: Column, page_id: Column) -> Column:
    """Pages are named after the document: name_page.jpg."""
    return F.concat(F.replace(doc_name, F.lit(".pdf"), F.lit("")), F.lit("_"), page_id, F.lit(".jpg"))


def with_images(layouts: DataFrame, pictures: DataFrame) -> DataFrame:
    """A layout's own image, else its page's, else null."""
    keyed = layouts.withColumn("_own", F.element_at(F.split("image_path", "/"), -1)).withColumn("_page", page_image_name(F.col("doc_name"), F.col("page_id")))
    own = pictures.select(F.col("name").alias("_own"), F.col("image").alias("_own_image"))
    whole = pictures.select(F.col("name").alias("_page"), F.col("image").alias("_page_image"))
    out = keyed.join(own, "_own", "left").join(whole, "_page", "left")
    return out.withColumn("image", F.coalesce("_own_image", "_page_image")).drop("_own", "_page", "_own_image", "_page_image")


def existing_pages(layouts: DataFrame, pictures: DataFrame) -> DataFrame:
    """doc_id and page_id of the pages whose image there is."""
    pages = layouts.select("doc_id", "page_id", page_image_name(F.col("doc_name"), F.col("page_id")).alias("name")).distinct()
    return pages.join(pictures.select("name").distinct(), "name", "left_semi").select("doc_id", "page_id")


def _block_of(block: int) -> Column:
    return F.floor(F.col("doc_id") / block).cast("long").alias("doc_block")


def write_stage(df: DataFrame, path: str, block: int = 1000) -> None:
    """K1-K3 for many documents: a folder of JSON lines for each `block` numbers of documents. Only the documents at hand are replaced.

    Documents that a folder already has and that aren't at hand are written again with it.
    """
    spark = df.sparkSession
    fs, at, _ = _fs(spark, path)
    if fs.exists(at):
        old = read_stage(spark, path, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema if f.name != "doc_id"), df.schema["doc_id"].dataType.simpleString())
        touched = df.select(_block_of(block)).distinct()
        old = old.withColumn("doc_block", _block_of(block)).join(touched, "doc_block", "left_semi").join(df.select("doc_id").distinct(), "doc_id", "left_anti")
        df = df.unionByName(materialize(old.select(df.columns), "old"))
    out = df.withColumn("doc_block", _block_of(block)).repartition("doc_block")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("doc_block").json(path)


def read_stage(spark: SparkSession, path: str, schema: str, id_type: str = "bigint") -> DataFrame:
    """What write_stage() wrote."""
    return spark.read.schema(f"doc_id {id_type}, {schema}").option("pathGlobFilter", "*.json").json(f"{path}/doc_block=*")


def write_documents(df: DataFrame, path: str, name: str, order: list[str]) -> int:
    """K1-K5: a JSON array for each document in a file of its own, such as name = "doc{}_facts.json"; gives their number.

    For as many documents as files should be: the driver names a file for each. Other documents' files stay as they are.
    """
    spark = df.sparkSession
    columns = [c for c in df.columns if c != "doc_id"]
    rows = F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("_order"), F.struct(*columns).alias("row"))))
    files = df.groupBy("doc_id").agg(F.to_json(F.transform(rows, lambda r: r["row"]), {"ignoreNullFields": "false"}).alias("value"))
    aside = f"{path}/_written-{uuid.uuid4().hex}"
    files.write.partitionBy("doc_id").text(aside)
    fs, at, jvm = _fs(spark, aside)
    n = 0
    for folder in fs.listStatus(at):
        if folder.isDirectory():
            part = next(s.getPath() for s in fs.listStatus(folder.getPath()) if str(s.getPath().getName()).startswith("part-"))
            target = jvm.org.apache.hadoop.fs.Path(f"{path}/{name.format(str(folder.getPath().getName()).split('=', 1)[1])}")
            fs.delete(target, False)
            fs.rename(part, target)
            n += 1
    fs.delete(at, True)
    return n


def write_corpus(docs: DataFrame, path: str) -> None:
    """K2: a corpus in the place of the one that it was made from: written aside, then swapped."""
    spark = docs.sparkSession
    aside, old = f"{path}-{uuid.uuid4().hex}", f"{path}-old-{uuid.uuid4().hex}"
    docs.write.json(aside)
    fs, at, jvm = _fs(spark, path)
    if fs.exists(at):
        fs.rename(at, jvm.org.apache.hadoop.fs.Path(old))
    fs.rename(jvm.org.apache.hadoop.fs.Path(aside), at)
    fs.delete(jvm.org.apache.hadoop.fs.Path(old), True)


def split_by_verdict(df: DataFrame, column: str = "filter_result", passing: str = "pass") -> tuple[DataFrame, DataFrame]:
    """K3, K4: kept and rejected rows of one table; a null verdict is rejected."""
    kept = F.coalesce(F.col(column) == passing, F.lit(False))
    return df.filter(kept), df.filter(~kept)


def write_metrics(metrics: DataFrame, summary: DataFrame, path: str) -> None:
    """K5: a table of metrics by question and one of their summary; a later run reads them back as cached."""
    metrics.write.mode("overwrite").parquet(f"{path}/metrics")
    summary.orderBy("dim", "key", "metric").coalesce(1).write.mode("overwrite").json(f"{path}/summary")  # a row for each group and metric


def cached_metrics(spark: SparkSession, path: str) -> DataFrame | None:
    """The metrics of an earlier run, None if there is none."""
    fs, at, _ = _fs(spark, f"{path}/metrics/_SUCCESS")
    return spark.read.parquet(f"{path}/metrics") if fs.exists(at) else None


def report(summary: DataFrame) -> list[str]:
    """The summary as lines, groups by name."""
    rows = summary.orderBy("dim", "key", "metric").collect()  # a row for each group and metric
    return [f"{r['dim']:>14} {r['key'] or '-':<24} {r['metric']:<20} {r['mean']:.4f} ± {r['std']:.4f} (n={r['n']})" for r in rows]


def large_results(spark: SparkSession, path: str, least: int = 1024) -> DataFrame:
    """B2: result files over a size, per system (the folder below path)."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").load(path)
    return read.filter(F.col("length") > least).groupBy(F.element_at(F.split("path", "/"), -2).alias("system")).count()
