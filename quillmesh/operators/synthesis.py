"""Synthesis over many layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmesh.functions.text import clip, mentions_any
from quillmesh.operators.retrieval import cosine_topk
from quillmesh.operators.verdicts import BY_TEXT_RAG, PASS


def candidates(shared: DataFrame, least_layouts: int = 5, most: int = 20, appearances: int = 10, min_modalities: int = 1) -> DataFrame:
    """Named entities of many layouts, the most widespread of each document, with their first appearances."""
    order = Window.partitionBy("doc_id").orderBy(F.desc("num_layouts"), F.desc("cross_modal"), "canonical_name")
    wide = shared.filter(F.col("is_named_entity") & (F.col("num_layouts") >= least_layouts) & (F.size("modalities") >= min_modalities))
    return wide.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most).withColumn("appearances", F.slice("appearances", 1, appearances))


def facts(chosen: DataFrame, contents: DataFrame, pattern: str = "[a-z]{8,}") -> DataFrame:
    """L13h, P10: a fact for each appearance whose layout has the entity's name or an alias; its data points are what the pattern finds."""
    seen = chosen.select("doc_id", F.col("canonical_name").alias("entity"), F.concat(F.array("canonical_name"), "aliases").alias("names"), F.inline("appearances"))
    out = seen.join(contents.select("doc_id", "layout_id", "content"), ["doc_id", "layout_id"]).filter(mentions_any(F.col("content"), F.col("names"))).drop("names")
    return out.withColumn("data_points", F.array_sort(F.array_distinct(F.regexp_extract_all("content", F.lit(pattern), F.lit(0)))))


def dedup_facts(found: DataFrame) -> DataFrame:
    """Of facts with the same lower-cased data points the first by layout stays; empty ones all stay. fact_no counts an entity's."""
    key = F.array_sort(F.array_distinct(F.transform(F.coalesce("data_points", F.array().cast("array<string>")), F.lower)))
    same = Window.partitionBy("doc_id", "entity", "_key").orderBy("layout_id")
    rows = found.withColumn("_key", key).withColumn("_n", F.row_number().over(same)).filter("_n = 1 or size(_key) = 0")
    order = Window.partitionBy("doc_id", "entity").orderBy("layout_id")
    return rows.withColumn("fact_no", F.row_number().over(order)).drop("_key", "_n")


def enough_facts(rows: DataFrame, least: int = 3) -> DataFrame:
    """the facts of entities that have enough of them."""
    return rows.withColumn("num_facts", F.count("*").over(Window.partitionBy("doc_id", "entity"))).filter(F.col("num_facts") >= least)


def pattern_facts(patterns: DataFrame, known: DataFrame, least: int = 3) -> DataFrame:
    """Patterns with the facts that they require. Repeated and unknown ids count for validity; unknown ones then vanish.

    patterns: doc_id, entity, valid, required_ids; known: doc_id, entity, fact_no, layout_id, modality.
    """
    ok = patterns.filter(F.col("valid") & (F.size("required_ids") >= least))
    held = known.groupBy("doc_id", "entity").agg(F.array_sort(F.collect_list(F.struct("fact_no", "layout_id", "modality"))).alias("facts"))
    out = ok.join(held, ["doc_id", "entity"], "left")
    out = out.withColumn("required", F.coalesce(F.filter("facts", lambda f: F.array_contains("required_ids", f["fact_no"])), F.array().cast("array<struct<fact_no:int,layout_id:int,modality:string>>")))
    return out.withColumn("num_required", F.size("required_ids")).withColumn("modalities", F.array_sort(F.array_distinct(F.transform("required", lambda f: f["modality"])))).drop("facts")


def text_rag_verdicts(asked: DataFrame, chunks: DataFrame, embed, k: int = 20) -> DataFrame:
    """T4, L18h, F19: fails where the k chunks of the document nearest to the question already hold all that an answer cites.

    asked: doc_id, entity, question, points; chunks: doc_id, layout_id, chunk; embed: text to vector, of at most 7,000 characters (P12).
    Without chunks nothing is sufficient.
    """
    vector = lambda c: embed(clip(F.col(c), 7000)).alias("v")
    queries = asked.select("doc_id", F.struct("doc_id", "entity").alias("query_id"), vector("question"))
    found = cosine_topk(queries, chunks.select("doc_id", F.col("layout_id").alias("chunk_id"), vector("chunk")), k=k, on=["doc_id"])
    found = found.select(F.col("query_id.doc_id").alias("doc_id"), F.col("query_id.entity").alias("entity"), F.col("chunk_id").alias("layout_id"), "rank")
    told = found.join(chunks.select("doc_id", "layout_id", "chunk"), ["doc_id", "layout_id"]).groupBy("doc_id", "entity")
    top = told.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk"))), lambda x: x["chunk"]), "\n\n---\n\n").alias("context"), F.count("*").cast("int").alias("retrieved_n"))
    out = asked.join(top, ["doc_id", "entity"], "left").withColumn("retrieved_n", F.coalesce("retrieved_n", F.lit(0)))
    sufficient = F.col("context").isNotNull() & F.forall("points", lambda p: F.contains("context", p))
    return out.withColumn("sufficient", sufficient).withColumn("filter_result", F.when(sufficient, BY_TEXT_RAG).otherwise(PASS)).drop("context")
