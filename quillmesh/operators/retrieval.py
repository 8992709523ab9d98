"""Retrieval (F12, J12, T4, L20): chunks, an offline embedding, exact cosine top-k in blocks."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmesh.functions.text import strip, text_or_empty

#: Queries and chunks that meet in a task at once.
QUERY_BLOCK, CHUNK_BLOCK = 2048, 16384


def rag_chunks(layouts: DataFrame) -> DataFrame:
    """text and image text of each text layout together, where there is any."""
    out = layouts.filter("modality = 'text'").withColumn("chunk", strip(F.concat_ws(" ", text_or_empty(F.col("text")), text_or_empty(F.col("ocr_text")))))
    return out.filter("chunk != ''").select("doc_id", "layout_id", "chunk")


def letter_counts(text: Column) -> Column:
    """L20h: the offline embedding, how often each letter a-z is in the text."""
    lower = F.lower(text)
    return F.array(*[(F.length(lower) - F.length(F.replace(lower, F.lit(c), F.lit("")))).cast("double") for c in "abcdefghijklmnopqrstuvwxyz"])


def _unit(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows divided by their norm plus 1e-9, filled up with zeros; sums run from the first component to the last."""
    out = np.zeros((len(column), width))
    for i, v in enumerate(column.to_pylist()):
        out[i, : len(v)] = v
    norm = np.zeros(len(out))
    for d in range(width):
        norm += out[:, d] * out[:, d]
    return out / (np.sqrt(norm) + 1e-9)[:, None]


def _nearest(q: pa.Table, c: pa.Table, k: int, step: int = 256) -> list[tuple]:
    """(query row, chunk row, similarity) of each query's k nearest chunks and those that rounding may put among them."""
    width = max((len(v) for t in (q, c) for v in t["v"].to_pylist()), default=0)
    asked, known = _unit(q["v"], width), _unit(c["v"], width)
    out = []
    for at in range(0, len(asked), step):
        rough = asked[at : at + step] @ known.T
        most = min(k, rough.shape[1])
        floor = np.partition(rough, -most, axis=1)[:, -most] - 1e-9
        row, col = np.nonzero(rough >= floor[:, None])
        exact = np.zeros(len(row))
        for d in range(width):  # the order of a plain sum, whatever the matrix product's
            exact += asked[at + row, d] * known[col, d]
        out.append((at + row, col, exact))
    return out


def cosine_topk(queries: DataFrame, chunks: DataFrame, k: int = 20, on: list[str] | None = None, skip_own: bool = False) -> DataFrame:
    """query_id, rank, chunk_id, sim of the k chunks nearest to each query, ties to the smaller chunk.

    queries: query_id, v; chunks: chunk_id, v; on: columns that both share and meet by, such as doc_id; skip_own: a query's own id is no
    chunk for it. Vectors are divided by their norm plus 1e-9; a row with a null vector takes no part. Blocks of queries meet blocks of
    chunks, all of a group's or of the tables'; a block's k nearest come out, never all pairs, and are merged.
    """
    on = list(on or [])
    queries, chunks = (df.filter("v is not null").withColumn("v", F.transform("v", lambda x: x.cast("double"))) for df in (queries, chunks))
    if on:
        parts = lambda df, size: df.groupBy(*on).agg(F.ceil(F.count("*") / size).cast("int").alias("n"))
        sizes = parts(queries, QUERY_BLOCK).withColumnRenamed("n", "_nq").join(parts(chunks, CHUNK_BLOCK).withColumnRenamed("n", "_nc"), on)
        queries, chunks = queries.join(sizes, on), chunks.join(sizes, on)
    else:
        n_queries, n_chunks = (max(1, math.ceil(df.count() / size)) for df, size in ((queries, QUERY_BLOCK), (chunks, CHUNK_BLOCK)))
        queries, chunks = (df.withColumn("_nq", F.lit(n_queries)).withColumn("_nc", F.lit(n_chunks)) for df in (queries, chunks))
    place = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    queries = queries.select(*on, "query_id", "v", place("query_id", "_nq").alias("_qb"), every("_nc").alias("_cb"))
    chunks = chunks.select(*on, "chunk_id", "v", place("chunk_id", "_nc").alias("_cb"), every("_nq").alias("_qb"))
    kinds = pa.schema([("query_at", pa.int64()), ("chunk_at", pa.int64()), ("sim", pa.float64())])

    def search(q: pa.Table, c: pa.Table) -> pa.Table:
        found = _nearest(q, c, k + skip_own) if q.num_rows and c.num_rows else []
        a, b, s = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"query_id": q["query_id"].take(pa.array(a)), "chunk_id": c["chunk_id"].take(pa.array(b)), "sim": pa.array(s, kinds.field("sim").type)})

    shape = f"query_id {queries.schema['query_id'].dataType.simpleString()}, chunk_id {chunks.schema['chunk_id'].dataType.simpleString()}, sim double"
    scored = queries.groupBy(*on, "_qb", "_cb").cogroup(chunks.groupBy(*on, "_qb", "_cb")).applyInArrow(search, shape)
    if skip_own:
        scored = scored.filter("query_id != chunk_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("sim"), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
