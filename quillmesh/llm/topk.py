"""Exact top-k by inner product: exhaustive term-at-a-time accumulation over blocks.

Query blocks meet candidate blocks; both sizes are bounded, so a task's score arrays are too. In a block each dimension's
non-zero components are a posting list, and each query's non-zero components scatter their weighted postings into a dense
array of scores. A partition selection keeps each query's k best of the block, and the blocks' lists are merged.

Work grows with queries times candidates, as an exhaustive search must. Defined results: vectors that are null or hold null
or non-finite components, and rows with a null vec_id, take no part; rows that share a vec_id are the same row to a query of
that id, which asks with the least of their vectors, and candidates of their own to others; shorter vectors count as if filled up with zeros; components are
floor(scale * x) within 64-bit integers; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

QUERY_BLOCK, CANDIDATE_BLOCK = 8192, 32768
_TILE = (256, 2048)


def quantized(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, v): whole-number components of the vectors that take part."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    bad = F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    part = vectors.filter("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))
    return part.filter(~bad).select("vec_id", F.transform("x", lambda c: F.floor(c * scale)).alias("v"))


def _matrix(column: pa.ChunkedArray | pa.Array, width: int = 0) -> np.ndarray:
    """Rows of whole numbers, filled up with zeros to the longest."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes), max(width, int(sizes.max(initial=0)))), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def accumulate(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Scores of every query and candidate, dimension by dimension."""
    width = min(queries.shape[1], candidates.shape[1])
    top = int(np.abs(queries).max(initial=0)) * int(np.abs(candidates).max(initial=0)) * max(width, 1)
    kind = np.int32 if top < 1 << 31 else np.int64
    scores = np.zeros((len(queries), len(candidates)), kind)
    for d in range(width):
        asks, holds = np.flatnonzero(queries[:, d]), np.flatnonzero(candidates[:, d])
        if 2 * len(asks) > len(queries) and 2 * len(holds) > len(candidates):
            scores += queries[:, d, None].astype(kind) * candidates[None, :, d].astype(kind)
        elif len(asks) and len(holds):
            scores[np.ix_(asks, holds)] += queries[asks, d, None].astype(kind) * candidates[None, holds, d].astype(kind)
    return scores


def best(queries: np.ndarray, query_ids: np.ndarray, candidates: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Each query's k best candidates but itself, ties to smaller ids. Candidates come sorted by id."""
    for at in range(0, len(queries), _TILE[0]):
        some, names = queries[at : at + _TILE[0]], query_ids[at : at + _TILE[0]]
        lists: list[list] = [[] for _ in names]
        for to in range(0, len(candidates), _TILE[1]):
            part, own = candidates[to : to + _TILE[1]], ids[to : to + _TILE[1]]
            scores = accumulate(some, part)
            floor = np.partition(scores, -min(k + 1, scores.shape[1]), axis=1)[:, -min(k + 1, scores.shape[1])]
            for q, name in enumerate(names.tolist()):
                row = scores[q]
                over, ties = np.flatnonzero(row > floor[q]), np.flatnonzero(row == floor[q])
                # the query itself may be among them, perhaps in several rows, so k others are kept
                ties = ties[own[ties] != name][:k]
                over = over[own[over] != name]
                if len(over) + len(ties) < k:
                    over = np.flatnonzero(own != name)
                    over, ties = over[np.argsort(-row[over].astype(np.int64), kind="stable")[:k]], over[:0]
                lists[q].append((row[np.append(over, ties)].astype(np.int64), own[np.append(over, ties)]))
        for q, name in enumerate(names.tolist()):
            score, own = (np.concatenate(x) for x in zip(*lists[q], strict=True)) if lists[q] else (np.zeros(0, np.int64),) * 2
            first = np.lexsort((own, -score))[:k]
            yield name, score[first], own[first]


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of each row whose vec_id is divisible by `every`."""
    whole = quantized(vectors, scale)
    # repeated rows are counted first: no more than k of them can be among the k best
    whole = whole.groupBy("vec_id", "v").count().select("vec_id", "v", F.explode(F.sequence(F.lit(1), F.least("count", F.lit(k)))).alias("copy"))
    n_all, n_asked = whole.agg(F.count("*"), F.count_if(F.col("vec_id") % every == 0)).first()
    blocks, asks = max(1, math.ceil(n_all / CANDIDATE_BLOCK)), max(1, math.ceil(n_asked / QUERY_BLOCK))
    spot = lambda n: F.pmod(F.xxhash64("vec_id", "v"), F.lit(n)).cast("int")
    queries = whole.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    queries = queries.select("vec_id", "v", spot(asks).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("cb"))
    candidates = whole.select("vec_id", "v", spot(blocks).alias("cb"), F.explode(F.sequence(F.lit(0), F.lit(asks - 1))).alias("qb"))

    def search(q: pa.Table, c: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if q.num_rows and c.num_rows:
            order = np.argsort(c["vec_id"].to_numpy(), kind="stable")
            for name, score, own in best(_matrix(q["v"]), q["vec_id"].to_numpy(), _matrix(c["v"])[order], c["vec_id"].to_numpy()[order], k):
                out.append((np.full(len(own), name), own, score))
        q_, v_, s_ = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3
        return pa.table({"query_id": pa.array(q_, pa.int64()), "vec_id": pa.array(v_, pa.int64()), "score": pa.array(s_, pa.int64())})

    found = queries.groupBy("qb", "cb").cogroup(candidates.groupBy("qb", "cb")).applyInArrow(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
