"""Line dedup: explode normalised lines, hash, count distinct documents per hash, drop lines over threshold, reassemble by position.

Native Spark throughout. A line's key is hashed to 128 bits and the hashes are written once; each task counts before the shuffle, so
a line of a third of all documents costs a few rows per task. Keys that have a thousandth of these lines or more are at most about
a thousand: they meet their lines by broadcast, all others by a shuffle in which none of them is hot. Texts move once, to meet the positions that go.

Defined results: a null or empty text is one empty line; rows that share a doc_id count as one document, each keeps its
own text; rows with a null doc_id are neither counted nor changed; no rows give no rows; other columns pass through, names that
begin with _qm_ are taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import SPACES, join_counted
from quillmesh.storage import materialize

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def line_key(line: Column) -> Column:
    """Stripped of ASCII white space, A-Z lower-cased and nothing else."""
    bare = F.btrim(line, F.lit(SPACES))
    return F.when(F.length(bare) == F.octet_length(bare), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _UPPER.lower()))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def dedup_lines(docs: DataFrame, min_docs: int = 3, min_chars: int = 20) -> DataFrame:
    """docs with _qm_n_lines, _qm_dropped and _qm_kept: lines before, lines dropped, and the text that stays.

    A key of at least min_chars code points in at least min_docs documents stays only in the largest doc_id that has it.
    """
    base = docs.select(F.col("doc_id").alias("_qm_id"), F.xxhash64("text").alias("_qm_text_hash"), F.col("text").alias("_qm_text"))
    lines = base.filter("_qm_id is not null").select("_qm_id", "_qm_text_hash", F.posexplode(_lines(F.col("_qm_text"))).alias("_qm_at", "_qm_line"))
    lines = lines.select("_qm_id", "_qm_text_hash", "_qm_at", line_key(F.col("_qm_line")).alias("_qm_key")).filter(F.length("_qm_key") >= min_chars)
    lines = lines.select("_qm_id", "_qm_text_hash", "_qm_at", F.xxhash64("_qm_key").alias("_qm_h1"), F.xxhash64(F.lit(1), "_qm_key").alias("_qm_h2"))
    lines, hashes = materialize(lines, "lines"), ["_qm_h1", "_qm_h2"]
    # a key's lines in a document first, so that distinct documents need no second set of keys
    often = lines.groupBy(*hashes, "_qm_id").agg(F.count("*").alias("_qm_n")).groupBy(*hashes)
    often = often.agg(F.count("*").alias("_qm_docs"), F.sum("_qm_n").alias("_qm_n"), F.max("_qm_id").alias("_qm_stays"))
    often = materialize(often.filter(F.col("_qm_docs") >= min_docs), "often")
    total = often.agg(F.sum("_qm_n")).first()[0] or 0
    gone = join_counted(lines, often, hashes, total, "_qm_stays", "_qm_n").filter("_qm_id != _qm_stays")
    gone = gone.groupBy("_qm_id", "_qm_text_hash").agg(F.collect_set("_qm_at").alias("_qm_gone"))
    gone = gone.withColumnsRenamed({"_qm_id": "_qm_gone_id", "_qm_text_hash": "_qm_gone_hash"})
    both = docs.join(gone, (docs["doc_id"] == gone["_qm_gone_id"]) & (F.xxhash64(docs["text"]) == gone["_qm_gone_hash"]), "left")
    split, text = _lines(F.col("text")), F.coalesce(F.col("text"), F.lit(""))
    both = both.withColumn("_qm_n_lines", F.size(split).cast("long")).withColumn("_qm_dropped", F.coalesce(F.size("_qm_gone"), F.lit(0)).cast("long"))
    stay = F.array_except(F.sequence(F.lit(0), F.col("_qm_n_lines").cast("int") - 1), F.col("_qm_gone"))
    # The outer transform binds the split lines, which are then not split anew for each position.
    joined = F.get(F.transform(F.array(split), lambda lines: F.array_join(F.transform(stay, lambda p: F.get(lines, p)), "\n")), 0)
    kept = F.when(F.col("_qm_gone").isNull(), text).otherwise(joined)
    return both.withColumn("_qm_kept", kept).drop("_qm_gone_id", "_qm_gone_hash", "_qm_gone")
