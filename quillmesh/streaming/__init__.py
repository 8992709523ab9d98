"""Addition: evaluation summaries over answers that arrive as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.operators.evaluation import partial_sums, summary_of


def answer_stream(spark: SparkSession, path: str, schema: str, files: int = 64) -> DataFrame:
    """A stream of Parquet files of scored answers."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def summarise_stream(scored: DataFrame, metric: list[str], dims: list[str], done_path: str, out_path: str, checkpoint: str):
    """Each batch adds the questions that the stream hasn't had yet to done_path, and their sums to those of earlier batches.

    The stream's own state knows the questions; a batch reads its own rows and a few sums an epoch, never the answers before it. A
    replayed batch writes the same epoch again.
    """

    def batch(df: DataFrame, epoch: int) -> None:
        spark = df.sparkSession
        df.write.mode("overwrite").parquet(f"{done_path}/epoch={epoch}")
        fresh = spark.read.schema(df.schema).parquet(f"{done_path}/epoch={epoch}")
        partial_sums(fresh, metric, dims).coalesce(1).write.mode("overwrite").parquet(f"{done_path}-sums/epoch={epoch}")
        sums = spark.read.parquet(f"{done_path}-sums").filter(F.col("epoch") <= epoch)
        summary_of(sums).write.mode("overwrite").parquet(f"{out_path}/epoch={epoch}")

    once = scored.dropDuplicates(["system", "question_id"])
    return once.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
