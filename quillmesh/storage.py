"""Tables that cut lineage, written where every executor can read them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
#: The tables written so far, in order.
_WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset, a temporary one, in local mode only."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="quillmesh-")
    return _OWN[app]


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: a lost executor loses nothing of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillmesh/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(conf).delete(at, True)


def written() -> int:
    """How many tables have been written so far."""
    return len(_WRITTEN)


def drop_since(spark: SparkSession, mark: int) -> None:
    """Delete the tables written since written() gave mark, but for the last: what it was made from is no longer needed."""
    for path in _WRITTEN[mark:-1]:
        _delete(spark, path)
    del _WRITTEN[mark:-1]


def cleanup(spark: SparkSession) -> None:
    """Delete every table that materialize() wrote; results that still read them become invalid."""
    _delete(spark, f"{shared_dir(spark)}/quillmesh")
    _WRITTEN.clear()
