"""What the Arrow-batched operators share."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: [\x20\x09-\x0D], the ASCII white space on which bytes.split() splits too.
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
SPACES = " \t\n\x0b\x0c\r"


def rows(batches: Iterable[pa.RecordBatch], *names: str, step: int = 256) -> Iterator[tuple]:
    """Tuples of the named columns, a few hundred rows in Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            yield from zip(*(part.column(part.schema.get_field_index(n)).to_pylist() for n in names), strict=True)


def cuts(raw: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """Parts of about `size` bytes, cut at ASCII white space, so that words stay whole and long texts need little memory."""
    at = 0
    while len(raw) - at > size:
        found = _SPACE.search(raw, at + size)
        if not found:
            break
        yield raw[at : found.start()]
        at = found.end()
    yield raw[at:] if at else raw


#: A key with one of so many parts of all rows is hot; there are at most so many.
HOT_PARTS = 1024


def join_counted(rows_of: DataFrame, counted: DataFrame, on: list[str], total: int, value: str, n: str) -> DataFrame:
    """rows_of with counted's value, where counted has a row for each key with the number n of rows that have it, of `total`.

    Hot keys meet their rows by broadcast, at most HOT_PARTS rows; in the shuffle of the others no key is hot. A row without a key
    in counted gets a null.
    """
    is_hot = F.col(n) * HOT_PARTS >= total
    hot = counted.filter(is_hot).select(*on, F.col(value).alias("_qm_hot"))
    met = rows_of.join(F.broadcast(hot), on, "left")
    cold = met.filter("_qm_hot is null").drop("_qm_hot").join(counted.filter(~is_hot).select(*on, value), on, "left")
    return met.filter("_qm_hot is not null").withColumnRenamed("_qm_hot", value).unionByName(cold)


def spread(df: DataFrame) -> DataFrame:
    """df dealt anew if it is a plain scan of fewer parts than there are cores: a small table of one row group would keep one core busy.

    A larger table, and what comes out of a shuffle, is left as it is.
    """
    query, cores = df._jdf.queryExecution(), df.sparkSession.sparkContext.defaultParallelism
    if query.executedPlan().getClass().getSimpleName() == "AdaptiveSparkPlanExec" or query.toRdd().getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


class Sink:
    """Gathers output rows by column and gives Arrow batches of a schema."""

    def __init__(self, schema: pa.Schema, size: int = 4096):
        self.schema, self.size, self.columns = schema, size, [[] for _ in schema]

    def add(self, *values) -> bool:
        """True when it is time to give a batch."""
        for column, value in zip(self.columns, values, strict=True):
            column.append(value)
        return len(self.columns[0]) >= self.size

    def batch(self) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(self.columns, self.schema, strict=True)], schema=self.schema)
        self.columns = [[] for _ in self.schema]
        return out
