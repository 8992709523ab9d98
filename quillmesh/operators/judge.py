"""Judges (L1-L29): a struct of verdicts for each prompt, null on failure, then a default that says pass or fail.

HeuristicJudge is a Column, ReplayJudge a join with recorded replies, HttpJudge a pool of requests in each task. A judge's
output is written before it is used twice: with materialize() it is paid for once and can't change.
"""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from quillmesh.functions.text import clean_response, parse_reply

#: What a failed judge stands for: it keeps (open) or drops (closed).
FAIL_OPEN, FAIL_CLOSED = "open", "closed"


@dataclass
class HeuristicJudge:
    """An expression over the row's own columns."""

    verdict: Column

    def replies(self, df: DataFrame, prompt: str, image: str | None = None) -> DataFrame:
        return df.withColumn("reply", F.to_json(self.verdict))


@dataclass
class ReplayJudge:
    """Recorded replies by the SHA-256 of their prompts: table (prompt_sha, reply)."""

    recorded: DataFrame

    def replies(self, df: DataFrame, prompt: str, image: str | None = None) -> DataFrame:
        known = self.recorded.groupBy("prompt_sha").agg(F.max("reply").alias("reply"))
        return df.withColumn("_sha", F.sha2(F.col(prompt), 256)).join(known.withColumnRenamed("prompt_sha", "_sha"), "_sha", "left").drop("_sha")


@dataclass
class HttpJudge:
    """A chat-completions endpoint; requests of a task run in a small pool, each tried a few times, and fail to null."""

    url: str
    model: str
    key: str = ""
    workers: int = 8
    tries: int = 3
    timeout: float = 120
    wait: float = 1
    options: dict = field(default_factory=dict)

    def _ask(self, text: str | None, image: str | None) -> str | None:
        if text is None:
            return None
        parts: list[dict] = [{"type": "image_url", "image_url": {"url": f"data:image/jpeg;base64,{image}"}}] if image else []
        content = [*parts, {"type": "text", "text": text}] if parts else text
        body = json.dumps({"model": self.model, "messages": [{"role": "user", "content": content}], **self.options}).encode()
        for k in range(self.tries):
            try:
                request = urllib.request.Request(self.url, body, {"Content-Type": "application/json", "Authorization": f"Bearer {self.key}"})
                with urllib.request.urlopen(request, timeout=self.timeout) as reply:
                    return json.load(reply)["choices"][0]["message"]["content"].strip()
            except (OSError, ValueError, KeyError, IndexError, TypeError, AttributeError):
                time.sleep(self.wait * (k + 1 < self.tries))
        return None

    def replies(self, df: DataFrame, prompt: str, image: str | None = None) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            with ThreadPoolExecutor(self.workers) as pool:
                for batch in batches:
                    texts = batch.column(batch.schema.get_field_index(prompt)).to_pylist()
                    pictures = batch.column(batch.schema.get_field_index(image)).to_pylist() if image else [None] * len(texts)
                    reply = pa.array(list(pool.map(self._ask, texts, pictures)), pa.string())
                    yield pa.RecordBatch.from_arrays([*batch.columns, reply], names=[*batch.schema.names, "reply"])

        return df.mapInArrow(run, StructType([*df.schema.fields, StructField("reply", StringType())]))


def judge(df: DataFrame, prompt: str, schema: str, backend, into: str = "verdict", image: str | None = None) -> DataFrame:
    """df with a struct column by the schema, null where the judge failed or its reply doesn't parse."""
    return backend.replies(df, prompt, image).withColumn(into, parse_reply(F.col("reply"), schema)).drop("reply")


def said(df: DataFrame, prompt: str, backend, into: str, image: str | None = None) -> DataFrame:
    """df with the judge's own words: what follows its thinking, without quotes around it; null where it failed."""
    return backend.replies(df, prompt, image).withColumn(into, F.btrim(clean_response(F.col("reply")), F.lit('"'))).drop("reply")


def passes(flag: Column, policy: str) -> Column:
    """A boolean verdict with the policy's default on failure."""
    return F.coalesce(flag, F.lit(policy == FAIL_OPEN))


def judged_branch(df: DataFrame, condition: Column, ask: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Only rows of the condition are asked; the others are joined on by union, as Python would run for all rows inside when()."""
    asked = F.coalesce(condition, F.lit(False))
    return ask(df.filter(asked)).unionByName(df.filter(~asked), allowMissingColumns=True)
