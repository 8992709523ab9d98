"""Token counts per section, by offset-mapped attribution.

A document is encoded once, whole. A byte-level vocabulary's tokens cover the text's bytes without gaps, so the running sum
of their lengths gives each token's span; an interval join puts spans into sections. A token that crosses a boundary is
allocated by an explicit rule: `majority` (the section with most of its bytes, the earlier on a tie), `start` or `end` (the
section of its first or last byte). The counts of a document's sections so add up to its tokens.

By default a section is a line with its line feed; fields are sections too, see field_counts(). Defined results: a null or
empty text is one section without tokens; every row is a document of its own, whatever its doc_id; other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import Sink, rows, spread

_READY: dict[tuple, ByteTokens] = {}
RULES = ("majority", "start", "end")


class ByteTokens:
    """A byte-level vocabulary: each token's id and length in bytes."""

    def __init__(self, ranks: str, pattern: str):
        import tiktoken

        pairs = [line.split() for line in ranks.splitlines() if line.strip()]
        known = {base64.b64decode(a): int(b) for a, b in pairs}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=known, special_tokens={})
        self.length = np.zeros(max(known.values()) + 1, np.int64)
        for token, rank in known.items():
            self.length[rank] = len(token)

    def ends(self, text: str) -> np.ndarray:
        """The byte after each token of the whole text."""
        return np.cumsum(self.length[np.array(self.encoding.encode_ordinary(text), np.int64)])


def allot(ends: np.ndarray, bounds: np.ndarray, rule: str = "majority") -> tuple[np.ndarray, np.ndarray]:
    """Tokens per section, and of those the ones that cross a boundary.

    ends: the byte after each token; bounds: the byte after each section, the last of which ends with the text.
    """
    starts = np.append(0, ends[:-1])
    first, last = np.searchsorted(bounds, starts, "right"), np.searchsorted(bounds, ends - 1, "right")
    to = {"start": first, "end": last, "majority": first.copy()}[rule]
    crossing = np.flatnonzero(first != last)
    if rule == "majority":
        for t in crossing.tolist():
            edges = np.clip(np.append(starts[t], bounds[first[t] : last[t] + 1]), starts[t], ends[t])
            to[t] = first[t] + int(np.diff(edges).argmax())
    return np.bincount(to, minlength=len(bounds)), np.bincount(to[crossing], minlength=len(bounds))


def line_bounds(raw: np.ndarray) -> np.ndarray:
    """The byte after each line, line feed included."""
    ends = np.flatnonzero(raw == 10) + 1
    return ends if len(ends) and ends[-1] == len(raw) else np.append(ends, len(raw))


def _tokens(shared) -> ByteTokens:
    if shared.value not in _READY:
        _READY[shared.value] = ByteTokens(*shared.value)
    return _READY[shared.value]


def section_counts(docs: DataFrame, ranks: str, pattern: str, rule: str = "majority", bounds: Callable[[np.ndarray], np.ndarray] = line_bounds) -> DataFrame:
    """doc_id, section, char_start, char_end, n_tokens, n_crossing: a row per section of each document.

    ranks: the vocabulary's lines of base64 token and rank; pattern: what splits text before its merges.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    shared = docs.sparkSession.sparkContext.broadcast((ranks, pattern))
    schema = pa.schema([("doc_id", pa.int64()), ("section", pa.int32()), *((n, pa.int64()) for n in ("char_start", "char_end", "n_tokens", "n_crossing"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens(shared)
        sink = Sink(schema, 20_000)
        for doc_id, text in rows(batches, "doc_id", "text"):
            if not text:
                if sink.add(doc_id, 0, 0, 0, 0, 0):
                    yield sink.batch()
                continue
            raw = np.frombuffer(text.encode("utf-8"), np.uint8)
            ends = bounds(raw)
            chars = np.append(0, np.cumsum(raw & 0xC0 != 0x80)[ends - 1])
            count, crossing = allot(tokens.ends(text), ends, rule)
            for section, values in enumerate(zip(chars[:-1].tolist(), chars[1:].tolist(), count.tolist(), crossing.tolist(), strict=True)):
                full = sink.add(doc_id, section, *values)
            if full:
                yield sink.batch()
        yield sink.batch()

    return spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))).mapInArrow(run, "doc_id long, section int, char_start long, char_end long, n_tokens long, n_crossing long")


def field_counts(table: DataFrame, key: str, fields: list[str], ranks: str, pattern: str, rule: str = "majority", joint: str = "\n") -> DataFrame:
    """The same for fields: they are joined to one text, encoded once, and each is a section with the joint after it.

    A null field is an empty section. doc_id holds the key column.
    """
    joined = F.concat_ws(joint, *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields])
    sizes = [F.octet_length(F.coalesce(F.col(f).cast("string"), F.lit(""))) for f in fields]
    shared = table.sparkSession.sparkContext.broadcast((ranks, pattern))
    schema = pa.schema([("doc_id", pa.int64()), ("field", pa.string()), ("n_tokens", pa.int64()), ("n_crossing", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, extra = _tokens(shared), len(joint.encode("utf-8"))
        sink = Sink(schema, 20_000)
        for doc_id, text, size in rows(batches, "doc_id", "text", "size"):
            ends = np.cumsum(np.array(size) + extra)
            ends[-1] -= extra
            count, crossing = allot(tokens.ends(text), ends, rule)
            for name, n, c in zip(fields, count.tolist(), crossing.tolist(), strict=True):
                full = sink.add(doc_id, name, n, c)
            if full:
                yield sink.batch()
        yield sink.batch()

    return table.select(F.col(key).cast("long").alias("doc_id"), joined.alias("text"), F.array(*sizes).alias("size")).mapInArrow(run, "doc_id long, field string, n_tokens long, n_crossing long")
