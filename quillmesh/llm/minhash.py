"""Document fingerprints by one-permutation MinHash with optimal densification and packed low-order bits.

Each word shingle is hashed once: its top bits choose a bin, the rest is its value, and a bin keeps its least value. An
empty bin copies the bin that a hash of (bin, attempt) names first among the filled ones. The low-order bits of the bins are
packed; the share of equal bins, corrected for chance agreement, estimates the Jaccard likeness of the shingle sets.

Words are ASCII-lower-cased and separated by ASCII white space; a text of fewer words is one shingle; one without words has
one shingle of its own, the empty one.

edited_pairs() pairs each document with the next by descending doc_id without one task that holds all: bounds from
approximate quantiles deal rows out in order, and the first row of each part is also dealt to the part before it. Texts
move once. Defined results: a null text is empty; rows that share a doc_id follow each other by text; null doc_ids come
last; a single document follows itself; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import Sink, rows
from quillmesh.llm.simhash import shingle_hashes

BINS, LOW_BITS, WORDS = 256, 8, 5
_ATTEMPTS = 4096


class MinHash:
    def __init__(self, bins: int = BINS, low_bits: int = LOW_BITS, words: int = WORDS, seed: int = 42):
        if bins & (bins - 1):
            raise ValueError("bins must be a power of two")
        self.bins, self.low_bits, self.words, self.seed = bins, low_bits, words, seed
        self.shift = np.uint64(64 - int(math.log2(bins)))
        # the bin that each attempt of an empty bin names, alike for all documents
        self.named = np.random.default_rng(seed).integers(0, bins, (_ATTEMPTS, bins))

    def bins_of(self, text: str) -> np.ndarray:
        """The low-order bits of each bin after densification."""
        least = np.full(self.bins, np.iinfo(np.uint64).max, np.uint64)
        some = False
        for hashes in shingle_hashes(text, self.words, self.seed):
            # a second mix, as one hash's top and low bits serve as bin and value
            bin_of = (hashes >> self.shift).astype(np.int64)
            np.minimum.at(least, bin_of, hashes & np.uint64((1 << int(self.shift)) - 1))
            some = True
        if not some:
            least[0] = 0
        filled = least != np.iinfo(np.uint64).max
        empty, source = np.flatnonzero(~filled), np.arange(self.bins)
        for attempt in range(_ATTEMPTS):
            if not len(empty):
                break
            named = self.named[attempt, empty]
            found = filled[named]
            source[empty[found]] = named[found]
            empty = empty[~found]
        source[empty] = np.flatnonzero(filled)[0]
        value = least[source] * np.uint64(0x9E3779B97F4A7C15)
        return (value >> np.uint64(64 - self.low_bits)).astype(np.uint16)

    def pack(self, bins: np.ndarray) -> str:
        """Hex digits of low_bits bits a bin."""
        return np.packbits(bins[:, None] >> np.arange(self.low_bits) & 1, bitorder="little").tobytes().hex()

    def unpack(self, packed: str) -> np.ndarray:
        bits = np.unpackbits(np.frombuffer(bytes.fromhex(packed), np.uint8), bitorder="little", count=self.bins * self.low_bits)
        return (bits.reshape(self.bins, self.low_bits).astype(np.uint16) << np.arange(self.low_bits, dtype=np.uint16)).sum(1, dtype=np.uint16)

    def likeness(self, a: np.ndarray, b: np.ndarray) -> float:
        """Jaccard likeness: equal bins over all, without those that low_bits bits have equal by chance."""
        chance = 0.5**self.low_bits
        return float(min(max(((a == b).mean() - chance) / (1 - chance), 0), 1))


def edited(text: str, following: str) -> str:
    """The last half replaced by as much of the beginning of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _ordered(docs: DataFrame, parts: int) -> tuple[DataFrame, list[int], dict[int, int]]:
    """docs with the part of each doc_id, parts by descending doc_id; each part's first doc_id and the part before it."""
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    keyed = docs.select(key.alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    asked = [k / parts for k in range(1, parts)]
    bounds = sorted(set((keyed.agg(F.percentile_approx("key", asked, max(10_000, 20 * parts))).first()[0] if asked else None) or []))
    # how many bounds are at or over the key, by blocks: a few dozen comparisons a row for thousands of bounds
    step = max(1, math.isqrt(len(bounds)))
    blocks = [bounds[k : k + step] for k in range(0, len(bounds), step)]
    if blocks:
        heads = F.array(*[F.lit(b[0]) for b in blocks])
        block = F.size(F.filter(heads, lambda h: h < F.col("key")))
        inside = F.array(*[F.array(*[F.lit(x) for x in b]) for b in blocks])
        below = F.when(block == 0, 0).otherwise((block - 1) * step + F.size(F.filter(F.get(inside, block - 1), lambda x: x < F.col("key"))))
        keyed = keyed.withColumn("part", F.lit(len(bounds)) - below)
    else:
        keyed = keyed.withColumn("part", F.lit(0))
    first = dict(keyed.groupBy("part").agg(F.max("key")).collect())  # a row a part
    present = sorted(first)
    before = {p: present[k - 1] for k, p in enumerate(present)}
    return keyed, [first.get(p) for p in range(len(bounds) + 1)], before


def edited_pairs(docs: DataFrame, parts: int | None = None, minhash: MinHash | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row of docs."""
    spark = docs.sparkSession
    minhash = minhash or MinHash()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed, first, before = _ordered(docs, parts or min(4 * tasks, 20_000))
    firsts = F.array(*[F.lit(x).cast("long") for x in first])
    earlier = F.array(*[F.lit(before.get(p)).cast("int") for p in range(len(first))])
    own = F.struct(F.col("part").alias("at"), F.lit(False).alias("ahead"))
    also = F.struct(F.get(earlier, F.col("part")).alias("at"), F.lit(True).alias("ahead"))
    dealt = keyed.withColumn("to", F.explode(F.when(F.get(firsts, F.col("part")) == F.col("key"), F.array(own, also)).otherwise(F.array(own))))
    dealt = dealt.select("to.at", "to.ahead", "key", "doc_id", "text").repartition(tasks, "at").sortWithinPartitions("at", "ahead", F.desc("key"), "text")
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), *((n, pa.string()) for n in ("edited_sha256", "fingerprint", "edited_fingerprint")), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink, held = Sink(schema, 1024), None
        for at, ahead, doc_id, text in rows(batches, "at", "ahead", "doc_id", "text"):
            if held and held[0] == at and not held[1]:
                bins = minhash.bins_of(text)
                _, _, held_id, held_text, held_bins = held
                changed = edited(held_text, text)
                changed_bins = minhash.bins_of(changed)
                if sink.add(held_id, len(held_text), hashlib.sha256(changed.encode("utf-8")).hexdigest(), minhash.pack(held_bins), minhash.pack(changed_bins), minhash.likeness(held_bins, changed_bins), minhash.likeness(held_bins, bins)):
                    yield sink.batch()
                held = (at, ahead, doc_id, text, bins)
            elif not ahead:
                held = (at, ahead, doc_id, text, minhash.bins_of(text))
            else:
                held = (at, ahead, None, "", None)
        yield sink.batch()

    return dealt.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
