"""LM scoring by masked pseudo-likelihood: a bidirectional window network, trained in numpy, predicts every token from both sides.

A document's score is the sum over its words of log p(word | the `reach` words before and after it). The network adds the
context words' vectors, each scaled by a vector of its position, and reads a word off a two-level softmax: its class, then
its place in the class. The most frequent words are predicted one by one. All others share the places of the first class, and
within a place a word's share is that of its count over the whole corpus: log p(place | context) + log p(word | place). The
counts are kept by hashed buckets, whose number grows with the corpus up to `most_buckets`; beyond that words share buckets evenly.

Everything comes from all documents: counts of all words, and the weights from a pass in which each partition trains on
every position of its documents (masked there, as everywhere, by leaving the word out of its own context) and the partitions'
weights are averaged by the words they saw, along a tree of bounded fan-in. What is gathered grows with the input.
Partitions train one by one, so another split of the same rows gives slightly other weights and scores.

Defined results: a null or empty text has no word and a score of 0 (its mean is null); rows are scored each for itself,
whatever their doc_id; with no word at all every score is 0; other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import Sink, cuts, rows, spread
from quillmesh.storage import materialize

#: Classes and places in a class: the vocabulary has their product. The first class holds the edge of a text and hashed places.
CLASSES, PLACES = 64, 64
WIDTH, REACH = 16, 2
EDGE = 0
_BLOCKS = 16


def word_counts(docs: DataFrame, most: int = 300_000) -> DataFrame:
    """(word, n) over all documents; each task counts before the shuffle and holds at most `most` words at once."""
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for (text,) in rows(batches, "text"):
            for part in cuts((text or "").encode("utf-8").lower()):
                counts.update(part.split())
            if len(counts) > most:
                yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], schema=schema)
                counts.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], schema=schema)

    return spread(docs.select(F.col("text").cast("string").alias("text"))).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """What scoring needs: the words predicted one by one, the other words' log shares of their places by bucket, the weights."""

    known: list[bytes]
    rare: np.ndarray
    weights: np.ndarray


class _Numbers(dict):
    """Numbers of words; those that aren't known have the vocabulary's size and their bucket."""

    buckets = 1

    def __missing__(self, word: bytes) -> int:
        return CLASSES * PLACES + zlib.crc32(word) % self.buckets


class Words:
    """Word numbers: the most frequent have their own, the rest share the places of the first class by their buckets."""

    def __init__(self, known: list[bytes], rare: np.ndarray):
        self.number = _Numbers((w, k + PLACES) for k, w in enumerate(known))
        self.number.buckets, self.rare = len(rare), rare

    def raw(self, text: str) -> Iterator[np.ndarray]:
        """Numbers of a text's ASCII-lower-cased words, part by part."""
        for part in cuts(text.encode("utf-8").lower()):
            if words := part.split():
                yield np.fromiter(map(self.number.__getitem__, words), np.int32, len(words))

    @staticmethod
    def placed(numbers: np.ndarray) -> np.ndarray:
        """Numbers within the vocabulary's size."""
        bucket = numbers - CLASSES * PLACES
        return np.where(bucket < 0, numbers, 1 + bucket % (PLACES - 1))

    def of(self, text: str) -> Iterator[np.ndarray]:
        return map(self.placed, self.raw(text))

    def scored(self, text: str, extra: list[float]) -> Iterator[np.ndarray]:
        """Like of(); the log shares of the rare words go to extra, part by part."""
        for numbers in self.raw(text):
            bucket = numbers[numbers >= CLASSES * PLACES] - CLASSES * PLACES
            extra.append(float(self.rare[bucket].sum(dtype=np.float64)))
            yield self.placed(numbers)


class Network:
    """The weights, as arrays of fixed shapes."""

    SHAPES = {
        "embed": (CLASSES * PLACES, WIDTH), "side": (2 * REACH, WIDTH), "bias": (WIDTH,), "klass": (WIDTH, CLASSES),
        "klass_bias": (CLASSES,), "place": (CLASSES, WIDTH, PLACES), "place_bias": (CLASSES, PLACES),
    }

    def __init__(self, flat: np.ndarray | None = None, seed: int = 42):
        sizes = {n: int(np.prod(s)) for n, s in self.SHAPES.items()}
        if flat is None:
            draw = np.random.default_rng(seed)
            flat = np.concatenate([np.ones(sizes[n]) if n == "side" else draw.normal(0, 0.1, sizes[n]) if n in ("embed", "klass", "place") else np.zeros(sizes[n]) for n in sizes])
        self.flat = np.ascontiguousarray(flat, np.float32)
        self.part: dict[str, np.ndarray] = {}
        at = 0
        for name, shape in self.SHAPES.items():
            self.part[name] = self.flat[at : at + sizes[name]].reshape(shape)
            at += sizes[name]

    def _hidden(self, context: np.ndarray) -> np.ndarray:
        p = self.part
        x = np.broadcast_to(p["bias"], (len(context), WIDTH)).copy()
        for side in range(2 * REACH):
            x += p["embed"][context[:, side]] * p["side"][side]
        return np.tanh(x, out=x)

    @staticmethod
    def _bounded(weights: np.ndarray, bias: np.ndarray) -> bool:
        """Whether no hidden layer, whose values are within one, can give a logit whose exponential overflows or vanishes."""
        return float(np.abs(weights).max()) * WIDTH + float(np.abs(bias).max()) < 60

    @staticmethod
    def _exp(logits: np.ndarray, bounded: bool) -> tuple[np.ndarray, np.ndarray]:
        """Exponentials, in place, and their sums by row. A product with ones sums rows faster than a reduction does."""
        if not bounded:
            logits -= logits.max(1, keepdims=True)
        np.exp(logits, out=logits)
        return logits, logits @ np.ones(logits.shape[1], np.float32)

    def _classes(self, klass: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """The rows of each class that has some."""
        order = np.argsort(klass.astype(np.uint8), kind="stable")
        ends = np.cumsum(np.bincount(klass, minlength=CLASSES))
        for c, (s, e) in enumerate(zip(np.append(0, ends[:-1]).tolist(), ends.tolist(), strict=True)):
            if s < e:
                yield c, order[s:e]

    def log_probs(self, targets: np.ndarray, context: np.ndarray) -> np.ndarray:
        """log p(target | context) of each row."""
        p, hidden = self.part, self._hidden(context)
        klass, place = targets // PLACES, targets % PLACES
        share, total = self._exp(hidden @ p["klass"] + p["klass_bias"], self._bounded(p["klass"], p["klass_bias"]))
        out = share[np.arange(len(targets)), klass] / total
        bounded = self._bounded(p["place"], p["place_bias"])
        for c, some in self._classes(klass):
            share, total = self._exp(hidden[some] @ p["place"][c] + p["place_bias"][c], bounded)
            out[some] *= share[np.arange(len(some)), place[some]] / total
        return np.log(np.maximum(out, 1e-37))

    def learn(self, targets: np.ndarray, context: np.ndarray, memory: Network, rate: float) -> None:
        """One step of Adagrad on the mean loss of these rows; memory holds the summed squares of the gradients."""
        p, hidden, n = self.part, self._hidden(context), len(targets)
        klass, place = targets // PLACES, targets % PLACES
        grad = Network(np.zeros_like(self.flat))
        g = grad.part
        share, total = self._exp(hidden @ p["klass"] + p["klass_bias"], self._bounded(p["klass"], p["klass_bias"]))
        share *= (1 / total)[:, None]
        share[np.arange(n), klass] -= 1
        ones = np.ones(n, np.float32)
        g["klass"][:], g["klass_bias"][:] = hidden.T @ share, ones @ share
        back = share @ p["klass"].T
        bounded = self._bounded(p["place"], p["place_bias"])
        for c, some in self._classes(klass):
            own = hidden[some]
            share, total = self._exp(own @ p["place"][c] + p["place_bias"][c], bounded)
            share *= (1 / total)[:, None]
            share[np.arange(len(some)), place[some]] -= 1
            g["place"][c], g["place_bias"][c] = own.T @ share, ones[: len(some)] @ share
            back[some] += share @ p["place"][c].T
        back *= 1 - hidden * hidden
        g["bias"][:] = ones @ back
        for side in range(2 * REACH):
            ids = context[:, side].astype(np.int16)
            g["side"][side] = np.einsum("ij,ij->j", p["embed"][ids], back)
            order = np.argsort(ids, kind="stable")
            sorted_ids = ids[order]
            first = np.flatnonzero(np.diff(sorted_ids, prepend=-1))
            # a side's factor is the same for all its words
            g["embed"][sorted_ids[first]] += np.add.reduceat(back[order], first, axis=0) * p["side"][side]
        grad.flat /= n
        memory.flat += grad.flat * grad.flat
        self.flat -= rate * grad.flat / (np.sqrt(memory.flat) + 1e-6)


def windows(parts: Iterator[np.ndarray], size: int = 1 << 15) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(targets, context) of a text's words; context holds the REACH words before, then those after, EDGE beyond the ends."""
    edge = np.zeros(REACH, np.int32)
    held = edge
    for part in itertools.chain(parts, [None]):
        held = np.concatenate([held, edge if part is None else part])
        while (n := len(held) - 2 * REACH) > 0 and (part is None or n >= size):
            n = min(n, size)
            sides = [held[k : k + n] for k in range(2 * REACH + 1)]
            yield sides[REACH], np.stack(sides[:REACH] + sides[REACH + 1 :], 1)
            held = held[n:]


def _batches(batches: Iterator[pa.RecordBatch], words: Words, size: int, offset: int, step: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Windows of every step-th position of each text, gathered to batches."""
    targets, context, n = [], [], 0
    for (text,) in rows(batches, "text"):
        at = offset
        for t, c in windows(words.of(text or "")):
            targets.append(t[at::step])
            context.append(c[at::step])
            n += len(targets[-1])
            at = (at - len(t)) % step
            if n >= size:
                yield np.concatenate(targets), np.concatenate(context)
                targets, context, n = [], [], 0
    if n:
        yield np.concatenate(targets), np.concatenate(context)


def _round(docs: DataFrame, shared_words, start: np.ndarray, offset: int, step: int, size: int, rate: float, fan_in: int = 32) -> np.ndarray:
    """Weights after each partition has trained from `start`, averaged by the positions that it trained on."""
    shared = docs.sparkSession.sparkContext.broadcast(start)
    cut = np.linspace(0, len(start), _BLOCKS + 1).astype(int).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, net = Words(shared_words.value[0], np.zeros(shared_words.value[1], np.float32)), Network(shared.value.copy())
        memory, seen = Network(np.zeros_like(net.flat)), 0
        for targets, context in _batches(batches, words, size, offset, step):
            net.learn(targets, context, memory, rate)
            seen += len(targets)
        if seen:
            node = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array([node] * _BLOCKS, pa.int64()), pa.array(range(_BLOCKS), pa.int32()), pa.array([float(seen)] * _BLOCKS), pa.array([net.flat[a:b].tobytes() for a, b in itertools.pairwise(cut)], pa.binary())], names=["node", "block", "seen", "w"])

    def mean(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("node", kind="stable")
        total = sum(np.frombuffer(w, np.float32).astype(np.float64) * s for w, s in zip(group["w"], group["seen"], strict=True))
        seen = group["seen"].sum()
        return pd.DataFrame({"node": [int(group["node"].iloc[0]) // fan_in], "block": [group["block"].iloc[0]], "seen": [seen], "w": [(total / seen).astype(np.float32).tobytes()]})

    kinds = "node long, block int, seen double, w binary"
    weights = materialize(spread(docs.select(F.col("text").cast("string").alias("text"))).mapInArrow(run, kinds), "weights")
    top = weights.agg(F.max("node")).first()[0]
    if top is None:
        return start
    while True:
        weights = weights.groupBy(F.expr(f"node div {fan_in}").alias("up"), "block").applyInPandas(mean, kinds)
        top //= fan_in
        if not top:
            break
    found = sorted((r["block"], bytes(r["w"])) for r in weights.select("block", "w").collect())  # one model's weights
    return np.frombuffer(b"".join(w for _, w in found), np.float32)


def _vocabulary(counts: DataFrame, most: int, step: float = 1.02) -> list[tuple[bytes, int]]:
    """The `most` most frequent words, ties to the smaller. Whole ranges of counts are taken without sorting; only the last is sorted."""
    range_of = F.floor(F.log("n") / math.log(step)).cast("int").alias("range")
    sizes = sorted(((r["range"], r["count"]) for r in counts.groupBy(range_of).count().collect()), reverse=True)  # a row for each factor of 1.02
    total, least = 0, None
    for at, size in sizes:
        if total + size > most:
            break
        total, least = total + size, at
    some = counts.withColumn("range", range_of)
    found = some.filter(F.col("range") >= least).select("word", "n").collect() if least is not None else []
    if total < most and len(sizes) and (least is None or least > sizes[-1][0]):
        last = next(at for at, _ in sizes if least is None or at < least)
        found += some.filter(F.col("range") == last).orderBy(F.desc("n"), "word").limit(most - total).select("word", "n").collect()
    return [(w, -n) for n, w in sorted((-n, bytes(w)) for w, n in found)]


def _rare(counts: DataFrame, known: list[bytes], most_buckets: int, block: int = 1 << 14) -> tuple[np.ndarray, np.ndarray]:
    """log p(word | place) of each bucket's words, and how often each place occurs; 32-bit numbers of all buckets reach the driver, in blocks."""
    spark = counts.sparkSession
    words = spark.createDataFrame([(bytearray(w),) for w in known], "word binary")  # the vocabulary's size
    rest = counts.join(F.broadcast(words), "word", "left_anti")
    n_words = rest.count()
    buckets = min(1 << max(n_words - 1, 1).bit_length(), most_buckets)
    sums = rest.groupBy((F.crc32("word") % buckets).cast("int").alias("bucket")).agg(F.sum("n").alias("n"), F.count("*").alias("words"))
    schema = pa.schema([("block", pa.int32()), ("n", pa.binary()), ("words", pa.binary())])

    def run(group: pa.Table) -> pa.Table:
        at = group["bucket"].to_numpy()
        n, words = np.zeros(block, np.float32), np.zeros(block, np.float32)
        n[at % block], words[at % block] = group["n"].to_numpy(), group["words"].to_numpy()
        return pa.table([[int(at[0]) // block], [n.tobytes()], [words.tobytes()]], schema=schema)

    n, words = np.zeros(-(-buckets // block) * block, np.float32), np.zeros(-(-buckets // block) * block, np.float32)
    for at, some, kinds in sums.groupBy(F.expr(f"bucket div {block}").alias("_block")).applyInArrow(run, "block int, n binary, words binary").collect():
        n[at * block : (at + 1) * block], words[at * block : (at + 1) * block] = np.frombuffer(some, np.float32), np.frombuffer(kinds, np.float32)
    n, words = n[:buckets] + 0.5, np.maximum(words[:buckets], 1)  # a bucket that no word of the corpus has: half an occurrence
    place = np.arange(buckets) % (PLACES - 1)
    sums = np.bincount(place, n, PLACES - 1)
    return np.log(n / sums[place] / words).astype(np.float32), sums


def unigram(counts: np.ndarray, network: Network) -> Network:
    """The network with biases that alone give each of the vocabulary's numbers the share of its count."""
    counts = np.maximum(counts.reshape(CLASSES, PLACES), 0.01)
    whole = counts.sum(1)
    network.part["klass_bias"][:] = np.log(whole / whole.sum())
    network.part["place_bias"][:] = np.log(counts / whole[:, None])
    return network


def train(docs: DataFrame, rounds: int = 1, step: int = 1, size: int = 8192, rate: float = 0.1, most_buckets: int = 1 << 22) -> Model:
    """The vocabulary, the other words' shares and the weights. Training starts from the words' shares alone; each round is over every step-th position of all texts, from another offset."""
    counts = materialize(word_counts(docs), "word_counts")
    found = _vocabulary(counts, (CLASSES - 1) * PLACES)
    known = [w for w, _ in found]
    rare, places = _rare(counts, known, most_buckets)
    often = np.zeros(CLASSES * PLACES)
    often[1:PLACES], often[PLACES : PLACES + len(found)] = places, [n for _, n in found]
    shared = docs.sparkSession.sparkContext.broadcast((known, len(rare)))
    weights = unigram(often, Network()).flat
    for k in range(rounds):
        weights = _round(docs, shared, weights, k * step // rounds, step, size, rate)
    return Model(known, rare, weights)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_words, log_likelihood, mean_log_likelihood of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("log_likelihood", pa.float64()), ("mean_log_likelihood", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, net = Words(shared.value.known, shared.value.rare), Network(shared.value.weights)
        sink = Sink(schema)
        held: list[tuple] = []
        n = 0

        def flush() -> None:
            """Score the windows of several texts together."""
            nonlocal held, n
            if n:
                logs = net.log_probs(np.concatenate([t for _, ts, _, _ in held for t in ts]), np.concatenate([c for _, _, cs, _ in held for c in cs]))
            at = 0
            for doc_id, ts, _, extra in held:
                size = sum(map(len, ts))
                total = float(logs[at : at + size].sum(dtype=np.float64)) + extra if size else 0.0
                at += size
                sink.add(doc_id, size, total, total / size if size else None)
            held, n = [], 0

        for doc_id, text in rows(batches, "doc_id", "text"):
            if text and len(text) > 1 << 20:  # long texts pass through window by window
                size, total, extra = 0, 0.0, []
                for t, c in windows(words.scored(text, extra)):
                    size, total = size + len(t), total + float(net.log_probs(t, c).sum(dtype=np.float64))
                total += sum(extra)
                sink.add(doc_id, size, total, total / size if size else None)
                continue
            extra = []
            found = list(windows(words.scored(text or "", extra)))
            held.append((doc_id, [t for t, _ in found], [c for _, c in found], sum(extra)))
            n += sum(len(t) for t, _ in found)
            if n >= 1 << 15 or len(held) >= 4096:
                flush()
                yield sink.batch()
        flush()
        yield sink.batch()

    return spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))).mapInArrow(run, "doc_id long, n_words long, log_likelihood double, mean_log_likelihood double")
