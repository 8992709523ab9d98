"""Best-fit packing of token pieces into sequences of a fixed capacity, by residual packing.

1. Each partition tokenizes its documents, cuts only those longer than a sequence, and packs its pieces best-fit in
   decreasing order. Nearly full sequences are final at once.
2. All underfull ones are opened again. What is in them is counted by length, at most `capacity` counts over all partitions, and
   these counts are packed best-fit in decreasing order as the items themselves would be, runs of equal bins at a time.
   (Merging underfull bins as unbreakable items needs 14 % more sequences than tokens where partitions are small.)
3. An item's number among those of its length, over the partitions in order, gives its sequence and offset.

Only rows of numbers are shuffled, never text or ids. Defined results: a null text is an empty one, whose only id is the
separator; a row with a null or repeated doc_id is a document of its own; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.llm.common import Sink, cuts, rows, spread
from quillmesh.storage import materialize

#: Texts that are split and merged here, and how; the tokenizer's own pattern says the same of these characters.
_FAST = re.compile("[\\x20-\\x7e\\x09-\\x0d\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*").fullmatch
_PIECES_OF = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff\\s]+").findall
_READY: dict[str, WordIds] = {}
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, at long, up boolean"
#: Bin numbers are (partition << _SHIFT) + count.
_SHIFT = 34


class WordIds(dict):
    """Token ids of whole texts for a tokenizer that drops white space and never joins words across it.

    A text's ids are those of its words between ASCII white space, one after the other. Texts of ASCII and Latin-1 letters,
    digits and signs are split and merged here on plain bytes, by the ranks of the tokenizer's own vocabulary; all others by
    the tokenizer. Pieces are kept while there is room, and all are dropped when too few of the kept ones still occur.
    """

    def __init__(self, spec: str, most: int = 250_000):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.most, self.missed, self.seen = Tokenizer.from_str(spec), most, 0, 0
        self.merges = self._byte_merges(json.loads(spec))

    @staticmethod
    def _byte_merges(spec: dict):
        """The vocabulary as ranks of byte strings, the end of a word being a byte that UTF-8 doesn't have; None if ids don't follow the merges."""
        model, end = spec["model"], spec["model"].get("end_of_word_suffix")
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        vocabulary = model["vocab"]
        if end != "</w>" or any(vocabulary.get(a + b) != 512 + i for i, (a, b) in enumerate(merges)):
            return None
        import tiktoken

        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
        ranks = {}
        for token, rank in vocabulary.items():
            if rank < 512 + len(merges):
                bare = token.removesuffix(end)
                ranks[bytes(byte[c] for c in bare) + b"\xff" * (bare != token)] = rank
        if len(ranks) != 512 + len(merges):
            return None
        return tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def __missing__(self, piece: str) -> bytes:
        self.missed += 1
        if len(piece) > 1000:
            return array("I", self.tokenizer.encode(piece, add_special_tokens=False).ids).tobytes()
        out = array("I", self.merges(piece.encode("utf-8") + b"\xff")).tobytes()
        if len(self) < self.most and len(piece) <= 64:
            self[piece] = out
        return out

    def _word(self, word: str) -> bytes:
        if self.merges is not None and len(word) < 1000 and "<|" not in word and _FAST(word):
            return b"".join(map(self.__getitem__, _PIECES_OF(word.lower())))
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def __call__(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if self.merges is not None and len(text) < 1 << 20 and "<|" not in text and _FAST(text):
            pieces = _PIECES_OF(text.lower())
            self.seen += len(pieces)
            out = b"".join(map(self.__getitem__, pieces))
        else:
            out = b"".join(self._word(w.decode("utf-8")) for part in cuts(text.encode("utf-8")) for w in part.split())
        if self.seen > 1_000_000:
            if len(self) >= self.most and self.missed > 0.3 * self.seen:
                self.clear()
            self.missed = self.seen = 0
        return out


def word_ids(spec) -> WordIds:
    """One for each Python worker and tokenizer."""
    if spec.value not in _READY:
        _READY[spec.value] = WordIds(spec.value)
    return _READY[spec.value]


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing. Gives each item's bin and offset, and the bins' fills.

    Open bins are listed by room; a bit set of the rooms in use finds the tightest fit in a few machine words.
    """
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    fills: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fit = rooms >> size
        if fit:
            room = size + (fit & -fit).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, b = capacity, len(fills)
            fills.append(0)
        bins[i], offsets[i] = b, fills[b]
        fills[b] += size
        left = room - size
        if left:
            if not by_room[left]:
                rooms |= 1 << left
            by_room[left].append(b)
    return bins, offsets, np.array(fills, np.int64)


def fit_counts(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Best-fit decreasing of counts[length] items of each length, by runs of bins that are filled alike.

    Rows of (length, first, bin, offset, each): from a length's item `first` on, bins from `bin` on take `each` items from `offset` on.
    """
    out: list[tuple] = []
    by_room: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    rooms = opened = 0

    def leave(room: int, first: int, n: int) -> None:
        nonlocal rooms
        if n and room:
            by_room[room].append((first, n))
            rooms |= 1 << room

    for size in sorted(counts, reverse=True):
        at, left = 0, counts[size]
        while left:
            fit = rooms >> size
            if fit:
                room = size + (fit & -fit).bit_length() - 1
                first, n = by_room[room].pop()
                if not by_room[room]:
                    rooms ^= 1 << room
            else:
                room, first, n = capacity, opened, -(-left // (capacity // size))
                opened += n
            # a bin stays the tightest until no other item of this length fits
            each = room // size
            for per, bins in ((each, min(n, left // each)), (left % each, 1)):
                if per and bins and n and left >= per:
                    out.append((size, at, first, capacity - room, per))
                    leave(room - per * size, first, bins)
                    at, left, first, n = at + per * bins, left - per * bins, first + bins, n - bins
                if left >= each:
                    break
            leave(room, first, n)
    return np.array(out, np.int64).reshape(-1, 5)


def pieces(docs: DataFrame, spec: str, capacity: int = 2048, separator: int = 0, slack: int = 2, block: int = 500_000) -> DataFrame:
    """Each document's pieces with their place in a local bin; of those from underfull bins, the partition and the number among its own of that length."""
    shared = docs.sparkSession.sparkContext.broadcast(spec)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, end = word_ids(shared), np.array([separator], "<u4").tobytes()
        schema = pa.schema([("doc_id", pa.int64()), *((n, t) for n, t in (("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())))])
        node = TaskContext.get().partitionId()
        first, before = node << _SHIFT, np.zeros(capacity + 1, np.int64)
        sink = Sink(schema, block)

        def placed(first: int) -> tuple[list[pa.RecordBatch], int]:
            table = sink.batch()
            sizes = table.column("length").to_numpy()
            bins, at, fills = best_fit(sizes, capacity)
            up = (fills < capacity - slack)[bins]
            order = np.flatnonzero(up)[np.argsort(sizes[up], kind="stable")]
            n = np.bincount(sizes[order], minlength=capacity + 1)
            at[order] = np.arange(len(order)) - np.repeat(np.cumsum(n) - n - before, n)
            before[:] += n
            more = [pa.array(np.where(up, node, first + bins)), pa.array(at), pa.array(up)]
            out = pa.RecordBatch.from_arrays([*table.columns, *more], names=[*schema.names, "bin", "at", "up"])
            return [out.slice(k, 50_000) for k in range(0, out.num_rows, 50_000)], first + len(fills)

        for doc_id, text in rows(batches, "doc_id", "text"):
            raw, full = ids(text or "") + end, False
            for piece, k in enumerate(range(0, len(raw), 4 * capacity)):
                part = raw[k : k + 4 * capacity]
                full |= sink.add(doc_id, piece, k // 4, len(part) // 4, zlib.crc32(part))
            if full:
                out, first = placed(first)
                yield from out
        if sink.columns[0]:
            yield from placed(first)[0]

    return spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))).mapInArrow(pack, _PIECES)


def pack(docs: DataFrame, spec: str, capacity: int = 2048, separator: int = 0, slack: int = 2, carry: int | None = None, fan_in: int | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: the place of every token of every document.

    spec is the tokenizer's JSON; capacity the tokens of a sequence; separator the id after each document. carry and fan_in
    bounded a tree of merges that is no more; they have no effect.
    """
    local = materialize(pieces(docs, spec, capacity, separator, slack), "pieces")
    plain = ["doc_id", "piece", "start", "length", "ids_crc32"]
    tally = materialize(local.filter("up").groupBy(F.col("bin").alias("node"), "length").agg(F.count("*").alias("n")), "tally")
    totals = {r["length"]: r["n"] for r in tally.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = docs.sparkSession.sparkContext.broadcast(fit_counts(totals, capacity))  # bounded by the capacity
    by = Window.partitionBy("length").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    numbered = tally.select("node", F.col("length").alias("_length"), F.coalesce(F.sum("n").over(by), F.lit(0)).alias("before"))
    rest = local.filter("up").join(numbered, (F.col("bin") == F.col("node")) & (F.col("length") == F.col("_length"))).select(*plain, (F.col("before") + F.col("at")).alias("number"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, first, bins, offset, each = places.value[np.lexsort((places.value[:, 1], places.value[:, 0]))].T
        shift = 40
        for batch in batches:
            length, number = (batch.column(k).to_numpy().astype(np.int64) for k in (3, 5))
            k = np.searchsorted((size << shift) + first, (length << shift) + number, side="right") - 1
            number = number - first[k]
            more = [pa.array((1 << 62) + bins[k] + number // each[k]), pa.array(offset[k] + number % each[k] * length)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *more], names=[*plain, "sequence_id", "offset"])

    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return local.filter("not up").select(*plain, F.col("bin").alias("sequence_id"), F.col("at").alias("offset")).unionByName(rest.mapInArrow(place, kinds))
