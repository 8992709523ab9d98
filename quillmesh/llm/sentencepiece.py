"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces with log scores.

A unigram model's file has log scores. One of merges has ranks, whose sums say nothing; a piece's log score is then that of its
rank's share by the law of Zipf and Mandelbrot, log(1 / (rank + 2.7)) less the log of all shares' sum: a rule, as tokenizers aren't
trained. Text is taken as it is: neither normalised nor freed of repeated spaces.

White space is the marker U+2581; a marker also goes before the text. Where no piece covers a character it falls back to the
pieces of its bytes. No piece of the usual vocabularies has a marker after another character, so the best segmentation of a
text is that of its units (markers and what follows them up to the next marker) one after the other; units are encoded
once and kept. For a vocabulary that has such pieces whole texts are searched.

Of equally good segmentations the one with the longer last piece wins, as in a left-to-right search that only a better
score replaces. Defined results: a null or empty text has no piece; a literal U+2581 reads as a space and decodes to one;
other columns are ignored; every row is encoded for itself.
"""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import rows, spread

MARK = "▁"
#: Kinds of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: The kind of model whose scores are log probabilities.
UNIGRAM = 1
#: The shift of ranks in the law of Zipf and Mandelbrot.
SHIFT = 2.7
#: What an uncovered character costs below the least score.
UNKNOWN_PENALTY = 10.0
_UNITS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
_LETTERS = "".join(c for c in map(chr, range(256)) if c.isalpha())
_READY: dict[int, Pieces] = {}


def _fields(raw: bytes) -> Iterator[tuple[int, bytes | int]]:
    """The fields of a protocol-buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        tag = number()
        if tag & 7 == 0:
            yield tag >> 3, number()
        else:
            size = number() if tag & 7 == 2 else 4 if tag & 7 == 5 else 8
            yield tag >> 3, raw[at : at + size]
            at += size


def read_pieces(model: bytes) -> list[tuple[str, float, int]]:
    """(piece, score, kind) by id, of a model file."""
    out = []
    for field, value in _fields(model):
        if field == 1:
            got = dict(_fields(value))
            out.append((got[1].decode("utf-8"), struct.unpack("<f", got[2])[0] if 2 in got else 0.0, got.get(3, NORMAL)))
    return out


def scored_pieces(model: bytes) -> list[tuple[str, float, int]]:
    """(piece, log score, kind) by id: the file's scores of a unigram model, else scores by rank. Scores have 32 bits, as in a file."""
    pieces = read_pieces(model)
    trainer = next((dict(_fields(value)) for field, value in _fields(model) if field == 2), {})
    if trainer.get(3, UNIGRAM) == UNIGRAM:
        return pieces
    usual = sorted((i for i, (_, _, kind) in enumerate(pieces) if kind == NORMAL), key=lambda i: (-pieces[i][1], i))
    share = 1 / (np.arange(len(usual)) + SHIFT)
    score = dict(zip(usual, np.log(share / share.sum()).astype(np.float32).tolist(), strict=True))
    return [(piece, score.get(i, had), kind) for i, (piece, had, kind) in enumerate(pieces)]


def double_array(keys: list[tuple[bytes, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base, check and value of a trie: state s goes over byte b to base[s] + b if check of that is s; value is -1 or an id."""
    tree: dict = {}
    for key, value in keys:
        node = tree
        for byte in key:
            node = node.setdefault(byte, {})
        node[-1] = value
    size = 1 << 16
    base, check, value = [0] * size, [-1] * size, [-1] * size
    check[0] = 0
    queue, low = [(0, tree)], 1
    for state, node in queue:
        value[state] = node.get(-1, -1)
        steps = sorted(b for b in node if b >= 0)
        if not steps:
            continue
        first, others, spot, taken = steps[0], steps[1:], max(low, steps[0] + 1), 0
        start = spot
        while True:
            if spot + 256 >= size:
                base += [0] * size
                check += [-1] * size
                value += [-1] * size
                size *= 2
            if check[spot] >= 0:
                taken += 1
            elif all(check[spot - first + b] < 0 for b in others):
                break
            spot += 1
        # A stretch that is nearly full isn't looked at again.
        if taken >= 0.9 * (spot - start + 1):
            low = max(low, spot)
        base[state] = spot - first
        for b in steps:
            check[spot - first + b] = state
            queue.append((spot - first + b, node[b]))
    return np.array(base, np.int32), np.array(check, np.int32), np.array(value, np.int32)


class Vocabulary:
    """What the executors need: the trie's arrays, the pieces, their scores and kinds. Its size is the vocabulary's."""

    def __init__(self, pieces: list[tuple[str, float, int]]):
        self.pieces = [p for p, _, _ in pieces]
        self.kinds = [k for _, _, k in pieces]
        usual = [s for _, s, k in pieces if k == NORMAL] or [0.0]
        self.scores = [s for _, s, _ in pieces]
        self.top, self.unknown = max(usual), min(usual) - UNKNOWN_PENALTY
        self.byte_ids = [next((i for i, (p, _, k) in enumerate(pieces) if k == BYTE and p == f"<0x{b:02X}>"), None) for b in range(256)]
        self.unknown_id = next((i for i, k in enumerate(self.kinds) if k == UNKNOWN), 0)
        found = [(p.encode("utf-8"), i) for i, (p, _, k) in enumerate(pieces) if k in (NORMAL, USER)]
        self.trie = double_array(found)
        self.by_unit = not any(re.search(f"[^{MARK}]{MARK}", p) for p, k in zip(self.pieces, self.kinds, strict=True) if k in (NORMAL, USER))


class _Kept(dict):
    """Units and their ids; all are dropped when there are too many.

    Between two characters that stand side by side in no piece every segmentation has a boundary: a new unit is cut there
    first, and its parts are looked up.
    """

    def __init__(self, viterbi: Callable[[str], list[int]], pairs: set[str], most: int):
        super().__init__()
        self.viterbi, self.most = viterbi, most
        # of these boundaries, those between a letter and a sign, as most new units are known words with signs
        signs = "".join(c for c in map(chr, range(128)) if not c.isalnum() and not any(x + c in pairs for x in _LETTERS))
        self.cut = re.compile(f"(?<=[{_LETTERS}])(?=[{re.escape(signs)}])").split if signs else lambda unit: [unit]

    def __missing__(self, unit: str) -> bytes:
        parts = self.cut(unit)
        if len(parts) > 1:
            ids = b"".join([self[part] for part in parts])
        else:
            ids = array("i", self.viterbi(unit)).tobytes()
        if len(unit) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[unit] = ids
        return ids


class Pieces:
    """Encodes and decodes with a vocabulary."""

    def __init__(self, vocabulary: Vocabulary, most: int = 300_000):
        self.v = vocabulary
        inside = (p for p, k in zip(vocabulary.pieces, vocabulary.kinds, strict=True) if k in (NORMAL, USER))
        self.kept = _Kept(self.viterbi, {p[k : k + 2] for p in inside for k in range(len(p) - 1)}, most)
        self.base, self.check, self.value = (a.tolist() for a in vocabulary.trie)
        self.gains = [len(p) * vocabulary.top - 0.1 if k == USER else g for p, g, k in zip(vocabulary.pieces, vocabulary.scores, vocabulary.kinds, strict=True)]
        # what each id decodes to
        self.said = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k in (CONTROL, UNKNOWN) else p.encode("utf-8") for p, k in zip(vocabulary.pieces, vocabulary.kinds, strict=True)]

    def viterbi(self, unit: str) -> list[int]:
        """The ids of the best segmentation."""
        raw = unit.encode("utf-8")
        base, check, value, gains, unknown = self.base, self.check, self.value, self.gains, self.v.unknown
        size, none = len(raw), float("-inf")
        score, start_of, piece_of = [none] * (size + 1), [0] * (size + 1), [-1] * (size + 1)
        score[0] = 0.0
        start = 0
        while start < size:
            here, lead = score[start], raw[start]
            width = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            first = start + width
            if here != none:
                state, at, single = 0, start, False
                while at < size:
                    to = base[state] + raw[at]
                    if check[to] != state or not to:
                        break
                    state = to
                    at += 1
                    piece = value[state]
                    if piece >= 0:
                        gain = here + gains[piece]
                        if gain > score[at]:
                            score[at], start_of[at], piece_of[at] = gain, start, piece
                        if at == first:
                            single = True
                if not single and here + unknown > score[first]:
                    score[first], start_of[first], piece_of[first] = here + unknown, start, -1
            start = first
        out, end, byte_ids = [], size, self.v.byte_ids
        while end:
            start, piece = start_of[end], piece_of[end]
            if piece >= 0:
                out.append(piece)
            else:
                out.extend(self.v.unknown_id if byte_ids[b] is None else byte_ids[b] for b in reversed(raw[start:end]))
            end = start
        out.reverse()
        return out

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, "<i4")
        marked = MARK + text.replace(" ", MARK)
        if not self.v.by_unit:
            return np.array(self.viterbi(marked), "<i4")
        return np.frombuffer(b"".join(map(self.kept.__getitem__, _UNITS.findall(marked))), "<i4")

    def decode(self, ids: list[int]) -> str:
        """The text: bytes are joined, markers become spaces, the first marker goes."""
        text = b"".join(map(self.said.__getitem__, ids)).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


def _pieces(shared) -> Pieces:
    vocabulary = shared.value
    key = zlib.crc32("\0".join(vocabulary.pieces).encode()) if not hasattr(vocabulary, "key") else vocabulary.key
    vocabulary.key = key
    if key not in _READY:
        _READY[key] = Pieces(vocabulary)
    return _READY[key]


def encode(docs: DataFrame, model: bytes, decoded: bool = False) -> DataFrame:
    """doc_id, ids: the ids of each whole text; model is the model file's content.

    decoded: also n_chars, n_ids, and whole: the ids decode to the very text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(scored_pieces(model)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(shared)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                found = [(doc_id, text or "", pieces.encode(text or "")) for doc_id, text in rows([batch.slice(at, 512)], "doc_id", "text")]
                sizes = np.cumsum([0, *(len(ids) for _, _, ids in found)])
                ids = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate([ids for _, _, ids in found]), pa.int32()))
                out = {"doc_id": pa.array([d for d, _, _ in found], pa.int64()), "ids": ids}
                if decoded:
                    out |= {"n_chars": pa.array([len(t) for _, t, _ in found], pa.int64()), "n_ids": pa.array(np.diff(sizes), pa.int64())}
                    out["whole"] = pa.array([pieces.decode(ids.tolist()) == t for _, t, ids in found], pa.bool_())
                yield pa.RecordBatch.from_pydict(out)

    kinds = "doc_id long, ids array<int>" + ", n_chars long, n_ids long, whole boolean" * decoded
    return spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))).mapInArrow(run, kinds)


def decode(encoded: DataFrame, model: bytes) -> DataFrame:
    """doc_id, ids, text: null ids give a null text."""
    shared = encoded.sparkSession.sparkContext.broadcast(Vocabulary(scored_pieces(model)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(shared)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                text = [None if ids is None else pieces.decode(ids) for (ids,) in rows([part], "ids", step=64)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(text, pa.string())], names=["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, text string")
