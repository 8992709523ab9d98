"""Language ID by interpolated Kneser-Ney character models, one per language, in sorted hash arrays.

A text's score in a language is the cross-entropy per character of its words, each between two boundary marks. All
languages share one sorted array of n-gram hashes per order, with a column per language, so a lookup serves all of them.
The lowest cross-entropy wins; a text whose lowest is beyond what the language's own calibration texts reach is rejected.

Fitting takes about `most_docs` labelled documents per language of at most `most_chars` code points each, chosen by a hash
of doc_id, and together at most `most_total` code points, a like share for each language; every fourth of them calibrates the rejection
and is not counted. Of more than `most_langs` languages those with most documents are learned. Prediction reads whole texts of all documents.

Defined results: a null text or one without a letter is `und` with score 0 and rejected; with nothing to learn from, every
text is; ties go to the first language in natural order; a null doc_id is not held out and is never learned from; other columns
pass through, names that begin with _qm_ are taken.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmesh.llm.common import Sink, cuts, rows, spread

ORDER = 5
START, END = chr(1), chr(2)
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_RUNS = re.compile(r"[^\W\d_]+")
#: ASCII letters lower-cased, all other ASCII to spaces: what letters() says of tokens, before there are any.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))
#: The one context of 1-grams.
_NONE = np.uint64(1)


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def letters(token: str) -> list[str]:
    """Lower-cased runs of letters."""
    return [run for run in _RUNS.findall(token.lower()) if any(map(str.isalpha, run))]


def _grams(words: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """For each position but the words' starts: hashes of the 1..ORDER-grams that end there, those of their contexts, the word.

    A word is START, its characters, END; START is context only. 0 stands where the word is too short for the gram.
    """
    text = np.frombuffer("".join(f"{START}{w}{END}" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    word = np.repeat(np.arange(len(words)), size)
    depth = np.arange(len(text)) - np.repeat(np.cumsum(size) - size, size)
    code, grams = np.zeros(len(text), np.uint64), []
    for k in range(ORDER):
        back = np.zeros(len(text), np.uint64)
        back[k:] = text[: max(len(text) - k, 0)]
        code = code + (back + np.uint64(7)) * np.uint64(pow(0x100000001B3, k + 1, 1 << 64))
        mixed = (code ^ (code >> np.uint64(29))) * _MIX[0]
        mixed = (mixed ^ (mixed >> np.uint64(32))) * _MIX[1] + np.uint64(k)
        grams.append(np.where(depth >= k, np.maximum(mixed, np.uint64(2)), np.uint64(0)))
    keep = depth > 0
    contexts = [np.full(int(keep.sum()), _NONE)] + [np.append(np.uint64(0), g[:-1])[keep] for g in grams[:-1]]
    return [g[keep] for g in grams], contexts, word[keep]


class _Table:
    """Sorted keys of all languages and a row of values for each; the last row is for keys that aren't there.

    Hashes are even, so their top bits say where in the array to begin; a few steps from there find a key or that it is missing.
    """

    def __init__(self, parts: list[tuple], langs: int, fill: float):
        self.keys = np.unique(np.concatenate([p[0] for p in parts]))
        self.values = np.full((len(self.keys) + 1, langs), fill, np.float64)
        for lang, (own, value) in enumerate(parts):
            self.values[np.searchsorted(self.keys, own), lang] = value
        bits = min(len(self.keys).bit_length() + 1, 24)
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(self.keys, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)
        self.padded = np.append(self.keys, np.uint64(0))

    def __call__(self, wanted: np.ndarray) -> np.ndarray:
        none = len(self.keys)
        at = self.first[(wanted >> self.shift).astype(np.int64)]
        row, left = np.full(len(wanted), none), np.arange(len(wanted))
        while len(left):
            key, asked = self.padded[at], wanted[left]
            hit = (key == asked) & (at < none)
            row[left[hit]] = at[hit]
            on = (key < asked) & (at < none)
            left, at = left[on], at[on] + 1
        return self.values[row]


class Models:
    """Per order the n-grams with their discounted share, and the contexts with what they pass down, a column per language."""

    def __init__(self, counts: dict[str, Counter]):
        """counts: how often each language has each word; no language without a word."""
        self.langs = sorted(counts)
        shares: list[list] = [[] for _ in range(ORDER)]
        passed: list[list] = [[] for _ in range(ORDER)]
        self.floor = np.zeros(len(self.langs))
        self.limit = np.zeros((len(self.langs), 2))
        for lang, name in enumerate(self.langs):
            words = list(counts[name])
            grams, contexts, word = _grams(words)
            weight = np.array([counts[name][w] for w in words], np.float64)[word]
            for k in range(ORDER):
                real = grams[k] != 0
                keys, first, at = np.unique(grams[k][real], return_index=True, return_inverse=True)
                if k == ORDER - 1:
                    n = np.bincount(at, weight[real], len(keys))
                else:
                    # Continuation counts: different characters before the gram; none can stand before a word's start, where the gram's own count serves.
                    longer = grams[k + 1][real]
                    kinds, one = np.unique(longer, return_index=True)
                    n = np.bincount(at[one[kinds != 0]], minlength=len(keys)) + np.bincount(at, np.where(longer == 0, weight[real], 0), len(keys))
                contexts_of, of = np.unique(contexts[k][real][first], return_inverse=True)
                total, ones, twos = np.bincount(of, n, len(contexts_of)), (n == 1).sum(), (n == 2).sum()
                cut = min(max(ones / (ones + 2 * twos) if ones else 0.5, 0.1), 0.9)
                shares[k].append((keys, np.maximum(n - cut, 0) / total[of]))
                passed[k].append((contexts_of, np.bincount(of, np.minimum(n, cut), len(contexts_of)) / total))
            self.floor[lang] = 1 / (len(np.unique(grams[0])) + 1000)
        self.shares = [_Table(x, len(self.langs), 0.0) for x in shares]
        self.passed = [_Table(x, len(self.langs), 1.0) for x in passed]

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log-probability of each word in each language, and its characters with the end mark."""
        grams, contexts, word = _grams(words)
        p = np.broadcast_to(self.floor, (len(word), len(self.langs)))
        for k in range(ORDER):
            p = np.where((grams[k] != 0)[:, None], self.shares[k](grams[k]) + self.passed[k](contexts[k]) * p, p)
        logs = np.log(p)
        sums = [np.bincount(word, logs[:, j], len(words)) for j in range(len(self.langs))]
        return np.stack(sums, 1), np.bincount(word, minlength=len(words)).astype(np.float64)

    def calibrate(self, texts: dict[str, list[Counter]]) -> None:
        """Set how high the cross-entropy of a language's own texts may be: limit[0] + limit[1] / sqrt(characters).

        limit[0] is above every calibration text and six deviations over their mean; limit[1] is six deviations of one character.
        """
        for lang, name in enumerate(self.langs):
            found = []
            for words in texts.get(name, []):
                logs, n = self.words(list(words))
                times = np.fromiter(words.values(), np.float64, len(words))
                size = (n * times).sum()
                entropy = -(logs[:, lang] * times).sum() / size
                found.append((entropy, ((logs[:, lang] + n * entropy) ** 2 * times).sum(), size))
            x = np.array(found).reshape(-1, 3)
            if len(x):
                self.limit[lang] = max(x[:, 0].max(), x[:, 0].mean() + 6 * x[:, 0].std()) + 0.25, 6 * np.sqrt(x[:, 1].sum() / x[:, 2].sum())
            else:
                self.limit[lang] = np.inf, 0


class Judge:
    """Judges texts token by token; a token's sums are kept, up to a number of tokens."""

    def __init__(self, models: Models | None, most: int = 150_000):
        self.models, self.most, self.kept = models, most, {}
        self.sums = np.zeros((1024, len(models.langs) + 1 if models else 1))

    def _learn(self, tokens: list[bytes]) -> None:
        if len(self.kept) + len(tokens) > self.most:
            self.kept.clear()
        runs = [[t.decode("ascii")] if t.isalpha() else letters(t.decode("utf-8", "replace")) for t in tokens]  # ASCII letters are lower-cased already
        words = list(dict.fromkeys(r for some in runs for r in some))
        first = len(self.kept)
        while len(self.sums) < first + len(tokens):
            self.sums = np.concatenate([self.sums, np.zeros_like(self.sums)])
        self.sums[first : first + len(tokens)] = 0
        if words:
            number = {w: k for k, w in enumerate(words)}
            table = np.column_stack(self.models.words(words))
            token = np.repeat(np.arange(len(tokens)), [len(some) for some in runs])
            np.add.at(self.sums, first + token, table[[number[r] for some in runs for r in some]])
        self.kept.update(zip(tokens, range(first, first + len(tokens)), strict=True))

    def prepare(self, texts: list[str | None]) -> None:
        """Learn the new tokens of several texts at once; long texts learn their own."""
        new = set().union(*(t.encode("utf-8", "replace").translate(_PLAIN).split() for t in texts if t and len(t) < 100_000)) if self.models else set()
        if new := list(new.difference(self.kept)):
            for at in range(0, len(new), 50_000):
                self._learn(new[at : at + 50_000])

    def total(self, text: str) -> np.ndarray:
        """Log-probabilities per language, then characters."""
        out = np.zeros(self.sums.shape[1])
        for part in cuts(text.encode("utf-8", "replace")):
            tokens = part.translate(_PLAIN).split()
            for at in range(0, len(tokens), 50_000):
                some = tokens[at : at + 50_000]
                try:
                    numbers = np.fromiter(map(self.kept.__getitem__, some), np.int64, len(some))
                except KeyError:  # a long text, or the kept ones were cleared
                    self._learn(list(set(some).difference(self.kept)))
                    if rest := list(set(some).difference(self.kept)):
                        self._learn(rest)
                    numbers = np.fromiter(map(self.kept.__getitem__, some), np.int64, len(some))
                out += self.sums[numbers].sum(0)
        return out

    def __call__(self, text: str | None) -> tuple[str, float, float | None, bool]:
        """Language, score, cross-entropy per character, rejected."""
        if text is None or self.models is None or not (total := self.total(text))[-1]:
            return "und", 0.0, None, True
        entropy = -total[:-1] / total[-1]
        best = int(entropy.argmin())
        score = 1 / np.exp((entropy[best] - entropy) * min(total[-1], 60.0)).sum()
        return self.models.langs[best], float(score), float(entropy[best]), bool(entropy[best] > self.models.limit[best, 0] + self.models.limit[best, 1] / np.sqrt(total[-1]))


def fit(docs: DataFrame, most_docs: int = 400, most_chars: int = 20_000, most_langs: int = 200, most_total: int = 50_000_000) -> Models | None:
    """Models from a bounded sample of the labelled documents that aren't held out, of a long one its first `most_chars` characters."""
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    labelled = labelled.select("doc_id", "lang", F.substring("text", 1, most_chars).alias("text"))
    sizes = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_langs).collect()
    if not sizes:
        return None
    rate = F.create_map(*(x for lang, n in sizes for x in (F.lit(lang), F.lit(most_docs / n))))
    lot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    # in the order of a hash, where ids repeat so that a lot stands for many rows
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", "text"), "doc_id", "text")
    sample = labelled.filter(lot < F.element_at(rate, F.col("lang"))).withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= 2 * most_docs)
    sample = sample.withColumn("_sum", F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, 0))).filter(F.col("_sum") <= max(most_chars, most_total // len(sizes)))
    sample = sample.select("doc_id", "lang", "text")
    counts: dict[str, Counter] = {}
    aside: dict[str, list[Counter]] = {}
    for k, (_, lang, text) in enumerate(sorted(sample.collect())):
        words = Counter(w for token in text.split() for w in letters(token))
        if words and k % 4 == 3 and lang in counts:
            aside.setdefault(lang, []).append(words)
        elif words:
            counts.setdefault(lang, Counter()).update(words)
    if not counts:
        return None
    models = Models(counts)
    models.calibrate(aside)
    return models


def identify(docs: DataFrame, models: Models | None) -> DataFrame:
    """docs with _qm_lang, _qm_score, _qm_entropy and _qm_rejected; other columns pass through."""
    shared = docs.sparkSession.sparkContext.broadcast(models)  # bounded by the sample's bounds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                sink, texts = Sink(added), [text for (text,) in rows([part], "text")]
                judge.prepare(texts)
                for text in texts:
                    sink.add(*judge(text))
                yield pa.RecordBatch.from_arrays([*part.columns, *sink.batch().columns], names=[*part.schema.names, *added.names])

    added = pa.schema([("_qm_lang", pa.string()), ("_qm_score", pa.float64()), ("_qm_entropy", pa.float64()), ("_qm_rejected", pa.bool_())])
    kinds = "_qm_lang string, _qm_score double, _qm_entropy double, _qm_rejected boolean"
    out = T.StructType([*docs.schema.fields, *T._parse_datatype_string(kinds).fields])
    return spread(docs).mapInArrow(run, out)
