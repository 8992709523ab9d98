"""SimHash near-dedup with the generalised pigeonhole principle.

A document's fingerprint has 64 bits by majority of its word shingles' hashes. Two fingerprints within `radius` bits agree,
for any split of the bits into m parts and any thresholds t_i >= -1 with sum(t_i + 1) = radius + 1, up to t_i bits in
some part i. plan() groups correlated bits into parts and allocates unequal thresholds by dynamic programming on estimated
candidate counts; probes() emits the signatures of each distinct fingerprint; links() verifies candidates bucket by bucket.

A bucket gives a few links per member, never all its pairs: a dense one is searched as an implicit graph, which a
fingerprint leaves once it is reached; a large one is split again on the bits that are left. Exact copies share one
fingerprint and enter once.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.llm.common import Sink, cuts, join_counted, rows, spread
from quillmesh.operators.graph import components
from quillmesh.storage import materialize

BITS = 64
#: Relative costs of one signature shuffled and one candidate compared.
SIGNATURE_COST, CANDIDATE_COST = 1.0, 0.005
#: The parts of a fingerprint in use, each with its bits and threshold.
Plan = list[tuple[list[int], int]]


def shingle_hashes(text: str, words: int, seed: int = 42, digest=None) -> Iterator[np.ndarray]:
    """XXH64 of each shingle of `words` ASCII-lower-cased words, part by part for long texts.

    A text of fewer words has one shingle, the whole sequence; one without words has none. digest, a running hash, is given the words.
    """
    tail: list[bytes] = []
    some = False
    for part in cuts(text.encode("utf-8").lower()):
        new = part.split()
        if digest is not None and new:
            digest.update(b" ".join(new) + b" ")
        tail += new
        if len(tail) >= words:
            shingles = map(b" ".join, zip(*(tail[k:] for k in range(words)), strict=False))
            yield np.fromiter(map(xxhash.xxh64_intdigest, shingles, itertools.repeat(seed)), np.uint64, len(tail) - words + 1)
            tail, some = tail[len(tail) - words + 1 :], True
    if tail and not some:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(tail), seed)], np.uint64)


def simhash(text: str, words: int = 4, seed: int = 42) -> int:
    """Bit b is 1 if it is set in over half of the shingles' hashes; no word: zero."""
    total, count = 0, np.zeros(BITS, np.int64)
    for hashes in shingle_hashes(text, words, seed):
        for at in range(0, len(hashes), 1 << 16):
            part = hashes[at : at + (1 << 16)]
            total += len(part)
            count += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << b for b in np.flatnonzero(2 * count > total).tolist()))


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long. A null text has no word."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink = Sink(schema)
        for doc_id, text in rows(batches, "doc_id", "text"):
            fp = simhash(text or "", words)
            if sink.add(doc_id, fp - (fp >> 63 << 64)):
                yield sink.batch()
        yield sink.batch()

    return spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))).mapInArrow(run, "doc_id long, fp long")


def _mixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of hashes, others for each k (the finaliser of SplitMix64); the hashes themselves for 0."""
    if k:
        hashes = hashes + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        hashes = (hashes ^ hashes >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        hashes = (hashes ^ hashes >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        hashes = hashes ^ hashes >> np.uint64(31)
    return hashes


def sketch(text: str, words: int, prints: int, digest=None) -> np.ndarray:
    """Independent fingerprints, of which the first is that of simhash()."""
    total, count = 0, np.zeros(BITS * prints, np.int64)
    for hashes in shingle_hashes(text, words, digest=digest):
        for at in range(0, len(hashes), 255):
            part = np.stack([_mixed(hashes[at : at + 255], k) for k in range(prints)], 1)
            total += len(part)
            count += np.unpackbits(part.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * count > total, bitorder="little").view(np.int64)


def sketches(docs: DataFrame, words: int, prints: int) -> DataFrame:
    """(_qm_id, _qm_hash, _qm_same, _qm_fps) of (_qm_id, _qm_hash, _qm_text): fps are a text's fingerprints as signed longs, same a hash of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, same = [np.zeros(0, np.int64)], []
            for (text,) in rows([batch], "_qm_text"):
                digest = xxhash.xxh64(seed=7)
                found.append(sketch(text or "", words, prints, digest))
                same.append(_signed(digest.intdigest()))
            fps = pa.ListArray.from_arrays(pa.array(np.arange(len(same) + 1, dtype=np.int32) * prints), pa.array(np.concatenate(found)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(same, pa.int64()), fps], names=["_qm_id", "_qm_hash", "_qm_same", "_qm_fps"])

    return spread(docs.select("_qm_id", "_qm_hash", "_qm_text")).mapInArrow(run, "_qm_id long, _qm_hash long, _qm_same long, _qm_fps array<long>")


def bit_counts(fps: DataFrame, prints: int = 1) -> list[tuple[int, np.ndarray]]:
    """For each print the number of fingerprints and how many have bits i and j set, over all of them; 64 x 64 sums each reach the driver.

    fps: its column fps is an array of `prints` fingerprints.
    """
    cells = BITS * BITS + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, both = 0, np.zeros((prints, BITS, BITS))
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, prints)
            for k in range(prints):
                bits = np.unpackbits(np.ascontiguousarray(x[:, k]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                both[k] += bits.T @ bits
            total += len(x)
        sums = np.append(both.reshape(prints, -1), np.full((prints, 1), total), 1).astype(np.int64).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums))), pa.array(sums)], names=["cell", "n"])

    found = np.zeros(cells * prints, np.int64)
    for cell, n in fps.select("fps").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n")).collect():
        found[cell] = n
    return [(int(x[-1]), x[:-1].reshape(BITS, BITS)) for x in found.reshape(prints, cells)]


def _groups(total: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in `parts` groups of even size, each filled with the bits that correlate most with those it has."""
    share = both.diagonal() / max(total, 1)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-9))
    bond = np.abs(both / max(total, 1) - np.outer(share, share)) / np.outer(spread, spread)
    np.fill_diagonal(bond, 0)
    left, out = list(range(BITS)), []
    for k in range(parts):
        size = len(left) // (parts - k)
        group = [max(left, key=lambda b: (bond[b][left].sum(), -b))]
        left.remove(group[0])
        while len(group) < size:
            group.append(max(left, key=lambda b: (bond[b][group].sum(), -b)))
            left.remove(group[-1])
        out.append(sorted(group))
    return out


def _agree(total: int, both: np.ndarray, bits: list[int], most: int) -> np.ndarray:
    """The chance that two fingerprints differ in at most 0..most of these bits.

    The mean and the variance of the number of differing bits follow from the counts of pairs of bits, so that correlated bits
    count as such; a beta-binomial distribution has the same two.
    """
    n = len(bits)
    one_and_one = both[np.ix_(bits, bits)] / max(total, 1)
    one = one_and_one.diagonal()
    none = 1 - one[:, None] - one[None, :] + one_and_one
    differ = 2 * (one_and_one * none + (one[:, None] - one_and_one) * (one[None, :] - one_and_one))
    mean = float(np.clip(differ.trace(), 1e-6, n - 1e-6))
    q = mean / n
    bond = (max(float(differ.sum()) - mean * mean, 0) / (n * q * (1 - q)) - 1) / max(n - 1, 1)
    a, b = (s * (1 / min(max(bond, 1e-6), 0.99) - 1) for s in (q, 1 - q))
    log_beta = lambda x, y: math.lgamma(x) + math.lgamma(y) - math.lgamma(x + y)
    return np.minimum(np.cumsum([math.comb(n, k) * math.exp(log_beta(k + a, n - k + b) - log_beta(a, b)) for k in range(most + 1)]), 1)


def plan(total: int, both: np.ndarray, radius: int, most_parts: int = 8) -> Plan:
    """(bits, threshold) of each part in use, of the least estimated cost."""
    total = max(total, 1)  # without fingerprints all plans would cost nothing, those of millions of signatures too
    best: tuple[float, list] = (float("inf"), [])
    for parts in range(1, min(most_parts, radius + 1) + 1):
        groups = _groups(total, both, parts)
        table: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for bits in groups:
            near, cost, flips = _agree(total, both, bits, min(radius, len(bits))), [0.0], 0.0
            for t, chance in enumerate(near.tolist()):
                flips += 1 if t == 0 else math.comb(len(bits), t) / 2 if t < 4 else float("inf")
                cost.append(total * flips * SIGNATURE_COST + total * total / 2 * chance * CANDIDATE_COST)
            step: dict[int, tuple[float, list[int]]] = {}
            for used, (spent, ts) in table.items():
                for more, c in enumerate(cost):
                    if used + more <= radius + 1 and spent + c < step.get(used + more, (float("inf"),))[0]:
                        step[used + more] = (spent + c, [*ts, more - 1])
            table = step
        if radius + 1 in table and table[radius + 1][0] < best[0]:
            best = (table[radius + 1][0], [(bits, t) for bits, t in zip(groups, table[radius + 1][1], strict=True) if t >= 0])
    return best[1]


def _signed(x: int) -> int:
    return x - (x >> 63 << 64)


def probes(nodes: DataFrame, plans: dict[int, Plan]) -> DataFrame:
    """(key, part, probing, x[, y][, node]): each fingerprint's own signature in each part and those up to its threshold away.

    nodes: fps, an array of fingerprints, and perhaps node; plans: a plan for each place in the array that is searched; parts are
    numbered through. x is the fingerprint; where there are several, y is the first one, or the second for the first. Of the two
    ways between two signatures only the one to the larger value is gone.
    """
    flips, number = [], itertools.count()
    for k, chosen in plans.items():
        for bits, threshold in chosen:
            part, mask = next(number), sum(1 << b for b in bits)
            for t in range(threshold + 1):
                for some in itertools.combinations(bits, t):
                    flip = sum(1 << b for b in some)
                    flips.append(F.struct(F.lit(part).alias("part"), F.lit(k).alias("k"), F.lit(_signed(mask)).cast("long").alias("mask"), F.lit(_signed(flip)).cast("long").alias("flip"), F.lit(_signed(1 << max(some, default=0))).cast("long").alias("top")))
    out = nodes.select("*", F.inline(F.array(*flips))).withColumn("x", F.get("fps", F.col("k")))
    out = out.filter((F.col("flip") == 0) | (F.col("x").bitwiseAND(F.col("top")) == 0)).withColumn("y", F.get("fps", (F.col("k") == 0).cast("int")))
    key = F.xxhash64("part", F.col("x").bitwiseAND(F.col("mask")).bitwiseXOR(F.col("flip")))
    return out.select(key.alias("key"), "part", (F.col("flip") != 0).cast("int").alias("probing"), "x", "y", *(c for c in ("node",) if c in nodes.columns))


class _Bucket:
    """Finds links among fingerprints x that are within the radius and, where there is a y, whose y are within `far`.

    Only links that join what isn't joined yet come out, so a group of n gives n - 1 at most, in however many parts its members meet.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray | None, radius: int, far: int, cells: int = 1 << 21):
        self.x, self.y, self.radius, self.far, self.cells = x, y, radius, far, cells
        self.parent = np.arange(len(x))

    def _close(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.bitwise_count(self.y[a] ^ self.y[b]) <= self.far

    def _roots(self, some: np.ndarray) -> np.ndarray:
        roots = self.parent[some]
        while not np.array_equal(up := self.parent[roots], roots):
            roots = up
        self.parent[some] = roots
        return roots

    def _joining(self, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of links those that join, which then are joined."""
        apart = self._roots(a) != self._roots(b)
        a, b = a[apart], b[apart]
        keep, parent = np.zeros(len(a), bool), self.parent
        for i, (p, q) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
            while (up := int(parent[p])) != p:
                p = up
            while (up := int(parent[q])) != q:
                q = up
            if p != q:
                parent[max(p, q)] = min(p, q)
                keep[i] = True
        if keep.any():
            yield a[keep], b[keep]

    def linked(self, own: np.ndarray, probing: np.ndarray, free: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Links, as row numbers, that join every own row and every other one near it, directly or over others.

        A small group's pairs are compared at once. A large one is split on the bits not yet used, into groups of which those that are
        joined already are left alone; where there are no such bits, it is searched as a graph that a member leaves once it is reached.
        """
        everyone, x = np.concatenate([own, probing]), self.x
        if len(own) * len(everyone) <= self.cells:
            near = np.bitwise_count(x[own][:, None] ^ x[everyone][None, :]) <= self.radius
            a, b = np.nonzero(near)
            a, b = a[b > a], b[b > a]
            if self.y is not None and len(a):
                keep = self._close(own[a], everyone[b])
                a, b = a[keep], b[keep]
            if len(a) <= 4 * len(everyone):
                yield from self._joining(own[a], everyone[b])
                return
        elif len(free) >= 4 * (self.radius + 1):
            # exact again on the bits not yet used: radius + 1 parts, of which one agrees
            for k in range(self.radius + 1):
                bits = free[k :: self.radius + 1]
                masked = x[everyone] & np.uint64(sum(1 << b for b in bits))
                order = np.argsort(masked, kind="stable")
                for some in np.split(order, np.flatnonzero(np.diff(masked[order])) + 1):
                    mine = some < len(own)
                    if len(some) > 1 and mine.any():
                        roots = self._roots(everyone[some])
                        if (roots != roots[0]).any():
                            yield from self.linked(everyone[some[mine]], everyone[some[~mine]], [b for b in free if b not in bits])
            return
        left = everyone
        while len(left):
            front, left = left[:1], left[1:]
            while len(front) and len(left):
                near = np.bitwise_count(x[left] ^ x[front[0]]) <= self.radius
                if self.y is not None and near.any():
                    near[near] = self._close(left[near], front[:1])
                if near.any():
                    yield from self._joining(np.repeat(front[:1], near.sum()), left[near])
                    front, left = np.concatenate([front, left[near]]), left[~near]
                front = front[1:]


class _Forest:
    """Of links in a row those that join what was apart; nodes are forgotten, at the cost of needless links, beyond a number."""

    def __init__(self, most: int = 1_000_000):
        self.parent: dict[int, int] = {}
        self.most = most

    def _root(self, x: int) -> int:
        parent, top = self.parent, x
        while (up := parent.get(top, top)) != top:
            top = up
        while x != top:
            parent[x], x = top, parent[x]
        return top

    def joining(self, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        if len(self.parent) > self.most:
            self.parent.clear()
        keep = np.zeros(len(a), bool)
        for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
            x, y = self._root(x), self._root(y)
            if x != y:
                self.parent[x] = y
                keep[i] = True
        return pa.RecordBatch.from_arrays([pa.array(a[keep], pa.int64()), pa.array(b[keep], pa.int64())], names=["a", "b"])


def links(signatures: DataFrame, plans: dict[int, Plan], radius: int, tasks: int, far: int | None = None) -> DataFrame:
    """(a, b) nodes that link, or a part of these pairs that joins the same ones. Without a name a node is its fingerprint x.

    far: y has to be within it too. Each task keeps a forest of its links, and so does each of fewer tasks over what is then written:
    a dense group's members meet in many buckets. Rows are sorted by all their columns, so a task that is run again keeps the same links.
    """
    free = [[b for b in range(BITS) if b not in bits] for chosen in plans.values() for bits, _ in chosen]
    columns = [c for c in ("key", "part", "probing", "x", "y", "node") if c in signatures.columns and (c != "y" or far is not None)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, forest = [np.zeros(0, np.int64)] * len(columns), _Forest()
        for batch in itertools.chain(batches, [None]):
            if batch is None:
                now = held
                ends = np.append(np.flatnonzero(np.diff(now[0])) + 1, len(now[0]))
            else:
                now = [np.concatenate([h, batch.column(k).to_numpy().astype(np.int64)]) for k, h in enumerate(held)]
                ends = np.flatnonzero(np.diff(now[0])) + 1
                last = ends[-1] if len(ends) else 0
                held = [c[last:] for c in now]
            if not len(ends) or not ends[-1]:
                continue
            at = dict(zip(columns, now, strict=True))
            part, probing, node = at["part"], at["probing"], at.get("node", at["x"])
            bucket = _Bucket(at["x"].view(np.uint64), at["y"].view(np.uint64) if far is not None else None, radius, far or 0)
            starts, owns = np.append(0, ends[:-1]), np.append(0, np.cumsum(probing == 0))
            own = owns[ends] - owns[starts]
            some = (own > 0) & (ends - starts > 1)
            found = []
            for s, e, n in zip(starts[some].tolist(), ends[some].tolist(), own[some].tolist(), strict=True):
                found += bucket.linked(np.arange(s, s + n), np.arange(s + n, e), free[part[s]])
            if found:
                out = forest.joining(*(node[np.concatenate(end)] for end in zip(*found, strict=True)))
                if out.num_rows:
                    yield out

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = _Forest()
        for batch in batches:
            if (out := forest.joining(*(c.to_numpy() for c in batch.columns))).num_rows:
                yield out

    found = signatures.select(*columns).repartition(tasks, "key").sortWithinPartitions(*columns).mapInArrow(run, "a long, b long")
    return materialize(found, "links").coalesce(max(4, tasks // 8)).mapInArrow(thin, "a long, b long")


def _reached(nodes: DataFrame, prints: int, radius: int, far: int | None = None) -> DataFrame:
    """(node, root) of the nodes that link with others. nodes: distinct rows of fps, an array of fingerprints; a node is named by the first.

    The first fingerprint is searched first. In the search of the others a component found so far is one node: a dense group
    comes out of the first one's buckets only.
    """
    tasks = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    plans = {k: plan(total, both, radius) for k, (total, both) in enumerate(bit_counts(nodes, prints))}
    one, more = {0: plans.pop(0)}, plans
    reached = materialize(components(links(probes(nodes, one), one, radius, tasks, far)), "reached")
    if not more:
        return reached
    named = nodes.join(reached, F.get("fps", 0) == F.col("node"), "left").select("fps", F.coalesce("root", F.get("fps", 0)).alias("node"))
    joined = components(links(probes(named, more), more, radius, tasks, far)).select(F.col("node").alias("part"), F.col("root").alias("whole"))
    joined = materialize(joined, "joined")
    out = reached.join(joined, reached["root"] == joined["part"], "left").select("node", F.coalesce("whole", "root").alias("root"))
    # and those that the first fingerprint joined with none
    return materialize(out.unionByName(joined.join(reached, joined["part"] == reached["node"], "left_anti").select(F.col("part").alias("node"), F.col("whole").alias("root"))), "reached")


def near_groups(docs: DataFrame, words: int = 4, radius: int = 4) -> DataFrame:
    """(doc_id, fp, component_id): the smallest doc_id that links of `radius` bits or fewer reach.

    Defined results: a null text has fingerprint zero, linked like any other; rows may share a doc_id; a null doc_id
    never is a component's name unless all its doc_ids are null; no rows give no rows; other columns are ignored.
    """
    found = materialize(fingerprints(docs, words), "fingerprints")
    classes = materialize(found.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "classes")
    reached = _reached(classes.select(F.array("fp").alias("fps")), prints=1, radius=radius)
    named = reached.join(classes, reached["node"] == classes["fp"]).groupBy("root").agg(F.min("first").alias("name"))
    renamed = reached.join(named, "root").select(F.col("node").alias("fp"), "name")
    # a null name stands for itself: it has to tell a hot fingerprint from one that isn't
    final = materialize(classes.join(renamed, "fp", "left").select("fp", "n", F.struct(F.coalesce("name", "first").alias("id")).alias("component")), "components")
    total = final.agg(F.sum("n")).first()[0] or 0
    return join_counted(found, final, ["fp"], total, "component", "n").select("doc_id", "fp", F.col("component.id").alias("component_id"))


def hex_fingerprint(fp):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


class _Kept:
    """The shingle sets of kept documents, by shingle: exact similarities to all of them at once."""

    def __init__(self, similarity: float):
        self.similarity, self.by_shingle, self.sizes, self.empty = similarity, {}, [], False

    def near(self, shingles: list[int]) -> bool:
        """Whether one's Jaccard similarity is high enough; of two without a word it is 1."""
        if not shingles:
            return self.empty
        owners = [o for o in map(self.by_shingle.get, shingles) if o is not None]
        if len(owners) < self.similarity * len(shingles):
            return False
        both = np.bincount(np.fromiter(itertools.chain.from_iterable(owners), np.int64), minlength=len(self.sizes))
        return bool((both / (len(shingles) + np.array(self.sizes) - both) >= self.similarity).any())

    def add(self, shingles: list[int]) -> None:
        self.empty |= not shingles
        for s in shingles:
            self.by_shingle.setdefault(s, []).append(len(self.sizes))
        self.sizes.append(len(shingles))


#: What becomes of a document in a round.
_STAYS, _GOES, _OPEN = 0, 1, 2


def _judged(left: DataFrame, words: int, similarity: float, most: int, most_chars: int) -> DataFrame:
    """(_qm_id, _qm_hash, _qm_state) after a round over (_qm_id, _qm_hash, _qm_group, _qm_text).

    A group of up to `most` documents is gone through in one task. A larger one is dealt out in chunks, and each chunk meets the
    smallest documents of the group, at most `most` / 2; members that are near none of them are open.
    """
    size = F.length(F.coalesce("_qm_text", F.lit("")))
    chunks = F.ceil(F.greatest(F.count("*") / most, F.sum(size) / most_chars)).cast("int")
    large = left.groupBy("_qm_group").agg(chunks.alias("_qm_chunks")).filter("_qm_chunks > 1")
    dealt = left.join(large, "_qm_group", "left")  # a row for a large group: broadcast only while Spark finds it small
    by = Window.partitionBy("_qm_group").orderBy("_qm_id", "_qm_hash")
    ranked = dealt.filter("_qm_chunks > 1").select("_qm_id", "_qm_hash", "_qm_group", size.alias("_qm_size")).withColumn("_qm_rank", F.row_number().over(by)).filter(F.col("_qm_rank") <= max(1, most // 2))
    before = F.sum("_qm_size").over(by.rowsBetween(Window.unboundedPreceding, -1))
    leaders = ranked.withColumn("_qm_before", before).filter(f"_qm_rank = 1 or _qm_before + _qm_size <= {most_chars}").select("_qm_id", "_qm_hash", F.lit(True).alias("_qm_leads"))
    dealt = dealt.join(leaders, ["_qm_id", "_qm_hash"], "left").withColumn("_qm_leads", F.coalesce("_qm_leads", F.isnull("_qm_chunks")))
    own = F.array(F.pmod("_qm_hash", F.coalesce("_qm_chunks", F.lit(1))).cast("int"))
    everywhere = F.sequence(F.lit(0), F.coalesce("_qm_chunks", F.lit(1)) - 1)
    dealt = dealt.select("_qm_id", "_qm_hash", "_qm_group", "_qm_text", "_qm_leads", F.explode(F.when(F.col("_qm_leads"), everywhere).otherwise(own)).alias("_qm_chunk"))
    schema = pa.schema([("_qm_id", pa.int64()), ("_qm_hash", pa.int64()), ("_qm_state", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink, at, kept = Sink(schema), None, _Kept(similarity)
        for doc_id, hashed, group, chunk, leads, text in rows(batches, "_qm_id", "_qm_hash", "_qm_group", "_qm_chunk", "_qm_leads", "_qm_text"):
            if at != (group, chunk):
                at, kept = (group, chunk), _Kept(similarity)
            shingles = np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_hashes(text or "", words)])).tolist()
            near = kept.near(shingles)
            if leads and not near:
                kept.add(shingles)
            if (chunk == 0 or not leads) and sink.add(doc_id, hashed, _GOES if near else _STAYS if leads else _OPEN):
                yield sink.batch()
        yield sink.batch()

    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(tasks, "_qm_group", "_qm_chunk").sortWithinPartitions("_qm_group", "_qm_chunk", F.desc("_qm_leads"), "_qm_id", "_qm_hash")
    return dealt.mapInArrow(run, "_qm_id long, _qm_hash long, _qm_state int")


def keep_one(docs: DataFrame, words: int = 5, radius: int = 10, far: int = 20, similarity: float = 0.8, prints: int = 5, most: int = 1536, most_chars: int = 4_000_000) -> DataFrame:
    """docs without those that are near copies of a document that stays.

    Candidates are within `radius` bits in any of `prints` fingerprints and within `far` in another: of pairs at 0.8 one fingerprint of
    10 bits misses a third, and unrelated texts that are near in one by chance are not in two, so components don't grow with the corpus.
    Of texts of the same words the one of the smallest doc_id stays. A component's texts are gone through by doc_id: one whose shingle
    set's Jaccard similarity to one that stays is `similarity` or more goes, any other stays, in as many rounds as leave none open (a
    round takes all of a component of up to `most` texts and `most_chars` characters).

    Defined results: rows that share a doc_id and a text stay or go together; rows with a null doc_id stay; a null text is one without
    words; no rows give no rows. Other columns pass through; names that begin with _qm_ are taken.
    """
    named = docs.filter("doc_id is not null")
    texts = named.select(F.col("doc_id").cast("long").alias("_qm_id"), F.col("text").cast("string").alias("_qm_text")).withColumn("_qm_hash", F.xxhash64("_qm_text"))
    found = materialize(sketches(texts, words, prints), "sketches")
    firsts = found.groupBy("_qm_same", "_qm_fps").agg(F.min(F.struct("_qm_id", "_qm_hash")).alias("_qm_first"))
    firsts = materialize(firsts.select("_qm_first.*", F.get("_qm_fps", 0).alias("_qm_node"), "_qm_fps"), "firsts")
    reached = _reached(firsts.select(F.col("_qm_fps").alias("fps")).distinct(), prints, radius, far)
    # several texts may be one node; the others with company are those that were reached
    shared = firsts.groupBy("_qm_node").agg(F.count("*").alias("_qm_n")).filter("_qm_n > 1").select("_qm_node", F.col("_qm_node").alias("_qm_group"))
    roots = reached.select(F.col("node").alias("_qm_node"), F.col("root").alias("_qm_group"))
    roots = roots.unionByName(shared.join(roots.select("_qm_node"), "_qm_node", "left_anti"))
    members = firsts.select("_qm_id", "_qm_hash", "_qm_node").join(roots, "_qm_node").select("_qm_id", "_qm_hash", "_qm_group")
    left = materialize(texts.join(members, ["_qm_id", "_qm_hash"]).dropDuplicates(["_qm_id", "_qm_hash"]), "grouped")
    goes = None
    while True:
        judged = materialize(_judged(left, words, similarity, most, most_chars), "judged")
        near = judged.filter(f"_qm_state = {_GOES}").select("_qm_id", "_qm_hash")
        goes = near if goes is None else goes.unionByName(near)
        rest = judged.filter(f"_qm_state = {_OPEN}").select("_qm_id", "_qm_hash")
        if rest.isEmpty():
            break
        left = materialize(left.join(rest, ["_qm_id", "_qm_hash"]), "left")
    stays = firsts.join(goes, ["_qm_id", "_qm_hash"], "left_anti").select(F.col("_qm_id").alias("_qm_stays_id"), F.col("_qm_hash").alias("_qm_stays_hash"))
    kept = docs.join(stays, (docs["doc_id"].cast("long") == stays["_qm_stays_id"]) & (F.xxhash64(docs["text"].cast("string")) == stays["_qm_stays_hash"]), "left_semi")
    return kept.unionByName(docs.filter("doc_id is null"))
