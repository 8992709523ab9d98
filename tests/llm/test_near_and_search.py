"""SimHash, MinHash, top-k, the pipeline and the queries with SQL: against brute force and edge cases."""

import hashlib
import itertools
import os
import random

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from quillmesh.llm import minhash, queries, simhash, topk

AT = "/root/testdata/sf0.001"


def shingles(text, n):
    words = text.encode().lower().split()
    return [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or ([b" ".join(words)] if words else [])


def brute_simhash(text, n=4):
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles(text, n)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, fps, radius):
    parent = list(range(len(ids)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(range(len(ids)), 2):
        if (fps[a] ^ fps[b]).bit_count() <= radius:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {find(i): min(ids[j] for j in range(len(ids)) if find(j) == find(i)) for i in range(len(ids))}, [find(i) for i in range(len(ids))]


def test_simhash():
    long = " ".join(f"W{k % 977}" for k in range(300_000))
    for text in ("", "one", "Two words", "a b c", "A b C d", "É é a\x1cb\x0bc d e f g", "the same " * 50):
        assert simhash.simhash(text) == brute_simhash(text)
    assert sum(map(len, simhash.shingle_hashes(long, 4))) == 300_000 - 3
    assert np.concatenate(list(simhash.shingle_hashes(long, 4))).tolist() == [xxhash.xxh64_intdigest(s, 42) for s in shingles(long, 4)]
    blank = " " * (1 << 20)
    for text in ("the quick brown fox jumps" + blank, "a b" + blank + "c d e" + 2 * blank, blank + "one two" + blank, 3 * blank, "a b c" + blank + "d", blank + "x" * (1 << 20) + " y"):
        assert simhash.simhash(text) == brute_simhash(text)
        assert [h for part in simhash.shingle_hashes(text, 4) for h in part.tolist()] == [xxhash.xxh64_intdigest(s, 42) for s in shingles(text, 4)]


@pytest.mark.parametrize("radius", [0, 2, 4, 7])
def test_links_lose_nothing(spark, radius):
    """Clusters around few centres, chains, and strangers; low bits correlate."""
    rng = random.Random(radius)
    fps = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(25):
            fps.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, radius + 2))))
    fps |= {rng.getrandbits(64) | 0xFFFF for _ in range(150)}
    fps = sorted(fps)
    signed = [x - (x >> 63 << 64) for x in fps]
    df = spark.createDataFrame([([x],) for x in signed], "fps array<long>")
    ((total, both),) = simhash.bit_counts(df)
    assert total == len(fps) and both[3, 5] == sum(x >> 3 & x >> 5 & 1 for x in fps)
    chosen = simhash.plan(total, both, radius)
    assert sum(t + 1 for _, t in chosen) == radius + 1
    found = simhash.links(simhash.probes(df, {0: chosen}), {0: chosen}, radius, 4).collect()
    other = simhash.links(simhash.probes(df.orderBy(F.rand(3)).repartition(7), {0: chosen}), {0: chosen}, radius, 4).collect()
    assert sorted(found) == sorted(other)  # what a task keeps doesn't depend on the order of fetched rows
    assert all(((r["a"] ^ r["b"]) & (1 << 64) - 1).bit_count() <= radius for r in found)
    number = {x: i for i, x in enumerate(signed)}
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for r in found:
        x, y = find(number[r["a"]]), find(number[r["b"]])
        parent[max(x, y)] = min(x, y)
    _, want = brute_components(list(range(len(fps))), fps, radius)
    assert [find(i) for i in range(len(fps))] == want


@pytest.mark.parametrize("total", [0, 1, 50])
def test_plans_of_few_fingerprints_are_small(total):
    """Where nothing is to be searched no plan of millions of signatures may come out."""
    both = np.full((64, 64), total // 4, np.int64)
    np.fill_diagonal(both, total // 2)
    for radius in (0, 4, 10):
        chosen = simhash.plan(total, both, radius)
        assert sum(t + 1 for _, t in chosen) == radius + 1 and all(0 <= t <= 2 for _, t in chosen)


def test_dense_and_large_groups():
    """A group in which all link gives few rows, and one beyond the size of a table is split on the bits left."""
    centre = 0x123456789ABCDEF0
    near = np.array([centre] + [centre ^ (1 << a) ^ (1 << b) for a, b in itertools.combinations(range(40), 2)], np.uint64)
    for cells in (1 << 21, 64):
        links = list(simhash._Bucket(near, None, 4, 64, cells).linked(np.arange(len(near)), np.arange(0), list(range(64))))
        a, b = (near[np.concatenate(x)] for x in zip(*links, strict=True))
        assert (np.bitwise_count(a ^ b) <= 4).all()
        seen, edges = {int(near[0])}, list(zip(a.tolist(), b.tolist(), strict=True))
        while any(len({x, y} & seen) == 1 for x, y in edges):
            seen |= {z for x, y in edges if {x, y} & seen for z in (x, y)}
        assert len(seen) == len(near)
        assert len(edges) == len(near) - 1  # however many parts they meet in


def test_near_groups(spark):
    docs = queries.documents(spark, AT).select("doc_id", "text")
    extra = spark.createDataFrame([(5001, None), (5002, ""), (5003, " \n"), (5003, " \n"), (None, None), (5004, "x")], "doc_id long, text string")
    both = docs.unionByName(extra).withColumn("fp", F.lit("clash")).withColumn("component_id", F.lit(0))
    rows = simhash.near_groups(both).select("doc_id", "component_id", simhash.hex_fingerprint(F.col("fp")).alias("h")).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in both.collect()}
    assert len(rows) == both.count()
    assert all(r["h"] == f"{brute_simhash(texts[r['doc_id']]):016x}" for r in rows)
    known = sorted((r for r in rows if r["doc_id"] is not None), key=lambda r: r["doc_id"])
    names, roots = brute_components([r["doc_id"] for r in known], [int(r["h"], 16) for r in known], 4)
    assert [r["component_id"] for r in known] == [names[x] for x in roots]
    assert simhash.near_groups(both.limit(0)).count() == 0


def test_keep_one(spark):
    base = " ".join(f"w{k}" for k in range(200))
    close, far = base.replace("w100 ", "other "), " ".join(f"z{k}" for k in range(200))
    rows = [(9, base), (2, base), (3, close), (4, far), (5, None), (6, ""), (4, far), (None, base), (7, "single")]
    out = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(str(r["doc_id"]) for r in out) == ["2", "4", "4", "5", "7", "None"]


@pytest.mark.parametrize("most", [512, 6])
def test_keep_one_leaves_none_uncompared(spark, monkeypatch, most):
    """One component of twelve families of a text, an equal text and two near copies each, whatever fits in a task."""
    monkeypatch.setattr(simhash, "_reached", lambda nodes, *a: nodes.select(F.get("fps", 0).alias("node"), F.lit(0).cast("long").alias("root")).distinct())
    rows = []
    for k in range(12):
        base = " ".join(f"f{k}w{j}" for j in range(200))
        rows += [(k, base), (100 + k, base), (200 + k, base.replace(f"f{k}w90 ", "other ")), (300 + k, base + " end")]
    random.Random(1).shuffle(rows)
    out = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), most=most).collect()
    assert sorted(r["doc_id"] for r in out) == list(range(12))


def test_keep_one_finds_pairs_at_the_bound(spark):
    """Of pairs whose exact similarity is 0.80 to 0.83 nearly all lose one; strangers stay."""
    rng, rows = random.Random(8), []
    for k in range(300):
        n = rng.choice([60, 300])
        words = [f"{k}w{j}" for j in range(n)]
        other = list(words)
        while True:
            j = rng.randrange(n)
            changed = other[:j] + [f"{k}x{j}"] + other[j + 1 :]
            a, b = set(shingles(" ".join(words), 5)), set(shingles(" ".join(changed), 5))
            if len(a & b) / len(a | b) < 0.8:
                break
            other = changed
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
    out = {r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out >= set(range(0, 600, 2)) and len(out) <= 300 + 0.03 * 300
    assert [int(simhash.sketch(t, 4, 3).view(np.uint64)[0]) for t in ("", "one", "a b c d e " * 90)] == [simhash.simhash(t) for t in ("", "one", "a b c d e " * 90)]


def test_minhash_estimates():
    m, rng = minhash.MinHash(), random.Random(3)
    errors, bias = [], []
    for share in (0.0, 0.2, 0.5, 0.8, 1.0):
        for size in (30, 400):
            for _ in range(8):
                words = [f"{rng.random()}" for _ in range(size)]
                other = words[: int(size * share)] + [f"{rng.random()}" for _ in range(size - int(size * share))]
                a, b = set(shingles(" ".join(words), 5)), set(shingles(" ".join(other), 5))
                got = m.likeness(m.bins_of(" ".join(words)), m.bins_of(" ".join(other)))
                errors.append(abs(got - len(a & b) / len(a | b)))
                bias.append(got - len(a & b) / len(a | b))
    assert np.mean(errors) < 0.03 and abs(np.mean(bias)) < 0.01
    assert m.likeness(m.bins_of(""), m.bins_of("")) == 1 and m.likeness(m.bins_of(""), m.bins_of("a b")) < 0.2
    bins = m.bins_of("some words that are packed")
    assert m.unpack(m.pack(bins)).tolist() == bins.tolist()
    small = minhash.MinHash(bins=64, low_bits=3)
    assert small.unpack(small.pack(small.bins_of("a b c d e f"))).tolist() == small.bins_of("a b c d e f").tolist()


def plain_minhash(text, seed=42):
    """One-permutation MinHash word by word: 256 bins by the top 8 bits of a shingle's hash, the least of the rest in each, empty bins
    filled from the first filled one among those drawn for them, 8 bits of each value."""
    least = {}
    for s in shingles(text, 5):
        h = xxhash.xxh64_intdigest(s, seed)
        b, value = h >> 56, h & (1 << 56) - 1
        least[b] = min(least.get(b, value), value)
    if not least:
        least[0] = 0
    drawn = np.random.default_rng(seed).integers(0, 256, (4096, 256))
    out = []
    for b in range(256):
        at = b if b in least else next((int(drawn[k, b]) for k in range(4096) if int(drawn[k, b]) in least), min(least))
        out.append((least[at] * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 56)
    return out


def plain_likeness(a, b):
    same = sum(x == y for x, y in zip(a, b, strict=True)) / 256
    return max(0.0, (same - 1 / 256) / (1 - 1 / 256))


@pytest.mark.parametrize("parts", [1, 3, 50])
def test_edited_pairs(spark, parts):
    rows = [(7, "seven é words here and some more"), (1, None), (30, "x"), (4, ""), (None, "no id"), (4, "second four"), (12, "a b c d e f g h"), (-5, "minus")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(0)).repartition(3)
    got = minhash.edited_pairs(df, parts).collect()
    order = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -(2**63)), r[1] or ""))
    want = []
    for k, (doc_id, text) in enumerate(order):
        text, following = text or "", order[(k + 1) % len(order)][1] or ""
        changed = text[: len(text) - len(text) // 2] + following[: len(text) // 2]
        want.append((str(doc_id), len(text), hashlib.sha256(changed.encode()).hexdigest(), bytes(plain_minhash(text)).hex(), bytes(plain_minhash(changed)).hex(), round(plain_likeness(plain_minhash(text), plain_minhash(changed)), 9), round(plain_likeness(plain_minhash(text), plain_minhash(following)), 9)))
    assert sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in got) == sorted(want)
    assert minhash.edited_pairs(df.limit(0), parts).count() == 0
    alone = minhash.edited_pairs(df.filter("doc_id = 12"), parts).collect()
    assert len(alone) == 1 and alone[0]["near_next"] == 1


def test_blank_tails_change_no_fingerprint():
    m = minhash.MinHash()
    text = "the quick brown fox jumps over"
    assert m.bins_of(text).tolist() == m.bins_of(text + " " * (1 << 20)).tolist() == plain_minhash(text)


def test_accumulate():
    rng = np.random.default_rng(4)
    for top in (3, 1 << 20):
        q, c = rng.integers(-top, top, (9, 6)), rng.integers(-top, top, (31, 5))
        q[rng.random(q.shape) < 0.6] = 0
        assert (topk.accumulate(q, c) == q[:, :5] @ c.T).all()


@pytest.mark.parametrize("blocks", [(8192, 32768), (3, 7)])
def test_top_k(spark, monkeypatch, blocks):
    monkeypatch.setattr(topk, "QUERY_BLOCK", blocks[0])
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", blocks[1])
    monkeypatch.setattr(topk, "_TILE", (2, 5))
    rng = random.Random(5)
    rows = [(k, [rng.choice([-0.5, 0.0, 0.25, 1.0]) for _ in range(4)]) for k in range(160)]
    rows += [(k, [0.25] * 4) for k in range(200, 280)] + [(300, None), (301, [1.0, None]), (302, [float("nan")] * 4), (303, [float("inf")]), (350, [1.0]), (50, [9.0] * 4), (None, [9.0] * 4), (351, [])] + [(77, [2.0] * 4)] * 9
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1)).withColumn("v", F.lit(1))
    ok = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    got: dict = {}
    for r in topk.top_k(df, 5, 50).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["score"], r["vec_id"]))
    asked = {i: min(v for j, v in ok if j == i) for i, _ in ok if i % 50 == 0}  # of the two rows of 50 the lesser asks
    assert set(got) == set(asked)
    for i in asked:
        v = asked[i]
        want = sorted(((-sum(a * b for a, b in zip(v, w, strict=False)), j) for j, w in ok if j != i))[:5]
        assert sorted(got[i]) == [(n + 1, -s, j) for n, (s, j) in enumerate(want)]
    assert topk.top_k(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(AT):
        con.sql(f"create view {file[:-8]} as select * from '{AT}/{file}'")
    got, want = queries.QUERIES[name](spark, AT).toPandas(), con.sql(queries.ORACLES[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    plain = lambda f: sorted(map(str, f[columns].astype(object).where(f[columns].notna(), None).values.tolist()))
    assert plain(got) == plain(want)


def test_url_query_with_null_ids(spark, tmp_path):
    """Null ids in labels and urls, and no page at all, against the SQL."""
    labels = [(None, 0, 1), (1, 0, 0), (2, 1, 1), (3, 1, 0), (3, 0, 0), (4, None, None)]
    pages = [(k, f"http://h{k % 3}.example.co.uk:80/p/{k % 6}.html") for k in range(40)] + [(None, None), (90, "http://x.org/fr/none"), (91, "no url"), (92, "http://10.0.0.1/2")]
    for at, rows in ((tmp_path / "some", pages), (tmp_path / "none", [])):
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(str(at / "labels.parquet"))
        spark.createDataFrame(rows, "page_id long, url string").coalesce(1).write.parquet(str(at / "pages.parquet"))
        con = duckdb.connect()
        for name in ("labels", "pages"):
            con.sql(f"create view {name} as select * from '{at}/{name}.parquet/*.parquet'")
        want = con.sql(queries.ORACLES["op5_url_filters"])
        got = sorted(str(tuple(r[c] for c in want.columns)) for r in queries.op5_url_filters(spark, str(at)).collect())
        assert got == sorted(map(str, want.fetchall())) and len(got) == len(rows)


def test_pipeline_edges(spark):
    """Empty tables and repeated rows: rows of one doc_id and text stay or go together."""
    docs = queries.documents(spark, AT).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, AT).count() == 0
    text = " ".join(f"w{k}" for k in range(50))
    rows = [(1, text), (1, text), (2, text), (3, "another text of some other words")]
    out = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), AT).collect()
    assert sorted(r["doc_id"] for r in out) == [1, 1, 3]


def test_pipeline(spark):
    docs = queries.documents(spark, AT).withColumn("extra", F.lit("kept"))
    noise = " ".join("".join(random.Random(k).choices("qxzvkjwpfgh", k=9)) for k in range(80))
    more = spark.createDataFrame([(90001, None), (90002, "12 34 !!"), (90003, noise)], "doc_id long, text string")
    docs = docs.unionByName(more, allowMissingColumns=True)
    first = corpus_pipeline.language_id(spark, docs, AT)
    assert first.columns == docs.columns
    kept = {r["doc_id"] for r in first.collect()}
    assert {r["doc_id"] for r in docs.collect()} - kept == {90001, 90002, 90003}
    second = corpus_pipeline.line_dedup(spark, first, AT)
    assert second.columns == docs.columns and second.count() == len(kept)
    third = corpus_pipeline.near_dedup(spark, second, AT)
    texts = [r["text"] for r in third.collect()]
    assert third.columns == docs.columns and len(set(texts)) == len(texts) and len(texts) >= 0.5 * len({r["text"] for r in second.collect()})
    packed = corpus_pipeline.pack(spark, third, AT)
    assert packed.select("doc_id").distinct().count() == len(texts)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "packing"]
