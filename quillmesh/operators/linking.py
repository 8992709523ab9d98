"""Entities across layouts (L2h, D1, A1-A6, J3, L3h): mentions, plural groups, shared entities, aliases."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmesh.functions.text import content_words, first_of_each, normalize
from quillmesh.operators.graph import components
from quillmesh.storage import materialize


def mentions(contents: DataFrame, pattern: str = "[A-Z][a-z]+") -> DataFrame:
    """Names by a pattern, each lower-cased name once a layout (D1: the first stays). The dedup is within the layout's own array."""
    said = F.coalesce("text", "ocr_text")
    first = first_of_each(F.regexp_extract_all(said, F.lit(pattern), F.lit(0)), lambda n, i: F.struct(i.alias("ord"), n.alias("name")))
    return contents.select("doc_id", "layout_id", "page_id", "modality", F.inline(first)).select("*", F.lit("group").alias("type"))


def _with_canonical(counts: DataFrame) -> DataFrame:
    """A2: counts (doc_id, norm, n, ...) with canonical, in one pass by document and base."""
    counts = counts.withColumn("base", F.regexp_replace("norm", "s+$", "")).withColumn("k", F.length("norm") - F.length("base"))
    order = Window.partitionBy("doc_id", "base").orderBy("k")
    counts = counts.withColumn("island", F.col("k") - F.row_number().over(order))
    whole = Window.partitionBy("doc_id", "base", "island")
    low, zero, one = F.min("k").over(whole), F.sum(F.when(F.col("k") == 0, F.col("n")).otherwise(0)).over(whole), F.sum(F.when(F.col("k") == 1, F.col("n")).otherwise(0)).over(whole)
    counts = counts.withColumn("low", low).withColumn("zero", zero).withColumn("one", one)
    canonical = F.when(F.col("low") == 0, F.when(F.col("one") > F.col("zero"), F.concat("base", F.lit("s"))).otherwise(F.col("base"))).otherwise(F.concat("base", F.expr("repeat('s', low)")))
    return counts.withColumn("canonical", canonical).drop("base", "k", "island", "low", "zero", "one")


def plural_groups(named: DataFrame) -> DataFrame:
    """A1, A2: doc_id, norm, n, canonical. Names that differ by runs of s at the end join in islands of consecutive runs.

    An island that starts without an s is named by its base, or its plural where that is more frequent; others by their shortest.
    """
    return _with_canonical(named.groupBy("doc_id", "norm").agg(F.count("*").alias("n")))


def _gathered(found: DataFrame) -> DataFrame:
    """Mentions by document and normalised name: how many, which names and types, where, and the first."""
    named = found.withColumn("norm", normalize(F.col("name")))
    seen = F.struct("layout_id", "page_id", "modality")
    return named.groupBy("doc_id", "norm").agg(F.count("*").alias("n"), F.collect_set("name").alias("names"), F.collect_set("type").alias("types"), F.collect_set(seen).alias("seen"), F.min(F.struct("layout_id", "ord")).alias("first"))


def canonical_counts(found: DataFrame) -> DataFrame:
    """A1, A2: doc_id, name, n of the names that plurals are grouped under."""
    return _with_canonical(_gathered(found).select("doc_id", "norm", "n")).groupBy("doc_id", F.col("canonical").alias("name")).agg(F.sum("n").alias("n"))


def shared_entities(found: DataFrame, least_layouts: int = 2, aliases: DataFrame | None = None) -> DataFrame:
    """Entities of several layouts of a document, with aliases, types, appearances, what they cross, and their position.

    Mentions are gathered by name before names are grouped, so they are read and dealt once. position counts a document's entities:
    those that cross modalities first, then by layouts, then as first seen. aliases: doc_id, name, canonical of names that are one (A3).
    """
    canonical = _with_canonical(_gathered(found))
    if aliases is not None:
        known = aliases.select("doc_id", F.col("name").alias("canonical"), F.col("canonical").alias("_alias"))
        canonical = canonical.join(known, ["doc_id", "canonical"], "left").withColumn("canonical", F.coalesce("_alias", "canonical"))
    all_of = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    out = canonical.groupBy("doc_id", F.col("canonical").alias("canonical_name")).agg(all_of("names").alias("aliases"), all_of("types").alias("entity_types"), all_of("seen").alias("appearances"), F.min("first").alias("first"))
    modalities = F.array_sort(F.array_distinct(F.transform("appearances", lambda a: a["modality"])))
    out = out.withColumn("num_layouts", F.size("appearances")).filter(F.col("num_layouts") >= least_layouts)
    out = out.withColumn("modalities", modalities).withColumn("cross_modal", F.size("modalities") > 1)
    out = out.withColumn("cross_page", F.size(F.array_distinct(F.transform("appearances", lambda a: a["page_id"]))) > 1)
    out = out.withColumn("is_named_entity", F.size(F.array_except("entity_types", F.array(F.lit("number"), F.lit("date")))) > 0)
    order = Window.partitionBy("doc_id").orderBy(F.desc("cross_modal"), F.desc("num_layouts"), "first", "canonical_name")
    return out.withColumn("position", F.row_number().over(order)).drop("first")


def alias_candidates(leaders: DataFrame) -> DataFrame:
    """doc_id, a, b: leaders of a document that share a content word and whose lengths are within 0.3 and 3 times.

    leaders: doc_id, name, one row each. Names meet by an equi-join on the word, never all with all.
    """
    words = leaders.select("doc_id", "name", F.explode(content_words(F.col("name"))).alias("word"))
    left = words.withColumnRenamed("name", "a")
    right = words.withColumnRenamed("name", "b")
    ratio = F.length("a") / F.length("b")
    return left.join(right, ["doc_id", "word"]).filter((F.col("a") < F.col("b")) & (ratio > 0.3) & (ratio < 3.0)).select("doc_id", "a", "b").distinct()


def same_words(a: Column, b: Column) -> Column:
    """The offline alias judge: equal sets of content words."""
    return F.array_sort(content_words(a)) == F.array_sort(content_words(b))


def alias_components(matched: DataFrame, leaders: DataFrame, most: int = 2000) -> DataFrame:
    """A3: doc_id, name, canonical of matched leaders: the most frequent leader of the component, then the smallest.

    matched: doc_id, a, b; leaders: doc_id, name, n. A document's graph is small and is joined up where it is; one of more than
    `most` pairs goes through the distributed rounds, as a graph of all documents would.
    """
    matched = matched.select("doc_id", "a", "b").distinct()
    sizes = matched.groupBy("doc_id").agg((F.count("*") > most).alias("large"))
    split = materialize(matched.join(sizes, "doc_id"), "aliases")

    def roots(key: tuple, pairs: pa.Table) -> pa.Table:
        parent: dict[str, str] = {}

        def root(x: str) -> str:
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        for a, b in zip(pairs["a"].to_pylist(), pairs["b"].to_pylist(), strict=True):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
        names = list(parent)
        return pa.table({"doc_id": pa.array([key[0].as_py()] * len(names), pairs.schema.field("doc_id").type), "name": names, "root": [root(n) for n in names]})

    kind = matched.schema["doc_id"].dataType.simpleString()
    small = split.filter("not large").groupBy("doc_id").applyInArrow(roots, f"doc_id {kind}, name string, root string")
    large = split.filter("large")
    if not large.isEmpty():
        ends = large.select(F.struct("doc_id", F.col("a").alias("name")).alias("a"), F.struct("doc_id", F.col("b").alias("name")).alias("b"))
        small = small.unionByName(components(ends).select("node.doc_id", "node.name", F.col("root.name").alias("root")))
    counted = small.join(leaders, ["doc_id", "name"])
    best = counted.groupBy("doc_id", "root").agg(F.min_by("name", F.struct((-F.col("n")).alias("n"), "name")).alias("canonical"))
    return counted.join(best, ["doc_id", "root"]).select("doc_id", "name", "canonical")
