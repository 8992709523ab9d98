"""Bridge chains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmesh.functions.text import bind, first_of_each, hop_path, numbered, surface_form


def atomic_seeds(shared: DataFrame, least_layouts: int = 3, most: int = 30) -> DataFrame:
    """The named entities of enough layouts; of each document the first by crossing modalities, fewest layouts, name."""
    order = Window.partitionBy("doc_id").orderBy(F.desc("cross_modal"), "num_layouts", "canonical_name")
    seeds = shared.filter(F.col("is_named_entity") & (F.col("num_layouts") >= least_layouts))
    return seeds.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def seed_appearances(seeds: DataFrame, contents: DataFrame, most: int = 6, extra: list[str] | None = None) -> DataFrame:
    """Of each seed the first text and the first visual layouts that name it, with the surface form found there.

    The first appearances are cut from the seed's own array, so no window is needed. extra: further columns of contents.
    """
    names = F.concat(F.array("canonical_name"), "aliases")
    some = [F.slice(F.filter("appearances", kind), 1, most) for kind in (lambda a: a["modality"] == "text", lambda a: a["modality"] != "text")]
    out = seeds.select("doc_id", "canonical_name", names.alias("names"), F.inline(F.concat(*some)))
    out = out.join(contents.select("doc_id", "layout_id", "content", *(extra or [])), ["doc_id", "layout_id"])
    return out.withColumn("shared_entity", surface_form(F.col("content"), F.col("names"))).filter("shared_entity is not null").drop("names")


def atomic_questions(appearances: DataFrame, pattern: str = "[A-Z][a-z]+") -> DataFrame:
    """Atomic QAs by the offline judge: about each appearance, answered by the layout's last mention of another name; both roles.

    appearances have text and ocr_text: the names are found again in these few layouts, which is less than to join all mentions.
    sh_id numbers a document's by name, layout and role (W1).
    """
    names = first_of_each(F.regexp_extract_all(F.coalesce("text", "ocr_text"), F.lit(pattern), F.lit(0)), lambda n, i: n)
    others = bind(F.lower("shared_entity"), lambda own: F.filter(names, lambda n: F.lower(n) != own))
    out = appearances.withColumn("answer", F.try_element_at(others, F.lit(-1))).filter("answer is not null").drop("text", "ocr_text")
    out = out.withColumn("question_role", F.explode(F.array(F.lit("bridge"), F.lit("target"))))
    order = Window.partitionBy("doc_id").orderBy("canonical_name", "layout_id", "question_role")
    return out.withColumn("sh_id", numbered("sh", F.col("doc_id"), F.row_number().over(order)))


def with_text_redundancy(atomic: DataFrame, layouts: DataFrame, least: int = 30) -> DataFrame:
    """text_redundant of visual targets: a text chunk of the document names both the entity and the answer.

    The pairs to look for are few and the chunks many: they meet by document, and the first hit is enough.
    """
    chunks = layouts.filter((F.col("modality") == "text") & (F.length("text") >= least)).select("doc_id", F.lower("text").alias("chunk"))
    asked = atomic.filter("question_role = 'target' and modality != 'text'").select("doc_id", "sh_id", F.lower("shared_entity").alias("e"), F.lower("answer").alias("s"))
    held = (asked["doc_id"] == chunks["doc_id"]) & F.contains(chunks["chunk"], asked["e"]) & F.contains(chunks["chunk"], asked["s"])
    hits = asked.join(chunks, held, "left_semi").select("sh_id", F.lit(True).alias("text_redundant"))
    return atomic.join(hits, "sh_id", "left").withColumn("text_redundant", F.coalesce("text_redundant", F.lit(False)))


def bridge_pairs(atomic: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Bridge questions with targets of the same surface form in other layouts.

    A target that text makes redundant is no second hop of another modality. At most twelve appearances a seed bound the pairs.
    extra: further columns of either side.
    """
    side = lambda role, n: atomic.filter(F.col("question_role") == role).select("doc_id", "shared_entity", *(F.col(c).alias(f"{c}{n}") for c in ("sh_id", "layout_id", "page_id", "modality", "answer", "text_redundant", *(extra or []))))
    pairs = side("bridge", 1).join(side("target", 2), ["doc_id", "shared_entity"]).filter("layout_id1 != layout_id2 and not (text_redundant2 and modality1 != modality2)")
    pairs = pairs.withColumn("hop_path", hop_path(F.col("modality1"), F.col("modality2"))).withColumn("cross_modal", F.col("modality1") != F.col("modality2")).withColumn("cross_page", F.col("page_id1") != F.col("page_id2"))
    order = Window.partitionBy("doc_id").orderBy(F.desc("cross_modal"), F.desc("cross_page"), "sh_id1", "sh_id2")
    pairs = pairs.withColumn("mh_id", numbered("mh", F.col("doc_id"), F.row_number().over(order)))
    return pairs.withColumn("final_answer", F.col("answer2")).withColumn("quality_score", 10.0 - 2.0 * (F.length("answer2") < 4).cast("int"))


def dedup_pairs(pairs: DataFrame) -> DataFrame:
    """D3: one chain for each unordered pair of layouts, the first by id."""
    key = [F.least("layout_id1", "layout_id2"), F.greatest("layout_id1", "layout_id2")]
    order = Window.partitionBy("doc_id", *key).orderBy("mh_id")
    return pairs.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")
