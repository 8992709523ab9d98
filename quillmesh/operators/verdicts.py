"""Filters by verdict (F15-F19, L9h-L12h, D4, W2, A8, A10, A13): shortcut, modality, review, leave-one-out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmesh.functions.text import answer_matches, least_score, strip

# The names of verdicts, which outputs must match.
PASS, NO_LAYOUT, HOP1, HOP2 = "pass", "skip_missing_layout", "fail_hop1_sufficient", "fail_hop2_sufficient"
ONE_MODALITY, BY_TEXT, BY_SIGHT = "skip_not_cross_modal", "fail_text_only_sufficient", "fail_visual_only_sufficient"
TOO_FEW, BY_TEXT_RAG = "fail_insufficient_required_evidence", "fail_text_rag_sufficient"


def shortcut_verdict(first_seen: Column, second_seen: Column, first: Column, second: Column) -> Column:
    """fails where one hop alone gives the answer; skipped where a layout is missing; an unknown probe passes."""
    return (
        F.when(~(first_seen & second_seen), NO_LAYOUT)
        .when(F.coalesce(first, F.lit(False)), HOP1)
        .when(F.coalesce(second, F.lit(False)), HOP2)
        .otherwise(PASS)
    )


def shortcuts(chains: DataFrame, probes: DataFrame) -> DataFrame:
    """Chains with filter_result. probes: doc_id, layout_id, predicted: the answer that a layout alone gives."""
    out = chains
    for n in (1, 2):
        one = probes.select("doc_id", F.col("layout_id").alias(f"layout_id{n}"), F.col("predicted").alias(f"predicted{n}"), F.lit(True).alias(f"seen{n}"))
        out = out.join(one, ["doc_id", f"layout_id{n}"], "left")
    seen = [F.coalesce(F.col(f"seen{n}"), F.lit(False)) for n in (1, 2)]
    hits = [answer_matches(F.col(f"predicted{n}"), F.col("final_answer")) for n in (1, 2)]
    return out.withColumn("filter_result", shortcut_verdict(*seen, *hits)).drop("seen1", "seen2", "predicted1", "predicted2")


def dedup_answers(chains: DataFrame) -> DataFrame:
    """Of the chains that passed one for each list of bridge entities and answer, the best, then the first by id.

    Entities are told apart as they are written, answers by their stripped lower-case form. A chain without bridge_entities has its
    shared entity as the only one.
    """
    bridges = F.col("bridge_entities") if "bridge_entities" in chains.columns else F.array("shared_entity")
    order = Window.partitionBy("doc_id", bridges, strip(F.lower("final_answer"))).orderBy(F.desc("quality_score"), "mh_id")
    passed = chains.filter(F.col("filter_result") == PASS) if "filter_result" in chains.columns else chains
    return passed.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def packed_context(layouts: DataFrame, cap: int = 200_000, least: int = 30) -> DataFrame:
    """A document's text chunks, then its image texts, up to the first that would overflow the cap.

    Each costs its length and two; a later, shorter one doesn't slip in. doc_id, layout_id, ord, chunk.
    """
    text = layouts.filter((F.col("modality") == "text") & (F.length("text") >= least)).select("doc_id", "layout_id", F.lit(0).alias("kind"), F.col("text").alias("chunk"))
    seen = layouts.filter((F.col("modality") != "text") & (F.length("ocr_text") >= least)).select("doc_id", "layout_id", F.lit(1).alias("kind"), F.concat(F.lit("["), "modality", F.lit(" OCR text] "), "ocr_text").alias("chunk"))
    order = Window.partitionBy("doc_id").orderBy("kind", "layout_id")
    both = text.unionByName(seen).withColumn("before", F.coalesce(F.sum(F.length("chunk") + 2).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    both = both.withColumn("over", F.max((F.col("before") + F.length("chunk") > cap).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return both.withColumn("ord", F.row_number().over(order)).filter("over = 0").select("doc_id", "layout_id", "ord", "chunk")


def visual_pages(layouts: DataFrame, most: int = 5, existing: DataFrame | None = None) -> DataFrame:
    """doc_id and its first pages with a figure or table, in order; of these only those whose image exists.

    existing: doc_id and page_id of the images there are; None where all are there.
    """
    seen = layouts.filter(F.col("modality").isin("figure", "table"))
    if existing is not None:
        seen = seen.join(existing.select("doc_id", "page_id"), ["doc_id", "page_id"], "left_semi")
    return seen.groupBy("doc_id").agg(F.slice(F.array_sort(F.collect_set("page_id")), 1, most).alias("pages"))


def modality_verdicts(chains: DataFrame, context: DataFrame, layouts: DataFrame, pages: DataFrame) -> DataFrame:
    """F16: filter_result of chains; what doesn't cross modalities is kept unprobed, and only what text doesn't answer is probed on images.

    The two probes are semi joins on filtered branches, so a costly judge in their place would see no row in vain.
    """
    crossing = chains.filter("cross_modal")
    asked = crossing.select("doc_id", "mh_id", F.lower("final_answer").alias("gold"))
    said = context.select(F.col("doc_id").alias("_doc"), F.lower("chunk").alias("_said"))
    by_text = asked.join(said, (F.col("doc_id") == F.col("_doc")) & F.contains("_said", F.col("gold")), "left_semi").select("mh_id")
    left = asked.join(by_text, "mh_id", "left_anti")
    shown = layouts.join(pages.select("doc_id", F.explode("pages").alias("page_id")), ["doc_id", "page_id"]).filter("modality != 'text'")
    shown = shown.select(F.col("doc_id").alias("_doc"), F.lower("ocr_text").alias("_said"))
    by_sight = left.join(shown, (F.col("doc_id") == F.col("_doc")) & F.contains("_said", F.col("gold")), "left_semi").select("mh_id")
    verdicts = by_text.select("mh_id", F.lit(BY_TEXT).alias("_v")).unionByName(by_sight.select("mh_id", F.lit(BY_SIGHT).alias("_v")))
    out = chains.join(verdicts, "mh_id", "left")
    return out.withColumn("filter_result", F.when(~F.col("cross_modal"), ONE_MODALITY).otherwise(F.coalesce("_v", F.lit(PASS)))).drop("_v")


def final_review(rows: DataFrame, dims: list[str], least: float = 7) -> DataFrame:
    """min_score and keep; a row whose review failed altogether (all dims null) is kept."""
    low = least_score(*[F.col(d) for d in dims])
    failed = F.coalesce(*[F.col(d).cast("double") for d in dims]).isNull()
    return rows.withColumn("min_score", F.when(failed, 5).otherwise(low)).withColumn("keep", failed | (low >= least))


def leave_one_out(points: DataFrame, key: list[str], least: int = 3) -> DataFrame:
    """Key, required, optional, num_required, n_llm_failed, modalities, filter_result. points: key, fact_no, modality, data_points.

    A point is needless if another point of its answer has all its data; each is judged against all others. The points of
    one answer are an array, so judging needs no join. Null data is what the judge failed on: such a point counts as required.
    modalities are those of the required points.
    """
    whole = points.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("fact_no", "modality", "data_points"))).alias("p"))
    covered = lambda x: F.coalesce(F.exists("p", lambda y: (y["fact_no"] != x["fact_no"]) & F.coalesce(F.size(F.array_except(x["data_points"], y["data_points"])) == 0, F.lit(False))), F.lit(False))
    out = whole.withColumn("_kept", F.filter("p", lambda x: ~covered(x)))
    out = out.select(
        *key, F.transform("_kept", lambda x: x["fact_no"]).alias("required"), F.transform(F.filter("p", covered), lambda x: x["fact_no"]).alias("optional"), F.size("_kept").alias("num_required"),
        F.size(F.filter("p", lambda x: x["data_points"].isNull())).alias("n_llm_failed"), F.array_sort(F.array_distinct(F.transform("_kept", lambda x: x["modality"]))).alias("modalities"),
    )
    return out.withColumn("filter_result", F.when(F.size("required") < least, TOO_FEW).otherwise(PASS))


def verdict_counts(rows: DataFrame, group: list[str], column: str = "filter_result") -> DataFrame:
    """Rows and passes per group, and the share that passes."""
    return rows.groupBy(*group).agg(F.count("*").alias("total"), F.count_if(F.col(column) == "pass").alias("passed"), F.round(F.avg((F.col(column) == "pass").cast("double")), 4).alias("pass_rate"))
