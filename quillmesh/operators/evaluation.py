"""Evaluation (S7, J4, P18-P24, A6, A7, A12, J5, J14): pairing with ground truth, metrics, summaries, refills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.functions.text import bind, derive_modality, distinct_names, share, strip, text_or_empty, truthy


def pair_with_truth(answers: DataFrame, truth: DataFrame) -> DataFrame:
    """Answers with their ground truth, if any, and the row's fields filled up from it.

    answers: doc_id, question_id, response, gt_answer, question_type, modality_type, num_hops, assigned_type, hop_path;
    truth: doc_id, question_id, and with the prefix t_ final_answer, conclusion (a synthesis's), answer (a plain one), question_type,
    modalities, num_hops, num_sources, assigned_type, hop_path; those that aren't there are null.
    """
    for c, kind in (("final_answer", "string"), ("conclusion", "string"), ("answer", "string"), ("question_type", "string"), ("modalities", "array<string>"), ("num_hops", "int"), ("num_sources", "int"), ("assigned_type", "string"), ("hop_path", "string")):
        if f"t_{c}" not in truth.columns:
            truth = truth.withColumn(f"t_{c}", F.lit(None).cast(kind))
    out = answers.join(truth, ["doc_id", "question_id"], "left")
    hops = F.coalesce("num_hops", "t_num_hops", "t_num_sources", F.lit(2))
    kind = F.coalesce(truthy(F.col("question_type")), truthy(F.col("t_question_type")), F.lit("unknown"))
    return (
        out.withColumn("gt_answer", F.coalesce(truthy(F.col("gt_answer")), F.col("t_final_answer"), truthy(F.col("t_conclusion")), F.col("t_answer"), F.lit("")))
        .withColumn("modality_type", F.when(F.coalesce(F.size("t_modalities"), F.lit(0)) > 0, derive_modality(F.col("t_modalities"), F.col("modality_type"))).otherwise(F.coalesce(truthy(F.col("modality_type")), F.lit("unknown"))))
        .withColumn("num_hops", hops)
        .withColumn("question_type", kind)
        .withColumn("assigned_type", F.coalesce(truthy(F.col("assigned_type")), truthy(F.col("t_assigned_type")), F.when(kind == "bridge_chain", F.format_string("bridge_%dhop", hops)), kind))
        .withColumn("hop_path", F.coalesce("t_hop_path", "hop_path", F.lit("")))
        .drop(*(c for c in truth.columns if c.startswith("t_")))
    )


# The lines of an enriched reference, which judges are asked about.
FINAL, CHAIN, HOP, BRIDGES, EVIDENCE = "Final answer: ", "Reasoning chain:", "  Hop ", "Bridge entities: ", "Required evidence points:"


def enriched_reference(gt_answer: Column, kind: Column, trace: Column, bridges: Column, points: Column) -> Column:
    """The final answer, then what leads to it: hops and bridges, or the evidence.

    trace: array of (hop, sub_question, result); bridges: names; points: array of facts.
    """
    first = F.concat(F.lit(FINAL), gt_answer)
    hops = F.filter(trace, lambda h: (strip(text_or_empty(h["sub_question"])) != "") & (strip(text_or_empty(h["result"])) != ""))
    said = F.transform(hops, lambda h: F.concat(F.lit(HOP), h["hop"], F.lit(": "), strip(h["sub_question"]), F.lit(" -> "), strip(h["result"])))
    none = F.array().cast("array<string>")
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    chain = F.concat(F.when(some(trace), F.concat(F.array(F.lit(""), F.lit(CHAIN)), said)).otherwise(none), F.when(some(bridges), F.array(F.lit(""), F.concat(F.lit(BRIDGES), F.array_join(bridges, ", ")))).otherwise(none))
    numbered = F.filter(F.transform(points, lambda p, i: F.when(strip(text_or_empty(p)) != "", F.concat(F.lit("  "), i + 1, F.lit(". "), strip(p)))), lambda x: x.isNotNull())
    evidence = F.when(some(points), F.concat(F.array(F.lit(""), F.lit(EVIDENCE)), numbered)).otherwise(none)
    return F.array_join(F.concat(F.array(first), F.when(kind == "bridge_chain", chain).when(kind == "synthesis", evidence).otherwise(none)), "\n")


def benchmark_entities(bridges: Column, trace: Column, points: Column, final_answer: Column) -> Column:
    """What a retrieved context should name: bridge entities, hops' results, evidence's data points, the final answer, each once.

    bridges: array of strings; trace: array of structs with result; points: array of structs with data_points. Any may be null.
    """
    none = F.array().cast("array<string>")
    parts = [F.coalesce(bridges, none), F.coalesce(F.transform(trace, lambda h: h["result"]), none), F.coalesce(F.flatten(F.transform(points, lambda p: F.coalesce(p["data_points"], none))), none), F.array(final_answer)]
    return distinct_names(F.filter(F.concat(*parts), lambda n: n.isNotNull()))


def entity_recall(context: Column, names: Column) -> tuple[Column, Column, Column]:
    """Hits, total and recall of distinct names in the whole context; 0 without context, null without names."""
    unique, text = distinct_names(names), F.lower(text_or_empty(context))
    hits = bind(text, lambda t: F.size(F.filter(unique, lambda n: F.contains(t, F.lower(n)))))
    return hits, F.size(unique), F.when(text_or_empty(context) == "", F.lit(0.0)).otherwise(share(hits, F.size(unique)))


def step_coverage(response: Column, kind: Column, steps: Column, covered: Column) -> Column:
    """Share of steps that the response covers. 0 for an empty response; null for single hops, without steps, or a failed judge."""
    return F.when(text_or_empty(response) == "", F.lit(0.0)).when(kind == "single_hop", None).when(covered.isNotNull(), share(F.size(F.filter(covered, lambda x: x)), F.size(steps)))


def _long(metrics: DataFrame, metric: list[str], dims: list[str]):
    """A row for each metric's value and each group that it counts for, grouped."""
    long = metrics.select(*dims, F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metric])))
    long = long.filter("value is not null and not isnan(value) and abs(value) != double('infinity')")
    rows = F.array(F.struct(F.lit("overall").alias("dim"), F.lit("").alias("key")), *[F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("key")) for d in dims])
    return long.select("metric", "value", F.inline(rows)).groupBy("dim", "key", "metric")


def summary(metrics: DataFrame, metric: list[str], dims: list[str]) -> DataFrame:
    """Mean, population deviation and count of each metric, over all and by each dimension, in one pass.

    Nulls, NaN and infinities don't count; a metric without a value has no row. dim names the dimension, or is `overall`.
    """
    return _long(metrics, metric, dims).agg(F.round(F.avg("value"), 4).alias("mean"), F.round(F.stddev_pop("value"), 4).alias("std"), F.count("*").alias("n"))


def partial_sums(metrics: DataFrame, metric: list[str], dims: list[str]) -> DataFrame:
    """What summary_of() needs of some of the rows: count, mean and variance by group."""
    return _long(metrics, metric, dims).agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.var_pop("value").alias("var"))


def summary_of(sums: DataFrame) -> DataFrame:
    """The summary over all rows out of the partial sums of parts of them."""
    whole = sums.groupBy("dim", "key", "metric").agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("m"), (F.sum(F.col("n") * (F.col("var") + F.col("mean") * F.col("mean"))) / F.sum("n")).alias("s"))
    return whole.select("dim", "key", "metric", F.round("m", 4).alias("mean"), F.round(F.sqrt(F.greatest(F.col("s") - F.col("m") * F.col("m"), F.lit(0.0))), 4).alias("std"), "n")


def fill_missing(cached: DataFrame, fresh: DataFrame, key: list[str], metric: list[str]) -> DataFrame:
    """Cached metrics, nulls filled from fresh ones."""
    new = fresh.select(*key, *[F.col(m).alias(f"_new_{m}") for m in metric])
    out = cached.join(new, key, "left")
    return out.select(*[F.coalesce(c, f"_new_{c}").alias(c) if c in metric else F.col(c) for c in cached.columns])


def missing_metrics(metrics: DataFrame, group: list[str], metric: list[str]) -> DataFrame:
    """Whether any row of a group lacks a metric."""
    return metrics.groupBy(*group).agg(*[F.bool_or(F.col(m).isNull()).alias(f"lacks_{m}") for m in metric])


def not_yet_done(wanted: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """What has no result yet."""
    return wanted.join(done.select(*key).distinct(), key, "left_anti")


def assemble(bridge: DataFrame, synthesis: DataFrame, single: DataFrame) -> DataFrame:
    """K7: one benchmark of three topologies by name. Ours: chains that passed, syntheses that passed, all single hops."""
    parts = [(bridge, "bridge_chain", "mh_id"), (synthesis, "synthesis", "sq_id"), (single, "single_hop", "sh_id")]
    out = None
    for rows, kind, key in parts:
        rows = rows.filter("filter_result = 'pass'") if "filter_result" in rows.columns else rows
        part = rows.withColumn("question_type", F.lit(kind)).withColumn("question_id", F.col(key))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out
