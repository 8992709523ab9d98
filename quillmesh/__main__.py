"""Runs a stage from files to files: python -m quillmesh STAGE --corpus FILE --work FOLDER.

Each stage reads its predecessors' tables in the work folder and writes its own there, and with --json a file for each document too.
Judges answer by --base-url and --model, or with recorded replies (--replies, a Parquet table of prompt_sha and reply).
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh import stages
from quillmesh.functions.text import truthy
from quillmesh.operators import evaluation, synthesis
from quillmesh.operators.judge import HttpJudge, ReplayJudge
from quillmesh.sources import files

#: stage: what it reads besides the corpus, the key that orders a document's rows in its files
STAGES = {
    "captions": ([], "layout_id"), "entities": ([], "layout_id"), "link": (["entities"], "position"), "atomic": (["link"], "sh_id"), "compose": (["atomic"], "mh_id"), "shortcut": (["compose"], "mh_id"),
    "modality": (["shortcut"], "mh_id"), "review": (["modality"], "mh_id"), "candidates": (["link"], "rank"), "facts": (["link"], "entity"), "patterns": (["facts"], "entity"), "synthesis": (["patterns"], "sq_id"),
    "validate": (["synthesis"], "sq_id"), "assemble": (["review", "validate", "atomic"], "question_id"), "evaluate": ([], "question_id"),
}


def options(argv: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser("quillmesh", description=__doc__)
    p.add_argument("stage", choices=STAGES)
    p.add_argument("--corpus", help="documents with their layouts, a JSON array")
    p.add_argument("--work", required=True, help="folder of the stages' tables")
    p.add_argument("--json", action="store_true", help="write a JSON file for each document too")
    p.add_argument("--images", help="folder of layouts' and pages' images")
    p.add_argument("--doc-id", type=int)
    p.add_argument("--doc-ids", type=int, nargs="*", default=[])
    p.add_argument("--start-doc", type=int, default=0)
    p.add_argument("--end-doc", type=int, default=0, help="0: to the last")
    p.add_argument("--replies", help="recorded replies")
    p.add_argument("--base-url")
    p.add_argument("--model", default="")
    p.add_argument("--api-key", default="")
    p.add_argument("--workers", type=int, default=16)
    p.add_argument("--force", action="store_true", help="do documents again that have been done")
    p.add_argument("--benchmark", help="questions with their truth, for evaluate")
    p.add_argument("--answers", help="folder of the systems' answers, for evaluate")
    p.add_argument("--systems", nargs="*", default=[])
    p.add_argument("--skip-step-coverage", action="store_true")
    p.add_argument("--fill-missing", action="store_true", help="score again what an earlier run left without a metric")
    p.add_argument("--reasons", action="store_true", help="ask the judge why")
    return p.parse_args(argv)


def backend(spark: SparkSession, o: argparse.Namespace):
    if o.replies:
        return ReplayJudge(spark.read.parquet(o.replies))
    return HttpJudge(o.base_url or "", o.model, o.api_key, workers=o.workers) if o.base_url else ReplayJudge(spark.createDataFrame([], "prompt_sha string, reply string"))


def evaluate(spark: SparkSession, o: argparse.Namespace, judge) -> DataFrame:
    """Answers paired with their truth, scored where they haven't been; metrics and summary are written by system."""
    truth = files.selected(files.benchmark(spark, o.benchmark), o.doc_id, o.start_doc, o.end_doc, o.doc_ids)
    kinds = F.transform("evidence_sources", lambda e: e["modality"])
    steps = F.when(F.size("reasoning_trace") > 0, F.transform("reasoning_trace", lambda h: F.concat_ws(" -> ", h["sub_question"], h["result"]))).otherwise(F.transform("answer.evidence_points", lambda e: e["fact"]))
    names = evaluation.benchmark_entities(F.col("bridge_entities"), F.col("reasoning_trace"), F.col("answer.evidence_points"), F.col("final_answer"))
    known = truth.select("doc_id", "question_id", F.col("final_answer").alias("t_final_answer"), F.col("answer.synthesis_conclusion").alias("t_conclusion"), F.col("question_type").alias("t_question_type"), kinds.alias("t_modalities"), F.col("num_hops").alias("t_num_hops"), F.col("hop_path").alias("t_hop_path"), steps.alias("t_steps"), names.alias("t_names"))
    extra = known.select("doc_id", "question_id", F.col("t_steps").alias("steps"), F.col("t_names").alias("names"))
    said = None
    for system in o.systems:
        one = files.answers(spark, f"{o.answers}/{system}", system)
        said = one if said is None else said.unionByName(one)
    said = said.join(known.select("doc_id").distinct(), "doc_id", "left_semi")
    cached = None if o.force else files.cached_metrics(spark, f"{o.work}/evaluate")
    key, scores = ["system", "doc_id", "question_id"], ["step_coverage", "entity_recall"]
    if cached is not None:
        whole = F.lit(True) if not o.fill_missing else F.col("step_coverage").isNotNull() & F.col("entity_recall").isNotNull()
        said = evaluation.not_yet_done(said, cached.filter(whole), key)
    paired = evaluation.pair_with_truth(said, known.drop("t_steps", "t_names")).join(extra, ["doc_id", "question_id"], "left")
    _, _, recall = evaluation.entity_recall(F.col("retrieved_context"), F.coalesce("names", F.array().cast("array<string>")))
    scored = paired.withColumn("entity_recall", recall).withColumn("has_retrieved_context", truthy(F.col("retrieved_context")).isNotNull())
    scored = scored.withColumn("step_coverage", F.lit(None).cast("double")) if o.skip_step_coverage else stages.coverage(scored, judge)
    out = scored.select("system", "doc_id", "question_id", "question_type", "assigned_type", "modality_type", "hop_path", "num_hops", "query", "gt_answer", "response", "has_retrieved_context", "step_coverage", "entity_recall")
    if o.reasons:
        out = stages.reasons(out, scores, judge)
    if cached is None:
        return out
    out = stages.materialize(out, "fresh")
    return evaluation.fill_missing(cached, out, key, scores).unionByName(evaluation.not_yet_done(out, cached, key), allowMissingColumns=True)


def run(spark: SparkSession, argv: list[str]) -> DataFrame:
    """The stage's table, written and read again."""
    o = options(argv)
    judge, table = backend(spark, o), lambda name: spark.read.parquet(f"{o.work}/{name}")
    rejected = None
    if o.stage == "evaluate":
        out = stages.materialize(evaluate(spark, o, judge), "metrics")
        dims = ["question_type", "modality_type", "hop_path"]
        summary = stages.materialize(evaluation.summary(out, ["step_coverage", "entity_recall"], dims), "summary")
        files.write_metrics(out, summary, f"{o.work}/evaluate")
        print(*files.report(summary), sep="\n")
        return files.cached_metrics(spark, f"{o.work}/evaluate")
    base = None
    if o.corpus:
        base = files.layouts_of(files.selected(files.corpus(spark, o.corpus), o.doc_id, o.start_doc, o.end_doc, o.doc_ids))
        if o.images:
            base = files.with_images(base, files.images(spark, o.images))
    before = [files.selected(table(name), o.doc_id, o.start_doc, o.end_doc, o.doc_ids) for name in STAGES[o.stage][0]]
    if o.stage == "captions":
        out = stages.captions(base, judge).drop("image")
    elif o.stage == "entities":
        out = stages.mentions(base, judge)
    elif o.stage == "link":
        out = stages.shared(before[0], judge)
    elif o.stage == "atomic":
        out = stages.atomic(before[0], base, judge).drop("image")
    elif o.stage == "compose":
        out = stages.chains(before[0], judge)
    elif o.stage == "shortcut":
        out, rejected = stages.shortcut(before[0], base, judge)
    elif o.stage == "modality":
        there = files.existing_pages(base, files.images(spark, o.images)) if o.images else None
        out, rejected = stages.modality(before[0], base, judge, there)
    elif o.stage == "review":
        out, rejected = stages.review(before[0], judge)
    elif o.stage == "candidates":
        out = synthesis.candidates(before[0])
    elif o.stage == "facts":
        out = stages.facts(before[0], base, judge)
    elif o.stage == "patterns":
        out = stages.patterns(before[0], judge)
    elif o.stage == "synthesis":
        out = stages.syntheses(before[0], judge)
    elif o.stage == "validate":
        out = stages.validate(before[0], base, judge)
    else:
        out = evaluation.assemble(before[0].drop("filter_result"), before[1], before[2])
    out.write.mode("overwrite").parquet(f"{o.work}/{o.stage}")
    if rejected is not None:
        rejected.write.mode("overwrite").parquet(f"{o.work}/{o.stage}_rejected")
    if o.json:
        files.write_documents(table(o.stage), f"{o.work}/json", f"doc{{}}_{o.stage}.json", [STAGES[o.stage][1]])
    return table(o.stage)


if __name__ == "__main__":
    session = SparkSession.builder.appName("quillmesh").getOrCreate()
    print(run(session, sys.argv[1:]).count(), "rows")
    session.stop()
