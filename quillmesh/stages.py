"""Stages with judges (L1-L21): tables in, tables out. A judge's output is written before it is used, so it is paid for once.

What a failed judge stands for (X6) is said at each stage: questions, answers, scores, compositions, facts and patterns drop their row;
probes and reviews keep it; a necessity that isn't known makes its evidence required.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmesh.functions import text as T
from quillmesh.operators import compose, evaluation, linking, retrieval, synthesis, verdicts
from quillmesh.operators.judge import FAIL_OPEN, judge, passes, said
from quillmesh.prompts import ROLES, TEMPLATES, evidence_lines, fact_lines, render
from quillmesh.storage import materialize

#: Attempts at the question of a picture that is to be a target, and at any other.
TRIES, ONE_TRY = 3, 1
MIN_SCORE = 8.0


def ask(df: DataFrame, name: str, schema: str, backend, into: str = "verdict", image: str | None = None, **values: Column) -> DataFrame:
    """df with the judge's verdict on a prompt, written; null where it failed."""
    prompted = df.withColumn("_prompt", render(TEMPLATES[name], **values))
    return materialize(judge(prompted, "_prompt", schema, backend, into, image).drop("_prompt"), name)


def tell(df: DataFrame, name: str, backend, into: str, image: str | None = None, **values: Column) -> DataFrame:
    """df with the judge's own words, without quotes around them, written."""
    prompted = df.withColumn("_prompt", render(TEMPLATES[name], **values))
    return materialize(said(prompted, "_prompt", backend, into, image).drop("_prompt"), name)


def _columns(*names: str) -> dict[str, Column]:
    return {n: F.col(n) for n in names}


def _image(df: DataFrame) -> str | None:
    return "image" if "image" in df.columns else None


def captions(layouts: DataFrame, backend) -> DataFrame:
    """Layouts with caption and topic of figures and tables, asked page by page; failed: no caption, an empty topic."""
    seen = layouts.filter(F.col("modality").isin("figure", "table"))
    shown = {"image": F.first("image").alias("image")} if "image" in layouts.columns else {}
    named = F.transform(F.array_sort(F.collect_list(F.struct("layout_id", "modality", T.clip(T.text_or_empty(F.col("ocr_text")), 80).alias("begin")))), lambda x: F.concat(x["layout_id"].cast("string"), F.lit(" ("), x["modality"], F.lit(") "), x["begin"]))
    pages = seen.groupBy("doc_id", "page_id").agg(F.array_join(named, ", ").alias("layouts"), *shown.values())
    told = ask(pages, "caption", "array<struct<layout_id int, caption string, topic string>>", backend, image=_image(pages), **_columns("page_id", "layouts"))
    given = told.select("doc_id", "page_id", F.posexplode("verdict").alias("_at", "v")).groupBy("doc_id", "page_id", F.col("v.layout_id").alias("layout_id")).agg(F.max_by("v", "_at").alias("v"))
    out = layouts.join(given.select("doc_id", "layout_id", "v"), ["doc_id", "layout_id"], "left")
    visual = F.col("modality").isin("figure", "table")
    return out.withColumn("caption", F.when(visual, F.col("v.caption")).otherwise(F.col("caption"))).withColumn("topic", F.when(visual, F.coalesce("v.topic", F.lit(""))).otherwise(F.col("topic"))).drop("v")


def mentions(layouts: DataFrame, backend) -> DataFrame:
    """doc_id, layout_id, page_id, modality, ord, name, type; a layout on which the judge failed has none."""
    rows = layouts.withColumn("content", T.layout_content()).filter("content is not null")
    told = ask(rows, "entity", "array<struct<name string, type string>>", backend, image=_image(rows), **_columns("modality", "page_id", "content"))
    found = told.select("doc_id", "layout_id", "page_id", "modality", F.posexplode("verdict").alias("ord", "v"))
    found = found.select("doc_id", "layout_id", "page_id", "modality", "ord", T.strip(F.col("v.name")).alias("name"), F.coalesce(T.truthy(F.col("v.type")), F.lit("unknown")).alias("type")).filter("name != ''")
    first = Window.partitionBy("doc_id", "layout_id", F.lower("name")).orderBy("ord")
    return found.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def shared(found: DataFrame, backend) -> DataFrame:
    """Entities of several layouts; names that the judge matches are one. Failed: no match."""
    leaders = linking.canonical_counts(found)
    pairs = linking.alias_candidates(leaders.select("doc_id", "name"))
    told = ask(pairs, "entity_match", "match boolean", backend, **_columns("a", "b"))
    matched = told.filter(F.coalesce("verdict.match", F.lit(False))).select("doc_id", "a", "b")
    return linking.shared_entities(found, aliases=materialize(linking.alias_components(matched, leaders), "matched"))


def _asked(rows: DataFrame, backend) -> DataFrame:
    """Rows with question, answer, answer_type and quality_score; a row that any step drops is gone."""
    visual = F.col("modality").isin("figure", "table")
    role = F.when(F.col("question_role") == "bridge", render(ROLES["bridge", False], entity=F.col("shared_entity"))).when(visual, F.lit(ROLES["target", True])).otherwise(F.lit(ROLES["target", False]))
    where, image = _columns("modality", "page_id", "layout_id", "content"), _image(rows)
    out = tell(rows, "single_hop_question", backend, "question", image, entity=F.col("shared_entity"), role_instruction=role, **where)
    out = out.filter(F.length("question") >= T.MIN_QUESTION)
    out = ask(out, "single_hop_answer", "answer string, answer_type string", backend, image=image, question=F.col("question"), **where)
    out = out.withColumn("answer", F.col("verdict.answer")).withColumn("answer_type", F.coalesce("verdict.answer_type", F.lit("phrase"))).filter(T.text_or_empty(F.col("answer")) != "").drop("verdict")
    out = ask(out, "single_hop_score", "score double", backend, image=image, modality=F.col("modality"), content=T.clip(F.col("content"), 500), **_columns("question", "answer"))
    # a failed score stands for 5, which is under every threshold
    out = out.withColumn("quality_score", F.when(F.col("verdict").isNull(), 5.0).otherwise(F.coalesce("verdict.score", F.lit(0.0)))).drop("verdict")
    return out.filter(F.col("quality_score") >= F.when(F.col("question_role") == "target", T.quality_threshold(F.col("modality"))).otherwise(MIN_SCORE))


def atomic(entities: DataFrame, layouts: DataFrame, backend) -> DataFrame:
    """Atomic questions with sh_id; the question of a picture that is to be a target has three tries."""
    rows = layouts.withColumn("content", T.layout_content()).filter("content is not null")
    seen = compose.seed_appearances(compose.atomic_seeds(entities), rows, extra=[c for c in ("image",) if c in rows.columns])
    key = ["doc_id", "canonical_name", "layout_id", "question_role"]
    left = materialize(seen.withColumn("question_role", F.explode(F.array(F.lit("bridge"), F.lit("target")))), "roles")
    done = None
    for attempt in range(TRIES):
        found = materialize(_asked(left, backend), "atomic")
        done = found if done is None else done.unionByName(found)
        again = F.col("modality").isin("figure", "table") & (F.col("question_role") == "target")
        if attempt + 1 < TRIES:
            left = materialize(left.filter(again).join(found.select(key), key, "left_anti"), "again")
            if left.isEmpty():
                break
    order = Window.partitionBy("doc_id").orderBy("canonical_name", "layout_id", "question_role")
    numbered = materialize(done.withColumn("sh_id", T.numbered("sh", F.col("doc_id"), F.row_number().over(order))), "numbered")
    return compose.with_text_redundancy(numbered, layouts)


def chains(questions: DataFrame, backend) -> DataFrame:
    """Bridge chains that hint at their entity; a failed composition or a score under 8 drops the pair."""
    two = {f"{n}{k}": F.col(f"{n}{k}") for n in ("modality", "question", "answer") for k in (1, 2)}
    pairs = compose.bridge_pairs(questions, extra=["question", "answer_type", "canonical_name"])
    told = ask(pairs, "multihop_compose", "composed_question string, final_answer string, indirect_description string", backend, entity=F.col("shared_entity"), page_id1=F.col("page_id1"), page_id2=F.col("page_id2"), **two)
    out = told.withColumn("question", F.col("verdict.composed_question")).withColumn("final_answer", F.coalesce("verdict.final_answer", "answer2")).withColumn("indirect_description", F.coalesce("verdict.indirect_description", F.lit(""))).drop("verdict")
    out = out.filter((F.length("question") >= T.MIN_COMPOSED) & ~T.leaks(F.col("question"), F.col("shared_entity")))
    out = ask(out, "multihop_score", "score double", backend, entity=F.col("shared_entity"), answer=F.col("final_answer"), **_columns("question", "hop_path"), **two)
    out = out.withColumn("quality_score", F.when(F.col("verdict").isNull(), 5.0).otherwise(F.coalesce("verdict.score", F.lit(0.0)))).filter(F.col("quality_score") >= MIN_SCORE).drop("verdict")
    hop = lambda k: F.struct(F.lit(k).alias("hop"), F.col(f"modality{k}").alias("source_modality"), F.col(f"page_id{k}").alias("source_page"), F.col(f"layout_id{k}").alias("source_layout"), F.col(f"question{k}").alias("sub_question"), F.col(f"answer{k}").alias("result"))
    source = lambda k: F.struct(F.col(f"modality{k}").alias("modality"), F.col(f"layout_id{k}").alias("layout_id"), F.col(f"page_id{k}").alias("page_id"))
    out = compose.dedup_pairs(out).withColumn("num_hops", F.lit(2)).withColumn("answer_type", F.col("answer_type2")).withColumn("bridge_entities", F.array("shared_entity"))
    return out.withColumn("reasoning_trace", F.array(hop(1), hop(2))).withColumn("evidence_sources", F.array(source(1), source(2))).withColumn("source_single_hops", F.array("sh_id1", "sh_id2"))


_PROBE = "answerable boolean, answer string"


def _hit(verdict: str, gold: str = "final_answer") -> Column:
    """A probe's answer is the gold one; a failed probe isn't."""
    return F.coalesce(F.col(f"{verdict}.answerable") & T.answer_matches(F.col(f"{verdict}.answer"), F.col(gold)), F.lit(False))


def shortcut(rows: DataFrame, layouts: DataFrame, backend) -> tuple[DataFrame, DataFrame]:
    """Chains that need both hops, one for each entity and answer, and those that one hop answers; a failed probe passes."""
    content = layouts.select("doc_id", "layout_id", T.layout_content(least=None).alias("content"), *(c for c in ("image",) if c in layouts.columns))
    hops = rows.select("mh_id", "doc_id", "question", "final_answer", F.inline(F.array(*[F.struct(F.lit(k).alias("hop"), F.col(f"layout_id{k}").alias("layout_id"), F.col(f"modality{k}").alias("modality")) for k in (1, 2)])))
    probed = hops.join(content, ["doc_id", "layout_id"])
    told = ask(probed, "single_source", _PROBE, backend, image=_image(probed), **_columns("modality", "content", "question"))
    seen = told.groupBy("mh_id").agg(*[F.max(F.when(F.col("hop") == k, _hit("verdict"))).alias(f"hit{k}") for k in (1, 2)])
    out = rows.join(seen, "mh_id", "left")
    verdict = verdicts.shortcut_verdict(F.col("hit1").isNotNull(), F.col("hit2").isNotNull(), F.col("hit1"), F.col("hit2"))
    out = materialize(out.withColumn("filter_result", verdict).drop("hit1", "hit2"), "shortcut")
    return verdicts.dedup_answers(out), out.filter(F.col("filter_result").isin(verdicts.HOP1, verdicts.HOP2))


def modality(rows: DataFrame, layouts: DataFrame, backend, existing: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Chains that need several modalities or have but one, and those that text or pictures alone answer.

    Only what text doesn't answer is asked about pictures; a failed probe passes. The label is modality_filter.
    """
    whole = verdicts.packed_context(layouts).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "chunk"))), lambda c: c["chunk"]), "\n\n").alias("content"))
    crossing = rows.filter("cross_modal").join(whole, "doc_id", "left")
    told = ask(crossing, "text_only", _PROBE, backend, into="text_only_check", **_columns("content", "question")).drop("content")
    by_text = F.col("content").isNotNull()
    told = told.withColumn("_text", _hit("text_only_check"))
    left = told.filter("not _text").join(verdicts.visual_pages(layouts, existing=existing), "doc_id")
    sight = ask(left, "visual_only", _PROBE, backend, into="visual_only_check", pages=F.array_join(F.transform("pages", lambda p: p.cast("string")), ", "), question=F.col("question"))
    out = told.join(sight.select("mh_id", "visual_only_check", _hit("visual_only_check").alias("_sight")), "mh_id", "left")
    label = F.when(F.col("_text"), verdicts.BY_TEXT).when(F.coalesce("_sight", F.lit(False)), verdicts.BY_SIGHT).otherwise(verdicts.PASS)
    out = materialize(out.withColumn("modality_filter", label).drop("_text", "_sight"), "modality")
    kept = rows.filter("not cross_modal").withColumn("modality_filter", F.lit(verdicts.ONE_MODALITY)).unionByName(out.filter(F.col("modality_filter") == verdicts.PASS), allowMissingColumns=True)
    return kept, out.filter(F.col("modality_filter") != verdicts.PASS)


#: What a final review looks at, and a synthesis's score.
REVIEW, SYNTHESIS = ["naturalness", "answer_quality", "multi_hop_necessity"], ["question_clarity", "conclusion_quality", "multi_source_necessity"]


def review(rows: DataFrame, backend) -> tuple[DataFrame, DataFrame]:
    """Chains with all three scores 7 or more, and the others; a failed review keeps its row with 5."""
    told = ask(rows, "final_review", ", ".join(f"{d} double" for d in REVIEW), backend, into="final_review", answer=F.col("final_answer"), **_columns("question", "hop_path"))
    failed = F.col("final_review").isNull()
    low = T.least_score(*[F.col(f"final_review.{d}") for d in REVIEW])
    told = told.withColumn("min_score", F.when(failed, 5.0).otherwise(low)).withColumn("keep", passes(F.when(~failed, low >= 7), FAIL_OPEN))
    return told.filter("keep").orderBy("doc_id", F.desc("quality_score"), "mh_id"), told.filter("not keep")


def facts(entities: DataFrame, layouts: DataFrame, backend) -> DataFrame:
    """Facts of widespread entities with fact_id; a failed judge drops the fact."""
    content = layouts.withColumn("content", T.layout_content(lenient=True)).filter("content is not null")
    chosen = synthesis.candidates(entities)
    seen = chosen.select("doc_id", F.col("canonical_name").alias("entity"), F.concat(F.array("canonical_name"), "aliases").alias("names"), F.inline("appearances"))
    seen = seen.join(content.select("doc_id", "layout_id", "content", *(c for c in ("image",) if c in content.columns)), ["doc_id", "layout_id"]).filter(T.mentions_any(F.col("content"), F.col("names"))).drop("names")
    told = ask(seen, "fact", "fact string, data_points array<string>", backend, image=_image(seen), **_columns("entity", "modality", "page_id", "content"))
    found = told.filter(T.text_or_empty(F.col("verdict.fact")) != "").withColumn("fact", F.col("verdict.fact")).withColumn("data_points", F.coalesce("verdict.data_points", F.array().cast("array<string>"))).drop("verdict", "content", "image")
    out = synthesis.enough_facts(synthesis.dedup_facts(found))
    return out.withColumn("fact_id", F.format_string("f%d", "fact_no"))


_FACT = ("fact_id", "layout_id", "page_id", "modality", "fact", "data_points")


def patterns(known: DataFrame, backend) -> DataFrame:
    """Patterns of entities that rest on three facts or more; a failed judge drops the entity. Unknown ids vanish from required_facts."""
    held = known.groupBy("doc_id", "entity").agg(F.transform(F.array_sort(F.collect_list(F.struct("fact_no", *_FACT))), lambda f: F.struct(*[f[c].alias(c) for c in _FACT])).alias("facts"))
    told = ask(held, "pattern", "valid boolean, pattern string, pattern_type string, required_fact_ids array<string>, why_multi_source string", backend, entity=F.col("entity"), facts=fact_lines(F.col("facts")))
    ok = told.filter(F.coalesce("verdict.valid", F.lit(False)) & (F.size("verdict.required_fact_ids") >= 3) & F.col("verdict.pattern").isNotNull())
    out = ok.select("doc_id", "entity", "verdict.pattern", F.coalesce("verdict.pattern_type", F.lit("unknown")).alias("pattern_type"), "verdict.required_fact_ids", F.coalesce("verdict.why_multi_source", F.lit("")).alias("why_multi_source"), "facts")
    out = out.withColumn("required_facts", F.filter("facts", lambda f: F.array_contains("required_fact_ids", f["fact_id"]))).drop("facts")
    return out.withColumn("num_required", F.size("required_fact_ids")).withColumn("modalities", F.array_sort(F.array_distinct(F.transform("required_facts", lambda f: f["modality"]))))


def syntheses(found: DataFrame, backend) -> DataFrame:
    """Synthesis questions with sq_id and their answers; a failed judge, a short question or no conclusion drops the pattern."""
    out = tell(found, "synthesis_question", backend, "question", facts=fact_lines(F.col("required_facts")), **_columns("entity", "pattern", "pattern_type"))
    out = out.filter(F.length("question") >= T.MIN_SYNTHESIS)
    out = ask(out, "synthesis_answer", "synthesis_conclusion string, key_data_cited array<string>", backend, question=F.col("question"), evidence=evidence_lines(F.col("required_facts")))
    out = out.filter(T.text_or_empty(F.col("verdict.synthesis_conclusion")) != "")
    order = Window.partitionBy("doc_id").orderBy("entity")
    out = out.withColumn("sq_id", T.numbered("syn", F.col("doc_id"), F.row_number().over(order)))
    return out.select("sq_id", "doc_id", "entity", "question", F.col("verdict.synthesis_conclusion").alias("synthesis_conclusion"), "verdict.key_data_cited", F.col("required_facts").alias("evidence_points"), "pattern_type", F.size("required_facts").alias("num_sources_required"), (F.size("modalities") > 1).alias("cross_modal"), F.col("modalities").alias("evidence_modalities"))


def validate(rows: DataFrame, layouts: DataFrame, backend, embed=retrieval.letter_counts, k: int = 20) -> DataFrame:
    """All syntheses with filter_result; failed ones stay in the table.

    Each point is left out in turn: where the conclusion still follows it is optional, where the judge failed it is required. Those with
    three required points or more are asked about the k nearest text chunks, and what these don't suffice for is scored, 5 where that failed.
    """
    points = rows.select("sq_id", "question", "synthesis_conclusion", "evidence_points", F.posexplode("evidence_points").alias("at", "point"))
    rest = F.filter("evidence_points", lambda e, i: i != F.col("at"))
    told = ask(points.withColumn("rest", rest), "necessity", "sufficient boolean", backend, question=F.col("question"), conclusion=F.col("synthesis_conclusion"), evidence=evidence_lines(F.col("rest"), data=False))
    needed = F.array_sort(F.collect_list(F.struct("at", "point", F.coalesce("verdict.sufficient", F.lit(False)).alias("optional"), F.col("verdict").isNull().alias("failed"))))
    held = told.groupBy("sq_id").agg(needed.alias("p"))
    ids = lambda c: F.transform(c, lambda x: x["point"]["fact_id"])
    required, optional = F.filter("p", lambda x: ~x["optional"]), F.filter("p", lambda x: x["optional"])
    checked = F.struct(ids(required).alias("required"), ids(optional).alias("optional"), F.size(required).alias("num_required"), F.size(F.filter("p", lambda x: x["failed"])).alias("n_llm_failed"))
    out = rows.join(held.select("sq_id", checked.alias("evidence_validation"), F.transform(required, lambda x: x["point"]).alias("_kept")), "sq_id", "left")
    out = out.withColumn("evidence_points", F.coalesce("_kept", "evidence_points")).withColumn("num_sources_required", F.size("evidence_points")).drop("_kept")
    modalities = F.array_sort(F.array_distinct(F.transform("evidence_points", lambda e: e["modality"])))
    out = materialize(out.withColumn("_enough", F.col("num_sources_required") >= 3).withColumn("evidence_modalities", F.when(F.col("_enough"), modalities).otherwise(F.col("evidence_modalities"))).withColumn("cross_modal", F.when(F.col("_enough"), F.size(modalities) > 1).otherwise(F.col("cross_modal"))), "necessity")
    asked = out.filter("_enough")
    chunks = materialize(retrieval.rag_chunks(layouts), "chunks")
    vector = lambda c: embed(T.clip(F.col(c), 7000)).alias("v")
    near = retrieval.cosine_topk(asked.select("doc_id", F.col("sq_id").alias("query_id"), vector("question")), chunks.select("doc_id", F.col("layout_id").alias("chunk_id"), vector("chunk")), k, on=["doc_id"])
    near = near.select(F.col("query_id").alias("sq_id"), F.col("chunk_id").alias("layout_id"), "rank").join(asked.select("sq_id", "doc_id"), "sq_id").join(chunks, ["doc_id", "layout_id"])
    context = near.groupBy("sq_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk"))).alias("c"))
    asked = asked.select("sq_id", "question", "synthesis_conclusion", "evidence_points").join(context, "sq_id")
    rag = ask(asked, "text_rag", "sufficient boolean, missing string", backend, k=F.size("c"), question=F.col("question"), conclusion=F.col("synthesis_conclusion"), chunks=F.array_join(F.transform("c", lambda x: x["chunk"]), "\n\n---\n\n"))
    rag = rag.select("sq_id", F.struct(F.coalesce("verdict.sufficient", F.lit(False)).alias("sufficient"), F.when(F.col("verdict").isNull(), "llm_failed").otherwise(F.coalesce("verdict.missing", F.lit(""))).alias("missing"), F.size("c").alias("retrieved_n")).alias("text_rag_check"))
    none = F.struct(F.lit(False).alias("sufficient"), F.lit("no_text_chunks").alias("missing"), F.lit(None).cast("int").alias("retrieved_n"))
    out = out.join(rag, "sq_id", "left").withColumn("text_rag_check", F.when(F.col("_enough"), F.coalesce("text_rag_check", none)))
    result = F.when(~F.col("_enough"), verdicts.TOO_FEW).when(F.col("text_rag_check.sufficient"), verdicts.BY_TEXT_RAG).otherwise(verdicts.PASS)
    out = materialize(out.withColumn("filter_result", result).drop("_enough"), "validated")
    scored = ask(out.filter(F.col("filter_result") == verdicts.PASS).select("sq_id", "question", "synthesis_conclusion", "evidence_points"), "synthesis_score", ", ".join(f"{d} double" for d in SYNTHESIS), backend, question=F.col("question"), conclusion=F.col("synthesis_conclusion"), evidence=evidence_lines(F.col("evidence_points"), data=False))
    low = F.when(F.col("verdict").isNull(), 5.0).otherwise(T.least_score(*[F.col(f"verdict.{d}") for d in SYNTHESIS]))
    return out.join(scored.select("sq_id", F.col("verdict").alias("quality_scores"), low.alias("quality_score")), "sq_id", "left")


def reasons(scored: DataFrame, metrics: list[str], backend) -> DataFrame:
    """Scored answers with the judge's words on why; where it failed, a note that says so."""
    marks = F.concat_ws(", ", *[F.concat(F.lit(f"{m}: "), F.coalesce(F.col(m).cast("string"), F.lit("none"))) for m in metrics])
    told = tell(scored, "reason", backend, "reason", question=F.col("query"), truth=T.clip(F.col("gt_answer"), 2500), response=T.clip(F.col("response"), 2500), scores=marks)
    return told.withColumn("reason", F.coalesce(T.truthy(F.col("reason")), F.lit("no reason: the judge failed")))


def coverage(paired: DataFrame, backend) -> DataFrame:
    """Paired answers with step_coverage. paired: question_id, question_type, query, response, steps; a failed judge: null."""
    open_ = (T.text_or_empty(F.col("response")) != "") & (F.col("question_type") != "single_hop") & (F.size("steps") > 0)
    steps = F.array_join(F.transform("steps", lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s)), "\n")
    told = ask(paired.filter(F.coalesce(open_, F.lit(False))), "step_coverage", "covered array<boolean>", backend, question=F.col("query"), response=T.clip(F.col("response"), 24_000), steps=steps)
    out = told.withColumn("covered", F.col("verdict.covered")).drop("verdict").unionByName(paired.filter(~F.coalesce(open_, F.lit(False))), allowMissingColumns=True)
    return out.withColumn("step_coverage", evaluation.step_coverage(F.col("response"), F.col("question_type"), F.col("steps"), F.col("covered"))).drop("covered")
