"""The query catalogue: one query per operator group, over whole tables, with plain columns that SQL can be compared with.

The chains share their first steps; a step that a chain consumes more than once is written first (storage.materialize).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.functions import text as T
from quillmesh.operators import compose, evaluation, judge, linking, retrieval, synthesis, verdicts
from quillmesh.sources import files
from quillmesh.sources.tables import contents, layouts, read
from quillmesh.storage import materialize, shared_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f

    @wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(spark, sf_dir)

    return run


def joined(c: str) -> F.Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), "|").alias(c)


# Shared steps


def found_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linking.mentions(contents(spark, sf_dir))


def shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linking.shared_entities(found_mentions(spark, sf_dir))


def leaders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, name, n: names of two words, so that names can share one."""
    named = linking.mentions(contents(spark, sf_dir), "[A-Z][a-z]+ [a-z]+").select("doc_id", T.normalize(F.col("name")).alias("name"))
    return named.groupBy("doc_id", "name").agg(F.count("*").alias("n"))


def appearances(spark: SparkSession, sf_dir: str, extra: list[str] | None = None) -> DataFrame:
    return compose.seed_appearances(compose.atomic_seeds(shared(spark, sf_dir)), contents(spark, sf_dir), extra=extra)


def atomic(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = compose.atomic_questions(appearances(spark, sf_dir, ["text", "ocr_text"]))
    return compose.with_text_redundancy(materialize(base, "atomic"), layouts(spark, sf_dir))


def chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bridge chains, one a pair of layouts; written, as both their sides and their numbering rest on the atomic questions."""
    return materialize(compose.dedup_pairs(compose.bridge_pairs(materialize(atomic(spark, sf_dir), "redundancy"))), "chains")


def chosen_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = synthesis.facts(synthesis.candidates(shared(spark, sf_dir)), contents(spark, sf_dir))
    return synthesis.enough_facts(synthesis.dedup_facts(found))


# Functions and sources


@query
def layout_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = layouts(spark, sf_dir)
    return rows.select("doc_id", "layout_id", "page_id", "modality", T.layout_content().alias("strict"), T.layout_content(lenient=True).alias("lenient"), T.layout_content(least=None).alias("whole"))


@query
def entity_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found_mentions(spark, sf_dir).select("doc_id", "layout_id", "page_id", "modality", "ord", "name")


@query
def normalize_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = read(spark, sf_dir, "documents").select(F.explode(F.split("text", " ")).alias("name")).distinct()
    return words.select("name", T.normalize(F.col("name")).alias("norm"))


@query
def content_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = leaders(spark, sf_dir).select("name").distinct()
    return names.select("name", F.array_join(F.array_sort(T.content_words(F.col("name"))), "|").alias("words"))


def _items(spark: SparkSession, sf_dir: str) -> int:
    """How many numbers the benchmark's items take, so that every item is asked about."""
    return (read(spark, sf_dir, "benchmark").agg(F.max("item_id")).first()[0] or 0) + 1


@query
def answer_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = read(spark, sf_dir, "benchmark").select("item_id", F.element_at(F.split("text", " "), 1).alias("gold"))
    said = read(spark, sf_dir, "documents").select("doc_id", F.pmod("doc_id", F.lit(_items(spark, sf_dir))).alias("item_id"), F.col("text").alias("said"))
    return said.join(gold, "item_id").select("doc_id", "item_id", T.answer_matches(F.col("said"), F.col("gold")).alias("matches"))


@query
def leakage_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = read(spark, sf_dir, "benchmark").select("item_id", F.regexp_extract("text", "[A-Z][a-z]+", 0).alias("entity"))
    asked = read(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", "text", F.pmod("conv_id", F.lit(_items(spark, sf_dir))).alias("item_id"))
    q = F.col("text")
    out = asked.join(names, "item_id").withColumn("leak", T.leaks(q, F.col("entity"))).withColumn("score", (F.length(q) % 11).cast("double"))
    modality = F.when(F.col("turn") % 3 == 0, "figure").otherwise("text")
    keep = ~F.col("leak") & (F.length(q) >= T.MIN_COMPOSED) & (F.col("score") >= T.quality_threshold(modality))
    return out.select("conv_id", "turn", "leak", "score", keep.alias("keep"))


@query
def response_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    body = F.concat(F.lit('{"answer": "'), "role", F.lit('", "score": '), F.col("turn"), F.lit("}"))
    reply = F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("<think>one {</think>\n```json\n"), body, F.lit("\n```"))).when(F.col("conv_id") % 3 == 1, F.concat(F.lit("Here: "), body, F.lit(" done"))).otherwise(F.lit("no reply"))
    got = T.parse_reply(F.col("reply"), "answer string, score string")
    return c.withColumn("reply", reply).withColumn("got", got).select("conv_id", "turn", F.col("got.answer").alias("answer"), F.col("got.score").alias("score"))


@query
def caption_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last caption given for a layout, by page, else none and an empty topic."""
    pages = read(spark, sf_dir, "pages")
    given = pages.select("page_id", F.regexp_extract("url", "/([0-9]+)", 1).try_cast("bigint").alias("doc_id"), (F.col("page_id") % 8).cast("int").alias("layout_id"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("caption"), F.regexp_extract("url", "/([a-z]{2})/", 1).alias("topic"))
    last = given.groupBy("doc_id", "layout_id").agg(F.max_by(F.struct("caption", "topic"), "page_id").alias("last"))
    seen = layouts(spark, sf_dir).filter("modality != 'text'").drop("caption", "topic").join(last, ["doc_id", "layout_id"], "left")
    seen = seen.withColumn("caption", F.col("last.caption")).withColumn("topic", F.coalesce("last.topic", F.lit("")))
    return seen.select("doc_id", "layout_id", "caption", "topic", T.layout_content().alias("content"))


@query
def doc_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document, a range whose end 0 means all, a list."""
    ids = read(spark, sf_dir, "documents").select("doc_id", "source")
    start, end = 100, 0
    picks = [("one", F.col("doc_id") == 7), ("range", (F.col("doc_id") >= start) & (F.col("doc_id") < (end or 999_999))), ("list", F.col("doc_id").isin(3, 5, 8)), ("system", F.col("source") != "src1")]
    return ids.select("doc_id", F.explode(F.array(*[F.when(c, F.lit(n)) for n, c in picks])).alias("pick")).filter("pick is not null")


@query
def file_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stage's rows written by group of documents and read back with the document's number."""
    path = f"{shared_dir(spark)}/quillmesh/roundtrip-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars", "source")
    files.write_stage(docs, path)
    return files.read_stage(spark, path, "lang string, n_chars long, source string").select("doc_id", "lang", "n_chars", "source")


# Linking


@query
def plural_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = found_mentions(spark, sf_dir).select("doc_id", T.normalize(F.col("name")).alias("norm"))
    return linking.plural_groups(named)


@query
def shared_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shared(spark, sf_dir)
    return out.select("doc_id", "canonical_name", joined("aliases"), joined("entity_types"), "num_layouts", joined("modalities"), "cross_modal", "cross_page", "is_named_entity", "position")


@query
def alias_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linking.alias_candidates(leaders(spark, sf_dir).select("doc_id", "name"))


@query
def alias_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = materialize(leaders(spark, sf_dir), "leaders")
    pairs = linking.alias_candidates(names.select("doc_id", "name"))
    return linking.alias_components(pairs.filter(linking.same_words(F.col("a"), F.col("b"))), names)


# Multi-hop


@query
def atomic_seed_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compose.atomic_seeds(shared(spark, sf_dir)).select("doc_id", "canonical_name", "num_layouts", "cross_modal", "rank")


@query
def seed_appearances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return appearances(spark, sf_dir).select("doc_id", "canonical_name", "layout_id", "modality", "shared_entity")


@query
def text_redundancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return atomic(spark, sf_dir).select("sh_id", "doc_id", "shared_entity", "question_role", "answer", "layout_id", "text_redundant")


@query
def bridge_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = compose.bridge_pairs(materialize(atomic(spark, sf_dir), "redundancy"))
    return pairs.select("mh_id", "doc_id", "shared_entity", "sh_id1", "sh_id2", "hop_path", "cross_modal", "cross_page", "final_answer", "quality_score")


@query
def pair_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chains(spark, sf_dir).select("mh_id", "doc_id", "layout_id1", "layout_id2")


def _probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L9h: what a layout alone answers is its first name."""
    return contents(spark, sf_dir).select("doc_id", "layout_id", F.regexp_extract(F.coalesce("text", "ocr_text"), "[A-Z][a-z]+", 0).alias("predicted"))


@query
def shortcut_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts.shortcuts(chains(spark, sf_dir), _probes(spark, sf_dir)).select("mh_id", "filter_result")


@query
def bridge_answer_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts.dedup_answers(verdicts.shortcuts(chains(spark, sf_dir), _probes(spark, sf_dir))).select("mh_id", "shared_entity", "final_answer", "quality_score")


@query
def context_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = verdicts.packed_context(layouts(spark, sf_dir), cap=1500)
    return out.select("doc_id", "layout_id", "ord", F.length("chunk").alias("size"))


def _images(rows: DataFrame) -> DataFrame:
    """S5h: of four pages in turn one has no image."""
    return rows.select("doc_id", "page_id").distinct().filter(F.pmod(F.col("doc_id") + F.col("page_id"), F.lit(4)) != 3)


@query
def visual_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = layouts(spark, sf_dir)
    return verdicts.visual_pages(rows, existing=_images(rows)).select("doc_id", joined("pages"))


@query
def modality_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = materialize(layouts(spark, sf_dir), "layouts")  # read by context, pages and probes
    out = verdicts.modality_verdicts(chains(spark, sf_dir), verdicts.packed_context(rows), rows, verdicts.visual_pages(rows, existing=_images(rows)))
    return out.select("mh_id", "filter_result")


@query
def final_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "n_chars").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    docs = docs.withColumn("a", F.col("quality") * 10).withColumn("b", 10 - F.col("toxic") * 5).withColumn("c", F.when(F.col("quality").isNotNull(), F.least(F.floor(F.col("n_chars") / 100), F.lit(10)).cast("int")))
    return verdicts.final_review(docs, ["a", "b", "c"]).select("doc_id", F.col("min_score").cast("long").alias("min_score"), "keep")


@query
def verdict_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return verdicts.verdict_counts(rows.withColumn("filter_result", F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "pass").otherwise("fail")), ["lang"])


@query
def judge_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L*, X6: recorded replies by prompt; every third is missing and takes the policy's default."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("Judge "), "doc_id").alias("prompt"))
    replies = docs.filter("doc_id % 3 != 0").select(F.sha2("prompt", 256).alias("prompt_sha"), F.concat(F.lit('```json\n{"ok": '), F.when(F.col("doc_id") % 2 == 0, "true").otherwise("false"), F.lit("}\n```")).alias("reply"))
    out = judge.judge(docs, "prompt", "ok boolean", judge.ReplayJudge(replies))
    return out.select("doc_id", judge.passes(F.col("verdict.ok"), judge.FAIL_OPEN).alias("open"), judge.passes(F.col("verdict.ok"), judge.FAIL_CLOSED).alias("closed"))


# Synthesis


@query
def synthesis_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = synthesis.candidates(shared(spark, sf_dir))
    return out.select("doc_id", "canonical_name", "num_layouts", "rank", F.array_join(F.transform("appearances", lambda a: a["layout_id"].cast("string")), "|").alias("layouts"))


@query
def fact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_facts(spark, sf_dir).select("doc_id", "entity", "fact_no", "layout_id", "num_facts", joined("data_points"))


def _patterns(facts: DataFrame) -> DataFrame:
    """L14h: every other fact of an entity, and one that there isn't."""
    ids = F.array_sort(F.collect_list(F.when(F.col("fact_no") % 2 == 1, F.col("fact_no"))))
    return facts.groupBy("doc_id", "entity").agg(F.concat(ids, F.array(F.lit(99))).alias("required_ids"), F.lit(True).alias("valid"))


@query
def pattern_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = materialize(chosen_facts(spark, sf_dir), "facts")
    out = synthesis.pattern_facts(_patterns(facts), facts)
    return out.select("doc_id", "entity", F.array_join(F.transform("required", lambda f: f["fact_no"].cast("string")), "|").alias("required"), "num_required", joined("modalities"))


@query
def leave_one_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = verdicts.leave_one_out(chosen_facts(spark, sf_dir), ["doc_id", "entity"])
    return out.select("doc_id", "entity", joined("required"), joined("optional"), "num_required", "n_llm_failed", joined("modalities"), "filter_result")


@query
def text_rag_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question is its entity and all data points of its facts; the offline embedding counts letters."""
    asked = chosen_facts(spark, sf_dir).groupBy("doc_id", "entity").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("data_points")))).alias("points"))
    asked = materialize(asked.withColumn("question", F.concat_ws(" ", "entity", "points")), "asked")
    chunks = materialize(retrieval.rag_chunks(layouts(spark, sf_dir)), "chunks")
    return synthesis.text_rag_verdicts(asked, chunks, retrieval.letter_counts).select("doc_id", "entity", "retrieved_n", "sufficient", "filter_result")


@query
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    asked = rows.filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    return retrieval.cosine_topk(asked, rows.withColumnRenamed("vec_id", "chunk_id"), skip_own=True).select("query_id", "rank", "chunk_id")


# Evaluation


def _truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S7 over user turns: keys in three columns, some empty; of a repeated key the last stays."""
    asked = read(spark, sf_dir, "conversations").filter("role = 'user'")
    key = F.concat_ws("_", "conv_id", F.floor(F.col("turn") / 4))
    rows = asked.withColumn("mh_id", F.when(F.col("turn") % 4 == 0, key).otherwise("")).withColumn("sq_id", F.when(F.col("turn") % 4 == 2, key)).withColumn("question_id", F.coalesce(T.truthy(F.col("mh_id")), T.truthy(F.col("sq_id")))).filter("question_id is not null")
    last = rows.groupBy(F.col("conv_id").alias("doc_id"), "question_id").agg(F.max_by(F.struct("turn", "text"), "turn").alias("t"))
    turn = F.col("t.turn")
    return last.select(
        "doc_id", "question_id", F.when(turn % 4 == 0, F.col("t.text")).alias("t_final_answer"), F.when(turn % 4 == 2, F.element_at(F.split("t.text", " "), -1)).alias("t_conclusion"), F.when(turn % 4 == 0, "bridge_chain").otherwise("synthesis").alias("t_question_type"),
        F.when(turn % 6 == 0, F.array(F.lit("text_only"))).when(turn % 6 == 2, F.array(F.lit("figure"), F.lit("text"))).otherwise(F.array().cast("array<string>")).alias("t_modalities"),
        F.when(turn % 4 == 0, F.lit(3)).alias("t_num_hops"), F.when(turn % 4 == 0, F.lit("text→figure")).alias("t_hop_path"),
    )


@query
def pair_answers_gt(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = read(spark, sf_dir, "conversations").filter("role = 'assistant'")
    none = F.lit(None).cast("string")
    rows = said.select(F.col("conv_id").alias("doc_id"), F.concat_ws("_", "conv_id", F.floor(F.col("turn") / 4)).alias("question_id"), "turn", none.alias("gt_answer"), F.when(F.col("turn") % 5 == 1, "single_hop").alias("question_type"), F.lit("").alias("modality_type"), F.lit(None).cast("int").alias("num_hops"), none.alias("assigned_type"), none.alias("hop_path"))
    out = evaluation.pair_with_truth(rows, _truth(spark, sf_dir))
    return out.select("doc_id", "turn", "question_id", "gt_answer", "question_type", "modality_type", "num_hops", "assigned_type", "hop_path")


def _sentences(c: F.Column) -> F.Column:
    return F.filter(F.split(c, "\\. ", -1), lambda s: s != "")


@query
def enriched_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").filter("role = 'user'").withColumn("s", _sentences(F.col("text")))
    kind = F.when(F.col("conv_id") % 3 == 0, "bridge_chain").when(F.col("conv_id") % 3 == 1, "synthesis").otherwise("single_hop")
    trace = F.transform("s", lambda x, i: F.struct((i + 1).alias("hop"), x.alias("sub_question"), F.element_at(F.split(x, " "), -1).alias("result")))
    out = evaluation.enriched_reference(F.col("text"), kind, trace, F.transform("s", lambda x: F.element_at(F.split(x, " "), 1)), F.col("s"))
    return rows.select("conv_id", "turn", out.alias("reference"))


@query
def entity_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An item's names are bridge entities, its words in brackets hops' results, its numbers data points, its first word the answer."""
    found = lambda p, n: F.regexp_extract_all("text", F.lit(p), F.lit(n))
    trace = F.transform(found("[(]([^)]+)[)]", 1), lambda r: F.struct(r.alias("result")))
    points = F.transform(found("[0-9]+", 0), lambda r: F.struct(F.array(r, F.upper(r)).alias("data_points")))
    names = evaluation.benchmark_entities(found("[A-Z][a-z]+", 0), trace, points, F.element_at(F.split("text", " "), 1))
    gold = read(spark, sf_dir, "benchmark").select("item_id", names.alias("names"))
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", F.pmod("doc_id", F.lit(_items(spark, sf_dir))).alias("item_id"))
    hits, total, recall = evaluation.entity_recall(F.col("text"), F.col("names"))
    return docs.join(gold, "item_id").select("doc_id", "item_id", hits.alias("hits"), total.alias("total"), recall.alias("recall"))


@query
def step_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations")
    asked = turns.filter("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), _sentences(F.col("text")).alias("steps"))
    said = turns.filter("role = 'assistant'").select("conv_id", "turn", F.when(F.col("turn") % 7 == 1, "").otherwise(F.col("text")).alias("response"))
    both = said.join(asked, ["conv_id", "turn"]).withColumn("covered", F.transform("steps", lambda s: F.contains(F.lower("response"), F.lower(F.element_at(F.split(s, " "), 1)))))
    kind = F.when(F.col("conv_id") % 5 == 0, "single_hop").otherwise("bridge_chain")
    return both.select("conv_id", "turn", F.size("steps").alias("steps"), evaluation.step_coverage(F.col("response"), kind, F.col("steps"), F.col("covered")).alias("coverage"))


@query
def metric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 5).alias("bucket"), F.col("value").cast("decimal(18,2)").alias("value"))
    rows = rows.withColumn("value", F.when(F.col("bucket") != 3, F.col("value")))
    return evaluation.summary(rows, ["value"], ["event_type", "bucket"])


def _metrics(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    labels = read(spark, sf_dir, "labels").select("doc_id", F.when(F.col("doc_id") % 4 != 0, F.col("quality")).alias("quality"), "toxic")
    fresh = read(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") % 2).cast("int").alias("quality"))
    return labels, fresh


@query
def fill_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cached, fresh = _metrics(spark, sf_dir)
    return evaluation.fill_missing(cached, fresh, ["doc_id"], ["quality"])


@query
def missing_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    cached, _ = _metrics(spark, sf_dir)
    return evaluation.missing_metrics(cached.withColumn("bucket", F.col("doc_id") % 10), ["bucket"], ["quality", "toxic"])


@query
def incremental_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.not_yet_done(read(spark, sf_dir, "documents").select("doc_id", "lang"), read(spark, sf_dir, "labels"), ["doc_id"])


@query
def benchmark_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, turns = read(spark, sf_dir, "documents"), read(spark, sf_dir, "conversations")
    bridge = docs.filter("doc_id % 2 = 0").select("doc_id", F.format_string("doc%d_mh_%04d", "doc_id", "doc_id").alias("mh_id"), F.col("text").alias("final_answer"), F.when(F.col("n_chars") > 500, "pass").otherwise("fail").alias("filter_result"))
    synth = docs.filter("doc_id % 2 = 1").select("doc_id", F.format_string("doc%d_syn_%04d", "doc_id", "doc_id").alias("sq_id"), F.col("text").alias("conclusion"), F.when(F.col("n_chars") > 900, "pass").otherwise("fail").alias("filter_result"))
    single = turns.filter("role = 'user'").select(F.col("conv_id").alias("doc_id"), F.format_string("doc%d_sh_%04d", "conv_id", "turn").alias("sh_id"), F.col("text").alias("final_answer"))
    out = evaluation.assemble(bridge, synth, single)
    return out.select("doc_id", "question_id", "question_type", F.coalesce(T.truthy(F.col("final_answer")), F.col("conclusion"), F.lit("")).alias("answer"))

