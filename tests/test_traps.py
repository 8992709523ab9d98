"""One fixture for each semantic trap: functions and operators on hand-written rows."""

import base64
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from quillmesh.functions import text as T
from quillmesh.operators import compose, evaluation, judge, linking, retrieval, synthesis, verdicts
from quillmesh.operators.graph import components
from quillmesh.sources import files

LAYOUT = "doc_id long, layout_id int, page_id int, modality string, text string, ocr_text string, vlm_text string, caption string, topic string"


def one(spark, column, **values):
    kinds = {k: v for k, v in values.items()}
    df = spark.createDataFrame([tuple(v[0] for v in kinds.values())], ", ".join(f"{k} {v[1]}" for k, v in kinds.items()))
    return df.select(column.alias("x")).first()[0]


def groups(spark, names):
    df = spark.createDataFrame([(1, n) for n, k in names.items() for _ in range(k)], "doc_id long, norm string")
    return {r["norm"]: r["canonical"] for r in linking.plural_groups(df).collect()}


def test_plural_islands(spark):
    assert groups(spark, {"gas": 1, "gass": 1, "gasss": 1}) == {"gas": "gas", "gass": "gas", "gasss": "gas"}
    assert groups(spark, {"word": 1, "words": 5}) == {"word": "words", "words": "words"}
    assert groups(spark, {"a": 1, "ass": 1}) == {"a": "a", "ass": "ass"}


def test_normalize(spark):
    for raw, want in (("Workers'", "workers"), ("foo .", "foo "), ("\t Foo\n", "foo"), ("Rate,;:", "rate")):
        assert one(spark, T.normalize(F.col("n")), n=(raw, "string")) == want


def test_plural_variants(spark):
    assert one(spark, T.plural_variants(F.col("n")), n=("cats", "string")) == ["cats", "catss", "cat"]


def test_answer_matches(spark):
    for a, b, want in (("1", "2015", True), ("$1,500", "1500", True), (".", "x", True), ("", "x", False), (None, "x", False), ("Yes.", "yes", True), ("a", "b", False)):
        assert one(spark, T.answer_matches(F.col("a"), F.col("b")), a=(a, "string"), b=(b, "string")) is want


def test_layout_content(spark):
    rows = [
        (1, 0, 0, "text", "x" * 49, None, None, None, None), (1, 1, 0, "text", f" {'x' * 50} ", None, None, None, None),
        (1, 2, 0, "figure", None, None, None, "short", ""), (1, 3, 0, "chart", None, "y" * 50, None, None, None), (1, 4, 0, "table", None, "y" * 40, "", None, None),
    ]
    got = {r[0]: r[1:] for r in spark.createDataFrame(rows, LAYOUT).select("layout_id", T.layout_content(), T.layout_content(lenient=True), T.layout_content(least=None)).collect()}
    assert got[0][0] is None and got[1][0] == "x" * 50 and got[2][0] is None and got[3][0] is None
    assert got[3][1] == "Text in image: " + "y" * 50 and got[2][2] == "Caption: short" and got[4][0] == "Text in image: " + "y" * 40


def test_surface_form(spark):
    names = F.array(F.lit("canonical"), F.lit("Alias"))
    assert one(spark, T.surface_form(F.col("c"), names), c=("only the ALIAS here", "string")) == "Alias"
    assert one(spark, T.surface_form(F.col("c"), names), c=("neither", "string")) is None
    assert one(spark, T.mentions_any(F.col("c"), names), c=("a canonical one", "string"))


def atomic_rows(spark, rows):
    return spark.createDataFrame([(1, "e", f"doc1_sh_{k:04d}", l, l // 2, m, f"answer{k}", r, red) for k, (l, m, r, red) in enumerate(rows)], "doc_id long, shared_entity string, sh_id string, layout_id int, page_id int, modality string, answer string, question_role string, text_redundant boolean")


def test_pair_rules(spark):
    df = atomic_rows(spark, [(0, "text", "bridge", False), (0, "text", "target", False), (1, "figure", "target", True), (2, "figure", "bridge", False)])
    pairs = {(r["layout_id1"], r["layout_id2"]): r["hop_path"] for r in compose.bridge_pairs(df).collect()}
    # same layout drops; a redundant target drops across modalities only
    assert pairs == {(2, 0): "figure→text", (2, 1): "figure→figure"}


def test_pair_dedup(spark):
    df = atomic_rows(spark, [(0, "text", "bridge", False), (1, "text", "target", False), (1, "text", "bridge", False), (0, "text", "target", False)])
    assert compose.bridge_pairs(df).count() == 2
    assert [r["mh_id"] for r in compose.dedup_pairs(compose.bridge_pairs(df)).collect()] == ["doc1_mh_0001"]


def test_numbered(spark):
    assert one(spark, T.numbered("sh", F.col("d"), F.col("n")), d=(3, "long"), n=(12345, "long")) == "doc3_sh_12345"


def test_shortcuts(spark):
    chains = spark.createDataFrame([("a", 1, 0, 1, "gold"), ("b", 1, 2, 0, "gold"), ("c", 1, 2, 3, "gold"), ("d", 1, 2, 9, "gold"), ("e", 1, 4, 2, "gold")], "mh_id string, doc_id long, layout_id1 int, layout_id2 int, final_answer string")
    probes = spark.createDataFrame([(1, 0, "gold"), (1, 1, "no"), (1, 2, "none"), (1, 3, None), (1, 4, None)], "doc_id long, layout_id int, predicted string")
    got = {r["mh_id"]: r["filter_result"] for r in verdicts.shortcuts(chains, probes).collect()}
    assert got == {"a": "fail_hop1_sufficient", "b": "fail_hop2_sufficient", "c": "pass", "d": "skip_missing_layout", "e": "pass"}


def test_packing_stops_at_the_first_overflow(spark):
    rows = [(1, k, 0, "text", "x" * n, None, None, None, None) for k, n in enumerate((40, 100, 30))]
    got = [r["layout_id"] for r in verdicts.packed_context(spark.createDataFrame(rows, LAYOUT), cap=120).collect()]
    assert got == [0]


def test_final_review(spark):
    df = spark.createDataFrame([(1, 8, 6, 9), (2, 8, None, 9), (3, None, None, None), (4, 7, 7, 7)], "i int, a int, b int, c int")
    assert {r["i"]: r["keep"] for r in verdicts.final_review(df, ["a", "b", "c"]).collect()} == {1: False, 2: False, 3: True, 4: True}


def test_fact_dedup(spark):
    df = spark.createDataFrame([(1, "e", 0, ["A", "b"]), (1, "e", 1, ["B", "a", "a"]), (1, "e", 2, []), (1, "e", 3, None)], "doc_id long, entity string, layout_id int, data_points array<string>")
    assert sorted((r["layout_id"], r["fact_no"]) for r in synthesis.dedup_facts(df).collect()) == [(0, 1), (2, 2), (3, 3)]
    assert synthesis.enough_facts(synthesis.dedup_facts(df), 4).count() == 0


def test_pattern_facts(spark):
    known = spark.createDataFrame([(1, "e", 1, 0, "text"), (1, "e", 2, 1, "figure")], "doc_id long, entity string, fact_no int, layout_id int, modality string")
    patterns = spark.createDataFrame([(1, "e", True, [1, 1, 1]), (1, "e", True, [1, 2, 9]), (1, "e", True, [1, 2])], "doc_id long, entity string, valid boolean, required_ids array<int>")
    assert sorted(r["num_required"] for r in synthesis.pattern_facts(patterns, known).collect()) == [3, 3]  # as asked for, with repeats and unknown ids
    assert sorted(len(r["required"]) for r in synthesis.pattern_facts(patterns, known).collect()) == [1, 2]


def test_leave_one_out(spark):
    rows = [(1, 1, ["a"]), (1, 2, ["b"]), (1, 3, ["c"]), (2, 1, ["a"]), (2, 2, ["a", "b"]), (2, 3, ["c"]), (2, 4, ["c"]), (3, 1, None), (3, 2, ["a"]), (3, 3, ["b"])]
    points = spark.createDataFrame(rows, "k int, fact_no int, data_points array<string>").withColumn("modality", F.when(F.col("fact_no") == 2, "table").otherwise("text"))
    got = {r["k"]: (r["required"], r["num_required"], r["n_llm_failed"], r["modalities"], r["filter_result"]) for r in verdicts.leave_one_out(points, ["k"]).collect()}
    assert got[1] == ([1, 2, 3], 3, 0, ["table", "text"], "pass") and got[2] == ([2], 1, 0, ["table"], "fail_insufficient_required_evidence")
    assert got[3] == ([1, 2, 3], 3, 1, ["table", "text"], "pass")  # what the judge failed on counts as required


def test_answer_dedup(spark):
    """Of what passed one for each entity as written and answer in its bare form; the best, then the first."""
    rows = [("a", "Alpha", "Yes", 8.0, "pass"), ("b", "Alpha", " yes\t", 9.0, "pass"), ("c", "alpha", "yes", 7.0, "pass"), ("d", "Alpha", "no", 9.0, "fail_hop1_sufficient"), ("e", "Alpha", "YES\u00a0", 9.0, "pass")]
    df = spark.createDataFrame([(1, *r) for r in rows], "doc_id long, mh_id string, shared_entity string, final_answer string, quality_score double, filter_result string")
    assert sorted(r["mh_id"] for r in verdicts.dedup_answers(df).collect()) == ["b", "c"]


def test_visual_pages_need_their_images(spark):
    rows = spark.createDataFrame([(1, p, "figure") for p in range(9)] + [(1, 20, "text"), (2, 0, "table")], "doc_id long, page_id int, modality string")
    there = spark.createDataFrame([(1, p) for p in (1, 3, 4, 5, 6, 7, 20)], "doc_id long, page_id int")
    assert {r["doc_id"]: r["pages"] for r in verdicts.visual_pages(rows, existing=there).collect()} == {1: [1, 3, 4, 5, 6]}
    assert {r["doc_id"]: r["pages"] for r in verdicts.visual_pages(rows).collect()} == {1: [0, 1, 2, 3, 4], 2: [0]}


def test_text_rag(spark):
    """Evidence in whichever of the nearest chunks; pictures' text is no chunk; a document without chunks suffices for nothing."""
    rows = [(1, k, "text", f"chunk {k} about alpha {'x' * k}", None) for k in range(30)] + [(1, 90, "figure", None, "needle")]
    layouts = spark.createDataFrame(rows, "doc_id long, layout_id int, modality string, text string, ocr_text string")
    asked = spark.createDataFrame([(1, "alpha", "chunk about alpha", ["chunk 3 "]), (1, "beta", "chunk about alpha", ["needle"]), (2, "gamma", "q", [])], "doc_id long, entity string, question string, points array<string>")
    got = {r["entity"]: (r["retrieved_n"], r["filter_result"]) for r in synthesis.text_rag_verdicts(asked, retrieval.rag_chunks(layouts), retrieval.letter_counts).collect()}
    assert got == {"alpha": (20, "fail_text_rag_sufficient"), "beta": (20, "pass"), "gamma": (0, "pass")}


def test_truth_fallbacks(spark):
    kinds = "doc_id int, question_id string, response string, gt_answer string, question_type string, modality_type string, num_hops int, assigned_type string, hop_path string"
    said = spark.createDataFrame([(1, k, "r", None, None, None, None, None, "row") for k in "abcde"], kinds)
    truth = spark.createDataFrame([(1, "a", "final", "other", "plain", "bridge_chain", None, 4, None, "gt"), (1, "b", None, "conclusion", "plain", "synthesis", None, 5, "own", None), (1, "c", None, "", "plain", None, 3, None, None, None), (1, "d", "", "conclusion", None, None, None, None, None, None)], "doc_id int, question_id string, t_final_answer string, t_conclusion string, t_answer string, t_question_type string, t_num_hops int, t_num_sources int, t_assigned_type string, t_hop_path string")
    got = {r["question_id"]: (r["gt_answer"], r["assigned_type"], r["num_hops"], r["hop_path"]) for r in evaluation.pair_with_truth(said, truth).collect()}
    assert got == {"a": ("final", "bridge_4hop", 4, "gt"), "b": ("conclusion", "own", 5, "row"), "c": ("plain", "unknown", 3, "row"), "d": ("", "unknown", 2, "row"), "e": ("", "unknown", 2, "row")}


def test_cosine(spark):
    q = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, v array<double>")
    c = spark.createDataFrame([(5, [2.0, 0.0]), (3, [1.0, 0.0]), (4, [0.0, 0.0])], "chunk_id long, v array<double>")
    got = [(r["rank"], r["chunk_id"]) for r in retrieval.cosine_topk(q, c, 3).orderBy("rank").collect()]
    assert sorted(x for _, x in got[:2]) == [3, 5] and got[2] == (3, 4)
    on = retrieval.cosine_topk(q.withColumn("doc_id", F.lit(1)), c.withColumn("doc_id", F.lit(1)), 1, on=["doc_id"])
    assert on.count() == 1


def test_cosine_in_blocks(spark, monkeypatch):
    """Every block size gives the plain result, ties by chunk; a query isn't its own chunk; null vectors take no part."""
    rng = random.Random(3)
    rows = [(k, [rng.choice([0.0, 0.5, 1.0, -2.0]) for _ in range(5)]) for k in range(120)] + [(200, None)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    unit = lambda v: (lambda n: [x / (n + 1e-9) for x in v])(math.sqrt(sum(x * x for x in v)))
    known = {k: unit(v) for k, v in rows if v}
    want = {(q, n + 1, c) for q in known if q % 10 == 0 for n, (_, c) in enumerate(sorted((-sum(a * b for a, b in zip(known[q], known[c], strict=True)), c) for c in known if c != q)[:7])}
    for blocks in ((2048, 16384), (5, 9)):
        monkeypatch.setattr(retrieval, "QUERY_BLOCK", blocks[0])
        monkeypatch.setattr(retrieval, "CHUNK_BLOCK", blocks[1])
        got = retrieval.cosine_topk(df.filter("id % 10 = 0").withColumnRenamed("id", "query_id"), df.withColumnRenamed("id", "chunk_id"), 7, skip_own=True).collect()
        assert {(r["query_id"], r["rank"], r["chunk_id"]) for r in got} == want
        two = lambda c: df.withColumn("doc_id", F.pmod("id", F.lit(2))).withColumnRenamed("id", c)
        got = retrieval.cosine_topk(two("query_id").filter("query_id % 10 < 2"), two("chunk_id"), 3, on=["doc_id"], skip_own=True).collect()
        assert len(got) == 24 * 3 and all(r["query_id"] % 2 == r["chunk_id"] % 2 for r in got)


def test_modality(spark):
    for given, want in (([], "unknown"), (["text_only"], "text_only"), (["figure", "figure"], "figure"), (["text", "table"], "multimodal"), ([None], "own"), (None, "unknown")):
        assert one(spark, T.derive_modality(F.col("m"), F.lit("own")), m=(given, "array<string>")) == want


def test_recall_and_coverage(spark):
    names = F.array(F.lit("Ab"), F.lit("aB "), F.lit(""), F.lit("cd"))
    assert one(spark, evaluation.entity_recall(F.col("c"), names)[2], c=("has ab", "string")) == 0.5
    assert one(spark, evaluation.entity_recall(F.col("c"), names)[2], c=("", "string")) == 0.0
    assert one(spark, evaluation.entity_recall(F.col("c"), F.array().cast("array<string>"))[2], c=("x", "string")) is None
    cover = lambda kind: evaluation.step_coverage(F.col("r"), F.lit(kind), F.array(F.lit("a"), F.lit("b")), F.col("c"))
    assert one(spark, cover("single_hop"), r=("", "string"), c=([True, False], "array<boolean>")) == 0.0
    assert one(spark, cover("single_hop"), r=("x", "string"), c=([True, False], "array<boolean>")) is None
    assert one(spark, cover("bridge_chain"), r=("x", "string"), c=([True, False], "array<boolean>")) == 0.5
    assert one(spark, cover("bridge_chain"), r=("x", "string"), c=(None, "array<boolean>")) is None


def test_summary(spark):
    df = spark.createDataFrame([("a", 1.0, None), ("a", None, None), ("b", float("nan"), None)], "g string, x double, y double")
    got = {(r["dim"], r["key"]): (r["mean"], r["std"], r["n"]) for r in evaluation.summary(df, ["x", "y"], ["g"]).collect()}
    assert got == {("overall", ""): (1.0, 0.0, 1), ("g", "a"): (1.0, 0.0, 1)}


def test_enriched_reference(spark):
    trace = "array<struct<hop:int,sub_question:string,result:string>>"
    build = lambda kind: evaluation.enriched_reference(F.lit("A"), F.lit(kind), F.col("t"), F.array(F.lit("b")), F.array(F.lit("f"), F.lit(" ")))
    given = ([(1, "q", "r"), (2, "q", "")], trace)
    assert one(spark, build("bridge_chain"), t=given) == "Final answer: A\n\nReasoning chain:\n  Hop 1: q -> r\n\nBridge entities: b"
    assert one(spark, build("synthesis"), t=given) == "Final answer: A\n\nRequired evidence points:\n  1. f"
    assert one(spark, build("single_hop"), t=given) == "Final answer: A"


def test_replies(spark):
    for reply, want in (('<think>{"a": 1}</think>{"a": "x"}', "x"), ('```json\n{"a": 1.5}\n```', "1.5"), ('so: {"a": "y"} ok', "y"), ("none", None), (None, None)):
        got = one(spark, T.parse_reply(F.col("r"), "a string"), r=(reply, "string"))
        assert (got and got["a"]) == want


def test_judges(spark):
    df = spark.createDataFrame([(1, "p"), (2, "q")], "i int, prompt string")
    calm = judge.HeuristicJudge(F.struct((F.col("i") == 1).alias("ok")))
    assert {r["i"]: r["verdict"]["ok"] for r in judge.judge(df, "prompt", "ok boolean", calm).collect()} == {1: True, 2: False}
    dead = judge.HttpJudge("http://127.0.0.1:9/none", "m", tries=1, timeout=1, wait=0)
    out = judge.judge(df, "prompt", "ok boolean", dead)
    assert [(judge_row["a"], judge_row["b"]) for judge_row in out.select(judge.passes(F.col("verdict.ok"), judge.FAIL_OPEN).alias("a"), judge.passes(F.col("verdict.ok"), judge.FAIL_CLOSED).alias("b")).collect()] == [(True, False)] * 2
    branch = judge.judged_branch(df, F.col("i") == 1, lambda d: d.withColumn("said", F.lit("x")))
    assert {r["i"]: r["said"] for r in branch.collect()} == {1: "x", 2: None}


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 9), (5, 5), *((k, k + 1) for k in range(20, 60))]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8} | {k: 20 for k in range(20, 61)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_files(spark, tmp_path):
    doc = {"doc_id": 1, "doc_name": "a.pdf", "layouts": [{"layout_id": 0, "page_id": 2, "modality": "text", "text": "t"}, {"layout_id": 1, "page_id": 3, "modality": "figure", "image_path": "/x/own.jpg"}]}
    (tmp_path / "corpus.json").write_text(json.dumps([doc]))
    (tmp_path / "img").mkdir()
    (tmp_path / "img/own.jpg").write_bytes(b"own")
    (tmp_path / "img/a_2.jpg").write_bytes(b"page")
    rows = files.layouts_of(files.corpus(spark, str(tmp_path / "corpus.json")))
    got = {r["layout_id"]: r["image"] for r in files.with_images(rows, files.images(spark, str(tmp_path / "img"))).collect()}
    assert got == {0: base64.b64encode(b"page").decode(), 1: base64.b64encode(b"own").decode()}
    (tmp_path / "s").mkdir()
    (tmp_path / "s/doc_7.json").write_text(json.dumps({"results": [{"question_id": "q", "response": "r"}]}))
    (tmp_path / "s/cost_doc_7.json").write_text("{}")
    (tmp_path / "s/sub").mkdir()
    (tmp_path / "s/sub/doc_8.json").write_text(json.dumps({"results": [{"question_id": "not read"}]}))  # the folder itself holds answers
    (tmp_path / "t/alpha").mkdir(parents=True)
    (tmp_path / "t/beta").mkdir()
    (tmp_path / "t/gamma").mkdir()
    (tmp_path / "t/alpha/cost_doc_1.json").write_text("{}")
    for folder in ("beta", "gamma"):  # the first by name that holds one
        (tmp_path / f"t/{folder}/doc_3.json").write_text(json.dumps({"results": [{"question_id": folder}]}))
    assert [r["question_id"] for r in files.answers(spark, str(tmp_path / "t"), "sys").collect()] == ["beta"]
    assert files.answers(spark, str(tmp_path / "nowhere"), "sys").count() == 0
    assert [(r["system"], r["doc_id"], r["question_id"]) for r in files.answers(spark, str(tmp_path / "s"), "sys").collect()] == [("sys", 7, "q")]
    (tmp_path / "b.json").write_text(json.dumps([{"doc_id": 1, "mh_id": "", "sq_id": "k", "question": "old"}, {"doc_id": 1, "sq_id": "k", "question": "new"}, {"doc_id": 1, "question": "no key"}]))
    assert [(r["question_id"], r["question"]) for r in files.benchmark(spark, str(tmp_path / "b.json")).collect()] == [("k", "new")]
    (tmp_path / "ids.txt").write_text("3\n\n 4 \n")
    assert sorted(r[0] for r in files.doc_ids(spark, str(tmp_path / "ids.txt")).collect()) == [3, 4]
    files.write_stage(spark.createDataFrame([(1, "a"), (2, "b")], "doc_id int, x string"), str(tmp_path / "stage"))
    files.write_stage(spark.createDataFrame([(2, "c")], "doc_id int, x string"), str(tmp_path / "stage"))
    assert sorted((r["doc_id"], r["x"]) for r in files.read_stage(spark, str(tmp_path / "stage"), "x string", "int").collect()) == [(1, "a"), (2, "c")]
    files.write_stage(spark.createDataFrame([(5000, "far")], "doc_id int, x string"), str(tmp_path / "stage"))
    assert files.read_stage(spark, str(tmp_path / "stage"), "x string", "int").count() == 3
    assert files.write_documents(spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (7, 1, None)], "doc_id int, n int, x string"), str(tmp_path / "json"), "doc{}_t.json", ["n"]) == 2
    assert json.loads((tmp_path / "json/doc1_t.json").read_text()) == [{"n": 1, "x": "a"}, {"n": 2, "x": "b"}] and json.loads((tmp_path / "json/doc7_t.json").read_text()) == [{"n": 1, "x": None}]
    files.write_corpus(spark.createDataFrame([(1, "a.pdf")], "doc_id int, doc_name string"), str(tmp_path / "c"))
    files.write_corpus(spark.read.json(str(tmp_path / "c")).withColumn("doc_name", F.lit("b.pdf")), str(tmp_path / "c"))
    assert [r["doc_name"] for r in spark.read.json(str(tmp_path / "c")).collect()] == ["b.pdf"] and len(list(tmp_path.glob("c*"))) == 2
    there = files.existing_pages(rows, files.images(spark, str(tmp_path / "img")))
    assert [tuple(r) for r in there.collect()] == [(1, 2)]
    five = spark.range(10).select(F.col("id").alias("doc_id"))
    assert [files.selected(five, **k).count() for k in ({"one": 3}, {"start": 2, "end": 5}, {"start": 4}, {"some": [1, 99]}, {})] == [1, 3, 6, 1, 10]
    kept, rest = files.split_by_verdict(spark.createDataFrame([("pass",), ("fail",), (None,)], "filter_result string"))
    assert (kept.count(), rest.count()) == (1, 2)
    (tmp_path / "res/alpha").mkdir(parents=True)
    (tmp_path / "res/alpha/doc_1.json").write_text("x" * 2000)
    assert [tuple(r) for r in files.large_results(spark, str(tmp_path / "res")).collect()] == [("alpha", 1)]


def test_fill_and_skip(spark):
    cached = spark.createDataFrame([(1, None, 2.0), (2, 5.0, None)], "q int, a double, b double")
    fresh = spark.createDataFrame([(1, 9.0), (2, 9.0)], "q int, a double")
    assert {r["q"]: r["a"] for r in evaluation.fill_missing(cached, fresh, ["q"], ["a"]).collect()} == {1: 9.0, 2: 5.0}
    assert [r["q"] for r in evaluation.not_yet_done(fresh, cached.filter("q = 1"), ["q"]).collect()] == [2]


@pytest.mark.parametrize("replay", [False, True])
def test_stream(spark, tmp_path, replay):
    from quillmesh.streaming import answer_stream, summarise_stream

    kinds = "system string, question_id string, x double"
    spark.createDataFrame([("s", "a", 1.0), ("s", "a", 1.0), ("s", "b", 3.0)], kinds).coalesce(1).write.parquet(str(tmp_path / "in"))
    for k in range(1 + replay):
        summarise_stream(answer_stream(spark, str(tmp_path / "in"), kinds), ["x"], ["system"], str(tmp_path / "done"), str(tmp_path / "out"), str(tmp_path / f"cp{k}")).awaitTermination(120)
    got = {r["dim"]: (r["mean"], r["n"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"overall": (2.0, 2), "system": (2.0, 2)}
