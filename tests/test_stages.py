"""Stages with judges from files to files: replies by rule, failures of every judge, the command line."""

import json
from dataclasses import dataclass, field

import pytest
from pyspark.sql import functions as F

from quillmesh import __main__ as cli
from quillmesh import prompts, stages
from quillmesh.operators import evaluation, verdicts
from quillmesh.operators.judge import FAIL_CLOSED, FAIL_OPEN, HttpJudge, ReplayJudge, passes
from quillmesh.sources import files

PAD = " and so the paragraph goes on until it is long enough to count"
LAYOUTS = [
    (1, "a.pdf", 0, 0, "text", f"Alpha Works was founded in 1990 by Dana Reed{PAD}", None, None, None, None, None),
    (1, "a.pdf", 1, 1, "figure", None, f"Alpha Works revenue 55 percent{PAD}", None, None, None, None),
    (1, "a.pdf", 2, 1, "table", None, f"Alpha Works staff of 700 people{PAD}", None, None, None, None),
    (1, "a.pdf", 3, 2, "text", f"Alpha Works moved to Lyon in 2004{PAD}", None, None, None, None, None),
    (1, "a.pdf", 4, 3, "text", f"Alpha Works has 12 plants across Asia{PAD}", None, None, None, None, None),
    (1, "a.pdf", 5, 3, "text", "too short", None, None, None, None, None),
]
SCHEMA = "doc_id int, doc_name string, layout_id int, page_id int, modality string, text string, ocr_text string, vlm_text string, caption string, topic string, image_path string"


@dataclass
class Rules:
    """Replies by the words of a prompt; names in `fails` get none."""

    fails: tuple = ()
    asked: list = field(default_factory=list)

    def replies(self, df, prompt, image=None):
        said = {
            "Give each figure": '[{"layout_id": 1, "caption": "old"}, {"layout_id": 1, "caption": "Revenue", "topic": "money"}]',
            "Name the entities": '```json\n[{"name": "Alpha Works", "type": "org"}, {"name": "alpha works", "type": ""}, {"name": " ", "type": "org"}]\n```',
            "mean the same entity": '{"match": true}',
            "Write one question about": '<think>hm</think>"What does it say of the company?"',
            "in as few words": '{"answer": "the PAGE answer", "answer_type": "phrase"}',
            "rightly answered": '{"score": 9}',
            "Join two questions": '{"composed_question": "What of the firm founded by Reed?", "final_answer": "55 percent", "indirect_description": "the firm"}',
            "needs both of its hops": '{"score": 8.5}',
            "With this": '{"answerable": false, "answer": null}',
            "With these pictures": '{"answerable": true, "answer": "nothing like it"}',
            "is the question natural": '{"naturalness": 8, "answer_quality": 9, "multi_hop_necessity": 7}',
            "one most important fact": None,
            "Which pattern": '{"valid": true, "pattern": "growth", "pattern_type": "trend", "required_fact_ids": ["f1", "f2", "f3", "f9"]}',
            "Write a question whose answer": '"How did the firm grow over the years?"',
            "Answer from this evidence": '{"synthesis_conclusion": "It grew.", "key_data_cited": ["55"]}',
            "still follow from what is left": '{"sufficient": false}',
            "text chunks nearest": '{"sufficient": false, "missing": "figures"}',
            "Score from 0 to 10 each.\nQuestion": '{"question_clarity": 8, "conclusion_quality": 6}',
            "Which of these steps": '{"covered": [true, false]}',
        }
        said["one most important fact"] = "FACT"
        reply = F.lit(None).cast("string")
        for begin, words in said.items():
            value = F.concat(F.lit('{"fact": "'), F.regexp_extract(prompt, "(Alpha Works [a-z]+)", 1), F.lit('", "data_points": ["'), F.regexp_extract(prompt, "\n\n[^\n]*?([0-9]+) ?[a-z ]*", 1), F.lit('"]}')) if words == "FACT" else F.lit(words)
            if begin not in self.fails:
                reply = F.when(F.contains(F.col(prompt), F.lit(begin)), value).otherwise(reply)
        return df.withColumn("reply", reply)


@pytest.fixture(scope="module")
def layouts(spark):
    return spark.createDataFrame(LAYOUTS, SCHEMA)


@pytest.fixture(scope="module")
def entities(spark, layouts):
    return stages.materialize(stages.shared(stages.mentions(layouts, Rules()), Rules()), "entities")


def test_prompts_ask_for_known_fields(spark):
    for name, template in prompts.TEMPLATES.items():
        assert prompts.fields(template), name
    df = spark.createDataFrame([("x", None)], "a string, b string")
    assert df.select(prompts.render('{a}-{b}: {"k": 1}', a=F.col("a"), b=F.col("b"))).first()[0] == 'x-: {"k": 1}'
    facts = spark.createDataFrame([([("f1", "text", 2, "It is.", ["5", "6"]), ("f2", "table", 3, "So.", None)],)], "f array<struct<fact_id string, modality string, page_id int, fact string, data_points array<string>>>")
    assert facts.select(prompts.fact_lines(F.col("f"))).first()[0] == "[f1] (text, page 2): It is.\n[f2] (table, page 3): So."
    assert facts.select(prompts.evidence_lines(F.col("f"))).first()[0] == "- (text, page 2): It is.  [data: 5, 6]\n- (table, page 3): So.  [data: ]"


def test_captions(spark, layouts):
    got = {r["layout_id"]: (r["caption"], r["topic"]) for r in stages.captions(layouts, Rules()).collect()}
    assert got[1] == ("Revenue", "money") and got[2] == (None, "") and got[0] == (None, None)
    failed = {r["layout_id"]: (r["caption"], r["topic"]) for r in stages.captions(layouts, Rules(fails=("Give each figure",))).collect()}
    assert failed[1] == (None, "")


def test_mentions_and_linking(spark, layouts, entities):
    found = stages.mentions(layouts, Rules()).collect()
    assert sorted((r["layout_id"], r["name"], r["type"]) for r in found) == [(k, "Alpha Works", "org") for k in range(5)]
    assert stages.mentions(layouts, Rules(fails=("Name the entities",))).count() == 0
    (one,) = entities.collect()
    assert one["canonical_name"] == "alpha works" and one["num_layouts"] == 5 and one["position"] == 1
    two = spark.createDataFrame([(1, k, k, "text", 0, n, "org") for k, n in ((0, "Reed Group"), (1, "Reed Group"), (2, "The Reed Group plc"))], "doc_id int, layout_id int, page_id int, modality string, ord int, name string, type string")
    assert [(r["canonical_name"], r["num_layouts"]) for r in stages.shared(two, Rules()).collect()] == [("reed group", 3)]
    assert [(r["canonical_name"], r["num_layouts"]) for r in stages.shared(two, Rules(fails=("mean the same entity",))).collect()] == [("reed group", 2)]


def test_multi_hop(spark, layouts, entities):
    questions = stages.materialize(stages.atomic(entities, layouts, Rules()), "questions")
    assert questions.count() == 10 and {r["question"] for r in questions.collect()} == {"What does it say of the company?"}
    assert {r["quality_score"] for r in questions.collect()} == {9.0}
    for failing in ("Write one question about", "in as few words", "rightly answered"):
        assert stages.atomic(entities, layouts, Rules(fails=(failing,))).count() == 0
    chains = stages.materialize(stages.chains(questions, Rules()), "chains")
    rows = chains.collect()
    assert len(rows) == 10 and rows[0]["bridge_entities"] == ["alpha works"] and rows[0]["final_answer"] == "55 percent" and [h["hop"] for h in rows[0]["reasoning_trace"]] == [1, 2]
    for failing in ("Join two questions", "needs both of its hops"):
        assert stages.chains(questions, Rules(fails=(failing,))).count() == 0
    kept, rejected = stages.shortcut(chains, layouts, Rules())
    assert (kept.count(), rejected.count()) == (1, 0)  # all share entity and answer
    kept, rejected = stages.shortcut(chains, layouts, Rules(fails=("With this",)))
    assert kept.count() == 1
    for rules in (Rules(), Rules(fails=("With this", "With these pictures"))):
        kept, rejected = stages.modality(chains, layouts, rules)
        assert (kept.count(), rejected.count()) == (10, 0)
        assert {r["modality_filter"] for r in kept.collect()} == {verdicts.PASS, verdicts.ONE_MODALITY}
    kept, rejected = stages.review(chains, Rules())
    assert (kept.count(), rejected.count()) == (10, 0)
    kept, _ = stages.review(chains, Rules(fails=("is the question natural",)))
    assert {r["min_score"] for r in kept.collect()} == {5.0}


def test_synthesis(spark, layouts, entities):
    known = stages.materialize(stages.facts(entities, layouts, Rules()), "known")
    assert known.count() == 5 and {r["fact_id"] for r in known.collect()} == {f"f{k}" for k in range(1, 6)}
    assert stages.facts(entities, layouts, Rules(fails=("one most important fact",))).count() == 0
    found = stages.materialize(stages.patterns(known, Rules()), "found")
    (one,) = found.collect()
    assert one["num_required"] == 4 and [f["fact_id"] for f in one["required_facts"]] == ["f1", "f2", "f3"]
    assert stages.patterns(known, Rules(fails=("Which pattern",))).count() == 0
    made = stages.materialize(stages.syntheses(found, Rules()), "made")
    (one,) = made.collect()
    assert one["sq_id"] == "doc1_syn_0001" and one["cross_modal"] and one["num_sources_required"] == 3
    for failing in ("Write a question whose answer", "Answer from this evidence"):
        assert stages.syntheses(found, Rules(fails=(failing,))).count() == 0
    (one,) = stages.validate(made, layouts, Rules()).collect()
    assert one["filter_result"] == verdicts.PASS and one["quality_score"] == 0 and one["text_rag_check"]["retrieved_n"] == 4 and one["evidence_validation"]["n_llm_failed"] == 0
    (one,) = stages.validate(made, layouts, Rules(fails=("still follow from what is left", "text chunks nearest", "Score from 0 to 10 each.\nQuestion"))).collect()
    assert one["filter_result"] == verdicts.PASS and one["quality_score"] == 5 and one["evidence_validation"]["n_llm_failed"] == 3 and one["text_rag_check"]["missing"] == "llm_failed"
    few = made.withColumn("evidence_points", F.slice("evidence_points", 1, 2))
    (one,) = stages.validate(few, layouts, Rules()).collect()
    assert one["filter_result"] == verdicts.TOO_FEW and one["quality_score"] is None
    (one,) = stages.validate(made, layouts.filter("modality != 'text'"), Rules()).collect()
    assert one["text_rag_check"]["missing"] == "no_text_chunks"


def test_coverage(spark):
    rows = [("a", "bridge_chain", "q", "r", ["s1", "s2"]), ("b", "single_hop", "q", "r", ["s"]), ("c", "synthesis", "q", "", ["s"]), ("d", "synthesis", "q", "r", None)]
    df = spark.createDataFrame(rows, "question_id string, question_type string, query string, response string, steps array<string>")
    assert {r["question_id"]: r["step_coverage"] for r in stages.coverage(df, Rules()).collect()} == {"a": 0.5, "b": None, "c": 0.0, "d": None}
    assert {r["question_id"]: r["step_coverage"] for r in stages.coverage(df, Rules(fails=("Which of these steps",))).collect()} == {"a": None, "b": None, "c": 0.0, "d": None}


def test_policies(spark):
    df = spark.createDataFrame([(True,), (False,), (None,)], "f boolean")
    assert [r[0] for r in df.select(passes(F.col("f"), FAIL_OPEN)).collect()] == [True, False, True]
    assert [r[0] for r in df.select(passes(F.col("f"), FAIL_CLOSED)).collect()] == [True, False, False]


def test_command_line(spark, tmp_path, monkeypatch):
    doc = lambda k: {"doc_id": k, "doc_name": "a.pdf", "layouts": [dict(zip(SCHEMA.replace(" int", "").replace(" string", "").split(", "), row, strict=True)) for row in LAYOUTS]}
    (tmp_path / "corpus.json").write_text(json.dumps([doc(1), doc(2)]))
    monkeypatch.setattr(cli, "backend", lambda *a: Rules())
    at = lambda stage, *more: cli.run(spark, [stage, "--corpus", str(tmp_path / "corpus.json"), "--work", str(tmp_path / "w"), *more])
    for stage in ("captions", "entities", "link", "atomic", "compose", "shortcut", "modality", "review", "candidates", "facts", "patterns", "synthesis", "validate"):
        out = at(stage, "--doc-id", "1", "--json")
        assert out.count() and {r["doc_id"] for r in out.select("doc_id").collect()} == {1}, stage
    told = json.loads((tmp_path / "w/json/doc1_facts.json").read_text())
    assert len(told) == 5 and {"entity", "fact", "data_points", "fact_id"} <= set(told[0])
    assert files.stage(spark, str(tmp_path / "w/json"), "entity string, fact_id string", "doc*_facts.json").filter("file_doc_id = 1").count() == 5
    assert {r["question_type"] for r in at("assemble").collect()} == {"bridge_chain", "synthesis", "single_hop"}
    # evaluation: scored once, then only what is new
    (tmp_path / "answers/sys/mix").mkdir(parents=True)
    (tmp_path / "answers/sys/zeta").mkdir()
    for folder in ("mix", "zeta"):
        (tmp_path / f"answers/sys/{folder}/doc_1.json").write_text(json.dumps({"results": [{"question_id": "m", "query": "q", "response": "r", "retrieved_context": "reed and more"}]}))
    (tmp_path / "b.json").write_text(json.dumps([{"doc_id": 1, "mh_id": "m", "question_type": "bridge_chain", "final_answer": "x", "bridge_entities": ["Reed"], "reasoning_trace": [{"hop": 1, "sub_question": "a", "result": "b"}, {"hop": 2, "sub_question": "c", "result": "d"}]}]))
    more = ["--benchmark", str(tmp_path / "b.json"), "--answers", str(tmp_path / "answers"), "--systems", "sys"]
    for _ in range(2):
        (row,) = at("evaluate", *more).collect()
        assert row["step_coverage"] == 0.5 and row["gt_answer"] == "x" and row["assigned_type"] == "bridge_2hop" and row["entity_recall"] == 0.5
    # a metric that an earlier run left out is filled in, and reasons come with it
    (row,) = at("evaluate", *more, "--force", "--skip-step-coverage").collect()
    assert row["step_coverage"] is None
    (row,) = at("evaluate", *more, "--fill-missing").collect()
    assert row["step_coverage"] == 0.5 and row["entity_recall"] == 0.5
    (row,) = at("evaluate", *more, "--force", "--reasons").collect()
    assert row["reason"] == "no reason: the judge failed"
    summary = spark.read.json(str(tmp_path / "w/evaluate/summary"))
    assert any(line.split()[0] == "overall" for line in files.report(summary.withColumn("key", F.coalesce("key", F.lit("")))))


def test_http_judge_parses_replies(spark):
    """One request for each row, against a server that answers."""
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    seen = []

    class Answer(BaseHTTPRequestHandler):
        def do_POST(self):
            seen.append(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))
            body = json.dumps({"choices": [{"message": {"content": '```json\n{"ok": true}\n```'}}]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    df = spark.createDataFrame([(1, "p1", [{"a": 1}], "aW1n"), (2, "p2", None, None)], "id int, p string, nested array<map<string,int>>, image string").coalesce(1)
    from quillmesh.operators.judge import judge

    got = judge(df, "p", "ok boolean", HttpJudge(f"http://127.0.0.1:{server.server_port}/v1/chat/completions", "m"), image="image").collect()
    server.shutdown()
    assert [(r["id"], r["verdict"]["ok"]) for r in got] == [(1, True), (2, True)] and len(seen) == 2
    assert sorted(type(x["messages"][0]["content"]).__name__ for x in seen) == ["list", "str"]


def test_benchmark_entities(spark):
    df = spark.createDataFrame([(["Reed", "reed ", ""], [("b",), (None,)], [(["5", None],), (None,)], "x"), (None, None, None, None)], "bridges array<string>, trace array<struct<result string>>, points array<struct<data_points array<string>>>, final string")
    got = [r[0] for r in df.select(evaluation.benchmark_entities(*(F.col(c) for c in df.columns))).collect()]
    assert got == [["Reed", "b", "5", "x"], []]


def test_replay_is_by_prompt(spark):
    df = spark.createDataFrame([("a",), ("b",)], "p string")
    recorded = df.filter("p = 'a'").select(F.sha2("p", 256).alias("prompt_sha"), F.lit("yes").alias("reply"))
    assert {r["p"]: r["reply"] for r in ReplayJudge(recorded).replies(df, "p").collect()} == {"a": "yes", "b": None}
