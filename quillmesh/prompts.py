"""Prompts of the judges (S10), in our own words, and their rendering as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_JSON = "Reply with JSON only: "
TEMPLATES = {
    "caption": "These layouts are on page {page_id}: {layouts}. Give each figure or table a caption and a topic. " + _JSON + '[{"layout_id": 0, "caption": "...", "topic": "..."}]',
    "entity": "Name the entities in this {modality} of page {page_id}, each with its type: person, org, group, place, date, number or metric.\n\n{content}\n\n" + _JSON + '[{"name": "...", "type": "..."}]',
    "entity_match": "Do these two names mean the same entity?\n1. {a}\n2. {b}\n" + _JSON + '{"match": true}',
    "single_hop_question": "Write one question about {entity} that this {modality} on page {page_id} (layout {layout_id}) answers. {role_instruction}\n\n{content}\n\nReply with the question only.",
    "single_hop_answer": "Answer from this {modality} on page {page_id} (layout {layout_id}) only, in as few words as can be.\n\n{content}\n\nQuestion: {question}\n" + _JSON + '{"answer": "...", "answer_type": "entity, number, percentage, date or phrase"}',
    "single_hop_score": "Score from 0 to 10 how clear, specific and rightly answered this question is.\n\nFrom a {modality}: {content}\nQuestion: {question}\nAnswer: {answer}\n" + _JSON + '{"score": 0}',
    "multihop_compose": "Join two questions that share {entity} into one which hints at {entity} without naming it.\n1 ({modality1}, page {page_id1}): {question1} -> {answer1}\n2 ({modality2}, page {page_id2}): {question2} -> {answer2}\n" + _JSON + '{"composed_question": "...", "final_answer": "...", "indirect_description": "..."}',
    "multihop_score": "Score from 0 to 10 how well this question needs both of its hops ({hop_path}).\nQuestion: {question}\nAnswer: {answer}\nThe hidden entity: {entity}\n1 ({modality1}): {question1} -> {answer1}\n2 ({modality2}): {question2} -> {answer2}\n" + _JSON + '{"score": 0}',
    "single_source": "With this {modality} alone, can the question be answered?\n\n{content}\n\nQuestion: {question}\n" + _JSON + '{"answerable": true, "answer": "..."}',
    "text_only": "With this text alone, can the question be answered?\n\n{content}\n\nQuestion: {question}\n" + _JSON + '{"answerable": true, "answer": "..."}',
    "visual_only": "With these pictures of pages {pages} alone, can the question be answered?\nQuestion: {question}\n" + _JSON + '{"answerable": true, "answer": "..."}',
    "final_review": "Score from 0 to 10 each: is the question natural, is the answer right and unambiguous, are all hops needed?\nQuestion: {question}\nAnswer: {answer}\nPath: {hop_path}\n" + _JSON + '{"naturalness": 0, "answer_quality": 0, "multi_hop_necessity": 0}',
    "fact": "State the one most important fact about {entity} in this {modality} on page {page_id}, with the data it rests on.\n\n{content}\n\n" + _JSON + '{"fact": "...", "data_points": ["..."]}',
    "pattern": "Which pattern about {entity} shows only when at least three of these facts are taken together?\n{facts}\n" + _JSON + '{"valid": true, "pattern": "...", "pattern_type": "trend, contradiction, causal, comparison or panorama", "required_fact_ids": ["..."], "why_multi_source": "..."}',
    "synthesis_question": "Write a question whose answer is this {pattern_type} about {entity}: {pattern}\nIt has to need all of:\n{facts}\nReply with the question only.",
    "synthesis_answer": "Answer from this evidence.\nQuestion: {question}\n{evidence}\n" + _JSON + '{"synthesis_conclusion": "...", "key_data_cited": ["..."]}',
    "necessity": "Does the conclusion still follow from what is left?\nQuestion: {question}\nConclusion: {conclusion}\nLeft:\n{evidence}\n" + _JSON + '{"sufficient": false}',
    "text_rag": "These are the {k} text chunks nearest to the question. Does the conclusion follow from them alone?\nQuestion: {question}\nConclusion: {conclusion}\n\n{chunks}\n\n" + _JSON + '{"sufficient": false, "missing": "..."}',
    "synthesis_score": "Score from 0 to 10 each.\nQuestion: {question}\nConclusion: {conclusion}\n{evidence}\n" + _JSON + '{"question_clarity": 0, "conclusion_quality": 0, "multi_source_necessity": 0}',
    "step_coverage": "Which of these steps does the response cover?\nQuestion: {question}\nResponse: {response}\n{steps}\n" + _JSON + '{"covered": [true, false]}',
    "reason": "In one or two sentences, why did the response get these scores?\nQuestion: {question}\nTruth: {truth}\nResponse: {response}\nScores: {scores}",
}
#: What a question is asked for, by its role and whether its layout is a picture.
ROLES = {
    ("bridge", False): "Its answer should identify {entity}.", ("bridge", True): "Its answer should identify {entity}.",
    ("target", False): "It should ask for a detail that only this text gives.", ("target", True): "It should ask for a detail that only the picture shows.",
}


def fields(template: str) -> list[str]:
    """The fields that a template asks for, in order."""
    return re.findall(r"\{([a-z_]+[0-9]?)\}", template)


def render(template: str, **values: Column) -> Column:
    """The template with its fields filled in; a null value is empty."""
    parts = re.split(r"\{([a-z_]+[0-9]?)\}", template)
    return F.concat(*[F.coalesce(values[p].cast("string"), F.lit("")) if i % 2 else F.lit(p) for i, p in enumerate(parts)])


def fact_lines(facts: Column) -> Column:
    """P25: a line for each fact, with its id and where it is from. facts: array of structs of fact_id, modality, page_id, fact."""
    return F.array_join(F.transform(facts, lambda f: F.concat(F.lit("["), f["fact_id"], F.lit("] ("), f["modality"], F.lit(", page "), f["page_id"].cast("string"), F.lit("): "), f["fact"])), "\n")


def evidence_lines(facts: Column, data: bool = True) -> Column:
    """P25: a line for each piece of evidence, with its data."""
    none = F.array().cast("array<string>")
    cited = lambda f: F.concat(F.lit("  [data: "), F.array_join(F.coalesce(f["data_points"], none), ", "), F.lit("]")) if data else F.lit("")
    return F.array_join(F.transform(facts, lambda f: F.concat(F.lit("- ("), f["modality"], F.lit(", page "), f["page_id"].cast("string"), F.lit("): "), f["fact"], cited(f))), "\n")
