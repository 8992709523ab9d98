"""Text of layouts, names and answers, as Column to Column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# What Python calls white space, which the semantics of stripping rest on.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0                　"
# Words that say nothing about which entity a name means.
STOP_WORDS = [
    "the", "a", "an", "of", "in", "for", "and", "or", "to", "with", "at", "by", "on", "is", "are", "was", "were", "than", "that",
    "this", "its", "their", "from", "who", "which", "least", "most", "more", "less", "experience", "level",
]
# Least lengths of contents and questions.
MIN_CONTENT, MIN_CHUNK, MIN_QUESTION, MIN_COMPOSED, MIN_SYNTHESIS = 50, 30, 10, 15, 20


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once: an expression inside a lambda is computed for every element."""
    return F.get(F.transform(F.array(value), use), 0)


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE))


def layout_content(least: int | None = MIN_CONTENT, lenient: bool = False) -> Column:
    """P1 (strict), P2 (lenient: any modality but text is visual), P3 (least=None: never null).

    Reads columns modality, text, ocr_text, vlm_text, caption, topic.
    """
    labelled = [F.when(text_or_empty(F.col(c)) != "", F.concat(F.lit(label), F.col(c))) for label, c in (("Caption: ", "caption"), ("Topic: ", "topic"), ("Description: ", "vlm_text"), ("Text in image: ", "ocr_text"))]
    visual = F.concat_ws("\n", *labelled)
    out = F.when(F.col("modality") == "text", strip(text_or_empty(F.col("text"))))
    out = out.otherwise(visual) if lenient else out.when(F.col("modality").isin("figure", "table"), visual)
    return text_or_empty(out) if least is None else F.when(F.length(out) >= least, out)


def normalize(name: Column) -> Column:
    """Stripped, lower-cased, without trailing punctuation; spaces before it stay."""
    return F.regexp_replace(F.lower(strip(name)), "[.,;:!?'\"]+$", "")


def content_words(name: Column) -> Column:
    """P5: distinct ASCII words that aren't stop words."""
    return F.array_except(F.regexp_extract_all(normalize(name), F.lit("[a-z]+"), F.lit(0)), F.array(*map(F.lit, STOP_WORDS)))


def plural_variants(name: Column) -> Column:
    """The name, with an s more, and with one less where it ends in one."""
    return F.array_distinct(F.filter(F.array(name, F.concat(name, F.lit("s")), F.when(F.endswith(name, F.lit("s")), F.substring(name, F.lit(1), F.length(name) - 1))), lambda x: x.isNotNull()))


def answer_matches(predicted: Column, gold: Column) -> Column:
    """Equal, contained either way, or equal but for percent and dollar signs and commas. Null or empty never matches."""
    a, b = (F.btrim(strip(F.lower(c)), F.lit(".\"'")) for c in (predicted, gold))
    plain = lambda c: F.translate(c, "%$,", "")
    some = (text_or_empty(predicted) != "") & (text_or_empty(gold) != "")
    return some & ((a == b) | F.contains(a, b) | F.contains(b, a) | (plain(a) == plain(b)))


def surface_form(content: Column, names: Column) -> Column:
    """The first of the names that occurs in the content, whatever its case; null if none."""
    return bind(F.lower(content), lambda low: F.get(F.filter(names, lambda n: F.contains(low, F.lower(n))), 0))


def mentions_any(content: Column, names: Column) -> Column:
    """P10."""
    return bind(F.lower(content), lambda low: F.exists(names, lambda n: F.contains(low, F.lower(n))))


def leaks(question: Column, entity: Column) -> Column:
    """The question names the entity that it should only hint at."""
    return F.contains(F.lower(question), F.lower(entity))


def clip(c: Column, n: int) -> Column:
    """P12."""
    return F.substring(c, 1, n)


def clean_response(reply: Column) -> Column:
    """What follows the last thinking part, without a code fence."""
    said = strip(F.element_at(F.split(reply, "</think>", -1), -1))
    return strip(F.regexp_replace(F.regexp_replace(said, "^```(?:json)?", ""), "```$", ""))


def json_candidates(reply: Column, listed: bool = False) -> Column:
    """A fenced block, the widest object, the widest array, all of it: in this order, those that are there. listed: no object, as a list is asked for."""
    fenced, one, many = (F.regexp_extract(reply, p, k) for p, k in (("(?s)```(?:json)?\\s*(.*?)```", 1), ("(?s)\\{.*\\}", 0), ("(?s)\\[.*\\]", 0)))
    return F.filter(F.array(*[fenced, *([] if listed else [one]), many, reply]), lambda p: p != "")


def parse_reply(reply: Column, schema: str) -> Column:
    """A struct or array by a schema from a reply, null where nothing parses; the first candidate that does wins."""
    listed = schema.lower().startswith("array<")
    candidates = json_candidates(clean_response(reply), listed)
    return F.coalesce(*[F.from_json(F.get(candidates, k), schema, {"mode": "PERMISSIVE"}) for k in range(3 if listed else 4)])


def hop_path(first: Column, second: Column) -> Column:
    """P16."""
    return F.concat_ws("→", first, second)


def numbered(kind: str, doc_id: Column, n: Column) -> Column:
    """Ids like doc3_mh_0012."""
    return F.format_string(f"doc%d_{kind}_%04d", doc_id, n)


def derive_modality(modalities: Column, fallback: Column | None = None) -> Column:
    """One name for a question's evidence modalities."""
    kinds = F.array_distinct(F.transform(modalities, lambda m: F.when(m == "text_only", "text").otherwise(m)))
    one = F.get(kinds, 0)
    return (
        F.when(F.coalesce(F.size(modalities), F.lit(0)) == 0, "unknown")
        .when(F.size(kinds) > 1, "multimodal")
        .when(one == "text", "text_only")
        .otherwise(F.coalesce(one, fallback if fallback is not None else F.lit(None).cast("string")))
    )


def truthy(c: Column) -> Column:
    """Null for an empty string."""
    return F.nullif(c, F.lit(""))


def quality_threshold(modality: Column) -> Column:
    """Visual targets need less."""
    return F.when(modality.isin("figure", "table"), 7.0).otherwise(8.0)


def least_score(*scores: Column) -> Column:
    """A missing dimension counts as 0."""
    return F.least(*[F.coalesce(s, F.lit(0)) for s in scores])


def share(hits: Column, total: Column) -> Column:
    """A ratio to four places; null without a total."""
    return F.round(F.when(total > 0, hits / total), 4)


def distinct_names(names: Column) -> Column:
    """Stripped, without empty ones, the first of each lower-cased name, in order."""
    return first_of_each(F.filter(F.transform(names, strip), lambda n: n != ""), lambda n, i: n)


def first_of_each(names: Column, make: Callable[[Column, Column], Column]) -> Column:
    """make(name, position) of the first of each lower-cased name, in order."""
    firsts = lambda n, low: F.filter(F.transform(n, lambda x, i: F.struct(make(x, i).alias("it"), F.get(low, i).alias("low"), i.alias("at"))), lambda s: F.array_position(low, s["low"]) == s["at"] + 1)
    return bind(names, lambda n: bind(F.transform(n, F.lower), lambda low: F.transform(firsts(n, low), lambda s: s["it"])))
