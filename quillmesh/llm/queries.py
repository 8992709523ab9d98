"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm import langid, linededup, lm, minhash, packing, sentencepiece, simhash, tokencount, topk, urls

#: The capacity and separator of packed sequences.
CAPACITY, SEPARATOR = 2048, 0
#: What splits text before the merges of the byte-level ranks; a fixed value of that vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def word_spec() -> str:
    with open(tokenizer_file("word_bpe_49k.json"), encoding="utf-8") as f:
        return f.read()


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), word_spec(), CAPACITY, SEPARATOR)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_groups(documents(spark, sf_dir), words=4, radius=4)
    return out.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = langid.identify(docs.select("doc_id", "text"), langid.fit(docs))
    return out.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), F.col("_qm_lang").alias("lang_pred"), F.col("_qm_score").alias("score"), F.col("_qm_rejected").alias("rejected"))


#: The rules that come before the method: verdict, host, path.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def page_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """host and bad of every page: a page's path ends with the doc_id of the document it shows, which labels may cover.

    Pages that show none have no outcome and don't meet the labels: they would all meet in one task.
    """
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("doc_id is not null")
    bad = labels.groupBy("doc_id").agg(F.max(((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")).alias("bad"))
    shown = F.regexp_extract(urls.path_of(F.col("url")), "/([0-9]{1,18})(?:[./]|$)", 1)
    shows = pages.select(urls.host_of(F.col("url")).alias("host"), shown.try_cast("bigint").alias("doc_id"))
    seen = shows.filter("doc_id is not null").join(bad, "doc_id", "left").select("host", (F.col("bad") == 1).alias("bad"))
    return seen.unionByName(shows.filter("doc_id is null").select("host", F.lit(None).cast("boolean").alias("bad")))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Besides the contract's columns: how many outcomes the host has, and its posterior mean and bound of bad pages."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    out = urls.judge(pages, page_outcomes(spark, sf_dir), RULES)
    return out.select("page_id", *(F.col(f"_qm_{c}").alias(c) for c in ("host", "path", "rule", "verdict")), F.col("_qm_n").alias("host_n"), F.round("_qm_mean", 6).alias("host_mean"), F.round("_qm_bound", 6).alias("host_bound"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return lm.score(docs, lm.train(docs))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(tokenizer_file("piece_bpe_32k.model"), "rb") as f:
        model = f.read()
    return sentencepiece.encode(documents(spark, sf_dir), model, decoded=True)


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.edited_pairs(documents(spark, sf_dir))


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=5, every=50, scale=256)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(tokenizer_file("byte_bpe_50k.tiktoken"), encoding="ascii") as f:
        return tokencount.section_counts(documents(spark, sf_dir), f.read(), PATTERN, rule="majority")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(documents(spark, sf_dir).select("doc_id", "text"), min_docs=3, min_chars=20)
    return out.select("doc_id", F.col("_qm_n_lines").alias("n_lines"), F.col("_qm_dropped").alias("n_dropped"), F.sha2("_qm_kept", 256).alias("kept_sha256"))


_STRIP = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LEVEL = """
        select sum(bad) / sum(n) as share, count(*) as groups, sum(n) as n, sum(bad) as bad, sum(n::double * n) as squares,
               sum(bad::double * bad / n) as spread from {0} where n > 0"""
_STRENGTH = """
        select share, case when spread - bad::double * bad / n - share * (1 - share) * (groups - 1) <= 0 or share * (1 - share) <= 0
                             or n - squares / n - (groups - 1) <= 0 or n is null then 50.0
                      else least(greatest(share * (1 - share) * (n - squares / n - (groups - 1))
                           / (spread - bad::double * bad / n - share * (1 - share) * (groups - 1)) - 1, 2.0), 50.0) end as m from {0}"""
ORACLES = {
    "op5_url_filters": f"""
        with rests as (
            select page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) end as rest from pages),
        parsed as (
            select page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
                   coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path from rests),
        outcomes as (select doc_id, max((quality = 0 or toxic = 1)::int) as bad from labels group by doc_id),
        seen as (
            select p.host, o.bad from parsed p
            left join outcomes o on o.doc_id = try_cast(regexp_extract(p.path, '/([0-9]{{1,18}})(?:[./]|$)', 1) as bigint)),
        sums as (
            select host, regexp_replace(host, '^.*@|:[0-9]*$|[.]$', '', 'g') as name, count(bad) as n, coalesce(sum(bad), 0)::bigint as bad from seen group by host),
        labels_of as (
            select *, string_split(name, '.') as parts, regexp_matches(name, '^[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+$') as numbers from sums),
        two as (
            select *, len(parts) >= 2 and list_contains({urls.TWO_LABEL_SUFFIXES}, array_to_string(parts[-2:], '.')) as two from labels_of),
        hosts as (
            select host, n, bad, case when numbers then name when two then array_to_string(parts[-3:], '.') else array_to_string(parts[-2:], '.') end as domain,
                   case when numbers then '' when two then array_to_string(parts[-2:], '.') else parts[-1] end as suffix from two),
        domains as (select domain, suffix, sum(n)::bigint as n, sum(bad)::bigint as bad from hosts group by all),
        suffixes as (select suffix, sum(n)::bigint as n, sum(bad)::bigint as bad from domains group by all),
        level_s as ({_LEVEL.format("suffixes")}), level_d as ({_LEVEL.format("domains")}), level_h as ({_LEVEL.format("hosts")}),
        prior_s as ({_STRENGTH.format("level_s")}), prior_d as ({_STRENGTH.format("level_d")}), prior_h as ({_STRENGTH.format("level_h")}),
        mean_s as (select suffix, (bad + coalesce((select share from prior_s), 0) * (select m from prior_s)) / (n + (select m from prior_s)) as mean from suffixes),
        mean_d as (select domain, (bad + s.mean * (select m from prior_d)) / (n + (select m from prior_d)) as mean from domains join mean_s s using (suffix)),
        mean_h as (select host, n, (bad + d.mean * (select m from prior_h)) / (n + (select m from prior_h)) as mean from hosts join mean_d d using (domain)),
        judged as (select *, mean - 0.674 * sqrt(mean * (1 - mean) / (n + (select m from prior_h) + 1)) as bound from mean_h),
        ruled as (
            select *, case when (host = 'example.net' or ends_with(host, '.example.net')) and starts_with(path, '/en/') then 'example.net/en/'
                           when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/de/') then 'example.com/de/'
                           when (host = 'org' or ends_with(host, '.org')) and starts_with(path, '/fr/') then 'org/fr/'
                           when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/') then 'net/' end as rule from parsed)
        select page_id, host, path, rule,
               case when rule in ('net/', 'example.com/de/') then 'block' when rule is not null then 'allow'
                    when j.bound > coalesce((select share from prior_s), 0) then 'block' else 'allow' end as verdict,
               j.n as host_n, round(j.mean, 6) as host_mean, round(j.bound, 6) as host_bound
        from ruled left join judged j using (host)""",
    "op8_top_k": """
        with ok as (
            select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
            where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        scored as (
            select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: coalesce(p[1], 0) * coalesce(p[2], 0)))::bigint as score
            from ok q join ok c on q.vec_id % 50 = 0 and q.vec_id != c.vec_id),
        ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from scored)
        select query_id, rank, vec_id, score from ranked where rank <= 5""",
    "op10_line_dedup": f"""
        with lines as (
            select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
                   generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos
            from documents),
        keyed as (
            select doc_id, pos, line, translate(trim(line, {_STRIP}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
            from lines),
        often as (
            select key, max(doc_id) as stays from keyed where length(key) >= 20
            group by key having count(distinct doc_id) >= 3),
        marked as (
            select k.*, o.key is not null and k.doc_id != o.stays as gone from keyed k left join often o on k.key = o.key)
        select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
               sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
        from marked group by doc_id""",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_packing, op2_simhash, op3_lm_scoring, op4_language_id, op5_url_filters, op6_sentencepiece, op7_fingerprints, op8_top_k, op9_token_counts, op10_line_dedup)}
