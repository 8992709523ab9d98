"""DuckDB SQL for the query catalogue, out of common table expressions named after the steps."""

from __future__ import annotations

from quillmesh.functions.text import STOP_WORDS, WHITE

_W = WHITE.replace("'", "''")
_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)
_PUNCT = "'[.,;:!?''\"]+$'"


def _norm(c: str) -> str:
    return f"regexp_replace(lower(trim({c}, '{_W}')), {_PUNCT}, '')"


def _words(c: str) -> str:
    return f"list_sort(list_distinct(list_filter(regexp_extract_all({_norm(c)}, '[a-z]+'), lambda w: w not in ({_STOPS}))))"


def _match(a: str, b: str) -> str:
    x, y = (f"trim(trim(lower({c}), '{_W}'), '.\"''')" for c in (a, b))
    plain = lambda c: f"replace(replace(replace({c}, '%', ''), '$', ''), ',', '')"
    return f"(coalesce({a}, '') != '' and coalesce({b}, '') != '' and ({x} = {y} or contains({x}, {y}) or contains({y}, {x}) or {plain(x)} = {plain(y)}))"


def _unit(text: str) -> str:
    """The offline embedding of a text, divided by its norm."""
    counts = f"list_transform(range(97, 123), lambda c: (length(lower(substr({text}, 1, 7000))) - length(replace(lower(substr({text}, 1, 7000)), chr(c::int), '')))::double)"
    return f"list_transform({counts}, lambda x: x / (sqrt(list_sum(list_transform({counts}, lambda y: y * y))) + 1e-9))"


def _packed(cap: int) -> str:
    return f"""
        select doc_id, layout_id, ord, chunk from (
            select *, max((coalesce(before, 0) + length(chunk) > {cap})::int) over (partition by doc_id order by kind, layout_id) as over_, row_number() over (partition by doc_id order by kind, layout_id)::int as ord from (
                select *, sum(length(chunk) + 2) over (partition by doc_id order by kind, layout_id rows between unbounded preceding and 1 preceding) as before from (
                    select doc_id, layout_id, (modality != 'text')::int as kind, case when modality = 'text' then line else '[' || modality || ' OCR text] ' || line end as chunk
                    from lay where length(line) >= 30))) where over_ = 0"""


#: name: (what it rests on, its query)
STEPS: dict[str, tuple[list[str], str]] = {
    "lay": ([], """
        select doc_id, layout_id, (layout_id // 4)::int as page_id, line,
               case (doc_id + layout_id) % 5 when 3 then 'figure' when 4 then 'table' else 'text' end as modality
        from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
                     (generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1)::int as layout_id from documents)"""),
    "con": (["lay"], f"""
        select * from (select *, case when modality = 'text' then trim(line, '{_W}') when line != '' then 'Text in image: ' || line else '' end as content from lay)
        where length(content) >= 50"""),
    "men": (["con"], """
        select doc_id, layout_id, page_id, modality, ord, name from (
            select *, row_number() over (partition by doc_id, layout_id, lower(name) order by ord) as n from (
                select doc_id, layout_id, page_id, modality, unnest(regexp_extract_all(line, '[A-Z][a-z]+')) as name,
                       (generate_subscripts(regexp_extract_all(line, '[A-Z][a-z]+'), 1) - 1)::int as ord from con)) where n = 1"""),
    "nam": (["men"], f"select *, {_norm('name')} as norm from men"),
    "plu": (["nam"], """
        select doc_id, norm, n, case when low = 0 then case when one > zero then base || 's' else base end else base || repeat('s', low) end as canonical from (
            select *, min(k) over w as low, sum(case when k = 0 then n else 0 end) over w as zero, sum(case when k = 1 then n else 0 end) over w as one from (
                select *, k - row_number() over (partition by doc_id, base order by k) as island from (
                    select *, length(norm) - length(base) as k from (
                        select doc_id, norm, count(*) as n, regexp_replace(norm, 's+$', '') as base from nam group by doc_id, norm)))
            window w as (partition by doc_id, base, island))"""),
    "sha": (["nam", "plu"], """
        select doc_id, canonical as canonical_name, list_sort(list_distinct(list(name))) as aliases, count(distinct layout_id)::int as num_layouts,
               list_sort(list_distinct(list(modality))) as modalities, count(distinct modality) > 1 as cross_modal, count(distinct page_id) > 1 as cross_page,
               row_number() over (partition by doc_id order by count(distinct modality) > 1 desc, count(distinct layout_id) desc, min(layout_id::bigint * 10000000 + ord), canonical)::int as position
        from nam join plu using (doc_id, norm) group by doc_id, canonical having count(distinct layout_id) >= 2"""),
    "app0": (["nam", "plu"], "select distinct doc_id, canonical as canonical_name, layout_id, page_id, modality from nam join plu using (doc_id, norm)"),
    "lea": (["con"], f"""
        select doc_id, {_norm('name')} as name, count(*) as n from (
            select doc_id, layout_id, name, row_number() over (partition by doc_id, layout_id, lower(name) order by ord) as k from (
                select doc_id, layout_id, unnest(regexp_extract_all(line, '[A-Z][a-z]+ [a-z]+')) as name,
                       generate_subscripts(regexp_extract_all(line, '[A-Z][a-z]+ [a-z]+'), 1) as ord from con)) where k = 1 group by all"""),
    "cand": (["lea"], f"""
        select distinct x.doc_id, x.name as a, y.name as b from (select doc_id, name, unnest({_words('name')}) as word from lea) x
        join (select doc_id, name, unnest({_words('name')}) as word from lea) y on x.doc_id = y.doc_id and x.word = y.word and x.name < y.name
        where length(x.name) / length(y.name) > 0.3 and length(x.name) / length(y.name) < 3.0"""),
    "seed": (["sha"], """
        select * from (select *, row_number() over (partition by doc_id order by cross_modal desc, num_layouts, canonical_name)::int as rank from sha where num_layouts >= 3) where rank <= 30"""),
    "app": (["seed", "app0", "con"], """
        select * from (
            select doc_id, canonical_name, layout_id, page_id, modality,
                   list_filter(list_concat([canonical_name], aliases), lambda x: contains(lower(content), lower(x)))[1] as shared_entity from (
                select a.*, s.aliases, row_number() over (partition by a.doc_id, a.canonical_name, a.modality = 'text' order by a.layout_id) as k
                from seed s join app0 a using (doc_id, canonical_name)) join con using (doc_id, layout_id, page_id, modality) where k <= 6)
        where shared_entity is not null"""),
    "ato0": (["app", "men"], """
        select *, format('doc{}_sh_{:04d}', doc_id, row_number() over (partition by doc_id order by canonical_name, layout_id, question_role)) as sh_id from (
            select a.*, l.answer, unnest(['bridge', 'target']) as question_role from app a join (
                select a.doc_id, a.canonical_name, a.layout_id, arg_max(m.name, m.ord) as answer
                from app a join men m using (doc_id, layout_id) where lower(m.name) != lower(a.shared_entity) group by all) l using (doc_id, canonical_name, layout_id))"""),
    "ato": (["ato0", "lay"], """
        select *, question_role = 'target' and modality != 'text' and exists (
            select 1 from lay l where l.doc_id = o.doc_id and l.modality = 'text' and length(l.line) >= 30
              and contains(lower(l.line), lower(o.shared_entity)) and contains(lower(l.line), lower(o.answer))) as text_redundant from ato0 o"""),
    "pair": (["ato"], """
        select *, format('doc{}_mh_{:04d}', doc_id, row_number() over (partition by doc_id order by cross_modal desc, cross_page desc, sh_id1, sh_id2)) as mh_id from (
            select b.doc_id, b.shared_entity, b.sh_id as sh_id1, t.sh_id as sh_id2, b.layout_id as layout_id1, t.layout_id as layout_id2,
                   b.modality || '→' || t.modality as hop_path, b.modality != t.modality as cross_modal, b.page_id != t.page_id as cross_page,
                   t.answer as final_answer, 10.0::double - 2.0 * (length(t.answer) < 4)::int as quality_score
            from ato b join ato t on b.doc_id = t.doc_id and b.shared_entity = t.shared_entity and b.question_role = 'bridge' and t.question_role = 'target'
            where b.layout_id != t.layout_id and not (t.text_redundant and b.modality != t.modality))"""),
    "cha": (["pair"], """
        select * from (select *, row_number() over (partition by doc_id, least(layout_id1, layout_id2), greatest(layout_id1, layout_id2) order by mh_id) as n from pair) where n = 1"""),
    "pro": (["con"], "select doc_id, layout_id, regexp_extract(line, '[A-Z][a-z]+') as predicted from con"),
    "sho": (["cha", "pro"], f"""
        select mh_id, case when p1.doc_id is null or p2.doc_id is null then 'skip_missing_layout' when {_match('p1.predicted', 'final_answer')} then 'fail_hop1_sufficient'
                           when {_match('p2.predicted', 'final_answer')} then 'fail_hop2_sufficient' else 'pass' end as filter_result
        from cha c left join pro p1 on p1.doc_id = c.doc_id and p1.layout_id = c.layout_id1 left join pro p2 on p2.doc_id = c.doc_id and p2.layout_id = c.layout_id2"""),
    "ctx": (["lay"], _packed(1500)),
    "ctx_whole": (["lay"], _packed(200_000)),
    "vis": (["lay"], """
        select doc_id, list_slice(list_sort(list_distinct(list(page_id))), 1, 5) as pages from lay
        where modality != 'text' and (doc_id + page_id) % 4 != 3 group by doc_id"""),
    "syn": (["sha"], """
        select * from (select *, row_number() over (partition by doc_id order by num_layouts desc, cross_modal desc, canonical_name)::int as rank from sha where num_layouts >= 5) where rank <= 20"""),
    "synapp": (["syn", "app0"], """
        select * from (select s.doc_id, s.canonical_name, s.aliases, s.num_layouts, s.rank, a.layout_id, a.modality, row_number() over (partition by s.doc_id, s.canonical_name order by a.layout_id) as k
                       from syn s join app0 a using (doc_id, canonical_name)) where k <= 10"""),
    "fac": (["synapp", "con"], """
        select * from (
            select *, count(*) over (partition by doc_id, entity) as num_facts, row_number() over (partition by doc_id, entity order by layout_id)::int as fact_no from (
                select *, row_number() over (partition by doc_id, entity, data_points order by layout_id) as n from (
                    select s.doc_id, s.canonical_name as entity, s.layout_id, c.modality, list_sort(list_distinct(regexp_extract_all(c.content, '[a-z]{8,}'))) as data_points
                    from synapp s join con c using (doc_id, layout_id) where contains(lower(c.content), lower(s.canonical_name)) or len(list_filter(s.aliases, lambda a: contains(lower(c.content), lower(a)))) > 0)) where n = 1 or len(data_points) = 0) where num_facts >= 3"""),
}


def sql(steps: list[str], select: str) -> str:
    """A query over steps and all that they rest on."""
    order: list[str] = []

    def need(name: str) -> None:
        for other in STEPS[name][0]:
            need(other)
        if name not in order:
            order.append(name)

    for name in steps:
        need(name)
    if not order:
        return select
    return "with " + ",\n".join(f"{n} as materialized ({STEPS[n][1]})" for n in order) + f"\n{select}"


_ITEMS = "(select coalesce(max(item_id), 0) + 1 from benchmark)"
_TURN_KEY = "conv_id || '_' || (turn // 4)"
_SENTENCES = "list_filter(string_split(text, '. '), lambda s: s != '')"
ORACLES: dict[str, str] = {
    "layout_content": sql(["lay"], f"""
        select doc_id, layout_id, page_id, modality, case when length(c) >= 50 then c end as strict, case when length(c) >= 50 then c end as lenient, c as whole
        from (select *, case when modality = 'text' then trim(line, '{_W}') when line != '' then 'Text in image: ' || line else '' end as c from lay)"""),
    "entity_mentions": sql(["men"], "select doc_id, layout_id, page_id, modality, ord, name from men"),
    "normalize_entities": f"select name, {_norm('name')} as norm from (select distinct unnest(string_split(text, ' ')) as name from documents)",
    "content_words": sql(["lea"], f"select name, array_to_string({_words('name')}, '|') as words from (select distinct name from lea)"),
    "answer_matches": f"""
        select doc_id, item_id, {_match('said', 'gold')} as matches from (select doc_id, doc_id % {_ITEMS} as item_id, text as said from documents)
        join (select item_id, string_split(text, ' ')[1] as gold from benchmark) using (item_id)""",
    "leakage_guard": f"""
        select conv_id, turn, leak, score, not leak and length(text) >= 15 and score >= case when turn % 3 = 0 then 7.0 else 8.0 end as keep from (
            select c.*, contains(lower(c.text), lower(regexp_extract(b.text, '[A-Z][a-z]+'))) as leak, (length(c.text) % 11)::double as score
            from conversations c join benchmark b on b.item_id = c.conv_id % {_ITEMS} where role = 'user')""",
    "response_parse": "select conv_id, turn, case when conv_id % 3 < 2 then role end as answer, case when conv_id % 3 < 2 then turn::varchar end as score from conversations",
    "caption_merge": sql(["lay"], """
        , given as (
            select page_id, try_cast(regexp_extract(url, '/([0-9]+)', 1) as bigint) as doc_id, (page_id % 8)::int as layout_id,
                   regexp_extract(html, '<title>([^<]*)</title>', 1) as caption, regexp_extract(url, '/([a-z]{2})/', 1) as topic from pages),
        last as (select * from (select *, row_number() over (partition by doc_id, layout_id order by page_id desc) as n from given) where n = 1),
        merged as (select l.doc_id, l.layout_id, l.line, g.caption, coalesce(g.topic, '') as topic from lay l left join last g using (doc_id, layout_id) where l.modality != 'text'),
        said as (select *, array_to_string(list_filter([case when coalesce(caption, '') != '' then 'Caption: ' || caption end, case when topic != '' then 'Topic: ' || topic end,
                                          case when line != '' then 'Text in image: ' || line end], lambda x: x is not null), chr(10)) as c from merged)
        select doc_id, layout_id, caption, topic, case when length(c) >= 50 then c end as content from said"""),
    "doc_selection": """
        select doc_id, 'one' as pick from documents where doc_id = 7 union all select doc_id, 'range' from documents where doc_id >= 100 and doc_id < 999999
        union all select doc_id, 'list' from documents where doc_id in (3, 5, 8) union all select doc_id, 'system' from documents where source != 'src1'""",
    "file_roundtrip": "select doc_id, lang, n_chars, source from documents",
    "plural_groups": sql(["plu"], "select * from plu"),
    "shared_entities": sql(["sha"], """
        select doc_id, canonical_name, array_to_string(aliases, '|') as aliases, 'group' as entity_types, num_layouts, array_to_string(modalities, '|') as modalities, cross_modal, cross_page, true as is_named_entity, position from sha"""),
    "alias_candidates": sql(["cand"], "select * from cand"),
    "alias_components": sql(["cand", "lea"], f"""
        , matched as (select * from cand where {_words('a')} = {_words('b')}),
        ways as (select doc_id, a, b from matched union select doc_id, b, a from matched),
        reach as (select r.doc_id, r.a as name, min(r.b) as root from (
            with recursive walk as (select doc_id, a, b from ways union select w.doc_id, w.a, n.b from walk w join ways n on w.doc_id = n.doc_id and w.b = n.a) select * from walk
            union select doc_id, a, a from ways) r group by all),
        best as (select *, row_number() over (partition by doc_id, root order by n desc, name) as k from reach join lea using (doc_id, name))
        select r.doc_id, r.name, b.name as canonical from reach r join best b on r.doc_id = b.doc_id and r.root = b.root and b.k = 1"""),
    "atomic_seed_topn": sql(["seed"], "select doc_id, canonical_name, num_layouts, cross_modal, rank from seed"),
    "seed_appearances": sql(["app"], "select doc_id, canonical_name, layout_id, modality, shared_entity from app"),
    "text_redundancy": sql(["ato"], "select sh_id, doc_id, shared_entity, question_role, answer, layout_id, text_redundant from ato"),
    "bridge_pairs": sql(["pair"], "select mh_id, doc_id, shared_entity, sh_id1, sh_id2, hop_path, cross_modal, cross_page, final_answer, quality_score from pair"),
    "pair_dedup": sql(["cha"], "select mh_id, doc_id, layout_id1, layout_id2 from cha"),
    "shortcut_verdict": sql(["sho"], "select mh_id, filter_result from sho"),
    "bridge_answer_dedup": sql(["cha", "sho"], f"""
        select mh_id, shared_entity, final_answer, quality_score from (
            select *, row_number() over (partition by doc_id, shared_entity, trim(lower(final_answer), '{_W}') order by quality_score desc, mh_id) as k
            from cha join sho using (mh_id) where filter_result = 'pass') where k = 1"""),
    "context_packing": sql(["ctx"], "select doc_id, layout_id, ord, length(chunk)::int as size from ctx"),
    "visual_pages": sql(["vis"], "select doc_id, array_to_string(pages, '|') as pages from vis"),
    "modality_verdict": sql(["cha", "ctx_whole", "vis", "lay"], """
        select mh_id, case when not cross_modal then 'skip_not_cross_modal'
            when exists (select 1 from ctx_whole x where x.doc_id = c.doc_id and contains(lower(x.chunk), lower(c.final_answer))) then 'fail_text_only_sufficient'
            when exists (select 1 from lay l join vis v using (doc_id) where l.doc_id = c.doc_id and l.modality != 'text' and list_contains(v.pages, l.page_id) and contains(lower(l.line), lower(c.final_answer))) then 'fail_visual_only_sufficient'
            else 'pass' end as filter_result from cha c"""),
    "final_review": """
        select doc_id, (case when quality is null then 5 else least(quality * 10, 10 - toxic * 5, least(n_chars // 100, 10)) end)::bigint as min_score,
               quality is null or least(quality * 10, 10 - toxic * 5, least(n_chars // 100, 10)) >= 7 as keep from documents left join labels using (doc_id)""",
    "verdict_summary": """
        select lang, count(*) as total, count(*) filter (quality = 1 and toxic = 0) as passed, round(avg((quality = 1 and toxic = 0)::int::double), 4) as pass_rate from labels join documents using (doc_id) group by lang""",
    "judge_replay": "select doc_id, doc_id % 3 = 0 or doc_id % 2 = 0 as open, doc_id % 3 != 0 and doc_id % 2 = 0 as closed from documents",
    "synthesis_candidates": sql(["synapp"], "select doc_id, canonical_name, num_layouts, rank, string_agg(layout_id::varchar, '|' order by layout_id) as layouts from synapp group by doc_id, canonical_name, num_layouts, rank"),
    "fact_dedup": sql(["fac"], "select doc_id, entity, fact_no, layout_id, num_facts, array_to_string(data_points, '|') as data_points from fac"),
    "pattern_required": sql(["fac"], """
        , valid as (select doc_id, entity from fac where fact_no % 2 = 1 group by all having count(*) + 1 >= 3)
        select doc_id, entity, string_agg(fact_no::varchar, '|' order by fact_no) as required, (count(*) + 1)::int as num_required, array_to_string(list_sort(list_distinct(list(modality))), '|') as modalities
        from fac join valid using (doc_id, entity) where fact_no % 2 = 1 group by all"""),
    "leave_one_out": sql(["fac"], """
        , marked as (select x.doc_id, x.entity, x.fact_no, x.modality, exists (select 1 from fac y where y.doc_id = x.doc_id and y.entity = x.entity and y.fact_no != x.fact_no and list_has_all(y.data_points, x.data_points)) as needless from fac x)
        select doc_id, entity, coalesce(string_agg(fact_no::varchar, '|' order by fact_no) filter (not needless), '') as required, coalesce(string_agg(fact_no::varchar, '|' order by fact_no) filter (needless), '') as optional,
               (count(*) filter (not needless))::int as num_required, 0::int as n_llm_failed, coalesce(array_to_string(list_sort(list_distinct(list(modality) filter (not needless))), '|'), '') as modalities,
               case when count(*) filter (not needless) < 3 then 'fail_insufficient_required_evidence' else 'pass' end as filter_result from marked group by all"""),
    "text_rag_verdict": sql(["fac", "lay"], f"""
        , asked as (select doc_id, entity, list_sort(list_distinct(flatten(list(data_points)))) as points from fac group by all),
        chunks as (select doc_id, layout_id, trim(line, '{_W}') as chunk from lay where modality = 'text' and trim(line, '{_W}') != ''),
        q as (select doc_id, entity, points, {_unit("entity || ' ' || array_to_string(points, ' ')")} as v from asked),
        c as (select doc_id, layout_id, chunk, {_unit("chunk")} as v from chunks),
        hits as (select q.doc_id, q.entity, c.chunk, row_number() over (partition by q.doc_id, q.entity order by list_dot_product(q.v, c.v) desc, c.layout_id) as k from q join c using (doc_id)),
        top as (select doc_id, entity, string_agg(chunk, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by k) as context, count(*)::int as n from hits where k <= 20 group by all),
        judged as (select doc_id, entity, coalesce(n, 0)::int as retrieved_n, context is not null and len(list_filter(points, lambda p: not contains(context, p))) = 0 as sufficient from asked left join top using (doc_id, entity))
        select *, case when sufficient then 'fail_text_rag_sufficient' else 'pass' end as filter_result from judged"""),
    "cosine_topk": """
        with u as (select vec_id, embedding::double[] as v from embeddings),
        n as (select vec_id, list_transform(v, lambda x: x / (sqrt(list_sum(list_transform(v, lambda y: y * y))) + 1e-9)) as v from u)
        select query_id, rank, chunk_id from (select q.vec_id as query_id, c.vec_id as chunk_id, row_number() over (partition by q.vec_id order by list_dot_product(q.v, c.v) desc, c.vec_id)::int as rank
              from n q join n c on q.vec_id % 50 = 0 and c.vec_id != q.vec_id) where rank <= 20""",
    "pair_answers_gt": f"""
        with keyed as (select conv_id as doc_id, turn, text, case when turn % 4 in (0, 2) then {_TURN_KEY} end as question_id from conversations where role = 'user'),
        truth as (select * from (select *, row_number() over (partition by doc_id, question_id order by turn desc) as k from keyed where question_id is not null) where k = 1),
        said as (select conv_id as doc_id, turn, {_TURN_KEY} as question_id, turn % 5 = 1 as single from conversations where role = 'assistant')
        select s.doc_id, s.turn, s.question_id, coalesce(case when t.turn % 4 = 0 then t.text else string_split(t.text, ' ')[-1] end, '') as gt_answer,
               case when single then 'single_hop' when t.turn % 4 = 0 then 'bridge_chain' when t.turn is not null then 'synthesis' else 'unknown' end as question_type,
               case t.turn % 6 when 0 then 'text_only' when 2 then 'multimodal' else 'unknown' end as modality_type,
               case when t.turn % 4 = 0 then 3 else 2 end::int as num_hops,
               case when single then 'single_hop' when t.turn % 4 = 0 then 'bridge_3hop' when t.turn is not null then 'synthesis' else 'unknown' end as assigned_type,
               case when t.turn % 4 = 0 then 'text→figure' else '' end as hop_path
        from said s left join truth t using (doc_id, question_id)""",
    "enriched_reference": f"""
        with r as (select conv_id, turn, text, conv_id % 3 as kind, {_SENTENCES} as s from conversations where role = 'user'),
        h as (select *, list_filter(list_transform(s, lambda x, i: case when trim(x, '{_W}') != '' and trim(string_split(x, ' ')[-1], '{_W}') != '' then '  Hop ' || i || ': ' || trim(x, '{_W}') || ' -> ' || trim(string_split(x, ' ')[-1], '{_W}') end), lambda x: x is not null) as hops,
                     list_filter(list_transform(s, lambda x, i: case when trim(x, '{_W}') != '' then '  ' || i || '. ' || trim(x, '{_W}') end), lambda x: x is not null) as points from r)
        select conv_id, turn, array_to_string(list_concat(['Final answer: ' || text],
               case when kind = 0 and len(s) > 0 then list_concat(['', 'Reasoning chain:'], hops, ['', 'Bridge entities: ' || array_to_string(list_transform(s, lambda x: string_split(x, ' ')[1]), ', ')])
                    when kind = 1 and len(s) > 0 then list_concat(['', 'Required evidence points:'], points) else [] end), chr(10)) as reference from h""",
    "entity_recall": f"""
        with parts as (
            select item_id, list_concat(regexp_extract_all(text, '[A-Z][a-z]+'), regexp_extract_all(text, '[(]([^)]+)[)]', 1), regexp_extract_all(text, '[0-9]+'), [string_split(text, ' ')[1]]) as names from benchmark),
        g as (select item_id, list_filter(list_distinct(list_transform(names, lambda x: lower(trim(x, '{_W}')))), lambda x: x != '') as names from parts),
        m as (select doc_id, item_id, d.text, names, len(list_filter(names, lambda n: contains(lower(d.text), n)))::int as hits from (select *, doc_id % {_ITEMS} as item_id from documents) d join g using (item_id))
        select doc_id, item_id, hits, len(names)::int as total, case when coalesce(text, '') = '' then 0.0 when len(names) > 0 then round(hits / len(names), 4) end as recall from m""",
    "step_coverage": f"""
        with q as (select conv_id, turn + 1 as turn, {_SENTENCES} as s from conversations where role = 'user'),
        a as (select conv_id, turn, case when turn % 7 = 1 then '' else text end as r from conversations where role = 'assistant')
        select conv_id, turn, len(s)::int as steps, case when r = '' then 0.0 when conv_id % 5 = 0 then null when len(s) > 0
               then round(len(list_filter(s, lambda x: contains(lower(r), lower(string_split(x, ' ')[1])))) / len(s), 4) end as coverage from a join q using (conv_id, turn)""",
    "metric_summary": """
        with e as (select event_type, (user_id % 5)::varchar as bucket, round(value, 2)::decimal(18, 2)::double as value from events where user_id % 5 != 3)
        select dim, key, 'value' as metric, round(avg(value), 4) as mean, round(stddev_pop(value), 4) as std, count(*) as n from (
            select 'overall' as dim, '' as key, value from e union all select 'event_type', event_type, value from e union all select 'bucket', bucket, value from e) group by dim, key""",
    "fill_missing": """
        select l.doc_id, coalesce(case when l.doc_id % 4 != 0 then quality end, (n_chars % 2)::int)::int as quality, toxic from labels l left join documents using (doc_id)""",
    "missing_metrics": "select doc_id % 10 as bucket, bool_or(doc_id % 4 = 0 or quality is null) as lacks_quality, bool_or(toxic is null) as lacks_toxic from labels group by 1",
    "incremental_skip": "select doc_id, lang from documents where doc_id not in (select doc_id from labels)",
    "benchmark_assembly": """
        select doc_id, format('doc{}_mh_{:04d}', doc_id, doc_id) as question_id, 'bridge_chain' as question_type, text as answer from documents where doc_id % 2 = 0 and n_chars > 500
        union all select doc_id, format('doc{}_syn_{:04d}', doc_id, doc_id), 'synthesis', text from documents where doc_id % 2 = 1 and n_chars > 900
        union all select conv_id, format('doc{}_sh_{:04d}', conv_id, turn), 'single_hop', text from conversations where role = 'user'""",
}
