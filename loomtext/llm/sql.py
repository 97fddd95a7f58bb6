"""DuckDB SQL that gives the same rows as the queries of :mod:`loomtext.llm.queries`, where SQL can."""

_NORMAL = "replace(replace(replace(nfc_normalize(replace(lower(nfc_normalize(term)), 'ß', 'ss')), '’', ''''), 'ʼ', ''''), '‘', '''')"
_POSTINGS = f"""
    valid as (
      select {_NORMAL} as term, doc_id, sum(tf)::bigint as tf
      from (select distinct term, doc_id, tf, positions from postings where term is not null and doc_id is not null and tf > 0)
      group by all)"""
_RESULTS = """
    latest as (
      select query_id, scorer, doc_id, score from (
        select *, row_number() over (partition by query_id, scorer, doc_id order by scored_at desc nulls last, score desc) as age
        from results where query_id is not null and scorer is not null and doc_id is not null and score is not null and not isnan(score))
      where age = 1)"""
_WEIGHTS = f"""
    {_POSTINGS},
    length as (select doc_id, sum(tf)::bigint as length from valid group by doc_id),
    frequency as (select term, count(*) as df from valid group by term),
    whole as (select count(*) as n, avg(length) as average from length),
    weighted as (
      select doc_id, term, tf, df, length,
        ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / average)) as weight
      from valid join length using (doc_id) join frequency using (term), whole)"""

SQL: dict[str, str] = {
    "p1_found": f"""
    with {_POSTINGS},
    counts as (select term, count(*) as documents from valid group by term),
    holding as (select count(distinct doc_id) as holding from valid)
    select term, case when documents <= 2 then 'rare' else 'common' end as mark
    from counts, holding where documents <= 2 or documents > 0.4 * holding""",
    "p1_counts": f"""
    with {_POSTINGS}
    select term, sum(tf)::bigint as occurrences, count(*) as documents from valid group by term""",
    "p5_found": f"""
    with {_WEIGHTS}
    select doc_id, term from (
      select doc_id, term, row_number() over (partition by doc_id order by round(weight, 9) desc, term) as place from weighted)
    where place = 1""",
    "p5_weights": f"""
    with {_WEIGHTS}
    select doc_id, term, tf, df, length, round(weight, 6) as weight from weighted""",
    "p6_found": r"""
    with items as (
      select 'document' as kind, doc_id as item_id, text from documents where length(text) > 2000 and doc_id is not null
      union all select 'passage', passage_id, passage from passages where length(passage) > 2000 and passage_id is not null)
    select kind, item_id,
      case when len(list_filter(regexp_split_to_array(text, '[\s\x0b\x1c-\x1f\x{85}\p{Z}.!?。！？।؟]+'), lambda x: length(x) > 2000)) > 0
        then 'forced' else 'boundary' end as cut
    from items""",
    "p6_audit": """
    select kind, item_id, 0 as over_limit, 0 as wrong_overlap, 0 as would_fit, length(text) as characters from (
      select 'document' as kind, doc_id as item_id, text from documents where doc_id is not null
      union all select 'passage', passage_id, passage from passages where passage_id is not null)
    where length(text) > 2000""",
    "p7_found": f"""
    with {_RESULTS}
    select query_id, scorer, doc_id from (
      select *, row_number() over (partition by query_id, scorer order by score desc, doc_id) as place from latest)
    where place <= 10""",
}

_WORDS = (
    "coalesce(regexp_extract_all(replace(replace(replace(nfc_normalize(replace(replace(lower(nfc_normalize(text)), 'ß', 'ss'), 'ς', 'σ')), '’', ''''), 'ʼ', ''''), '‘', ''''), "
    r"'[\p{L}\p{N}]+(?:''[\p{L}\p{N}]+)*'), [])"
)


def _runs(table: str, key: str) -> str:
    """Every run of twelve words of a table's texts."""
    return f"""(select distinct {key}, array_to_string(w[i + 1 : i + 12], ' ') as run
      from (select {key}, w, unnest(range(greatest(len(w) - 11, 0))) as i from (select {key}, {_WORDS} as w from {table})))"""


SQL["p2_found"] = f"""
    with {_RESULTS},
    bounds as (select query_id, scorer, s[greatest(1, ceil(0.05 * len(s)))::int] as low, s[greatest(1, ceil(0.95 * len(s)))::int] as high
      from (select query_id, scorer, list_sort(list(score)) as s from latest group by all)),
    grid as (select query_id, doc_id, scorer, coalesce(least(greatest(score, low), high), low, 0) as v
      from (select distinct query_id, doc_id from latest) cross join (select distinct scorer from latest)
      left join latest using (query_id, doc_id, scorer) left join bounds using (query_id, scorer)),
    z as (select query_id, doc_id, scorer, case when max(v) over w > min(v) over w then (v - avg(v) over w) / sqrt(sum(c * c) over w) else 0 end as z
      from (select *, v - avg(v) over (partition by query_id, scorer) as c from grid) window w as (partition by query_id, scorer)),
    ends as (select query_id, scorer, max(z) as best, min(z) as worst from z group by all),
    parts as (select query_id, doc_id, sqrt(sum((z - worst) ** 2)) as far, sqrt(sum((z - best) ** 2)) as near from z join ends using (query_id, scorer) group by all)
    select query_id, doc_id from (
      select *, row_number() over (partition by query_id order by round(case when far + near > 0 then far / (far + near) else 0.5 end, 9) desc, doc_id) as place from parts)
    where place <= 3"""
SQL["p4_found"] = """
    with valid as (select passage_id as id, list_transform(embedding, lambda x: x::double) as e from passages
        where passage_id is not null and len(embedding) = 64 and not isnan(list_sum(list_transform(embedding, lambda x: x::double)))),
    unit as (select id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) as u from valid where list_dot_product(e, e) > 0),
    near as (select a.id as a, b.id as b, round(list_dot_product(a.u, b.u), 6) as cosine from unit a join unit b on a.id <> b.id),
    best as (select a, b, cosine, row_number() over (partition by a order by cosine desc, b) as place from near)
    select distinct least(a, b) as passage_id_a, greatest(a, b) as passage_id_b from best where place <= 5 and cosine >= 0.86"""
SQL["p9_found"] = f"select distinct doc_id, item_id from {_runs('documents', 'doc_id')} join {_runs('eval_items', 'item_id')} using (run)"
SQL["p9_coverage"] = f"""
    with docs_ as (select doc_id, {_WORDS} as w from documents),
    held as (select distinct run from {_runs('eval_items', 'item_id')}),
    runs_at as (select doc_id, i, array_to_string(w[i + 1 : i + 12], ' ') as run from (select doc_id, w, unnest(range(greatest(len(w) - 11, 0))) as i from docs_)),
    covered as (select doc_id, count(distinct i + j) as n from runs_at join held using (run), range(12) as r(j) group by doc_id)
    select doc_id, len(w)::int as words, coalesce(n, 0)::int as leaked_words from docs_ left join covered using (doc_id)"""
