"""The registered queries over the Parquet tables of a folder, and DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.functions import snippets, vectors, web
from loomtext.functions.text import tokens
from loomtext.operators import index as ix
from loomtext.operators import quality, scoring, search, semantic
from loomtext.scratch import scratch_path
from loomtext.skew import spread
from loomtext.sources import store
from loomtext.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a function under its name, with the SQL that checks it."""

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "documents").select("doc_id", "path", "title", "text"))


def index(spark: SparkSession, folder: str) -> ix.Index:
    """An index of which both tables are read."""
    return ix.build_index(documents(spark, folder), tokens_once=True)


_SAVED: dict[tuple[str, str], str] = {}


def saved_index(spark: SparkSession, folder: str) -> ix.Index:
    """The documents' index as saved, built at the first query of an application over a folder and read by all later ones."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _SAVED:
        path = scratch_path(spark, "saved-index")
        store.save(index(spark, folder), path)
        _SAVED[key] = path
    return store.load(spark, _SAVED[key], validate=False)


# SQL building blocks -------------------------------------------------------------------------------------------------

_NORMAL = "replace(replace(replace(nfc_normalize(replace(replace(lower(nfc_normalize({0})), 'ß', 'ss'), 'ς', 'σ')), '’', ''''), 'ʼ', ''''), '‘', '''')"
_TOKENS = "coalesce(regexp_extract_all(" + _NORMAL + r", '[\p{{L}}\p{{N}}]+(?:''[\p{{L}}\p{{N}}]+)*'), [])"
_TITLE = r"coalesce(nullif(title, ''), replace(regexp_replace(regexp_extract(path, '([^/]*)$', 1), '(.)\.[^.]*$', '\1'), '_', ' '), '')"
_DOCS = f"""
    docs_ as (select doc_id, path, {_TITLE} as title, {_TOKENS.format("text")} as toks, text from documents),
    lengths as (select doc_id, len(toks)::int as length from docs_),
    words as (select doc_id, unnest(toks) as term, generate_subscripts(toks, 1) - 1 as pos from docs_),
    posts as (select term, doc_id, count(*)::int as tf, list(pos order by pos) as positions from words group by all),
    whole as (select count(*)::double as n, coalesce(avg(length), 0) as average from lengths),
    freq as (select term, count(*)::double as df from posts group by term)"""
_BM25 = "ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / average))"
_TFIDF = "(1 + ln(tf)) * ln(1 + n / df)"


def _scores(formula: str, terms: str) -> str:
    return f"(select doc_id, sum({formula}) as score from posts join freq using (term) join lengths using (doc_id), whole where term in ({terms}) group by doc_id)"


def _phrase(*terms: str) -> str:
    joins = "".join(f" join words w{i} on w{i}.doc_id = w0.doc_id and w{i}.pos = w0.pos + {i} and w{i}.term = '{t}'" for i, t in enumerate(terms) if i)
    return f"(select distinct w0.doc_id from words w0{joins} where w0.term = '{terms[0]}')"


def _has(term: str) -> str:
    return f"(select doc_id from posts where term = '{term}')"


# index and statistics ------------------------------------------------------------------------------------------------


@query(f"select doc_id, array_to_string({_TOKENS.format('text')}, ' ') as tokens from documents")
def tokenize(spark, folder):
    return documents(spark, folder).select("doc_id", F.array_join(tokens(F.col("text")), " ").alias("tokens"))


@query(f"with {_DOCS} select term, doc_id, tf from posts")
def index_postings(spark, folder):
    return ix.build_index(documents(spark, folder), positions=False).postings


@query(f"with {_DOCS} select term, doc_id, array_to_string(positions, ',') as positions from posts")
def index_positions(spark, folder):
    return ix.build_index(documents(spark, folder)).postings.select("term", "doc_id", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"))


@query(f"with {_DOCS} select doc_id, length from lengths")
def doc_lengths(spark, folder):
    return ix.build_index(documents(spark, folder)).docs.select("doc_id", "length")


@query(f"with {_DOCS} select term, df::bigint as df from freq")
def term_df(spark, folder):
    return ix.document_frequency(ix.build_index(documents(spark, folder), positions=False).postings)


@query(f"""with {_DOCS} select (select count(*) from lengths) as documents, (select sum(length)::bigint from lengths) as tokens,
    (select count(*) from freq) as terms, round(average, 6) as average_length from whole""")
def corpus_stats(spark, folder):
    return ix.corpus_stats(ix.build_index(documents(spark, folder), positions=False, tokens_once=True)).withColumn("average_length", F.round("average_length", 6))


@query(f"with {_DOCS} select term, count(*) as df, sum(tf)::bigint as cf from posts group by term order by cf desc, term limit 50")
def top_terms(spark, folder):
    return ix.top_terms(ix.build_index(documents(spark, folder), positions=False).postings)


@query(f"with {_DOCS} select term, count(*) as cf from words group by term")
def token_counts(spark, folder):
    return ix.token_counts(documents(spark, folder))


@query(f"with {_DOCS} select term, count(*) as df, sum(tf)::bigint as cf from posts group by term")
def index_merge(spark, folder):
    """Two halves indexed apart and merged."""
    docs = documents(spark, folder)
    odd = F.pmod("doc_id", F.lit(2)) == 1
    merged = ix.merge_indexes([ix.build_index(docs.where(odd)), ix.build_index(docs.where(~odd))])
    return ix.term_statistics(merged.postings)


_RULES = "term_empty tf_not_positive positions_count positions_order positions_negative length_differs position_beyond_length posting_twice doc_id_twice"


@query("select unnest([" + ", ".join(f"'{r}'" for r in _RULES.split()) + "]) as rule, 0::bigint as violations")
def index_integrity(spark, folder):
    return ix.integrity(index(spark, folder).written())


@query("""with hashed as (select sha256(concat_ws(chr(31), doc_id::varchar, coalesce(path, ''), coalesce(text, ''))) as h from documents),
    folded as (select sum(('0x' || substr(h, 1, 15))::bigint) as a, sum(('0x' || substr(h, 16, 15))::bigint) as b, sum(('0x' || substr(h, 31, 15))::bigint) as c,
      sum(('0x' || substr(h, 46, 15))::bigint) as d, count(*) as n from hashed)
    select sha256(concat_ws(',', a::hugeint::varchar, b::hugeint::varchar, c::hugeint::varchar, d::hugeint::varchar, n::varchar)) as fingerprint from folded""")
def corpus_fingerprint(spark, folder):
    return ix.fingerprint(documents(spark, folder))


@query("select doc_id, path, title, length(text) as characters from documents where doc_id = 7")
def doc_lookup(spark, folder):
    return documents(spark, folder).where("doc_id = 7").select("doc_id", "path", "title", F.length("text").cast("long").alias("characters"))


# Boolean queries -----------------------------------------------------------------------------------------------------


def _matches(name: str, text: str, sql: str) -> None:
    QUERIES[name], SQL[name] = lambda spark, folder: search.matched_documents(documents(spark, folder), text), f"with {_DOCS} {sql}"


_matches("q_term", "the", f"select doc_id from {_has('the')}")
_matches("q_phrase", '"see the"', f"select doc_id from {_phrase('see', 'the')}")
_matches("q_and", "the AND buffer", f"select doc_id from {_has('the')} intersect select doc_id from {_has('buffer')}")
_matches("q_or", "der OR buffer", f"select doc_id from {_has('der')} union select doc_id from {_has('buffer')}")
_matches("q_not", 'NOT (the OR "la copia")', f"select doc_id from lengths except select doc_id from {_has('the')} except select doc_id from {_phrase('la', 'copia')}")

@query(f"with {_DOCS} (select doc_id from {_has('buffer')} union select doc_id from {_has('der')}) intersect select doc_id from {_has('the')}")
def q_boolean_ltr(spark, folder):
    """The left-to-right dialect, over the saved index."""
    return search.boolean_search(saved_index(spark, folder), "buffer OR der the")


@query(f"with {_DOCS} select doc_id from lengths except (select doc_id from {_has('the')} intersect select doc_id from {_has('of')})")
def q_boolean_sets(spark, folder):
    """The same tree by set algebra on document ids."""
    return search.matched_by_sets(saved_index(spark, folder), "NOT (the of)")


@query(f'with {_DOCS} (select doc_id from {_has("the")} union select doc_id from {_has("der")}) except select doc_id from {_phrase("the", "log", "says")}')
def q_compound(spark, folder):
    """Through the index: one aggregate per document whatever the query."""
    return search.matched(index(spark, folder), '(the OR der) NOT "the log says"')


def _sets(name: str, f, op: str) -> None:
    def run(spark, folder):
        docs = documents(spark, folder)
        return f(*(search.matched_documents(docs, t) for t in ("the", "of")))

    QUERIES[name], SQL[name] = run, f"with {_DOCS} select doc_id from {_has('the')} {op} select doc_id from {_has('of')}"


_sets("set_intersect", search.intersect, "intersect")
_sets("set_union", search.union, "union")
_sets("set_except", search.difference, "except")


# ranking -------------------------------------------------------------------------------------------------------------


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 6))


@query(f"with {_DOCS} select doc_id, round(score, 6) as score from {_scores(_BM25, chr(39) + 'the' + chr(39) + ', ' + chr(39) + 'der' + chr(39))}")
def bm25_scores(spark, folder):
    return _rounded(search.rank_documents(documents(spark, folder), "the OR der"))


@query(f"with {_DOCS} select doc_id, round(score, 6) as score from {_scores(_TFIDF, chr(39) + 'the' + chr(39) + ', ' + chr(39) + 'der' + chr(39))}")
def tfidf_scores(spark, folder):
    built = ix.build_index(documents(spark, folder), positions=False).written()
    return _rounded(scoring.document_scores(built, scoring.TfIdf(), ["the", "der"]))


def _top(formula: str, k: int = 10, terms: str = "'buffer', 'queue'", matching: str = "select doc_id from lengths") -> str:
    return f"""with {_DOCS}, ranked as (select doc_id, round(score, 6) as score from {_scores(formula, terms)} where doc_id in ({matching})),
    top as (select *, row_number() over (order by score desc, doc_id)::int as rank from ranked)
    select rank, doc_id, score, title, path from top join docs_ using (doc_id) where rank <= {k}"""


def _search(spark, folder, scorer):
    """Search without an index; snippets are Python's and checked by tests."""
    found = search.search(documents(spark, folder), "buffer OR queue", scorer, k=10, digits=6)
    return found.select("rank", "doc_id", "score", "title", "path")


@query(_top(_BM25))
def search_bm25(spark, folder):
    return _search(spark, folder, scoring.BM25())


@query(_top(_TFIDF))
def search_tfidf(spark, folder):
    return _search(spark, folder, scoring.TfIdf())


@query(_top(_BM25))
def search_index_bm25(spark, folder):
    """The same over the saved index: of its postings only the row groups that can hold the terms are read."""
    return search.search(saved_index(spark, folder), "buffer OR queue", k=10, digits=6).select("rank", "doc_id", "score", "title", "path")


@query(_top(_BM25, terms="'see', 'the', 'buffer'", matching=f"select doc_id from {_phrase('see', 'the')} union select doc_id from {_has('buffer')}"))
def search_index_phrase(spark, folder):
    return search.search(saved_index(spark, folder), '"see the" OR buffer', k=10, digits=6).select("rank", "doc_id", "score", "title", "path")


@query()
def search_snippets(spark, folder):
    return search.search(documents(spark, folder), 'buffer (queue OR thread) NOT "see the"', k=10, digits=6)


@query(f"""with {_DOCS}, ranked as (select doc_id, round(score, 6) as score from {_scores(_BM25, "'buffer', 'queue'")}),
    top as (select *, row_number() over (order by score desc, doc_id)::int as rank, count(*) over () as total from ranked)
    select total, ceil(total / 10)::bigint as pages, rank, doc_id, score from top where rank > 10 and rank <= 20""")
def search_page(spark, folder):
    return search.search_page(documents(spark, folder), "buffer OR queue", k=10, page=2, digits=6)


_RUNS = r"""runs as (
      select doc_id, unnest(r) as run, generate_subscripts(r, 1) as i
      from (select doc_id, regexp_extract_all(text, '[\p{L}\p{N}\p{M}''’ʼ‘]+|[^\p{L}\p{N}\p{M}''’ʼ‘]+') as r from documents where text is not null)),
    placed as (select doc_id, run, coalesce(sum(length(run)) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) as place from runs),
    hits as (select doc_id, place + length(run) - length(ltrim(run, '''’ʼ‘')) as start, lower(trim(run, '''’ʼ‘')) as term from placed where lower(trim(run, '''’ʼ‘')) in ('buffer', 'queue', 'the')),
    windows as (select doc_id, start, count(*) over w as hits, len(list_distinct(list(term) over w)) as distinct_terms
      from hits window w as (partition by doc_id order by start range between 80 preceding and 80 following))
    """


@query(f"""with {_RUNS} select doc_id, start::bigint as start, distinct_terms::int as distinct_terms, hits from (
      select *, row_number() over (partition by doc_id order by distinct_terms desc, hits desc, start) as place from windows) where place = 1""")
def snippet_window(spark, folder):
    """Of each document the hit around which most distinct terms, then most hits, lie within 80 characters."""
    return snippets.best_windows(documents(spark, folder), ("buffer", "queue", "the"))


@query(r"""select distinct snippet, regexp_replace(replace(replace(replace(replace(replace(snippet, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;'),
    '\[([^\[\]]+)\]', '<mark>\1</mark>', 'g') as html from results""")
def highlight(spark, folder):
    return table(spark, folder, "results").select("snippet").distinct().select("snippet", snippets.highlight(F.col("snippet")).alias("html"))


@query("""with latest as (select query_id, scorer, doc_id, score from (
      select *, row_number() over (partition by query_id, scorer, doc_id order by scored_at desc nulls last, score desc) as age
      from results where query_id is not null and scorer is not null and doc_id is not null and score is not null and not isnan(score)) where age = 1),
    first as (select query_id, scorer, doc_id from (select *, row_number() over (partition by query_id, scorer order by score desc, doc_id) as place from latest) where place <= 5),
    rel as (select distinct query_id, docs.doc_id from (select query_id, unnest(relevant) as path from judgments) join docs using (path)),
    hits as (select query_id, scorer, count(*) as hits from first join rel using (query_id, doc_id) group by all),
    judged as (select query_id, scorer from (select distinct query_id from rel) cross join (select distinct scorer from latest))
    select query_id, scorer, coalesce(hits, 0) as hits, coalesce(hits, 0) / 5.0::double as precision from judged left join hits using (query_id, scorer)""")
def precision_at_k(spark, folder):
    """P@5 of every scorer's latest results over all judged queries."""
    rows = table(spark, folder, "results").where("query_id is not null and scorer is not null and doc_id is not null and score is not null and not isnan(score)")
    latest = rows.groupBy("query_id", "scorer", "doc_id").agg(F.max(F.struct("scored_at", "score")).alias("last")).select("query_id", "scorer", "doc_id", "last.score")
    judged = table(spark, folder, "judgments").select("query_id", F.explode("relevant").alias("path"))
    return quality.precision_at_k(latest, judged.join(table(spark, folder, "docs").select("path", "doc_id"), "path"), 5, by=["scorer"])


# passages and vectors ------------------------------------------------------------------------------------------------

_CHUNKS = r"""ws as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\s\x0b\x1c-\x1f\x{85}\p{Z}]+'), lambda x: x <> '') as w from documents),
    starts as (select doc_id, w, unnest(range(case when len(w) = 0 then 0 when len(w) <= 160 then 1 else ceil((len(w) - 160) / 128.0)::bigint + 1 end)) as chunk from ws)"""


@query(f"with {_CHUNKS} select doc_id, chunk::int as chunk, array_to_string(w[chunk * 128 + 1 : chunk * 128 + 160], ' ') as passage from starts")
def doc_chunks(spark, folder):
    return semantic.passages(documents(spark, folder))


_VALID = """valid as (
      select passage_id, doc_id, passage, list_transform(embedding, lambda x: x::double) as e from passages
      where embedding is not null and len(embedding) = 64 and not isnan(list_sum(list_transform(embedding, lambda x: x::double)))),
    unit as (select passage_id, doc_id, passage, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) as u from valid where list_dot_product(e, e) > 0),
    q as (select u as qu from unit order by passage_id limit 1),
    sims as (select passage_id, doc_id, passage, list_dot_product(u, qu) as sim from unit, q)"""


def _unit(spark, folder) -> DataFrame:
    rows = table(spark, folder, "passages")
    e = F.col("embedding")
    ok = (F.size(e) == 64) & ~F.exists(e, lambda x: x.isNull() | F.isnan(x))
    return rows.where(e.isNotNull()).where(ok).where(vectors.dot(e, e) > 0).select("passage_id", "doc_id", "passage", vectors.normalize(e).alias("embedding"))


def _query_vector(rows: DataFrame) -> list[float]:
    return rows.orderBy("passage_id").select("embedding").first()[0]


@query(f"with {_VALID} select passage_id, round(list_aggregate(list_transform(u, lambda x: abs(x)), 'sum'), 6) as l1, round(u[1], 6) as first, round(u[64], 6) as last from unit")
def vec_normalize(spark, folder):
    u = F.col("embedding")
    return _unit(spark, folder).select(
        "passage_id", F.round(F.aggregate(u, F.lit(0.0), lambda s, x: s + F.abs(x)), 6).alias("l1"), F.round(u[0], 6).alias("first"), F.round(u[63], 6).alias("last")
    )


@query(f"with {_VALID} select passage_id, round(sim, 6) as sim from sims order by sim desc, passage_id limit 10")
def cosine_topk(spark, folder):
    rows = _unit(spark, folder)
    return semantic.similarities(rows, _query_vector(rows)).select("passage_id", F.round("sim", 6).alias("sim")).orderBy(F.desc("sim"), "passage_id").limit(10)


@query(f"""with {_VALID}, pairs as (
      select a.passage_id as query_id, b.passage_id, round(list_dot_product(a.u, b.u), 6) as sim from unit a join unit b on a.passage_id % 100 = 0 and a.passage_id <> b.passage_id)
    select query_id, passage_id, sim, place from (select *, row_number() over (partition by query_id order by sim desc, passage_id)::int as place from pairs) where place <= 5""")
def cosine_each(spark, folder):
    """The five most similar of all passages for every passage whose id is divisible by 100."""
    rows = _unit(spark, folder)
    return semantic.nearest_to_each(rows, rows.where("passage_id % 100 = 0").select(F.col("passage_id").alias("query_id"), "embedding"), "passage_id", 5)


@query(f"""with {_VALID}, best as (select *, row_number() over (partition by doc_id order by sim desc, passage_id) as place from sims where doc_id is not null)
    select doc_id, round(sim, 6) as score, substr(passage, 1, 240) as snippet from best where place = 1""")
def semantic_rank(spark, folder):
    rows = _unit(spark, folder)
    return _rounded(semantic.semantic_rank(rows.where("doc_id is not null"), _query_vector(rows)))


_FUSED = f"""with {_DOCS}, {_VALID},
    kw as (select doc_id, row_number() over (order by round(score, 6) desc, doc_id) as r from {_scores(_BM25, "'buffer', 'queue'")}),
    sem as (select doc_id, row_number() over (order by round(s, 6) desc, doc_id) as r from (select doc_id, max(sim) as s from sims where doc_id is not null group by doc_id)),
    both_ as (select doc_id, round(sum(1.0 / (60 + r)), 9) as score from (select * from kw union all select * from sem) group by doc_id)"""


class _Given:
    """An encoder that gives one vector, for passages whose vectors come with the data."""

    def __init__(self, vector: list[float]):
        self.vector = vector

    def encode(self, texts: list[str]) -> np.ndarray:
        return np.array([self.vector] * len(texts))


def _semantic(spark, folder) -> tuple[semantic.SemanticIndex, _Given]:
    rows = _unit(spark, folder)
    return semantic.SemanticIndex(rows.where("doc_id is not null"), ""), _Given(_query_vector(rows))


@query(f"{_FUSED} select doc_id, score from both_")
def hybrid_rrf(spark, folder):
    known, encoder = _semantic(spark, folder)
    fused = semantic.ranking_of(saved_index(spark, folder), "buffer queue", mode="hybrid", semantic=known, encoder=encoder, digits=6)
    return fused.select("doc_id", F.round("score", 9).alias("score"))


@query(f"""{_FUSED} select rank, doc_id, score, title, path from (select *, row_number() over (order by score desc, doc_id)::int as rank from both_) join docs_ using (doc_id)
    where rank <= 10""")
def retrieve_hybrid(spark, folder):
    known, encoder = _semantic(spark, folder)
    found = semantic.retrieve(saved_index(spark, folder), "buffer queue", k=10, mode="hybrid", semantic=known, encoder=encoder, digits=6)
    return found.select("rank", "doc_id", "score", "title", "path")


@query(f"""with {_DOCS}, {_VALID}, best as (select doc_id, round(max(sim), 9) as score from sims where doc_id is not null group by doc_id)
    select rank, doc_id, score, title, path from (select *, row_number() over (order by score desc, doc_id)::int as rank from best) join docs_ using (doc_id) where rank <= 10""")
def retrieve_semantic(spark, folder):
    known, encoder = _semantic(spark, folder)
    found = semantic.retrieve(saved_index(spark, folder), "buffer queue", k=10, mode="semantic", semantic=known, encoder=encoder, digits=6)
    return found.select("rank", "doc_id", "score", "title", "path")


# pages ---------------------------------------------------------------------------------------------------------------

_CANONICAL = r"""(case when regexp_matches(trim(url), '^(?i)https?://[^/?#@\\]+') then
      lower(regexp_extract(trim(url), '^([^:]+)://', 1)) || '://' || regexp_replace(lower(regexp_extract(trim(url), '://([^/?#]+)', 1)), case when lower(trim(url)) like 'https%' then ':443$' else ':80$' end, '')
      || coalesce(nullif(regexp_replace(regexp_extract(trim(url), '://[^/?#]+([^?#]*)', 1), '/+$', ''), ''), '/')
      || case when regexp_extract(trim(url), '\?([^#]*)', 1) <> '' then '?' || array_to_string(list_sort(string_split(regexp_extract(trim(url), '\?([^#]*)', 1), '&')), '&') else '' end end)"""


@query(f"select page_id, {_CANONICAL} as url from pages")
def url_canonical(spark, folder):
    return table(spark, folder, "pages").select("page_id", web.canonical_url("url").alias("url"))


@query(r"select page_id, regexp_extract(url, '^([^:/?#]+)://', 1) || '://' || regexp_extract(url, '://([^/?#]*)', 1) as origin from pages")
def url_origin(spark, folder):
    return table(spark, folder, "pages").select("page_id", web.origin(F.col("url")).alias("origin"))


@query(f"select {_CANONICAL} as url, min(page_id) as page_id, count(*) as fetched from pages group by 1 having url is not null")
def pages_dedup(spark, folder):
    rows = table(spark, folder, "pages").select("page_id", web.canonical_url("url").alias("url")).where("url is not null")
    return rows.groupBy("url").agg(F.min("page_id").alias("page_id"), F.count("*").alias("fetched"))


def _html(rows: DataFrame) -> DataFrame:
    safe = lambda c: F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    page = F.concat(
        F.lit("<html><head><title>"), safe(F.col("title")), F.lit("</title><script>let x = '<p>';</script></head><body><p>"),
        F.regexp_replace(safe(F.col("text")), "\n", "</p>\n<p>"), F.lit("</p><a href='"), F.coalesce("url", F.lit("")), F.lit("'></a></body></html>"),
    )
    return rows.select("page_id", page.alias("html"))


_SPACE = r"trim(regexp_replace({0}, '[\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}]+', ' ', 'g'))"


@query(f"select page_id, {_SPACE.format('coalesce(title, chr(32))')} as title, {_SPACE.format('coalesce(title, chr(32)) || chr(32) || coalesce(text, chr(32))')} as text, coalesce(nullif(url, ''), '-') as link from pages")
def html_extract(spark, folder):
    """Pages wrapped in HTML with a script, entities and a link, and read back."""
    parts = _html(table(spark, folder, "pages")).select("page_id", web.parse_html("html").alias("p"))
    return parts.select("page_id", "p.title", "p.text", F.coalesce(F.get("p.links", F.lit(0)), F.lit("-")).alias("link"))


# streaming -----------------------------------------------------------------------------------------------------------


@query(f"with {_DOCS} select term, df::bigint as df from freq")
def stream_term_df(spark, folder):
    """Documents as a stream of files, indexed batch by batch, then counted. Every third page arrives three times under
    other spellings of its address, at first with other text; each counts once, with its last text."""
    source, target, state = (scratch_path(spark, n) for n in ("stream-in", "stream-index", "stream-state"))
    number = F.col("doc_id").cast("string")
    text = F.coalesce("text", F.lit(""))
    page = lambda url, body, at: [url.alias("url"), F.coalesce("title", F.lit("")).alias("title"), body.alias("text"), F.lit(at).alias("fetched_at")]
    docs = documents(spark, folder)
    again = docs.where("doc_id % 3 = 0")
    old = again.select(*page(F.concat(F.lit("HTTPS://Docs.Example:443/"), number, F.lit("/")), F.concat(F.lit("superseded "), text), "2025-01-01"))
    old.unionByName(again.select(*page(F.concat(F.lit("https://docs.example/"), number, F.lit("#top")), F.lit("superseded twice"), "2025-01-02"))).repartition(2).write.json(source)
    ingest.start_indexing(ingest.read_pages(spark, source, files_per_batch=1), target, state, positions=False).awaitTermination()
    docs.select(*page(F.concat(F.lit("https://docs.example/"), number), text, "2025-01-03")).repartition(4).write.mode("append").json(source)
    ingest.start_indexing(ingest.read_pages(spark, source, files_per_batch=2), target, state, positions=False).awaitTermination()
    return ix.document_frequency(ingest.load_stream(spark, target).postings)
