"""Boolean matching, ranked keyword search with snippets, paging."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from loomtext.functions.snippets import with_snippets
from loomtext.functions.text import title_or_stem, tokens
from loomtext.operators.index import Index
from loomtext.operators.scoring import BM25, Scorer, in_order
from loomtext.plans.query import And, Not, Or, Phrase, Query, Term, parse, parse_left_to_right
from loomtext.scratch import written


#: The most results that are shown at once, with titles and snippets; whole rankings have no limit.
MOST_K = 1_000_000


def check_k(k: int) -> int:
    """``k`` if it is a whole number from 0 to :data:`MOST_K` (a Boolean is none), else a ``ValueError``."""
    if type(k) is not int or not 0 <= k <= MOST_K:
        raise ValueError(f"k must be a whole number from 0 to {MOST_K}")
    return k


@dataclass(frozen=True)
class _View:
    """One row a document: ``doc_id``, ``length`` and for the i-th of ``terms`` its ``tf{i}`` (null if absent) and ``pos{i}``."""

    rows: DataFrame
    terms: list[str]

    def has(self, term: str) -> Column:
        return F.col(f"tf{self.terms.index(term)}").isNotNull()

    def places(self, term: str) -> Column:
        return F.coalesce(F.col(f"pos{self.terms.index(term)}"), F.array().cast("array<int>"))


def _view_of_index(index: Index, query: Query) -> _View:
    """One shuffle whatever the query: postings of its terms, gathered per document. Documents without any of them are
    looked at only if they can match."""
    terms = sorted(query.all_terms())
    phrases = query.phrase_terms()
    if phrases and not index.has_positions:
        raise ValueError("phrases need an index with positions")
    columns = []
    for i, t in enumerate(terms):
        columns.append(F.max(F.when(F.col("term") == t, F.col("tf"))).alias(f"tf{i}"))
        if t in phrases:
            columns.append(F.first(F.when(F.col("term") == t, F.col("positions")), ignorenulls=True).alias(f"pos{i}"))
    found = index.postings.where(F.col("term").isin(terms)).groupBy("doc_id").agg(*columns)
    how = "left" if query.matches_nothing_present() else "inner"
    return _View(index.docs.select("doc_id", "length").join(found, "doc_id", how), terms)


def _of_term(term: str) -> Column:
    return F.filter("_hits", lambda s: s["x"] == term)


def _view_of_documents(documents: DataFrame, query: Query) -> _View:
    """Straight from the texts, without an index and without a shuffle."""
    terms = sorted(query.all_terms())
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), tokens(F.col("text")).alias("_tokens"))
    wanted = F.transform("_tokens", lambda x, i: F.struct(i.cast("int").alias("i"), x.alias("x")))
    kept = rows.select("doc_id", F.size("_tokens").alias("length"), F.filter(wanted, lambda s: s["x"].isin(terms)).alias("_hits"))
    columns: list[Column] = []
    phrases = query.phrase_terms()
    for i, t in enumerate(terms):
        hits = _of_term(t)
        columns.append(F.nullif(F.size(hits), F.lit(0)).alias(f"tf{i}"))
        if t in phrases:
            columns.append(F.transform(hits, lambda s: s["i"]).alias(f"pos{i}"))
    return _View(kept.select("doc_id", "length", *columns), terms)


def _matching(view: _View, query: Query) -> DataFrame:
    return view.rows.where(query.column(view.has, view.places))


def _as_query(query: Query | str) -> Query:
    return parse(query) if isinstance(query, str) else query


def matched(index: Index, query: Query | str) -> DataFrame:
    """``(doc_id)`` of the documents that match."""
    query = _as_query(query)
    return _matching(_view_of_index(index, query), query).select("doc_id")


def matched_documents(documents: DataFrame, query: Query | str) -> DataFrame:
    """:func:`matched` for documents without an index: one pass over the texts, no shuffle."""
    query = _as_query(query)
    return _matching(_view_of_documents(documents, query), query).select("doc_id")


def matched_by_sets(index: Index, query: Query | str) -> DataFrame:
    """:func:`matched` by set algebra on document ids; a second lowering for tests and very selective queries."""
    query = _as_query(query)
    everything = index.docs.select("doc_id")

    def ids(q: Query) -> DataFrame:
        if isinstance(q, Term):
            return index.postings.where(F.col("term") == q.value).select("doc_id")
        if isinstance(q, Phrase):
            return _matching(_view_of_index(index, q), q).select("doc_id")
        if isinstance(q, And):
            return ids(q.left).join(ids(q.right), "doc_id", "left_semi")
        if isinstance(q, Or):
            return ids(q.left).union(ids(q.right)).distinct()
        if isinstance(q, Not):
            return everything.join(ids(q.child), "doc_id", "left_anti")
        raise TypeError(type(q).__name__)

    return ids(query)


def boolean_search(index: Index, query: str, engine: str = "columns") -> DataFrame:
    """``(doc_id)`` for the left-to-right dialect, in ascending order; ``engine`` is ``columns`` or ``sets``."""
    tree = parse_left_to_right(query)
    if engine not in ("columns", "sets"):
        raise ValueError("engine is columns or sets")
    return (matched if engine == "columns" else matched_by_sets)(index, tree).orderBy("doc_id")


def _scored(view: _View, query: Query, scorer: Scorer, statistics: Callable[[str], Column], rows: DataFrame) -> DataFrame:
    """``(doc_id, score)`` of ``rows`` of a view that match: the sum over positive terms, in code point order, of those a
    document has. ``statistics`` gives ``n_docs``, ``average`` and of the i-th term ``df{i}``."""
    part = lambda i: F.coalesce(
        scorer.part(F.col(f"tf{i}").cast("double"), statistics(f"df{i}"), F.col("length").cast("double"), statistics("n_docs"), statistics("average")), F.lit(0.0)
    )
    return rows.select("doc_id", in_order([part(view.terms.index(t)) for t in sorted(query.terms())]).alias("score"))


def _whole() -> list[Column]:
    return [F.count("*").cast("double").alias("n_docs"), F.coalesce(F.avg("length"), F.lit(0.0)).alias("average")]


def rank(index: Index, query: Query | str, scorer: Scorer | None = None) -> DataFrame:
    """``(doc_id, score)`` of every match."""
    query = _as_query(query)
    view = _view_of_index(index, query)
    counts = [F.count_if(F.col("term") == t).cast("double").alias(f"df{i}") for i, t in enumerate(view.terms)]
    frequency = index.postings.where(F.col("term").isin(view.terms)).agg(*counts)
    whole = F.broadcast(index.docs.agg(*_whole()).crossJoin(frequency))
    return _scored(view, query, scorer or BM25(), F.col, _matching(view, query).crossJoin(whole))


def rank_documents(documents: DataFrame, query: Query | str, scorer: Scorer | None = None) -> DataFrame:
    """:func:`rank` for a single query over documents that have no index: one pass over the texts, no shuffle of them.

    The pass runs at once: it writes the matching rows, a few numbers each, and observes the statistics of all rows on
    the way, so that nothing is tokenised twice.
    """
    query = _as_query(query)
    view = _view_of_documents(documents, query)
    seen = Observation()
    counts = [F.count(f"tf{i}").cast("double").alias(f"df{i}") for i in range(len(view.terms))]
    rows = written(_View(view.rows.observe(seen, *_whole(), *counts), view.terms).rows.where(query.column(view.has, view.places)), "ranking-rows")
    whole = seen.get
    return _scored(view, query, scorer or BM25(), lambda name: F.lit(whole[name]), rows)


def best(ranking: DataFrame, k: int, digits: int | None = None) -> DataFrame:
    """The first ``k`` by score descending, then ``doc_id``, with their ``rank`` from 1."""
    score = F.col("score") if digits is None else F.round("score", digits)
    top = ranking.withColumn("score", score).orderBy(F.desc("score"), "doc_id").limit(check_k(k))
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")))


def _ranking(source: Index | DataFrame, query: Query, scorer: Scorer | None) -> DataFrame:
    return rank(source, query, scorer) if isinstance(source, Index) else rank_documents(source, query, scorer)


def search(source: Index | DataFrame, query: Query | str, scorer: Scorer | None = None, k: int = 10, digits: int | None = None) -> DataFrame:
    """``(rank, doc_id, score, title, path, snippet)`` of the ``k`` best matches in an index, or in documents
    ``(doc_id, path, title, text)`` that have none. Snippets are cut for those only."""
    query = _as_query(query)
    docs = source.docs if isinstance(source, Index) else source
    return shown(best(_ranking(source, query, scorer), k, digits), docs, query)


def shown(top: DataFrame, docs: DataFrame, query: Query) -> DataFrame:
    """``top`` with title (or the file's name), path and snippet; it has at most :data:`MOST_K` rows, which bounds its broadcast."""
    rows = docs.select("doc_id", title_or_stem(F.col("title"), F.col("path")).alias("title"), "path", "text").join(F.broadcast(top), "doc_id")
    return with_snippets(rows, query.terms()).select("rank", "doc_id", "score", "title", "path", "snippet")


def search_page(source: Index | DataFrame, query: Query | str, scorer: Scorer | None = None, k: int = 10, page: int = 1, digits: int | None = None) -> DataFrame:
    """``(total, pages, rank, doc_id, score)``: one page of the ranking; a page past the end is one row with null ``doc_id``."""
    if type(page) is not int or page < 1 or check_k(k) < 1:
        raise ValueError("page and k must be at least 1")
    ranking = written(_ranking(source, _as_query(query), scorer), "page-ranking")
    total = ranking.agg(F.count("*").alias("total")).withColumn("pages", F.ceil(F.col("total") / F.lit(k)))
    rows = best(ranking, k * page, digits).where(F.col("rank") > k * (page - 1))
    return total.join(rows, F.lit(True), "left").select("total", "pages", "rank", "doc_id", "score")


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """Ids in both."""
    return a.select("doc_id").intersect(b.select("doc_id"))


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Ids in either, once."""
    return a.select("doc_id").union(b.select("doc_id")).distinct()


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Ids in the first but not the second."""
    return a.select("doc_id").subtract(b.select("doc_id"))
