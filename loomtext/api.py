"""What a search service does between its HTTP layer and the engine: checked parameters, pages of results, lookups."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import functions as F

from loomtext.functions.snippets import py_highlight
from loomtext.operators.index import Index, corpus_stats, top_terms
from loomtext.operators.scoring import BM25, TfIdf
from loomtext.operators.search import best
from loomtext.operators.semantic import Encoder, SemanticIndex, ranking_of, with_titles
from loomtext.scratch import written
from loomtext.timing import timed

#: Limits of the parameters.
MOST_QUERY, MOST_K, MOST_PAGE = 300, 100, 10_000
SCORERS = {"bm25": BM25, "tfidf": TfIdf}
MODES = ("keyword", "semantic", "hybrid")


@dataclass(frozen=True)
class SearchParams:
    """Parameters of a search; anything out of bounds is a ``ValueError``."""

    q: str
    k: int = 10
    page: int = 1
    scorer: str = "bm25"
    mode: str = "keyword"

    def __post_init__(self):
        if not isinstance(self.q, str) or not self.q.strip() or len(self.q) > MOST_QUERY:
            raise ValueError(f"q must be 1 to {MOST_QUERY} characters and not blank")
        for name, most in (("k", MOST_K), ("page", MOST_PAGE)):
            value = getattr(self, name)
            if type(value) is not int or not 1 <= value <= most:
                raise ValueError(f"{name} must be a whole number from 1 to {most}")
        if self.scorer not in SCORERS or self.mode not in MODES:
            raise ValueError(f"scorer is one of {', '.join(SCORERS)}, mode one of {', '.join(MODES)}")

    @classmethod
    def read(cls, raw: dict[str, str]) -> SearchParams:
        """From the strings of a request; unknown names are refused."""
        if unknown := set(raw) - set(cls.__dataclass_fields__):
            raise ValueError(f"unknown parameters: {', '.join(sorted(unknown))}")
        if "q" not in raw:
            raise ValueError("q is missing")
        return cls(**{n: int(v) if n in ("k", "page") else v for n, v in raw.items()})


@dataclass(frozen=True)
class SearchResponse:
    total: int
    pages: int
    page: int
    results: list[dict[str, Any]] = field(default_factory=list)


@timed
def execute_search(index: Index, params: SearchParams, semantic: SemanticIndex | None = None, encoder: Encoder | None = None) -> SearchResponse:
    """One page. Past the last page there are no results, but the total stays.

    The ranking is written once, for the total and the page; texts are read for the rows of the page only. The total counts
    what the mode finds: matches, documents with passages, or in hybrid mode either.
    """
    ranking = written(ranking_of(index, params.q, SCORERS[params.scorer](), params.mode, semantic, encoder), "service-ranking")
    total = ranking.count()
    top = best(ranking, params.k * params.page).where(F.col("rank") > params.k * (params.page - 1))
    rows = with_titles(top, index, params.q, params.mode)
    found = [{**r.asDict(), "html": py_highlight(r.snippet)} for r in rows.orderBy("rank").collect()]
    return SearchResponse(total, -(-total // params.k), params.page, found)


def document(index: Index, doc_id: int) -> dict[str, Any]:
    """A document by id; an unknown one is a ``LookupError``."""
    row = index.document(doc_id).first()
    if row is None:
        raise LookupError(f"no document {doc_id}")
    return row.asDict()


def stats(index: Index, top: int = 50) -> dict[str, Any]:
    """Sizes of the index and its most frequent terms."""
    return {**corpus_stats(index).first().asDict(), "top": [(r.term, r.cf) for r in top_terms(index.postings, top).orderBy(F.desc("cf"), "term").collect()]}


def health(index: Index | None) -> dict[str, Any]:
    """Whether an index is there to be searched."""
    return {"status": "ok" if index is not None else "unavailable", "documents": index.docs.count() if index is not None else 0}
