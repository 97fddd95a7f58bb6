"""Scorers as Column expressions, so whole rankings stay in generated code."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from operator import add
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.operators.index import Index, document_frequency


class Scorer(Protocol):
    """Any object with ``part``: what one term adds to a document's score, from Columns of doubles."""

    def part(self, tf: Column, df: Column, length: Column, n_docs: Column, average: Column) -> Column: ...


@dataclass(frozen=True)
class BM25:
    """Saturating term frequency with document length normalisation."""

    k1: float = 1.5
    b: float = 0.75

    def __post_init__(self):
        if not (math.isfinite(self.k1) and self.k1 > 0 and math.isfinite(self.b) and 0 <= self.b <= 1):
            raise ValueError("k1 must be finite and above 0, b within 0 and 1")

    def part(self, tf, df, length, n_docs, average):
        idf = F.log1p((n_docs - df + 0.5) / (df + 0.5))
        return idf * tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * length / average))


@dataclass(frozen=True)
class TfIdf:
    """Logarithmic term frequency times inverse document frequency, whatever the length."""

    def part(self, tf, df, length, n_docs, average):
        return (1 + F.ln(tf)) * F.log1p(n_docs / df)


def in_order(parts: list[Column]) -> Column:
    """The sum of parts in the order given: equal documents get equal scores, bit for bit."""
    return reduce(add, parts, F.lit(0.0))


def term_scores(index: Index, scorer: Scorer, terms: list[str] | None = None) -> DataFrame:
    """``(term, doc_id, score)`` of every posting, or of the postings of some terms."""
    postings = index.postings if terms is None else index.postings.where(F.col("term").isin(terms))
    df = document_frequency(postings)
    stats = index.docs.agg(F.count("*").cast("double").alias("n_docs"), F.coalesce(F.avg("length"), F.lit(0.0)).alias("average"))
    rows = postings.select("term", "doc_id", "tf").join(df, "term").join(index.docs.select("doc_id", "length"), "doc_id").crossJoin(F.broadcast(stats))
    d = lambda c: F.col(c).cast("double")
    return rows.select("term", "doc_id", scorer.part(d("tf"), d("df"), d("length"), d("n_docs"), d("average")).alias("score"))


def document_scores(index: Index, scorer: Scorer, terms: list[str]) -> DataFrame:
    """``(doc_id, score)``: every document with any of the terms, parts added in order of terms."""
    parts = term_scores(index, scorer, terms).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("term", "score"))).alias("parts"))
    return parts.select("doc_id", F.aggregate("parts", F.lit(0.0), lambda s, x: s + x["score"]).alias("score"))
