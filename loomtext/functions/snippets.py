"""Snippets around the best window of hits, and their highlighting.

A text's hits are found by one pass; the best window is chosen by ranking all hits at once, so a snippet of a row and
the windows of a whole table (:func:`best_windows`) follow one definition.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.functions.text import APOSTROPHES, py_tokens

_QUOTES = "'" + APOSTROPHES
_COMBINING = "".join(c for c in map(chr, (*range(0x300, 0x20000), *range(0xE0100, 0xE01F0))) if unicodedata.category(c)[0] == "M")
#: Whatever ends a word: all but letters, digits, combining marks and apostrophes. Combining marks are no ``\\w``.
_GAP = re.compile(rf"[^\w{_QUOTES}{_COMBINING}]+|_+")


def normalized_word(word: str) -> str | None:
    """The one token a word is, or None."""
    tokens = py_tokens(word)
    return tokens[0] if len(tokens) == 1 else None


def matching_spans(text: str, terms: Iterable[str]) -> list[tuple[int, int, str]]:
    """``(begin, end, term)`` of every word of the original text that is one of the terms."""
    wanted, spans, at = frozenset(terms), [], 0
    known: dict[str, str | None] = {}
    for gap in [*(m.span() for m in _GAP.finditer(text)), (len(text), len(text))]:
        word = text[at : gap[0]]
        bare = word.strip(_QUOTES)
        if bare and bare not in known:
            known[bare] = normalized_word(bare)
        if bare and (term := known[bare]) in wanted:
            begin = at + len(word) - len(word.lstrip(_QUOTES))
            spans.append((begin, begin + len(bare), term))
        at = gap[1]
    return spans


def best_hit(hits: list[tuple[int, int, str]], radius: int) -> int:
    """Place of the hit around which most distinct terms, then most hits, begin within ``radius``; of equal ones the first."""
    begins = np.array([h[0] for h in hits])
    low, high = np.searchsorted(begins, begins - radius, "left"), np.searchsorted(begins, begins + radius, "right")
    distinct = np.zeros(len(hits), dtype=np.int64)
    for term in {h[2] for h in hits}:
        upto = np.concatenate([[0], np.cumsum([h[2] == term for h in hits])])
        distinct += upto[high] > upto[low]
    return int(np.argmax(distinct * (len(hits) + 1) + (high - low)))


def snippet(text: str, terms: Iterable[str], radius: int = 80) -> str:
    """The part of a text with the most distinct terms, then the most hits, within ``radius`` of a hit; hits in brackets.

    Without hits the first ``2 * radius`` characters. ``…`` marks where the text goes on; line breaks become spaces.
    """
    hits = matching_spans(text, terms)
    if hits:
        begin, end, _ = hits[best_hit(hits, radius)]
        window = slice(max(begin - radius, 0), min(max(end, begin + radius), len(text)))
    else:
        window = slice(0, min(2 * radius, len(text)))
    inside = [h for h in hits if window.start <= h[0] and h[1] <= window.stop]
    edges = [window.start, *(e for h in inside for e in h[:2]), window.stop]
    # parts between edges are outside and inside a hit by turns
    parts = [text[a:b] for a, b in zip(edges, edges[1:])]
    body = "".join(f"[{p}]" if i % 2 else p for i, p in enumerate(parts))
    return ("…" * (window.start > 0) + body + "…" * (window.stop < len(text))).replace("\n", " ")


def with_snippets(rows: DataFrame, terms: set[str], text: str = "text") -> DataFrame:
    """``rows`` with a column ``snippet``; meant for the few rows left after a limit. A null text gives an empty snippet."""
    wanted = frozenset(terms)

    @F.pandas_udf("string")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: "" if t is None else snippet(t, wanted))

    return rows.withColumn("snippet", cut(F.col(text)))


def best_windows(documents: DataFrame, terms: Iterable[str], radius: int = 80) -> DataFrame:
    """``(doc_id, start, distinct_terms, hits)`` of every document with a hit: where the window of its snippet begins to be
    looked for, and what lies around. Texts are read in their tasks, nothing is shuffled; a null text has no row."""
    wanted = frozenset(terms)

    @F.pandas_udf("struct<start: long, distinct_terms: int, hits: long>")
    def best(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            hits = matching_spans(text, wanted)
            if hits:
                at = hits[best_hit(hits, radius)][0]
                near = [t for b, _, t in hits if abs(b - at) <= radius]
            rows.append((at, len(set(near)), len(near)) if hits else (-1, 0, 0))
        return pd.DataFrame(rows, columns=["start", "distinct_terms", "hits"])

    return documents.where("text is not null").select("doc_id", best("text").alias("b")).where("b.start >= 0").select("doc_id", "b.*")


def window_of_hits(hits: DataFrame, radius: int = 80) -> DataFrame:
    """:func:`best_windows` from a table of hits ``(doc_id, begin, term)``, such as positions kept by an index."""
    near = Window.partitionBy("doc_id").orderBy("begin").rangeBetween(-radius, radius)
    windows = hits.select("doc_id", "begin", F.size(F.collect_set("term").over(near)).alias("distinct_terms"), F.count("*").over(near).alias("hits"))
    best = windows.groupBy("doc_id").agg(F.max(F.struct("distinct_terms", "hits", (-F.col("begin")).alias("minus"))).alias("b"))
    return best.select("doc_id", (-F.col("b.minus")).alias("start"), "b.distinct_terms", "b.hits")


def highlight(column: Column) -> Column:
    """HTML of a snippet: everything escaped, bracketed parts in ``<mark>``."""
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        column = F.replace(column, F.lit(raw), F.lit(safe))
    return F.regexp_replace(column, r"\[([^\[\]]+)\]", "<mark>$1</mark>")


def py_highlight(text: str, opening: str = "<mark>", closing: str = "</mark>", escape: bool = True) -> str:
    """:func:`highlight` of one string; with other marks and no escaping, for terminals."""
    safe = html.escape(text) if escape else text
    out, at = [], 0
    while (a := safe.find("[", at)) >= 0 and (b := safe.find("]", a)) >= 0:
        inner = safe.rfind("[", a, b)
        out += [safe[at:inner], *([opening, safe[inner + 1 : b], closing] if b > inner + 1 else ["[]"])]
        at = b + 1
    return "".join(out) + safe[at:]
