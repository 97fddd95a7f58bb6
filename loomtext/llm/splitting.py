"""Splitting of oversized texts at natural boundaries by agglomerative merging of atomic segments."""

from __future__ import annotations

import heapq
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Marks after which a text may be cut, beside white space.
MARKS = ".!?。！？।؟"

#: Boundaries from strong to weak: a cut is right after what matches. A weaker kind is looked for only in what is too long.
_KINDS = (
    re.compile(r"\n[^\S\n]*\n\s*"),
    re.compile(r"\n[^\S\n]*"),
    re.compile(r"[.!?]+[\"'”’»)\]]*(?=\s)\s*|[。！？।؟]+[」』”’»）]*\s*"),
    re.compile(r"\s+"),
    re.compile(rf"\s|[{re.escape(MARKS)}]"),
)


def _segments(text: str, start: int, stop: int, room: int, kind: int, out: list[tuple[int, int, int]]) -> None:
    """Append ``(start, end, strength)`` of segments of at most ``room``; strength is that of the boundary at the end, or
    where there is none, the length of the stretch that is cut, negated.

    Parts that fit are not cut at weaker boundaries: merging would join them again before any stronger boundary.
    """
    if stop - start <= room:
        out.append((start, stop, 0))
        return
    if kind == len(_KINDS):
        stretch = stop - start - bool(_KINDS[-1].match(text, stop - 1))
        while start + room < stop:
            out.append((start, start + room, -stretch))
            start += room
        out.append((start, stop, 0))
        return
    at = start
    for m in _KINDS[kind].finditer(text, start, stop):
        if at < m.end() < stop:
            _segments(text, at, m.end(), room, kind + 1, out)
            out[-1] = (*out[-1][:2], len(_KINDS) - kind)
            at = m.end()
    _segments(text, at, stop, room, kind + 1, out)


def _merge(segments: list[tuple[int, int, int]], room: int) -> list[tuple[int, int, int]]:
    """Join neighbours at the weakest boundary first, then the smallest and first, while they fit into ``room``."""
    n = len(segments)
    start, end, strength = ([s[i] for s in segments] for i in range(3))
    after, before, version = list(range(1, n + 1)), list(range(-1, n - 1)), [0] * n
    heap: list[tuple[int, int, int, int, int, int]] = []

    def push(i: int) -> None:
        j = after[i]
        if j < n and end[j] - start[i] <= room:
            heapq.heappush(heap, (strength[i], end[j] - start[i], i, j, version[i], version[j]))

    for i in range(n):
        push(i)
    gone = [False] * n
    while heap:
        _, _, i, j, vi, vj = heapq.heappop(heap)
        if gone[i] or gone[j] or version[i] != vi or version[j] != vj:
            continue
        end[i], strength[i], after[i], gone[j] = end[j], strength[j], after[j], True
        if after[j] < n:
            before[after[j]] = i
        version[i] += 1
        push(i)
        if before[i] >= 0:
            push(before[i])
    return [(start[i], end[i], strength[i]) for i in range(n) if not gone[i]]


def pieces(text: str, limit: int = 2000, overlap: int = 200) -> list[tuple[int, int, int]]:
    """``(start, end, stretch)`` of every piece.

    A piece has at most ``limit`` characters and begins ``overlap`` before the end of the one before. ``stretch`` is 0 for
    a piece that ends at a boundary (or with the text), else the length of the stretch without boundaries it ends in,
    which doesn't fit between overlap and limit. A text within the limit is one piece.
    """
    if len(text) <= limit:
        return [(0, len(text), 0)]
    room = limit - overlap
    segments: list[tuple[int, int, int]] = []
    _segments(text, 0, len(text), room, 0, segments)
    return [(max(0, a - overlap) if a else 0, b, max(0, -s)) for a, b, s in _merge(segments, room)]


def oversized(items: DataFrame, item: str, text: str, limit: int = 2000, overlap: int = 200) -> DataFrame:
    """``(item_id, cut, pieces, text)`` of every text over ``limit`` characters, ``pieces`` being an array of ``(start, end,
    stretch)`` as :func:`pieces` gives them.

    ``cut`` is ``forced`` if a piece ends in a stretch of more than ``limit`` characters without white space and without
    any of :data:`MARKS`, else ``boundary``. As pieces are no longer than the limit, every such stretch has a piece that ends in it. Positions are
    characters from 0. Null ids and texts, and texts within the limit, give no rows; a repeated id gives a row for each of
    its texts; other columns are ignored; an empty table gives no rows. Texts are read whole; only those over the limit
    leave the JVM, and none of them comes back.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than the limit")

    @F.pandas_udf("array<struct<start: int, end: int, stretch: int>>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"start": a, "end": b, "stretch": s} for a, b, s in pieces(t, limit, overlap)])

    long = items.select(F.col(item).cast("long").alias("item_id"), F.col(text).alias("text")).where("item_id is not null").where(F.length("text") > limit)
    kind = F.when(F.exists("pieces", lambda p: p["stretch"] > limit), "forced").otherwise("boundary")
    return long.select("item_id", "text", cut("text").alias("pieces")).select("item_id", kind.alias("cut"), "pieces", "text")


def split_oversized(items: DataFrame, item: str, text: str, limit: int = 2000, overlap: int = 200) -> DataFrame:
    """``(item_id, piece_no, start, end, natural, cut, piece)``: the pieces of :func:`oversized`, a row each, with their
    text; ``natural`` tells whether a piece ends at a boundary or with the text."""
    each = oversized(items, item, text, limit, overlap).select("item_id", "cut", "text", F.posexplode("pieces").alias("piece_no", "p"))
    part = F.substring("text", F.col("p.start") + 1, F.col("p.end") - F.col("p.start"))
    return each.select("item_id", "piece_no", "p.start", "p.end", (F.col("p.stretch") == 0).alias("natural"), "cut", part.alias("piece"))
