"""Evaluation texts inside training texts, by a generalised suffix automaton of the items' words.

The automaton accepts every run of words of every item. A document's words are read through it once; at every word it
knows the longest run ending there that some item holds, and from the run's state the items that hold it.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.functions.text import APOSTROPHES, py_tokens, tokens
from loomtext.scratch import written

#: Words of items in one automaton, on average: about 60 MB in a worker. More items are more blocks.
BLOCK_WORDS = 200_000
#: Bits of the filter, of which a run of words sets three: 16 MB on the driver and in every worker, whatever the data.
FILTER_BITS = 27
#: Characters of documents that one building of an automaton serves, on average.
SLICE_CHARACTERS = 4_000_000
_SURFACE = re.compile(rf"[^\W_]+(?:['{APOSTROPHES}][^\W_]+)*")


class SuffixAutomaton:
    """All runs of words of several sequences; ``holders[s]`` are the items whose runs of ``least`` words end in state s."""

    def __init__(self, items: list[tuple[int, list[int]]], least: int):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.least = [-1], [0], least
        for _, words in items:
            self._add(words)
        # the highest state on the way to the root whose runs still have ``least`` words stands for that run
        self.top = [0] * len(self.link)
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            if self.length[s] >= least:
                self.top[s] = s if self.length[self.link[s]] < least else self.top[self.link[s]]
        self.holders: dict[int, set[int]] = {}
        for item, words in items:
            s = 0
            for word in words:
                s = self.next[s][word]
                if t := self.top[s]:
                    self.holders.setdefault(t, set()).add(item)
        self.items = {s: tuple(sorted(h)) for s, h in self.holders.items()}

    def _state(self, length: int, link: int, following: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(following)
        return len(self.length) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        """A state for the runs of q that are no longer than one more than those of p."""
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def _add(self, words: list[int]) -> None:
        """Add a sequence, starting from the root again."""
        last = 0
        for word in words:
            q = self.next[last].get(word)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, word, q)
                continue
            new, p = self._state(self.length[last] + 1, 0, {}), last
            while p >= 0 and word not in self.next[p]:
                self.next[p][word] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][word]
                self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
            last = new

    def runs(self, words: list[int | None]) -> Iterator[tuple[int, int, int]]:
        """``(place, longest, state)`` of each word at which a run of at least ``least`` words of some item ends."""
        follow, link, length, top, least = self.next, self.link, self.length, self.top, self.least
        state = run = 0
        for place, word in enumerate(words):
            if word is None:
                state = run = 0
                continue
            to = follow[state].get(word)
            while to is None and state:
                state = link[state]
                run = length[state]
                to = follow[state].get(word)
            if to is None:
                continue
            state, run = to, run + 1
            if run >= least:
                yield place, run, top[state]


def _automaton(items: list[tuple[int, list[str]]], least: int) -> tuple[SuffixAutomaton, dict[str, int]]:
    ids: dict[str, int] = {}
    coded = [(item, [ids.setdefault(w, len(ids)) for w in words]) for item, words in items]
    return SuffixAutomaton(coded, least), ids


def _reader(ids: dict[str, int]) -> Callable[[str], list[list[int | None]]]:
    """Words of a text as ids, None for words of no item; one entry for each stretch of letters, digits and apostrophes."""
    known: dict[str, list[int | None]] = {}

    def read(text: str) -> list[list[int | None]]:
        out = []
        for w in _SURFACE.findall(text):
            v = known.get(w)
            if v is None:
                v = [ids.get(t) for t in py_tokens(w)]
                if len(known) < 500_000:
                    known[w] = v
            out.append(v)
        return out

    return read


def _spans(auto: SuffixAutomaton, words: list[int | None]) -> dict[int, list[tuple[int, int]]]:
    """Of each item the maximal spans ``(first, last)`` of the document's words covered by its runs of ``least`` words."""
    out: dict[int, list[tuple[int, int]]] = {}
    for place, _, state in auto.runs(words):
        for item in auto.items.get(state, ()):
            spans = out.setdefault(item, [])
            first = place - auto.least + 1
            if spans and spans[-1][1] >= first - 1:
                spans[-1] = (spans[-1][0], place)
            else:
                spans.append((first, place))
    return out


_ODD = np.uint64(0x9E3779B97F4A7C15)


class _Runs:
    """Hashes of all runs of ``least`` words of a text, and their places in a filter of 2**FILTER_BITS bits."""

    def __init__(self, least: int):
        self.least, self.known = least, {}

    def words(self, text: str) -> np.ndarray:
        """One 64-bit hash a word."""
        out: list[int] = []
        for w in _SURFACE.findall(unicodedata.normalize("NFC", text)):
            v = self.known.get(w)
            if v is None:
                v = [int.from_bytes(hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") for t in py_tokens(w)]
                if len(self.known) < 500_000:
                    self.known[w] = v
            out += v
        return np.array(out, dtype=np.uint64)

    def hashes(self, text: str) -> np.ndarray:
        words = self.words(text)
        n = len(words) - self.least + 1
        if n < 1:
            return words[:0]
        run = np.zeros(n, dtype=np.uint64)
        for i in range(self.least):
            run = run * _ODD + words[i : i + n]
        run ^= run >> np.uint64(29)
        return run * _ODD

    @staticmethod
    def places(runs: np.ndarray) -> np.ndarray:
        shifts = np.array([[64 - FILTER_BITS], [64 - FILTER_BITS - 18], [64 - FILTER_BITS - 37]], dtype=np.uint64)
        return (runs[None, :] >> shifts) & np.uint64((1 << FILTER_BITS) - 1)


def _item_blocks(items: DataFrame, least: int) -> tuple[DataFrame, int]:
    """The items with at least ``least`` words, written, each with its block of about :data:`BLOCK_WORDS` words; and the number of blocks."""
    words = F.size(tokens(F.col("text")))
    rows = items.where("item_id is not null and text is not null").select("item_id", "text", words.alias("words")).where(F.col("words") >= least)
    rows = written(rows, "leak-items")
    total = rows.agg(F.sum("words")).first()[0] or 0
    blocks = -(-total // BLOCK_WORDS)
    return rows.select("item_id", "text", F.pmod(F.xxhash64("item_id"), F.lit(max(1, blocks))).cast("int").alias("block")), blocks


def _filter_of(runs: DataFrame) -> np.ndarray:
    """The filter that all ``run`` hashes set: built in the tasks, merged by exclusive ranges, of a fixed size on the driver."""

    def bits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            places = np.unique(_Runs.places(pdf["run"].to_numpy().astype(np.uint64)))
            of = pd.DataFrame({"at": (places >> np.uint64(6)).astype(np.int64), "bit": np.uint64(1) << (places & np.uint64(63))})
            yield of.groupby("at").agg(bits=("bit", "sum")).reset_index().assign(bits=lambda d: d["bits"].astype(np.uint64).astype(np.int64))

    merged = runs.mapInPandas(bits, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), dtype=np.int64)
    out[merged.column("at").to_numpy()] = merged.column("bits").to_numpy()
    return out.view(np.uint64)


def _candidates(docs: DataFrame, bitmap: np.ndarray, least: int) -> DataFrame:
    """``(row, doc_id, text, runs)`` of the documents with a run in the filter, and those runs: the one pass over the corpus."""
    sent = docs.sparkSession.sparkContext.broadcast(bitmap)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader, bits = _Runs(least), sent.value
        for pdf in batches:
            rows = []
            for doc, text in zip(pdf.doc_id, pdf.text):
                runs = reader.hashes(text)
                if len(runs):
                    at = reader.places(runs)
                    hit = ((bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).all(axis=0)
                    if hit.any():
                        rows.append((doc, text, np.unique(runs[hit]).astype(np.int64)))
            yield pd.DataFrame(rows, columns=["doc_id", "text", "runs"])

    return docs.mapInPandas(find, "doc_id long, text string, runs array<long>").select(F.xxhash64("doc_id", "text").alias("row"), "doc_id", "text", "runs")


def leaked(documents: DataFrame, items: DataFrame, least: int = 12) -> DataFrame:
    """``(doc_id, item_id, first_word, last_word)``: the maximal spans of each document's words covered by runs of at least
    ``least`` consecutive words of an item; case, punctuation and spacing make no difference. Words count from 0.

    The corpus is read once, however many items there are: a filter of fixed size over the hashes of all items' runs lets
    through documents that may hold one, and the runs tell the blocks of items concerned. Only these documents are
    shuffled, to their blocks, in slices of bounded size; a task builds the automaton of its block and streams its slice
    through it. The filter only spares work: what is reported comes from the automata.

    Null texts and ids are left out, as are items of fewer words; items with equal texts are all reported, equal documents
    of one id once; an empty side gives no rows; other columns, whatever their names, are ignored.
    """
    if type(least) is not int or least < 1:
        raise ValueError("least must be a positive whole number")
    spark, schema = documents.sparkSession, "doc_id long, item_id long, first_word int, last_word int"
    tests, blocks = _item_blocks(items, least)
    if not blocks:
        return spark.createDataFrame([], schema)

    def runs_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = _Runs(least)
        for pdf in batches:
            found = [np.unique(reader.hashes(t)).astype(np.int64) for t in pdf.text]
            yield pd.DataFrame({"run": np.concatenate(found), "block": np.repeat(pdf.block.to_numpy(), list(map(len, found)))})

    runs = written(tests.mapInPandas(runs_of, "run long, block int").distinct(), "leak-runs")
    docs = documents.where("doc_id is not null and text is not null").select("doc_id", "text")
    found = written(_candidates(docs, _filter_of(runs.select("run")), least), "leak-candidates")
    routed = found.select("row", F.explode("runs").alias("run")).join(runs, "run").select("row", "block").distinct()
    texts = written(found.select("row", "doc_id", "text").dropDuplicates(["row", "doc_id", "text"]).join(routed, "row"), "leak-routed")
    slices = texts.groupBy("block").agg(F.ceil(F.sum(F.length("text")) / SLICE_CHARACTERS).cast("int").alias("slices"))
    slices = written(slices.where("slices > 0"), "leak-slices")
    total = slices.agg(F.sum("slices")).first()[0] or 1

    # of a slice first its block's items, then its documents
    every = tests.join(slices, "block").select("block", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.lit(0).alias("kind"), F.col("item_id").alias("id"), "text")
    read = texts.join(slices, "block").select("block", F.pmod(F.xxhash64("row"), F.col("slices")).cast("int").alias("slice"), F.lit(1).alias("kind"), F.col("doc_id").alias("id"), "text")
    streams = every.unionByName(read).repartition(total, "block", "slice").sortWithinPartitions("block", "slice", "kind")

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, waiting, auto, reader = None, [], None, None
        for pdf in batches:
            rows = []
            for place, kind, id_, text in zip(zip(pdf.block, pdf.slice), pdf.kind, pdf.id, pdf.text):
                if place != at:
                    at, waiting, auto = place, [], None
                if not kind:
                    waiting.append((id_, py_tokens(text)))
                    continue
                if auto is None:
                    auto, ids = _automaton(waiting, least)
                    reader = _reader(ids)
                words = [x for v in reader(unicodedata.normalize("NFC", text)) for x in v]
                rows += [(id_, item, a, b) for item, spans in _spans(auto, words).items() for a, b in spans]
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "first_word", "last_word"])

    return streams.mapInPandas(match, schema)


def without_leaks(documents: DataFrame, spans: DataFrame, longest: int = 0, coverage: float = 0.5) -> DataFrame:
    """``(doc_id, words, leaked_words, text)``: texts in NFC without the leaked ``spans`` of more than ``longest`` words.

    Where leaked words are more than ``coverage`` of a document's words, its text is null: the document is to be dropped.
    Documents without leaks keep their text as it is and never leave the JVM; null texts stay null, with no words.
    ``spans`` are the rows of :func:`leaked`; a document's spans are merged in its task, where they are at most its words
    over ``least``, times the items that share a passage.
    """
    merged = spans.select("doc_id", F.struct("first_word", "last_word").alias("s")).distinct().groupBy("doc_id").agg(F.sort_array(F.collect_list("s")).alias("spans"))
    docs = documents.where("doc_id is not null").select("doc_id", "text").join(written(merged, "leak-spans"), "doc_id", "left")
    clean = docs.where("spans is null or text is null").select("doc_id", F.size(tokens(F.col("text"))).alias("words"), F.lit(0).alias("leaked_words"), "text")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, text, spans in zip(pdf.doc_id, pdf.text, pdf.spans):
                nfc = unicodedata.normalize("NFC", text)
                places = [m.span() for m in _SURFACE.finditer(nfc) for _ in py_tokens(m.group())]
                gone: list[list[int]] = []
                for s in spans:
                    if s["first_word"] >= len(places):
                        break  # of another text with this id
                    if gone and s["first_word"] <= gone[-1][1] + 1:
                        gone[-1][1] = max(gone[-1][1], min(s["last_word"], len(places) - 1))
                    else:
                        gone.append([s["first_word"], min(s["last_word"], len(places) - 1)])
                gone = [g for g in gone if g[1] - g[0] + 1 > longest]
                n = sum(b - a + 1 for a, b in gone)
                kept, at = [], 0
                for a, b in gone:
                    kept.append(nfc[at : places[a][0]])
                    at = places[b][1]
                kept.append(nfc[at:])
                rows.append((doc, len(places), n, None if n > coverage * len(places) else "".join(kept) if gone else text))
            yield pd.DataFrame(rows, columns=["doc_id", "words", "leaked_words", "text"])

    return clean.unionByName(docs.where("spans is not null and text is not null").mapInPandas(cut, "doc_id long, words int, leaked_words int, text string"))
