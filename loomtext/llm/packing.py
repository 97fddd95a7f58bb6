"""Filling containers of fixed capacity with texts, neighbours along a space-filling curve together."""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.neighbours import hilbert_keys
from loomtext.scratch import written

#: Where the ranks of the public tokenizer are, and the fixed pattern that splits text before its merges.
RANKS = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Items not yet placed among which the next one of a container is looked for; they follow each other on the curve.
LOOK = 256
_BUCKETS, _AXES, _BITS = 256, 6, 10


class Packer:
    """Packs a stream of items in its order, with a look-ahead of :data:`LOOK` items.

    A container begins with the first item that waits and takes the ones after it in order while they fit; when the next
    does not, the largest waiting item that does, of equal ones the first. It closes when none fits. So most of a
    container are items that follow each other, and none is more than the look-ahead away.
    """

    def __init__(self, capacity: int, look: int = LOOK):
        self.capacity, self.most, self.made, self.free = capacity, look, 0, 0
        self.sizes: list[tuple[int, int]] = []  # (size, -number) of the items that wait, ascending
        self.order: deque[int] = deque()
        self.waiting: dict[int, tuple[int, object]] = {}
        self.seen = 0

    def new(self) -> int:
        self.made += 1
        return self.made - 1

    def put(self, size: int, item: object) -> list[tuple[int, object]]:
        """Let an item wait; ``(container, item)`` of those placed now."""
        self.waiting[self.seen] = (size, item)
        insort(self.sizes, (size, -self.seen))
        self.order.append(self.seen)
        self.seen += 1
        return [self._place()] if len(self.waiting) >= self.most else []

    def rest(self) -> list[tuple[int, object]]:
        """The places of all items that still wait."""
        return [self._place() for _ in range(len(self.waiting))]

    def _place(self) -> tuple[int, object]:
        while self.order[0] not in self.waiting:
            self.order.popleft()
        number = self.order[0]
        if self.waiting[number][0] > self.free:
            at = bisect_left(self.sizes, (self.free + 1, -self.seen))
            if at:
                number = -self.sizes[at - 1][1]
            else:
                self.box, self.free = self.new(), self.capacity
        size, item = self.waiting.pop(number)
        del self.sizes[bisect_left(self.sizes, (size, -number))]
        self.free -= size
        return self.box, item


def token_keys(documents: DataFrame, ranks: str = RANKS, seed: int = 5) -> DataFrame:
    """``(doc_id, tokens, key)``: the size of every text in tokens and the place of its hashed vector on a Hilbert curve.

    Token counts go into signed hash buckets, are brought to unit norm and projected onto a few dimensions.
    """
    rng = np.random.default_rng(seed)
    sign, bucket = rng.choice([-1.0, 1.0], 1 << 16), rng.integers(0, _BUCKETS, 1 << 16)
    basis = np.linalg.qr(rng.standard_normal((_BUCKETS, _AXES)))[0] * np.sqrt(_BUCKETS)

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encode = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary
        for pdf in batches:
            sizes, vectors = np.zeros(len(pdf), np.int64), np.zeros((len(pdf), _BUCKETS))
            for i, text in enumerate(pdf.text):
                ids = np.asarray(encode(text), dtype=np.int64) & 0xFFFF
                sizes[i] = len(ids)
                vectors[i] = np.bincount(bucket[ids], weights=sign[ids], minlength=_BUCKETS)
            vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
            cells = np.clip(((vectors @ basis) / 6 + 0.5) * (1 << _BITS), 0, (1 << _BITS) - 1).astype(np.int64)
            yield pd.DataFrame({"doc_id": pdf.doc_id, "tokens": sizes, "key": hilbert_keys(cells, _BITS)})

    rows = documents.where("doc_id is not null and text is not null and text <> ''").select("doc_id", "text")
    return rows.mapInPandas(keyed, "doc_id long, tokens long, key long")


def containers(documents: DataFrame, capacity: int = 1024, ranks: str = RANKS) -> DataFrame:
    """``(container, doc_id, first_token, tokens)``: every text assigned to containers of ``capacity`` tokens.

    A text of at most ``capacity`` tokens is in one container, whole; a longer one is cut into full pieces, each filling
    a container of its own, and a rest that is packed like a short text. All texts are range-sorted by their key, and
    each range is packed along the curve by a :class:`Packer`, so a container holds neighbours of the curve. Container
    numbers are unique but neither dense nor the same in every run, as the borders of ranges come from Spark's sampling.

    Null and empty texts take no space and give no rows; documents of one id are packed each; other columns are ignored;
    an empty table gives no rows. No task holds more than the look-ahead and a batch, however many texts share a key.
    """
    if type(capacity) is not int or capacity < 1:
        raise ValueError("capacity must be a positive whole number")

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        context = TaskContext.get()
        base = (context.partitionId() if context else 0) << 40
        packer = Packer(capacity)

        def table(rows: list[tuple[int, int, int, int]]) -> pd.DataFrame:
            out = pd.DataFrame(rows, columns=["container", "doc_id", "first_token", "tokens"], dtype="int64")
            return out.assign(container=out.container + base)

        for pdf in batches:
            rows = []
            for doc, tokens in zip(pdf.doc_id.tolist(), pdf.tokens.tolist()):
                full, rest = divmod(tokens, capacity)
                rows += [(packer.new(), doc, i * capacity, capacity) for i in range(full)]
                if rest:
                    rows += [(box, *item) for box, item in packer.put(rest, (doc, full * capacity, rest))]
            yield table(rows)
        yield table([(box, *item) for box, item in packer.rest()])

    # the tokenizer runs once: finding the borders of ranges reads the keys again
    keyed = written(token_keys(documents, ranks), "packing-keys")
    ordered = keyed.repartitionByRange("key", "doc_id").sortWithinPartitions("key", "doc_id")
    return ordered.mapInPandas(packed, "container long, doc_id long, first_token long, tokens long")
