"""Passages, embeddings, semantic and hybrid ranking."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomtext.functions.snippets import with_snippets
from loomtext.functions.text import py_tokens, word_chunks
from loomtext.functions.vectors import dot, literal
from loomtext.operators.index import Index, fingerprint
from loomtext.operators.scoring import BM25, Scorer
from loomtext.operators.search import best, check_k, rank, shown
from loomtext.plans.query import any_of, parse
from loomtext.scratch import written


class Encoder(Protocol):
    """Anything with ``encode``: texts to a float32 matrix of unit rows. It is sent to the workers, so it must pickle."""

    def encode(self, texts: list[str]) -> np.ndarray: ...


@dataclass(frozen=True)
class HashingEncoder:
    """Signed word hashes; needs no model, gives the same vectors everywhere."""

    dim: int = 64

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), dtype=np.float32)
        for row, text in zip(out, texts):
            for word in py_tokens(text):
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                row[h % self.dim] += 1.0 if h >> 63 else -1.0
            if not row.any():
                row[0] = 1.0
        return out / np.linalg.norm(out, axis=1, keepdims=True)


def passages(docs: DataFrame, size: int = 160, overlap: int = 32) -> DataFrame:
    """``(doc_id, chunk, passage)``: overlapping runs of words of every text; a text without words has none."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(word_chunks(F.col("text"), size, overlap)).alias("chunk", "passage"))


def embed(rows: DataFrame, encoder: Encoder, batch: int = 64, known: DataFrame | None = None) -> DataFrame:
    """``rows`` with ``embedding`` of their ``passage``.

    With ``known(passage_hash, embedding)``, as kept from an earlier run by :func:`embedding_store`, only passages not
    among them are encoded.
    """

    @F.pandas_udf("array<float>")
    def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            values = texts.fillna("").tolist()
            parts = [encoder.encode(values[i : i + batch]) for i in range(0, len(values), batch)]
            yield pd.Series([v for p in parts for v in np.asarray(p, dtype=np.float32)], dtype=object)

    if known is None:
        return rows.withColumn("embedding", encoded("passage"))
    keyed = rows.withColumn("passage_hash", F.sha2("passage", 256))
    have = keyed.join(known.select("passage_hash", "embedding"), "passage_hash")
    missing = keyed.join(known.select("passage_hash"), "passage_hash", "left_anti").withColumn("embedding", encoded("passage"))
    return have.unionByName(missing).drop("passage_hash")


def embedding_store(embedded: DataFrame) -> DataFrame:
    """What a resumed run needs of an earlier one: ``(passage_hash, embedding)``."""
    return embedded.select(F.sha2("passage", 256).alias("passage_hash"), "embedding").dropDuplicates(["passage_hash"])


def similarities(rows: DataFrame, query: list[float], vector: str = "embedding") -> DataFrame:
    """``rows`` with ``sim``, the dot product with a query vector of the same length; another length is an error."""
    v = F.col(vector)
    wrong = F.raise_error(F.concat(F.lit("vector of length "), F.size(v).cast("string"))).cast("double")
    return rows.withColumn("sim", F.when(F.size(v) == len(query), dot(v, literal(query))).otherwise(wrong))


def nearest_to_each(rows: DataFrame, queries: DataFrame, item: str, k: int = 10, block: int = 4096, vector: str = "embedding") -> DataFrame:
    """``(query_id, item, sim, place)``: of every row of ``queries(query_id, embedding)`` the ``k`` rows most similar by dot
    product, equal ones (to six decimals) by smaller id; a row whose id is the query's is left out.

    Exact: every query meets every row, in blocks. The queries are a stated set, sent out ``block`` at a time, which bounds
    what a task holds; a block is one matrix product a batch of rows, of which each task keeps its ``k`` best per query.
    All vectors must have one length; a null one takes no part; an empty side gives no rows.
    """
    known = queries.where(F.col(vector).isNotNull()).select("query_id", vector)
    blocks = max(1, -(-known.count() // block))
    placed = written(known.withColumn("_block", F.pmod(F.xxhash64("query_id"), F.lit(blocks))), "nearest-queries")
    usable = rows.where(F.col(vector).isNotNull()).select(F.col(item).cast("long").alias("item"), F.col(vector).alias("v"))
    found = rows.sparkSession.createDataFrame([], "query_id long, item long, sim double")
    for part in range(blocks):
        some = placed.where(F.col("_block") == part).select("query_id", vector).collect()
        if not some:
            continue
        ids, matrix = np.array([r[0] for r in some]), np.array([r[1] for r in some], dtype=np.float64)

        def best_of(batches: Iterator[pd.DataFrame], ids=ids, matrix=matrix) -> Iterator[pd.DataFrame]:
            kept = pd.DataFrame({"query_id": ids[:0], "item": ids[:0], "sim": np.empty(0)})
            for pdf in batches:
                for a in range(0, len(pdf), 1024):
                    items, v = pdf["item"].to_numpy()[a : a + 1024], np.stack(pdf["v"].iloc[a : a + 1024].to_numpy())
                    sims = np.round(matrix @ v.astype(np.float64).T, 6)
                    # the query itself may be among the best of the batch
                    least = -np.partition(-sims, k, axis=1)[:, k] if len(items) > k else np.full(len(ids), -np.inf)
                    q, i = np.nonzero((sims >= least[:, None]) & (ids[:, None] != items[None, :]))
                    kept = pd.concat([kept, pd.DataFrame({"query_id": ids[q], "item": items[i], "sim": sims[q, i]})])
                    kept = kept.sort_values(["query_id", "sim", "item"], ascending=[True, False, True]).groupby("query_id").head(k)
            yield kept

        found = found.unionByName(usable.mapInPandas(best_of, "query_id long, item long, sim double"))
    order = Window.partitionBy("query_id").orderBy(F.desc("sim"), "item")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("query_id", F.col("item").alias(item), "sim", "place")


def semantic_rank(rows: DataFrame, query: list[float], snippet: int = 240) -> DataFrame:
    """``(doc_id, score, snippet)``: the best passage of each document of ``(passage_id, doc_id, passage, embedding)``;
    of equally good ones the first, by ``chunk`` where there is one, else by id. Documents without passages don't appear."""
    scored = similarities(rows, query)
    nth = "chunk" if "chunk" in rows.columns else "passage_id"
    first = F.min(F.struct((-F.col("sim")).alias("minus"), nth, "passage")).alias("first")
    top = scored.groupBy("doc_id").agg(first)
    return top.select("doc_id", (-F.col("first.minus")).alias("score"), F.substring("first.passage", 1, snippet).alias("snippet"))


def ranked(ranking: DataFrame, digits: int | None = None) -> DataFrame:
    """``ranking`` with ``rank`` from 1 over all rows, by score descending and ``doc_id``.

    A global rank without one task that sees all rows: rows are range-partitioned in rank order, numbered within their
    partition and offset by the rows of the partitions before, of which only counts are gathered.
    """
    score = F.col("score") if digits is None else F.round("score", digits)
    keyed = ranking.withColumn("score", score).withColumn("_minus", -F.col("score"))
    spread = keyed.repartitionByRange(F.col("_minus"), F.col("doc_id")).withColumn("_part", F.spark_partition_id())
    spread = written(spread, "ranking")
    sizes = spread.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy("_minus", "doc_id"))
    # one row a partition: bounded by their number
    return spread.join(F.broadcast(before), "_part").withColumn("rank", (own + F.col("_before")).cast("long")).drop("_part", "_before", "_minus")


def rrf(rankings: list[DataFrame], constant: int = 60) -> DataFrame:
    """Reciprocal Rank Fusion of ``(doc_id, rank)`` lists: ``(doc_id, score)`` with the sum of ``1 / (constant + rank)``.

    One union and one aggregate instead of a full join for every list.
    """
    if not rankings:
        raise ValueError("nothing to fuse")
    rows = None
    for place, r in enumerate(rankings):
        part = r.select("doc_id", F.lit(place).alias("list"), (1.0 / (constant + F.col("rank"))).alias("part"))
        rows = part if rows is None else rows.unionByName(part)
    parts = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("list", "part"))).alias("parts"))
    return parts.select("doc_id", F.aggregate("parts", F.lit(0.0), lambda s, x: s + x["part"]).alias("score"))


@dataclass(frozen=True)
class SemanticIndex:
    """``passages(passage_id, doc_id, chunk, passage, embedding)`` and the fingerprint of the documents they were made of."""

    passages: DataFrame
    corpus: str
    model: str = "hashing"

    @classmethod
    def build(cls, index: Index, encoder: Encoder, model: str = "hashing", size: int = 160, overlap: int = 32, known: SemanticIndex | None = None) -> SemanticIndex:
        """Embeddings of all passages. With ``known``, an index of the same model over other or fewer documents, only
        passages that it doesn't have are encoded. Ids are hashes of document and chunk, so document ids may be any."""
        if known is not None and known.model != model:
            raise ValueError("the known embeddings are of another model")
        rows = passages(index.docs, size, overlap).select(F.xxhash64("doc_id", "chunk").alias("passage_id"), "doc_id", "chunk", "passage")
        return cls(embed(rows, encoder, known=embedding_store(known.passages) if known is not None else None), fingerprint(index.docs).first()[0], model)

    def save(self, path: str) -> None:
        self.passages.write.parquet(f"{path}/passages")
        self.passages.sparkSession.createDataFrame([(1, self.model, self.corpus)], "version int, model string, corpus string").coalesce(1).write.json(f"{path}/metadata")

    @classmethod
    def load(cls, spark: SparkSession, path: str, index: Index | None = None, dim: int | None = None, model: str | None = None) -> SemanticIndex:
        """Read and check: version, model and documents must be the same, vectors of one length and unit norm."""
        meta = spark.read.schema("version int, model string, corpus string").json(f"{path}/metadata").first()
        if meta is None or meta.version != 1 or (model is not None and meta.model != model):
            raise ValueError("the embeddings are of another version or model")
        if index is not None and fingerprint(index.docs).first()[0] != meta.corpus:
            raise ValueError("the embeddings belong to other documents")
        rows = spark.read.parquet(f"{path}/passages")
        n = F.sqrt(dot(F.col("embedding"), F.col("embedding")))
        sizes = rows.agg(F.min(F.size("embedding")).alias("a"), F.max(F.size("embedding")).alias("b"), F.count_if(~F.coalesce(F.abs(n - 1) <= 1e-5, F.lit(False)) | F.isnan(n)).alias("bad")).first()
        if sizes.bad or sizes.a != sizes.b or (dim is not None and sizes.a not in (None, dim)):
            raise ValueError("the vectors are not of one length and unit norm")
        return cls(rows, meta.corpus, meta.model)

    def rank(self, query: str, encoder: Encoder) -> DataFrame:
        return semantic_rank(self.passages, encoder.encode([query])[0].tolist())


def check_retrieval(query: str, mode: str, semantic: SemanticIndex | None, encoder: Encoder | None) -> None:
    if not query.strip():
        raise ValueError("the query is blank")
    if mode not in ("keyword", "semantic", "hybrid") or mode != "keyword" and (semantic is None or encoder is None):
        raise ValueError("mode is keyword, semantic or hybrid; the last two need an index of embeddings and an encoder")


def ranking_of(
    index: Index, query: str, scorer: Scorer | None = None, mode: str = "keyword", semantic: SemanticIndex | None = None, encoder: Encoder | None = None, digits: int | None = None
) -> DataFrame:
    """``(doc_id, score, snippet)`` of all that a mode finds: ``keyword`` the matches of a query, ``semantic`` the documents
    with passages by their best one, ``hybrid`` both rankings in full, fused; its keyword side is BM25 of the query's
    distinct words, whatever ``scorer`` is. ``snippet`` is the best passage's begin, null where there is none."""
    check_retrieval(query, mode, semantic, encoder)
    if mode == "keyword":
        return rank(index, parse(query), scorer).withColumn("snippet", F.lit(None).cast("string"))
    near = semantic.rank(query, encoder)
    if mode == "semantic":
        return near
    near = written(near, "semantic-ranking")
    words = py_tokens(query)
    lists = [ranked(rank(index, any_of(words), BM25()), digits)] if words else []
    return rrf([*lists, ranked(near.select("doc_id", "score"), digits)]).join(near.select("doc_id", "snippet"), "doc_id", "left")


def retrieve(
    index: Index, query: str, scorer: Scorer | None = None, k: int = 10, mode: str = "keyword", semantic: SemanticIndex | None = None, encoder: Encoder | None = None, digits: int | None = None
) -> DataFrame:
    """``(rank, doc_id, score, title, path, snippet)`` of the first ``k`` of :func:`ranking_of`; equal scores, to ``digits``
    decimals if given, by smaller id."""
    check_k(k)
    ranking = ranking_of(index, query, scorer, mode, semantic, encoder, digits)
    return with_titles(best(ranking, k, None if digits is None else digits + 3), index, query, mode)


def with_titles(top: DataFrame, index: Index, query: str, mode: str) -> DataFrame:
    """``top`` rows of :func:`ranking_of` with title, path and snippet: around the words found, else the passage's begin."""
    if mode == "keyword":
        return shown(top.drop("snippet"), index.docs, parse(query))
    rows = index.docs.select("doc_id", "title", "path", "text").join(F.broadcast(top.withColumnRenamed("snippet", "_near")), "doc_id")
    words = set(py_tokens(query)) if mode == "hybrid" else set()
    own = with_snippets(rows, words) if words else rows.withColumn("snippet", F.lit(None).cast("string"))
    snippet = F.coalesce(F.nullif("snippet", F.lit("")), "_near", F.lit(""))
    return own.select("rank", "doc_id", "score", "title", "path", snippet.alias("snippet"))
