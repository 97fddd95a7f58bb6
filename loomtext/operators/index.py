"""The inverted index as tables: build, merge, statistics, checks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.functions.text import title_or_stem, tokens
from loomtext.scratch import written


@dataclass(frozen=True)
class Index:
    """``docs(doc_id, path, title, text, length)`` and ``postings(term, doc_id, tf, positions)``; ``positions`` may be absent."""

    docs: DataFrame
    postings: DataFrame

    @property
    def has_positions(self) -> bool:
        return "positions" in self.postings.columns

    def __contains__(self, term: str) -> bool:
        return not self.lookup(term).isEmpty()

    def __len__(self) -> int:
        return self.postings.select("term").distinct().count()

    def lookup(self, term: str) -> DataFrame:
        """Postings of a term in order of document."""
        return self.postings.where(F.col("term") == term).orderBy("doc_id")

    def document(self, doc_id: int) -> DataFrame:
        return self.docs.where(F.col("doc_id") == doc_id)

    def written(self) -> Index:
        """The same index over tables written once, for several queries in a session."""
        return Index(written(self.docs, "index-docs"), written(self.postings, "index-postings"))


def _doc_columns(documents: DataFrame) -> list[Column]:
    have = set(documents.columns)
    path = F.col("path") if "path" in have else F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))
    title = title_or_stem(F.col("title") if "title" in have else F.lit(None).cast("string"), path)
    return [F.col("doc_id").cast("long").alias("doc_id"), path.alias("path"), title.alias("title"), F.col("text")]


def build_index(documents: DataFrame, positions: bool = True, tokens_once: bool = False) -> Index:
    """Index of ``documents(doc_id, text[, path, title])``.

    Documents without tokens, null texts among them, are documents of length 0. Words of one document never leave its
    row before they are counted, so the only shuffle of the build is by term and document, after partial counts. Where
    both tables will be read, ``tokens_once`` writes the tokens first, so that texts are not tokenised for each of them.
    """
    rows = documents.select(*_doc_columns(documents), tokens(F.col("text")).alias("_tokens"))
    if tokens_once:
        rows = written(rows, "index-tokens")
    docs = rows.withColumn("length", F.size("_tokens")).drop("_tokens")
    words = rows.select("doc_id", F.posexplode("_tokens").alias("pos", "term"))
    found = [F.count("*").cast("int").alias("tf")]
    if positions:
        found.append(F.sort_array(F.collect_list("pos")).alias("positions"))
    return Index(docs, words.groupBy("term", "doc_id").agg(*found))


def token_counts(documents: DataFrame) -> DataFrame:
    """``(term, cf)``: occurrences of every term straight from the texts."""
    return documents.select(F.explode(tokens(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("cf"))


def document_frequency(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count("*").alias("df"))


def term_statistics(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def top_terms(postings: DataFrame, n: int = 50) -> DataFrame:
    """The ``n`` most frequent terms of the collection, equal ones in code point order."""
    return term_statistics(postings).orderBy(F.desc("cf"), "term").limit(n)


def corpus_stats(index: Index) -> DataFrame:
    """One row ``(documents, tokens, terms, average_length)``; the average of no documents is 0."""
    of_docs = index.docs.agg(
        F.count("*").alias("documents"), F.coalesce(F.sum("length"), F.lit(0)).alias("tokens"), F.coalesce(F.avg("length"), F.lit(0.0)).alias("average_length")
    )
    terms = index.postings.select("term").distinct().agg(F.count("*").alias("terms"))
    return of_docs.crossJoin(F.broadcast(terms)).select("documents", "tokens", "terms", "average_length")


def merge_indexes(parts: list[Index], check: bool = True) -> Index:
    """One index of parts over disjoint documents; a document in two parts, or parts of which only some have positions, is an error."""
    if not parts:
        raise ValueError("nothing to merge")
    if len({p.has_positions for p in parts}) > 1:
        raise ValueError("some parts have positions and some don't")
    docs, postings = parts[0].docs, parts[0].postings
    for p in parts[1:]:
        docs, postings = docs.unionByName(p.docs), postings.unionByName(p.postings)
    if check and not docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        raise ValueError("a document is in two parts")
    return Index(docs, postings)


def integrity(index: Index) -> DataFrame:
    """``(rule, violations)``: how often each rule of a sound index is broken; all 0 in one that :func:`build_index` made."""
    docs, postings = index.docs, index.postings
    p, size = F.col("positions"), F.size("positions")
    checks = {
        "term_empty": F.coalesce(F.col("term") == "", F.lit(True)),
        "tf_not_positive": ~F.coalesce(F.col("tf") > 0, F.lit(False)),
    }
    if index.has_positions:
        checks |= {
            "positions_count": ~F.coalesce(size == F.col("tf"), F.lit(False)),
            "positions_order": ~F.coalesce(F.array_sort(F.array_distinct(p)) == p, F.lit(False)),
            "positions_negative": F.coalesce(F.exists(p, lambda x: x < 0), F.lit(True)),
        }
    rules = postings.agg(*(F.count_if(c).alias(r) for r, c in checks.items()))
    per_doc = postings.groupBy("doc_id").agg(F.sum("tf").alias("total"), *([F.max(F.array_max(p)).alias("last")] if index.has_positions else []))
    both = docs.select("doc_id", "length").join(per_doc, "doc_id", "full")
    lengths = {"length_differs": ~F.coalesce(F.coalesce("length", F.lit(-1)) == F.coalesce("total", F.lit(0)), F.lit(False))}
    if index.has_positions:
        lengths["position_beyond_length"] = F.coalesce(F.col("last") >= F.col("length"), F.lit(False))
    rules = rules.crossJoin(both.agg(*(F.count_if(c).alias(r) for r, c in lengths.items())))
    twice = postings.groupBy("term", "doc_id").count().where("count > 1").agg(F.count("*").alias("posting_twice"))
    ids = docs.groupBy("doc_id").count().agg(F.count_if((F.col("count") > 1) | F.col("doc_id").isNull()).alias("doc_id_twice"))
    wide = rules.crossJoin(twice).crossJoin(ids)
    pairs = ", ".join(f"'{c}', {c}" for c in wide.columns)
    return wide.selectExpr(f"stack({len(wide.columns)}, {pairs}) as (rule, violations)")


def fingerprint(docs: DataFrame) -> DataFrame:
    """One row ``(fingerprint)``: a hash over all documents that doesn't depend on their order or partitioning.

    Every document is hashed in its row; rows are folded by exclusive or and sum of 64-bit halves, which merge map-side,
    so nothing is gathered.
    """
    line = F.concat_ws("\x1f", F.col("doc_id").cast("string"), F.coalesce("path", F.lit("")), F.coalesce("text", F.lit("")))
    digest = F.sha2(line, 256)
    half = lambda i: F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")
    folded = docs.select(*(half(i).alias(f"h{i}") for i in range(4))).agg(*(F.coalesce(F.sum(f"h{i}"), F.lit(0)).cast("string").alias(f"h{i}") for i in range(4)), F.count("*").alias("n"))
    return folded.select(F.sha2(F.concat_ws(",", "h0", "h1", "h2", "h3", F.col("n").cast("string")), 256).alias("fingerprint"))
