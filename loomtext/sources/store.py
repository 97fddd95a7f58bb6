"""Saved indexes: Parquet tables, sorted so that a query for a few terms reads few row groups."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from loomtext.operators.index import Index, integrity

VERSION = 1


def save(index: Index, path: str) -> None:
    """Write an index; a path that exists is an error. Postings are range-partitioned and sorted by term and document, so
    the statistics of row groups prune reads by term; content is the same however the index was built."""
    spark = index.docs.sparkSession
    index.docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id").write.parquet(f"{path}/docs")
    index.postings.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id").write.parquet(f"{path}/postings")
    spark.createDataFrame([(VERSION, index.has_positions)], "version int, positions boolean").coalesce(1).write.json(f"{path}/metadata")


def load(spark: SparkSession, path: str, validate: bool = True) -> Index:
    """Read an index; another version, missing columns or, with ``validate``, any broken rule is a ``ValueError``."""
    meta = spark.read.schema("version int, positions boolean").json(f"{path}/metadata").first()
    if meta is None or meta.version != VERSION:
        raise ValueError("not an index of this version")
    index = Index(spark.read.parquet(f"{path}/docs"), spark.read.parquet(f"{path}/postings"))
    if not {"doc_id", "path", "title", "text", "length"} <= set(index.docs.columns) or not {"term", "doc_id", "tf"} <= set(index.postings.columns) or index.has_positions != meta.positions:
        raise ValueError("the index has not the columns it should have")
    if validate and (broken := integrity(index).where("violations > 0").collect()):
        raise ValueError("the index is broken: " + ", ".join(f"{r.rule} {r.violations}" for r in broken))
    return index


@contextmanager
def open_index(spark: SparkSession, path: str, validate: bool = False) -> Iterator[Index]:
    """An index kept in memory and on disk of the executors while the block runs, released even after an error."""
    index = load(spark, path, validate)
    for table in (index.docs, index.postings):
        table.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield index
    finally:
        for table in (index.docs, index.postings):
            table.unpersist()


def same_content(a: Index, b: Index) -> bool:
    """Whether two indexes have equal documents and postings, by hashes that merge map-side."""

    def content(index: Index):
        key = F.concat_ws("\x1f", "term", F.col("doc_id").cast("string"), F.col("tf").cast("string"), *([F.to_json("positions")] if index.has_positions else []))
        docs = F.concat_ws("\x1f", F.col("doc_id").cast("string"), "path", "title", F.coalesce("text", F.lit("")), F.col("length").cast("string"))
        fold = lambda d, c: d.select(F.xxhash64(c).cast("decimal(38,0)").alias("h")).agg(F.sum("h"), F.count("*")).first()
        return tuple(fold(index.postings, key)), tuple(fold(index.docs, docs)), index.has_positions

    return content(a) == content(b)
