"""Incremental indexing: pages arrive as files of JSON Lines, their postings are appended exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.utils import AnalysisException

from loomtext.functions.web import canonical_url
from loomtext.operators.index import Index, build_index
from loomtext.scratch import written

PAGES = "url string, title string, text string, fetched_at string"


def read_pages(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """A stream of pages from the JSON Lines files of a folder, at most so many files at once."""
    return spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_per_batch).json(folder)


def distinct_pages(pages: DataFrame, within: str | None = None) -> DataFrame:
    """Pages by canonical address, the first of each. Without ``within`` all addresses are remembered for good; with it,
    say ``"7 days"`` of ``fetched_at``, the state is bounded by a watermark."""
    addressed = pages.withColumn("url", canonical_url("url")).where("url is not null")
    if within is None:
        return addressed.dropDuplicates(["url"])
    return addressed.withColumn("at", F.to_timestamp("fetched_at")).withWatermark("at", within).dropDuplicatesWithinWatermark(["url"]).drop("at")


def start_indexing(pages: DataFrame, path: str, checkpoint: str, positions: bool = True, available_now: bool = True) -> StreamingQuery:
    """Append documents and postings of every micro-batch to ``path``; :func:`load_stream` reads them.

    A document's id is a 63-bit hash of its canonical address, so a batch needs nothing of the ones before, and a page
    fetched again, under whatever spelling, has the id it had. Of a page's rows in one batch the one with the latest
    ``fetched_at`` counts, equal ones by text; of several batches, the last. To keep the first fetch instead, pass
    ``distinct_pages(pages)``. A batch writes into a folder of its own number and overwrites it if it is run again, which
    makes the appends exactly-once. Frequencies, counts and averages are derived when queried, never stored.
    """

    def append(batch: DataFrame, number: int) -> None:
        known = batch.withColumn("path", canonical_url("url")).where("path is not null").withColumn("doc_id", F.xxhash64("path").bitwiseAND(F.lit(2**63 - 1)))
        last = known.groupBy("doc_id").agg(F.max(F.struct("fetched_at", "text", "title", "path")).alias("p"))
        index = build_index(last.select("doc_id", "p.path", "p.title", "p.text"), positions, tokens_once=True)
        index.docs.write.mode("overwrite").parquet(f"{path}/docs/batch={number}")
        index.postings.write.mode("overwrite").parquet(f"{path}/postings/batch={number}")

    writer = pages.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")).start()


def load_stream(spark: SparkSession, path: str) -> Index:
    """The index of everything appended so far, of each document its last version; a folder without batches is an error.

    Versions that a later batch replaced are few, so leaving them out is an anti-join against those, not against all.
    """
    try:
        docs, postings = spark.read.parquet(f"{path}/docs"), spark.read.parquet(f"{path}/postings")
    except AnalysisException as e:
        raise ValueError("no batch has been indexed") from e
    versions = docs.groupBy("doc_id").agg(F.max("batch").alias("last"), F.count("*").alias("n")).where("n > 1").select("doc_id", "last")
    replaced = docs.select("doc_id", "batch").join(versions, "doc_id").where("batch < last").select("doc_id", "batch")
    replaced = written(replaced, "stream-replaced")
    keep = lambda rows: rows.join(replaced, ["doc_id", "batch"], "left_anti").drop("batch")
    return Index(keep(docs), keep(postings))
