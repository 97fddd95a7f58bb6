"""Frequency of every term, kept up to date by incremental signed deltas.

A :class:`TermCounts` store is a folder:

- ``manifest``: one small file a version, which names the tables that make it up; a version exists once its manifest does,
  so a job that dies leaves the store as it was, and of two writers of one version the second fails;
- ``records``: the valid ``(doc_id, term, tf)`` of the documents of a version, in buckets by document;
- ``docs``: the documents that a version touched, with their bucket and whether they have any valid posting since;
- ``counts`` and ``deltas``: ``(term, occurrences, documents)``, in all and signed per version, hash-partitioned by term.

Applying a change looks the touched documents up in ``docs``, a narrow table, and reads the old rows of those that are
there from their buckets only; these are negated, the new rows added, and both aggregated per term before anything is
shuffled by term, so a hot term costs one row a task and version. Every few versions the deltas are folded into the counts,
and every few more the records into one version; what a store returns stays the same.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm.postings import valid_postings
from loomtext.scratch import scratch_path

RECORDS = "doc_id long, term string, tf long"
DOCS = "doc_id long, bucket int, alive boolean"
DELTAS = "term string, occurrences long, documents long"
#: Deltas after which they are folded into the counts, and versions of records after which they become one.
FOLD, COMPACT = 4, 8


class TermCounts:
    """Persistent counts of terms under signed changes; a path that holds a store opens it at its last version.

    Null or invalid postings, repeated rows, several forms of a term and extra columns are treated as
    :func:`~loomtext.llm.postings.valid_postings` says. Empty changes and an empty store are valid and give no rows.
    Deleting an unknown document changes nothing; upserting a document replaces all of it; a document both upserted and
    deleted in one change is upserted; one whose new postings are all invalid has no terms from then on. ``buckets`` is
    fixed when a store is made.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = 32):
        self.spark, self.path = spark, path or scratch_path(spark, "term-counts")
        names = self._manifests()
        self._now = json.loads(self._read(names[-1])) if names else {"version": 0, "buckets": buckets, "holding": 0, "records": {}, "docs": {}, "counts": None, "deltas": []}

    # the manifest ----------------------------------------------------------------------------------------------------

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _manifests(self) -> list[str]:
        fs, at = self._fs(f"{self.path}/manifest")
        return sorted(s.getPath().toString() for s in fs.listStatus(at)) if fs.exists(at) else []

    def _read(self, name: str) -> str:
        return self.spark.read.text(name, wholetext=True).first()[0]

    def _commit(self, **changed) -> None:
        now = {**self._now, **changed, "version": self._now["version"] + 1}
        fs, at = self._fs(f"{self.path}/manifest/{now['version']:08d}.json")
        out = fs.create(at, False)
        out.write(bytearray(json.dumps(now).encode()))
        out.close()
        self._now = now

    # tables ----------------------------------------------------------------------------------------------------------

    def _write(self, df: DataFrame, kind: str, *by: str) -> str:
        path = f"{self.path}/{kind}/{self._now['version'] + 1:08d}-{uuid.uuid4().hex[:8]}"
        df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
        return path

    def _table(self, schema: str, *paths: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("doc_id"), F.lit(self._now["buckets"])).cast("int").alias("bucket")

    def _write_records(self, rows: DataFrame) -> str:
        """In buckets; a bucket is written by several tasks, so no document makes one of them long."""
        keyed = rows.select("doc_id", "term", "tf", self._bucket())
        return self._write(keyed.repartition("bucket", F.pmod(F.xxhash64("term"), F.lit(2))), "records", "bucket")

    def _last(self, touched: DataFrame | None = None) -> DataFrame:
        """``(doc_id, bucket, alive, version)``: of each document, or of the touched ones, what its last version says."""
        versions = [self._table(DOCS, path).select("*", F.lit(int(v)).alias("version")) for v, path in self._now["docs"].items()]
        rows = self._table(DOCS).select("*", F.lit(0).alias("version"))
        for v in versions:
            rows = rows.unionByName(v if touched is None else v.join(touched, "doc_id", "left_semi"))
        last = rows.groupBy("doc_id").agg(F.max(F.struct("version", "bucket", "alive")).alias("d"))
        return last.select("doc_id", "d.bucket", "d.alive", "d.version")

    def _records(self, version: str, buckets: list[int] | None = None) -> DataFrame:
        rows = self._table(f"{RECORDS}, bucket int", self._now["records"][version])
        return (rows if buckets is None else rows.where(F.col("bucket").isin(buckets))).drop("bucket")

    def records(self) -> DataFrame:
        """The current ``(doc_id, term, tf)`` rows: of each version those of documents that no later one touched."""
        if len(self._now["docs"]) == 1:
            return self._records(*self._now["records"])
        last, rows = self._last().where("alive").select("doc_id", "version"), self._table(RECORDS).withColumn("version", F.lit(0))
        for v in self._now["records"]:
            rows = rows.unionByName(self._records(v).withColumn("version", F.lit(int(v))))
        return rows.join(last, ["doc_id", "version"], "left_semi").select("doc_id", "term", "tf")

    # changes ---------------------------------------------------------------------------------------------------------

    def apply(self, upserts: DataFrame | None = None, deletes: DataFrame | None = None) -> TermCounts:
        """Replace the documents of ``upserts`` (raw postings), drop those of ``deletes`` (column ``doc_id``)."""
        version = str(self._now["version"] + 1)
        none = self._table(RECORDS)
        records = self._write_records(valid_postings(upserts) if upserts is not None else none)
        new = self._table(f"{RECORDS}, bucket int", records)
        named = [d.select("doc_id", F.lit(False).alias("alive")).where("doc_id is not null") for d in (upserts, deletes) if d is not None]
        touched = new.select("doc_id", F.lit(True).alias("alive"))
        for d in named:
            touched = touched.unionByName(d)
        touched = touched.groupBy("doc_id").agg(F.max("alive").alias("alive"))
        docs = self._write(touched.select("doc_id", self._bucket(), "alive"), "docs")

        found = self._last(self._table(DOCS, docs).select("doc_id")).where("alive") if self._now["docs"] else None
        signed, gone = new.select("term", "tf", F.lit(1).alias("sign")), 0
        if found is not None:
            found_path = self._write(found, "found")
            found = self.spark.read.parquet(found_path)
            # at most versions times buckets rows
            places = found.groupBy("version", "bucket").agg(F.count("*").alias("n")).collect()
            gone = sum(p.n for p in places)
            for v in sorted({p.version for p in places}):
                old = self._records(str(v), [p.bucket for p in places if p.version == v])
                old = old.join(found.where(F.col("version") == v).select("doc_id"), "doc_id", "left_semi")
                signed = signed.union(old.select("term", "tf", F.lit(-1).alias("sign")))
        change = signed.groupBy("term").agg(F.sum(F.col("tf") * F.col("sign")).alias("occurrences"), F.sum("sign").alias("documents"))
        delta = self._write(change.where("occurrences <> 0 or documents <> 0"), "deltas")
        alive = self._table(DOCS, docs).where("alive").count()
        self._commit(
            holding=self._now["holding"] + alive - gone, deltas=[*self._now["deltas"], delta],
            records={**self._now["records"], version: records}, docs={**self._now["docs"], version: docs},
        )
        if len(self._now["deltas"]) > FOLD:
            self._commit(counts=self._write(self.counts(), "counts"), deltas=[])
        if len(self._now["records"]) > COMPACT:
            self.compact()
        return self

    def counts(self) -> DataFrame:
        """``(term, occurrences, documents)`` of every term that any document holds now."""
        paths = [p for p in (self._now["counts"], *self._now["deltas"]) if p]
        rows = self._table(DELTAS, *paths)
        if len(paths) < 2:
            return rows
        return rows.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("documents").alias("documents")).where("documents > 0")

    def compact(self) -> TermCounts:
        """Fold all versions into one; what :meth:`counts` and :meth:`records` return stays the same."""
        if self._now["records"]:
            version = str(self._now["version"] + 1)
            docs = self._write(self._last().where("alive").select("doc_id", "bucket", "alive"), "docs")
            counts, records = self._write(self.counts(), "counts"), self._write_records(self.records())
            self._commit(counts=counts, deltas=[], records={version: records}, docs={version: docs})
        return self

    def marked(self, rare_at_most: int = 2, common_above: float = 0.4) -> DataFrame:
        """:meth:`counts` with ``mark``: ``rare``, ``common`` or null.

        ``rare``: at most ``rare_at_most`` documents hold the term; else ``common``: more than ``common_above`` of the
        documents with any valid posting do; their number is kept with every version.
        """
        share = F.col("documents") > F.lit(common_above) * F.lit(self._now["holding"])
        mark = F.when(F.col("documents") <= rare_at_most, "rare").when(share, "common")
        return self.counts().select("term", "occurrences", "documents", mark.alias("mark"))
