"""Corpora: folders of text files and JSON Lines of pages."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomtext.scratch import written


def read_text_files(spark: SparkSession, root: str, on_error: str = "skip", limit: int | None = None) -> DataFrame:
    """``(path, title, text)`` of every ``.txt`` file below ``root``; paths are relative, with ``/``.

    Files are UTF-8 with or without byte order mark. One that is not is left out (``skip``) or fails the job (``fail``).
    ``limit`` takes the first files by path; the others are not read.
    """
    if on_error not in ("skip", "fail"):
        raise ValueError("on_error is skip or fail")
    if limit is not None and (type(limit) is not int or limit < 0):
        raise ValueError("limit must be a whole number of at least 0")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").load(root)
    if limit is not None:
        first = files.select("path").orderBy("path").limit(limit)
        files = files.join(F.broadcast(first), "path", "left_semi")

    @F.pandas_udf("string")
    def decoded(contents: pd.Series) -> pd.Series:
        def one(raw: bytes) -> str | None:
            try:
                return bytes(raw).decode("utf-8-sig")
            except UnicodeDecodeError:
                if on_error == "fail":
                    raise
                return None

        return contents.map(one)

    base = root.rstrip("/").removeprefix("file://").removeprefix("file:")
    relative = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "^" + _quoted("/" + base.lstrip("/")) + "/", "")
    return files.select(relative.alias("path"), F.lit(None).cast("string").alias("title"), decoded("content").alias("text")).where("text is not null")


def _quoted(text: str) -> str:
    return r"\Q" + text + r"\E"


def corpus_paths(spark: SparkSession, root: str, limit: int | None = None) -> DataFrame:
    """``(path)`` of the text files below ``root`` in order; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").load(root).select("path").orderBy("path")
    return files if limit is None else files.limit(limit)


def read_jsonl(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """``(path, title, text)`` of JSON Lines with string ``url``, ``title`` and ``text``; ``path`` is the path of the URL.

    Lines are split over tasks, however long a file is, and read JVM-side; blank ones are skipped. A line that is no JSON
    object, or whose fields aren't strings, is an error with its number in its file, which is looked for only then.
    ``limit`` takes the first lines.
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    if limit is not None:
        lines = lines.limit(limit)
    bare = F.regexp_replace("value", "^\ufeff", "")
    whole = F.try_parse_json(bare)
    get = lambda name: F.try_variant_get(whole, f"$.{name}", "string")
    is_text = lambda name: F.coalesce(F.schema_of_variant(F.try_variant_get(whole, f"$.{name}", "variant")) == "STRING", F.lit(False))
    good = F.coalesce(F.schema_of_variant(whole).startswith("OBJECT") & is_text("url") & is_text("title") & is_text("text"), F.lit(False))
    if bad := lines.where(~good).select("value").limit(1).collect():
        raise ValueError(f"line {_line_number(spark, path, bad[0][0])}: url, title and text must be strings of a JSON object")
    place = F.regexp_extract(get("url"), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    return lines.select(place.alias("path"), get("title").alias("title"), get("text").alias("text"))


def _line_number(spark: SparkSession, path: str, line: str) -> int:
    """The first number, from 1, that a line has in a file that holds it."""
    files = spark.read.format("binaryFile").load(path).select(F.split(F.decode("content", "UTF-8"), r"\r?\n").alias("lines"))
    return files.select(F.array_position("lines", line).alias("n")).where("n > 0").agg(F.min("n")).first()[0]


def read_corpus(spark: SparkSession, root: str, on_error: str = "skip", limit: int | None = None) -> DataFrame:
    """A ``.jsonl`` file or a folder of text files; ``limit`` takes the first of them."""
    return read_jsonl(spark, root, limit) if root.endswith(".jsonl") else read_text_files(spark, root, on_error, limit)


def numbered(documents: DataFrame, start: int = 0) -> DataFrame:
    """``documents`` with a dense ``doc_id`` from ``start`` in order of path, equal paths by text.

    Numbers come from range partitions and the counts of those before, so no task sees all rows.
    """
    spread = written(documents.repartitionByRange("path", "text").withColumn("_part", F.spark_partition_id()), "numbered")
    sizes = spread.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy("path", "text"))
    return spread.join(F.broadcast(before), "_part").withColumn("doc_id", (own + F.col("_before") + (start - 1)).cast("long")).drop("_part", "_before")


def write_jsonl(rows: DataFrame, path: str) -> None:
    """Results or pages as JSON Lines, one file a partition."""
    rows.write.json(path)
