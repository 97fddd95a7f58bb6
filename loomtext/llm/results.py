"""Cleaning of scored search results, shared by rank fusion and top-N."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sortable(score: Column) -> Column:
    """A double as a long that orders the same way; -0.0 counts as 0.0. Null stays null."""
    bits = F.reflect(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), F.coalesce(score, F.lit(0.0)) + F.lit(0.0)).cast("long")
    code = F.when(bits < 0, bits.bitwiseXOR(F.lit(2**63 - 1))).otherwise(bits)
    return F.when(score.isNotNull(), code)


def valid_results(results: DataFrame) -> DataFrame:
    """``(query_id, scorer, doc_id, last)`` of the rows without a null key and with a score neither null nor NaN.

    ``last`` is ``(scored_at, score)``: the greatest of a key is its latest row, a null ``scored_at`` being the earliest
    and, of rows scored at one moment, the higher score counting.
    """
    keys = " and ".join(f"{k} is not null" for k in ("query_id", "scorer", "doc_id"))
    last = F.struct("scored_at", F.col("score").cast("double").alias("score"))
    return results.where(f"{keys} and score is not null and not isnan(score)").select("query_id", "scorer", "doc_id", last.alias("last"))


def latest_valid(results: DataFrame) -> DataFrame:
    """One row ``(query_id, scorer, doc_id, score)`` per key: of its valid rows the latest.

    Copies collapse map-side before the shuffle. Other columns are ignored; an empty table gives no rows.
    """
    latest = valid_results(results).groupBy("query_id", "scorer", "doc_id").agg(F.max("last").alias("last"))
    return latest.select("query_id", "scorer", "doc_id", F.col("last.score").alias("score"))
