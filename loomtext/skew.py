"""Joins of rows with one row a key that hold however unevenly the rows spread over the keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if it has at least 1/HOT of all rows. As the rows of all keys add up to all rows, at most HOT keys are.
HOT = 1000


def join_per_key(rows: DataFrame, per_key: DataFrame, keys: list[str], n: str) -> DataFrame:
    """Inner join of ``rows`` with ``per_key``, one row a key that counts the key's rows in column ``n``.

    Rows of hot keys stay where they are and meet a broadcast of at most :data:`HOT` rows; all others are shuffled by key,
    where no key has more than 1/HOT of the rows. ``per_key`` is computed twice, so it should be cheap or written.
    """
    total = per_key.agg(F.sum(n).alias("_total"))
    ranked = per_key.crossJoin(F.broadcast(total))
    is_hot = F.col(n) * HOT >= F.col("_total")
    hot = F.broadcast(ranked.where(is_hot).drop("_total"))
    cold = ranked.where(~is_hot).drop("_total")
    return rows.join(hot, keys).unionByName(rows.join(F.broadcast(ranked.where(is_hot).select(*keys)), keys, "left_anti").join(cold, keys))


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` of a scan over at least as many partitions as there are cores, for work that costs much more than the read.

    A large table has more than that and stays as it is; only tables of a few splits are dealt out again.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)
