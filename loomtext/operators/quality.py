"""Retrieval quality over judged queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def precision_at_k(results: DataFrame, relevant: DataFrame, k: int = 5, by: list[str] | None = None) -> DataFrame:
    """``(query_id, *by, hits, precision)`` of every judged query: relevant documents among its first ``k``, over ``k`` always.

    ``results`` is ``(query_id, doc_id, score)``, ordered by score descending and ``doc_id``; ``relevant`` is
    ``(query_id, doc_id)``. ``by`` names further columns of ``results``, such as the scorer, whose values are evaluated
    apart; they are few. A judged query without results has precision 0. The first ``k`` are cut map-side before the
    shuffle by query, as Spark limits ranks within groups.
    """
    by = by or []
    order = Window.partitionBy("query_id", *by).orderBy(F.desc("score"), "doc_id")
    first = results.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("query_id", *by, "doc_id")
    hits = first.join(relevant.select("query_id", "doc_id").distinct(), ["query_id", "doc_id"]).groupBy("query_id", *by).agg(F.count("*").alias("hits"))
    judged = relevant.select("query_id").distinct()
    if by:
        values = results.select(*by).distinct().agg(F.collect_list(F.struct(*by)).alias("_by"))
        judged = judged.crossJoin(F.broadcast(values)).select("query_id", F.explode("_by").alias("_by")).select("query_id", "_by.*")
    found = judged.join(hits, ["query_id", *by], "left")
    return found.select("query_id", *by, F.coalesce("hits", F.lit(0)).alias("hits"), (F.coalesce("hits", F.lit(0)) / F.lit(float(k))).alias("precision"))


def mean_precision(per_query: DataFrame) -> DataFrame:
    return per_query.agg(F.avg("precision").alias("mean_precision"), F.count("*").alias("queries"))
