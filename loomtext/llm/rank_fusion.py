"""One ranking from several differently-scaled scores, by distance to an ideal and an anti-ideal point."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtext.llm.results import valid_results
from loomtext.scratch import written
from loomtext.skew import join_per_key

#: More scorers than this are taken for a mistake: each is a column of the plan.
MOST_SCORERS = 64


def quantile_rows(rows: DataFrame, keys: list[str], value: str, levels: list[float]) -> DataFrame:
    """``(*keys, level, value)``: of every group exactly the value at place ``ceil(level * rows)``, at least the first; ``level`` counts
    from 0.

    Groups of any size: rows are range-sorted by key and value, so a hot group lies in several partitions, of which only
    counts are added up; the wanted rows are then found by their place in the order.
    """
    order = [*keys, value]
    placed = rows.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
    placed = written(placed, "quantile-rows")
    runs = placed.groupBy(*keys, F.shiftright("_place", 33).alias("_part")).agg(F.min("_place").alias("_first"), F.count("*").alias("_n"))
    whole = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("_n").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(*keys, "_first", "_n", before.alias("_before"), F.sum("_n").over(whole).alias("_all"))
    wanted = F.posexplode(F.array(*(F.greatest(F.ceil(F.lit(q) * F.col("_all")), F.lit(1)) for q in levels))).alias("level", "_at")
    at = runs.select("_first", "_n", "_before", wanted).where((F.col("_at") > F.col("_before")) & (F.col("_at") <= F.col("_before") + F.col("_n")))
    return placed.join(at.select((F.col("_first") + F.col("_at") - F.col("_before") - 1).alias("_place"), "level"), "_place").select(*keys, "level", value)


def combined_order(results: DataFrame, winsor: tuple[float, float] = (0.05, 0.95), weights: dict[str, float] | None = None, top: int | None = None) -> DataFrame:
    """``(query_id, doc_id, closeness)``; with ``top``, the first ``top`` of each query and their ``place``.

    The order of a query is ``closeness`` descending, then ``doc_id``. Per query and scorer, scores are clipped to the
    exact ``winsor`` quantiles, centred on their mean and divided by the norm of the centred vector, so neither the scale
    of a scorer nor where its zero lies counts. The ideal point has each scorer's best value, the anti-ideal its worst; a
    document without a valid score has the worst. Distances to both are Euclidean, each scorer weighted (default 1); a
    scorer that gives all documents the same value doesn't count. ``closeness`` is 0 to 1, and 0.5 where no scorer tells
    documents apart.

    Which rows are valid and which of several counts: :func:`loomtext.llm.results.valid_results`. Further columns are
    ignored; an empty table gives no rows.
    """
    low, high = winsor
    if not 0 <= low < high <= 1:
        raise ValueError("winsor must be two quantiles in order")
    valid = valid_results(results)
    scorers = sorted(r[0] for r in valid.select("scorer").distinct().limit(MOST_SCORERS + 1).collect())
    if len(scorers) > MOST_SCORERS:
        raise ValueError(f"more than {MOST_SCORERS} scorers")
    if not scorers:
        valid, scorers = valid.limit(0), [""]
    names = [f"s{i}" for i in range(len(scorers))]
    weight = [float((weights or {}).get(s, 1.0)) for s in scorers]
    one = valid.groupBy("query_id", "doc_id").agg(*(F.max(F.when(F.col("scorer") == s, F.col("last"))).alias(c) for s, c in zip(scorers, names)))
    table = written(one.select("query_id", "doc_id", *(F.col(c)["score"].alias(c) for c in names)), "fusion-scores")

    each = table.select("query_id", F.posexplode(F.array(*names)).alias("scorer", "score")).where("score is not null")
    bounds = quantile_rows(each, ["query_id", "scorer"], "score", [low, high])
    at = lambda i, level: F.max(F.when((F.col("scorer") == i) & (F.col("level") == level), F.col("score")))
    per_query = bounds.groupBy("query_id").agg(*(at(i, k).alias(f"{c}_{k}") for i, c in enumerate(names) for k in (0, 1)))
    sizes = table.groupBy("query_id").agg(F.count("*").alias("n"))
    bounded = join_per_key(table, written(sizes.join(per_query, "query_id", "left"), "fusion-bounds"), ["query_id"], "n")
    clip = lambda c: F.coalesce(F.least(F.greatest(F.col(c), F.col(f"{c}_0")), F.col(f"{c}_1")), F.col(f"{c}_0"), F.lit(0.0))
    clipped = bounded.select("query_id", "doc_id", *(clip(c).alias(c) for c in names))
    points = clipped.groupBy("query_id").agg(
        F.count("*").alias("n"),
        *(f(c).alias(f"{c}_{k}") for c in names for k, f in (("best", F.max), ("worst", F.min))),
        *((F.stddev_pop(c) * F.sqrt(F.count("*"))).alias(f"{c}_norm") for c in names),
    )
    both = join_per_key(clipped, written(points, "fusion-points"), ["query_id"], "n")

    def distance(end: str):
        # the mean, taken off before the division, cancels in the difference
        def part(c: str, w: float):
            away = (F.col(c) - F.col(f"{c}_{end}")) / F.col(f"{c}_norm")
            return F.when(F.col(f"{c}_best") > F.col(f"{c}_worst"), w * away * away).otherwise(F.lit(0.0))

        return F.sqrt(reduce(add, (part(c, w) for c, w in zip(names, weight))))

    far, near = distance("worst"), distance("best")
    closeness = F.round(F.when(far + near > 0, far / (far + near)).otherwise(F.lit(0.5)), 9)
    ranked = both.select("query_id", "doc_id", closeness.alias("closeness"))
    if top is None:
        return ranked
    order = Window.partitionBy("query_id").orderBy(F.desc("closeness"), "doc_id")
    return ranked.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)
