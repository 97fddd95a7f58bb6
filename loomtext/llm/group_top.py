"""Top N items within every group by simultaneous bisection of an order-preserving code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtext.llm.results import sortable
from loomtext.scratch import written
from loomtext.skew import HOT

#: A round tells 2**bits intervals of a group's code apart, that is, it makes so many bisections at once: the first one,
#: over all rows, fewer than those over the few rows left.
FIRST_BITS, BITS = 8, 12
#: Parts over which the rows of a hot group are spread.
SALTS = 32
_SIGN = -(2**63)
_MOST_ROUNDS = 2 * (64 // BITS + 1) + 1


def top_n(rows: DataFrame, by: list[str], score: str, item: str, n: int) -> DataFrame:
    """``(*by, item, score)``: of every group the ``n`` rows with the highest ``score``, equal scores by smaller ``item``.

    ``item`` is a long. Rows with a null or NaN score or a null item are left out, as are rows with a null group key; an
    item that occurs several times in a group counts once, with its highest score. Groups with fewer than ``n`` items
    are kept whole; an empty table gives no rows; other columns are dropped.

    A row's code is its score as an order-preserving long followed by the complement of its item, so no two rows of a
    group are equal. All groups refine their cutoff together: a round takes each group's lowest and highest undecided
    code, skips the bits they share and counts rows above each of the midpoints of the next bits. Rows
    above the interval that holds the cutoff are taken, those below dropped, and the rest goes on until every group holds
    exactly ``n``: at most 13 rounds, three or four as a rule. No group is ever gathered or sorted: hot ones (at most
    :data:`~loomtext.skew.HOT` by count) are spread over :data:`SALTS` parts, of which only counts are merged.
    """
    if type(n) is not int or n < 1:
        raise ValueError("n must be a positive whole number")
    usable = rows.where(reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in [*by, item, score])) & ~F.isnan(F.col(score).cast("double")))
    once = usable.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(by)), F.col(item).cast("long").alias("item"), F.col(score).cast("double").alias("score"))
    keys = [f"k{i}" for i in range(len(by))]
    once = written(once.groupBy(*keys, "item").agg(F.max("score").alias("score")), "top-rows")
    counted = once.groupBy(*keys).agg(F.count("*").alias("n"))
    hot = counted.crossJoin(F.broadcast(once.agg(F.count("*").alias("all")))).where(F.col("n") * HOT >= F.col("all"))
    open_ = once.join(F.broadcast(hot.select(*keys, F.lit(SALTS).alias("salts"))), keys, "left").select(
        *keys, "item", "score", F.coalesce("salts", F.lit(1)).alias("salts"), F.lit(n).alias("need")
    )
    taken = []
    for nth in range(_MOST_ROUNDS):
        decided = written(_round(open_, keys, BITS if nth else FIRST_BITS), "top-round")
        taken.append(decided.where("taken"))
        open_ = decided.where("not taken").drop("taken")
        if open_.isEmpty():
            break
    else:
        raise AssertionError("a group has two rows of one code")
    whole = reduce(DataFrame.unionByName, taken)
    return whole.select(*(F.col(k).alias(c) for k, c in zip(keys, by)), F.col("item").alias(item), F.col("score").alias(score))


def _round(open_: DataFrame, keys: list[str], bits: int) -> DataFrame:
    """The rows taken in this round, and the undecided ones with the number still to take of their group."""
    place = [*keys, "salt"]
    rows = open_.withColumn("salt", F.pmod(F.xxhash64("item"), F.col("salts")).cast("int")).repartition(*place)
    rows = rows.withColumns({"high": sortable(F.col("score")), "low": F.bitwise_not("item")})
    ends = [f(c).alias(f"{k}_{c}") for c in ("high", "low") for k, f in (("min", F.min), ("max", F.max))]
    again = [f(f"{k}_{c}").alias(f"{k}_{c}") for c in ("high", "low") for k, f in (("min", F.min), ("max", F.max))]
    group = rows.groupBy(*place).agg(F.count("*").alias("n"), F.max("salts").alias("salts"), F.max("need").alias("need"), *ends)
    group = group.groupBy(*keys).agg(F.sum("n").alias("n"), F.max("salts").alias("salts"), F.max("need").alias("need"), *again)
    on_high = F.col("min_high") < F.col("max_high")
    differ = F.when(on_high, F.col("min_high").bitwiseXOR(F.col("max_high"))).otherwise(F.col("min_low").bitwiseXOR(F.col("max_low")))
    width = F.length(F.bin(differ))
    group = group.select(*keys, "n", "salts", "need", on_high.alias("on_high"), F.greatest(width - bits, F.lit(0)).alias("shift"))
    spread = lambda d: d.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    code = F.when(F.col("on_high"), F.col("high")).otherwise(F.col("low")).bitwiseXOR(F.lit(_SIGN))
    interval = F.expr("shiftrightunsigned(code, shift)").bitwiseAND(F.lit(2**bits - 1)).cast("int")
    placed = rows.drop("need").join(spread(group).hint("shuffle_hash"), place)
    placed = placed.withColumn("code", code).withColumn("interval", F.when(F.col("n") <= F.col("need"), F.lit(0)).otherwise(interval))

    counts = placed.groupBy(*place, "interval").agg(F.count("*").alias("c"), F.max("need").alias("need"), F.max("n").alias("n"), F.max("salts").alias("salts"))
    counts = counts.repartition(*keys).groupBy(*keys, "interval").agg(F.sum("c").alias("c"), F.max("need").alias("need"), F.max("n").alias("n"), F.max("salts").alias("salts"))
    down = Window.partitionBy(*keys).orderBy(F.desc("interval"))
    counts = counts.withColumn("above", F.sum("c").over(down) - F.col("c"))
    cut = counts.where((F.col("above") < F.col("need")) & ((F.col("above") + F.col("c") >= F.col("need")) | (F.col("n") <= F.col("need"))))
    left = (F.col("need") - F.col("above")).cast("int")
    cut = cut.select(*keys, "salts", F.col("interval").alias("cut"), left.alias("left"), (F.col("c") <= left).alias("fits"))
    decided = placed.join(spread(cut).hint("shuffle_hash"), place).where(F.col("interval") >= F.col("cut"))
    is_taken = (F.col("interval") > F.col("cut")) | F.col("fits")
    return decided.select(*keys, "item", "score", "salts", F.col("left").alias("need"), is_taken.alias("taken"))
