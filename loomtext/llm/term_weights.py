"""How distinctive a term is of a record: probabilistic relevance weights (BM25) over the whole collection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.postings import valid_postings
from loomtext.scratch import written
from loomtext.skew import join_per_key


def term_weights(postings: DataFrame, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """``(doc_id, term, tf, df, length, weight)`` for every document and term with a valid posting.

    ``weight = ln(1 + (N - df + .5) / (df + .5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / average))``; ``N`` is
    the number of documents with a valid posting, ``length`` the sum of a document's ``tf`` (stored lengths may be
    stale). Invalid, repeated and empty input is treated as :func:`valid_postings` says.
    """
    if not k1 > 0 or not 0 <= b <= 1:
        raise ValueError("k1 must be above 0 and b within 0 and 1")
    rows = written(valid_postings(postings), "weights-postings")
    length = written(rows.groupBy("doc_id").agg(F.sum("tf").alias("length"), F.count("*").alias("terms")), "weights-lengths")
    frequency = written(rows.groupBy("term").agg(F.count("*").alias("df")), "weights-frequency")
    whole = length.agg(F.count("*").alias("n"), F.avg("length").alias("average"))
    # neither a term in most documents nor a document with most terms meets one task; one join is done before the other begins
    sized = written(join_per_key(rows, length, ["doc_id"], "terms").select("doc_id", "term", "tf", "length"), "weights-sized")
    parts = join_per_key(sized, frequency, ["term"], "df").crossJoin(F.broadcast(whole))
    idf = F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    saturation = F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("average"))
    return parts.select("doc_id", "term", "tf", "df", "length", (idf * F.col("tf") * (k1 + 1) / saturation).alias("weight"))


def most_distinctive(postings: DataFrame, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """``(doc_id, term, weight)``: of each document its heaviest term, of equal ones the first in code point order.

    The choice is a mergeable aggregate, so a document with any number of terms is never gathered in one task.
    """
    w = term_weights(postings, k1, b).select("doc_id", (-F.round("weight", 9)).alias("minus"), "term")
    best = w.groupBy("doc_id").agg(F.min(F.struct("minus", "term")).alias("best"))
    return best.select("doc_id", "best.term", (-F.col("best.minus")).alias("weight"))
