"""Cleaning of raw index entries, shared by term counting and term weighting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.functions.text import normal_form


def valid_postings(postings: DataFrame) -> DataFrame:
    """One row ``(doc_id, term, tf)`` per document and term in normal form.

    Rows whose term, document or ``tf`` is null, or whose ``tf`` is not above 0, are left out. Exact repeats of a row
    (its positions included, by their 64-bit hash) count once; the ``tf`` of several forms of a term in a document add
    up. A table without ``positions`` is taken to have none. Columns beside these are ignored; an empty table gives no
    rows. Repeats collapse map-side before the first shuffle, so a row copied any number of times is no hot key.
    """
    places = F.xxhash64("positions") if "positions" in postings.columns else F.lit(0)
    rows = (
        postings.where("term is not null and doc_id is not null and tf > 0")
        .select("doc_id", "term", F.col("tf").cast("long").alias("tf"), places.alias("places"))
        .distinct()
    )
    return (
        rows.select("doc_id", normal_form(F.col("term")).alias("term"), "tf")
        .groupBy("doc_id", "term")
        .agg(F.sum("tf").alias("tf"))
    )
