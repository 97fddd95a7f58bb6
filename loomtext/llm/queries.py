"""The registered queries of this subpackage; each takes the session and a folder of Parquet tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm.boilerplate import main_body
from loomtext.llm.group_top import top_n
from loomtext.llm.leaks import leaked, without_leaks
from loomtext.llm.neighbours import similar_vectors
from loomtext.llm.packing import containers
from loomtext.llm.rank_fusion import combined_order
from loomtext.llm.results import latest_valid
from loomtext.llm.sentences import sentences
from loomtext.llm.splitting import oversized, split_oversized
from loomtext.llm.term_counts import TermCounts
from loomtext.llm.term_weights import most_distinctive, term_weights
from loomtext.skew import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """Columns of a table whose texts take much work, over all cores."""
    return spread(table(spark, folder, name).select(*columns))


def _counted(spark: SparkSession, folder: str) -> TermCounts:
    """The index arrives in two deltas: the even build batches of 500 documents, then the odd ones."""
    postings = table(spark, folder, "postings").where("doc_id is not null")
    odd = F.pmod(F.expr("doc_id div 500"), F.lit(2)) == 1
    return TermCounts(spark).apply(upserts=postings.where(~odd)).apply(upserts=postings.where(odd))


@query
def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return _counted(spark, folder).marked().where("mark is not null").select("term", "mark")


@query
def p1_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Every term's counts after documents were also deleted, changed and put back."""
    postings = table(spark, folder, "postings").where("doc_id is not null")
    third = F.pmod("doc_id", F.lit(3))
    counts = _counted(spark, folder).apply(
        upserts=postings.where(third == 1).withColumn("tf", F.col("tf") + 5),
        deletes=postings.where(third == 0).select("doc_id"),
    )
    return counts.apply(upserts=postings.where(third < 2)).counts()


@query
def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return combined_order(table(spark, folder, "results"), top=3).select("query_id", "doc_id")


@query
def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return main_body(texts(spark, folder, "pages", "page_id", "url", "title", "text")).select("page_id", "line_no")


@query
def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    near = similar_vectors(table(spark, folder, "passages"), "passage_id", "embedding", dim=64, k=5, least=0.86)
    pair = [F.least("item", "other").alias("passage_id_a"), F.greatest("item", "other").alias("passage_id_b")]
    return near.select(*pair).distinct()


@query
def p4_nearest(spark: SparkSession, folder: str) -> DataFrame:
    """The five nearest, however far, of every passage whose id is divisible by 100, against all: far neighbours need a wide window."""
    passages = table(spark, folder, "passages")
    return similar_vectors(passages, "passage_id", "embedding", dim=64, k=5, window=1024, asks=F.col("passage_id") % 100 == 0)


@query
def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return most_distinctive(table(spark, folder, "postings")).select("doc_id", "term")


@query
def p5_weights(spark: SparkSession, folder: str) -> DataFrame:
    return term_weights(table(spark, folder, "postings")).withColumn("weight", F.round("weight", 6))


def _both(f, spark: SparkSession, folder: str) -> DataFrame:
    documents = f(table(spark, folder, "documents"), "doc_id", "text")
    passages = f(table(spark, folder, "passages"), "passage_id", "passage")
    return documents.withColumn("kind", F.lit("document")).unionByName(passages.withColumn("kind", F.lit("passage")))


@query
def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return _both(oversized, spark, folder).select("kind", "item_id", "cut")


@query
def p6_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return _both(split_oversized, spark, folder)


@query
def p6_audit(spark: SparkSession, folder: str) -> DataFrame:
    """What has to hold of every item's pieces: the limit, the overlap, no gap, and no neighbours that would fit into one."""
    items = _both(oversized, spark, folder)
    p, later = F.col("pieces"), F.sequence(F.lit(1), F.size("pieces") - 1)
    end = lambda i: F.coalesce(F.get(p, i)["end"], F.lit(0))
    count = lambda test: F.size(F.filter(later, test))
    return items.select(
        "kind", "item_id",
        F.size(F.filter(p, lambda x: x["end"] - x["start"] > 2000)).alias("over_limit"),
        count(lambda i: p[i]["start"] != F.greatest(end(i - 1) - 200, F.lit(0))).alias("wrong_overlap"),
        count(lambda i: end(i) - end(i - 2) <= 1800).alias("would_fit"),
        F.element_at(p, -1)["end"].cast("long").alias("characters"),
    )


@query
def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    best = top_n(latest_valid(table(spark, folder, "results")), ["query_id", "scorer"], "score", "doc_id", 10)
    return best.select("query_id", "scorer", "doc_id")


@query
def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    return containers(texts(spark, folder, "documents", "doc_id", "text"))


@query
def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaked(texts(spark, folder, "documents", "doc_id", "text"), table(spark, folder, "eval_items")).select("doc_id", "item_id").distinct()


@query
def p9_cleaned(spark: SparkSession, folder: str) -> DataFrame:
    """What stays of every document after leaked spans are cut out."""
    documents = texts(spark, folder, "documents", "doc_id", "text")
    return without_leaks(documents, leaked(documents, table(spark, folder, "eval_items")))


@query
def p9_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """How many words every document has, and how many of them are leaked."""
    return p9_cleaned(spark, folder).select("doc_id", "words", "leaked_words")


@query
def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return sentences(texts(spark, folder, "documents", "doc_id", "text"))
