"""Reciprocal rank fusion of result lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value.
K = 60
RECORD = ("path", "heading", "snippet")


def ranked(hits: DataFrame, ordinal: int) -> DataFrame:
    """`hits` of one method, already cut to its best, with ranks from 1 and the list's place."""
    w = Window.partitionBy("method").orderBy(F.desc("score"), "chunk_id")
    return hits.withColumn("rank", F.row_number().over(w)).withColumn("ordinal", F.lit(ordinal))


def fuse(lists: list[DataFrame], limit: int = 10) -> DataFrame:
    """Hits by chunk: the sum of 1 / (K + rank), rounded before it sorts; the record of the first list wins; methods in order of lists.

    Ties go by list, then rank, as lists are stacked.
    """
    both = None
    for k, hits in enumerate(lists):
        r = ranked(hits, k)
        both = r if both is None else both.unionByName(r)
    one = both.groupBy("chunk_id").agg(
        F.round(F.sum(1.0 / (K + F.col("rank"))), 4).alias("score"),
        F.min(F.struct("ordinal", "rank", *RECORD)).alias("first"),
        F.transform(F.array_sort(F.collect_set(F.struct("ordinal", "method"))), lambda x: x["method"]).alias("methods"),
    )
    cols = [F.col(f"first.{c}").alias(c) for c in RECORD]
    top = one.select("chunk_id", *cols, "score", F.lit("combined").alias("method"), "methods", F.col("first.ordinal").alias("o"), F.col("first.rank").alias("r"))
    return top.orderBy(F.desc("score"), "o", "r").limit(max(0, limit)).drop("o", "r")


def hybrid(lexical: DataFrame, semantic: DataFrame | None, limit: int = 10, both: bool = True) -> tuple[DataFrame, bool]:
    """(hits, degraded): fusion, or the lexical list alone with a flag where vectors are unavailable."""
    if semantic is None:
        return lexical, True
    return (fuse([lexical, semantic], limit) if both else semantic), False
