"""Exact dedup with a heavy-hitter split.

A frequent-items sketch (Misra-Gries counters, merged in two levels) proposes the digests that
hold a large share of the rows. Their exact counts are then taken, and the verified winners, at
most `tracked` rows, are broadcast so that their copies are settled map-side. Only the other
digests are shuffled, so no shuffle key holds more than about 3.5 / `tracked` of the rows; they are counted
map-side first, and no task holds a group: rows meet their group's one row of counts in a join that may be split.

Everything is DataFrame code. Null texts count as empty. Rows with a null doc_id take part and
rank below every other id. Of fully repeated rows exactly one is kept. An empty table gives an
empty result, and extra columns of any name pass through `drop_copies` untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import settle, text_or_empty

TRACKED = 1024
#: First-level merges of the partitions' sketches.
SALTS = 32


def frequent_digests(digests: DataFrame, tracked: int = TRACKED) -> DataFrame:
    """Digests that may be frequent, at most `tracked` rows: (digest). Input: (digest binary)."""
    level1 = (
        digests.select(F.hex("digest").alias("h"), (F.spark_partition_id() % SALTS).alias("salt"))
        .groupBy("salt")
        .agg(F.expr(f"approx_top_k_accumulate(h, {tracked})").alias("state"))
    )
    # Grouped, not global: a global aggregate also merges the empty sketches of empty partitions, which this function can't.
    level2 = level1.groupBy((F.col("salt") * 0).alias("all")).agg(F.expr(f"approx_top_k_combine(state, {tracked})").alias("state"))
    found = level2.select(F.explode(F.expr(f"approx_top_k_estimate(state, {tracked})")).alias("x"))
    return found.where("x.count > 1 and x.item is not null").select(F.unhex("x.item").alias("digest"))


def verified_winners(base: DataFrame, tracked: int = TRACKED) -> DataFrame:
    """Exact size and last row of each proposed digest: (digest, n, last struct<doc_id, uid>); at most `tracked` rows."""
    proposed = F.broadcast(frequent_digests(base.select("digest"), tracked))
    return (
        base.join(proposed, "digest")
        .groupBy("digest")
        .agg(F.count("*").alias("n"), F.max(F.struct("doc_id", "uid")).alias("last"))
        .where("n > 1")
    )


def digest_table(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, uid), settled; uid tells fully repeated rows apart."""
    return settle(
        docs.select(
            "doc_id",
            F.unhex(F.sha2(text_or_empty(), 256)).alias("digest"),
            F.monotonically_increasing_id().alias("uid"),
        )
    )


def exact_groups(docs: DataFrame, tracked: int = TRACKED) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    base = digest_table(docs)
    if base.isEmpty():
        winners = base.select("digest", F.lit(0).cast("long").alias("n"), F.struct("doc_id", "uid").alias("last"))
    else:
        winners = settle(verified_winners(base, tracked))
    heavy = base.join(F.broadcast(winners), "digest").select("doc_id", "uid", "digest", "n", "last")
    light = base.join(F.broadcast(winners.select("digest")), "digest", "left_anti").select("doc_id", "uid", "digest")
    sums = light.groupBy("digest").agg(F.count("*").alias("n"), F.max(F.struct("doc_id", "uid")).alias("last"))
    light = light.join(sums, "digest").select("doc_id", "uid", "digest", "n", "last")
    return heavy.unionByName(light).select(
        "doc_id",
        F.col("last.doc_id").alias("keep_id"),
        F.col("n").cast("long").alias("group_size"),
        (F.col("uid") == F.col("last.uid")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, tracked: int = TRACKED) -> DataFrame:
    """The rows of `docs` that stay, with all their columns.

    Copies of the broadcast winners go map-side; only rows with other digests are shuffled.
    """
    base = digest_table(docs)
    if base.isEmpty():
        return docs
    winners = settle(verified_winners(base, tracked)).select("digest", F.col("last.doc_id").alias("keep"), F.lit(True).alias("hot"))
    rows = docs.select(
        F.struct("*").alias("row"),
        F.col("doc_id").alias("doc_id"),
        F.unhex(F.sha2(text_or_empty(), 256)).alias("digest"),
    ).join(F.broadcast(winners), "digest", "left")
    heavy = rows.where(F.col("hot") & F.col("doc_id").eqNullSafe(F.col("keep"))).dropDuplicates(["digest"])
    last = Window.partitionBy("digest").orderBy(F.col("doc_id").desc_nulls_last())
    light = rows.where(F.col("hot").isNull()).withColumn("k", F.row_number().over(last)).where("k = 1")
    return heavy.select("row.*").unionByName(light.select("row.*"))


ORACLE = """
SELECT doc_id,
       max(doc_id) OVER g AS keep_id,
       count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
