"""The catalog of files: filters, snapshots, differences and their consequences for chunks and vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import suffix

#: Image suffixes, least image size, mark for retry.
IMAGES = (".png", ".jpg", ".jpeg", ".webp", ".gif", ".bmp", ".tif", ".tiff")
LEAST_IMAGE = 8192
RETRY = -1


def wanted_suffix(files: DataFrame, suffixes) -> DataFrame:
    return files.where(suffix(F.col("path")).isin(*suffixes))


def outside_skipped(files: DataFrame, root: str, skip) -> DataFrame:
    """Files with no directory below the root whose name is skipped."""
    below = F.substring("path", len(root.rstrip("/")) + 2, 1 << 30)
    folders = F.slice(F.split(below, "/"), F.lit(1), F.greatest(F.size(F.split(below, "/")) - 1, F.lit(0)))
    return files.where(~F.arrays_overlap(folders, F.array(*[F.lit(s) for s in skip])))


def image_gate(files: DataFrame, opted_in) -> DataFrame:
    """Without small images, and without images from roots that did not opt in."""
    image = suffix(F.col("path")).isin(*IMAGES)
    return files.where(~image | ((F.col("size") >= LEAST_IMAGE) & F.col("directory").isin(*opted_in)))


def under(path: Column, prefix: str) -> Column:
    """Whether a path lies below a directory; a sibling whose name only begins alike does not."""
    return path.startswith(prefix.rstrip("/") + "/")


def merged_roots(scans: list[DataFrame]) -> DataFrame:
    """One row per path; where roots overlap, the later root names the directory."""
    every = None
    for k, s in enumerate(scans):
        s = s.withColumn("ordinal", F.lit(k))
        every = s if every is None else every.unionByName(s)
    w = Window.partitionBy("path").orderBy(F.desc("ordinal"))
    return every.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k", "ordinal")


def snapshot_diff(stored: DataFrame, current: DataFrame, full: bool = False, protect: DataFrame | None = None) -> DataFrame:
    """(path, action): new, changed, removed or same, by the pair of time and size.

    `full` takes every current file as changed. Files of the roots in `protect` (directory), such as missing ones, are never removed.
    """
    s = stored.select("path", F.col("directory").alias("sd"), F.struct("mtime_ns", "size").alias("old"))
    c = current.select("path", F.struct("mtime_ns", "size").alias("new"))
    both = s.join(c, "path", "full_outer")
    if protect is not None:
        both = both.join(F.broadcast(protect.select(F.col("directory").alias("sd"), F.lit(True).alias("kept"))), "sd", "left")
    else:
        both = both.withColumn("kept", F.lit(None).cast("boolean"))
    changed = F.lit(True) if full else ~F.col("old").eqNullSafe(F.col("new"))
    action = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), F.when(F.col("kept"), "same").otherwise("removed")).when(changed, "changed").otherwise("same")
    return both.select("path", action.alias("action"))


def survivors(chunks: DataFrame, diff: DataFrame) -> DataFrame:
    """Chunks of files that are neither changed nor removed."""
    gone = diff.where(F.col("action").isin("changed", "removed")).select(F.col("path").alias("file_path"))
    return chunks.join(gone, "file_path", "left_anti")


def without_root(rows: DataFrame, files: DataFrame, root: str, key: str = "file_path") -> DataFrame:
    """Rows whose file does not belong to the root."""
    return rows.join(files.where(F.col("directory") == root).select(F.col("path").alias(key)), key, "left_anti")


def root_named(roots: list[str], name: str) -> str | None:
    """The root that a user means: exactly, or the first that ends with it."""
    return name if name in roots else next((r for r in roots if r.endswith(name)), None)


def marked_for_retry(files: DataFrame, chunks: DataFrame, failed: DataFrame) -> DataFrame:
    """`files` with the retry mark on those that hold a failed chunk."""
    hit = chunks.join(failed.select("chunk_id"), "chunk_id", "left_semi").select(F.col("file_path").alias("path")).distinct().withColumn("hit", F.lit(True))
    out = files.join(hit, "path", "left")
    return out.withColumn("mtime_ns", F.when(F.col("hit"), F.lit(RETRY)).otherwise(F.col("mtime_ns"))).drop("hit")


def upserted(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last write of each key."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")


def meta_value(meta: DataFrame, key: str, default: int) -> DataFrame:
    """One row: the integer under a key, or the default where it is absent or no number."""
    return meta.where(F.col("key") == key).agg(F.max("value").alias("v")).select(F.coalesce(F.expr("try_cast(v AS INT)"), F.lit(default)).alias("value"))


def after_model_change(vectors: DataFrame, meta: DataFrame, model: str) -> DataFrame:
    """`vectors`, or none of them if another model made them."""
    same = meta.where((F.col("key") == "embed_model") & (F.col("value") == model)).select(F.lit(1).alias("ok")).limit(1)
    known = meta.where(F.col("key") == "embed_model").agg(F.count("*").alias("n"))
    # two rows of one number at most
    return vectors.crossJoin(F.broadcast(known)).join(F.broadcast(same), F.lit(True), "left").where("n = 0 or ok = 1").drop("n", "ok")


def truncation_warning(meta: DataFrame, vectors: DataFrame, limit: int = 8000, old: int = 2000) -> DataFrame:
    """One row: the cut that stored vectors were made with, and whether it is shorter than today's."""
    at = meta_value(meta, "embed_max_chars", old)
    n = vectors.agg(F.count("*").alias("n"))
    return at.crossJoin(F.broadcast(n)).select(F.col("value").alias("made_with"), ((F.col("n") > 0) & (F.col("value") < limit)).alias("warn"))
