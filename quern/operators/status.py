"""Counts about the store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def totals(files: DataFrame, chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row: files, chunks, embeddings."""
    one = lambda df, name: df.agg(F.count("*").alias(name))
    return one(files, "files").crossJoin(F.broadcast(one(chunks, "chunks"))).crossJoin(F.broadcast(one(vectors, "embeddings")))


def per_root(roots: DataFrame, files: DataFrame) -> DataFrame:
    """(directory, files) of every configured root, 0 where it has none."""
    n = files.groupBy("directory").agg(F.count("*").alias("files"))
    return roots.join(n, "directory", "left").select("directory", F.coalesce("files", F.lit(0)).alias("files"))


def coverage(files: DataFrame, chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """(path, chunks, embedded) of every file."""
    c = chunks.select(F.col("file_path").alias("path"), "chunk_id")
    v = vectors.select("chunk_id", F.lit(1).alias("has"))
    return files.select("path").join(c, "path", "left").join(v, "chunk_id", "left").groupBy("path").agg(F.count("chunk_id").alias("chunks"), F.count("has").alias("embedded"))


def missing_embeddings(chunks: DataFrame, vectors: DataFrame, least: int) -> DataFrame:
    """Chunks that are long enough to embed and have no vector."""
    from quern.functions.text import strip

    return chunks.where(F.length(strip(F.col("content"))) >= least).join(vectors.select("chunk_id"), "chunk_id", "left_anti")


def meta_map(meta: DataFrame) -> DataFrame:
    return meta.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "value")))).alias("meta"))


def report(roots: DataFrame, files: DataFrame, chunks: DataFrame, vectors: DataFrame, meta: DataFrame) -> DataFrame:
    """One status record."""
    rows = per_root(roots, files).agg(F.sort_array(F.collect_list(F.struct("directory", "files"))).alias("directories"))
    return totals(files, chunks, vectors).crossJoin(F.broadcast(rows)).crossJoin(F.broadcast(meta_map(meta)))
