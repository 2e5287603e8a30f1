"""Exact vector search and its upkeep."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0."""
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)


def normalised(vectors: DataFrame) -> DataFrame:
    """`vectors` with unit vectors; a zero vector stays as it is."""
    n = norm(F.col("vector"))
    return vectors.withColumn("norm", n).withColumn("unit", F.transform(doubles(F.col("vector")), lambda x: x / F.when(F.col("norm") == 0, 1.0).otherwise(F.col("norm")))).withColumn("dim", F.size("vector"))


def top_k(vectors: DataFrame, query: list[float], limit: int, allowed: DataFrame | None = None) -> DataFrame:
    """(chunk_id, score): the nearest vectors of the query's dimension, among allowed chunks; ties by chunk_id.

    The query is a literal, so the scan needs no join; a zero query or a limit below one finds nothing.
    """
    q = F.array(*[F.lit(float(x)) for x in query])
    rows = vectors.where(F.size("vector") == len(query))
    if allowed is not None:
        rows = rows.join(allowed.select("chunk_id").distinct(), "chunk_id", "left_semi")
    if limit < 1 or not any(query):
        rows = rows.limit(0)
    return rows.select("chunk_id", cosine(F.col("vector"), q).alias("score")).orderBy(F.desc("score"), "chunk_id").limit(max(0, limit))


def top_k_units(units: DataFrame, query: list[float], limit: int, allowed: DataFrame | None = None) -> DataFrame:
    """The same over stored unit vectors (chunk_id, unit): one product each, without norms."""
    length = float(np.sqrt(sum(float(x) ** 2 for x in query)))
    q = F.array(*[F.lit(float(x) / length if length else 0.0) for x in query])
    rows = units.where(F.size("unit") == len(query))
    if allowed is not None:
        rows = rows.join(allowed.select("chunk_id").distinct(), "chunk_id", "left_semi")
    if limit < 1 or not length:
        rows = rows.limit(0)
    return rows.select("chunk_id", dot(F.col("unit"), q).alias("score")).orderBy(F.desc("score"), "chunk_id").limit(max(0, limit))


def top_k_batch(vectors: DataFrame, query: list[float], limit: int) -> DataFrame:
    """The same by a matrix product on Arrow batches; each batch keeps its best `limit`."""
    q = np.asarray(query, np.float64)
    q = q / (np.linalg.norm(q) or 1.0)

    def run(batches):
        for pdf in batches:
            m = np.stack(pdf["vector"].to_numpy()).astype(np.float64) if len(pdf) else np.zeros((0, len(q)))
            n = np.linalg.norm(m, axis=1)
            s = m @ q / np.where(n == 0, 1.0, n)
            best = np.lexsort((pdf["chunk_id"].to_numpy(), -s))[:limit]
            yield pd.DataFrame({"chunk_id": pdf["chunk_id"].to_numpy()[best], "score": s[best]})

    rows = vectors.where(F.size("vector") == len(query)).select("chunk_id", "vector").mapInPandas(run, "chunk_id long, score double")
    return rows.orderBy(F.desc("score"), "chunk_id").limit(max(0, limit))


def fingerprint(vectors: DataFrame) -> DataFrame:
    """One row that changes with the table: count and largest id."""
    return vectors.agg(F.count("*").alias("n"), F.max("chunk_id").alias("last")).select("n", "last", F.concat_ws(":", F.col("n").cast("string"), F.coalesce(F.col("last").cast("string"), F.lit("-"))).alias("rev"))


def audit(vectors: DataFrame, cached: DataFrame, tolerance: float = 1e-5) -> DataFrame:
    """Rows of a cache (chunk_id, unit) that do not fit the table: missing, surplus, or off by more than the tolerance."""
    now = normalised(vectors).select("chunk_id", F.col("unit").alias("u"))
    both = now.join(cached.select("chunk_id", F.col("unit").alias("c")), "chunk_id", "full_outer")
    off = F.size("u") != F.size("c")
    far = F.exists(F.zip_with("u", "c", lambda x, y: F.abs(x - y) > tolerance), lambda x: x)
    fault = F.when(F.col("c").isNull(), "missing").when(F.col("u").isNull(), "surplus").when(off, "dimension").when(far, "changed")
    return both.select("chunk_id", fault.alias("fault")).where("fault is not null")


def pack_vector(v: Column) -> Column:
    """Little-endian float32 bytes, by a vectorised function."""
    @F.pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else np.asarray(x, "<f4").tobytes())

    return run(v)


def unpack_vector(b: Column) -> Column:
    @F.pandas_udf("array<float>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else np.frombuffer(x, "<f4"))

    return run(b)
