"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}
#: A join key is heavy if it holds more than LEAST rows and more than 1 / HEAVY of them.
HEAVY, LEAST = 4096, 1 << 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table by name."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder the session names in spark.checkpoint.dir; only a local session without it gets a temporary one, removed at the end."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if sc.applicationId not in _own:
            _own[sc.applicationId] = tempfile.mkdtemp(prefix="quern-checkpoint-")
            atexit.register(shutil.rmtree, _own[sc.applicationId], ignore_errors=True)
        named = _own[sc.applicationId]
    return named


class Passing:
    """A scope: tables `written` in it are removed at its end, but for those to `keep`, which pass to the scope around it, if any."""

    def __init__(self) -> None:
        self.made: list[tuple[DataFrame, str]] = []
        self.kept: list[DataFrame] = []

    def keep(self, df: DataFrame) -> DataFrame:
        self.kept.append(df)
        return df

    def __enter__(self) -> Passing:
        self.token = _scope.set(self)
        return self

    def __exit__(self, *error: object) -> None:
        _scope.reset(self.token)
        for df, path in self.made:
            if not any(df is x for x in self.kept):
                sc = df.sparkSession.sparkContext
                at = sc._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)
            elif around := _scope.get():
                around.made.append((df, path))


_scope: ContextVar[Passing | None] = ContextVar("passing", default=None)


def written(df: DataFrame) -> DataFrame:
    """`df` written as Parquet to the shared folder and read again; its size is that of the files.

    A checkpoint keeps its plan's estimate, in which a join has the product of its inputs' sizes. Where joins of checkpoints
    follow each other, the digits of that number double with each, up to the driver's memory; so such tables are written.
    """
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/quern-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    if scope := _scope.get():
        scope.made.append((out, path))
    return out


@contextmanager
def arrow_rows(spark: SparkSession, most: int) -> Iterator[None]:
    """What runs inside sends at most so many rows to a Python worker at once; JVM and worker hold a batch of whole texts each."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if 0 < int(before) < most:
        most = int(before)
    spark.conf.set(key, str(most))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage of `df` with a reliable checkpoint.

    The folder is the one the session names in spark.checkpoint.dir, which driver and
    executors share; lost executors lose nothing. Only a session without that setting
    (a local test) gets a temporary folder.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def maybe_broadcast(df: DataFrame, rows: int, most: int) -> DataFrame:
    """`df` with a broadcast hint if its counted `rows` are at most `most`; else a shuffled join is left to AQE."""
    return F.broadcast(df) if rows <= most else df


def spread_join(rows: DataFrame, one: DataFrame, key: str, how: str = "inner", total: int | None = None) -> DataFrame:
    """`rows`, of which there are `total`, joined on `key` with `one`, which has at most one row of fixed width for a key. Both are read more than once.

    Keys that hold more than LEAST rows and more than 1 / HEAVY of all are joined map-side; there are at most HEAVY of
    them, so what is broadcast is bounded. So no shuffle key holds more than the larger of the two. `how` is inner or left.
    """
    total = rows.count() if total is None else total
    if total <= LEAST:
        return rows.join(one, key, how)
    most = max(LEAST, total // HEAVY)
    heavy = written(rows.groupBy(key).agg(F.count("*").alias("_rows")).where(F.col("_rows") > most).select(key))
    if heavy.isEmpty():
        return rows.join(one, key, how)
    hot = rows.join(F.broadcast(written(heavy.join(one, key, how))), key)
    return hot.unionByName(rows.join(F.broadcast(heavy), key, "left_anti").join(one, key, how))


def text_slices(column, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours in an Arrow string column that hold about `most` bytes together."""
    import pyarrow.compute as pc

    a = total = 0
    sizes = pc.binary_length(column).to_pylist()
    for b, n in enumerate(sizes):
        if b > a and total + (n or 0) > most:
            yield a, b
            a, total = b, 0
        total += n or 0
    if sizes:
        yield a, len(sizes)


def trim_memory() -> None:
    """Give freed memory back to the system, which the C library keeps otherwise."""
    import ctypes

    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def release_memory() -> None:
    """Give memory that a Python worker no longer uses back to the system, since idle workers stay."""
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim_memory()
