"""Incremental indexing as a stream: new files become chunks and postings in micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.lexicon import tokenised
from quern.session import shared_folder


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def index_new_files(spark: SparkSession, source: str, target: str, checkpoint: str, files_per_batch: int = 20) -> None:
    """Read what arrived at `source` since the last run, and append its chunks to `target`, a folder a batch.

    A batch that is repeated after a failure overwrites its own folder, so nothing is indexed twice.
    """
    schema = spark.read.parquet(source).schema
    folder, glob = (source, "*.parquet") if _is_folder(spark, source) else source.rsplit("/", 1)

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.select(F.col("doc_id").alias("chunk_id"), F.concat_ws(" ", "lang", "source").alias("heading"), F.col("text").alias("content"))
        tokenised(rows).select("chunk_id", "heading_tokens", "content_tokens").write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", glob).parquet(folder)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def indexed_by_stream(spark: SparkSession, source: str) -> DataFrame:
    """One row: chunks and content tokens that a run over all of `source` indexed. A second run finds nothing new."""
    folder = shared_folder(spark)
    for _ in range(2):
        index_new_files(spark, source, f"{folder}/index", f"{folder}/checkpoint")
    t = spark.read.parquet(f"{folder}/index")
    return t.agg(F.count("*").alias("chunks"), F.sum(F.size("content_tokens")).cast("long").alias("tokens"))
