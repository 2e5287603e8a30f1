"""The store: immutable tables in a folder, and numbered generations that name the folder of each table.

A generation is a small file that becomes current by one rename to the next number, so readers never see half a
write and nothing that is being read is overwritten; a run that dies between leaves the one before in place. Tables that a generation
does not change are named again, not copied. Works on any file system Spark writes to.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.embedders import Embedder, embedded
from quern.functions.text import MAX_EMBED, MIN_EMBED, embed_text, iso_now, strip
from quern.operators import catalog as C
from quern.operators import chunking as K
from quern.operators import lexicon as L
from quern.operators import vectors as V
from quern.operators.ranking import SearchIndex

SCHEMAS = {
    "files": "path string, directory string, mtime_ns long, size long",
    "chunks": "chunk_id long, file_path string, chunk_index int, heading string, content string",
    "embeddings": "chunk_id long, vector array<float>",
    "units": "chunk_id long, unit array<float>",
    "meta": "key string, value string",
    "postings": "term string, chunk_id long, col string, positions array<int>, tf long, length int",
    "stats": "n long, words long",
    "lengths": "chunk_id long, len_content int, len_heading int",
}


#: Tables that are looked up by a key. Chunks are cut into ranges, which are sampled first and so read twice; postings, which are dear to make, are cut by
#: hash, and where a frequent term makes too much for a task, AQE cuts that.
SORTED = {"postings": ("term", "chunk_id"), "chunks": ("chunk_id",)}


class Store:
    """Tables of one corpus."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def generations(self) -> list[int]:
        fs, p = self._fs(self.root)
        names = [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(n.removeprefix("generation-")) for n in names if n.startswith("generation-") and n.removeprefix("generation-").isdigit())

    def named(self, number: int | None = None) -> dict[str, str]:
        """Folder of each table in a generation, or in the current one; none before the first."""
        have = self.generations()
        if not have:
            return {}
        path = f"{self.root}/generation-{have[-1] if number is None else number:012d}"
        return json.loads("".join(r[0] for r in self.spark.read.text(path).collect()))

    def table(self, name: str) -> DataFrame:
        """A table of the current generation; empty before the first."""
        at = self.named().get(name)
        if at is None:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.root}/{at}")

    def index(self) -> SearchIndex:
        return SearchIndex(self.table("postings"), self.table("stats"), self.table("chunks"))

    def write(self, tables: dict[str, DataFrame]) -> int:
        """Write these tables and make a generation current that names them and the others as they were."""
        new, names, number = uuid.uuid4().hex, self.named(), (self.generations() or [0])[-1] + 1

        def put(name: str, df: DataFrame) -> DataFrame:
            """Write a table, and read it again for what derives from it."""
            out = df.select(*[F.col(c).cast(kind).alias(c) for c, kind in (x.split(" ") for x in SCHEMAS[name].split(", "))])
            key = SORTED.get(name)
            if key:  # lookups read few row groups or pages
                out = out.hint("rebalance", key[0]) if name == "postings" else out.repartitionByRange(*key)
                out = out.sortWithinPartitions(*key)
            names[name] = f"tables/{new}/{name}"
            out.write.parquet(f"{self.root}/{names[name]}")
            return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.root}/{names[name]}")

        done = {}
        for name, df in tables.items():
            done[name] = put(name, df)
            if name == "embeddings":  # one generation names both, so unit vectors are never those of other vectors
                put("units", V.normalised(done[name]))
        if "postings" in done:  # written with their chunks; every word is in one posting, so no text is read for this
            words = done["postings"].agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("words"))
            put("stats", done["chunks"].agg(F.count("*").alias("n")).crossJoin(F.broadcast(words)))  # one row each
        fs, p = self._fs(f"{self.root}/pending-{new}")
        stream = fs.create(p, True)
        stream.write(bytearray(json.dumps(names).encode()))
        stream.close()
        if not fs.rename(p, self._fs(f"{self.root}/generation-{number:012d}")[1]):
            raise RuntimeError("another run has written this generation")
        return number

    def vacuum(self, keep: int = 2) -> None:
        """Remove all but the last generations, and tables that none of those names."""
        have = self.generations()
        fs, top = self._fs(f"{self.root}/tables")
        used = {at.split("/")[1] for g in have[-keep:] for at in self.named(g).values()}
        for g in have[:-keep]:
            fs.delete(self._fs(f"{self.root}/generation-{g:012d}")[1], False)
        for x in fs.listStatus(top) if fs.exists(top) else ():
            if x.getPath().getName() not in used:
                fs.delete(x.getPath(), True)

    def staged(self, df: DataFrame) -> DataFrame:
        """`df` written once, for several readers; vacuum removes it."""
        path = f"{self.root}/tables/staged-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def refresh(self, current: DataFrame, texts: DataFrame, embedder: Embedder | None = None, model: str = "", full: bool = False, overlap: int = 0, protect: DataFrame | None = None, retries: int = 0, workers: int | None = None) -> dict:
        """Bring the store up to the `current` catalog. `texts` (path, text, markdown) holds at least the changed files.

        Unchanged files keep their chunks, postings and vectors. A chunk that could not be embedded for now, after `retries`, marks
        its file for retry. At most `workers` requests for vectors are under way at once.
        """
        files, chunks, vectors, meta = (self.table(n) for n in ("files", "chunks", "embeddings", "meta"))
        diff = C.snapshot_diff(files, current, full, protect)
        counts = {r["action"]: r["count"] for r in diff.groupBy("action").count().collect()}
        stamp = self.spark.range(1).select(F.lit("last_index").alias("key"), iso_now().alias("value"))
        if not set(counts) - {"same"}:
            self.write({"meta": self._meta(meta, stamp)})
            return {"files": 0, "chunks": 0, "embedded": 0, "up_to_date": True}
        kept = C.survivors(chunks, diff)
        todo = texts.join(diff.where(F.col("action").isin("new", "changed")).select("path"), "path", "left_semi")
        fresh = K.markdown_chunks(todo.where("markdown")).unionByName(K.plain_chunks(todo.where("not markdown"))).withColumn("chunk_id", K.chunk_id())
        fresh = self.staged(fresh)
        stored = vectors.join(kept.select("chunk_id"), "chunk_id", "left_semi")
        stored = C.after_model_change(stored, meta, model)
        out_files = diff.where("action <> 'removed'").select("path").join(current, "path", "left")
        out_files = files.join(diff.where("action = 'same'").select("path"), "path", "left_semi").unionByName(out_files.join(diff.where("action <> 'same'").select("path"), "path", "left_semi").select(*files.columns))
        done = 0
        if embedder is not None:
            rows = K.with_previous(fresh).where(F.length(strip(F.col("content"))) >= MIN_EMBED)
            rows = rows.select("chunk_id", embed_text(F.col("heading"), F.col("content"), F.col("previous"), overlap).alias("text"))
            result = self.staged(embedded(rows.coalesce(workers) if workers else rows, embedder, retries))
            stored = stored.unionByName(result.where("status = 'ok'").select("chunk_id", "vector"))
            out_files = C.marked_for_retry(out_files, fresh, result.where("status = 'transient'"))
            done = result.where("status = 'ok'").count()
        index = self.table("postings").join(kept.select("chunk_id"), "chunk_id", "left_semi").unionByName(L.postings(fresh))
        lengths = self.table("lengths").join(kept.select("chunk_id"), "chunk_id", "left_semi").unionByName(L.document_lengths(fresh))
        keys = [("embed_model", model)] if model else []
        if full or vectors.isEmpty():
            keys.append(("embed_max_chars", str(MAX_EMBED)))
        more = self.spark.createDataFrame(keys, "key string, value string") if keys else stamp.limit(0)
        tables = {"files": out_files, "chunks": kept.unionByName(fresh.select(*kept.columns)), "embeddings": stored, "postings": index, "lengths": lengths, "meta": self._meta(meta, stamp.unionByName(more))}
        self.write(tables)
        n = fresh.count()
        return {"files": counts.get("new", 0) + counts.get("changed", 0), "removed": counts.get("removed", 0), "chunks": n, "embedded": done, "up_to_date": False}

    def _meta(self, old: DataFrame, new: DataFrame) -> DataFrame:
        both = old.withColumn("written", F.lit(0)).unionByName(new.withColumn("written", F.lit(1)))
        return C.upserted(both, "key", "written")

    def remove_root(self, root: str) -> None:
        """Without the files of a root and all that came from them."""
        files, chunks = self.table("files"), self.table("chunks")
        kept = C.without_root(chunks, files, root)
        ids = kept.select("chunk_id")
        tables = {n: self.table(n).join(ids, "chunk_id", "left_semi") for n in ("embeddings", "postings", "lengths")}
        self.write(tables | {"files": files.where(F.col("directory") != root), "chunks": kept})
