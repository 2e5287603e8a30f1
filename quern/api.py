"""The engine: indexing, search and status over a store."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.embedders import Embedder, Rejected, Unavailable, with_retries
from quern.functions.text import semantic_snippet
from quern.operators import catalog as C
from quern.operators import fusion as H
from quern.operators import ranking as R
from quern.operators import status as S
from quern.operators import vectors as V
from quern.sources import readers
from quern.sources.store import Store

#: Folders that are never entered, suffixes that are read as text.
SKIPPED = (".git", ".obsidian", ".claude", "node_modules", "__pycache__", ".venv", "venv")
SUFFIXES = (".md", ".txt", ".org", ".rst")
#: Files whose chunks are committed together; tries for a batch of vectors after the first, in indexing and in search.
COMMIT, RETRIES, SEARCH_RETRIES = 500, 5, 1


@dataclass(frozen=True)
class Config:
    """Settings of a corpus."""

    directories: tuple[str, ...] = ()
    images: tuple[str, ...] = ()
    suffixes: tuple[str, ...] = SUFFIXES
    skip: tuple[str, ...] = SKIPPED
    model: str = "hash-8"
    overlap: int = 0
    workers: int = 4
    extra: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        object.__setattr__(self, "overlap", min(max(0, int(self.overlap)), 2000))
        object.__setattr__(self, "workers", max(1, int(self.workers)))


@dataclass
class Hits:
    rows: DataFrame
    degraded: bool = False


class Engine:
    """`converter` turns documents into Markdown (content, suffix, ocr), `image_text` reads an image (content, suffix, ocr); without them such files are not indexed."""

    def __init__(
        self, spark: SparkSession, root: str, config: Config, embedder: Embedder | None = None, converter: readers.Converter | None = None, image_text: readers.Converter | None = None,
        retries: int = RETRIES, commit: int = COMMIT,
    ) -> None:
        self.spark, self.store, self.config, self.embedder = spark, Store(spark, root), config, embedder
        self.converter, self.image_text, self.retries, self.commit = converter, image_text, retries, commit

    def catalog(self) -> tuple[DataFrame, list[str]]:
        """Files of the roots: texts, documents if they can be converted, and images of roots that opted in."""
        suffixes = self.config.suffixes + (readers.DOCUMENTS if self.converter else ()) + (C.IMAGES if self.image_text else ())
        files, missing = readers.scan(self.spark, list(self.config.directories), suffixes, self.config.skip)
        return C.image_gate(files, list(self.config.images)), missing

    def read(self, paths: list[str]) -> tuple[DataFrame, list[str]]:
        """(texts of these files, those that nothing could read for now). A file that is broken has no text and is not read again until it changes."""
        kind = lambda p, suffixes: p.lower().endswith(suffixes)
        images = [p for p in paths if kind(p, C.IMAGES)]
        documents = [p for p in paths if kind(p, readers.DOCUMENTS)] if self.converter else []
        plain = sorted(set(paths).difference(images, documents))
        texts = readers.read_texts(self.spark, plain) if plain else self.spark.createDataFrame([], "path string, text string, markdown boolean")
        away: list[str] = []
        for own, convert in ((documents, self.converter), (images, self.image_text)):
            if own:
                found = self.store.staged(readers.convert(readers.read_bytes(self.spark, own), convert))
                away += [r["path"] for r in found.where("status = 'unavailable'").select("path").collect()]  # of files that the driver listed
                texts = texts.unionByName(found.where("status = 'ok'").select("path", "text", F.lit(True).alias("markdown")))
        return texts, away

    def index(self, full: bool = False) -> dict:
        """Scan the roots and refresh the store; files of missing roots stay as they are.

        Only changed files are read, and COMMIT of them are committed at a time; a run that dies leaves the rest to the next.
        """
        files, missing = self.catalog()
        gone = self.spark.createDataFrame([(m,) for m in missing], "directory string") if missing else None
        stored = self.store.table("files")
        diff = C.snapshot_diff(stored, files, full, gone)
        todo = sorted(r["path"] for r in diff.where(F.col("action").isin("new", "changed")).select("path").collect())  # of files that the driver walked itself
        total: dict = {}
        for a in range(0, max(1, len(todo)), self.commit):
            texts, away = self.read(todo[a : a + self.commit])
            wait = self.spark.createDataFrame([(p,) for p in away + todo[a + self.commit :]], "path string")
            now = self.store.table("files")
            current = files.join(wait, "path", "left_anti").unionByName(now.join(wait, "path", "left_semi").select(*files.columns))
            whole = full and a == 0
            done = self.store.refresh(current, texts, self.embedder, self.config.model, whole, self.config.overlap, gone, self.retries, self.config.workers)
            total = {k: (total.get(k, 0) + v if k != "up_to_date" else total.get(k, True) and v) for k, v in done.items()}
        self.store.vacuum()
        return total

    def lexical(self, query: str, limit: int = 10, strict: bool = False, prefix: str | None = None, max_chars: int | None = None) -> DataFrame:
        return R.search_hits(self.store.index().search(query, limit, strict, prefix), self.store.table("files"), query, max_chars)

    def semantic(self, query: str, limit: int = 10, prefix: str | None = None, max_chars: int | None = None) -> DataFrame | None:
        """Nearest chunks; None where vectors are unavailable, nothing where the query can't be embedded."""
        vectors, chunks = self.store.table("units"), self.store.table("chunks")
        if self.embedder is None or vectors.isEmpty():
            return None
        try:
            vector = with_retries(self.embedder, [query], SEARCH_RETRIES)[0]
        except Unavailable:
            return None
        except Rejected:
            vector = []
        allowed = chunks.where(F.col("file_path").startswith(prefix.rstrip("/") + "/")) if prefix else None
        near = V.top_k_units(vectors, vector, limit, allowed).join(chunks, "chunk_id")
        return R.with_mtimes(R.shaped(near, "semantic", semantic_snippet(F.col("content"), max_chars)), self.store.table("files"))

    def search(self, query: str, limit: int = 10, semantic: bool = False, both: bool = False, strict: bool = False, prefix: str | None = None, max_chars: int | None = None) -> Hits:
        """Lexical by default; semantic wins over both if both are asked for; without vectors the lexical hits, degraded."""
        near = self.semantic(query, limit, prefix, max_chars) if semantic or both else None
        if semantic and near is not None:
            return Hits(near.orderBy(F.desc("score"), "chunk_id"))
        words = self.lexical(query, limit, strict, prefix, max_chars)
        if not (semantic or both):
            return Hits(words.orderBy(F.desc("score"), "chunk_id"))
        rows, degraded = H.hybrid(words, near, limit)
        return Hits(rows, degraded)

    def status(self) -> DataFrame:
        t = self.store.table
        roots = self.spark.createDataFrame([(d,) for d in self.config.directories], "directory string")
        return S.report(roots, t("files"), t("chunks"), t("embeddings"), t("meta"))
