"""Chunks: sections by heading, packed paragraphs, dense numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import strip

#: Fixed value: characters of a chunk, at most, unless one paragraph is longer.
CHUNK = 4000
#: Only \n ends a line; white space after the marks may run over lines.
HEADING = r"(?md)^#{1,3}\s+[^\n]+"
_LEVEL, _TITLE = r"^(#{1,3})", r"^#{1,3}\s+([^\n]+)"


def pack_paragraphs(c: Column, most: int = CHUNK) -> Column:
    """Array of chunks: paragraphs joined while they fit, without white space at a chunk's ends; a single long one is not cut."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(None).cast("string").alias("cur"))

    def add(acc: Column, p: Column) -> Column:
        fits = F.length(acc["cur"]) + F.length(p) + 2 <= most
        return (
            F.when(acc["cur"].isNull() | (acc["cur"] == ""), F.struct(acc["out"].alias("out"), p.alias("cur")))
            .when(fits, F.struct(acc["out"].alias("out"), F.concat(acc["cur"], F.lit("\n\n"), p).alias("cur")))
            .otherwise(F.struct(F.concat(acc["out"], F.array(acc["cur"])).alias("out"), p.alias("cur")))
        )

    folded = F.aggregate(F.split(c, "\n\n+"), start, add, lambda acc: F.transform(F.concat(acc["out"], F.array(acc["cur"])), strip))
    return F.when(F.length(c) <= most, F.array(c)).otherwise(folded)


def sections(c: Column) -> Column:
    """array<struct<heading, body>>: the preamble with an empty heading, then each section under its breadcrumb."""
    marks = F.regexp_extract_all(c, F.lit(HEADING), F.lit(0))
    empty = F.lit("")
    slots = F.struct(empty.alias("a"), empty.alias("b"), empty.alias("c"), F.array().cast("array<string>").alias("out"))

    def add(acc: Column, mark: Column) -> Column:
        level, title = F.length(F.regexp_extract(mark, _LEVEL, 1)), strip(F.regexp_extract(mark, _TITLE, 1))
        a = F.when(level == 1, title).otherwise(acc["a"])
        b = F.when(level == 2, title).when(level == 1, empty).otherwise(acc["b"])
        d = F.when(level == 3, title).otherwise(empty)
        crumb = F.array_join(F.filter(F.array(a, b, d), lambda x: x != ""), " > ")
        return F.struct(a.alias("a"), b.alias("b"), d.alias("c"), F.concat(acc["out"], F.array(crumb)).alias("out"))

    crumbs = F.concat(F.array(empty), F.aggregate(marks, slots, add, lambda acc: acc["out"]))
    return F.arrays_zip(crumbs.alias("heading"), F.split(c, HEADING).alias("body"))


def markdown_chunks(docs: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(file_path, chunk_index, heading, content) of Markdown texts; a text with headings but no bodies is one chunk."""
    cut = docs.select(F.col(path).alias("file_path"), F.col(text).alias("text"), F.posexplode(sections(F.col(text))).alias("n", "s"))
    body = strip(F.col("s.body"))
    parts = cut.select("file_path", "n", F.col("s.heading").alias("heading"), F.posexplode(pack_paragraphs(body)).alias("k", "content")).where(F.length(strip(F.col("content"))) > 0)
    bare = docs.select(F.col(path).alias("file_path"), F.lit(0).alias("n"), F.lit("").alias("heading"), F.lit(0).alias("k"), strip(F.col(text)).alias("content"), F.exists(sections(F.col(text)), lambda s: F.length(strip(s["body"])) > 0).alias("some"))
    bare = bare.where(~F.col("some") & (F.length("content") > 0)).drop("some")
    return numbered(parts.unionByName(bare))


def plain_chunks(docs: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(file_path, chunk_index, heading, content) of plain texts."""
    parts = docs.select(F.col(path).alias("file_path"), F.lit(0).alias("n"), F.lit("").alias("heading"), F.posexplode(pack_paragraphs(strip(F.col(text)))).alias("k", "content"))
    return numbered(parts.where(F.length(strip(F.col("content"))) > 0))


def numbered(parts: DataFrame) -> DataFrame:
    """Dense numbers from 0 within a file, after blank chunks are gone."""
    w = Window.partitionBy("file_path").orderBy("n", "k")
    return parts.select("file_path", (F.row_number().over(w) - 1).alias("chunk_index"), "heading", "content")


def with_previous(chunks: DataFrame) -> DataFrame:
    """`chunks` with the content of the chunk before in the same file."""
    return chunks.withColumn("previous", F.lag("content").over(Window.partitionBy("file_path").orderBy("chunk_index")))


def chunk_id() -> Column:
    """A key that depends on the file and the number alone."""
    return F.xxhash64("file_path", "chunk_index")
