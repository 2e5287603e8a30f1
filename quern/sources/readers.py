"""Sources: directory scans, text reading, and seams for converters and image readers."""

from __future__ import annotations

import io
import os
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.text import has_text, normal_newlines, strip_images, strip_tags, unbold_headings

#: Suffixes of documents that need a converter.
DOCUMENTS = (".pdf", ".doc", ".docx", ".rtf", ".ppt", ".pptx", ".xls", ".xlsx", ".odt", ".ods", ".odp", ".html", ".htm", ".epub", ".csv", ".tsv")
#: Bytes of content that a Python worker converts at once; a file is never cut.
BYTES_AT_ONCE = 2_000_000
SCAN = "path string, directory string, mtime_ns long, size long"


class ReaderUnavailable(Exception):
    """No engine for this kind of file, or its configuration is wrong."""


def walk(root: str, suffixes: Iterable[str], skip: Iterable[str] = ()) -> Iterator[tuple[str, str, int, int]]:
    """(path, root, mtime_ns, size) of wanted files below a root, hidden ones too; links to folders are not followed."""
    base, wanted, skip = os.path.abspath(os.path.expanduser(root)), {s.lower() for s in suffixes}, set(skip)
    for folder, folders, names in os.walk(base):
        folders[:] = sorted(f for f in folders if f not in skip)
        for name in sorted(names):
            if Path(name).suffix.lower() in wanted:
                path = os.path.join(folder, name)
                try:
                    info = os.stat(path)
                except OSError:
                    continue  # a link to nothing
                yield path, base, info.st_mtime_ns, info.st_size


def scan(spark: SparkSession, roots: list[str], suffixes: Iterable[str], skip: Iterable[str] = ()) -> tuple[DataFrame, list[str]]:
    """(files of all roots, roots that are missing). Of overlapping roots the later one names the directory."""
    found: dict[str, tuple] = {}
    missing = [r for r in roots if not os.path.isdir(os.path.expanduser(r))]
    for r in roots:
        if r not in missing:
            found |= {row[0]: row for row in walk(r, suffixes, skip)}
    return spark.createDataFrame(list(found.values()), SCAN), missing


def scan_distributed(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """The same from any store Spark reads, without contents; names that begin with . or _ stay hidden there."""
    b = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    return b.select("path", F.lit(root).alias("directory"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"), F.col("length").alias("size"))


def read_bytes(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, content) of these files."""
    hidden = [p for p in paths if os.path.basename(p)[:1] in "._"]
    plain = sorted(set(paths).difference(hidden))

    def opened(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"path": pdf["path"], "content": [Path(p).read_bytes() for p in pdf["path"]]})

    if plain:
        b = spark.read.format("binaryFile").load(plain).select(F.regexp_replace("path", "^file:/*", "/").alias("path"), "content")
    else:
        b = spark.createDataFrame([], "path string, content binary")
    if hidden:  # Spark's file sources pass over such names
        b = b.unionByName(spark.createDataFrame([(p,) for p in hidden], "path string").mapInPandas(opened, "path string, content binary"))
    return b


def read_texts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, text, markdown): UTF-8 with bad bytes replaced and plain newlines; Markdown only by the exact suffix .md."""
    b = read_bytes(spark, paths)
    return b.select("path", normal_newlines(F.make_valid_utf8(F.col("content").cast("string"))).alias("text"), F.col("path").endswith(".md").alias("markdown"))


def cleaned(markdown) -> object:
    """Converter output as the chunker wants it: plain headings, no image links, no inline tags."""
    return strip_tags(strip_images(unbold_headings(markdown)))


Converter = Callable[[bytes, str, bool], str]


def csv_to_markdown(content: bytes, suffix: str) -> str:
    """A built-in converter for tables."""
    import csv

    rows = list(csv.reader(io.StringIO(content.decode("utf-8", "replace")), delimiter="\t" if suffix == ".tsv" else ","))
    if not rows:
        return ""
    line = lambda r: "| " + " | ".join(r) + " |"
    return "\n".join([line(rows[0]), "|" + " --- |" * len(rows[0]), *map(line, rows[1:])])


def convert(rows: DataFrame, converter: Converter) -> DataFrame:
    """(path, text, status) of rows (path, content) through a converter(content, suffix, ocr).

    Status is ok, error (this file can't be read: recorded, not tried again until it changes) or unavailable (nothing can be
    read now: not recorded). A PDF without real text is converted once more with OCR.
    """
    import re

    letters = lambda t: len(re.sub(r"[^\w]", "", re.sub(r"!\[[^\]]*\]\([^)]*\)", "", t)))

    def one(path: str, content: bytes) -> tuple[str, str]:
        suffix = Path(path).suffix.lower()
        try:
            if suffix in (".csv", ".tsv"):
                return csv_to_markdown(content, suffix), "ok"
            text = converter(content, suffix, False)
            if suffix == ".pdf" and letters(text) < 20:
                text = converter(content, suffix, True)
            return text, "ok"
        except ReaderUnavailable:
            return "", "unavailable"
        except Exception:  # noqa: BLE001  whatever a converter raises is that file's error
            return "", "error"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column("content")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            starts = np.unique((np.cumsum(sizes) - sizes) // BYTES_AT_ONCE, return_index=True)[1].tolist()
            for a, b in zip(starts, [*starts[1:], len(sizes)]):
                part = batch.slice(a, b - a)
                found = [one(p.as_py(), c.as_py() or b"") for p, c in zip(part.column("path"), part.column("content"))]
                kinds = (pa.array(x, pa.string()) for x in ([t for t, _ in found], [s for _, s in found]))
                yield pa.RecordBatch.from_arrays([part.column("path"), *kinds], ["path", "text", "status"])

    out = rows.select("path", "content").mapInArrow(run, "path string, text string, status string")
    return out.withColumn("text", cleaned(F.col("text"))).withColumn("real", has_text(F.col("text")))


def image_as_jpeg(content: bytes, side: int = 1600, quality: int = 85) -> bytes:
    """An image turned upright, in RGB, within `side` pixels; needs the optional imaging library."""
    try:
        from PIL import Image, ImageOps
    except ImportError as e:
        raise ReaderUnavailable("no imaging library") from e
    im = ImageOps.exif_transpose(Image.open(io.BytesIO(content))).convert("RGB")
    im.thumbnail((side, side))
    out = io.BytesIO()
    im.save(out, "JPEG", quality=quality)
    return out.getvalue()


#: Kinds of image that go as they are where there is no imaging library, and their most bytes; replies that speak of the image itself.
RAW_IMAGES = {".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".webp": "image/webp", ".gif": "image/gif"}
MOST_RAW = 5 * 1024 * 1024
IMAGE_REJECTED = (400, 413, 415, 422)
PROMPT = "Write down all text in this image as it is, in Markdown. Keep tables and headings. Neither summarise nor comment. If there is no text, answer exactly: NO_TEXT"


def sendable(content: bytes, suffix: str) -> tuple[bytes, str]:
    """(bytes, media type) of an image for a request: scaled down as JPEG, or as it is if there is no imaging library and it is small and of a kind for the web."""
    try:
        return image_as_jpeg(content), "image/jpeg"
    except ReaderUnavailable:
        if suffix.lower() not in RAW_IMAGES or len(content) > MOST_RAW:
            raise
        return content, RAW_IMAGES[suffix.lower()]


def vision_request(content: bytes, mime: str, model: str, prompt: str = PROMPT) -> dict:
    """Body of a chat completion that asks for an image's text."""
    import base64

    url = f"data:{mime};base64,{base64.b64encode(content).decode()}"
    return {"model": model, "temperature": 0, "max_tokens": 4000, "messages": [{"role": "user", "content": [{"type": "text", "text": prompt}, {"type": "image_url", "image_url": {"url": url}}]}]}


def vision_reader(url: str, model: str, key: str = "", timeout: float = 300.0) -> Converter:
    """A reader of images by a vision model. An image that the server rejects is that image's error; any other failure is for another run."""

    def read(content: bytes, suffix: str, ocr: bool) -> str:
        import json
        import urllib.error
        import urllib.request

        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
        body = json.dumps(vision_request(*sendable(content, suffix), model)).encode()
        try:
            with urllib.request.urlopen(urllib.request.Request(url.rstrip("/") + "/chat/completions", data=body, headers=headers), timeout=timeout) as r:
                return vision_text(r.read().decode("utf-8", "replace"))
        except urllib.error.HTTPError as e:
            if e.code in IMAGE_REJECTED:
                raise ValueError(f"the server rejects the image: {e.code}") from e
            raise ReaderUnavailable(f"the server answers {e.code}") from e
        except OSError as e:
            raise ReaderUnavailable(str(e)) from e

    return read


def vision_text(reply: str, nothing: str = "NO_TEXT") -> str:
    """Text of a chat completion's JSON; ReaderUnavailable if it is none."""
    import json

    try:
        text = json.loads(reply)["choices"][0]["message"]["content"]
    except (ValueError, KeyError, IndexError, TypeError) as e:
        raise ReaderUnavailable("no chat completion") from e
    if isinstance(text, list):
        text = "".join(p.get("text", "") for p in text if isinstance(p, dict))
    return "" if text.strip() == nothing else text


def routing_demo(files: DataFrame, docs: DataFrame) -> DataFrame:
    """Outcomes of a converter that knows some kinds of file: by suffix of doc_id mod 5."""
    ext = F.element_at(F.array(*[F.lit(x) for x in (".csv", ".pdf", ".html", ".png", ".doc")]), (F.col("doc_id") % 5 + 1).cast("int"))
    rows = docs.select(F.concat(F.lit("/in/"), F.col("doc_id").cast("string"), ext).alias("path"), F.col("text").cast("binary").alias("content"))

    def converter(content: bytes, suffix: str, ocr: bool) -> str:
        if suffix == ".png":
            raise ReaderUnavailable
        if suffix == ".doc":
            raise ValueError("broken")
        return ("scan " * 10 if ocr else "") if suffix == ".pdf" else content.decode("utf-8", "replace")

    return convert(rows, converter)
