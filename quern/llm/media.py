"""Media columns: texts stored as baseline JPEG and read back, with thumbnail features.

Every whole text, as UTF-8 and filled with bytes 255 to a positive multiple of 576, is written as a
JPEG, parsed and Huffman-decoded again; dimensions and hashes of the DC-only thumbnail become features.
Null texts count as empty, a null doc_id stays null, equal texts get equal values, and an empty table
gives an empty result. Only doc_id and text are read, so extra columns never clash.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from quern.llm import jpeg

UNIT = 576
SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, width int, height int, thumb_sha256 string, feature string"


def fill(raw: bytes) -> bytes:
    return raw + b"\xff" * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def row(n: int, blob: bytes, head: dict, coefficients: np.ndarray) -> tuple:
    """Digest columns of one stored file; the payload is what was read back."""
    length = int(head["comment"].removeprefix(b"payload="))
    payload = (coefficients[:length] + 128).astype(np.uint8).tobytes()
    grid = jpeg.thumbnail(head, coefficients)
    thumb = hashlib.sha256(grid.tobytes()).hexdigest()
    feature = f"{head['width']}x{head['height']};dc={grid.shape[1]}x{grid.shape[0]};ahash={jpeg.average_hash(grid)};thumb={thumb[:16]}"
    return (n, length, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(blob), hashlib.sha256(blob).hexdigest(), head["width"], head["height"], thumb, feature)


def rows(texts: list[str | None]) -> list[tuple]:
    out = []
    raws = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    for a, b in jpeg._runs([len(r) + UNIT for r in raws]):
        blobs = jpeg.write([fill(r) for r in raws[a:b]])
        out += [row(len(r), blob, h, c) for r, blob, (h, c) in zip(raws[a:b], blobs, jpeg.read(blobs))]
    return out


def media_columns(docs: DataFrame) -> DataFrame:
    """One row per document, by SCHEMA."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for pdf in batches:
            found = rows(pdf["text"].tolist())
            out = pd.DataFrame(found, columns=names[1:])
            out.insert(0, "doc_id", pdf["doc_id"].astype("Int64").to_numpy())
            yield out

    return docs.select("doc_id", "text").mapInPandas(run, SCHEMA)
