"""Embedding seam: callables from texts to vectors, run on Arrow batches with a three-valued outcome.

A backend returns vectors, or raises Unavailable (worth another try later) or Rejected (this input will never work). A
failed batch is tried again text by text, so that one bad text costs only itself.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts in a request, characters of a text, longest wait.
BATCH, MOST_CHARS, LONGEST_WAIT = 5, 8000, 60


class Unavailable(Exception):
    """The backend did not answer."""


class Rejected(Exception):
    """The backend will never accept this input."""


Embedder = Callable[[list[str]], list[list[float]]]


def hash_embedding(c: Column, dim: int) -> Column:
    """The first `dim` bytes of a digest over 255: deterministic vectors for tests, as an expression."""
    h = F.sha2(c, 256)
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.conv(F.substring(h, i * 2 + 1, F.lit(2)), 16, 10).cast("double") / 255.0)


def hash_embedder(dim: int) -> Embedder:
    return lambda texts: [[b / 255 for b in hashlib.sha256(t.encode()).digest()[:dim]] for t in texts]


def faulty_hash_embedder(dim: int) -> Embedder:
    """Rejects texts that begin with POISON and is down for those that begin with DOWN."""

    def run(texts: list[str]) -> list[list[float]]:
        if any(t.startswith("POISON") for t in texts):
            raise Rejected
        if any(t.startswith("DOWN") for t in texts):
            raise Unavailable
        return [[b / 255 for b in hashlib.sha256(t.encode()).digest()[:dim]] for t in texts]

    return run


def with_retries(embedder: Embedder, texts: list[str], retries: int = 0, wait: Callable[[float], None] = time.sleep) -> list[list[float]]:
    """Vectors, after waits that double up to LONGEST_WAIT while the backend is unavailable."""
    for k in range(retries + 1):
        try:
            return embedder(texts)
        except Unavailable:
            if k == retries:
                raise
            wait(min(2 ** (k + 1), LONGEST_WAIT))
    return []


def outcomes(embedder: Embedder, texts: list[str], retries: int = 0, wait: Callable[[float], None] = time.sleep) -> list[tuple[str, list[float] | None]]:
    """(status, vector) of each text; status is ok, transient or permanent."""
    out: list[tuple[str, list[float] | None]] = []
    for a in range(0, len(texts), BATCH):
        batch = [t[:MOST_CHARS] for t in texts[a : a + BATCH]]
        try:
            out += [("ok", v) for v in with_retries(embedder, batch, retries, wait)]
        except (Unavailable, Rejected):
            for t in batch:
                try:
                    out.append(("ok", with_retries(embedder, [t], retries, wait)[0]))
                except Unavailable:
                    out.append(("transient", None))
                except Rejected:
                    out.append(("permanent", None))
    return out


def embedded(rows: DataFrame, embedder: Embedder, retries: int = 0) -> DataFrame:
    """(chunk_id, status, vector) of rows (chunk_id, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = outcomes(embedder, pdf["text"].tolist(), retries)
            yield pd.DataFrame({"chunk_id": pdf["chunk_id"], "status": [s for s, _ in found], "vector": [v for _, v in found]})

    return rows.select("chunk_id", "text").mapInPandas(run, "chunk_id long, status string, vector array<float>")


def vectors_of(reply: str, listed: bool) -> list[list[float]]:
    """Vectors of a server's JSON. A `listed` reply holds records with an index, in any order; the other kind holds the vectors in order."""
    import json

    try:
        found = json.loads(reply)
        if listed:
            return [r["embedding"] for r in sorted(found["data"], key=lambda r: r.get("index", 0))]
        return list(found["embeddings"])
    except (ValueError, KeyError, TypeError, AttributeError) as e:
        raise Unavailable("no embeddings in the reply") from e


#: What a server says of a text that it can never embed.
NEVER = ("NaN", "unsupported value")


def http_embedder(url: str, model: str, key: str = "", listed: bool = False, timeout: float = 120.0) -> Embedder:
    """An embedding server: `url`/embeddings for listed replies, else `url`/api/embed. What it can never embed is Rejected, any other failure Unavailable."""

    def run(texts: list[str]) -> list[list[float]]:
        import json
        import urllib.error
        import urllib.request

        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key and listed else {})
        body = json.dumps({"model": model, "input": texts}).encode()
        try:
            with urllib.request.urlopen(urllib.request.Request(url.rstrip("/") + ("/embeddings" if listed else "/api/embed"), data=body, headers=headers), timeout=timeout) as r:
                out = vectors_of(r.read().decode("utf-8", "replace"), listed)
        except urllib.error.HTTPError as e:
            said = e.read().decode("utf-8", "replace")
            raise (Rejected if any(n in said for n in NEVER) else Unavailable)(said[:200]) from e
        except OSError as e:
            raise Unavailable(str(e)) from e
        if len(out) != len(texts):
            raise Unavailable("another number of vectors than texts")
        return out

    return run


def plain_http(url: str) -> bool:
    """Whether texts and keys would travel to another machine unencrypted."""
    from urllib.parse import urlparse

    at = urlparse(url)
    return at.scheme != "https" and at.hostname not in ("localhost", "127.0.0.1", "::1")
