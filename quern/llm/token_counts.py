"""Token counts of whole texts by a compiled finite-state tokenizer.

The transducers of `token_fst` are compiled once per Python worker from a vocabulary file, whose path is a
parameter. Null texts count as empty, with no bytes and no tokens; a null doc_id stays null; an empty table
gives an empty result; only doc_id and text are read, so extra columns never clash.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 512
#: Code points that are counted at once.
BATCH = 1 << 20


@functools.lru_cache(maxsize=2)
def compiled(path: str):
    from quern.llm.token_fst import Tokenizer

    return Tokenizer(path)


def vocabulary(name: str) -> str:
    """Where the installed public vocabularies keep a file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = compiled(path)
        for pdf in batches:
            texts = [t or "" for t in pdf["text"]]
            sizes, tokens, a, total = [], [], 0, 0
            for b in range(len(texts) + 1):
                if b > a and (b == len(texts) or total + len(texts[b]) > BATCH):
                    s, n = tokenizer.counts(texts[a:b])
                    sizes += s.tolist()
                    tokens += n.tolist()
                    a, total = b, 0
                total += len(texts[b]) if b < len(texts) else 0
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "n_bytes": sizes, "n_tokens": tokens})

    out = docs.select("doc_id", "text").mapInPandas(run, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
