"""Lexical search: a query tree becomes column expressions over occurrences, scored by column-weighted BM25.

There are two ways to read the corpus. An index is looked up by the words of the query: `SearchIndex` reads their postings
alone, counts words, phrases and NEAR from positions, and scores from the lengths that postings carry, so its work
follows those postings and not the corpus; only the chunks of the best rows are read. `scored` scans token arrays, for
chunks that have no index: one pass counts documents, lengths and phrase frequencies in a single
global aggregate, whose one row joins the scoring pass.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from quern.functions.text import clip_words, iso_time, tokens
from quern.plans import queryparse as Q

#: Weights by column, saturation, length share, floor of the inverse document frequency.
WEIGHTS = {"content": 1.0, "heading": 2.0}
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
FRAGMENT = 40
#: Best rows that come to the driver, to look their chunks up by id; more are joined.
MOST_COLLECTED = 10_000


def positions(tokens: Column, p: Q.Phrase) -> Column:
    """Where a phrase begins in a token array, from 0."""
    k = len(p.words)
    if not k:
        return F.array().cast("array<int>")

    def at(i: Column) -> Column:
        hits = [F.get(tokens, i + j) == w for j, w in enumerate(p.words)]
        if p.prefix:
            hits[-1] = F.get(tokens, i + (k - 1)).startswith(p.words[-1])
        return reduce(lambda a, b: a & b, hits)

    every = F.when(F.size(tokens) >= k, F.sequence(F.lit(0), F.size(tokens) - k)).otherwise(F.array().cast("array<int>"))
    if p.initial:
        every = F.slice(every, 1, 1)
    return F.filter(every, at)


def count_hits(tokens: Column, p: Q.Phrase | Q.Near, column: str) -> Column:
    """Occurrences of a leaf in one column; for NEAR, those of its phrases that lie close enough."""
    if isinstance(p, Q.Phrase):
        if column not in p.columns or not p.words:
            return F.lit(0)
        if len(p.words) == 1 and not p.initial:
            w = p.words[0]
            return F.size(F.filter(tokens, (lambda x: x.startswith(w)) if p.prefix else (lambda x: x == w)))
        return F.size(positions(tokens, p))
    own = [x for x in p.phrases if column in x.columns]
    if len(own) < len(p.phrases):
        return F.lit(0)
    return clumps([positions(tokens, x) for x in own], p)


def clumps(spots: list[Column], p: Q.Near) -> Column:
    """Starts of clumps: every other phrase begins no later than `distance` tokens after the first one's end."""
    total = F.lit(0)
    for k, first in enumerate(spots):
        reach = len(p.phrases[k].words) + p.distance
        near = lambda x, others: reduce(lambda a, b: a & b, [F.exists(o, lambda y: (y >= x) & (y <= x + reach)) for o in others])  # noqa: E731, B023
        total = total + F.size(F.filter(first, lambda x: near(x, spots[:k] + spots[k + 1 :])))  # noqa: B023
    return total


def matches(tree, hits: dict) -> Column:
    """Whether a row satisfies the tree, from its leaves' occurrences."""
    if isinstance(tree, (Q.Phrase, Q.Near)):
        return hits[tree] > 0
    if isinstance(tree, Q.Without):
        return matches(tree.keep, hits) & ~matches(tree.drop, hits)
    parts = [matches(p, hits) for p in tree.parts]
    return reduce((lambda a, b: a & b) if isinstance(tree, Q.Both) else (lambda a, b: a | b), parts)


def leaves(tree) -> list:
    if isinstance(tree, (Q.Phrase, Q.Near)):
        return [tree]
    if isinstance(tree, Q.Without):
        return leaves(tree.keep) + leaves(tree.drop)
    return [x for p in tree.parts for x in leaves(p)]


def scored(chunks: DataFrame, tree) -> DataFrame:
    """Matching rows of tokenised `chunks` with their BM25 `score`. Statistics are those of all of `chunks`."""
    every = list(dict.fromkeys(leaves(tree)))
    ranked = [every.index(p) for p in dict.fromkeys(Q.phrases_of(tree))]
    rows = chunks
    for k, p in enumerate(every):
        for c in Q.COLUMNS:
            rows = rows.withColumn(f"_{c}{k}", count_hits(F.col(f"{c}_tokens"), p, c).cast("double"))
    any_hit = {p: F.col(f"_content{k}") + F.col(f"_heading{k}") for k, p in enumerate(every)}
    rows = rows.withColumn("_len", (F.size("content_tokens") + F.size("heading_tokens")).cast("double"))
    stats = rows.agg(
        F.count("*").cast("double").alias("_n"),
        F.avg("_len").alias("_avgdl"),
        *[F.sum((any_hit[every[k]] > 0).cast("double")).alias(f"_df{k}") for k in ranked],
    )
    # one row of statistics
    return rows.where(matches(tree, any_hit)).crossJoin(F.broadcast(stats)).withColumn("score", bm25(ranked)).select(*chunks.columns, "score")


def bm25(ranked: list[int]) -> Column:
    """The score from _content, _heading and _df of each ranked leaf, _len, _n and _avgdl."""
    score = F.lit(0.0)
    for k in ranked:
        idf = F.greatest(F.log((F.col("_n") - F.col(f"_df{k}") + 0.5) / (F.col(f"_df{k}") + 0.5)), F.lit(LEAST_IDF))
        tf = F.col(f"_content{k}") * WEIGHTS["content"] + F.col(f"_heading{k}") * WEIGHTS["heading"]
        score = score + idf * ((tf * (K1 + 1)) / (tf + K1 * (1 - B + B * F.col("_len") / F.col("_avgdl"))))
    return score


@dataclass
class SearchIndex:
    """A stored index: postings sorted by term, one row of statistics (n, words), and chunks sorted by id."""

    postings: DataFrame
    stats: DataFrame
    chunks: DataFrame

    @cached_property
    def totals(self) -> tuple[float, float]:
        """Chunks, and their mean length."""
        row = self.stats.first()
        n = float(row["n"] if row else 0)
        return n, (row["words"] or 0) / n if n else 0.0

    def scores(self, tree) -> DataFrame:
        """(chunk_id, score) of matching chunks, from the postings of the query's words."""
        every = list(dict.fromkeys(leaves(tree)))
        ranked = [every.index(p) for p in dict.fromkeys(Q.phrases_of(tree))]
        slots: dict[tuple, int] = {}  # (word, prefix, column, with positions)
        ask = lambda *slot: F.col(f"_s{slots.setdefault(slot, len(slots))}")

        def spots(p: Q.Phrase, column: str) -> Column:
            at = [ask(w, p.prefix and j == len(p.words) - 1, column, True) for j, w in enumerate(p.words)]
            if not at:
                return F.array().cast("array<int>")
            later = [(j, a) for j, a in enumerate(at) if j]
            out = F.filter(at[0], lambda x: reduce(lambda u, v: u & v, [F.array_contains(a, x + j) for j, a in later])) if later else at[0]
            return F.filter(out, lambda x: x == 0) if p.initial else out

        def count(p, column: str) -> Column:
            if isinstance(p, Q.Near):
                return clumps([spots(x, column) for x in p.phrases], p) if all(column in x.columns for x in p.phrases) else F.lit(0)
            if column not in p.columns or not p.words:
                return F.lit(0)
            if len(p.words) == 1 and not p.initial:
                return F.coalesce(ask(p.words[0], p.prefix, column, False), F.lit(0))
            return F.size(spots(p, column))

        counts = {(c, k): count(p, c).cast("double") for k, p in enumerate(every) for c in Q.COLUMNS}
        term = lambda w, prefix: F.col("term").startswith(w) if prefix else F.col("term") == w
        asked = [term(w, prefix) for w, prefix in dict.fromkeys((w, prefix) for w, prefix, _, _ in slots)]
        own = self.postings.where(reduce(lambda a, b: a | b, asked) if asked else F.lit(False))
        aggregates = [F.first("length").cast("double").alias("_len")]
        for (w, prefix, column, placed), k in slots.items():
            mine = term(w, prefix) & (F.col("col") == column)
            aggregates.append((F.flatten(F.collect_list(F.when(mine, F.col("positions")))) if placed else F.sum(F.when(mine, F.col("tf")))).alias(f"_s{k}"))
        rows = own.groupBy("chunk_id").agg(*aggregates)
        rows = rows.select("chunk_id", "_len", *[x.alias(f"_{c}{k}") for (c, k), x in counts.items()])
        any_hit = {p: F.col(f"_content{k}") + F.col(f"_heading{k}") for k, p in enumerate(every)}
        df = rows.agg(F.lit(1), *[F.sum((any_hit[every[k]] > 0).cast("double")).alias(f"_df{k}") for k in ranked])
        n, mean = self.totals
        # one row of document frequencies
        both = rows.where(matches(tree, any_hit)).crossJoin(F.broadcast(df)).withColumns({"_n": F.lit(n), "_avgdl": F.lit(mean)})
        return both.select("chunk_id", bm25(ranked).alias("score"))

    def best(self, query: str, limit: int, prefix: str | None = None) -> DataFrame | None:
        """Chunks with `score` of the best rows of a query, or None if it is no query. Best rows are few, so they come to the driver and their chunks are looked up by id."""
        try:
            tree = Q.parse(query)
        except Q.QuerySyntaxError:
            return None
        rows = self.scores(tree)
        if prefix:
            rows = rows.join(self.chunks.where(under(prefix)).select("chunk_id"), "chunk_id", "left_semi")
        rows = rows.orderBy(F.desc("score"), "chunk_id").limit(max(0, limit))
        return self.chunks.join(rows, "chunk_id") if limit > MOST_COLLECTED else self.looked_up(rows)

    def looked_up(self, rows: DataFrame, how: str = "inner") -> DataFrame:
        """Few `rows` (chunk_id, score) with their chunks, by id; with `how` "left" also those without one. The other chunks are not moved."""
        found = rows.select("chunk_id", "score").collect()
        few = self.chunks.sparkSession.createDataFrame(found, "chunk_id long, score double")
        own = self.chunks.where(F.col("chunk_id").isin([r["chunk_id"] for r in found]))
        if how == "inner":
            return own.join(F.broadcast(few), "chunk_id")
        return few.join(F.broadcast(own), "chunk_id", how)

    def search(self, query: str, limit: int = 10, strict: bool = False, prefix: str | None = None) -> DataFrame:
        """The relaxation ladder."""
        none = self.chunks.limit(0).withColumn("score", F.lit(0.0))
        return ladder(lambda q: self.best(q, limit, prefix), none, query, strict) if limit > 0 else none


def under(prefix: str) -> Column:
    return F.col("file_path").startswith(prefix.rstrip("/") + "/")


def top(rows: DataFrame, limit: int, prefix: str | None = None) -> DataFrame:
    """The best `limit` rows, after the directory filter; ties by chunk_id. Fewer than one is none."""
    if prefix:
        rows = rows.where(under(prefix))
    return rows.orderBy(F.desc("score"), "chunk_id").limit(max(0, limit))


def fragment(content_tokens: Column, words: list[str], size: int = FRAGMENT) -> Column:
    """The first run of `size` tokens with most distinct query words, with an ellipsis where it is cut. An own definition of a snippet."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(content_tokens) - size, F.lit(0)))
    wanted = F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")
    worth = F.transform(starts, lambda i: F.struct(F.size(F.array_intersect(F.slice(content_tokens, i + 1, F.lit(size)), wanted)).alias("n"), (-i).alias("i")))
    best = -F.array_max(worth)["i"]
    body = F.array_join(F.slice(content_tokens, best + 1, F.lit(size)), " ")
    return F.concat(F.when(best > 0, "...").otherwise(""), body, F.when(best + size < F.size(content_tokens), "...").otherwise(""))


def shaped(rows: DataFrame, method: str, snippet: Column) -> DataFrame:
    """Hit records: path, heading, snippet, score to 4 places, method, chunk_id."""
    return rows.select(F.col("file_path").alias("path"), F.coalesce("heading", F.lit("")).alias("heading"), snippet.alias("snippet"), F.round("score", 4).alias("score"), F.lit(method).alias("method"), "chunk_id")


@F.pandas_udf(LongType())
def _live_mtime(paths: pd.Series) -> pd.Series:
    """Time of a file where it can be reached."""

    def one(path):
        try:
            return os.stat(path).st_mtime_ns
        except (OSError, TypeError):
            return None

    return paths.map(one).astype("Int64")


def with_mtimes(hits: DataFrame, files: DataFrame) -> DataFrame:
    """`hits`, which are few, with the stored time of their files, or the file's own where none is stored or it is marked for retry."""
    own = files.select("path", "mtime_ns").join(F.broadcast(hits.select("path").distinct()), "path", "left_semi")
    ns = F.when(F.col("mtime_ns") >= 0, F.col("mtime_ns")).otherwise(_live_mtime("path"))
    return hits.join(own, "path", "left").withColumn("mtime", iso_time(ns)).drop("mtime_ns")


def run_query(chunks: DataFrame, query: str, limit: int, prefix: str | None = None) -> DataFrame | None:
    """Top rows of a query, or None if it is no query."""
    try:
        tree = Q.parse(query)
    except Q.QuerySyntaxError:
        return None
    return top(scored(chunks, tree), limit, prefix)


def ladder(run: Callable[[str], DataFrame | None], none: DataFrame, query: str, strict: bool = False) -> DataFrame:
    """The relaxation ladder over `run`, which gives a query's rows, or None if it is no query.

    The query as it stands; if it is no query or finds nothing, its words all together; if that finds nothing, any of them. Strict
    search, or operators in the query, keep it from loosening what was found empty; a query with operators that is no
    query finds nothing, and one without is repaired even if strict.
    """
    operators, words = Q.has_operators(query), Q.terms(query)
    tight = strict or operators
    found = run(query)
    if found is not None and (tight or not found.isEmpty()):
        return found
    if found is None and operators or not words:
        return none
    together = " ".join(words)
    if together != query or found is None:
        found = run(together)
        if found is not None and not found.isEmpty():
            return found
    if strict or len(words) < 2:
        return none
    return run(" OR ".join(words))


def search(chunks: DataFrame, query: str, limit: int = 10, strict: bool = False, prefix: str | None = None) -> DataFrame:
    """The ladder over tokenised chunks, without an index."""
    none = chunks.limit(0).withColumn("score", F.lit(0.0))
    return ladder(lambda q: run_query(chunks, q, limit, prefix), none, query, strict) if limit > 0 else none


def search_hits(found: DataFrame, files: DataFrame, query: str, max_chars: int | None = None) -> DataFrame:
    """Hit records of found chunks with snippets and times."""
    words = [w for t in Q.terms(query) for w in Q.fold_words(t)]
    snippet = clip_words(F.col("content"), max_chars) if max_chars else fragment(tokens(F.col("content")), words)
    return with_mtimes(shaped(found, "fts", snippet), files)
