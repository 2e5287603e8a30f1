"""Toxicity scores: gradient-boosted trees over dense text features, with isotonic calibration.

Features are lexicon densities (a fixed list, and word beginnings mined from labelled rows), the
proximity of second-person words to lexicon words, and rates of capitals, punctuation and obfuscation. They
read whole texts and nothing but texts.

Labels come only from rows whose crc32(doc_id as text) mod 5 is not 0, of which a sample of at most
SAMPLE rows, least by hash of the id, is used, one for each id. The rows of one half are described by the word beginnings mined from
the other half, so that no row judges a lexicon that it helped to make; three quarters of them grow the
trees and a quarter calibrates. Documents are scored with the beginnings mined from all the sample.

Null and empty texts get the score of a text without words. Rows that repeat are scored alike. A null
doc_id stays null, with held_out null. Without labels of both kinds the score is the labelled rate, and 0 without any
label. Empty tables give empty results; extra columns of any name pass through `drop_toxic`.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import settle, text_or_empty
from quern.llm.gbdt import Boosted, Isotonic

#: Labelled rows that the model may learn from, at most.
SAMPLE = 16_000
#: Share of words, over all rows, that every beginning is given beforehand on both sides.
PRIOR = 0.02
#: Lengths of mined word beginnings; toxic rows that must hold one; least ratio of its mean share of a row's words. All that pass are taken; SAMPLE bounds them.
LENGTHS, SUPPORT, RATIO = (3, 4, 5, 6, 7), 5, 12.0
#: Fixed lists.
INSULTS = frozenset("idiot moron stupid dumb loser pathetic worthless disgusting trash scum clown fool ugly imbecile jerk filth vermin".split())
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split())
LEET = str.maketrans("013457@$!", "oieastasi")
NEAR = 5
NAMES = ["words", "word_length", "insults", "beginnings", "beginning_weight", "beginning_count", "beginning_top", "second_person", "near_second_person", "capitals", "capital_words", "exclamations", "questions", "marks", "symbols", "digits", "obfuscated", "leet_insults", "stretched", "variety", "top_word"]
_STRIP = re.compile(r"^[^\w]+|[^\w]+$")
_MIXED = re.compile(r"[^\W\d_][^\w\s'’-]+[^\W\d_]|[^\W\d_][0-9@$]+[^\W\d_]")
_STRETCHED = re.compile(r"(\w)\1\1")


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


class Features:
    """Feature rows of texts, given mined word beginnings and their weights."""

    MOST_WORDS = 300_000

    def __init__(self, beginnings: dict[str, float]) -> None:
        self.beginnings = beginnings
        self.known: dict[str, tuple[str, float, int]] = {}

    def word(self, w: str) -> tuple[str, float, int]:
        """(bare word, weight of its longest mined beginning, flags: 1 insult, 2 second person, 4 obfuscated, 8 insult in disguise, 16 stretched)."""
        bare = _STRIP.sub("", w)
        weight = next((self.beginnings[bare[:k]] for k in reversed(LENGTHS) if bare[:k] in self.beginnings), 0.0)
        mixed = bool(_MIXED.search(bare))
        plain = re.sub(r"[^a-z]", "", w.translate(LEET))
        flags = (bare in INSULTS) | 2 * (bare in SECOND_PERSON) | 4 * mixed | 8 * (bare not in INSULTS and plain in INSULTS) | 16 * bool(_STRETCHED.search(bare))
        return bare, weight, flags

    def rows(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), len(NAMES)))
        if len(self.known) > self.MOST_WORDS:
            self.known.clear()
        for k, t in enumerate(texts):
            out[k] = self.row(t)
        return out

    def row(self, text: str) -> list[float]:
        words, known = text.lower().split(), self.known
        for w in set(words).difference(known):
            known[w] = self.word(w)
        found = [known[w] for w in words]
        n = max(1, len(words))
        flags = np.fromiter((f for _, _, f in found), np.int64, len(found))
        weight = np.fromiter((x for _, x, _ in found), np.float64, len(found))
        bad, person = np.flatnonzero((weight > 0) | (flags & 9 > 0)), np.flatnonzero(flags & 2)
        near = 0
        if len(bad) and len(person):
            at = np.searchsorted(person, bad)
            gap = np.minimum(np.abs(person[np.minimum(at, len(person) - 1)] - bad), np.abs(person[np.maximum(at - 1, 0)] - bad))
            near = int((gap <= NEAR).sum())
        b = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
        letters = max(1, int(b[65:91].sum() + b[97:123].sum() + b[192:].sum()))
        chars = max(1, len(text))
        tops = Counter(w for w, _, _ in found)
        capital_words = sum(1 for w in text.split() if len(w) > 2 and w.isupper()) if b[65:91].sum() > 3 else 0
        return [
            np.log1p(len(words)), chars / n, (flags & 1).sum() / n, (weight > 0).sum() / n, weight.sum() / n, np.log1p((weight > 0).sum() + (flags & 9 > 0).sum()),
            weight.max(initial=0.0), len(person) / n, near / n, b[65:91].sum() / letters, capital_words / n, b[33] / chars, b[63] / chars,
            (b[44] + b[46] + b[58] + b[59]) / chars, (b[35:39].sum() + b[42] + b[64] + b[94] + b[126]) / chars, b[48:58].sum() / chars,
            (flags & 4 > 0).sum() / n, (flags & 8 > 0).sum() / n, (flags & 16 > 0).sum() / n, len(tops) / n, max(tops.values(), default=0) / n,
        ]


class Model:
    """Word beginnings, trees and calibration."""

    def __init__(self, beginnings: dict[str, float], trees: Boosted, scale: Isotonic) -> None:
        self.beginnings, self.trees, self.scale = beginnings, trees, scale

    def scores(self, x: np.ndarray) -> np.ndarray:
        return self.scale.apply(self.trees.margin(x))


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(text, toxic, half) of at most `sample` labelled rows that are not held out."""
    few = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    few = few.select("doc_id", F.col("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    half = (F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2))).cast("int").alias("half")
    few = few.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # at most `sample` rows of two numbers are broadcast; of rows that repeat an id the least text is learned from
    rows = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(few), "doc_id")
    return settle(rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")).select("text", "toxic", half))


def mined(sample: DataFrame) -> dict[str, float]:
    """Word beginnings whose mean share of a row's words is far larger in toxic rows than in others, with the logarithm of that ratio.

    A share is of the row's own words, so a long row counts as much as a short one.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yes, no, held = Counter(), Counter(), Counter()
            for text, toxic in zip(pdf["text"], pdf["toxic"]):
                own: Counter = Counter()
                words = text.lower().split()
                for w, n in Counter(words).items():
                    bare = _STRIP.sub("", w)
                    for k in LENGTHS:
                        if len(bare) >= k:
                            own[bare[:k]] += n
                side = yes if toxic else no
                for g, n in own.items():
                    side[g] += n / len(words)
                if toxic:
                    held.update(own.keys())
            keys = list(yes.keys() | no.keys())
            yield pd.DataFrame({"g": keys, "yes": [float(yes[x]) for x in keys], "no": [float(no[x]) for x in keys], "held": [held[x] for x in keys]})

    totals = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    p, n = totals.get(1, 0), totals.get(0, 0)
    # whole steps, so that sums do not depend on the order of rows
    whole = lambda c: (F.sum(F.round(F.col(c) * 1e9).cast("long")) / 1e9).alias(c)
    grams = sample.select("text", "toxic").mapInPandas(count, "g string, yes double, no double, held long").groupBy("g").agg(whole("yes"), whole("no"), F.sum("held").alias("held"))
    ratio = ((F.col("yes") + PRIOR) / (p + 1)) / ((F.col("no") + PRIOR) / (n + 1))
    rows = grams.where(F.col("held") >= SUPPORT).withColumn("ratio", ratio).where(F.col("ratio") >= RATIO).orderBy("g").collect()
    found = {r["g"]: float(np.log(r["ratio"])) for r in rows}
    # a longer beginning says more only where it is clearly the better sign
    return {g: v for g, v in found.items() if not any(found.get(g[:k], 0.0) >= v - 0.5 for k in LENGTHS if k < len(g))}


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from the labelled rows of `docs` that are not held out."""
    rows = labelled_sample(docs, labels, sample)
    lexicons = [mined(rows.where(F.col("half") == 1 - k)) for k in (0, 1)]
    beginnings = mined(rows)

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        both = [Features(x) for x in lexicons]
        for pdf in batches:
            yield pd.DataFrame({"x": [both[h].row(t) for t, h in zip(pdf["text"], pdf["half"])], "y": pdf["toxic"]})

    got = rows.mapInPandas(features, "x array<double>, y int").toPandas()
    if not len(got):
        return Model(beginnings, Boosted(), Isotonic())
    x, y = np.array(got["x"].tolist()), got["y"].to_numpy().astype(float)
    order = np.lexsort(np.column_stack((x, y)).T)  # the same model whatever the order of rows
    x, y = x[order], y[order]
    calibrate = np.arange(len(y)) % 4 == 0
    both = len(set(y[calibrate])) == 2
    trees = Boosted().fit(x[~calibrate] if both else x, y[~calibrate] if both else y)
    held = trees.margin(x[calibrate] if both else x)
    return Model(beginnings, trees, Isotonic().fit(held, y[calibrate] if both else y))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = Features(model.beginnings)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "score": model.scores(f.rows(pdf["text"].tolist()))})

    return docs.select("doc_id", text_or_empty().alias("text")).mapInPandas(run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    out = scored(docs, fit(docs, labels, sample))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of `docs` that score below 0.5, with all their columns; texts are scored in place, without a join."""
    model = fit(docs, labels, sample)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        f = Features(model.beginnings)
        for texts in batches:
            yield pd.Series(model.scores(f.rows(texts.fillna("").tolist())))

    return docs.where(score(F.col("text")) < 0.5)
