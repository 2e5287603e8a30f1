"""Lexical retrieval packing into windows of fixed length.

Texts are tokenised map-side, and what a document has beyond whole windows of its own becomes an item. Items are written
with a lexical key, the least tokens of their token sets in three random orders that prefer rare tokens, so that items
with words in common have keys in common. Ranges of (key, doc_id, start) are sorted and cut into shards of at
most SHARD_IDS ids: neighbours by key share a shard at every size of the corpus, and a key that holds a third of all items
is cut by document. A task builds a BM25 inverted index over a shard's items and fills one window after another: a seed
document is the query, its best unused neighbours follow in order of score, and the first that doesn't fit is cut;
its rest seeds the next window. What a shard leaves of a window goes to the task's next shard, so only the last
window of a range is short, and that is cut at powers of two, which need no padding.

The number of ranges follows from the length of all items. Null texts count as empty: they are the end token alone. A
null doc_id stays null. Every row is packed, repeated rows too. An empty table gives an empty result; only
doc_id and text are read, so extra columns never clash.
"""

from __future__ import annotations

import functools
import itertools
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import arrow_rows, release_memory, text_or_empty, text_slices, trim_memory, written
from quern.llm.token_fst import byte_alphabet

WINDOW = 4096
END_ID = 2
#: Ids of items in a range, about, and in a shard, at most but for one item; the memory of a task follows from the latter.
RANGE_IDS = SHARD_IDS = 1_000_000
#: Ranges for each shuffle partition that the session is set to, at most.
RANGES = 4
#: Bytes of text that are tokenised at once, and rows that an executor holds for a Python worker at once.
BATCH, ROWS = 1 << 22, 1024
K1, B = 1.2, 0.75
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class WordTokenizer:
    """Ids of a tokenizer file that drops white space and merges within words; each distinct run of one kind of character is encoded once.

    Texts with special strings, with characters beyond the Latin blocks and common punctuation, or not in normal form are
    left to the library as a whole, since Unicode versions may differ there.
    """

    #: Bytes of distinct runs that are kept, about, before all are forgotten, with ROOM for the entry of each.
    MOST_BYTES, ROOM = 32 << 20, 160
    #: Dotted capital I is the one character here whose lower case is longer.
    PLAIN = re.compile("[^\t-\r -\x7e\xa0-\u012f\u0131-\u024f\u2010-\u2027]")
    BLANK, LETTER, NUMBER, OTHER, END = range(5)

    def __init__(self, path: str) -> None:
        import json

        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.model = self.library.model
        self.split = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        self.letters = {b: c for c, b in byte_alphabet().items()}
        steps = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if steps != ["NFC", "Replace", "Lowercase"] or not spec["model"]["end_of_word_suffix"]:
            raise ValueError("only files that normalise to NFC and lower case and merge within words")
        self.kind = np.full(0x2028, self.OTHER, np.uint8)
        for c in range(len(self.kind)):
            group = unicodedata.category(chr(c))[0]
            self.kind[c] = self.BLANK if chr(c).isspace() else {"L": self.LETTER, "N": self.NUMBER}.get(group, self.OTHER)
        self.kind[0] = self.END
        self.reset()

    def reset(self) -> None:
        self.index: dict[str, int] = {}
        self.kept = self.used = 0
        self.flat = np.zeros(1 << 16, np.uint16)
        #: Run k of the index is flat[bounds[k] : bounds[k + 1]].
        self.bounds = np.zeros(1 << 16, np.int64)

    def learn(self, runs: list[str]) -> None:
        """Encode new runs: split them by the file's pattern, and let the library's model merge each word."""
        ids: list[int] = []
        cuts = [0]
        word = self.model.tokenize
        for p in runs:
            if p.isalpha():  # one word; ASCII letters stand for themselves
                ids += [t.id for t in word(p if p.isascii() else p.encode().decode("latin-1").translate(self.letters))]
            else:
                for w in self.split(p):
                    ids += [t.id for t in word(w.encode().decode("latin-1").translate(self.letters))]
            cuts.append(len(ids))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        self.flat[self.used : self.used + len(ids)] = ids
        known = len(self.index)
        while known + len(cuts) > len(self.bounds):
            self.bounds = np.concatenate((self.bounds, np.zeros_like(self.bounds)))
        self.bounds[known : known + len(cuts)] = np.array(cuts) + self.used
        self.index.update(zip(runs, range(known, known + len(runs))))
        self.used += len(ids)
        self.kept += sum(map(len, runs)) + self.ROOM * len(runs)

    def plain(self, text: str) -> bool:
        return not self.PLAIN.search(text) and not any(s in text for s in self.special) and unicodedata.is_normalized("NFC", text)

    def runs(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(distinct runs, number of each run in order, runs in each text). A run is of letters, of numbers or of others; beside an apostrophe nothing is cut."""
        joined = ("\0".join(texts) + "\0").lower()
        raw = np.frombuffer(joined.encode(), np.uint8)
        points = raw if joined.isascii() else np.frombuffer(joined.encode("utf-16-le"), np.uint16)
        kind = self.kind[points]
        shown = (kind != self.BLANK) & (kind != self.END)
        begins = shown.copy()
        begins[1:] &= kind[1:] != kind[:-1]
        marks = np.flatnonzero(points == 39)
        if len(marks):
            gaps = np.concatenate(([-1], np.flatnonzero(~shown)))
            at = np.unique(np.searchsorted(gaps, marks))
            first, n = gaps[at - 1] + 2, np.maximum(0, gaps[at] - gaps[at - 1] - 2)
            begins[np.repeat(first - np.cumsum(n) + n, n) + np.arange(int(n.sum()))] = False
        starts = begins[shown]
        if points is raw:
            data, place = raw[shown], np.flatnonzero(starts)
        else:
            width = (1 + (points > 0x7F).astype(np.uint8) + (points > 0x7FF)).astype(np.uint8)
            data, own = raw[np.repeat(shown, width)], width[shown]
            wide, place = np.flatnonzero(own > 1), np.flatnonzero(starts)
            place += np.concatenate(([0], np.cumsum(own[wide] - 1, dtype=np.int64)))[np.searchsorted(wide, place)]
            del width, own, wide
        del joined, raw, points, shown, starts
        offsets = np.append(place, len(data)).astype(np.int32)
        found = pa.StringArray.from_buffers(len(place), pa.py_buffer(offsets), pa.py_buffer(data)).dictionary_encode()
        upto = np.searchsorted(np.flatnonzero(begins), np.flatnonzero(kind == self.END))
        return found.dictionary.to_pylist(), found.indices.to_numpy(zero_copy_only=False), np.diff(upto, prepend=0)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, without special tokens added."""
        plain = [bool(t) and self.plain(t) for t in texts]
        out: list = [np.zeros(0, np.uint16)] * len(texts)
        for ascii in (True, False):
            own = [k for k, t in enumerate(texts) if plain[k] and t.isascii() == ascii]
            if not own:
                continue
            if self.kept > self.MOST_BYTES:
                self.reset()
            distinct, order, count = self.runs([texts[k] for k in own])
            at = np.fromiter(map(self.index.get, distinct, itertools.repeat(-1)), np.int64, len(distinct))
            new = np.flatnonzero(at < 0)
            at[new] = len(self.index) + np.arange(len(new))
            self.learn([distinct[k] for k in new.tolist()])
            at = at[order]
            first, n = self.bounds[at], self.bounds[at + 1] - self.bounds[at]
            upto = np.concatenate(([0], np.cumsum(n)))
            spot = np.repeat(first - upto[:-1], n)
            spot += np.arange(len(spot))
            ids = self.flat[spot]
            del at, order, first, n, spot
            cuts = upto[np.concatenate(([0], np.cumsum(count)))]
            for k, a, b in zip(own, cuts, cuts[1:]):
                out[k] = ids[a:b]
        for k, t in enumerate(texts):
            if t and not plain[k]:
                out[k] = np.array(self.library.encode(t, add_special_tokens=False).ids, np.uint16)
        return out


@functools.lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


class Index:
    """BM25 over items of token ids: a row of weights for each token that many items hold, postings for the others."""

    #: A token in one of so many items has a row.
    FREQUENT = 16

    def __init__(self, items: list[np.ndarray]) -> None:
        n = len(items)
        size = np.array([len(x) for x in items])
        key = np.sort(np.concatenate(items).astype(np.int64) << 32 | np.repeat(np.arange(n), size)) if n else np.zeros(0, np.int64)
        new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        tf = np.diff(np.append(new, len(key)))
        token, item = key[new] >> 32, key[new] & 0xFFFFFFFF
        df = np.bincount(token, minlength=int(token.max(initial=0)) + 1)
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * size / max(1.0, size.mean())) if n else size
        weight = idf[token] * tf * (K1 + 1) / (tf + norm[item])
        often = df * self.FREQUENT >= max(n, 1)
        self.row = np.where(often, np.cumsum(often) - 1, -1)
        self.rows = np.zeros((int(often.sum()), n))
        own = often[token]
        self.rows[self.row[token[own]], item[own]] = weight[own]
        self.item, self.weight = item[~own], weight[~own]
        self.cut = np.searchsorted(token[~own], np.arange(len(df) + 1))
        self.n = n

    def scores(self, query: np.ndarray) -> np.ndarray:
        """BM25 of every item for the distinct tokens of a query."""
        asked = np.zeros(len(self.row), bool)
        asked[query] = True
        t = np.flatnonzero(asked)
        row = self.row[t]
        use = np.zeros(len(self.rows))
        use[row[row >= 0]] = 1
        t = t[row < 0]
        a, n = self.cut[t], self.cut[t + 1] - self.cut[t]
        at = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return use @ self.rows + np.bincount(self.item[at], self.weight[at], self.n)


def fill(items: list[np.ndarray], last: bool = True, window: int = WINDOW) -> Iterator[tuple[int, int, int, int, int]]:
    """(item, start, length, window number, offset) of every piece; each id of each item lies in one piece.

    Unless it is the `last` shard, what would make a short window is given back instead, with window number -1.
    """
    index = Index(items)
    unused = np.ones(len(items), bool)
    order = np.argsort(-np.array([len(x) for x in items]), kind="stable")
    nxt, number = 0, 0
    rest: tuple[int, int] | None = None
    while True:
        if rest is None:
            while nxt < len(order) and not unused[order[nxt]]:
                nxt += 1
            if nxt == len(order):
                return
            seed, at = int(order[nxt]), 0
            unused[seed] = False
        else:
            seed, at = rest
        pieces, room = [(seed, at, len(items[seed]) - at)], window - (len(items[seed]) - at)
        rest = None
        if room and unused.any():
            score = index.scores(items[seed].astype(np.int64))
            left = np.flatnonzero(unused)
            for k in left[np.argsort(-score[left], kind="stable")].tolist():
                unused[k] = False
                take = min(room, len(items[k]))
                pieces.append((k, 0, take))
                room -= take
                if take < len(items[k]):
                    rest = k, take
                if not room:
                    break
        used = window - room
        if not room:
            offset = 0
            for k, a, n in pieces:
                yield k, a, n, number, offset
                offset += n
            number += 1
            continue
        if not last:
            for k, a, n in pieces:
                yield k, a, n, -1, 0
            return
        # The last window: cut at powers of two.
        sizes = [1 << b for b in range(window.bit_length() - 1, -1, -1) if used >> b & 1]
        offset = 0
        for k, a, n in pieces:
            while n:
                take = min(n, sizes[0] - offset)
                yield k, a, take, number, offset
                a, n, offset = a + take, n - take, offset + take
                if offset == sizes[0]:
                    sizes.pop(0)
                    number, offset = number + 1, 0
        return


@functools.lru_cache(maxsize=2)
def orders(tokens: int, end_id: int) -> np.ndarray:
    """Three random orders of the vocabulary, by exponential clocks. A token's rate is the square of the logarithm of its number,
    since vocabularies of merges are numbered from frequent to rare; the end token is last."""
    u = np.random.default_rng(8675309).random((3, tokens))
    clock = -np.log(u) / np.log(np.arange(tokens) + 2.0) ** 2
    clock[:, end_id] = np.inf
    return np.argsort(np.argsort(clock, axis=1), axis=1).astype(np.uint16)


def lexical_keys(items: list[np.ndarray], end_id: int) -> np.ndarray:
    """The least token of each item in each of the three orders, 16 bits each; items are not empty."""
    flat = np.concatenate(items)
    starts = np.cumsum([0, *map(len, items)])[:-1]
    key = np.zeros(len(items), np.int64)
    for order in orders(1 << 16, end_id):
        key = key << 16 | np.minimum.reduceat(order[flat], starts)
    return key


ITEMS = "key long, doc_id long, start long, length long, doc_tokens long, crc long, ids binary"


def items_of(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Rows by ITEMS: whole windows of long documents have no ids, and their key only spreads them; the rests have ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        for batch in batches:
            column, doc_ids = batch.column("text"), batch.column("doc_id")
            for a, b in text_slices(column, BATCH):
                out, rests = [], []
                for doc_id, ids in zip(doc_ids.slice(a, b - a).to_pylist(), tok.encode(column.slice(a, b - a).to_pylist())):
                    ids = np.append(ids, np.uint16(end_id))
                    for start in range(0, len(ids), window):
                        p = ids[start : start + window]
                        check = crc(p)
                        if len(p) == window:
                            out.append((check << 16 | start >> 12 & 0xFFFF, doc_id, start, window, len(ids), check, None))
                        else:
                            rests.append((doc_id, start, len(p), len(ids), check, p))
                keys = lexical_keys([r[-1] for r in rests], end_id).tolist() if rests else []
                out += [(key, *r[:-1], r[-1].astype("<u2").tobytes()) for key, r in zip(keys, rests)]
                yield pa.RecordBatch.from_arrays([pa.array(x, f) for x, f in zip(zip(*out), [pa.int64()] * 6 + [pa.binary()])], [c.split()[0] for c in ITEMS.split(", ")])
                del out, rests, keys
                trim_memory()
        tok.reset()  # idle workers stay
        release_memory()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, ITEMS)


class Range:
    """Packs the items of a range, in order, shard by shard."""

    def __init__(self, first: int, window: int = WINDOW) -> None:
        self.number, self.window = first, window
        self.items: list[tuple[int, int, int, np.ndarray]] = []  # doc_id, start, doc_tokens, ids
        self.held = 0

    def add(self, item: tuple[int, int, int, np.ndarray]) -> None:
        self.items.append(item)
        self.held += len(item[3])

    def pack(self, last: bool) -> list[tuple]:
        """Rows by SCHEMA for the shard; what is left of a window stays."""
        shard, self.items, self.held = self.items, [], 0
        out, most = [], -1
        for i, a, n, seq, offset in fill([x[3] for x in shard], last, self.window):
            doc_id, start, tokens, ids = shard[i]
            if seq < 0:
                self.add((doc_id, start + a, tokens, ids[a : a + n]))
                continue
            out.append((doc_id, start + a, n, crc(ids[a : a + n]), tokens, self.number + seq, offset))
            most = max(most, seq)
        self.number += most + 1
        return out


def pack_range(window: int, shard_ids: int):
    """Over the sorted items of a range: its pieces, by SCHEMA. Sequence ids begin with the number of the range."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        frame = lambda rows: pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")]).astype({"doc_id": "Int64"})
        r = Range(TaskContext.get().partitionId() << 32, window)
        for pdf in batches:
            whole = []
            for doc_id, start, length, tokens, check, ids in zip(pdf["doc_id"].astype("Int64").tolist(), pdf["start"].tolist(), pdf["length"].tolist(), pdf["doc_tokens"].tolist(), pdf["crc"].tolist(), pdf["ids"]):
                if ids is None:
                    whole.append((doc_id, start, length, int(check), tokens, r.number, 0))
                    r.number += 1
                    continue
                r.add((doc_id, start, tokens, np.frombuffer(ids, "<u2")))
                if r.held >= shard_ids:
                    yield frame(r.pack(False))
            if whole:
                yield frame(whole)
        if r.items:
            yield frame(r.pack(True))
        release_memory()

    return run


def dealt(items: DataFrame, ranges: int) -> DataFrame:
    """Items by lexical key in `ranges` sorted ranges; the columns after the key cut a key that many items have."""
    by = ("key", "doc_id", "start", "crc", "length")
    return items.repartitionByRange(ranges, *by).sortWithinPartitions(*by)


def pack(docs: DataFrame, path: str, window: int = WINDOW, range_ids: int = RANGE_IDS, shard_ids: int = SHARD_IDS) -> DataFrame:
    """One row per piece, by SCHEMA."""
    with arrow_rows(docs.sparkSession, ROWS):
        items = written(items_of(docs, path, window))
    total = items.where("ids is not null").agg(F.sum("length")).first()[0] or 0
    most = RANGES * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt(items, max(1, min(-(-total // range_ids), most))).mapInPandas(pack_range(window, shard_ids), SCHEMA)
