"""Multisets of word shingles, and their BagMinHash signatures, in numpy.

A document is the multiset of its five-word shingles. For a shingle of count w the generator is a
Poisson process over (level, time), with levels in the dyadic intervals [0, 1), [1, 2), [2, 4), ... that
begin below w; each interval has its own process of rate m times its length, each point a uniform level
within it and a uniform signature slot, and points at levels of w or more are thinned out. The
signature keeps the first time in each slot. Two multisets agree in a slot with a probability that is
exactly their weighted Jaccard similarity. Points later than the bound by which all slots of a document
are full are never generated, so a document takes about m ln m points besides one per shingle.
"""

from __future__ import annotations

import hashlib

import numpy as np

SHINGLE = 5
BANDS, ROWS = 24, 6
SLOTS = BANDS * ROWS

U = np.uint64
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**64, 256, dtype=np.uint64, endpoint=False) | U(1)
_P = U(0x9E3779B97F4A7C15 | 1)
_PINV = U(pow(int(_P), -1, 2**64))
_Q = [U(int(x) | 1) for x in _rng.integers(1, 2**63, SHINGLE)]
_SALT = [U(int(x) | 1) for x in _rng.integers(1, 2**63, 4)]
#: Word characters of lower-case UTF-8: ASCII letters and digits, and all bytes of other characters.
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_powers: dict[str, np.ndarray] = {}


def _pow(base: np.uint64, n: int, name: str) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 20), base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _powers[name] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, 48-bit shingle hash, count), sorted by the first two; a text of fewer than five words is one shingle."""
    raws = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join(raws) + b" ", np.uint8)
    ends = np.cumsum([len(r) + 1 for r in raws])
    word = _WORD[data]
    edge = np.flatnonzero(np.diff(word, prepend=False))
    start, stop = edge[::2], edge[1::2]
    if not len(start):
        empty = np.zeros(0, np.int64)
        return empty, empty.astype(np.uint64), empty
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _pow(_P, len(data), "p"), out=total[1:])
    h = mix((total[stop] - total[start]) * _pow(_PINV, len(data), "inverse")[start])
    doc = np.searchsorted(ends, start, side="right")
    n = len(h)
    if n >= SHINGLE:
        whole = doc[: n - SHINGLE + 1] == doc[SHINGLE - 1 :]
        s = h[: n - SHINGLE + 1] * _Q[0]
        for j in range(1, SHINGLE):
            s += h[j : n - SHINGLE + 1 + j] * _Q[j]
        s, d = mix(s[whole]), doc[: n - SHINGLE + 1][whole]
    else:
        s, d = h[:0], doc[:0]
    words = np.bincount(doc, minlength=len(texts))
    short = np.flatnonzero((words > 0) & (words < SHINGLE))
    if len(short):
        first = np.searchsorted(doc, short)
        own = np.zeros(len(short), np.uint64)
        for j in range(SHINGLE - 1):
            has = words[short] > j
            own[has] += h[first[has] + j] * _Q[j]
        s, d = np.concatenate((s, mix(own + words[short].astype(np.uint64)))), np.concatenate((d, short))
    counts_d, counts_h, counts = [], [], []
    for a in range(0, len(texts), 1 << 15):  # the text's number takes the upper 16 bits of a sort key
        sel = (d >= a) & (d < a + (1 << 15)) if len(texts) > 1 << 15 else slice(None)
        key = np.sort((d[sel] - a).astype(np.uint64) << U(48) | s[sel] >> U(16))
        if not len(key):
            continue
        new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        counts.append(np.diff(np.append(new, len(key))))
        key = key[new]
        counts_d.append((key >> U(48)).astype(np.int64) + a)
        counts_h.append(key & U((1 << 48) - 1))
    return np.concatenate(counts_d), np.concatenate(counts_h), np.concatenate(counts)


def elements(h: np.ndarray, count: np.ndarray) -> np.ndarray:
    """A multiset as a set: one 64-bit value per occurrence, so that set overlap is multiset overlap."""
    rep = np.repeat(h, count)
    nth = np.arange(len(rep)) - np.repeat(np.cumsum(count) - count, count)
    return mix(rep * _SALT[0] + nth.astype(np.uint64) * _SALT[1]).view(np.int64)


def _points(h, interval, nth):
    """Uniform numbers of the nth point of a process: for its waiting time, its slot and its level."""
    a = mix(h * _SALT[0] + interval * _SALT[1] + nth * _SALT[2])
    b = mix(a ^ _SALT[3])
    wait = -np.log(((a >> U(11)).astype(np.float64) + 0.5) * 2.0**-53)
    return wait, b >> U(32), (b & U(0xFFFFFFFF)).astype(np.float64) * 2.0**-32


def signatures(doc: np.ndarray, h: np.ndarray, count: np.ndarray, docs: int, slots: int = SLOTS) -> np.ndarray:
    """First times by document and slot; infinite for a document without shingles."""
    out = np.full((docs, slots), np.inf)
    weight = np.bincount(doc, count, docs)
    bound = np.divide(np.log(slots) + 3, weight, out=np.zeros(docs), where=weight > 0)
    todo = weight > 0
    while todo.any():
        sel = todo[doc]
        _fill(out, doc[sel], h[sel], count[sel], bound, slots)
        todo &= np.isinf(out).any(axis=1)
        bound = np.where(todo, bound * 1.7, bound)
    return out


def _fill(out, doc, h, count, bound, slots) -> None:
    flat = out.reshape(-1)
    top = int(count.max(initial=1))
    level = 0
    while level == 0 or 1 << (level - 1) < top:
        low, size = (0.0, 1.0) if level == 0 else (float(1 << (level - 1)), float(1 << (level - 1)))
        sel = np.flatnonzero(count > low)
        d, hh, w = doc[sel], h[sel], count[sel]
        t, n = np.zeros(len(sel)), 0
        interval = U(level)
        while len(d):
            block = 1 if not n else int(np.clip(8192 // len(d), 1, 64))
            nth = np.arange(n, n + block, dtype=np.uint64)
            wait, slot, at = _points(hh[:, None], interval, nth[None, :])
            times = t[:, None] + np.cumsum(wait, axis=1) / (slots * size)
            fits = times <= bound[d][:, None]
            r, c = np.nonzero(fits & (low + at * size < w[:, None]))
            np.minimum.at(flat, d[r] * slots + (slot[r, c] * U(slots) >> U(32)).astype(np.int64), times[r, c])
            go = fits[:, -1]
            d, hh, w, t, n = d[go], hh[go], w[go], times[go, -1], n + block
        level += 1


def band_keys(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key by document and band."""
    bits = sig.view(np.uint64).reshape(len(sig), bands, rows)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64) * _SALT[2], (len(sig), bands)).copy()
    for r in range(rows):
        key = mix(key * _SALT[1] + bits[:, :, r])
    return key.view(np.int64)


def slot_bytes(sig: np.ndarray) -> np.ndarray:
    """One byte by document and slot: equal slots have equal bytes, others by chance once in 256."""
    return (mix(sig.view(np.uint64)) & U(255)).astype(np.uint8)


def digest(h: np.ndarray, count: np.ndarray) -> bytes:
    """Equal for equal multisets."""
    return hashlib.blake2b(h.tobytes() + count.astype(np.int64).tobytes(), digest_size=16).digest()
