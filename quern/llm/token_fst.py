"""A byte-level BPE tokenizer compiled to two deterministic transducers that count tokens.

Words. The splitting pattern of the byte-level tokenizer family is a transducer of 12 states over 12
character classes. A transition says whether a word begins at the character it reads and, where the pattern
looks ahead, whether one begins at the character before. Texts are cut into chunks; each chunk's map
from entry states to exit states is computed for all states at once, the maps compose in a
parallel prefix scan, and a second pass over all chunks, now with known entry states, emits the word starts.

Tokens. Within a word, the encoding of a prefix is the encoding of a shorter prefix plus one token, and a
sequence of tokens is an encoding exactly if each two neighbours are. So a state needs, for each
earlier position that a vocabulary entry may still span, the trie node reached from there, the token that
ends there, and how many tokens lie before it, relative to here. That is a finite set; states are determinised on
demand and kept in a table whose transitions carry the change of the token count.

Long words are cut into chunks too. Their states are too many for whole maps, so a chunk's map is computed for the entry
states that occur: all chunks run together from a guessed entry; then each takes its neighbour's exit for its entry and runs again
only until it meets its former path, from where exit and counts are known. Where that does not settle soon, as in
periodic texts, the chunks that are left are walked in order.
"""

from __future__ import annotations

import json
import sys
import unicodedata

import numpy as np

# Character classes
STMD, R, V, LL, E, LETTER, NUMBER, OTHER, SPACE, WHITE, QUOTE, END = range(12)
# States of the word transducer
START, IN_L, IN_N, IN_O, ONE_SPACE, ONE_WHITE, MORE_SPACE, MORE_WHITE, QUOTED, QUOTED_R, QUOTED_V, QUOTED_L = range(12)
N_STATES = N_CLASSES = 12
#: White space of the pattern's \s, as code points.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
CHUNK = 64
#: Bytes of words that advance together.
SLICE = 1 << 17
#: Words of more bytes are cut into chunks of CHAIN bytes; after ROUNDS of exchanged states the rest is walked.
LONG, CHAIN, ROUNDS = 2048, 256, 6


def character_classes() -> np.ndarray:
    """Class by code point, from Unicode's general categories."""
    table = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for c in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            table[c] = LETTER
        elif kind == "N":
            table[c] = NUMBER
    table[WHITE_SPACE] = WHITE
    table[0x20] = SPACE
    table[ord("'")] = QUOTE
    for group, cls in (("stmd", STMD), ("r", R), ("v", V), ("l", LL), ("e", E)):
        table[[ord(x) for x in group]] = cls
    return table


def word_transducer() -> tuple[np.ndarray, np.ndarray]:
    """(next state, emission) by state and class; emission bit 0: a word starts here, bit 1: one starts a character earlier."""
    letters = {STMD, R, V, LL, E, LETTER}
    opens = {NUMBER: IN_N, OTHER: IN_O, SPACE: ONE_SPACE, WHITE: ONE_WHITE, QUOTE: QUOTED} | dict.fromkeys(letters, IN_L)
    joins = opens | {QUOTE: IN_O}
    run_of = {IN_L: letters, IN_N: {NUMBER}, IN_O: {OTHER, QUOTE}}
    after_white = {SPACE: MORE_SPACE, WHITE: MORE_WHITE}

    def step(s: int, c: int) -> tuple[int, int]:
        if c == END:
            return START, 2 * (s in (QUOTED_R, QUOTED_V, QUOTED_L))
        if s in run_of:
            return (s, 0) if c in run_of[s] else (opens[c], 1)
        if s in (ONE_SPACE, ONE_WHITE, MORE_SPACE, MORE_WHITE):
            if c in after_white:
                return after_white[c], 0
            early = 2 * (s in (MORE_SPACE, MORE_WHITE))
            return (joins[c], early) if s in (ONE_SPACE, MORE_SPACE) else (opens[c], early | 1)
        if s == QUOTED:
            if c in (STMD, R, V, LL):
                return {STMD: START, R: QUOTED_R, V: QUOTED_V, LL: QUOTED_L}[c], 0
            return (IN_O, 0) if c in run_of[IN_O] else (opens[c], 1)
        if s in (QUOTED_R, QUOTED_V, QUOTED_L):
            if c == (LL if s == QUOTED_L else E):
                return START, 0
            n, emit = step(IN_L, c)
            return n, emit | 2
        return opens[c], 1

    both = np.array([[step(s, c) for c in range(N_CLASSES)] for s in range(N_STATES)], np.uint8)
    return both[:, :, 0].copy(), both[:, :, 1].copy()


class WordSplitter:
    """Word starts by chunk state maps and a parallel prefix scan."""

    def __init__(self) -> None:
        self.classes = character_classes()
        nxt, emit = word_transducer()
        self.next, self.emit = nxt.reshape(-1), emit.reshape(-1)

    def starts(self, points: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Where words start in `points`, code points of texts that each end with a filler; `ends` are the fillers' places."""
        n = len(points)
        cls = self.classes[points]
        cls[ends] = END
        chunks = -(-n // CHUNK)
        grid = np.full(chunks * CHUNK, END, np.uint8)
        grid[:n] = cls
        grid = np.ascontiguousarray(grid.reshape(chunks, CHUNK).T)
        maps = np.broadcast_to(np.arange(N_STATES, dtype=np.uint8), (chunks, N_STATES)).copy()
        for row in grid:
            maps = self.next[maps * np.uint8(N_CLASSES) + row[:, None]]
        entry = self.scan(maps)
        out = np.zeros((CHUNK, chunks), np.uint8)
        state = entry
        for k, row in enumerate(grid):
            at = state * np.uint8(N_CLASSES) + row
            out[k] = self.emit[at]
            state = self.next[at]
        flags = np.ascontiguousarray(out.T).reshape(-1)[:n]
        here = (flags & 1).astype(bool)
        here[:-1] |= (flags[1:] & 2).astype(bool)
        return here

    @staticmethod
    def scan(maps: np.ndarray) -> np.ndarray:
        """Entry state of each chunk, from START: maps compose over spans that double."""
        run, span = maps.copy(), 1
        while span < len(run):
            run[span:] = np.take_along_axis(run[span:], run[:-span], axis=1)
            span *= 2
        return np.concatenate((np.array([START], np.uint8), run[:-1, START]))


def byte_alphabet() -> dict[str, int]:
    """The byte of each letter that byte-level vocabularies are written in."""
    printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printed]
    return {chr(b): b for b in printed} | {chr(256 + k): b for k, b in enumerate(rest)}


class TokenCounter:
    """Token counts of byte words under a list of merges, as a transducer that is determinised on demand."""

    def __init__(self, merges: list[tuple[bytes, bytes]], most_states: int = 120_000) -> None:
        self.ids: dict[bytes, int] = {bytes([b]): b for b in range(256)}
        self.parts: list[tuple[int, int] | None] = [None] * 256
        self.rank: dict[tuple[int, int], int] = {}
        for left, right in merges:
            pair = self.ids[left], self.ids[right]
            self.rank[pair] = len(self.parts)  # ids beyond the bytes are in order of merging
            self.ids[left + right] = len(self.parts)
            self.parts.append(pair)
        self.child: dict[int, int] = {}
        self.token_at: list[int] = [-1]
        self.inner = bytearray([1])
        for text, token in self.ids.items():
            node = 0
            for b in text:
                nxt = self.child.get(node << 8 | b)
                if nxt is None:
                    nxt = self.child[node << 8 | b] = len(self.token_at)
                    self.token_at.append(-1)
                    self.inner.append(0)
                self.inner[node] = 1
                node = nxt
            self.token_at[node] = token
        self.fits: dict[tuple[int, int], bool] = {}
        self.most_states = most_states
        self.reset()

    def reset(self) -> None:
        """Forget all states, so that memory stays bounded."""
        self.states: dict[tuple, int] = {}
        self.keys: list[tuple] = []
        self.column = np.full(256, -1, np.int64)
        self.columns = 0
        self.table = np.full((1024, 64), -1, np.int32)
        self.state(((0, -1, 0),))

    def state(self, key: tuple) -> int:
        n = self.states.get(key)
        if n is None:
            n = self.states[key] = len(self.keys)
            self.keys.append(key)
            if n >= len(self.table):
                self.table = np.concatenate((self.table, np.full_like(self.table, -1)))
        return n

    def neighbours(self, a: int, b: int) -> bool:
        """Whether a, b can stand side by side in an encoding.

        The merges at the border are undone from the last one back. At each point the two tokens that
        touch must not have been a pair that BPE would have merged earlier; of equal merges the left one comes first.
        """
        known = self.fits.get((a, b))
        if known is not None:
            return known
        x, y, before, ok = a, b, 1 << 60, True
        while True:
            if self.rank.get((x, y), 1 << 60) < before:
                ok = False
                break
            right_last = y >= 256 and y >= x
            if right_last:
                before, y = y + 1, self.parts[y][0]
            elif x >= 256:
                before, x = x, self.parts[x][1]
            else:
                break
        self.fits[a, b] = ok
        return ok

    def step(self, state: int, byte: int) -> int:
        """The packed transition: next state << 8 | change of the count + 128."""
        live, found = [], None
        for node, last, count in self.keys[state]:
            nxt = self.child.get(node << 8 | byte)
            if nxt is None:
                continue
            token = self.token_at[nxt]
            if token >= 0 and found is None and (last < 0 or self.neighbours(last, token)):
                found = token, count + 1
            if self.inner[nxt]:
                live.append((nxt, last, count))
        token, total = found
        key = tuple((n, p, c - total) for n, p, c in live) + ((0, token, 0),)
        return self.state(key) << 8 | (total + 128)

    def learn(self, states: np.ndarray, bytes_: np.ndarray) -> None:
        pairs = np.unique(states.astype(np.int64) << 8 | bytes_)
        for pair in pairs.tolist():
            state, byte = pair >> 8, pair & 255
            if self.column[byte] < 0:
                self.column[byte] = self.columns
                self.columns += 1
                if self.columns > self.table.shape[1]:
                    self.table = np.concatenate((self.table, np.full_like(self.table, -1)), axis=1)
            packed = self.step(state, byte)
            self.table[state, self.column[byte]] = packed

    def count(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Tokens of each word data[start : start + length]."""
        out = np.empty(len(start), np.int64)
        for k in np.flatnonzero(length > LONG):
            out[k] = self.long_word(data[start[k] : start[k] + length[k]])
        short = np.flatnonzero(length <= LONG)
        start, length = start[short], length[short]
        upto = np.cumsum(length)
        cuts = [0, *np.unique(np.searchsorted(upto, np.arange(SLICE, int(length.sum()), SLICE))), len(start)]
        for a, b in zip(cuts, cuts[1:]):
            if len(self.keys) > self.most_states:  # a slice adds at most a state a byte
                self.reset()
            if b > a:
                out[short[a:b]] = self.together(data, start[a:b], length[a:b])
        return out

    def long_word(self, data: np.ndarray) -> int:
        """Tokens of one word, slice by slice."""
        total, key = 0, self.keys[0]
        for a in range(0, len(data), SLICE):
            if len(self.keys) > self.most_states:
                self.reset()
            n, state = self.composed(data[a : a + SLICE], self.state(key))
            total, key = total + n, self.keys[state]
        return total

    def composed(self, data: np.ndarray, state: int) -> tuple[int, int]:
        """(tokens, exit state) of a slice of a word from an entry state, by maps of its chunks."""
        chunks = len(data) // CHAIN
        grid = np.ascontiguousarray(data[: chunks * CHAIN].reshape(chunks, CHAIN).T)
        entry = np.zeros(chunks, np.int64)
        entry[:1] = state
        path, upto = np.empty((CHAIN, chunks), np.int64), np.empty((CHAIN, chunks), np.int64)
        now, total = entry.copy(), np.zeros(chunks, np.int64)
        for k, row in enumerate(grid):
            now, change = self.advance(now, row)
            total += change
            path[k], upto[k] = now, total
        wrong = np.zeros(0, np.int64)
        for _ in range(ROUNDS):
            want = np.concatenate(([state], path[-1, :-1]))[:chunks]
            wrong = np.flatnonzero(want != entry)
            if not len(wrong):
                break
            entry[wrong] = want[wrong]
            own, now, total = wrong, want[wrong], np.zeros(len(wrong), np.int64)
            for k in range(CHAIN):
                now, change = self.advance(now, grid[k, own])
                total = total + change
                met = now == path[k, own]
                if met.any():  # from here on the former path holds, with another count
                    upto[k:, own[met]] += total[met] - upto[k, own[met]]
                    own, now, total = own[~met], now[~met], total[~met]
                    if not len(own):
                        break
                path[k, own], upto[k, own] = now, total
        if len(wrong):
            want = np.concatenate(([state], path[-1, :-1]))[:chunks]
            wrong = np.flatnonzero(want != entry)
        first = int(wrong[0]) if len(wrong) else chunks
        count = int(upto[-1, :first].sum()) if chunks else 0
        n, state = self.walk(data[first * CHAIN :], int(path[-1, first - 1]) if first else state)
        return count + n, state

    def walk(self, data: np.ndarray, state: int) -> tuple[int, int]:
        """(tokens, exit state) of bytes from a state, one by one."""
        total, known = 0, {}
        for b in data.tolist():
            v = known.get(state << 8 | b)
            if v is None:
                at, change = self.advance(np.array([state]), np.array([b], np.uint8))
                v = known[state << 8 | b] = int(at[0]), int(change[0])
            state = v[0]
            total += v[1]
        return total, state

    def advance(self, state: np.ndarray, bytes_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(next states, changes of the count)."""
        c = self.column[bytes_]
        v = self.table[state, c]
        missing = np.flatnonzero((v < 0) | (c < 0))
        if len(missing):
            self.learn(state[missing], bytes_[missing])
            v[missing] = self.table[state[missing], self.column[bytes_[missing]]]
        return (v >> 8).astype(np.int64), (v & 255).astype(np.int64) - 128

    def together(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The same; all words advance together, a byte a step."""
        order = np.argsort(-length, kind="stable")
        start, length = start[order], length[order]
        state, total = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        shorter = np.searchsorted(-length, -np.arange(1, int(length.max(initial=0)) + 1), side="right")
        for k, m in enumerate(shorter):
            state[:m], change = self.advance(state[:m], data[start[:m] + k])
            total[:m] += change
        out = np.empty_like(total)
        out[order] = total
        return out


class Tokenizer:
    """Counts of whole texts under a byte-level BPE file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec["pre_tokenizer"], spec["model"]
        if spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or model["type"] != "BPE" or model["ignore_merges"]:
            raise ValueError("only plain byte-level BPE files are compiled")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("only special tokens that match as they are")
        self.special = [t["content"] for t in spec["added_tokens"]]
        alphabet = byte_alphabet()
        as_bytes = lambda x: bytes(alphabet[c] for c in x)
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        self.words = WordSplitter()
        self.tokens = TokenCounter([(as_bytes(a), as_bytes(b)) for a, b in merges])

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(UTF-8 bytes, tokens) of each text. Special tokens in a text are one token each, as the library has it by default."""
        extra = np.zeros(len(texts), np.int64)
        parts, owner = [], []
        for k, t in enumerate(texts):
            cut = [t]
            for s in self.special:
                cut = [y for x in cut for y in x.split(s)] if s in t else cut
            extra[k] = len(cut) - 1
            parts += cut
            owner += [k] * len(cut)
        special_bytes = np.zeros(len(texts), np.int64)
        for k in np.flatnonzero(extra):
            special_bytes[k] = len(texts[k].encode()) - sum(len(p.encode()) for p, o in zip(parts, owner) if o == k)
        joined = "\0".join(parts) + "\0"
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum([len(p) + 1 for p in parts]) - 1
        here = self.words.starts(points, ends)
        width = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
        place = np.cumsum(width) - width
        data = np.frombuffer(joined.encode("utf-8", "surrogatepass"), np.uint8)
        here[ends] = True  # the fillers close the last words and are no words themselves
        at = np.flatnonzero(here)
        start = place[at]
        length = np.diff(np.append(start, len(data)))
        filler = np.zeros(len(points), bool)
        filler[ends] = True
        real = ~filler[at]
        n = self.tokens.count(data, start[real], length[real])
        part = np.searchsorted(ends, at[real])
        owner = np.array(owner, np.int64)
        tokens = np.bincount(owner[part], n, len(texts)).astype(np.int64) + extra
        size = np.bincount(owner, place[ends] - np.concatenate(([0], place[ends][:-1] + 1)), len(texts)).astype(np.int64)
        return size + special_bytes, tokens
