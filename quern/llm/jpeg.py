"""Baseline JPEG in numpy: a lossless carrier for bytes, and a marker and Huffman decoder.

The writer stores a byte stream in the quantised coefficients of a grey baseline image: block b holds
bytes 64 b .. 64 b + 63 in zigzag order, each less 128. Coefficients, unlike samples, survive exactly.
The DC quantiser is 8 and the others are 1, so a block's mean luminance equals its first byte and the
DC-only thumbnail is exact too. Every RESTART blocks a restart marker makes the scan independent, which
lets the decoder run all intervals of a batch of files in lock step, one Huffman symbol each per step.

The reader parses SOI, DQT, SOF0, DHT, DRI, COM, SOS and EOI of any one-component baseline file
and takes the Huffman tables from the file.
"""

from __future__ import annotations

import functools
import struct

import numpy as np

BLOCK = 64
RESTART = 3  # blocks in a restart interval
INTERVAL = BLOCK * RESTART
#: Long streams are coded in pieces of so many bytes, a multiple of eight intervals, so that restart numbers begin at 0 again.
PIECE = INTERVAL * 8 * 512
#: Decoding and encoding hold about this many bytes at once.
BATCH = 1 << 21
MOST_SIDE = 65528


def canonical(lengths: list[tuple[int, int]]) -> tuple[bytes, bytes, np.ndarray, np.ndarray]:
    """(counts, symbols, code by symbol, length by symbol) of a canonical Huffman table from (symbol, length) pairs."""
    code, size = np.zeros(256, np.uint64), np.zeros(256, np.int64)
    counts, order, nxt, last = [0] * 16, [], 0, 0
    for symbol, n in sorted(lengths, key=lambda x: x[1]):
        nxt <<= n - last
        last = n
        code[symbol], size[symbol] = nxt, n
        counts[n - 1] += 1
        order.append(symbol)
        nxt += 1
    return bytes(counts), bytes(order), code, size


# DC differences of bytes take size classes 0..8. Text bytes less 128 mostly take classes 3..6 with no zero run.
DC = canonical([(s, 4) for s in range(9)])
AC = canonical([(s, 3) for s in (2, 3, 4, 5, 6, 7)] + [(1, 4), (8, 4), (0x00, 8), (0xF0, 8)] + [(r << 4 | s, 11) for r in range(1, 16) for s in range(1, 9)])

_v = np.abs(np.arange(-256, 257))
CLASS = np.where(_v == 0, 0, np.floor(np.log2(np.maximum(_v, 1))).astype(np.int64) + 1)  # by value + 256


def encode_pieces(pieces: list[bytes]) -> list[bytes]:
    """Entropy-coded data of each piece, a positive multiple of INTERVAL bytes, with restart markers inside."""
    data = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64) - 128
    n = len(data)
    pos = np.arange(n) % BLOCK
    is_dc = pos == 0
    dc = data[::BLOCK].copy()
    diff = dc.copy()
    diff[1:] -= dc[:-1]
    diff[::RESTART] = dc[::RESTART]
    data[::BLOCK] = diff
    at = np.flatnonzero(is_dc | (data != 0))
    v, dcs = data[at], is_dc[at]
    gap = np.zeros(len(at), np.int64)
    gap[1:] = at[1:] - at[:-1] - 1
    gap[dcs] = 0
    cls = CLASS[v + 256]
    symbol = np.where(dcs, cls, (gap & 15) << 4 | cls)
    length = np.where(dcs, DC[3][symbol], AC[3][symbol])
    code = np.where(dcs, DC[2][symbol], AC[2][symbol])
    extra = np.where(v < 0, v + (1 << cls) - 1, v).astype(np.uint64)
    code = code << cls.astype(np.uint64) | extra
    length = length + cls
    zrl = gap >> 4
    for k in np.flatnonzero(zrl):  # rare: over 15 zero bytes in a row within a block
        for _ in range(int(zrl[k])):
            code[k] |= AC[2][0xF0] << np.uint64(length[k])
            length[k] += 8
    tail = np.ones(len(at), bool)
    tail[:-1] = dcs[1:]
    short = tail & (at % BLOCK != BLOCK - 1)
    code = np.where(short, code << np.uint64(8) | AC[2][0x00], code)
    length = np.where(short, length + 8, length)

    interval = at // INTERVAL
    first = np.searchsorted(interval, np.arange(n // INTERVAL))
    bits = np.add.reduceat(length, first)
    size = (bits + 7) // 8
    base = np.concatenate(([0], np.cumsum(size)))
    before = np.cumsum(length) - length
    offset = base[:-1][interval] * 8 + before - before[first][interval]
    byte, shift = offset >> 3, offset & 7
    word = code << (64 - shift - length).astype(np.uint64)
    total = int(base[-1])
    out = np.zeros(total + 8, np.float64)
    need = shift + length
    for k in range(8):
        sel = slice(None) if k < 1 else np.flatnonzero(need > 8 * k)
        if k and not len(sel):
            break
        out += np.bincount(byte[sel] + k, ((word[sel] >> np.uint64(56 - 8 * k)) & np.uint64(255)).astype(np.float64), total + 8)
    out = out[:total].astype(np.uint8)
    pad = size * 8 - bits
    out[base[1:] - 1] |= ((1 << pad) - 1).astype(np.uint8)

    lens = np.array([len(p) for p in pieces]) // INTERVAL
    last = np.zeros(len(size), bool)
    last[np.cumsum(lens) - 1] = True
    start = np.repeat(np.cumsum(lens) - lens, lens)
    number = (np.arange(len(size)) - start) & 7
    ff = out == 255
    grow = np.ones(total, np.int64) + ff
    grow[base[1:] - 1] += np.where(last, 0, 2)
    place = np.cumsum(grow) - grow
    full = np.zeros(int(grow.sum()), np.uint8)
    full[place] = out
    ends = base[1:] - 1
    mark = place[ends] + 1 + ff[ends]
    mark, number = mark[~last], number[~last]
    full[mark] = 255
    full[mark + 1] = 0xD0 + number
    piece_end = (place + grow)[ends[last]]
    piece_start = np.concatenate(([0], piece_end[:-1]))
    blob = full.tobytes()
    return [blob[a:b] for a, b in zip(piece_start, piece_end)]


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def shape(n: int) -> tuple[int, int]:
    """Width and height in pixels for n payload bytes, a multiple of 9 blocks: 24 wide while the height allows it."""
    blocks = n // BLOCK
    side = MOST_SIDE // 8
    across = RESTART * -(-blocks // (RESTART * side))
    return across * 8, -(-blocks // across) * 8


def header(n: int) -> bytes:
    """All up to the scan data of an image that holds n payload bytes; a comment keeps n."""
    width, height = shape(n)
    quantiser = bytes([8] + [1] * 63)
    return b"".join((
        b"\xff\xd8",
        _segment(0xFE, b"payload=%d" % n),
        _segment(0xDB, b"\0" + quantiser),
        _segment(0xC0, struct.pack(">BHHB", 8, height, width, 1) + bytes((1, 0x11, 0))),
        _segment(0xC4, b"\0" + DC[0] + DC[1] + b"\x10" + AC[0] + AC[1]),
        _segment(0xDD, struct.pack(">H", RESTART)),
        _segment(0xDA, bytes((1, 1, 0, 0, 63, 0))),
    ))


def write(payloads: list[bytes]) -> list[bytes]:
    """A JPEG file for each payload; lengths are positive multiples of 576."""
    pieces, owner = [], []
    for k, p in enumerate(payloads):
        width, height = shape(len(p))
        p = p + b"\x80" * (width * height - len(p))
        cut = [p[i : i + PIECE] for i in range(0, len(p), PIECE)]
        pieces += cut
        owner += [k] * len(cut)
    coded: list[bytes] = []
    for a, b in _runs([len(p) for p in pieces]):
        coded += encode_pieces(pieces[a:b])
    scans: list[list[bytes]] = [[] for _ in payloads]
    for k, c in zip(owner, coded):
        scans[k].append(c)
    return [header(len(p)) + b"\xff\xd7".join(s) + b"\xff\xd9" for p, s in zip(payloads, scans)]


def _runs(sizes: list[int], most: int = BATCH):
    """Ranges of neighbours that hold about `most` together."""
    a = total = 0
    for b, n in enumerate(sizes):
        if b > a and total + n > most:
            yield a, b
            a, total = b, 0
        total += n
    if a < len(sizes):
        yield a, len(sizes)


def markers(blob: bytes) -> dict:
    """The parsed header of a one-component baseline file, and where its scan data lie."""
    if blob[:2] != b"\xff\xd8":
        raise ValueError("no SOI")
    out, at, tables = {"restart": 0, "comment": b""}, 2, []
    while True:
        if blob[at] != 0xFF:
            raise ValueError("no marker")
        kind, n = blob[at + 1], struct.unpack_from(">H", blob, at + 2)[0]
        body = blob[at + 4 : at + 2 + n]
        at += 2 + n
        if kind == 0xDB:
            out["quantiser"] = body[1:65]
        elif kind == 0xC0:
            bits, out["height"], out["width"], parts = struct.unpack_from(">BHHB", body)
            if bits != 8 or parts != 1:
                raise ValueError("only one component of 8 bits")
        elif 0xC1 <= kind <= 0xCF and kind != 0xC4:
            raise ValueError("not baseline")
        elif kind == 0xC4:
            tables.append(body)
        elif kind == 0xDD:
            out["restart"] = struct.unpack(">H", body)[0]
        elif kind == 0xFE:
            out["comment"] = body
        elif kind == 0xDA:
            break
    out |= {"tables": b"".join(tables), "start": at, "end": len(blob) - 2}
    if blob[-2:] != b"\xff\xd9":
        raise ValueError("no EOI")
    return out


@functools.lru_cache(maxsize=64)
def lookahead(tables: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(length, symbol) by the next 16 bits, DC table first, then AC."""
    length, symbol = np.zeros(2 << 16, np.int64), np.zeros(2 << 16, np.int64)
    at = 0
    while at < len(tables):
        kind = tables[at] >> 4
        counts = tables[at + 1 : at + 17]
        at += 17
        code = 0
        for n, count in enumerate(counts, 1):
            for _ in range(count):
                lo = (kind << 16) + (code << (16 - n))
                length[lo : lo + (1 << (16 - n))] = n
                symbol[lo : lo + (1 << (16 - n))] = tables[at]
                at += 1
                code += 1
            code <<= 1
    return length, symbol


def decode_pieces(pieces: list[bytes], blocks: list[int], restart: int, tables: bytes) -> list[np.ndarray]:
    """Quantised coefficients in zigzag order of each piece of scan data that starts an interval."""
    length_of, symbol_of = lookahead(tables)
    raw = np.frombuffer(b"".join(pieces), np.uint8)
    n = len(raw)
    starts = np.zeros(n + 1, bool)
    starts[np.cumsum([0] + [len(p) for p in pieces])[:-1]] = True
    ff = np.zeros(n, bool)
    ff[:-1] = raw[:-1] == 255
    where = np.flatnonzero(ff)
    nxt = raw[where + 1]
    keep = np.ones(n, bool)
    keep[where[nxt == 0] + 1] = False
    rst = where[(nxt >= 0xD0) & (nxt <= 0xD7)]
    keep[rst] = keep[rst + 1] = False
    starts[rst + 2] = True
    kept_before = np.cumsum(keep) - keep
    begin = kept_before[np.flatnonzero(starts[:n])]
    clean = np.concatenate((raw[keep], np.zeros(8, np.uint8))).astype(np.int64)
    word = clean[:-4] << 32 | clean[1:-3] << 24 | clean[2:-2] << 16 | clean[3:-1] << 8 | clean[4:]

    per = restart or max(blocks)
    want = np.concatenate([np.minimum(per, b - np.arange(0, b, per)) for b in blocks]) * BLOCK
    if len(want) != len(begin):
        raise ValueError("restart intervals do not fit the image")
    base = np.cumsum(want) - want
    out = np.zeros(int(want.sum()), np.int64)
    bit, k, pred = begin * 8, np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int64)
    live = np.arange(len(begin))
    while len(live):
        b, kk = bit[live], k[live]
        w, s = word[b >> 3], b & 7
        dc = (kk & 63) == 0
        look = (w >> (24 - s)) & 0xFFFF
        look[~dc] += 1 << 16
        length, symbol = length_of[look], symbol_of[look]
        if not length.all():
            raise ValueError("no such Huffman code")
        size = symbol & 15
        value = (w >> (40 - s - length - size)) & ((1 << size) - 1)
        value = np.where((size > 0) & (value < (1 << size >> 1)), value - (1 << size) + 1, value)
        bit[live] = b + length + size
        pred[live[dc]] += value[dc]
        value[dc] = pred[live[dc]]
        skip = ~dc & (size == 0)
        kk = kk + np.where(dc, 0, symbol >> 4)
        store = ~skip
        out[base[live[store]] + kk[store]] = value[store]
        kk = np.where(skip, np.where(symbol == 0xF0, kk + 1, (kk | 63) + 1), kk + 1)
        k[live] = kk
        live = live[kk < want[live]]
    cuts = np.cumsum(np.array(blocks) * BLOCK)[:-1]
    return np.split(out, cuts)


def read(blobs: list[bytes]) -> list[tuple[dict, np.ndarray]]:
    """(header, quantised coefficients in zigzag order by block) of each file."""
    heads = [markers(b) for b in blobs]
    found: list[list[np.ndarray]] = [[] for _ in blobs]
    groups: dict[tuple, list[tuple[int, bytes, int]]] = {}
    for i, (b, h) in enumerate(zip(blobs, heads)):
        scan, total = b[h["start"] : h["end"]], (h["width"] + 7) // 8 * ((h["height"] + 7) // 8)
        own = groups.setdefault((h["tables"], h["restart"]), [])
        if len(scan) <= BATCH or not h["restart"]:
            own.append((i, scan, total))
            continue
        # cut after restart marker 7, so that a piece is a whole number of intervals
        parts, done = scan.split(b"\xff\xd7"), 0
        for k, p in enumerate(parts):
            count = total - done if k == len(parts) - 1 else 8 * h["restart"]
            own.append((i, p, count))
            done += count
    for (tables, restart), own in groups.items():
        for a, b in _runs([len(p) for _, p, _ in own]):
            for (i, _, _), c in zip(own[a:b], decode_pieces([p for _, p, _ in own[a:b]], [n for _, _, n in own[a:b]], restart, tables)):
                found[i].append(c)
    return [(h, f[0] if len(f) == 1 else np.concatenate(f)) for h, f in zip(heads, found)]


def thumbnail(head: dict, coefficients: np.ndarray) -> np.ndarray:
    """DC-only luminance: one pixel a block."""
    dc = coefficients[::BLOCK] * head["quantiser"][0]
    grid = np.clip(np.rint(dc / 8 + 128), 0, 255).astype(np.uint8)
    return grid.reshape((head["height"] + 7) // 8, (head["width"] + 7) // 8)


def average_hash(grid: np.ndarray, side: int = 8) -> str:
    """64 bits: which of side x side nearest samples of the thumbnail lie above their mean."""
    rows = np.arange(side) * grid.shape[0] // side
    cols = np.arange(side) * grid.shape[1] // side
    small = grid[np.ix_(rows, cols)].astype(np.float64)
    return np.packbits(small > small.mean()).tobytes().hex()
