"""Progressive JPEG in numpy: a writer and a reader of spectral-selection and successive-approximation scans.

Both work on many files at a time. A scan's restart intervals are lanes: all lanes of all files that
share a scan's parameters and tables are coded in lockstep, so the loops run over coefficients, not over
blocks or files. The reader adds each scan to coefficient arrays, in zigzag order, and a transform with
integer factors (exact in float64, so a block's samples never depend on what it is batched with) makes
samples of them; chroma is replicated to full resolution and turned into RGB.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

LANES = 16384


def zigzag() -> np.ndarray:
    """Places in a row-major block, in zigzag order."""
    order = sorted(((i + j, (i if (i + j) % 2 else j), i, j) for i in range(8) for j in range(8)))
    return np.array([i * 8 + j for _, _, i, j in order])


ZIGZAG = zigzag()


class Codes:
    """A Huffman table of (symbol, length), canonical, with a lookup by the next 16 bits."""

    def __init__(self, lengths: dict[int, int]) -> None:
        self.order = sorted(lengths, key=lambda s: (lengths[s], s))
        self.counts = [sum(n == k for n in lengths.values()) for k in range(1, 17)]
        self.fill(self.order, [lengths[s] for s in self.order])

    def fill(self, symbols: list[int], lengths: list[int]) -> None:
        self.code, self.length = np.zeros(256, np.int64), np.zeros(256, np.int64)
        self.look = np.zeros(1 << 16, np.int32)
        code, at = 0, 0
        for s, n in zip(symbols, lengths, strict=True):
            code <<= n - at
            at = n
            self.code[s], self.length[s] = code, n
            self.look[code << (16 - n) : (code + 1) << (16 - n)] = n << 8 | s
            code += 1

    @classmethod
    def of(cls, counts: bytes, symbols: bytes) -> Codes:
        return cls({s: n for s, n in zip(symbols, (n + 1 for n, c in enumerate(counts) for _ in range(c)), strict=True)})

    def segment(self, kind: int, number: int) -> bytes:
        body = bytes([kind << 4 | number, *self.counts, *self.order])
        return b"\xff\xc4" + struct.pack(">H", len(body) + 2) + body


@lru_cache(maxsize=64)
def read_codes(body: bytes) -> Codes:
    return Codes.of(body[:16], body[16:])


# Tables of the writer, by rule: short codes for what UTF-8 text as coefficients is made of.
DC = Codes({s: 4 for s in range(12)})
AC_FIRST = Codes({r << 4 | s: 10 for r in range(16) for s in range(1, 11)} | {r << 4: 10 for r in range(16)} | {0x06: 1, 0x05: 3, 0x07: 4, 0x00: 4})
AC_REFINE = Codes({r << 4 | s: 6 for r in range(16) for s in (0, 1)} | {0x00: 1})


@lru_cache(maxsize=4096)
def layout(width: int, height: int, sampling: tuple[tuple[int, int], ...]) -> tuple[list[tuple[int, int, int, int, int]], int, np.ndarray]:
    """Of each component (first block, stored blocks across and down, own blocks across and down); number of blocks; blocks of each MCU."""
    hmax, vmax = max(h for h, _ in sampling), max(v for _, v in sampling)
    mx, my = -(-width // (8 * hmax)), -(-height // (8 * vmax))
    parts, first, cols = [], 0, []
    for h, v in sampling:
        across, down = mx * h, my * v
        parts.append((first, across, down, -(-(-(-width * h // hmax)) // 8), -(-(-(-height * v // vmax)) // 8)))
        grid = first + np.arange(across * down).reshape(my, v, mx, h)
        cols.append(grid.transpose(0, 2, 1, 3).reshape(mx * my, v * h))
        first += across * down
    return parts, first, np.concatenate(cols, axis=1)


@lru_cache(maxsize=8192)
def units_of(width: int, height: int, sampling: tuple[tuple[int, int], ...], comps: tuple[int, ...]) -> tuple[np.ndarray, list[int]]:
    """Block numbers of the units of a scan, and the component of each column."""
    parts, _, mcus = layout(width, height, sampling)
    if len(comps) == 1:
        first, across, _, own_x, own_y = parts[comps[0]]
        return (first + np.arange(own_y)[:, None] * across + np.arange(own_x)).reshape(-1, 1), [comps[0]]
    owner = [c for c, (h, v) in enumerate(sampling) for _ in range(h * v)]
    keep = [i for i, c in enumerate(owner) if c in comps]
    return mcus[:, keep], [owner[i] for i in keep]


# ---------------------------------------------------------------- writing

_SIZES = np.array([n.bit_length() for n in range(1 << 12)])  # coefficients and differences have 11 bits at most


def size_of(v: np.ndarray) -> np.ndarray:
    """Number of bits of |v|."""
    return _SIZES[np.abs(v)]


def pack(lane: np.ndarray, value: np.ndarray, bits: np.ndarray, lanes: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens, in order by lane, to bytes: (bytes, number of bytes of each lane); lanes end on ones."""
    total = np.bincount(lane, weights=bits, minlength=lanes).astype(np.int64)
    size = -(-total // 8)
    begin = (np.cumsum(size) - size) * 8
    run = np.cumsum(bits) - bits
    at = begin[lane] + run - (np.cumsum(total) - total)[lane]
    pad = size * 8 - total
    lane_at = begin + total
    at, value, bits = np.r_[at, lane_at], np.r_[value, (1 << pad) - 1], np.r_[bits, pad]
    word, shift = at >> 5, 64 - (at & 31) - bits
    wide = value << shift  # below 2^64 for tokens of up to 32 bits
    wide = wide.astype(np.uint64)
    n = int(size.sum())
    words = -(-n // 4) + 2
    out = np.bincount(word, weights=(wide >> np.uint64(32)).astype(float), minlength=words)[:words]
    out += np.bincount(word + 1, weights=(wide & np.uint64(0xFFFFFFFF)).astype(float), minlength=words)[:words]
    return out.astype(np.uint32).astype(">u4").view(np.uint8)[:n], size


def stuffed(data: np.ndarray, size: np.ndarray, owner: np.ndarray, files: int) -> list[bytes]:
    """Entropy-coded data of each file: zeros after FF, restart markers between its lanes."""
    lane = np.repeat(np.arange(len(size)), size)
    ff = data == 0xFF
    first = np.r_[True, owner[1:] != owner[:-1]]
    order = np.arange(len(owner)) - np.flatnonzero(first)[np.cumsum(first) - 1]
    marks = np.cumsum(~first)  # restart markers up to a lane
    at = np.arange(len(data)) + np.cumsum(ff) - ff + 2 * marks[lane]
    out = np.zeros(len(data) + int(ff.sum()) + 2 * int((~first).sum()), np.uint8)
    out[at] = data
    ends = np.cumsum(size)
    more = np.flatnonzero(~first)
    start = (ends - size)[more]  # place of a lane's first byte, its marker just before it
    stuff = np.r_[0, np.cumsum(ff)]
    mark = start + stuff[start] + 2 * marks[more] - 2
    out[mark], out[mark + 1] = 0xFF, 0xD0 + (order[more] - 1) % 8
    count = np.bincount(owner, weights=size, minlength=files).astype(np.int64)
    byte_end = np.cumsum(count)
    length = count + np.bincount(owner, weights=np.add.reduceat(ff, ends - size) if len(size) else [], minlength=files).astype(np.int64) + 2 * np.bincount(owner[~first], minlength=files)
    cut = np.cumsum(length)
    del byte_end
    raw = out.tobytes()
    return [raw[e - n : e] for e, n in zip(cut.tolist(), length.tolist(), strict=True)]


def dc_first(coef: np.ndarray, units: np.ndarray, cols: list[int], al: int) -> tuple[np.ndarray, np.ndarray]:
    v = coef[units, 0] >> al
    d = v.copy()
    last: dict[int, int] = {}
    for j, c in enumerate(cols):
        if c in last:
            d[:, j] = v[:, j] - v[:, last[c]]
        last[c] = j
    d = d.astype(np.int64).reshape(-1)
    s = size_of(d)
    return pack(np.repeat(np.arange(len(units)), len(cols)), DC.code[s] << s | np.where(d < 0, d + (1 << s) - 1, d), DC.length[s] + s, len(units))


def dc_refine(coef: np.ndarray, units: np.ndarray, al: int) -> tuple[np.ndarray, np.ndarray]:
    v = (coef[units, 0] >> al & 1).astype(np.int64).reshape(-1)
    return pack(np.repeat(np.arange(len(units)), units.shape[1]), v, np.ones(len(v), np.int64), len(units))


def ac_first(coef: np.ndarray, blocks: np.ndarray, ss: int, se: int, al: int) -> tuple[np.ndarray, np.ndarray]:
    c = coef[blocks, ss : se + 1]
    signed = len(c) > 0 and c.min() < 0
    v = np.sign(c) * (np.abs(c) >> al) if signed else c >> al
    flat = np.flatnonzero(v)
    lane, k = np.divmod(flat, se - ss + 1)
    d = v.reshape(-1)[flat].astype(np.int64)
    s = size_of(d)
    run = np.diff(flat, prepend=-1) - 1  # zeros before, if in the same block
    run = np.minimum(run, k)
    sym = (run & 15) << 4 | s
    if signed:
        d = np.where(d < 0, d + (1 << s) - 1, d)
    value, bits = AC_FIRST.code[sym] << s | d, AC_FIRST.length[sym] + s
    last = np.full(len(blocks), -1)
    last[lane] = k
    open_ = np.flatnonzero(last < se - ss)
    long = np.flatnonzero(run > 15)
    extra = np.repeat(long, run[long] >> 4)
    lanes = np.concatenate([lane[extra], lane, open_])
    place = np.concatenate([k[extra] * 2, k * 2 + 1, np.full(len(open_), 200)])
    value = np.concatenate([np.full(len(extra), AC_FIRST.code[0xF0]), value, np.full(len(open_), AC_FIRST.code[0])])
    bits = np.concatenate([np.full(len(extra), AC_FIRST.length[0xF0]), bits, np.full(len(open_), AC_FIRST.length[0])])
    if len(extra) or len(open_):
        order = np.argsort(lanes * 256 + place, kind="stable")
        lanes, value, bits = lanes[order], value[order], bits[order]
    return pack(lanes, value, bits, len(blocks))


def ac_refine(coef: np.ndarray, blocks: np.ndarray, ss: int, se: int, al: int) -> tuple[np.ndarray, np.ndarray]:
    """Refinement of one bit. Blocks without a coefficient that becomes non-zero now are a code for that and their bits; others are coded one by one."""
    mag = np.abs(coef[blocks, ss : se + 1]).astype(np.int32)
    rows = np.ascontiguousarray((mag >> al).T)
    acc, n = np.zeros(len(blocks), np.uint64), np.ones(len(blocks), np.int64)
    for r in rows:
        has = r > 1
        acc = np.where(has, acc << np.uint64(1) | (r & 1).astype(np.uint64), acc)
        n += has
    fresh = np.flatnonzero((rows == 1).any(axis=0))
    hi = n > 32
    low = np.where(hi, n - 32, 0)
    lane = np.repeat(np.arange(len(blocks)), 1 + hi)
    top, bits = (acc >> low.astype(np.uint64)).astype(np.int64), n - low
    # two tokens, where a block has over 32 bits
    at = np.cumsum(1 + hi) - (1 + hi)
    value, width = np.zeros(len(lane), np.int64), np.zeros(len(lane), np.int64)
    value[at], width[at] = np.where(hi, (acc >> np.uint64(32)).astype(np.int64), top), np.where(hi, n - 32, n)
    value[at[hi] + 1], width[at[hi] + 1] = (acc[hi] & np.uint64(0xFFFFFFFF)).astype(np.int64), 32
    if len(fresh):
        keep = np.ones(len(blocks), bool)
        keep[fresh] = False
        tokens = [(int(b), *t) for b in fresh for t in refine_block(coef[blocks[b], ss : se + 1].tolist(), al)]
        lane, value, width = np.r_[lane[keep[lane]], [t[0] for t in tokens]], np.r_[value[keep[lane]], [t[1] for t in tokens]], np.r_[width[keep[lane]], [t[2] for t in tokens]]
        order = np.argsort(lane, kind="stable")
        lane, value, width = lane[order], value[order], width[order]
    return pack(lane, value, width, len(blocks))


def refine_block(c: list[int], al: int) -> list[tuple[int, int]]:
    """(value, bits) of one block's refinement: a run's code and sign come before the correction bits it passes."""
    out: list[tuple[int, int]] = []
    fresh = [k for k, x in enumerate(c) if abs(x) >> al == 1]
    code = lambda s: out.append((int(AC_REFINE.code[s]), int(AC_REFINE.length[s])))
    run, held = 0, []
    for k, x in enumerate(c):
        m = abs(x) >> al
        if not m:
            run += 1
            continue
        while run > 15 and k <= fresh[-1]:
            code(0xF0)
            out += held
            run, held = run - 16, []
        if m > 1:
            held.append((m & 1, 1))
        else:
            code(run << 4 | 1)
            out += [(int(x > 0), 1), *held]
            run, held = 0, []
    if run or held:
        code(0)
        out += held
    return out


@dataclass
class Script:
    """The scans of the writer: (components, first and last coefficient, high and low bit)."""

    scans: tuple = (((0, 1, 2), 0, 0, 0, 1), ((0,), 1, 20, 0, 1), ((0,), 21, 63, 0, 1), ((1,), 1, 63, 0, 1), ((2,), 1, 63, 0, 1), ((0,), 1, 63, 1, 0), ((1,), 1, 63, 1, 0), ((2,), 1, 63, 1, 0), ((0, 1, 2), 0, 0, 1, 0))
    sampling: tuple = ((2, 2), (1, 1), (1, 1))


def write(coef: np.ndarray, shapes: list[tuple[int, int]], notes: list[bytes], script: Script = Script()) -> list[bytes]:  # noqa: B008
    """Files of images whose coefficients follow one another in ``coef`` (blocks x 64, zigzag), width and height in ``shapes``."""
    base = np.cumsum([0, *(layout(w, h, script.sampling)[1] for w, h in shapes)])
    parts: list[list[bytes]] = [[_head(w, h, script.sampling, note)] for (w, h), note in zip(shapes, notes, strict=True)]
    for comps, ss, se, ah, al in script.scans:
        got = [units_of(w, h, script.sampling, comps) for w, h in shapes]
        units = np.concatenate([u + b for (u, _), b in zip(got, base[:-1], strict=True)])
        owner = np.repeat(np.arange(len(shapes)), [len(u) for u, _ in got])
        if ss == 0:
            data, size = dc_refine(coef, units, al) if ah else dc_first(coef, units, got[0][1], al)
        else:
            data, size = (ac_refine if ah else ac_first)(coef, units[:, 0], ss, se, al)
        head = b"\xff\xda" + struct.pack(">HB", 6 + 2 * len(comps), len(comps)) + b"".join(bytes([c + 1, 0x01 if ah and ss else 0x00]) for c in comps) + bytes([ss, se, ah << 4 | al])
        for p, x in zip(parts, stuffed(data, size, owner, len(shapes)), strict=True):
            p += [head, x]
    return [b"".join([*p, b"\xff\xd9"]) for p in parts]


def _head(w: int, h: int, sampling: tuple, note: bytes) -> bytes:
    seg = lambda m, body: bytes([0xFF, m]) + struct.pack(">H", len(body) + 2) + body
    frame = struct.pack(">BHHB", 8, h, w, len(sampling)) + b"".join(bytes([c + 1, x << 4 | y, 0]) for c, (x, y) in enumerate(sampling))
    return b"\xff\xd8" + seg(0xFE, note) + seg(0xDB, bytes([0] + [1] * 64)) + seg(0xC2, frame) + DC.segment(0, 0) + AC_FIRST.segment(1, 0) + AC_REFINE.segment(1, 1) + seg(0xDD, b"\x00\x01")


# ---------------------------------------------------------------- reading


@dataclass
class Image:
    width: int = 0
    height: int = 0
    sampling: tuple = ()
    quant: tuple = ()
    note: bytes = b""
    scans: list = field(default_factory=list)
    base: int = 0


class Bits:
    """Bits of all lanes of a batch of files, without stuffing and markers."""

    def __init__(self, data: np.ndarray) -> None:
        d = np.r_[data, np.full(8, 0xFF, np.uint8)].astype(np.uint32)
        self.word = (d[:-3] << 24 | d[1:-2] << 16 | d[2:-1] << 8 | d[3:]).astype(np.int64)

    def peek(self, at: np.ndarray, n: int) -> np.ndarray:
        """The next n bits, 25 at most."""
        return (self.word[at >> 3] << (at & 7) & 0xFFFFFFFF) >> (32 - n)

    def take(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        return (self.word[at >> 3] << (at & 7) & 0xFFFFFFFF) >> (32 - n)


def _extend(v: np.ndarray, s: np.ndarray) -> np.ndarray:
    return np.where(v < (1 << s) >> 1, v - (1 << s) + 1, v)


def read_dc(bits: Bits, coef: np.ndarray, units: np.ndarray, cols: list[int], codes: dict[int, Codes], at: np.ndarray, ah: int, al: int) -> None:
    """units: lanes x units x blocks, -1 beyond a file's end."""
    pred = {c: np.zeros(len(at), np.int64) for c in cols}
    for u in range(units.shape[1]):
        for j, c in enumerate(cols):
            block = units[:, u, j]
            on = block >= 0
            if ah:
                coef[block[on], 0] |= (bits.peek(at, 1) << al)[on].astype(np.int32)
                at = at + on
                continue
            e = codes[c].look[bits.peek(at, 16)]
            n, s = e >> 8, (e & 255).astype(np.int64)
            pred[c] = pred[c] + _extend(bits.take(at + n, s), s)
            coef[block[on], 0] = (pred[c] << al)[on]
            at = np.where(on, at + n + s, at)


def read_ac_first(bits: Bits, flat: np.ndarray, units: np.ndarray, codes: Codes, at: np.ndarray, ss: int, se: int, al: int) -> None:
    lane, u, k, run = np.arange(len(at)), np.zeros(len(at), np.int64), np.full(len(at), ss), np.zeros(len(at), np.int64)
    block = units[lane, u]
    live = np.flatnonzero(block >= 0)
    lane, u, k, run, at, block = (x[live] for x in (lane, u, k, run, at, block))
    while len(lane):
        e = codes.look[bits.peek(at, 16)]
        n, s = e >> 8, (e & 15).astype(np.int64)
        r = e >> 4 & 15
        zero = s == 0
        value = bits.take(at + n, s)
        at = at + n + s
        k = k + r
        plain = not zero.any()
        put = slice(None) if plain else ~zero
        flat[block[put] * 64 + k[put]] = _extend(value, s)[put] << al
        k = k + 1
        if not plain:
            z = np.flatnonzero(zero & (r < 15))
            run[z] = (1 << r[z]) - 1 + bits.take(at[z], r[z].astype(np.int64))
            at[z] += r[z]
            k[z] = se + 1
        over = np.flatnonzero(k > se)
        if len(over):
            u[over] += 1 + run[over]
            run[over] = 0
            k[over] = ss
            inside = u[over] < units.shape[1]
            block[over] = np.where(inside, units[lane[over], np.minimum(u[over], units.shape[1] - 1)], -1)
            keep = block >= 0
            lane, u, k, run, at, block = (x[keep] for x in (lane, u, k, run, at, block))


def read_ac_refine(bits: Bits, coef: np.ndarray, units: np.ndarray, codes: Codes, at: np.ndarray, ss: int, se: int, al: int) -> None:
    """All lanes stand at the same coefficient; what differs is how far their runs reach."""
    one = 1 << al
    ends = np.zeros(len(at), np.int64)  # blocks left of an end-of-band run
    for j in range(units.shape[1]):
        block = units[:, j]
        on = block >= 0
        c = np.ascontiguousarray(coef[np.maximum(block, 0), ss : se + 1].T)
        left, new, busy = np.zeros(len(at), np.int64), np.zeros(len(at), np.int32), np.zeros(len(at), bool)
        for row in c:
            need = np.flatnonzero(on & ~busy & (ends == 0))
            if len(need):
                a = at[need]
                e = codes.look[bits.peek(a, 16)]
                a = a + (e >> 8)
                r, s = e >> 4 & 15, e & 15
                band = (s == 0) & (r < 15)
                b = bits.take(a, np.where(band, r, s).astype(np.int64))
                at[need] = a + np.where(band, r, s)
                ends[need] = np.where(band, (1 << r) + b, 0)
                left[need], busy[need] = r, ~band
                new[need] = np.where(s == 0, 0, np.where(b == 1, one, -one))
            has = (row != 0) & on
            bit = bits.peek(at, 1)
            at += has
            row += np.where(has & (bit == 1), np.sign(row) * one, 0).astype(row.dtype)
            if busy.any():
                zero = busy & ~has
                here = zero & (left == 0)
                row[here] = new[here]
                busy &= ~here
                left -= zero & ~here
        ends = np.maximum(ends - on, 0)
        coef[block[on], ss : se + 1] = c.T[on]


def parse(data: bytes, at: int, marks: np.ndarray, codes: dict) -> Image:
    """Segments of the file from ``at`` on; of scans, where their data begin and end."""
    im, restart, comps, tables = Image(), 0, [], {}
    at += 2
    while data[at + 1] != 0xD9:
        m, n = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + n]
        at += 2 + n
        if m == 0xFE:
            im.note = body
        elif m == 0xDB:
            while body:
                wide = body[0] >> 4
                tables[body[0] & 15] = tuple(np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).tolist())
                body = body[65 + 64 * wide :]
        elif m == 0xC2:
            _, im.height, im.width, k = struct.unpack(">BHHB", body[:6])
            comps = [(body[6 + 3 * i], divmod(body[7 + 3 * i], 16), body[8 + 3 * i]) for i in range(k)]
            im.sampling = tuple(s for _, s, _ in comps)
        elif m == 0xC4:
            while body:
                k = 17 + sum(body[1:17])
                codes = codes | {(body[0] >> 4, body[0] & 15): body[1:k]}
                body = body[k:]
        elif m == 0xDD:
            restart = int.from_bytes(body, "big")
        elif m == 0xDA:
            k = body[0]
            ids = [c[0] for c in comps]
            picked = tuple(ids.index(body[1 + 2 * i]) for i in range(k))
            ss, se, a = body[1 + 2 * k : 4 + 2 * k]
            used = tuple(codes.get((1, body[2] & 15)) if ss else codes.get((0, body[2 + 2 * i] >> 4)) for i in range(k)) if ss or not a >> 4 else ()
            end = int(marks[np.searchsorted(marks, at)])
            im.scans.append(((picked, ss, se, a >> 4, a & 15, restart, used), at, end))
            at = end
        elif m in (0xC0, 0xC1, 0xC3, 0xC9, 0xCA):
            raise ValueError("not a progressive Huffman-coded JPEG")
    im.quant = tuple(tables.get(q, (1,) * 64) for _, _, q in comps)
    return im


def read(files: list[bytes]) -> tuple[np.ndarray, list[Image]]:
    """Coefficients (blocks x 64, zigzag, not yet scaled) of files one after the other, and their headers."""
    data = b"".join(files)
    raw = np.frombuffer(data, np.uint8)
    ff = np.flatnonzero(raw[:-1] == 0xFF)
    follow = raw[ff + 1]
    marks = ff[(follow != 0) & ((follow < 0xD0) | (follow > 0xD7)) & (follow != 0xFF)]
    rst = ff[(follow >= 0xD0) & (follow <= 0xD7)]
    keep = np.ones(len(raw), bool)
    keep[ff[follow == 0] + 1] = False
    keep[rst] = keep[rst + 1] = False
    before = np.cumsum(keep) - keep
    bits = Bits(raw[keep])
    images, at, base = [], 0, 0
    for f in files:
        im = parse(data, at, marks, {})
        im.base, base, at = base, base + layout(im.width, im.height, im.sampling)[1], at + len(f)
        images.append(im)
    places = np.sort(np.concatenate([rst, np.array([start for im in images for _, start, _ in im.scans], np.int64)]))
    begins = before[places].astype(np.int64) * 8  # first bit of every lane
    coef = np.zeros((base, 64), np.int32)
    for i in range(max((len(im.scans) for im in images), default=0)):
        groups: dict[tuple, list[tuple[Image, int, int]]] = {}
        for im in images:
            if i < len(im.scans):
                key, start, end = im.scans[i]
                groups.setdefault(key, []).append((im, start, end))
        for (comps, ss, se, ah, al, restart, used), members in groups.items():
            lanes, starts = [], []
            for im, start, _ in members:
                units, cols = units_of(im.width, im.height, im.sampling, comps)
                step = restart or len(units)
                n = -(-len(units) // step)
                if n * step > len(units):
                    units = np.concatenate([units + im.base, np.full((n * step - len(units), units.shape[1]), -1)])
                else:
                    units = units + im.base
                lanes.append(units.reshape(n, step, -1))
                lo = int(np.searchsorted(places, start))
                starts.append(begins[lo : lo + n])
            if len({x.shape[1] for x in lanes}) > 1:  # files without restarts, of several sizes
                most = max(x.shape[1] for x in lanes)
                lanes = [np.concatenate([x, np.full((len(x), most - x.shape[1], x.shape[2]), -1)], axis=1) for x in lanes]
            units, first = np.concatenate(lanes), np.concatenate(starts)
            for lo in range(0, len(units), LANES):
                part, pos = units[lo : lo + LANES], first[lo : lo + LANES].copy()
                if ss == 0:
                    tables = {c: read_codes(t) for c, t in zip(comps, used, strict=True)} if used else {}
                    read_dc(bits, coef, part, cols, tables, pos, ah, al)
                elif ah:
                    read_ac_refine(bits, coef, part[:, :, 0], read_codes(used[0]), pos, ss, se, al)
                else:
                    read_ac_first(bits, coef.reshape(-1), part[:, :, 0], read_codes(used[0]), pos, ss, se, al)
    return coef, images


def _transform() -> np.ndarray:
    """64 x 64 factors from zigzag coefficients to samples, times 2^20, rounded to integers."""
    u = np.arange(8)
    a = np.cos((2 * u[:, None] + 1) * u[None, :] * np.pi / 16) * np.where(u == 0, np.sqrt(0.125), 0.5)  # sample x frequency
    return np.round(np.kron(a, a)[:, ZIGZAG].T * (1 << 20))


TRANSFORM = _transform()


def samples(coef: np.ndarray, quant: np.ndarray | None = None) -> np.ndarray:
    """Blocks of 8 x 8 samples, 0 to 255. Products and sums are integers below 2^53, so the result is exact."""
    c = coef.astype(np.float64) if quant is None else coef * np.asarray(quant, np.float64)
    x = np.floor(c @ TRANSFORM * (1.0 / (1 << 20)) + 128.5)
    return np.clip(x, 0, 255).astype(np.uint8)


def rgb(blocks: np.ndarray, im: Image) -> np.ndarray:
    """height x width x 3 of an image's sample blocks; chroma is replicated to full resolution."""
    parts, _, _ = layout(im.width, im.height, im.sampling)
    hmax, vmax = max(h for h, _ in im.sampling), max(v for _, v in im.sampling)
    planes = []
    for (first, across, down, _, _), (h, v) in zip(parts, im.sampling, strict=True):
        p = blocks[first : first + across * down].reshape(down, across, 8, 8).transpose(0, 2, 1, 3).reshape(down * 8, across * 8)
        p = p.repeat(vmax // v, axis=0) if v < vmax else p
        planes.append((p.repeat(hmax // h, axis=1) if h < hmax else p)[: im.height, : im.width])
    if len(planes) == 1:
        return np.repeat(planes[0][:, :, None], 3, axis=2)
    y, cb, cr = planes[0].astype(np.int32) << 16, planes[1].astype(np.int32) - 128, planes[2].astype(np.int32) - 128
    out = np.empty((im.height, im.width, 3), np.uint8)
    # factors of the usual colour conversion, times 2^16
    for i, x in enumerate((y + 91881 * cr, y - 22554 * cb - 46802 * cr, y + 116130 * cb)):
        out[:, :, i] = np.clip((x + 32768) >> 16, 0, 255)
    return out
