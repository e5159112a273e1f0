"""FLAC columns: payloads stored losslessly as FLAC, decoded again into PCM blocks with seekable sample offsets.

Encoding cuts samples into blocks; each takes the cheapest of a constant, verbatim samples, a fixed predictor of
order 0 to 2 and a quantised linear predictor of order 4, with Rice-coded residuals in partitions. All of it depends
on the payload alone, so equal payloads give equal bytes. The stream info holds the MD5 of the samples, the seek table
a point for every frame.

Decoding takes any FLAC stream of up to 8 channels and 24 bits a sample: it finds the frames by sync code, header
checksum (CRC-8), frame number and frame checksum (CRC-16), decodes Rice residuals of all frames of a batch side by
side, and runs the linear predictors forward, likewise side by side. A wrong checksum or MD5 is an error, which names
the stream; ``decode`` reports it in a column instead of failing the job. A null stream gives null blocks and no error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

# The format's polynomials, codes and predictors.
CRC8_POLY, CRC16_POLY = 0x07, 0x8005
FIXED = {0: (), 1: (1,), 2: (2, -1), 3: (3, -3, 1), 4: (4, -6, 4, -1)}
SAMPLE_BITS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24}
BLOCK_SIZES = {1: 192, 2: 576, 3: 1152, 4: 2304, 5: 4608, 8: 256, 9: 512, 10: 1024, 11: 2048, 12: 4096, 13: 8192, 14: 16384, 15: 32768}


def _crc_table(poly: int, bits: int, over: int) -> np.ndarray:
    """CRC register after ``over`` input bits, for each value of the register's top bits XOR input."""
    r = np.arange(1 << over, dtype=np.uint32) << (bits - over if bits > over else 0)
    top = np.uint32(1 << (bits - 1))
    for _ in range(over):
        r = np.where(r & top, (r << np.uint32(1)) ^ np.uint32(poly), r << np.uint32(1)) & np.uint32((1 << bits) - 1)
    return r


CRC8 = _crc_table(CRC8_POLY, 8, 8).tolist()
CRC16_WORD = _crc_table(CRC16_POLY, 16, 16).astype(np.uint16)  # two bytes at a time
CRC16_BYTE = _crc_table(CRC16_POLY, 16, 8).astype(np.uint16)


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = CRC8[c ^ b]
    return c


def crc16_of(buf: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-16 of many runs of a byte buffer, side by side."""
    out = np.zeros(len(start), np.uint16)
    order = np.argsort(-length, kind="stable")
    s, n = start[order], length[order]
    c = np.zeros(len(s), np.uint16)
    pad = np.append(buf, np.zeros(2, np.uint8))
    word = (pad[:-1].astype(np.uint16) << np.uint16(8)) | pad[1:]
    alive = np.searchsorted(-n, -2 * np.arange(1, (int(n[0]) if len(n) else 0) // 2 + 1), side="right")
    for i, m in enumerate(alive):
        c[:m] = CRC16_WORD[c[:m] ^ word[s[:m] + 2 * i]]
    odd = np.flatnonzero(n & 1)
    c[odd] = (c[odd] << np.uint16(8)) ^ CRC16_BYTE[(c[odd] >> np.uint16(8)) ^ pad[s[odd] + n[odd] - 1]]
    out[order] = c
    return out


def _coded_number(n: int) -> bytes:
    """The frame number in the format's UTF-8-like code."""
    if n < 0x80:
        return bytes([n])
    tail = []
    room = 0x3F
    while n > room:
        tail.append(0x80 | (n & 0x3F))
        n >>= 6
        room >>= 1
    return bytes([(~(2 * room + 1) & 0xFF) | n, *reversed(tail)])


#: Blocks that are encoded, and bytes of frames that are decoded, side by side.
ROWS, TOGETHER = 512, 2_000_000

# ---------------------------------------------------------------- encoding


def _bits_of(values: np.ndarray, width: int) -> np.ndarray:
    """Each row of ``values`` as bits, ``width`` a value, most significant first."""
    v = values.astype(np.int64)
    shifts = np.arange(width - 1, -1, -1)
    return ((v[..., None] >> shifts) & 1).astype(np.uint8).reshape(*v.shape[:-1], -1)


def _linear(x: np.ndarray, order: int, precision: int) -> tuple[np.ndarray, np.ndarray]:
    """Quantised predictor of each row: coefficients (rows x order) and shifts. Sums are integers, so exact."""
    n = x.shape[1]
    r = np.stack([(x[:, : n - k] * x[:, k:]).sum(1, dtype=np.int64) for k in range(order + 1)], 1).astype(np.float64)
    a = np.zeros((len(x), order))
    err = np.maximum(r[:, 0] * (1 + 1e-9), 1e-9)
    for i in range(order):
        acc = r[:, i + 1].copy()
        for j in range(i):
            acc -= a[:, j] * r[:, i - j]
        k = np.clip(acc / err, -0.9999, 0.9999)
        new = a.copy()
        new[:, i] = k
        for j in range(i):
            new[:, j] = a[:, j] - k * a[:, i - 1 - j]
        a, err = new, np.maximum(err * (1 - k * k), 1e-9)
    top = np.maximum(np.abs(a).max(1), 1e-9)
    shift = np.clip(precision - 2 - np.floor(np.log2(top)).astype(np.int64), 0, 15)
    limit = (1 << (precision - 1)) - 1
    return np.clip(np.rint(a * (2.0 ** shift)[:, None]), -limit, limit).astype(np.int64), shift


def _residual(x: np.ndarray, coef: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """Residuals of each row behind its warm-up samples."""
    order, n = coef.shape[1], x.shape[1]
    p = np.zeros((len(x), n - order), x.dtype)
    for j in range(order):
        p += coef[:, j : j + 1].astype(x.dtype) * x[:, order - 1 - j : n - 1 - j]
    return x[:, order:] - (p >> shift[:, None].astype(x.dtype))


def _best_rice(u: np.ndarray, order: int, parts: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Rice parameter of each partition (rows x parts) and the bits of all."""
    n = u.shape[1] + order
    width = n // parts
    edges = [0, *(width * i - order for i in range(1, parts)), n - order]
    counts = np.diff(edges)
    costs = np.stack([np.add.reduceat(u >> k, edges[:-1], axis=1) + (k + 1) * counts for k in range(min(15, most + 1))], 2)
    return costs.argmin(2).astype(np.int32), costs.min(2).sum(1) + 4 * parts


def _encode_rows(x: np.ndarray, bits: int) -> tuple[list[bytes], list[np.ndarray]]:
    """Subframe bits of each row of ``x`` (samples of one channel, all rows of one length)."""
    m, n = x.shape
    parts = 4 if n % 4 == 0 and n // 4 > 4 else 1
    options = []
    for order in (0, 1, 2):
        if n > order:
            coef = np.tile(np.array(FIXED[order], np.int64), (m, 1)).reshape(m, order)
            options.append((8 + order, order, coef, np.zeros(m, np.int64), 0))
    if n > 64:
        coef, shift = _linear(x, 4, 12)
        options.append((32 + 3, 4, coef, shift, 12))
    made, costs = [], [np.full(m, 8 + bits * n, np.int64)]
    for kind, order, coef, shift, precision in options:
        res = _residual(x, coef, shift)
        u = np.where(res < 0, -2 * res - 1, 2 * res).astype(np.int32)
        k, cost = _best_rice(u, order, parts, bits)
        made.append((u, k))
        costs.append(cost + 8 + bits * order + (9 + precision * order if precision else 0) + 6)
    pick = np.stack(costs).argmin(0)
    flat = (x == x[:, :1]).all(1)
    out: list = [None] * m
    for i in np.flatnonzero(flat):
        out[i] = np.concatenate([np.zeros(8, np.uint8), _bits_of(x[i, :1], bits)])
    for i in np.flatnonzero(~flat & (pick == 0)):
        out[i] = np.concatenate([_bits_of(np.array([2]), 8), _bits_of(x[i], bits)])
    for o, (kind, order, coef, shift, precision) in enumerate(options):
        rows = np.flatnonzero(~flat & (pick == o + 1))
        if not len(rows):
            continue
        u, k = made[o][0][rows], made[o][1][rows]
        width = n // parts
        first = np.array([0, *(width * i - order for i in range(1, parts))])
        kk = np.repeat(k, np.diff([*first, n - order]), axis=1)
        q = u >> kk
        size = q + 1 + kk
        extra = np.zeros_like(size)
        extra[:, first] = 4  # a partition's parameter stands before its first sample
        end = np.cumsum((size + extra).ravel())
        at = (end - size.ravel()).reshape(size.shape)
        row_at = np.append(0, end[size.shape[1] - 1 :: size.shape[1]])
        stream = np.zeros(int(end[-1]) if len(end) else 0, np.uint8)
        stream[at + q] = 1
        for b in range(int(kk.max()) if kk.size else 0):
            has = kk > b
            stream[(at + q + kk - b)[has]] = ((u >> b) & 1)[has]
        for b in range(4):
            stream[at[:, first] - 4 + b] = (k >> (3 - b)) & 1
        head = _bits_of(np.array([2 * kind]), 8)
        method = _bits_of(np.array([parts.bit_length() - 1]), 6)
        for j, i in enumerate(rows):
            pre = [head, _bits_of(x[i, :order], bits)] if order else [head]
            if precision:
                pre += [_bits_of(np.array([precision - 1]), 4), _bits_of(shift[i : i + 1], 5), _bits_of(coef[i], precision)]
            out[i] = np.concatenate([*pre, method, stream[row_at[j] : row_at[j + 1]]])
    return out


def encode(payloads: list[bytes], block: int = 4096, rate: int = 8000) -> list[bytes]:
    """Each payload (not empty) as mono FLAC of 8-bit samples; a byte b is the sample b - 128."""
    blocks: list[tuple[int, int, np.ndarray]] = []
    signed = []
    for d, p in enumerate(payloads):
        x = (np.frombuffer(p, np.uint8) ^ np.uint8(128)).view(np.int8)
        signed.append(x)
        blocks += [(d, i, x[a : a + block]) for i, a in enumerate(range(0, len(x), block))]
    by_length: dict[int, list[int]] = {}
    for j, (_, _, x) in enumerate(blocks):
        by_length.setdefault(len(x), []).append(j)
    frames: list = [b""] * len(blocks)
    for own in (own[a : a + ROWS] for own in by_length.values() for a in range(0, len(own), ROWS)):
        n = len(blocks[own[0]][2])
        for j, sub in zip(own, _encode_rows(np.stack([blocks[j][2] for j in own]).astype(np.int32), 8), strict=True):
            # sync, fixed block size; 16-bit block size follows, rate as in the stream info; mono, 8 bits
            head = b"\xff\xf8\x70\x02" + _coded_number(blocks[j][1]) + (n - 1).to_bytes(2, "big")
            frames[j] = head + bytes([crc8(head)]) + np.packbits(sub).tobytes()
    lengths = np.array([len(f) for f in frames], np.int64)
    joined = np.frombuffer(b"".join(frames), np.uint8)
    sums = crc16_of(joined, np.cumsum(lengths) - lengths, lengths)
    out, j = [], 0
    for d, x in enumerate(signed):
        own, points, at = [], [], 0
        while j < len(blocks) and blocks[j][0] == d:
            f = frames[j] + int(sums[j]).to_bytes(2, "big")
            points.append((blocks[j][1] * block).to_bytes(8, "big") + at.to_bytes(8, "big") + len(blocks[j][2]).to_bytes(2, "big"))
            own.append(f)
            at += len(f)
            j += 1
        small = [len(f) for f in own]
        info = block.to_bytes(2, "big") * 2 + min(small).to_bytes(3, "big") + max(small).to_bytes(3, "big") + ((rate << 44) | (7 << 36) | len(x)).to_bytes(8, "big") + hashlib.md5(x.tobytes()).digest()
        seek = b"".join(points)
        out.append(b"fLaC\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(seek).to_bytes(3, "big") + seek + b"".join(own))
    return out


# ---------------------------------------------------------------- decoding


class Broken(ValueError):
    """A stream that can't be decoded, or whose checksums are wrong."""


@dataclass
class Stream:
    rate: int
    channels: int
    bits: int
    total: int
    md5: bytes
    seek: list[tuple[int, int, int]]
    first: int  # byte of the first frame
    frames: list[Frame] = field(default_factory=list)


@dataclass
class Frame:
    stream: int
    start: int  # byte in the batch's buffer
    end: int
    body: int  # byte of the first subframe
    n: int
    mode: int  # channel assignment
    bits: int
    first_sample: int = 0


def metadata(data: bytes) -> Stream:
    if data[:4] != b"fLaC":
        raise Broken("no fLaC mark")
    at, last, s, seek = 4, False, None, []
    while not last:
        if at + 4 > len(data):
            raise Broken("metadata end early")
        last, kind, n = bool(data[at] & 0x80), data[at] & 0x7F, int.from_bytes(data[at + 1 : at + 4], "big")
        body = data[at + 4 : at + 4 + n]
        if kind == 0:
            v = int.from_bytes(body[10:18], "big")
            s = Stream(v >> 44, ((v >> 41) & 7) + 1, ((v >> 36) & 31) + 1, v & ((1 << 36) - 1), body[18:34], seek, 0)
        elif kind == 3:
            for i in range(0, n, 18):
                p = int.from_bytes(body[i : i + 8], "big")
                if p != (1 << 64) - 1:
                    seek.append((p, int.from_bytes(body[i + 8 : i + 16], "big"), int.from_bytes(body[i + 16 : i + 18], "big")))
        at += 4 + n
    if s is None:
        raise Broken("no stream info")
    s.first = at
    return s


def _header(data: bytes, at: int, s: Stream) -> tuple[Frame, int] | None:
    """The frame whose header is at ``at``, and its number (of the frame, or of its first sample if the second bit says so)."""
    if at + 6 > len(data) or data[at] != 0xFF or data[at + 1] & 0xFE != 0xF8 or data[at + 3] & 1:
        return None
    size, rate, mode, depth = data[at + 2] >> 4, data[at + 2] & 15, data[at + 3] >> 4, (data[at + 3] >> 1) & 7
    p = at + 4
    b = data[p]
    more = 0
    if b >= 0x80:
        while more < 7 and b & (0x40 >> more):
            more += 1
        if not more:
            return None
    number = b & (0x7F if not more else 0x3F >> more)
    for c in data[p + 1 : p + 1 + more]:
        number = (number << 6) | (c & 0x3F)
    p += 1 + more
    if size == 6:
        n, p = data[p] + 1, p + 1
    elif size == 7:
        n, p = int.from_bytes(data[p : p + 2], "big") + 1, p + 2
    else:
        n = BLOCK_SIZES.get(size, 0)
    p += {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if p >= len(data) or not n or mode > 10 or crc8(data[at:p]) != data[p]:
        return None
    bits = s.bits if depth == 0 else SAMPLE_BITS.get(depth, 0)
    return (Frame(0, at, 0, p + 1, n, mode, bits), number) if bits else None


def _every_frame(s: Stream, size: int) -> list[int]:
    """Offsets of all frames, if the seek table has a point for each; else nothing."""
    at = 0
    for sample, offset, n in s.seek:
        if sample != at or s.first + offset >= size:
            return []
        at += n
    return [s.first + p[1] for p in s.seek] if s.total and at == s.total else []


def _next_sync(data: bytes, at: int) -> int:
    while (at := data.find(b"\xff", at)) >= 0:
        if data[at + 1 : at + 2] in (b"\xf8", b"\xf9"):
            return at
        at += 1
    return len(data)


def _find_frames(data: bytes, s: Stream) -> list[Frame]:
    """Frames at the seek table's points if it has all; else at each sync code whose header has the right checksum and
    the next number. ``_check_frames`` then tests what lies between."""
    found: list[Frame] = []
    known, sample = iter(_every_frame(s, len(data))), 0
    at = next(known, s.first)
    exact = bool(_every_frame(s, len(data)))
    while at < len(data):
        got = _header(data, at, s)
        if got and got[1] == (sample if data[at + 1] & 1 else len(found)):
            f = got[0]
            if found:
                found[-1].end = at
            f.first_sample = sample
            sample += f.n
            found.append(f)
        elif exact or not found:
            raise Broken("no frame where one should be")
        at = next(known, len(data)) if exact else _next_sync(data, found[-1].body if got and found[-1].start == at else at + 1)
    if found:
        found[-1].end = len(data)
    return found


class _Bits:
    """A buffer that many readers read at bit positions of their own."""

    def __init__(self, buf: np.ndarray):
        pad = np.append(buf, np.zeros(8, np.uint8)).astype(np.int64)
        self.word = (pad[:-4] << 32) | (pad[1:-3] << 24) | (pad[2:-2] << 16) | (pad[3:-1] << 8) | pad[4:]
        bits = np.unpackbits(buf)
        at = np.where(bits, np.arange(len(bits), dtype=np.int32), np.int32(len(bits)))
        self.next_one = np.append(np.minimum.accumulate(at[::-1])[::-1], np.int32(len(bits)))
        self.n = len(bits)

    def read(self, p: np.ndarray, width: np.ndarray | int) -> np.ndarray:
        """Unsigned numbers of up to 32 bits at bit positions ``p``."""
        if np.any(p + width > self.n):
            raise Broken("frame ends early")
        return (self.word[p >> 3] >> (40 - (p & 7) - width)) & ((np.int64(1) << width) - 1)

    def signed(self, p: np.ndarray, width: np.ndarray | int) -> np.ndarray:
        v = self.read(p, width)
        return np.where(v >> (width - 1), v - (np.int64(1) << width), v)


def _subframes(b: _Bits, p: np.ndarray, n: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Samples (lanes x longest) of one subframe of each frame, and where each ends. p: bit positions."""
    lanes, longest = len(p), int(n.max())
    x = np.zeros((lanes, longest), np.int64)
    kind = b.read(p, 8)
    if np.any(kind & 0x80):
        raise Broken("bad subframe")
    p = p + 8
    wasted = np.zeros(lanes, np.int64)
    w = np.flatnonzero(kind & 1)
    wasted[w] = b.next_one[p[w]] - p[w] + 1
    p[w] += wasted[w]
    bits = bits - wasted
    kind = (kind >> 1) & 0x3F
    for i in np.flatnonzero(kind == 0):
        x[i, : n[i]] = b.signed(p[i : i + 1], bits[i])
        p[i] += bits[i]
    for i in np.flatnonzero(kind == 1):
        x[i, : n[i]] = b.signed(p[i] + bits[i] * np.arange(n[i]), bits[i])
        p[i] += bits[i] * n[i]
    fixed, linear = (kind >= 8) & (kind <= 12), kind >= 32
    if np.any(~fixed & ~linear & (kind > 1)):
        raise Broken("reserved subframe")
    order = np.where(fixed, kind - 8, np.where(linear, kind - 31, 0))
    own = np.flatnonzero(fixed | linear)
    if len(own):
        _predicted(b, x, p, n, bits, kind, order, own)
    return x << wasted[:, None], p


def _predicted(b: _Bits, x, p, n, bits, kind, order, own) -> None:
    top = int(order[own].max())
    for t in range(top):  # warm-up samples
        i = own[order[own] > t]
        x[i, t] = b.signed(p[i], bits[i])
        p[i] += bits[i]
    coef, shift = np.zeros((len(x), max(top, 1)), np.int64), np.zeros(len(x), np.int64)
    for i in own[kind[own] < 32]:
        coef[i, : order[i]] = FIXED[int(order[i])]
    lin = own[kind[own] >= 32]
    if len(lin):
        precision = b.read(p[lin], 4) + 1
        shift[lin] = b.signed(p[lin] + 4, 5)
        if np.any(shift[lin] < 0) or np.any(precision == 16):
            raise Broken("bad predictor")
        p[lin] += 9
        for t in range(int(order[lin].max())):
            sel = order[lin] > t
            i = lin[sel]
            coef[i, t] = b.signed(p[i], precision[sel])
            p[i] += precision[sel]
    _rice(b, x, p, n, order, own)
    # the predictors run forward, all lanes at once; a lane's warm-up and end are left alone
    rows = own[np.argsort(-n[own], kind="stable")]
    y = np.zeros((int(n[own].max()) + top, len(rows)), np.int64)
    y[top:] = x[rows, : int(n[own].max())].T
    c, s, o = coef[rows, :top][:, ::-1].T.copy(), shift[rows], order[rows]
    alive = np.searchsorted(-n[rows], -np.arange(1, int(n[own].max()) + 1), side="right")
    if top:
        for t in range(1, len(alive)):
            m = alive[t]
            guess = (y[t : t + top, :m] * c[:, :m]).sum(0) >> s[:m]
            y[top + t, :m] += guess if t >= top else np.where(o[:m] <= t, guess, 0)
        x[rows, : len(alive)] = y[top:].T


def _rice(b: _Bits, x, p, n, order, own) -> None:
    """Residuals of the lanes ``own`` into x, partition by partition."""
    method, po = b.read(p[own], 2), b.read(p[own] + 2, 4)
    if np.any(method > 1):
        raise Broken("reserved residual coding")
    p[own] += 6
    width, escape = 4 + method, np.where(method == 0, 15, 31)
    size = n[own] >> po
    at = order[own].copy()  # next sample of each lane
    for part in range(int(1 << po.max())):
        on = np.flatnonzero(part < (1 << po))
        lane = own[on]
        k = b.read(p[lane], width[on])
        p[lane] += width[on]
        count = size[on] - (order[lane] if part == 0 else 0)
        raw = k == escape[on]
        for j in np.flatnonzero(raw):
            i, w = lane[j], int(b.read(p[lane[j : j + 1]], 5)[0])
            p[i] += 5
            if w:
                x[i, at[on[j]] : at[on[j]] + count[j]] = b.signed(p[i] + w * np.arange(count[j]), w)
            p[i] += w * count[j]
        ready = np.flatnonzero(~raw & (count > 0))
        ready = ready[np.argsort(-count[ready], kind="stable")]
        if len(ready):
            lanes, kk, c = lane[ready], k[ready], count[ready]
            pos, to = p[lanes], at[on[ready]]
            got = np.zeros((int(c[0]), len(lanes)), np.int64)
            alive = np.searchsorted(-c, -np.arange(1, int(c[0]) + 1), side="right")
            one, word, keep, down = b.next_one, b.word, (np.int64(1) << kk) - 1, 40 - kk
            limit = b.n
            for t, m in enumerate(alive):
                e = one[pos[:m]].astype(np.int64)
                q = e - pos[:m]
                e += 1
                got[t, :m] = (q << kk[:m]) | ((word[np.minimum(e, limit - 1) >> 3] >> (down[:m] - (e & 7))) & keep[:m])
                pos[:m] = e + kk[:m]
                if m and pos[:m].max() > limit:
                    raise Broken("frame ends early")
            value = (got >> 1) ^ -(got & 1)
            for j in range(len(lanes)):
                x[lanes[j], to[j] : to[j] + c[j]] = value[: c[j], j]
            p[lanes] = pos
        at[on] += count


def _frames_of(streams: list[bytes]) -> tuple[np.ndarray, list[Stream]]:
    out, at = [], 0
    for k, data in enumerate(streams):
        s = metadata(data)
        s.frames = _find_frames(data, s)
        for f in s.frames:
            f.stream, f.start, f.end, f.body = k, f.start + at, f.end + at, f.body + at
        out.append(s)
        at += len(data)
    return np.frombuffer(b"".join(streams), np.uint8), out


def _check_frames(buf: np.ndarray, found: list[Stream]) -> None:
    frames = [f for s in found for f in s.frames]
    if not frames:
        return
    start, end = np.array([f.start for f in frames]), np.array([f.end for f in frames])
    have = (buf[end - 2].astype(np.uint16) << np.uint16(8)) | buf[end - 1]
    if np.any(crc16_of(buf, start, end - start - 2) != have):
        raise Broken("wrong frame checksum")


def _samples(buf: np.ndarray, frames: list[Frame]) -> list[np.ndarray]:
    """Samples (channels x n) of consecutive frames, decoded side by side."""
    base = frames[0].start
    bits = _Bits(buf[base : frames[-1].end])
    n, mode, depth = (np.array([getattr(f, c) for f in frames]) for c in ("n", "mode", "bits"))
    pos = np.array([8 * (f.body - base) for f in frames])
    channels = np.where(mode < 8, mode + 1, 2)
    got: list[list[np.ndarray]] = [[] for _ in frames]
    for c in range(int(channels.max())):
        on = np.flatnonzero(channels > c)
        side = ((mode[on] == 8) & (c == 1)) | ((mode[on] == 9) & (c == 0)) | ((mode[on] == 10) & (c == 1))
        x, p = _subframes(bits, pos[on], n[on], depth[on] + side)
        pos[on] = p
        for j, i in enumerate(on):
            got[i].append(x[j, : n[i]])
    out = []
    for i, f in enumerate(frames):
        if (pos[i] + 7) // 8 != f.end - 2 - base:
            raise Broken("frame of another length than its residuals")
        ch = got[i]
        if f.mode == 8:
            ch = [ch[0], ch[0] - ch[1]]
        elif f.mode == 9:
            ch = [ch[0] + ch[1], ch[1]]
        elif f.mode == 10:
            mid = (ch[0] << 1) | (ch[1] & 1)
            ch = [(mid + ch[1]) >> 1, (mid - ch[1]) >> 1]
        out.append(np.stack(ch).astype(np.int32))
    return out


def decode(streams: list[bytes]) -> list[tuple[Stream, list[np.ndarray]]]:
    """For each stream its info and the samples (channels x n) of each frame; raises ``Broken`` on any fault."""
    buf, found = _frames_of(streams)
    _check_frames(buf, found)
    frames = [f for s in found for f in s.frames]
    samples: list[np.ndarray] = []
    first = 0
    while first < len(frames):
        last = first + 1
        while last < len(frames) and frames[last].end - frames[first].start <= TOGETHER:
            last += 1
        samples += _samples(buf, frames[first:last])
        first = last
    out, j = [], 0
    for s in found:
        own = samples[j : j + len(s.frames)]
        j += len(s.frames)
        if s.total and sum(x.shape[1] for x in own) != s.total:
            raise Broken("number of samples")
        if any(s.md5):
            h = hashlib.md5()
            for x in own:
                h.update(pcm(x, s.bits))
            if h.digest() != s.md5:
                raise Broken("wrong MD5")
        out.append((s, own))
    return out


def pcm(x: np.ndarray, bits: int) -> bytes:
    """Samples (channels x n) interleaved, signed, little-endian, in whole bytes."""
    width = (bits + 7) // 8
    flat = x.T.reshape(-1).astype("<i4")
    return flat.astype(np.int8).tobytes() if width == 1 else flat.view(np.uint8).reshape(-1, 4)[:, :width].tobytes()


def batches_of(items: list, size: int = 2_000_000) -> Iterator[list[int]]:
    """Numbers of items of bounded size together (a larger one alone)."""
    own, total = [], 0
    for i, x in enumerate(items):
        if own and total + len(x) > size:
            yield own
            own, total = [], 0
        own.append(i)
        total += len(x)
    if own:
        yield own
