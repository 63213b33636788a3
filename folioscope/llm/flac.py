"""Media columns: FLAC.

Samples are 8-bit mono in blocks of BLOCK. The encoder chooses for each block
a constant, a fixed or a quantised linear predictor with Rice-coded residuals
in four partitions, or the samples as they are. The decoder finds the frames
by their sync codes, verifies the header's CRC-8 and the frame's CRC-16,
decodes the residuals, runs the predictors, checks the stream's MD5 and gives
blocks of PCM with their sample offsets. Many frames are coded side by side:
step i of all of them is one numpy operation. Frames of other kinds (several
channels, other widths and block sizes, escaped partitions) go through a plain
decoder that knows the whole format but runs alone.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm._common import delete_path, fresh_path, stored, table

BLOCK = 576
#: Frames coded side by side, which bounds the memory.
FRAMES = 2048
#: The order of the quantised linear predictor, its precision in bits and its shift.
ORDER, PRECISION, SHIFT = 4, 10, 7
#: Each residual is coded in 2 ** PARTITION_ORDER partitions.
PARTITION_ORDER = 2
#: A seek point for every so many frames.
SEEK_EVERY = 16
RATE = 8000
#: Weights of the fixed predictors of order 0 to 4 on the last samples.
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))


def _table(poly: int, bits: int) -> np.ndarray:
    out = np.arange(256, dtype=np.uint32) << (bits - 8)
    for _ in range(8):
        out = np.where(out >> (bits - 1) & 1, (out << 1) ^ poly, out << 1) & ((1 << bits) - 1)
    return out.astype(np.uint16 if bits == 16 else np.uint8)


CRC8, CRC16 = _table(0x07, 8), _table(0x8005, 16)
_CRC8_LIST, _CRC16_LIST = CRC8.tolist(), CRC16.tolist()


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = _CRC8_LIST[c ^ b]
    return c


def crc16(data: bytes) -> int:
    c = 0
    for b in data:
        c = (c << 8 & 0xFFFF) ^ _CRC16_LIST[c >> 8 ^ b]
    return c


def crc16_many(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-16 of many stretches of data side by side, the longest first."""
    order = np.argsort(-lengths, kind="stable")
    at, left, c = starts[order], lengths[order], np.zeros(len(order), np.uint16)
    live = np.searchsorted(-left, -np.arange(int(left[0]) if len(left) else 0), side="left")  # stretches longer than i
    for i, n in enumerate(live.tolist()):
        own = c[:n]
        c[:n] = (own << np.uint16(8)) ^ CRC16[(own >> np.uint16(8)) ^ data[at[:n] + i]]
    out = np.empty_like(c)
    out[order] = c
    return out


def number(n: int) -> bytes:
    """A frame number in the format's extended UTF-8."""
    if n < 0x80:
        return bytes([n])
    for extra in range(1, 7):
        if n < 1 << (5 * extra + 6) or extra == 6:
            break
    tail = [0x80 | n >> 6 * i & 0x3F for i in range(extra)][::-1]
    return bytes([(0xFF << 7 - extra - 1 + 0) & 0xFF & ~(1 << 6 - extra) | n >> 6 * extra, *tail]) if extra < 6 else bytes([0xFE, *tail])


_HEADERS: dict[int, bytes] = {}


def header(n: int) -> bytes:
    """Frame header of number n: fixed block size 576, rate from STREAMINFO, mono, 8 bits."""
    if n not in _HEADERS:
        if len(_HEADERS) > 10_000:
            _HEADERS.clear()
        head = b"\xff\xf8\x20\x02" + number(n)
        _HEADERS[n] = head + bytes([crc8(head)])
    return _HEADERS[n]


# --- encoder ---------------------------------------------------------------


def _put(bits: np.ndarray, pos: np.ndarray, value: np.ndarray, width: np.ndarray) -> None:
    """Write value's lowest `width` bits, highest first, so that they end before pos + width."""
    value = value.astype(np.int64)
    last = pos + width - 1
    for j in range(int(width.max()) if len(width) else 0):
        use = width > j
        bits[last[use] - j] = (value[use] >> j) & 1


def _lpc(x: np.ndarray) -> np.ndarray:
    """Quantised predictor weights of each row by Levinson's recursion on its windowed autocorrelation."""
    y = x * np.hanning(BLOCK)[None, :]
    r = np.stack([(y[:, : BLOCK - k] * y[:, k:]).sum(1) for k in range(ORDER + 1)], axis=1)
    r[:, 0] = r[:, 0] * 1.0001 + 1e-9
    a, e = np.zeros((len(x), ORDER)), r[:, 0].copy()
    for i in range(ORDER):
        k = (r[:, i + 1] - (a[:, :i] * r[:, i:0:-1]).sum(1)) / e
        a[:, :i] -= k[:, None] * a[:, :i][:, ::-1]
        a[:, i] = k
        e *= np.maximum(1 - k * k, 1e-9)
    most = (1 << PRECISION - 1) - 1
    return np.clip(np.rint(a * (1 << SHIFT)), -most - 1, most).astype(np.int32)


def encode_frames(x: np.ndarray, numbers: np.ndarray) -> list[bytes]:
    """Frames of the rows of x (n x BLOCK, -128 to 127)."""
    n, parts = len(x), 1 << PARTITION_ORDER
    size = BLOCK // parts
    x = x.astype(np.int32)
    diff = x
    # of fixed predictors and the linear one, that with the smallest sum of residuals
    best = np.abs(x).sum(1)
    kind = np.zeros(n, np.int64)
    residual = x.copy()
    for order in range(1, 5):
        diff = np.diff(diff, axis=1)
        cost = np.abs(diff).sum(1)
        better = cost < best
        best = np.where(better, cost, best)
        kind[better] = order
        residual[better, order:] = diff[better]
    coefs = _lpc(x)
    predicted = np.zeros((n, BLOCK - ORDER), np.int32)
    for j in range(ORDER):
        predicted += coefs[:, j : j + 1] * x[:, ORDER - 1 - j : BLOCK - 1 - j]
    linear = x[:, ORDER:] - (predicted >> SHIFT)
    better = np.abs(linear).sum(1) < best
    kind[better] = 5
    residual[better, ORDER:] = linear[better]
    orders = np.where(kind == 5, ORDER, kind)
    coded = np.arange(BLOCK)[None, :] >= orders[:, None]
    u = np.where(coded, (residual << 1) ^ (residual >> 31), 0)
    shaped, counts = u.reshape(n, parts, size), coded.reshape(n, parts, size).sum(2)
    guess = np.maximum(np.floor(np.log2(np.maximum(shaped.sum(2) / np.maximum(counts, 1), 1e-9) * 0.7 + 1e-9)), 0).astype(np.int32)
    lengths, ks = None, None
    for step in (-1, 0, 1):
        k = np.clip(guess + step, 0, 14)
        cost = (shaped >> k[:, :, None]).sum(2) + counts * (k + 1)
        if lengths is None:
            lengths, ks = cost, k
        else:
            less = cost < lengths
            lengths, ks = np.where(less, cost, lengths), np.where(less, k, ks)
    extra = np.where(kind == 5, 4 + 5 + ORDER * PRECISION, 0)
    total = 8 + orders * 8 + extra + 6 + 4 * parts + lengths.sum(1)
    constant = (x == x[:, :1]).all(1)
    verbatim = ~constant & (total >= 8 + 8 * BLOCK)
    plain = ~constant & ~verbatim
    total = np.where(constant, 16, np.where(verbatim, 8 + 8 * BLOCK, total))
    heads = [header(i) for i in numbers.tolist()]
    head_len = np.fromiter(map(len, heads), np.int64, n)
    byte_len = head_len + (total + 7) // 8 + 2
    starts = np.append(0, np.cumsum(byte_len))
    bits = np.zeros(int(starts[-1]) * 8, np.uint8)
    at = (starts[:-1] + head_len) * 8
    tag = np.where(constant, 0, np.where(verbatim, 1, np.where(kind == 5, 32 + ORDER - 1, 8 + kind))) << 1
    _put(bits, at, tag, np.full(n, 8))
    at = at + 8
    c = np.flatnonzero(constant)
    _put(bits, at[c], x[c, 0] & 255, np.full(len(c), 8))
    v = np.flatnonzero(verbatim)
    if len(v):
        where = (at[v][:, None] + 8 * np.arange(BLOCK)).ravel()
        _put(bits, where, (x[v] & 255).ravel(), np.full(len(where), 8))
    p = np.flatnonzero(plain)
    if len(p):
        at, o = at[p], orders[p]
        for j in range(ORDER):
            use = np.flatnonzero(o > j)
            _put(bits, at[use] + 8 * j, x[p[use], j] & 255, np.full(len(use), 8))
        at = at + 8 * o
        l = np.flatnonzero(kind[p] == 5)
        _put(bits, at[l], np.full(len(l), (PRECISION - 1) << 5 | SHIFT), np.full(len(l), 9))
        for j in range(ORDER):
            _put(bits, at[l] + 9 + PRECISION * j, coefs[p[l], j] & ((1 << PRECISION) - 1), np.full(len(l), PRECISION))
        at = at + extra[p]
        _put(bits, at, np.full(len(p), PARTITION_ORDER), np.full(len(p), 6))  # method 0 in two bits, then the order
        at = at + 6
        k = np.repeat(ks[p], size, axis=1)
        width = np.where(coded[p], (u[p] >> k) + 1 + k, 0)
        first = np.zeros((len(p), BLOCK), np.int64)
        first[:, ::size] = 4
        ends = at[:, None] + np.cumsum(width + first, axis=1)
        for j in range(parts):
            _put(bits, ends[:, j * size] - width[:, j * size] - 4, ks[p][:, j], np.full(len(p), 4))
        mask = coded[p]
        ends, k, value = ends[mask], k[mask], u[p][mask]
        bits[ends - 1 - k] = 1
        for j in range(int(k.max()) if len(k) else 0):
            low = k > j
            bits[ends[low] - 1 - j] = (value[low] >> j) & 1
    data = np.packbits(bits)
    for i, h in enumerate(heads):
        data[starts[i] : starts[i] + len(h)] = np.frombuffer(h, np.uint8)
    crc = crc16_many(data, starts[:-1], byte_len - 2)
    data[starts[1:] - 2], data[starts[1:] - 1] = crc >> 8, crc & 255
    raw, cuts = data.tobytes(), starts.tolist()
    return [raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def _stream(payload: bytes, frames: list[bytes]) -> bytes:
    sizes = list(map(len, frames))
    signed = (np.frombuffer(payload, np.uint8) ^ 128).tobytes()
    info = struct.pack(">HH", BLOCK, BLOCK) + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big")
    info += (RATE << 44 | 0 << 41 | 7 << 36 | len(payload)).to_bytes(8, "big") + hashlib.md5(signed, usedforsecurity=False).digest()
    points, at = [], 0
    for i, n in enumerate(sizes):
        if i % SEEK_EVERY == 0:
            points.append(struct.pack(">QQH", i * BLOCK, at, BLOCK))
        at += n
    seek = b"".join(points)
    return b"fLaC" + b"\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(seek).to_bytes(3, "big") + seek + b"".join(frames)


def encode_many(payloads: list[bytes]) -> list[bytes]:
    """FLAC streams of payloads, each a positive multiple of BLOCK bytes; byte b is sample b - 128."""
    counts = [len(p) // BLOCK for p in payloads]
    if any(len(p) % BLOCK or not p for p in payloads):
        raise ValueError(f"a payload must be a positive multiple of {BLOCK} bytes")
    frames: list[bytes] = []
    flat = [(i, j) for i, c in enumerate(counts) for j in range(0, c, FRAMES)]
    rows, numbers, held = [], [], 0

    def flush() -> None:
        nonlocal rows, numbers, held
        if rows:
            x = np.concatenate(rows).reshape(-1, BLOCK).astype(np.int16) - 128
            frames.extend(encode_frames(x, np.concatenate(numbers)))
            rows, numbers, held = [], [], 0

    for i, j in flat:
        n = min(FRAMES, counts[i] - j)
        if held + n > FRAMES:
            flush()
        rows.append(np.frombuffer(payloads[i], np.uint8)[j * BLOCK : (j + n) * BLOCK])
        numbers.append(np.arange(j, j + n))
        held += n
    flush()
    out, at = [], 0
    for p, c in zip(payloads, counts, strict=True):
        out.append(_stream(p, frames[at : at + c]))
        at += c
    return out


# --- decoder ---------------------------------------------------------------


class Broken(ValueError):
    """A stream fails a check."""


class Info:
    """What STREAMINFO and SEEKTABLE say, and where the frames begin."""

    def __init__(self, data: bytes):
        if data[:4] != b"fLaC":
            raise Broken("no stream marker")
        at, last, self.points = 4, False, []
        while not last:
            if at + 4 > len(data):
                raise Broken("metadata cut off")
            last, kind, n = bool(data[at] & 128), data[at] & 127, int.from_bytes(data[at + 1 : at + 4], "big")
            body = data[at + 4 : at + 4 + n]
            at += 4 + n
            if kind == 0:
                self.smallest, self.largest = struct.unpack(">HH", body[:4])
                word = int.from_bytes(body[10:18], "big")
                self.rate, self.channels, self.bits, self.samples = word >> 44, (word >> 41 & 7) + 1, (word >> 36 & 31) + 1, word & (1 << 36) - 1
                self.md5 = body[18:34]
            elif kind == 3:
                self.points = [p for i in range(0, n - 17, 18) if (p := struct.unpack(">QQH", body[i : i + 18]))[0] != (1 << 64) - 1]
        self.first = at


class _Bits:
    def __init__(self, data: bytes, at: int):
        self.data, self.pos = data, at * 8

    def take(self, n: int) -> int:
        a, b = self.pos >> 3, self.pos + n + 7 >> 3
        if b > len(self.data):
            raise Broken("frame cut off")
        value = int.from_bytes(self.data[a:b], "big") >> (b * 8 - self.pos - n) & (1 << n) - 1
        self.pos += n
        return value

    def signed(self, n: int) -> int:
        v = self.take(n)
        return v - (1 << n) if n and v >> n - 1 else v

    def unary(self) -> int:
        n = 0
        while not self.take(1):
            n += 1
        return n


def parse_header(data: bytes, at: int, info: Info) -> tuple[int, int, int, int, int, bool] | None:
    """(block size, channel code, bits, number, place after the header, variable) of a valid frame header at a place, else None."""
    if len(data) < at + 6 or data[at] != 255 or data[at + 1] & 0xFE != 0xF8:
        return None
    size, rate, channels, width = data[at + 2] >> 4, data[at + 2] & 15, data[at + 3] >> 4, data[at + 3] >> 1 & 7
    if not size or rate == 15 or channels > 10 or width == 3 or data[at + 3] & 1:
        return None
    b, p = data[at + 4], at + 5
    extra = 0 if b < 0x80 else 8 - (b ^ 0xFF).bit_length() - 1
    if b >= 0x80 and (extra < 1 or extra > 6):
        return None
    value = b if b < 0x80 else b & (0x3F >> extra)
    for _ in range(extra):
        if p >= len(data) or data[p] & 0xC0 != 0x80:
            return None
        value, p = value << 6 | data[p] & 0x3F, p + 1
    if size in (6, 7):
        blocks = int.from_bytes(data[p : p + size - 5], "big") + 1
    else:
        blocks = 192 if size == 1 else 576 << size - 2 if size <= 5 else 256 << size - 8
    p += {6: 1, 7: 2}.get(size, 0) + {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if p >= len(data) or crc8(data[at:p]) != data[p]:
        return None
    return blocks, channels, {0: info.bits, 1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}[width], value, p + 1, bool(data[at + 1] & 1)


def frame_places(data: bytes, info: Info) -> list[tuple[int, int]]:
    """(start, end) of each frame, found by sync codes whose headers pass their check and go on with the numbering."""
    starts, at, expected, variable = [], info.first, 0, None
    while at < len(data):
        found = parse_header(data, at, info)
        if found and variable in (None, found[5]) and found[3] == expected:
            starts.append(at)
            variable = found[5]
            expected += found[0] if variable else 1
            at = data.find(b"\xff", at + 6)
        else:
            if not starts:
                raise Broken("no frame where the first one is due")
            at = data.find(b"\xff", at + 1)
        if at < 0:
            break
    return list(zip(starts, [*starts[1:], len(data)], strict=True))


def decode_in_turn(data: bytes, info: Info) -> np.ndarray:
    """Samples of the first channel, frame by frame: each tells where it ends, so nothing within it can pass for a header."""
    at, out = info.first, []
    while at < len(data):
        x, at = decode_frame(data, at, info)
        out.append(x[0])
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def decode_frame(data: bytes, at: int, info: Info) -> tuple[np.ndarray, int]:
    """Samples (channels x block) of any frame and the place after it; checks both CRCs."""
    found = parse_header(data, at, info)
    if not found:
        raise Broken("frame header")
    size, code, width, _, place, _ = found
    bits, rows = _Bits(data, place), []
    for c in range(code + 1 if code < 8 else 2):
        rows.append(_subframe(bits, size, width + (code == 8 and c == 1 or code == 9 and c == 0 or code == 10 and c == 1)))
    end = bits.pos + 7 >> 3
    if crc16(data[at:end]) != int.from_bytes(data[end : end + 2], "big") or end + 2 > len(data):
        raise Broken("frame CRC-16")
    x = np.array(rows, np.int64)
    if code == 8:
        x[1] = x[0] - x[1]
    elif code == 9:
        x[0] = x[0] + x[1]
    elif code == 10:
        middle = x[0] * 2 + (x[1] & 1)
        x = np.stack([(middle + x[1]) >> 1, (middle - x[1]) >> 1])
    return x, end + 2


def _subframe(bits: _Bits, size: int, width: int) -> list[int]:
    if bits.take(1):
        raise Broken("subframe padding")
    kind, wasted = bits.take(6), 0
    if bits.take(1):
        wasted = bits.unary() + 1
    width -= wasted
    if kind == 0:
        out = [bits.signed(width)] * size
    elif kind == 1:
        out = [bits.signed(width) for _ in range(size)]
    elif 8 <= kind <= 12 or kind >= 32:
        order = kind - 8 if kind <= 12 else kind - 31
        out = [bits.signed(width) for _ in range(order)]
        weights, shift = FIXED[order] if kind <= 12 else (), 0
        if kind >= 32:
            precision, shift = bits.take(4) + 1, bits.signed(5)
            weights = [bits.signed(precision) for _ in range(order)]
        method, parts = bits.take(2), bits.take(4)
        if method > 1:
            raise Broken("residual method")
        for part in range(1 << parts):
            k = bits.take(4 + method)
            count = (size >> parts) - (order if part == 0 else 0)
            if k == (15, 31)[method]:
                raw = bits.take(5)
                residual = [bits.signed(raw) for _ in range(count)]
            else:
                residual = [u >> 1 ^ -(u & 1) for _ in range(count) for u in [bits.unary() << k | bits.take(k)]]
            for r in residual:
                out.append(r + (sum(w * s for w, s in zip(weights, out[: -order - 1 : -1], strict=True)) >> shift if order else 0))
    else:
        raise Broken("subframe type")
    return [s << wasted for s in out] if wasted else out


def _decode_side_by_side(data: np.ndarray, places: np.ndarray, head_len: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """n x BLOCK samples of mono 8-bit frames of BLOCK samples, and which of them need the plain decoder."""
    n = len(places)
    out, odd = np.zeros((n, BLOCK), np.int32), np.zeros(n, bool)
    bits = np.unpackbits(data)
    wide = np.zeros(len(data) + 4, np.int64)
    wide[: len(data)] = data
    wide = wide[:-2] << 16 | np.append(wide[1:-2] << 8, 0) | np.append(wide[2:-2], [0, 0])

    def take(pos: np.ndarray, k: np.ndarray | int) -> np.ndarray:
        return wide[pos >> 3] >> (24 - (pos & 7) - k) & ((1 << k) - 1)

    ones = np.where(bits, np.arange(len(bits), dtype=np.int32), np.int32(len(bits)))
    ones = np.append(np.minimum.accumulate(ones[::-1])[::-1], np.int32(len(bits)))
    at = (places + head_len) * 8
    tag = take(at, 8)
    at = at + 8
    kind = tag >> 1
    odd |= (tag & 129) != 0
    c = np.flatnonzero(~odd & (kind == 0))
    out[c] = (take(at[c], 8) ^ 128)[:, None] - 128
    v = np.flatnonzero(~odd & (kind == 1))
    out[v] = (data[(at[v] >> 3)[:, None] + np.arange(BLOCK)].astype(np.int32) ^ 128) - 128
    fixed, linear = (kind >= 8) & (kind <= 12), (kind >= 32) & (kind < 32 + 8)
    odd |= ~((kind == 0) | (kind == 1) | fixed | linear)
    p = np.flatnonzero(~odd & (fixed | linear))
    if not len(p):
        return out, odd
    order, pos, lin = np.where(fixed[p], kind[p] - 8, kind[p] - 31), at[p], linear[p]
    top = max(4, int(order.max()))
    x = np.zeros((BLOCK, len(p)), np.int64)
    for j in range(top):
        use = order > j
        x[j, use] = (take(pos[use] + 8 * j, 8) ^ 128) - 128
    pos = pos + 8 * order
    weights, shift = np.zeros((top, len(p)), np.int64), np.zeros(len(p), np.int64)
    for o, w in enumerate(FIXED):
        use = ~lin & (order == o)
        for j, value in enumerate(w):
            weights[j, use] = value
    if lin.any():
        precision = take(pos, 4) + 1
        s = take(pos + 4, 5)
        strange = lin & ((precision > 15) | (s > 15))
        shift = np.where(lin, s & 15, 0)
        pos = pos + np.where(lin, 9, 0)
        for j in range(top):
            use = lin & (order > j)
            raw = take(pos, precision)
            weights[j, use] = (raw - ((raw >> precision - 1) << precision))[use]
            pos = pos + np.where(use, precision, 0)
        odd[p[strange]] = True
    method, parts = take(pos, 2), take(pos + 2, 4)
    pos = pos + 6
    odd[p[(method != 0) | (BLOCK % (1 << np.minimum(parts, 10)) != 0) | (parts > 6)]] = True
    length = BLOCK >> np.minimum(parts, 6)
    k, limit = np.zeros(len(p), np.int64), len(bits)
    escaped = np.zeros(len(p), bool)
    steady = int(order.min())
    for i in range(BLOCK):
        begins = i % length == 0
        if begins.any():
            pos = np.minimum(pos, limit - 1)
            k = np.where(begins, take(pos, 4), k)
            pos = pos + 4 * begins
            escaped |= k == 15
        if i < steady:
            continue
        one = ones[np.minimum(pos, limit)]
        u = (one - pos) << k
        pos2 = np.minimum(one + 1, limit - 1)
        u |= take(pos2, k)
        r = (u >> 1) ^ -(u & 1)
        after = pos2 + k
        if i < top:
            live = order <= i
            predicted = _predict(x, weights, shift, i, min(i, top))
            x[i] = np.where(live, r + predicted, x[i])
            pos = np.where(live, after, pos)
        else:
            x[i] = r + _predict(x, weights, shift, i, top)
            pos = after
    odd[p[escaped]] = True
    out[p] = np.clip(x.T, -128, 127)
    return out, odd


def _predict(x: np.ndarray, weights: np.ndarray, shift: np.ndarray, i: int, reach: int) -> np.ndarray:
    total = np.zeros(x.shape[1], np.int64)
    for j in range(reach):
        total += weights[j] * x[i - 1 - j]
    return total >> shift


def decode_many(streams: list[bytes]) -> list[np.ndarray]:
    """Samples of mono streams, all checks made."""
    infos = [Info(s) for s in streams]
    work = [(i, a, b) for i, (s, info) in enumerate(zip(streams, infos, strict=True)) for a, b in frame_places(s, info)]
    parts: list[list[np.ndarray]] = [[] for _ in streams]
    doubtful: set[int] = set()  # a frame fails its check: damage, or bytes within it that look like a header
    for at in range(0, len(work), FRAMES):
        some = work[at : at + FRAMES]
        raw = b"".join(streams[i][a:b] for i, a, b in some)
        data = np.frombuffer(raw, np.uint8)
        lengths = np.array([b - a for _, a, b in some], np.int64)
        starts = np.append(0, np.cumsum(lengths))[:-1]
        heads = [parse_header(streams[i], a, infos[i]) for i, a, _ in some]
        usual = np.array([h is not None and h[0] == BLOCK and h[1] == 0 and h[2] == 8 for h in heads])
        sums = crc16_many(data, starts, lengths - 2)
        stored = data[starts + lengths - 2].astype(np.uint16) << np.uint16(8) | data[starts + lengths - 1]
        whole = sums == stored
        x, odd = np.zeros((0, BLOCK), np.int32), np.zeros(0, bool)
        fast = np.flatnonzero(usual & whole)
        if len(fast):
            x, odd = _decode_side_by_side(data, starts[fast], np.array([heads[f][4] - some[f][1] for f in fast.tolist()], np.int64))
        row = dict(zip(fast.tolist(), range(len(fast)), strict=True))
        for f, (i, a, _) in enumerate(some):
            r = row.get(f)
            if not whole[f]:
                doubtful.add(i)
            elif r is None or odd[r]:
                parts[i].append(decode_frame(streams[i], a, infos[i])[0][0])
            else:
                parts[i].append(x[r])
    for i in doubtful:
        parts[i] = [decode_in_turn(streams[i], infos[i])]
    out = []
    for info, own in zip(infos, parts, strict=True):
        samples = np.concatenate(own) if own else np.zeros(0, np.int32)
        if info.samples and len(samples) != info.samples:
            raise Broken("number of samples")
        if info.bits == 8 and info.channels == 1 and any(info.md5) and hashlib.md5(samples.astype(np.int8).tobytes(), usedforsecurity=False).digest() != info.md5:
            raise Broken("stream MD5")
        out.append(samples)
    return out


def read_samples(data: bytes, start: int, count: int) -> np.ndarray:
    """Samples from `start` of a mono stream, entered at the nearest seek point before."""
    info = Info(data)
    near = max((p for p in info.points if p[0] <= start), default=(0, 0, 0))
    at, place, got = info.first + near[1], near[0], []
    while at < len(data) and place < start + count:
        x, at = decode_frame(data, at, info)
        got.append(x[0])
        place += x.shape[1]
    return np.concatenate(got)[start - near[0] :][:count] if got else np.zeros(0, np.int64)


# --- columns ---------------------------------------------------------------


def payload_of(text: str | None) -> bytes:
    """UTF-8 of a text (null: empty) with bytes 255 up to a positive multiple of BLOCK."""
    raw = (text or "").encode("utf-8", "replace")
    return raw + b"\xff" * (BLOCK - len(raw) % BLOCK if len(raw) % BLOCK or not raw else 0)


def _encode(texts: pd.Series) -> pd.Series:
    return pd.Series(encode_many([payload_of(t) for t in texts]), dtype=object)


def feature(samples: np.ndarray) -> str:
    """Whole numbers only, so that it is the same everywhere: peak, energy, sign changes and sum of steps."""
    x = samples.astype(np.int64)
    return f"peak={int(np.abs(x).max())};energy={int((x * x).sum())};crossings={int((np.signbit(x[1:]) != np.signbit(x[:-1])).sum())};steps={int(np.abs(np.diff(x)).sum())}"


def _samples(streams: list[bytes | None]) -> list[np.ndarray | str | None]:
    """Samples of each stream, None for a null one, or what is wrong with it; one damaged stream costs no other."""
    some = [s for s in streams if s is not None]
    try:
        found = iter(decode_many(some) if some else [])
        return [None if s is None else next(found) for s in streams]
    except (Broken, ValueError, IndexError, OverflowError):
        out: list[np.ndarray | str | None] = []
        for s in streams:
            try:
                out.append(None if s is None else decode_many([s])[0])
            except (Broken, ValueError, IndexError, OverflowError) as e:
                out.append(f"{type(e).__name__}: {e}")
        return out


def _digest(media: pd.Series) -> pd.DataFrame:
    rows = []
    streams = [None if m is None else bytes(m) for m in media]
    for at in range(0, len(streams), 512):
        some = streams[at : at + 512]
        for stream, samples in zip(some, _samples(some), strict=True):
            whole = [len(stream), hashlib.sha256(stream).hexdigest()] if stream is not None else [None, None]
            if samples is None or isinstance(samples, str):
                rows.append((None, None, None, *whole, None, samples))
                continue
            raw = (samples + 128).astype(np.uint8).tobytes()
            rows.append((len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-32:]), *whole, feature(samples), None))
    out = pd.DataFrame(rows, columns=["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "broken"])
    return out.astype({"payload_bytes": "Int64", "tail_crc32": "Int64", "media_bytes": "Int64"})


def to_flac(text: Column) -> Column:
    """A text's payload as a FLAC stream."""
    return F.pandas_udf(_encode, T.BinaryType())(text)


def digest(media: Column) -> Column:
    """What a FLAC stream holds, read back in full: a struct of sizes, sums and the feature.

    A null stream gives nulls. A damaged one is put in quarantine: its own size
    and hash stay, broken says what is wrong, and the rest is null.
    """
    kinds = [("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType()), ("broken", T.StringType())]
    return F.pandas_udf(_digest, T.StructType([T.StructField(*k) for k in kinds]))(media)


def pcm_blocks(df: DataFrame, key: str, media: str, samples: int = 16 * BLOCK) -> DataFrame:
    """A row for each block of PCM (signed 8-bit) of a column of FLAC streams: key, block, sample_offset, n_samples, pcm. A null stream has none, nor has a damaged one, which digest() names."""
    def cut(parts):
        for part in parts:
            rows = []
            for k, x in zip(part[key], _samples([None if m is None else bytes(m) for m in part[media]]), strict=True):
                if x is None or isinstance(x, str):
                    continue
                rows += [(k, i, at, len(x[at : at + samples]), x[at : at + samples].astype(np.int8).tobytes()) for i, at in enumerate(range(0, len(x), samples))]
            yield pd.DataFrame(rows, columns=[key, "block", "sample_offset", "n_samples", "pcm"])

    kinds = [df.schema[key], T.StructField("block", T.IntegerType()), T.StructField("sample_offset", T.LongType()), T.StructField("n_samples", T.LongType()), T.StructField("pcm", T.BinaryType())]
    return df.select(key, media).mapInPandas(cut, T.StructType(kinds))


def write_media(docs: DataFrame, path: str) -> None:
    """A media table under path: doc_id, n_bytes and media, the text's FLAC stream, of every row of docs (doc_id, text)."""
    n = F.octet_length(F.coalesce(F.col("text"), F.lit(""))).cast("long").alias("n_bytes")
    docs.select("doc_id", n, to_flac(F.col("text")).alias("media")).write.option("compression", "none").parquet(path)


def read_media(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, n_bytes and what the stored streams hold, read back."""
    kept = spark.read.schema("doc_id long, n_bytes long, media binary").parquet(path)
    return kept.select("doc_id", "n_bytes", digest(F.col("media")).alias("d")).select("doc_id", "n_bytes", "d.*")


#: The query stores its media in so many turns, which bounds the disk that they take at once.
TURNS = 4


def op3_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents, written as media and read back; repeated rows come as often as they are. An empty table gives no rows.
    A null text counts as empty, so its payload is one padded block. Very long texts are stored and read whole, frame by frame.

    The rows go by a hash of doc_id in TURNS turns. A turn's media are deleted
    once their digests are stored; write_media keeps them.
    """
    docs, out = table(spark, sf_dir, "documents"), None
    for turn in range(TURNS):
        path = fresh_path(spark, "media")
        write_media(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(TURNS)) == turn), path)
        done = stored(read_media(spark, path), "digests")
        delete_path(spark, path)
        out = done if out is None else out.union(done)
    return out
