"""FLAC media columns: lossless 8-bit mono streams, encoded and decoded many frames at a time.

Every stream has blocks of 192 samples and a seek table with a point for each frame, so a decoder
finds any sample without reading what comes before it, and the frames of many documents are
decoded together: step i reads the i-th Rice residual of every frame and adds the frame's linear
prediction. Both frame checksums and the stream's MD5 are verified on reading.

`decode_stream` reads one stream of any origin (any block size, stereo, 4 to 32 bits) bit by bit;
the frame-parallel path hands it whatever it doesn't know. Decoded samples go out in blocks of
known offsets (`pcm_blocks`, `write_pcm`), so that a seek reads the blocks it needs.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, create_shared, id_text, new_dir, open_shared, remove_shared, text_bytes

BLOCK = 192
PARTS = 4  # Rice partitions of a block
PRECISION = 10  # bits of an LPC coefficient
TAPS = 4
RATE = 8000
#: How the stream info begins to say the rate, one channel and 8 bits.
MONO = (RATE << 44 | 0 << 41 | 7 << 36).to_bytes(8, "big")[:3]
TOP_K = 12
STEP = 8192  # frames worked on at a time
POINTS = 900_000  # of one seek table block
CHUNK_BYTES = 1_500_000

FIXED = np.array([[0, 0, 0, 0], [1, 0, 0, 0], [2, -1, 0, 0], [3, -3, 1, 0], [4, -6, 4, -1]], np.int64)


def _crc_table(poly: int, bits: int) -> np.ndarray:
    top, mask = 1 << (bits - 1), (1 << bits) - 1
    out = []
    for byte in range(256):
        c = byte << (bits - 8)
        for _ in range(8):
            c = (c << 1 ^ poly) & mask if c & top else c << 1 & mask
        out.append(c)
    return np.array(out, np.uint16)


CRC8 = _crc_table(0x07, 8)
CRC16 = _crc_table(0x8005, 16)
_all = np.arange(65536, dtype=np.uint32)
#: The state after two more zero bytes, so that a state is folded with 16 bits of input at once.
CRC16_PAIR = CRC16[(CRC16[_all >> 8] ^ (_all << 8)).astype(np.uint16) >> 8] ^ ((CRC16[_all >> 8] ^ (_all << 8)).astype(np.uint16) << 8).astype(np.uint16)
del _all


def crc16(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The CRC-16 of each slice. Leading zero bytes leave a zero state as it is, so slices are right-aligned."""
    wide = int(length.max(initial=0) + 1) // 2 * 2
    at = start + length - wide
    held = np.concatenate([np.zeros(wide, np.uint8), data])
    crc = np.zeros(len(start), np.uint16)
    skip = wide - length
    for i in range(0, wide, 2):
        a = np.where(i >= skip, held[at + (i + wide)], 0).astype(np.uint16)
        b = np.where(i + 1 >= skip, held[at + (i + 1 + wide)], 0).astype(np.uint16)
        crc = CRC16_PAIR[crc ^ (a << 8 | b)]
    return crc


def crc8(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    crc = np.zeros(len(start), np.uint16)
    for i in range(int(length.max(initial=0))):
        crc = np.where(i < length, CRC8[crc ^ data[start + np.minimum(i, length - 1)]], crc)
    return crc


def _numbers(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame numbers in FLAC's extended UTF-8: a matrix of bytes and their count."""
    size = np.ones(len(n), np.int64)
    for bits in (7, 11, 16, 21, 26, 31):
        size += n >= 1 << bits
    out = np.zeros((len(n), 7), np.uint8)
    lead = np.array([0, 0, 0xC0, 0xE0, 0xF0, 0xF8, 0xFC, 0xFE])
    for i in range(7):
        shift = np.maximum(6 * (size - 1 - i), 0)
        part = n >> shift
        out[:, i] = np.where(i >= size, 0, np.where(i == 0, np.where(size == 1, n, lead[size] | part), 0x80 | (part & 0x3F))) & 0xFF
    return out, size


def _lpc(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantised coefficients (frames, TAPS) and shifts by Levinson-Durbin over all frames at once."""
    f = x.astype(np.float64)
    r = np.stack([(f[:, lag:] * f[:, : BLOCK - lag]).sum(1) for lag in range(TAPS + 1)], 1)
    r[:, 0] = r[:, 0] * 1.0001 + 1e-9
    a = np.zeros((len(x), TAPS))
    err = r[:, 0].copy()
    for i in range(TAPS):
        k = (r[:, i + 1] - (a[:, :i] * r[:, i:0:-1]).sum(1)) / err
        before = a[:, :i].copy()
        a[:, :i] = before - k[:, None] * before[:, ::-1]
        a[:, i] = k
        err *= np.maximum(1 - k * k, 1e-9)
    most = np.abs(a).max(1)
    shift = np.clip(PRECISION - 1 - np.ceil(np.log2(np.maximum(most, 1e-6) * 1.01)), 0, 14).astype(np.int64)
    limit = (1 << (PRECISION - 1)) - 1
    return np.clip(np.rint(a * (1 << shift)[:, None]), -limit, limit).astype(np.int64), shift


def encode_frames(x: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The frames of samples x (frames, BLOCK) one after the other, and the length of each."""
    n = len(x)
    x = x.astype(np.int32)
    # the predictor of least absolute residual: a fixed polynomial, or LPC
    best = np.abs(x).sum(1)
    order = np.zeros(n, np.int64)
    res = x.copy()
    d = x
    for o in range(1, 5):
        d = np.diff(d, axis=1)
        cost = np.abs(d).sum(1) + 12 * o
        better = cost < best
        best = np.where(better, cost, best)
        order = np.where(better, o, order)
        res[better, o:] = d[better]
    coef, shift = _lpc(x)
    p = np.zeros((n, BLOCK - TAPS), np.int64)
    for j in range(TAPS):
        p += coef[:, j : j + 1] * x[:, TAPS - 1 - j : BLOCK - 1 - j]
    d = x[:, TAPS:] - (p >> shift[:, None]).astype(np.int32)
    lpc = np.abs(d).sum(1) + 12 * TAPS + 60 < best
    order = np.where(lpc, TAPS, order)
    res[lpc, TAPS:] = d[lpc]
    column = np.arange(BLOCK)
    warm = column[None, :] < order[:, None]
    z = np.where(warm, 0, res << 1 ^ res >> 31).astype(np.int32)
    parts = z.reshape(n, PARTS, BLOCK // PARTS)
    count = np.full((n, PARTS), BLOCK // PARTS)
    count[:, 0] -= order
    costs = np.stack([(parts >> k).sum(2) + count * (k + 1) for k in range(TOP_K)])
    k = costs.argmin(0)
    bits = 8 + 8 * order + np.where(lpc, 9 + PRECISION * TAPS, 0) + 6 + 4 * PARTS + costs.min(0).sum(1)
    constant = (x == x[:, :1]).all(1)
    verbatim = ~constant & (bits >= 8 + 8 * BLOCK)
    coded = ~constant & ~verbatim
    body = np.where(constant, 2, np.where(verbatim, 1 + BLOCK, (bits + 7) // 8))
    number, size = _numbers(numbers)
    head = 5 + size
    length = head + body + 2
    start = np.concatenate([[0], np.cumsum(length)])
    total = int(start[-1])
    start = start[:-1]
    out = np.zeros(total + 8, np.uint8)
    for i, byte in enumerate((0xFF, 0xF8, 0x14, 0x02)):  # sync, fixed blocks; 192 samples at 8 kHz; mono of 8 bits
        out[start + i] = byte
    for i in range(7):
        has = i < size
        out[start[has] + 4 + i] = number[has, i]
    out[start + 4 + size] = crc8(out, start, 4 + size)
    at = start + head
    sample = (x & 0xFF).astype(np.uint8)
    out[at[constant] + 1] = sample[constant, 0]
    out[at[verbatim]] = 0b00000010
    out[at[verbatim, None] + 1 + column] = sample[verbatim]
    # coded frames: every field is a value of at most 16 bits at a bit position
    g = np.flatnonzero(coded)
    if len(g):
        o, kk, zz, w, is_lpc = order[g], k[g], z[g], warm[g], lpc[g]
        each = np.repeat(kk, BLOCK // PARTS, axis=1)
        q = zz >> each
        long = np.where(w, 8, q + 1 + each)
        pre = np.zeros((len(g), BLOCK), np.int64)
        pre[:, BLOCK // PARTS :: BLOCK // PARTS] = 4
        own = np.where(is_lpc, 9 + PRECISION * TAPS, 0)
        pre[np.arange(len(g)), o] = own + 10
        end = 8 + np.cumsum(long + pre, axis=1)
        code = end - np.where(w, 8, 1 + each)
        base = at[g] * 8
        value = np.where(w, x[g] & 0xFF, 1 << each | zz & ((1 << each) - 1))
        width = np.where(w, 8, 1 + each)
        fields = [(value.ravel(), width.ravel(), (code + base[:, None]).ravel())]
        kind = np.where(is_lpc, 0b100000 | TAPS - 1, 0b001000 | o) << 1
        fields.append((kind, np.full(len(g), 8), base))
        first = (end - long)[np.arange(len(g)), o] + base  # where the first residual starts
        fields.append((np.full(len(g), PARTS.bit_length() - 1), np.full(len(g), 6), first - 10))
        fields.append((kk[:, 0], np.full(len(g), 4), first - 4))
        for part in range(1, PARTS):
            c = part * BLOCK // PARTS
            fields.append((kk[:, part], np.full(len(g), 4), (end - long)[:, c] + base - 4))
        h = np.flatnonzero(is_lpc)
        if len(h):
            at_lpc = first[h] - 10 - 9 - PRECISION * TAPS
            fields.append((np.full(len(h), PRECISION - 1), np.full(len(h), 4), at_lpc))
            fields.append((shift[g][h], np.full(len(h), 5), at_lpc + 4))
            for j in range(TAPS):
                fields.append((coef[g][h, j] & ((1 << PRECISION) - 1), np.full(len(h), PRECISION), at_lpc + 9 + PRECISION * j))
        value, width, pos = (np.concatenate([np.asarray(f[i], np.int64) for f in fields]) for i in range(3))
        word = value << (24 - (pos & 7) - width)
        byte = pos >> 3
        # fields never share a bit, so adding them up joins them
        sums = np.zeros(total + 8)
        for i, s in enumerate((16, 8, 0)):
            part = word >> s & 0xFF
            sums += np.bincount(byte + i, part, total + 8)
        out += sums.astype(np.uint8)
    crc = crc16(out, start, length - 2)
    out[start + length - 2] = crc >> 8
    out[start + length - 1] = crc & 0xFF
    return out[:total], length


def encode_payloads(payload: np.ndarray, frames: np.ndarray) -> list[bytes]:
    """A FLAC stream for each document; payload holds their bytes, frames their counts of blocks."""
    x = (payload ^ 0x80).view(np.int8).reshape(-1, BLOCK)
    first = np.concatenate([[0], np.cumsum(frames)])
    number = np.arange(len(x)) - np.repeat(first[:-1], frames)
    data, length = [], []
    for i in range(0, len(x), STEP):
        d, n = encode_frames(x[i : i + STEP], number[i : i + STEP])
        data.append(d)
        length.append(n)
    data, length = np.concatenate(data), np.concatenate(length)
    at = np.concatenate([[0], np.cumsum(length)])
    out = []
    for i, n in enumerate(frames.tolist()):
        a, b = first[i], first[i + 1]
        own = length[a:b]
        info = struct.pack(">HH", BLOCK, BLOCK) + int(own.min()).to_bytes(3, "big") + int(own.max()).to_bytes(3, "big")
        info += (RATE << 44 | 0 << 41 | 7 << 36 | n * BLOCK).to_bytes(8, "big") + hashlib.md5(x[a:b].tobytes()).digest()
        parts = [b"fLaC", b"\x00\x00\x00\x22", info]
        for s in range(0, n, POINTS):
            m = min(POINTS, n - s)
            points = np.zeros(m, np.dtype([("sample", ">u8"), ("byte", ">u8"), ("n", ">u2")]))
            points["sample"] = np.arange(s, s + m) * BLOCK
            points["byte"] = at[a + s : a + s + m] - at[a]
            points["n"] = BLOCK
            parts += [bytes([3 | (0x80 if s + m == n else 0)]), (18 * m).to_bytes(3, "big"), points.tobytes()]
        out.append(b"".join([*parts, data[at[a] : at[b]].tobytes()]))
    return out


class _Other(Exception):
    """A stream that the frame-parallel path doesn't know."""


def parse(media: bytes) -> tuple[bytes, np.ndarray, int]:
    """The stream info, the sample and byte offsets of the seek points, and where frames begin."""
    if media[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, info, points = 4, b"", []
    while True:
        kind, size = media[at], int.from_bytes(media[at + 1 : at + 4], "big")
        body = media[at + 4 : at + 4 + size]
        if kind & 0x7F == 0:
            info = body
        elif kind & 0x7F == 3:
            points.append(np.frombuffer(body, np.dtype([("sample", ">u8"), ("byte", ">u8"), ("n", ">u2")])))
        at += 4 + size
        if kind & 0x80:
            break
    if len(info) != 34:
        raise ValueError("no stream info")
    return info, np.concatenate(points) if points else np.zeros(0, np.dtype([("sample", ">u8"), ("byte", ">u8"), ("n", ">u2")])), at


def decode_frames(data: np.ndarray, start: np.ndarray, length: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Samples (frames, BLOCK) of 8-bit mono frames at the given places; checksums are verified."""
    n = len(start)
    data = np.concatenate([data, np.zeros(16, np.uint8)])
    if (length < 9).any() or (data[start] != 0xFF).any() or (data[start + 1] != 0xF8).any() or (data[start + 2] != 0x14).any() or (data[start + 3] != 0x02).any():
        raise _Other
    expected, size = _numbers(number)
    for i in range(7):
        has = i < size
        if (data[start[has] + 4 + i] != expected[has, i]).any():
            raise _Other
    if (crc8(data, start, 4 + size) != data[start + 4 + size]).any():
        raise ValueError("a frame header's checksum is wrong")
    tail = start + length - 2
    if (crc16(data, start, length - 2) != (data[tail].astype(np.uint16) << 8 | data[tail + 1])).any():
        raise ValueError("a frame's checksum is wrong")
    at = start + 5 + size
    kind = data[at] >> 1
    if (data[at] & 0x81).any():
        raise _Other
    out = np.zeros((n, BLOCK), np.int32)
    column = np.arange(BLOCK)
    constant, verbatim = kind == 0, kind == 1
    out[constant] = data[at[constant] + 1].view(np.int8)[:, None]
    out[verbatim] = data[at[verbatim, None] + 1 + column].view(np.int8)
    g = np.flatnonzero(~constant & ~verbatim)
    if not len(g):
        return out
    kind, at = kind[g].astype(np.int64), at[g]
    lpc, fixed = kind >= 32, (kind >= 8) & (kind <= 12)
    order = np.where(lpc, kind - 31, kind - 8)
    if not (lpc | fixed).all() or (order > TAPS).any():
        raise _Other
    words = np.zeros(len(data) - 8, np.uint64)  # the eight bytes from each place on
    for i in range(8):
        words |= data[i : i + len(words)].astype(np.uint64) << np.uint64(56 - 8 * i)

    def peek(pos: np.ndarray) -> np.ndarray:
        return words[pos >> 3] << (pos & 7).astype(np.uint64)

    def take(pos: np.ndarray, width: int) -> np.ndarray:
        return (peek(pos) >> np.uint64(64 - width)).astype(np.int64)

    m = len(g)
    pos = at * 8 + 8
    got = np.zeros((BLOCK, m), np.int64)
    for i in range(TAPS):
        v = take(pos, 8)
        has = i < order
        got[i] = np.where(has, v - (v >> 7 << 8), 0)
        pos = pos + np.where(has, 8, 0)
    coef, shift = FIXED[np.minimum(order, 4)].copy(), np.zeros(m, np.int64)
    h = np.flatnonzero(lpc)
    if len(h):
        p = pos[h]
        width = take(p, 4) + 1
        if (width != PRECISION).any():
            raise _Other
        shift[h] = take(p + 4, 5)
        coef[h] = 0
        for j in range(TAPS):
            has = j < order[h]
            v = take(p + 9 + PRECISION * j, PRECISION)
            coef[h, j] = np.where(has, v - (v >> (PRECISION - 1) << PRECISION), 0)
        pos[h] = p + 9 + PRECISION * order[h]
    if (take(pos, 2) != 0).any() or (take(pos, 6) & 15 != PARTS.bit_length() - 1).any():
        raise _Other
    pos = pos + 6
    k = take(pos, 4)
    pos = pos + 4
    c = [np.ascontiguousarray(coef[:, j]) for j in range(TAPS)]
    far = order.max()
    one, top = np.uint64(1), np.uint64(63)
    for i in range(BLOCK):
        if i and i % (BLOCK // PARTS) == 0:
            k = take(pos, 4)
            pos = pos + 4
        if (k == 15).any():
            raise _Other
        w = peek(pos)
        lead = (w >> np.uint64(32)).astype(np.float64)
        q = 31 - ((lead.view(np.int64) >> 52) - 1023)
        q = np.where(lead == 0, 32, q)
        rest = pos + q + 1
        late = np.flatnonzero(lead == 0)
        for j in late[(i >= order[late])] if len(late) else ():  # a long run of zeros
            u = int(pos[j]) + 32
            while not data[u >> 3] >> (7 - (u & 7)) & 1:
                u += 1
            q[j] = u - pos[j]
            rest[j] = u + 1
        w = peek(rest)
        low = (w >> one >> (top - k.astype(np.uint64))).astype(np.int64)
        z = q << k | low
        r = z >> 1 ^ -(z & 1)
        pred = np.zeros(m, np.int64)
        for j in range(min(i, far)):
            pred += c[j] * got[i - 1 - j]
        value = r + (pred >> shift)
        if i < far:
            warm = i < order
            got[i] = np.where(warm, got[i], value)
            pos = np.where(warm, pos, rest + k)
        else:
            got[i] = value
            pos = rest + k
    out[g] = got.T
    return out


def _together(media: list[bytes]) -> list[bytes]:
    """The samples of streams such as `encode_payloads` makes, all frames decoded together."""
    data, start, length, number, frames = [], [], [], [], []
    at = 0
    infos = []
    for m in media:
        info, points, begin = parse(m)
        total = int.from_bytes(info[10:18], "big") & ((1 << 36) - 1)
        n = len(points)
        if info[:4] != struct.pack(">HH", BLOCK, BLOCK) or info[10:13] != MONO or not n or total != n * BLOCK or (points["sample"] != np.arange(n, dtype=np.uint64) * BLOCK).any():
            raise _Other
        offsets = points["byte"].astype(np.int64)
        if (np.diff(offsets) <= 0).any() or offsets[-1] >= len(m) - begin:
            raise _Other
        start.append(offsets + begin + at)
        length.append(np.diff(np.append(offsets, len(m) - begin)))
        number.append(np.arange(n))
        frames.append(n)
        infos.append(info)
        data.append(np.frombuffer(m, np.uint8))
        at += len(m)
    data, start, length, number = map(np.concatenate, (data, start, length, number))
    x = np.zeros((len(start), BLOCK), np.int8)
    for i in range(0, len(start), STEP):
        s, e = start[i : i + STEP], length[i : i + STEP]
        a, b = int(s[0]), int(s[-1] + e[-1])
        x[i : i + STEP] = decode_frames(data[a:b], s - a, e, number[i : i + STEP])
    out, first = [], 0
    for info, n in zip(infos, frames, strict=True):
        own = x[first : first + n].tobytes()
        _verify(info, own)
        out.append((np.frombuffer(own, np.uint8) ^ 0x80).tobytes())
        first += n
    return out


def _verify(info: bytes, samples: bytes) -> None:
    """The stream's MD5, where it has one; it covers interleaved signed samples, low byte first."""
    if info[18:34] != bytes(16) and hashlib.md5(samples).digest() != info[18:34]:
        raise ValueError("the stream's MD5 is wrong")


def _alone(media: bytes) -> tuple[bytes, int, int]:
    """A stream of any origin: its samples, channels and bytes a sample."""
    own, channels = decode_stream(media)
    width = -(-own["depth"] // 8)
    x = np.stack(channels, 1)
    raw = x.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()
    _verify(parse(media)[0], raw)
    if own["samples"] and own["samples"] != len(x):
        raise ValueError(f"{len(x)} samples where the stream names {own['samples']}")
    return (np.frombuffer(raw, np.uint8) ^ 0x80).tobytes() if width == 1 else raw, own["channels"], width


def decoded(media: list[bytes]) -> list[tuple[bytes, int, int]]:
    """Samples, channels and bytes a sample of each stream, checksums and MD5 verified.

    Samples are interleaved, low byte first; those of up to 8 bits are unsigned (silence at 128),
    wider ones signed, as in WAV files. Streams of other origin are found by halving the list, so
    that only they go to the bit reader.
    """
    try:
        return [(p, 1, 1) for p in _together(media)] if media else []
    except _Other:
        if len(media) == 1:
            return [_alone(media[0])]
        half = len(media) // 2
        return decoded(media[:half]) + decoded(media[half:])


def decode_media(media: list[bytes]) -> list[bytes]:
    """The samples alone that `decoded` gives."""
    return [p for p, _, _ in decoded(media)]


def seek(media: bytes, sample: int, count: int) -> bytes:
    """`count` samples from `sample` on, decoding only the frames that hold them."""
    info, points, begin = parse(media)
    a, b = sample // BLOCK, min(-(-(sample + count) // BLOCK), len(points))
    if a >= b:
        return b""
    offsets = np.append(points["byte"].astype(np.int64), len(media) - begin)
    x = decode_frames(np.frombuffer(media, np.uint8)[begin:], offsets[a:b], np.diff(offsets)[a:b], np.arange(a, b))
    return ((x.astype(np.int8).view(np.uint8) ^ 0x80).tobytes())[sample - a * BLOCK :][:count]


class _Bits:
    def __init__(self, data: bytes, at: int):
        self.data, self.pos = data, at * 8

    def take(self, n: int) -> int:
        a, b = self.pos >> 3, (self.pos + n + 7) >> 3
        v = int.from_bytes(self.data[a:b], "big") >> (b * 8 - self.pos - n) & ((1 << n) - 1)
        self.pos += n
        return v

    def signed(self, n: int) -> int:
        v = self.take(n)
        return v - (1 << n) if n and v >> (n - 1) else v

    def zeros(self) -> int:
        n = 0
        while not self.take(1):
            n += 1
        return n


def _subframe(bits: _Bits, n: int, depth: int) -> list[int]:
    bits.take(1)
    kind, wasted = bits.take(6), 0
    if bits.take(1):
        wasted = bits.zeros() + 1
        depth -= wasted
    if kind == 0:
        x = [bits.signed(depth)] * n
    elif kind == 1:
        x = [bits.signed(depth) for _ in range(n)]
    else:
        order = kind - 31 if kind >= 32 else kind - 8
        x = [bits.signed(depth) for _ in range(order)]
        shift = 0
        if kind >= 32:
            precision = bits.take(4) + 1
            shift = bits.signed(5)
            coef = [bits.signed(precision) for _ in range(order)]
        else:
            coef = FIXED[order].tolist()[:order]
        wide = 5 if bits.take(2) else 4
        parts = 1 << bits.take(4)
        for p in range(parts):
            k = bits.take(wide)
            raw = bits.take(5) if k == (1 << wide) - 1 else None
            for _ in range(n // parts - (order if p == 0 else 0)):
                if raw is None:
                    z = bits.zeros() << k
                    z |= bits.take(k)
                    r = z >> 1 ^ -(z & 1)
                else:
                    r = bits.signed(raw)
                x.append(r + (sum(c * v for c, v in zip(coef, x[: -order - 1 : -1], strict=True)) >> shift if order else 0))
    return [v << wasted for v in x]


def decode_stream(media: bytes) -> tuple[dict, list[np.ndarray]]:
    """Any FLAC stream: its info and an int64 array for each channel."""
    info, _, at = parse(media)
    word = int.from_bytes(info[10:18], "big")
    own = {"rate": word >> 44, "channels": (word >> 41 & 7) + 1, "depth": (word >> 36 & 31) + 1, "samples": word & ((1 << 36) - 1)}
    out: list[list[int]] = [[] for _ in range(own["channels"])]
    while at < len(media):
        bits = _Bits(media, at)
        if bits.take(15) != 0b111111111111100:
            raise ValueError("no frame where one should begin")
        bits.take(1)
        size, rate, layout, depth = bits.take(4), bits.take(4), bits.take(4), bits.take(3)
        bits.take(1)
        lead = bits.take(8)
        if lead & 0x80:  # as many more bytes as it has leading ones, less one
            bits.take(8 * (7 - (~lead & 0xFF).bit_length()))
        if size in (6, 7):
            n = bits.take(8 if size == 6 else 16) + 1
        else:
            n = 192 if size == 1 else 576 << (size - 2) if size < 6 else 256 << (size - 8)
        if rate in (12, 13, 14):
            bits.take(8 if rate == 12 else 16)
        data = np.frombuffer(media, np.uint8)
        one = np.array([at])
        if crc8(data, one, np.array([(bits.pos >> 3) - at]))[0] != bits.take(8):
            raise ValueError("a frame header's checksum is wrong")
        depth = {0: own["depth"], 1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}[depth]
        wide = [layout in (9,), layout in (8, 10)]  # the side channel has one bit more
        channels = [_subframe(bits, n, depth + (wide[c] if layout >= 8 else 0)) for c in range(2 if layout >= 8 else layout + 1)]
        if layout == 8:
            channels[1] = [a - b for a, b in zip(*channels, strict=True)]
        elif layout == 9:
            channels[0] = [a + b for a, b in zip(*channels, strict=True)]
        elif layout == 10:
            both = [((m << 1 | s & 1) + s >> 1, (m << 1 | s & 1) - s >> 1) for m, s in zip(*channels, strict=True)]
            channels = [[p[0] for p in both], [p[1] for p in both]]
        for c, x in zip(out, channels, strict=True):
            c += x
        bits.pos = -(-bits.pos // 8) * 8
        if crc16(data, one, np.array([(bits.pos >> 3) - at]))[0] != bits.take(16):
            raise ValueError("a frame's checksum is wrong")
        at = bits.pos >> 3
    return own, [np.array(c, np.int64) for c in out]


def payloads(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts' bytes, each padded with spaces to a positive multiple of BLOCK; sizes and block counts."""
    offsets, data = text_bytes(column)
    sizes = np.diff(offsets)
    frames = np.maximum(-(-sizes // BLOCK), 1)
    at = np.concatenate([[0], np.cumsum(frames)]) * BLOCK
    out = np.full(int(at[-1]), 32, np.uint8)
    for a, i, n in zip(at.tolist(), offsets.tolist(), sizes.tolist(), strict=False):
        out[a : a + n] = data[i : i + n]
    return out, sizes, frames


def encode(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: every whole text as a FLAC stream.

    A null or empty text is 192 spaces; repeated rows repeat; a null doc_id stays null; an empty
    table gives no rows; other columns of docs are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, CHUNK_BYTES):
            payload, sizes, frames = payloads(batch.column("text"))
            media = encode_payloads(payload, frames)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return id_text(docs).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def stored(docs: DataFrame, path: str) -> DataFrame:
    """What `encode` gives, written as a table below path and read back."""
    encode(docs).write.option("compression", "none").parquet(path)
    return docs.sparkSession.read.parquet(path)


BLOCKS = "doc_id long, sample_offset long, n_samples long, channels int, sample_bytes int, pcm binary"


def pcm_blocks(media: DataFrame, samples: int = 1 << 16) -> DataFrame:
    """doc_id, sample_offset, n_samples, channels, sample_bytes, pcm: blocks of at most `samples` samples.

    A block's offset is a multiple of `samples` and counts samples of one channel, so the block
    that holds a sample is known without reading others. Rows without media, and streams without
    samples, give no block; repeated rows give theirs again; an empty table gives none; other
    columns are not read. A damaged stream fails the job.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, CHUNK_BYTES, "media"):
            ids = batch.column("doc_id").to_pylist()
            rows = [
                (i, at // (c * w), min(samples, (len(pcm) - at) // (c * w)), c, w, pcm[at : at + samples * c * w])
                for i, (pcm, c, w) in zip(ids, decoded(batch.column("media").to_pylist()), strict=True)
                for at in range(0, len(pcm), samples * c * w)
            ]
            if rows:
                columns = zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], [x.split()[0] for x in BLOCKS.split(", ")])

    return media.select(F.col("doc_id").cast("long").alias("doc_id"), "media").filter("media is not null").mapInArrow(run, BLOCKS)


def write_pcm(media: DataFrame, path: str, samples: int = 1 << 16) -> DataFrame:
    """`pcm_blocks` as a table below path, read back; files are sorted, so that a seek prunes row groups.

    Rows are those of `pcm_blocks`: none for nulls and empty streams, repeated ones again.
    """
    pcm_blocks(media, samples).sortWithinPartitions("doc_id", "sample_offset").write.option("compression", "zstd").parquet(path)
    return media.sparkSession.read.parquet(path)


def seek_pcm(blocks: DataFrame, doc_id: int, sample: int, count: int) -> DataFrame:
    """The blocks of one document that hold `count` samples from `sample` on; the filters reach the scan.

    Blocks without a doc_id are nobody's; repeated ones all come; beyond the end there are none.
    """
    return blocks.filter((F.col("doc_id") == doc_id) & (F.col("sample_offset") < sample + count) & (F.col("sample_offset") + F.col("n_samples") > sample))


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


#: Samples of a PCM block in the file that a task writes and seeks in.
PCM_SAMPLES = 1 << 16


def _described(blocks: Iterator[bytes]) -> tuple[int, str, int, str]:
    """Bytes, digest, checksum of the last 16 bytes and signal features of a stream of 8-bit samples, block by block."""
    n = peak = energy = changes = 0
    digest, tail, last = hashlib.sha256(), b"", None
    for block in blocks:
        x = (np.frombuffer(block, np.uint8) ^ 0x80).view(np.int8).astype(np.int32)
        digest.update(block)
        tail = (tail + block)[-16:]
        n += len(x)
        peak = max(peak, int(np.abs(x).max(initial=0)))
        energy += int((x.astype(np.int64) ** 2).sum())
        changes += int(np.count_nonzero(np.diff(x))) + int(last is not None and len(x) > 0 and x[0] != last)
        last = x[-1] if len(x) else last
    return n, digest.hexdigest(), zlib.crc32(tail), f"samples={n};peak={peak};energy={energy};changes={changes}"


def _sought(uri: str, streams: list[bytes], samples: int) -> Iterator[Iterator[bytes]]:
    """The blocks of each stream, read back by their places from a file of PCM blocks that is deleted then."""
    index: list[list[tuple[int, int]]] = []
    with create_shared(uri) as file:
        at = 0
        for pcm in streams:
            own = []
            for offset in range(0, len(pcm), samples):  # block i of a stream begins at sample i * samples
                own.append((at, min(samples, len(pcm) - offset)))
                file.write(pcm[offset : offset + samples])
                at += own[-1][1]
            index.append(own)
    try:
        with open_shared(uri, "rb") as file:

            def read(places: list[tuple[int, int]]) -> Iterator[bytes]:
                for at, n in places:
                    file.seek(at)
                    yield bytes(file.read(n))

            for places in index:
                yield read(places)
    finally:
        remove_shared(uri)


def _features(ids: pa.Array, n_bytes: pa.Array, media: list[bytes], uri: str | None = None) -> pa.RecordBatch:
    """Features of decoded streams, by way of a file of PCM blocks if uri names one."""
    streams = list(decode_media(media))
    blocks = _sought(uri, streams, PCM_SAMPLES) if uri else ((p[i : i + PCM_SAMPLES] for i in range(0, len(p), PCM_SAMPLES)) for p in streams)
    rows = []
    for m, own in zip(media, blocks, strict=True):
        n, digest, tail, says = _described(own)
        rows.append((n, digest, tail, len(m), hashlib.sha256(m).hexdigest(), says))
    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)]
    return pa.RecordBatch.from_arrays([ids, n_bytes, *columns], [x.split()[0] for x in FEATURES.split(", ")])


def features(media: DataFrame) -> DataFrame:
    """Digests of what stored 8-bit mono streams hold, and simple signal features, of every row with media.

    Rows without media give no row; repeated rows give theirs again; an empty table gives none;
    other columns are not read. A damaged stream fails the job.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, CHUNK_BYTES, "media"):
            yield _features(batch.column("doc_id"), batch.column("n_bytes"), batch.column("media").to_pylist())

    return media.select("doc_id", "n_bytes", "media").filter("media is not null").mapInArrow(run, FEATURES)


def round_trip(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """The `features` of every text, by way of files of the shared folder.

    A task writes its streams to a file of its own and reads them back from there; what they decode
    to goes to a second file, in PCM blocks whose places follow from their sample offsets, and the
    features are taken from blocks sought there. Both are deleted, the second after every batch, so
    the disk holds no more than the tasks at work need; `stored` keeps the streams. A null or
    empty text is 192 spaces; repeated rows repeat; a null doc_id stays null; an empty table gives
    no rows; other columns of docs are not read.
    """
    folder = folder or new_dir(docs.sparkSession, "flac")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri, file, index = f"{folder}/streams-{uuid.uuid4().hex}.bin", None, []
        for batch in chunks(batches, CHUNK_BYTES):
            file = file or create_shared(uri)
            payload, sizes, frames = payloads(batch.column("text"))
            media = encode_payloads(payload, frames)
            index.append((batch.column("doc_id"), pa.array(sizes, pa.int64()), np.fromiter(map(len, media), np.int64, len(media))))
            file.write(b"".join(media))
        if not file:
            return
        file.close()
        try:
            with open_shared(uri, "rb") as file:
                for ids, sizes, lengths in index:
                    raw, end = bytes(file.read(int(lengths.sum()))), np.cumsum(lengths)
                    yield _features(ids, sizes, [raw[a:b] for a, b in zip((end - lengths).tolist(), end.tolist(), strict=True)], f"{uri}.pcm")
        finally:
            remove_shared(uri)

    return id_text(docs).mapInArrow(run, FEATURES)


def op1(spark, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))
