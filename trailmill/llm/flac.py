"""Media columns as FLAC: linear prediction, Rice residuals, frame checksums, seekable PCM blocks.

A payload is stored as mono 8-bit samples (byte minus 128) in frames of 4608
samples. Every frame takes the cheapest of a constant, fixed predictors of order
0 to 2, a quantised second-order linear predictor and plain samples. A seek
table in the stream holds each frame's first sample and byte offset, so a block
is decoded without those before it.

Python walks over frames only; samples are worked on by numpy, one sample of all
frames of a slice at a time, so the cost for a sample does not grow with the
length of a text. Documents are independent: there is no shuffle. The stored
streams are decoded into a table of PCM blocks, a frame each with its sample
offset; the query's columns are computed from these blocks as they pass, in the
order of their documents and offsets, so no step but the encoder holds a whole
text. seek() gives the blocks of a range of samples without decoding the others.

Edge cases: a null or empty text is padded to 576 bytes of 255; a null doc_id
stays null; equal texts give equal bytes; clashing extra columns are cut first.
A damaged frame raises FlacError, both for checksums and for the MD5.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, slices, stage

UNIT = 576
BLOCK = 8 * UNIT
RATE = 8000
#: Coefficients of the fixed predictors, newest sample first. Fixed values of the format.
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))
#: Bits for a linear predictor's coefficient, and its shift.
PRECISION, SHIFT = 9, 6
MAX_ORDER = 4


class FlacError(ValueError):
    """A stream that is damaged or uses what this codec lacks."""


def _crc_table(poly: int, bits: int) -> np.ndarray:
    top, mask = 1 << (bits - 1), (1 << bits) - 1
    out = []
    for byte in range(256):
        c = byte << (bits - 8)
        for _ in range(8):
            c = ((c << 1) ^ poly if c & top else c << 1) & mask
        out.append(c)
    return np.array(out, np.uint16 if bits == 16 else np.uint8)


CRC8, CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)
_CRC8 = CRC8.tolist()
#: Leading zeros of a 16-bit number.
LEADING = np.array([16 - int(x).bit_length() for x in range(1 << 16)], np.int64)


def crc8(b: bytes) -> int:
    c = 0
    for x in b:
        c = _CRC8[c ^ x]
    return c


def crc16_many(buffer: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-16 of many byte ranges, a byte of each at a time."""
    order = np.argsort(-lengths, kind="stable")
    at, left = starts[order], lengths[order]
    crc = np.zeros(len(order), np.uint16)
    alive = len(order) - np.searchsorted(left[::-1], np.arange(1, (int(left[0]) if len(left) else 0) + 1), side="left")
    for i, n in enumerate(alive):
        c = crc[:n]
        crc[:n] = (c << np.uint16(8)) ^ CRC16[(c >> np.uint16(8)) ^ buffer[at[:n] + i]]
    out = np.empty_like(crc)
    out[order] = crc
    return out


def _utf8_number(n: int) -> bytes:
    """The frame number in the format's extended UTF-8."""
    if n < 0x80:
        return bytes([n])
    length = next(k for k in range(2, 8) if n < 1 << 5 * k + 1)
    tail = [0x80 | n >> 6 * j & 0x3F for j in range(length - 2, -1, -1)]
    return bytes([0xFF00 >> length & 0xFF | n >> 6 * (length - 1), *tail])


def _zigzag(r: np.ndarray) -> np.ndarray:
    return (r << 1) ^ (r >> 31)


def _plans(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list]:
    """For frames of one size (rows): kind of predictor, Rice parameter, bits of the residual, coefficients, residuals by kind."""
    n, size = x.shape
    c1, c2 = _fit(x)
    residuals = [x, x[:, 1:] - x[:, :-1]]
    residuals.append(residuals[1][:, 1:] - residuals[1][:, :-1])
    residuals.append(x[:, 2:] - ((c1[:, None] * x[:, 1:-1] + c2[:, None] * x[:, :-2]) >> SHIFT))
    bits, params, codes = [], [], []
    for kind, r in enumerate(residuals):
        u = _zigzag(r)
        mean = u.mean(axis=1)
        k = np.clip(np.floor(np.log2(np.maximum(mean * 0.7, 1))), 0, 14).astype(np.int64)
        bits.append((u >> k[:, None]).sum(axis=1) + u.shape[1] * (k + 1) + (0, 8, 16, 16 + 9 + 2 * PRECISION)[kind])
        params.append(k)
        codes.append(u)
    table = np.stack(bits)
    kind = table.argmin(axis=0)
    cost = table[kind, np.arange(n)]
    param = np.stack(params)[kind, np.arange(n)]
    kind = np.where(cost + 10 >= 8 * size, 4, kind)  # plain samples
    kind = np.where((x == x[:, :1]).all(axis=1), 5, kind)  # a constant
    return kind, param, cost, np.stack([c1, c2]), codes


def _fit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Second-order predictors by the normal equations, quantised."""
    f = x.astype(np.float64)
    r0 = (f * f).sum(axis=1) + 1e-9
    r1 = (f[:, 1:] * f[:, :-1]).sum(axis=1)
    r2 = (f[:, 2:] * f[:, :-2]).sum(axis=1)
    det = r0 * r0 - r1 * r1
    det = np.where(det <= 1e-6 * r0 * r0, np.inf, det)
    limit = (1 << (PRECISION - 1)) - 1
    a = np.clip(np.rint((r1 * r0 - r1 * r2) / det * (1 << SHIFT)), -limit, limit)
    b = np.clip(np.rint((r2 * r0 - r1 * r1) / det * (1 << SHIFT)), -limit, limit)
    return a.astype(np.int32), b.astype(np.int32)


def _field(value: int, bits: int) -> int:
    return value & ((1 << bits) - 1)


def _bodies(x: np.ndarray) -> list[bytes]:
    """Subframes of frames of one size (rows of samples)."""
    n, size = x.shape
    kind, param, cost, coef, codes = _plans(x)
    out: list[bytes] = [b""] * n
    plain = (x & 0xFF).astype(np.uint8)
    coded = []
    for i in range(n):
        if kind[i] == 5:
            out[i] = bytes([0, plain[i, 0]])
        elif kind[i] == 4:
            out[i] = b"\x02" + plain[i].tobytes()
        else:
            coded.append(i)
    if not coded:
        return out
    head, width = np.zeros(len(coded), np.uint64), np.zeros(len(coded), np.int64)
    for j, i in enumerate(coded):
        order = min(int(kind[i]), 2)
        value = (0b001000 | order) << 1 if kind[i] < 3 else (0b100000 | 1) << 1
        bits = 8
        for w in range(order):
            value, bits = value << 8 | int(plain[i, w]), bits + 8
        if kind[i] == 3:
            value, bits = value << 4 | PRECISION - 1, bits + 4
            value, bits = value << 5 | SHIFT, bits + 5
            for c in (0, 1):
                value, bits = value << PRECISION | _field(int(coef[c, i]), PRECISION), bits + PRECISION
        head[j], width[j] = value << 10 | int(param[i]), bits + 10
    rows = np.array(coded)
    pieces = [codes[kind[i]][i] for i in coded]
    lengths = np.array([len(p) for p in pieces])
    u = np.concatenate(pieces).astype(np.int64)
    k = np.repeat(param[rows], lengths)
    ends = np.cumsum((u >> k) + 1 + k)
    last = np.cumsum(lengths) - 1
    body = np.diff(np.concatenate([[0], ends[last]]))
    size_bytes = (width + body + 7) // 8
    base = np.concatenate([[0], np.cumsum(size_bytes)])
    shift = base[:-1] * 8 + width - (ends[last] - body)
    ends += np.repeat(shift, lengths)
    bits = np.zeros(int(base[-1]) * 8, np.uint8)
    bits[ends - 1 - k] = 1
    for j in range(int(k.max())):
        on = np.flatnonzero((k > j) & ((u >> j) & 1 == 1))
        bits[ends[on] - 1 - j] = 1
    for j in range(int(width.max())):
        on = np.flatnonzero((width > j) & ((head >> np.uint64(j)) & np.uint64(1) == 1))
        bits[base[:-1][on] * 8 + width[on] - 1 - j] = 1
    packed = np.packbits(bits).tobytes()
    for j, i in enumerate(coded):
        out[i] = packed[base[j] : base[j + 1]]
    return out


def _frame_head(number: int, size: int) -> bytes:
    code = {576: 2, 1152: 3, 2304: 4, 4608: 5}.get(size, 7)
    h = bytes([0xFF, 0xF8, code << 4 | 4, 0b0010]) + _utf8_number(number) + ((size - 1).to_bytes(2, "big") if code == 7 else b"")
    return h + bytes([crc8(h)])


def encode_many(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream for each payload, whose lengths are positive multiples of 576."""
    by_size: dict[int, list[tuple[int, int]]] = {}
    for p, data in enumerate(payloads):
        for at in range(0, len(data), BLOCK):
            by_size.setdefault(min(BLOCK, len(data) - at), []).append((p, at))
    frames: dict[tuple[int, int], bytes] = {}
    for size, places in by_size.items():
        x = np.frombuffer(b"".join(payloads[p][at : at + size] for p, at in places), np.uint8).reshape(-1, size).astype(np.int32) - 128
        for (p, at), body in zip(places, _bodies(x)):
            frames[p, at] = _frame_head(at // BLOCK, size) + body
    keys = [(p, at) for p, data in enumerate(payloads) for at in range(0, len(data), BLOCK)]
    lengths = np.array([len(frames[key]) for key in keys], np.int64)
    buffer = np.frombuffer(b"".join(frames[key] for key in keys), np.uint8)
    sums = crc16_many(buffer, np.concatenate([[0], np.cumsum(lengths)])[:-1].astype(np.int64), lengths)
    for key, c in zip(keys, sums.tolist()):
        frames[key] += c.to_bytes(2, "big")
    out = []
    for p, data in enumerate(payloads):
        own = [(at, frames[p, at]) for at in range(0, len(data), BLOCK)]
        sizes = [len(f) for _, f in own]
        samples = len(data)
        signed = (np.frombuffer(data, np.uint8) ^ 0x80).tobytes()
        packed = RATE << 44 | 0 << 41 | 7 << 36 | samples
        least = min(BLOCK, samples) if samples < BLOCK else BLOCK
        info = least.to_bytes(2, "big") + BLOCK.to_bytes(2, "big") + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big") + packed.to_bytes(8, "big") + hashlib.md5(signed).digest()
        seek, offset = [], 0
        for (at, f) in own:
            seek.append(at.to_bytes(8, "big") + offset.to_bytes(8, "big") + min(BLOCK, samples - at).to_bytes(2, "big"))
            offset += len(f)
        table = b"".join(seek)
        out.append(b"fLaC\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(table).to_bytes(3, "big") + table + b"".join(f for _, f in own))
    return out


@dataclass
class Stream:
    """Where things are in a stream: first byte of the frames, seek points (sample, byte, samples), samples, MD5."""

    data: bytes
    first: int
    points: list[tuple[int, int, int]]
    samples: int
    md5: bytes


def open_stream(data: bytes) -> Stream:
    """Read the metadata blocks."""
    if data[:4] != b"fLaC":
        raise FlacError("no fLaC marker")
    at, points, samples, md5 = 4, [], 0, b""
    while True:
        kind, size = data[at], int.from_bytes(data[at + 1 : at + 4], "big")
        block = data[at + 4 : at + 4 + size]
        if kind & 0x7F == 0:
            packed = int.from_bytes(block[10:18], "big")
            if packed >> 41 & 7 or packed >> 36 & 31 != 7:
                raise FlacError("only mono streams of 8 bits")
            samples, md5 = packed & (1 << 36) - 1, block[18:34]
        elif kind & 0x7F == 3:
            points = [(int.from_bytes(block[i : i + 8], "big"), int.from_bytes(block[i + 8 : i + 16], "big"), int.from_bytes(block[i + 16 : i + 18], "big")) for i in range(0, size, 18)]
        at += 4 + size
        if kind & 0x80:
            return Stream(data, at, points, samples, md5)


class _Bits:
    """Bits of a few header bytes, for what comes before the residual."""

    def __init__(self, data: bytes, at: int):
        self.data, self.pos = data, at * 8

    def take(self, n: int, signed: bool = False) -> int:
        if not n:
            return 0
        low, high = self.pos >> 3, self.pos + n + 7 >> 3
        value = int.from_bytes(self.data[low:high], "big") >> (high * 8 - self.pos - n) & (1 << n) - 1
        self.pos += n
        return value - (1 << n) if signed and value >> n - 1 else value


def _parse_head(data: bytes, at: int) -> tuple[int, int]:
    """Samples in the frame and the place of its subframe; the header's checksum is verified."""
    if data[at : at + 2] != b"\xff\xf8":
        raise FlacError("lost the frame's sync code")
    code, p = data[at + 2] >> 4, at + 4
    lead = data[p]
    p += 1 if lead < 0x80 else 8 - (lead ^ 0xFF).bit_length()
    if code == 7:
        size, p = int.from_bytes(data[p : p + 2], "big") + 1, p + 2
    elif code == 6:
        size, p = data[p] + 1, p + 1
    elif 2 <= code <= 5:
        size = UNIT << code - 2
    elif code >= 8:
        size = 256 << code - 8
    else:
        raise FlacError("unknown block size")
    if crc8(data[at:p]) != data[p]:
        raise FlacError("frame header checksum differs")
    return size, p + 1


def decode_frames(data: bytes, places: list[tuple[int, int]]) -> list[np.ndarray]:
    """Samples of the frames at (first byte, end byte), after both checksums of each are verified."""
    buffer = np.frombuffer(data, np.uint8)
    starts, ends = np.array([p[0] for p in places], np.int64), np.array([p[1] for p in places], np.int64)
    given = buffer[ends - 2].astype(np.uint16) << 8 | buffer[ends - 1]
    if (crc16_many(buffer, starts, ends - starts - 2) != given).any():
        raise FlacError("frame checksum differs")
    out: list[np.ndarray] = [None] * len(places)  # type: ignore[list-item]
    jobs = []
    for i, (at, _) in enumerate(places):
        size, body = _parse_head(data, at)
        bits = _Bits(data, body)
        kind = bits.take(8) >> 1
        if kind == 0:
            out[i] = np.full(size, bits.take(8, True), np.int32)
        elif kind == 1:
            out[i] = buffer[body + 1 : body + 1 + size].view(np.int8).astype(np.int32)
        elif 8 <= kind <= 12 or kind >= 32:
            order = kind - 8 if kind < 32 else kind - 31
            warm = [bits.take(8, True) for _ in range(order)]
            coef, shift = FIXED[order] if kind < 32 else (), 0
            if kind >= 32:
                precision, shift = bits.take(4) + 1, bits.take(5)
                coef = tuple(bits.take(precision, True) for _ in range(order))
            wide, parts = bits.take(2), bits.take(4)
            if wide > 1:
                raise FlacError("unknown residual coding")
            jobs.append((size, i, order, warm, coef, shift, 4 + wide, parts, bits.pos))
        else:
            raise FlacError("unknown subframe")
    if jobs:
        _decode_rice(buffer, sorted(jobs, key=lambda j: -j[0]), out)
    return out


def _decode_rice(buffer: np.ndarray, jobs: list[tuple], out: list) -> None:
    """Rice codes and predictors of many frames, a sample of each at a time."""
    b = np.concatenate([buffer, np.zeros(8, np.uint8)]).astype(np.uint32)
    word = b[:-3] << np.uint32(24) | b[1:-2] << np.uint32(16) | b[2:-1] << np.uint32(8) | b[3:]
    n = len(jobs)
    size = np.array([j[0] for j in jobs])
    order = np.array([j[2] for j in jobs])
    depth = max(int(order.max()), 1)
    coef = np.zeros((depth, n), np.int64)
    history = np.zeros((depth, n), np.int64)  # newest first
    x = np.zeros((int(size[0]), n), np.int32)
    for j, (_, _, o, warm, c, *_rest) in enumerate(jobs):
        for d in range(o):
            coef[d, j] = c[d]
            history[d, j] = warm[o - 1 - d]
            x[d, j] = warm[d]
    shift = np.array([j[5] for j in jobs], np.int64)
    width = np.array([j[6] for j in jobs], np.int64)
    pos = np.array([j[8] for j in jobs], np.int64)
    part = size >> np.array([j[7] for j in jobs])
    whole = bool((part == size).all())
    k = np.zeros(n, np.int64)
    alive = n - np.searchsorted(size[::-1], np.arange(1, int(size[0]) + 1), side="left")

    def peek(p: np.ndarray) -> np.ndarray:
        return word[p >> 3] << (p & 7).astype(np.uint32)

    first = np.unique(order)
    for t, m in enumerate(alive.tolist()):
        late = t < first[-1]
        live = np.flatnonzero(order[:m] <= t) if late else slice(0, m)
        if late and not len(live):
            continue
        # a partition begins at its multiple, the first one after the warm-up samples
        if t in first or not whole:
            begins = (order[:m] == t) | ((part[:m] > 0) & (t % np.maximum(part[:m], 1) == 0) & (t > order[:m]))
            if begins.any():
                w = np.flatnonzero(begins)
                k[w] = (peek(pos[w]) >> (32 - width[w]).astype(np.uint32)).astype(np.int64)
                if (k[w] == (1 << width[w]) - 1).any():
                    raise FlacError("escaped partitions are not supported")
                pos[w] += width[w]
        p, kk = pos[live], k[live]
        q = LEADING[peek(p) >> np.uint32(16)]
        long = np.flatnonzero(q == 16)
        while len(long):
            more = LEADING[peek(p[long] + q[long]) >> np.uint32(16)]
            q[long] += more
            long = long[more == 16]
        p = p + q + 1
        low = np.where(kk > 0, peek(p).astype(np.int64) >> (32 - kk), 0)
        pos[live] = p + kk
        u = q << kk | low
        s = (u >> 1) ^ -(u & 1)
        acc = coef[0][live] * history[0][live]
        for d in range(1, depth):
            acc += coef[d][live] * history[d][live]
        s += acc >> shift[live]
        for d in range(depth - 1, 0, -1):
            history[d][live] = history[d - 1][live]
        history[0][live] = s
        x[t, live] = s
    columns = np.ascontiguousarray(x.T)
    for j, (length, i, *_rest) in enumerate(jobs):
        out[i] = columns[j, :length]


def _places(s: Stream, base: int = 0) -> list[tuple[int, int]]:
    offsets = [s.first + p[1] for p in s.points] + [len(s.data)]
    return [(base + a, base + b) for a, b in zip(offsets, offsets[1:])]


def decode_many(streams: list[bytes]) -> list[bytes]:
    """The payload of each stream; checksums and MD5 are verified."""
    opened = [open_stream(s) for s in streams]
    places, owners, base = [], [], 0
    for i, s in enumerate(opened):
        own = _places(s, base)
        places += own
        owners += [i] * len(own)
        base += len(s.data)
    parts: list[list[np.ndarray]] = [[] for _ in streams]
    for owner, samples in zip(owners, decode_frames(b"".join(streams), places)):
        parts[owner].append(samples)
    out = []
    for s, p in zip(opened, parts):
        signed = np.concatenate(p).astype(np.int8).view(np.uint8)
        if len(signed) != s.samples or hashlib.md5(signed.tobytes()).digest() != s.md5:
            raise FlacError("the samples differ from the stream's MD5")
        out.append((signed ^ 0x80).tobytes())
    return out


def frames_at(data: bytes, first: int, count: int | None = None) -> list[tuple[int, bytes]]:
    """(sample offset, payload bytes) of the frames that hold one of count samples from first on; no other is decoded."""
    s = open_stream(data)
    places, end = _places(s), s.samples if count is None else first + count
    hit = [i for i, (at, _, n) in enumerate(s.points) if at < end and at + n > first]
    if not hit:
        return []
    frames = decode_frames(data, [places[i] for i in hit])
    return [(s.points[i][0], (f.astype(np.int8).view(np.uint8) ^ 0x80).tobytes()) for i, f in zip(hit, frames)]


def read_at(data: bytes, sample: int, count: int) -> bytes:
    """count payload bytes from a sample offset."""
    got = frames_at(data, sample, count)
    return b"".join(pcm for _, pcm in got)[sample - got[0][0] :][:count] if got else b""


def payload_of(text: str | None) -> tuple[int, bytes]:
    """Unpadded length and the bytes, padded with 255 to a positive multiple of 576."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    padded = max(UNIT, -(-len(raw) // UNIT) * UNIT)
    return len(raw), raw + b"\xff" * (padded - len(raw))


class Described:
    """Digests and integers that describe a payload whose blocks come in order."""

    def __init__(self) -> None:
        self.sha, self.tail, self.size = hashlib.sha256(), b"", 0
        self.sum = self.energy = self.crossings = self.peak = 0
        self.below: bool | None = None

    def add(self, pcm: bytes) -> None:
        x = np.frombuffer(pcm, np.uint8).astype(np.int64) - 128
        low = x < 0
        self.sha.update(pcm)
        self.tail = (self.tail + pcm)[-32:]
        self.size += len(pcm)
        self.sum += int(x.sum())
        self.energy += int((x * x).sum())
        self.crossings += int((low[1:] != low[:-1]).sum()) + (self.below is not None and self.below != bool(low[0]))
        self.peak = max(self.peak, int(np.abs(x).max()))
        self.below = bool(low[-1])

    def feature(self) -> str:
        return f"n={self.size};sum={self.sum};energy={self.energy};crossings={self.crossings};peak={self.peak}"


def feature(payload: bytes) -> str:
    """Integers that describe the sound: samples, sum, energy, sign changes, peak."""
    d = Described()
    d.add(payload)
    return d.feature()


def media(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_bytes, the stored FLAC stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole):
                got = [payload_of(t) for t in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([n for n, _ in got], pa.int64()), pa.array(encode_many([p for _, p in got]), pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


BLOCKS = "row long, doc_id long, n_bytes long, samples long, media_bytes long, media_sha256 string, sample_offset long, pcm binary"


def pcm_blocks(stored: DataFrame, first: int = 0, count: int | None = None) -> DataFrame:
    """PCM blocks (unsigned 8-bit) of a table of streams, a frame each with its sample offset, in order within a task.

    row numbers the streams; with first and count only frames that hold one of these samples are decoded.
    """
    names = [c.split()[0] for c in BLOCKS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for whole in batches:
            for b in slices(whole, "media"):
                rows = []
                streams = b.column("media").to_pylist()
                if first == 0 and count is None:
                    decoded = [[(at, p[at : at + BLOCK]) for at in range(0, len(p), BLOCK)] for p in decode_many(streams)]
                else:
                    decoded = [frames_at(s, first, count) for s in streams]
                for doc, n, s, blocks in zip(b.column("doc_id").to_pylist(), b.column("n_bytes").to_pylist(), streams, decoded):
                    info = (row, doc, n, open_stream(s).samples, len(s), hashlib.sha256(s).hexdigest())
                    rows += [(*info, at, pcm) for at, pcm in blocks]
                    row += 1
                columns = list(zip(*rows)) if rows else [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (*(pa.int64(),) * 5, pa.string(), pa.int64(), pa.binary()))], names)

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, BLOCKS)


def seek(stored: DataFrame, first: int, count: int) -> DataFrame:
    """doc_id, sample_offset, pcm: the samples [first, first + count) of every stream, cut from the blocks that hold them."""
    blocks = pcm_blocks(stored, first, count)
    skip = F.greatest(F.lit(first) - F.col("sample_offset"), F.lit(0))
    take = F.least(F.lit(first + count) - F.col("sample_offset"), F.octet_length("pcm").cast("long")) - skip
    return blocks.select("doc_id", (F.col("sample_offset") + skip).alias("sample_offset"), F.expr("pcm").substr((skip + 1).cast("int"), take.cast("int")).alias("pcm"))


def digest(stored: DataFrame) -> DataFrame:
    """The stored streams read back as PCM blocks, and each payload described from its blocks."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        made = Described()

        def ended() -> tuple:
            _, doc, n, samples, media_bytes, media_sha = held
            if made.size != samples:
                raise FlacError("blocks are missing")
            return doc, n, made.size, made.sha.hexdigest(), zlib.crc32(made.tail), media_bytes, media_sha, made.feature()

        def frame(rows: list[tuple]) -> pa.RecordBatch:
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])
            out["doc_id"] = out["doc_id"].astype("Int64")
            return pa.RecordBatch.from_pandas(out, preserve_index=False)

        for b in batches:
            rows = []
            for *info, at, pcm in zip(*(c.to_pylist() for c in b.columns)):
                if held is None or info[0] != held[0]:
                    if held is not None:
                        rows.append(ended())
                    held, made = tuple(info), Described()
                if at != made.size:
                    raise FlacError("blocks are not in order")
                made.add(pcm)
            if rows:
                yield frame(rows)
        if held is not None:
            yield frame([ended()])

    return pcm_blocks(stored).mapInArrow(run, schema)


def op3_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(stage(media(documents(spark, sf_dir)), "flac"))


QUERIES = {"op3_flac": op3_flac}
ORACLE: dict[str, str] = {}
