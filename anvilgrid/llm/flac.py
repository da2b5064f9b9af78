"""FLAC media columns: lossless blocks with Rice-coded residuals, checked frames and a seek table.

Streams are written and read in numpy, many frames at once: frames of one step are laid side by side and every bit
position moves forward in all of them together. A stream has the marker, a stream-info block (with the MD5 of the
samples), a seek table with one point for each frame, and frames of one channel of 8-bit samples. The writer takes for
each frame the smallest of constant, verbatim, fixed predictors of order 0 to 2 and a quantised linear predictor. The
reader takes constant, verbatim, fixed and linear subframes of any order, both Rice parameter widths, any partition
order and escaped partitions, verifies the header's CRC-8 and the frame's CRC-16, and returns blocks of samples with
their offsets. Seek points lead to a block without reading those before.

Defined cases: null text = empty = one block of filler; long texts have as many blocks as they need and are worked on
STEP_BYTES at a time; repeated rows repeat; a stream that fails a check raises BadStream.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from anvilgrid.llm.common import doc_view, documents, nonempty
from anvilgrid.session import ship

BLOCK, RATE, BITS = 576, 8000, 8
#: Order and precision of the linear predictor that the writer tries.
ORDER, PRECISION = 2, 12
#: Fixed predictors that the writer tries: orders 0, 1 and 2.
TRIED = 3
#: Frames that one step works on.
STEP_FRAMES = 4096
FIXED = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]]


class BadStream(ValueError):
    """A stream that is cut short, malformed or fails a checksum."""


def crc_table(polynomial: int, bits: int) -> np.ndarray:
    out, top = [], 1 << (bits - 1)
    for b in range(256):
        r = b << (bits - 8)
        for _ in range(8):
            r = (r << 1) ^ polynomial if r & top else r << 1
        out.append(r & ((1 << bits) - 1))
    return np.array(out, np.int64)


CRC8, CRC16 = crc_table(0x07, 8), crc_table(0x8005, 16)


def crc(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, wide: bool) -> np.ndarray:
    """CRC-16 or CRC-8 of several ranges of data, a byte of each at a time."""
    r, n = np.zeros(len(starts), np.int64), ends - starts
    order = np.argsort(-n, kind="stable")
    live, s = len(order), starts[order]
    lengths = n[order]
    out = r[order]
    for i in range(int(n.max(initial=0))):
        while live and lengths[live - 1] <= i:
            live -= 1
        b = data[s[:live] + i]
        out[:live] = CRC16[(out[:live] >> 8) ^ b] ^ ((out[:live] << 8) & 0xFFFF) if wide else CRC8[out[:live] ^ b]
    r[order] = out
    return r


def coded_number(n: int) -> bytes:
    """The UTF-8-like code of frame numbers, up to 36 bits."""
    if n < 128:
        return bytes([n])
    size = next(k for k in range(2, 8) if n < 1 << (5 * k + 1 if k < 7 else 36))
    head = (0xFF << (8 - size)) & 0xFF | n >> 6 * (size - 1)
    return bytes([head, *(0x80 | n >> 6 * i & 63 for i in range(size - 2, -1, -1))])


class BitWriter:
    """Fields of many rows at given bit positions. Fields never overlap, so bytes are the sums of their parts."""

    def __init__(self, size: int):
        self.bytes = np.zeros(size + 4, np.int64)

    def put(self, at: np.ndarray, value: np.ndarray, width: int) -> None:
        """Of up to 24 bits."""
        at, value = np.ravel(at), np.ravel(value).astype(np.int64) & ((1 << width) - 1)
        self.put_each(at, value, np.full(len(at), width))

    def put_each(self, at: np.ndarray, value: np.ndarray, width: np.ndarray) -> None:
        if not len(at):
            return
        first, base = at >> 3, int(at[0]) >> 3
        base = min(base, int(first.min()))
        v = value << (32 - (at & 7) - width)
        last = int(first.max()) + 4 - base
        for i in range(4):
            part = (v >> (24 - 8 * i)) & 255
            if part.any():
                self.bytes[base : base + last] += np.bincount(first - base + i, part, last).astype(np.int64)


def predictors(x: np.ndarray) -> np.ndarray:
    """Quantised coefficients of each row's linear predictor (rows x ORDER), by Levinson's recursion."""
    f = x * np.hanning(x.shape[1] + 2)[1:-1].astype(np.float32)
    r = np.stack([np.einsum("ij,ij->i", f[:, : f.shape[1] - k], f[:, k:]) for k in range(ORDER + 1)], 1).astype(np.float64)
    a, err = np.zeros((len(x), ORDER)), r[:, 0] + 1e-9
    for i in range(ORDER):
        k = (r[:, i + 1] - (a[:, :i] * r[:, i:0:-1][:, :i]).sum(1)) / err
        a[:, :i] = a[:, :i] - k[:, None] * a[:, :i][:, ::-1]
        a[:, i] = k
        err = err * (1 - k * k) + 1e-9
    shift = PRECISION - 2
    return np.clip(np.rint(a * (1 << shift)), -(1 << (PRECISION - 1)), (1 << (PRECISION - 1)) - 1).astype(np.int32)


def residuals(x: np.ndarray, coefficients: np.ndarray, shift: int) -> np.ndarray:
    """x[i] - (sum of c[j] * x[i-1-j]) >> shift, from the order on; coefficients: rows x order."""
    order = coefficients.shape[1]
    total = np.zeros((len(x), x.shape[1] - order), np.int32)
    for j in range(order):
        total += coefficients[:, j : j + 1] * x[:, order - 1 - j : x.shape[1] - 1 - j]
    return x[:, order:] - (total >> shift)


def fold_sign(r: np.ndarray) -> np.ndarray:
    return (r << 1) ^ (r >> 31)


def rice(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best Rice parameter of each row of folded residuals and the bits it takes: near the logarithm of the mean."""
    guess = np.clip(np.log2(u.mean(1) + 0.5).astype(np.int64), 1, 13)
    tried = guess[:, None] + np.arange(-1, 2)
    sizes = np.stack([(u >> tried[:, i : i + 1].astype(np.int32)).sum(1) + u.shape[1] * (tried[:, i] + 1) for i in range(3)], 1)
    at = sizes.argmin(1)
    return tried[np.arange(len(u)), at], sizes[np.arange(len(u)), at] + 10


def write_frames(x: np.ndarray, numbers: list[int]) -> list[bytes]:
    """Frames of BLOCK samples (rows of x, -128..127), numbered within their streams."""
    n, x = len(x), x.astype(np.int32)
    kinds = [np.tile(np.array(c, np.int32), (n, 1)) if c else np.zeros((n, 0), np.int32) for c in FIXED[:TRIED]] + [predictors(x)]
    tried = [fold_sign(residuals(x, c, 0 if i < TRIED else PRECISION - 2)) for i, c in enumerate(kinds)]
    best = [rice(u) for u in tried]
    extra = [BITS * c.shape[1] + (9 + PRECISION * ORDER if i == TRIED else 0) for i, c in enumerate(kinds)]
    sizes = np.stack([b[1] + e for b, e in zip(best, extra, strict=True)] + [np.full(n, BITS * BLOCK)], 1)
    kind = sizes.argmin(1)
    constant = (x == x[:, :1]).all(1)
    linear, verbatim, same = TRIED, TRIED + 1, TRIED + 2
    kind[constant] = same
    heads = []
    for number in numbers:
        h = bytes([0xFF, 0xF8, 0x24, 0x02]) + coded_number(number)
        heads.append(h)
    whole = np.frombuffer(b"".join(heads), np.uint8)
    ends = np.cumsum([len(h) for h in heads])
    check = crc(whole, np.concatenate([[0], ends[:-1]]), ends, False)
    heads = [h + bytes([c]) for h, c in zip(heads, check.tolist(), strict=True)]
    body_bits = 8 + np.where(kind == same, BITS, sizes[np.arange(n), np.minimum(kind, verbatim)])
    head_bytes = np.array([len(h) for h in heads])
    frame_bytes = head_bytes + (body_bits + 7) // 8 + 2
    base = (np.concatenate([[0], np.cumsum(frame_bytes)[:-1]]) + head_bytes) * 8
    w = BitWriter(int(frame_bytes.sum()))
    for i in range(same + 1):
        rows = np.flatnonzero(kind == i)
        if not len(rows):
            continue
        at, v = base[rows], x[rows]
        code = 8 + i if i < TRIED else {linear: 32 + ORDER - 1, verbatim: 1, same: 0}[i]
        w.put(at, np.full(len(rows), code << 1), 8)
        at = at + 8
        if i == same:
            w.put(at, v[:, 0], BITS)
        elif i == verbatim:
            w.put(at[:, None] + np.arange(BLOCK) * BITS, v, BITS)
        else:
            c = kinds[i][rows]
            order = c.shape[1]
            w.put(at[:, None] + np.arange(order) * BITS, v[:, :order], BITS)
            at = at + order * BITS
            if i == linear:
                w.put(at, np.full(len(rows), (PRECISION - 1) << 5 | PRECISION - 2), 9)
                w.put(at[:, None] + 9 + np.arange(order) * PRECISION, c, PRECISION)
                at = at + 9 + order * PRECISION
            k = best[i][0][rows]
            w.put(at, k, 10)  # method 0, partition order 0, parameter
            u = tried[i][rows].astype(np.int64)
            q = u >> k[:, None]
            width = k[:, None] + 1
            length = q + width
            first = (at + 10)[:, None] + np.cumsum(length, 1) - length
            # the zeros of the unary part are there; the one that ends it and the low bits are one field
            low = (u & ((np.int64(1) << k[:, None]) - 1)) | (np.int64(1) << k[:, None])
            w.put_each((first + q).ravel(), low.ravel(), np.broadcast_to(width, u.shape).ravel())
    out = w.bytes[:-4].astype(np.uint8)
    starts = np.concatenate([[0], np.cumsum(frame_bytes)[:-1]])
    for s, h in zip(starts.tolist(), heads, strict=True):
        out[s : s + len(h)] = np.frombuffer(h, np.uint8)
    stops = starts + frame_bytes
    check = crc(out, starts, stops - 2, True)
    out[stops - 2], out[stops - 1] = check >> 8, check & 255
    raw = out.tobytes()
    return [raw[a:b] for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]


def encode_streams(payloads: list[bytes]) -> list[bytes]:
    """One stream for each payload; a payload's length is a positive multiple of BLOCK."""
    counts = [len(p) // BLOCK for p in payloads]
    numbers = [i for c in counts for i in range(c)]
    x = (np.frombuffer(b"".join(payloads), np.uint8).astype(np.int64) - 128).reshape(-1, BLOCK)
    frames: list[bytes] = []
    for i in range(0, len(x), STEP_FRAMES):
        frames += write_frames(x[i : i + STEP_FRAMES], numbers[i : i + STEP_FRAMES])
    out, at = [], 0
    for p, c in zip(payloads, counts, strict=True):
        own = frames[at : at + c]
        at += c
        samples = (np.frombuffer(p, np.uint8) ^ 128).tobytes()  # as signed bytes
        sizes = [len(f) for f in own]
        info = struct.pack(">HH", BLOCK, BLOCK) + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big")
        info += (RATE << 44 | (BITS - 1) << 36 | len(p)).to_bytes(8, "big") + hashlib.md5(samples).digest()
        offsets = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        # a metadata block holds less than 16 MiB: a table has points for as many evenly spaced frames as fit
        step = -(-c // 900_000)
        table = b"".join(struct.pack(">QQH", i * BLOCK, int(offsets[i]), BLOCK) for i in range(0, c, step))
        out.append(b"fLaC" + b"\0" + len(info).to_bytes(3, "big") + info + b"\x83" + len(table).to_bytes(3, "big") + table + b"".join(own))
    return out


def read_header(stream: bytes) -> dict:
    """Stream info, seek points (sample, offset, samples) and where frames begin."""
    if stream[:4] != b"fLaC":
        raise BadStream("no stream marker")
    at, last, out = 4, False, {"seek": []}
    while not last:
        if len(stream) < at + 4:
            raise BadStream("cut short in metadata")
        kind, size = stream[at] & 127, int.from_bytes(stream[at + 1 : at + 4], "big")
        last, body = stream[at] > 127, stream[at + 4 : at + 4 + size]
        if kind == 0:
            packed = int.from_bytes(body[10:18], "big")
            out |= {"block": int.from_bytes(body[2:4], "big"), "rate": packed >> 44, "channels": (packed >> 41 & 7) + 1, "bits": (packed >> 36 & 31) + 1, "samples": packed & (1 << 36) - 1, "md5": body[18:34]}
        elif kind == 3:
            out["seek"] = [p for p in struct.iter_unpack(">QQH", body[: size // 18 * 18]) if p[0] != 2**64 - 1]
        at += 4 + size
    if "block" not in out:
        raise BadStream("no stream info")
    return out | {"frames": at}


def frame_bounds(stream: bytes, head: dict) -> list[tuple[int, int]]:
    """Of each frame: by the seek table if it has every frame, else by scanning for headers whose CRC-8 holds."""
    at, n = head["frames"], -(-head["samples"] // head["block"])
    if len(head["seek"]) == n:
        starts = [at + p[1] for p in head["seek"]]
    else:
        starts, i = [], stream.find(b"\xff\xf8", at)
        while i >= 0:
            size = frame_header(stream, i, strict=False)
            if size and (not starts or check16(stream[starts[-1] : i])):
                starts.append(i)
            i = stream.find(b"\xff\xf8", i + 1)
    return list(zip(starts, [*starts[1:], len(stream)], strict=True))


def check16(frame: bytes) -> bool:
    d = np.frombuffer(frame, np.uint8)
    return len(d) > 2 and int(crc(d, np.array([0]), np.array([len(d) - 2]), True)[0]) == int.from_bytes(frame[-2:], "big")


def frame_header(stream: bytes, at: int, strict: bool = True) -> tuple[int, int, int] | None:
    """(size in bytes, frame number, samples) of a frame header whose checksum holds."""
    h = stream[at : at + 16]
    try:
        if h[0] != 0xFF or h[1] != 0xF8:
            raise BadStream("no frame")
        lead = h[4]
        more = 0 if lead < 128 else next(k for k in range(1, 8) if not lead >> (6 - k) & 1 or k == 6)
        number = lead if lead < 128 else lead & (1 << (6 - more)) - 1 if more < 6 else 0
        for b in h[5 : 5 + more]:
            number = number << 6 | b & 63
        size, code = 5 + more, h[2] >> 4
        if code == 6:
            samples, size = h[size] + 1, size + 1
        elif code == 7:
            samples, size = int.from_bytes(h[size : size + 2], "big") + 1, size + 2
        elif code == 1:
            samples = 192
        elif 2 <= code <= 5:
            samples = 576 << (code - 2)
        elif code >= 8:
            samples = 256 << (code - 8)
        else:
            raise BadStream("reserved block size")
        size += {12: 1, 13: 2, 14: 2}.get(h[2] & 15, 0)
        d = np.frombuffer(h[:size], np.uint8)
        if int(crc(d, np.array([0]), np.array([size]), False)[0]) != h[size]:
            raise BadStream("a frame header fails its checksum")
    except (IndexError, StopIteration, BadStream) as e:
        if strict:
            raise BadStream(str(e)) from e
        return None
    return size + 1, number, samples


#: Zeros that lead a 16-bit number.
LEADING = np.array([16 - int(i).bit_length() for i in range(1 << 16)], np.int64)


class BitReader:
    """Reads fields at many bit positions at once, through an unaligned view of 64-bit words."""

    def __init__(self, data: bytes):
        self.size = len(data) * 8
        self.words = np.ndarray((len(data),), ">u8", data + b"\0" * 8, strides=(1,))

    def window(self, at: np.ndarray) -> np.ndarray:
        """The bits from each position on, at the top of 64-bit words; 57 of them hold."""
        if np.any(at >= self.size):
            raise BadStream("cut short in a frame")
        return self.words[at >> 3].astype(np.uint64) << (at & 7).astype(np.uint64)

    def get(self, at: np.ndarray, width) -> np.ndarray:
        """Unsigned fields of up to 32 bits; width may differ by row, and may be 0."""
        w = np.asarray(width).astype(np.uint64)
        return ((self.window(at) >> np.uint64(1)) >> (np.uint64(63) - w)).astype(np.int64)

    def signed(self, at: np.ndarray, width) -> np.ndarray:
        top = np.int64(1) << (np.asarray(width, np.int64) - 1)
        return (self.get(at, width) ^ top) - top

    def rice(self, at: np.ndarray, k: np.ndarray, k_bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Folded residuals, and where the next ones begin; k_bits: k as unsigned."""
        v = self.window(at)
        q = LEADING[v >> np.uint64(48)]
        long = q == 16
        if long.any():
            rows = np.flatnonzero(long)
            pos = at[rows] + 16
            while len(rows):
                z = LEADING[self.window(pos) >> np.uint64(48)]
                q[rows] += z
                pos, rows = (pos + 16)[z == 16], rows[z == 16]
            return (q << k) | self.get(at + q + 1, k), at + q + 1 + k
        low = ((v << (q + 1).astype(np.uint64)) >> np.uint64(1)) >> (np.uint64(63) - k_bits)
        return (q << k) | low.astype(np.int64), at + q + 1 + k


def read_residuals(r: BitReader, at: np.ndarray, order: np.ndarray, block: int) -> np.ndarray:
    """Residuals from each row's order on, a sample of all rows after another (block x rows)."""
    wide = np.where(r.get(at, 2) == 1, 5, 4)
    partitions = r.get(at + 2, 4)
    at, out = at + 6, np.zeros((block, len(at)), np.int64)
    for po in np.unique(partitions).tolist():
        rows = np.flatnonzero(partitions == po)
        pos, width, begin = at[rows], wide[rows], order[rows]
        for p in range(1 << po):
            lo, hi = p * (block >> po), (p + 1) * (block >> po)
            k = r.get(pos, width)
            pos = pos + width
            escaped = k == (1 << width) - 1
            e, plain = np.flatnonzero(escaped), np.flatnonzero(~escaped)
            if len(plain):
                kk, pp, mine, first = k[plain], pos[plain], rows[plain], begin[plain]
                bits, every, latest = kk.astype(np.uint64), len(plain) == len(at), int(first.max())
                for i in range(lo, hi):
                    if i < latest:
                        on = first <= i
                        out[i, mine[on]], pp[on] = r.rice(pp[on], kk[on], bits[on])
                    elif every:
                        out[i], pp = r.rice(pp, kk, bits)
                    else:
                        out[i, mine], pp = r.rice(pp, kk, bits)
                pos[plain] = pp
                part = out[lo:hi] if every else out[lo:hi, mine]
                out[lo:hi, mine] = (part >> 1) ^ -(part & 1)
            if len(e):
                raw = r.get(pos[e], 5)
                pos[e] += 5
                for i in range(lo, hi):
                    on = (begin[e] <= i) & (raw > 0)
                    out[i, rows[e[on]]] = r.signed(pos[e[on]], raw[on])
                    pos[e[on]] += raw[on]
    return out


def read_frames(data: bytes, bounds: list[tuple[int, int]], bits: int) -> list[tuple[int, np.ndarray]]:
    """(frame number, samples) of each one-channel frame after both checksums held."""
    d = np.frombuffer(data, np.uint8)
    a, b = np.array([x for x, _ in bounds]), np.array([y for _, y in bounds])
    if np.any(crc(d, a, b - 2, True) != d[b - 2].astype(np.int64) * 256 + d[b - 1]):
        raise BadStream("a frame fails its checksum")
    heads = [frame_header(data, x) for x, _ in bounds]
    r = BitReader(data)
    at = (a + [h[0] for h in heads]) * 8
    kind, wasted = r.get(at, 8) >> 1 & 63, r.get(at, 8) & 1
    if wasted.any():
        raise BadStream("wasted bits are not supported")
    at = at + 8
    blocks = np.array([h[2] for h in heads])
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(bounds)
    if np.any((kind > 1) & (kind < 8) | (kind > 12) & (kind < 32)):
        raise BadStream("reserved subframe")
    order = np.where(kind >= 32, kind - 31, np.maximum(kind - 8, 0))
    for block in np.unique(blocks).tolist():
        for k in (0, 1):
            rows = np.flatnonzero((kind == k) & (blocks == block))
            if len(rows):
                width = bits if k else 0
                x = r.signed(at[rows][:, None] + np.arange(block) * width, bits)
                for i, row in zip(rows.tolist(), x, strict=True):
                    out[i] = row
        rows = np.flatnonzero((kind >= 8) & (blocks == block))
        if not len(rows):
            continue
        linear, begin = kind[rows] >= 32, at[rows] + order[rows] * bits
        precision, shift = np.ones(len(rows), np.int64), np.zeros(len(rows), np.int64)
        precision[linear], shift[linear] = r.get(begin[linear], 4) + 1, r.get(begin[linear] + 4, 5)
        x = read_residuals(r, begin + np.where(linear, 9 + order[rows] * precision, 0), order[rows], block)
        for k in np.unique(kind[rows]).tolist():  # a sample of all rows after another
            own = np.flatnonzero(kind[rows] == k)
            n = int(order[rows[own[0]]])
            y = np.ascontiguousarray(x[:, own])
            y[:n] = r.signed(at[rows[own]] + np.arange(n)[:, None] * bits, bits)
            c = [r.signed(begin[own] + 9 + j * precision[own], precision[own]) for j in range(n)] if k >= 32 else FIXED[n]
            for i in range(n, block) if n else ():
                total = c[0] * y[i - 1]
                for j in range(1, n):
                    total += c[j] * y[i - 1 - j]
                y[i] += total >> shift[own]
            for i, row in zip(rows[own].tolist(), np.ascontiguousarray(y.T), strict=True):
                out[i] = row
    return [(h[1], x) for h, x in zip(heads, out, strict=True)]


def decode_streams(streams: list[bytes], verify: bool = True) -> list[list[tuple[int, np.ndarray]]]:
    """For each stream its PCM blocks as (offset of the first sample, samples); frames of all streams go together."""
    todo, heads = [], [read_header(s) for s in streams]
    for k, (s, h) in enumerate(zip(streams, heads, strict=True)):
        if h["channels"] != 1:
            raise BadStream("only one channel is supported")
        todo += [(k, b) for b in frame_bounds(s, h)]
    out: list[list[tuple[int, np.ndarray]]] = [[] for _ in streams]
    for i in range(0, len(todo), STEP_FRAMES):
        part, data, bounds = todo[i : i + STEP_FRAMES], [], []
        at = 0
        for k, (x, y) in part:
            data.append(streams[k][x:y])
            bounds.append((at, at + y - x))
            at += y - x
        for bits in {heads[k]["bits"] for k, _ in part}:
            own = [j for j, (k, _) in enumerate(part) if heads[k]["bits"] == bits]
            for j, (number, x) in zip(own, read_frames(b"".join(data), [bounds[j] for j in own], bits), strict=True):
                k = part[j][0]
                out[k].append((number * heads[k]["block"], x))
    for k, h in enumerate(heads):
        if verify and h["bits"] == 8 and any(h["md5"]):
            x = np.concatenate([x for _, x in out[k]]) if out[k] else np.zeros(0, np.int64)
            if len(x) != h["samples"] or hashlib.md5(x.astype(np.int8).tobytes()).digest() != h["md5"]:
                raise BadStream("the samples fail their checksum")
    return out


def read_block(stream: bytes, sample: int) -> tuple[int, np.ndarray]:
    """The block that holds a sample, by its seek point, reading only that frame."""
    h = read_header(stream)
    bounds = frame_bounds(stream, h)
    i = sample // h["block"]
    if not 0 <= i < len(bounds):
        raise BadStream("no such sample")
    number, x = read_frames(stream[bounds[i][0] : bounds[i][1]], [(0, bounds[i][1] - bounds[i][0])], h["bits"])[0]
    return number * h["block"], x


def payload_of(text: str) -> tuple[int, bytes]:
    raw = text.encode()
    size = max(1, -(-len(raw) // BLOCK)) * BLOCK
    return len(raw), raw + b"\xff" * (size - len(raw))


def to_bytes(blocks: list[tuple[int, np.ndarray]]) -> bytes:
    return (np.concatenate([x for _, x in blocks]) + 128).astype(np.uint8).tobytes()


def measure(blocks: list[tuple[int, np.ndarray]], media_bytes: int) -> str:
    """Whole-number features of the decoded samples: blocks, peak, mean energy, zero crossings, bytes in 1000 stored."""
    x = np.concatenate([b for _, b in blocks])
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return f"blocks={len(blocks)};peak={int(np.abs(x).max())};energy={int((x * x).sum() // len(x))};crossings={crossings};permille={media_bytes * 1000 // len(x)}"


def media_column(docs: DataFrame, media: bool = True) -> DataFrame:
    """Every text stored as a stream and read back.

    doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, and if ``media`` the
    stream itself and its seek offsets (sample number of each block).
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            held: list[tuple[object, int, bytes]] = []
            size = 0
            for doc_id, text in zip(b["doc_id"], b["text"], strict=True):
                n, p = payload_of(text)
                held.append((doc_id, n, p))
                size += len(p)
                if size >= STEP_FRAMES * BLOCK:
                    yield rows(held)
                    held, size = [], 0
            if held:
                yield rows(held)

    def rows(held: list[tuple[object, int, bytes]]) -> pd.DataFrame:
        streams = encode_streams([p for _, _, p in held])
        out = []
        for (doc_id, n, p), s, blocks in zip(held, streams, decode_streams(streams), strict=True):
            back = to_bytes(blocks)
            if back != p:
                raise BadStream("the stored bytes differ")
            row = [doc_id, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(s), hashlib.sha256(s).hexdigest(), measure(blocks, len(s))]
            out.append([*row, s, [int(o) for o, _ in blocks]] if media else row)
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", *(["media", "offsets"] if media else [])]
        return pd.DataFrame(out, columns=names).astype({"doc_id": "Int64"})

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return doc_view(docs).mapInPandas(nonempty(run), schema + (", media binary, offsets array<long>" if media else ""))


def op1_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_column(documents(spark, sf_dir), media=False)
