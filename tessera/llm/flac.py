"""FLAC media columns: lossless 8-bit mono streams, encoded and decoded in lockstep.

A stream is a FLAC file: marker, STREAMINFO with the samples' MD5, a SEEKTABLE with
every frame's sample number and byte offset, and frames of a fixed block size.  The
encoder takes, per frame, the cheapest of a constant, verbatim samples, a fixed
predictor or a quantised linear predictor, with Rice-coded residuals.  The decoder
starts at the seek points and reads one residual of every frame of a chunk per
step, so numpy works across frames where a residual depends on the one before.
Header CRC-8, frame CRC-16 and the MD5 are verified; a mismatch raises.

Payload bytes b are samples b - 128.  Null text is empty.  Every row of the input
gives one row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.arrow import text_parts

BLOCK = 1024
RATE = 8000
LPC_ORDER = 4
PRECISION = 9
CHUNK_BYTES = 1 << 20
PAD_TO = 64
U = np.uint64

#: Fixed values of the format: fixed predictors' coefficients, CRC polynomials.
FIXED = {0: (), 1: (1,), 2: (2, -1), 3: (3, -3, 1), 4: (4, -6, 4, -1)}
CRC8_POLY, CRC16_POLY = 0x07, 0x8005


def _crc_table(poly: int, bits: int) -> np.ndarray:
    top, full = 1 << (bits - 1), (1 << bits) - 1
    table = []
    for byte in range(256):
        crc = byte << (bits - 8)
        for _ in range(8):
            crc = ((crc << 1) ^ poly if crc & top else crc << 1) & full
        table.append(crc)
    return np.array(table, np.int32)


_CRC8, _CRC16 = _crc_table(CRC8_POLY, 8).tolist(), _crc_table(CRC16_POLY, 16)


def crc8(data: bytes) -> int:
    crc = 0
    for b in data:
        crc = _CRC8[crc ^ b]
    return crc


def crc16(buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-16 of many ranges at once."""
    order = np.argsort(-size, kind="stable")
    at, left = start[order], size[order]
    crc = np.zeros(len(order), np.int32)
    live = np.searchsorted(-left, -np.arange(1, int(left[0]) + 1 if len(left) else 1), "right")
    for t, n in enumerate(live.tolist()):
        c = crc[:n]
        crc[:n] = ((c & 255) << 8) ^ _CRC16[(c >> 8) ^ buf[at[:n] + t]]
    out = np.empty_like(crc)
    out[order] = crc
    return out


@lru_cache(maxsize=1 << 14)
def frame_header(number: int, size: int) -> bytes:
    code = 10 if size == BLOCK else 7
    out = bytearray((0xFF, 0xF8, code << 4 | 4, 1 << 1)) + utf8_number(number)
    if code == 7:
        out += struct.pack(">H", size - 1)
    return bytes(out) + bytes((crc8(bytes(out)),))


def utf8_number(n: int) -> bytes:
    """Frame numbers are coded like UTF-8, up to 31 bits."""
    if n < 0x80:
        return bytes((n,))
    tail = []
    more = 0
    while n >= 1 << (6 - more):
        tail.append(0x80 | n & 63)
        n >>= 6
        more += 1
    return bytes(((0xFF << (7 - more)) & 0xFF | n, *reversed(tail)))


def read_utf8_number(data: bytes, at: int) -> tuple[int, int]:
    first = data[at]
    if first < 0x80:
        return first, at + 1
    more = 0
    while first << (more + 1) & 0x80:
        more += 1
    n = first & (0x3F >> more)
    for i in range(more):
        n = n << 6 | data[at + 1 + i] & 63
    return n, at + 1 + more


def _zigzag(r: np.ndarray) -> np.ndarray:
    return (r << 1) ^ (r >> 31)


def _rice(u: np.ndarray, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rice parameter and estimated bits per frame for non-negative residuals."""
    total = np.add.reduceat(u, start, dtype=np.int64)
    mean = np.maximum(total / np.maximum(count, 1), 0.5)
    k = np.clip(np.floor(np.log2(mean * 0.98 + 0.02)), 0, 14).astype(np.int64)
    return k, count * (k + 1) + (total >> k)


def _lpc(x: np.ndarray, start: np.ndarray, frame: np.ndarray, place: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Quantised coefficients (frames x order) and shifts, by autocorrelation and Levinson-Durbin."""
    f = x.astype(np.float64)
    auto = np.zeros((len(start), order + 1))
    for lag in range(order + 1):
        prod = f[lag:] * f[: len(f) - lag] if lag else f * f
        prod = np.r_[np.zeros(lag), prod] if lag else prod
        prod[place < lag] = 0
        auto[:, lag] = np.add.reduceat(prod, start)
    auto[:, 0] = auto[:, 0] * (1 + 1e-9) + 1e-9
    a = np.zeros((len(start), order))
    err = auto[:, 0].copy()
    for i in range(order):
        k = (auto[:, i + 1] - (a[:, :i] * auto[:, i:0:-1]).sum(1)) / err
        new = a.copy()
        new[:, i] = k
        new[:, :i] = a[:, :i] - k[:, None] * a[:, :i][:, ::-1]
        a, err = new, np.maximum(err * (1 - k * k), 1e-9)
    peak = np.maximum(np.abs(a).max(1), 1e-6)
    shift = np.clip(PRECISION - 2 - np.ceil(np.log2(peak)), 0, 14).astype(np.int64)
    limit = 1 << (PRECISION - 1)
    q = np.clip(np.rint(a * (1 << shift)[:, None]), -limit, limit - 1).astype(np.int32)
    return q, shift


def encode(payloads: list[bytes], lpc_order: int = LPC_ORDER) -> list[bytes]:
    """FLAC streams of non-empty 8-bit payloads."""
    raw = np.frombuffer(b"".join(payloads), np.uint8)
    x = raw.astype(np.int32) - 128
    starts, sizes, numbers, owner = [], [], [], []
    at = 0
    for i, p in enumerate(payloads):
        for k in range(0, len(p), BLOCK):
            starts.append(at + k)
            sizes.append(min(BLOCK, len(p) - k))
            numbers.append(k // BLOCK)
            owner.append(i)
        at += len(p)
    start, size = np.array(starts), np.array(sizes)
    frame = np.repeat(np.arange(len(start)), size)
    place = np.arange(len(x)) - start[frame]

    # Candidates: (kind, order, coefficients, residuals); the cheapest by estimate stays.
    best = size * 8  # verbatim
    kind = np.zeros(len(start), np.int64)  # 0 verbatim, 1 predicted, 2 constant
    order = np.zeros(len(start), np.int64)
    param = np.zeros(len(start), np.int64)
    coded = raw.astype(np.int32)  # what is written of each sample
    res = x
    for o in range(3):
        if o:
            res = np.diff(res, prepend=np.int32(0))
        u = _zigzag(res)
        if o:
            u[place < o] = 0
        k, bits = _rice(u, start, size - o)
        bits = bits + 8 * o + 10
        better = (bits < best) & (size > o)
        if better.any():
            best = np.where(better, bits, best)
            kind[better], order[better], param[better] = 1, o, k[better]
            np.copyto(coded, u, where=better[frame] & (place >= o))
            if o:
                np.copyto(coded, raw, where=better[frame] & (place < o))
    lpc = np.zeros(len(start), bool)
    coef, shift = np.zeros((len(start), max(lpc_order, 1)), np.int32), np.zeros(len(start), np.int64)
    if lpc_order:
        o = lpc_order
        coef, shift = _lpc(x, start, frame, place, o)
        pred = np.zeros(len(x), np.int32)
        for j in range(o):
            pred[j + 1 :] += coef[:, j][frame[j + 1 :]] * x[: len(x) - j - 1]
        u = _zigzag(x - (pred >> shift.astype(np.int32)[frame]))
        u[place < o] = 0
        k, bits = _rice(u, start, size - o)
        bits = bits + 8 * o + 19 + o * PRECISION
        lpc = (bits < best) & (size > o)
        if lpc.any():
            best = np.where(lpc, bits, best)
            kind[lpc], order[lpc], param[lpc] = 1, o, k[lpc]
            np.copyto(coded, u, where=lpc[frame] & (place >= o))
            np.copyto(coded, raw, where=lpc[frame] & (place < o))
    same = np.minimum.reduceat(raw, start) == np.maximum.reduceat(raw, start)
    kind[same], order[same], lpc[same] = 2, 0, False
    np.copyto(coded, raw, where=same[frame])

    # Bits of each sample: raw ones have 8, coded ones a unary part and `param` low bits.
    rice = (kind == 1)[frame] & (place >= order[frame])
    low = np.where(rice, param[frame], 8)
    unary = np.where(rice, coded >> np.where(rice, low, 0), -1)
    raw_fix = ~rice
    coded[raw_fix] = coded[raw_fix] ^ 0x80  # two's complement of b - 128
    length = unary + 1 + low
    length[same[frame] & (place > 0)] = 0
    gap = np.where(kind == 1, 10 + lpc * (9 + order * PRECISION), 0)
    body = np.add.reduceat(length, start) + gap
    heads = [frame_header(n, s) for n, s in zip(numbers, sizes, strict=True)]
    head = np.fromiter(map(len, heads), np.int64, len(heads))
    frame_bytes = head + 1 + -(-body // 8) + 2
    base = np.cumsum(frame_bytes) - frame_bytes
    begin = (base + head + 1) * 8  # first bit after the subframe header
    inner = np.cumsum(length) - length
    pos = begin[frame] + inner - inner[start][frame] + np.where(place >= order[frame], gap[frame], 0)

    bits = np.zeros(int(frame_bytes.sum()) * 8, np.uint8)
    bits[(pos + unary)[rice]] = 1
    end = pos + length - 1
    live = length > 0
    for j in range(int(low.max())):
        on = np.flatnonzero(live & (low > j) & ((coded >> j) & 1).astype(bool))
        bits[end[on] - j] = 1

    def put(where: np.ndarray, value: np.ndarray, n: int) -> None:
        for j in range(n):
            bits[where + n - 1 - j] = (value >> j) & 1

    subtype = np.where(kind == 0, 1, np.where(kind == 2, 0, np.where(lpc, 31 + order, 8 + order)))
    put((base + head) * 8, subtype << 1, 8)
    coding = np.flatnonzero(kind == 1)
    put((begin + order * 8 + gap - 10)[coding], param[coding], 10)
    with_lpc = np.flatnonzero(lpc)
    if len(with_lpc):
        w = (begin + order * 8)[with_lpc]
        put(w, np.full(len(w), PRECISION - 1), 4)
        put(w + 4, shift[with_lpc], 5)
        for j in range(lpc_order):
            put(w + 9 + j * PRECISION, coef[with_lpc, j] & ((1 << PRECISION) - 1), PRECISION)
    buf = np.packbits(bits)
    hb = np.frombuffer(b"".join(heads), np.uint8)
    hoff = np.cumsum(head) - head
    buf[np.repeat(base - hoff, head) + np.arange(len(hb))] = hb
    crc = crc16(buf, base, frame_bytes - 2)
    buf[base + frame_bytes - 2], buf[base + frame_bytes - 1] = crc >> 8, crc & 255

    out, f = [], 0
    data, signed = buf.tobytes(), (raw ^ 0x80).tobytes()
    at = 0
    for i, p in enumerate(payloads):
        g = f
        while g < len(owner) and owner[g] == i:
            g += 1
        lo, hi = int(base[f]), int(base[g - 1] + frame_bytes[g - 1])
        fb = frame_bytes[f:g]
        points = b"".join(struct.pack(">QQH", k * BLOCK, int(base[f + k]) - lo, sizes[f + k]) for k in range(g - f))
        packed = RATE << 44 | 0 << 41 | 7 << 36 | len(p)
        info = struct.pack(">HH", BLOCK, BLOCK) + int(fb.min()).to_bytes(3, "big") + int(fb.max()).to_bytes(3, "big") + packed.to_bytes(8, "big")
        info += hashlib.md5(signed[at : at + len(p)]).digest()
        out.append(b"fLaC" + b"\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(points).to_bytes(3, "big") + points + data[lo:hi])
        f, at = g, at + len(p)
    return out


def read_metadata(stream: bytes) -> tuple[int, bytes, list[tuple[int, int, int]], int]:
    """(total samples, MD5, seek points, offset of the first frame)."""
    if stream[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, last, info, points = 4, False, b"", []
    while not last:
        last, kind, size = stream[at] >> 7 == 1, stream[at] & 127, int.from_bytes(stream[at + 1 : at + 4], "big")
        block = stream[at + 4 : at + 4 + size]
        if kind == 0:
            info = block
        elif kind == 3:
            points = [p for p in struct.iter_unpack(">QQH", block) if p[0] != 2**64 - 1]
        at += 4 + size
    packed = int.from_bytes(info[10:18], "big")
    if packed >> 41 & 7 or (packed >> 36 & 31) != 7:
        raise ValueError("only 8-bit mono streams")
    return packed & (1 << 36) - 1, info[18:34], points, at


#: Fixed values of the format: block sizes by code.
SIZES = {1: 192, **{c: 576 << (c - 2) for c in range(2, 6)}, **{c: 256 << (c - 8) for c in range(8, 16)}}


def _read_header(data: bytes, at: int) -> tuple[int, int, int]:
    """(frame number, block size, offset after the header)."""
    if data[at] != 0xFF or data[at + 1] != 0xF8:
        raise ValueError("no frame here")
    code, rate = data[at + 2] >> 4, data[at + 2] & 15
    number, end = read_utf8_number(data, at + 4)
    if code in (6, 7):
        size = int.from_bytes(data[end : end + code - 5], "big") + 1
        end += code - 5
    else:
        size = SIZES[code]
    end += {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if crc8(data[at:end]) != data[end]:
        raise ValueError("frame header CRC-8 differs")
    return number, size, end + 1


def decode_frames(data: bytes, frame_start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Samples of many frames one after another, frame sizes, and the offsets where frames end."""
    n = len(frame_start)
    buf = np.frombuffer(data + b"\0" * 16, np.uint8)
    heads = [_read_header(data, s) for s in frame_start.tolist()]
    size = np.array([h[1] for h in heads], np.int64)
    sub = np.array([h[2] for h in heads], np.int64)
    kind = buf[sub].astype(np.int64)
    if (kind & 0x81).any():
        raise ValueError("wasted bits are not supported")
    kind >>= 1
    fixed, lpc = (kind >= 8) & (kind <= 12), kind >= 32
    if (~(fixed | lpc | (kind <= 1))).any():
        raise ValueError("reserved subframe type")
    order = np.where(fixed, kind - 8, np.where(lpc, kind - 31, 0))
    out = np.zeros((int(size.max()), n), np.int32)
    pos = (sub + 1) * 8
    words = np.zeros(len(buf) - 8, U)
    for j in range(8):
        words = words << U(8) | buf[j : len(buf) - 8 + j]

    def bits(who: np.ndarray, count: int, signed: bool = False) -> np.ndarray:
        w = words[pos[who] >> 3] << (pos[who] & 7).astype(U)
        pos[who] += count
        got = (w >> U(64 - count)).astype(np.int64)
        return got - ((got >> (count - 1)) << count) if signed else got

    flat = np.flatnonzero(kind == 0)
    if len(flat):
        out[:, flat] = bits(flat, 8, True)[None, :]
    plain = np.flatnonzero(kind == 1)
    if len(plain):
        at = np.minimum(sub[plain][None, :] + 1 + np.arange(out.shape[0])[:, None], len(buf) - 1)
        out[:, plain] = buf[at].view(np.int8)
        pos[plain] += size[plain] * 8
    who = np.flatnonzero(order + fixed + lpc > 0)
    if len(who):
        who = who[np.argsort(-size[who], kind="stable")]
        _decode_predicted(words, who, size, order, fixed, lpc, out, pos, bits)
    end = -(-pos // 8) + 2
    if (crc16(buf, frame_start, end - 2 - frame_start) != (buf[end - 2].astype(np.int32) << 8 | buf[end - 1])).any():
        raise ValueError("frame CRC-16 differs")
    keep = np.arange(out.shape[0])[None, :] < size[:, None]
    return out.T[keep], size, end


def _decode_predicted(words, who, size, order, fixed, lpc, out, pos, bits) -> None:
    """One residual of every predicted frame per step; ``who`` by falling size."""
    most = int(order[who].max())
    for t in range(most):
        some = who[order[who] > t]
        out[t, some] = bits(some, 8, True)
    shift = np.zeros(len(pos), np.int64)
    coef = np.zeros((max(most, 1), len(pos)), np.int64)
    for o, c in FIXED.items():
        for j, v in enumerate(c[:most]):
            coef[j, np.flatnonzero(fixed & (order == o))] = v
    which = np.flatnonzero(lpc)
    if len(which):
        precision = bits(which, 4) + 1
        shift[which] = bits(which, 5, True)
        for j in range(int(order[which].max())):
            for p in np.unique(precision[order[which] > j]).tolist():
                some = which[(order[which] > j) & (precision == p)]
                coef[j, some] = bits(some, p, True)
    method, depth = bits(who, 2), bits(who, 4)
    if method.any():
        raise ValueError("only 4-bit Rice parameters are supported")
    part = size[who] >> depth
    change = np.zeros(int(size[who[0]]) + 1, bool)
    for p, s in {(int(p), int(s)) for p, s in zip(part, size[who], strict=True)}:
        change[0:s:p] = True
    first = order[who]
    low = np.zeros(len(who), np.int64)
    live = np.searchsorted(-size[who], -np.arange(1, int(size[who[0]]) + 1), "right").tolist()
    c, s = np.ascontiguousarray(coef[:, who]), shift[who]
    p = pos[who]
    history = np.zeros((max(most, 1), len(who)), np.int64)
    early = int(first.max()) if len(first) else 0

    def window(at: np.ndarray) -> np.ndarray:
        return words[at >> 3] << (at & 7).astype(U)

    for t, n in enumerate(live):
        q = p[:n]
        started = first[:n] <= t if t < early else None
        if change[t] or t <= early:
            new = np.flatnonzero((t % part[:n] == 0) & (first[:n] <= t) | (first[:n] == t))
            if len(new):
                low[new] = (window(q[new]) >> U(60)).astype(np.int64)
                q[new] += 4
                if (low[new] == 15).any():
                    raise ValueError("escaped partitions are not supported")
        at = q.copy()
        w = window(at)
        runs = np.zeros(n, np.int64)
        top = w >> U(12)
        if started is not None:
            top[~started] = U(1 << 51)
        empty = top == 0
        while empty.any():
            runs[empty] += 52
            at[empty] += 52
            top[empty] = window(at[empty]) >> U(12)
            empty = empty & (top == 0)
        zeros = 1074 - (top.astype(np.float64).view(np.int64) >> 52)
        runs += zeros
        at += zeros + 1
        k = low[:n]
        u = runs << k | ((window(at) >> U(1)) >> (U(63) - k.astype(U))).astype(np.int64)
        at += k
        x = (u >> 1) ^ -(u & 1)
        if most:
            x += (c[:, :n] * history[:, :n]).sum(0) >> s[:n]
        if started is not None:
            x = np.where(started, x, out[t, who[:n]])
            at = np.where(started, at, q)
        out[t, who[:n]] = x
        p[:n] = at
        if most:
            history[1:, :n] = history[:-1, :n]
            history[0, :n] = x
    pos[who] = p


def decode(streams: list[bytes]) -> tuple[list[np.ndarray], list[list[tuple[int, int]]]]:
    """Samples (int8) of each stream, and its blocks as (first sample, samples)."""
    meta = [read_metadata(s) for s in streams]
    whole = all(sum(p[2] for p in m[2]) == m[0] for m in meta)
    if whole:
        base = np.cumsum([0, *map(len, streams)])
        at = np.array([base[i] + m[3] + p[1] for i, m in enumerate(meta) for p in m[2]], np.int64)
        samples, _, _ = decode_frames(b"".join(streams), at) if len(at) else (np.zeros(0, np.int32), None, None)
        parts = np.split(samples, np.cumsum([m[0] for m in meta])[:-1]) if meta else []
        blocks = [[(p[0], p[2]) for p in m[2]] for m in meta]
    else:  # no full seek table: one frame after another
        parts, blocks = [], []
        for s, m in zip(streams, meta, strict=True):
            at, got, mine, done = m[3], [], [], 0
            while done < m[0]:
                x, size, end = decode_frames(s, np.array([at]))
                got.append(x)
                mine.append((done, int(size[0])))
                done, at = done + int(size[0]), int(end[0])
            parts.append(np.concatenate(got) if got else np.zeros(0, np.int32))
            blocks.append(mine)
    parts = [p.astype(np.int8) for p in parts]
    for p, m in zip(parts, meta, strict=True):
        if hashlib.md5(p.tobytes()).digest() != m[1]:
            raise ValueError("the samples' MD5 differs")
    return parts, blocks


def padded(text: bytes) -> bytes:
    """The payload: the text's bytes and zeros up to a positive multiple of 64."""
    return text + b"\0" * (-len(text) % PAD_TO if text else PAD_TO)


def _grouped(items: list[bytes], limit: int) -> Iterator[tuple[int, int]]:
    lo, size = 0, 0
    for i, x in enumerate(items):
        if size and size + len(x) > limit:
            yield lo, i
            lo, size = i, 0
        size += len(x)
    if items:
        yield lo, len(items)


def _encode_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, off = text_parts(batch.column(1))
        raw, off = data.tobytes(), off.tolist()
        payloads = [padded(raw[i:j]) for i, j in zip(off[:-1], off[1:], strict=True)]
        for lo, hi in _grouped(payloads, CHUNK_BYTES):
            cols = [batch.column(0).slice(lo, hi - lo), pa.array([j - i for i, j in zip(off[lo:hi], off[lo + 1 : hi + 1], strict=True)], pa.int64())]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(encode(payloads[lo:hi]), pa.binary())], names=["doc_id", "n_bytes", "flac"])


def stored_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, flac): each whole text's padded bytes as a FLAC stream."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_encode_batches, "doc_id long, n_bytes long, flac binary")


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes], list[np.ndarray], list]]:
    for batch in batches:
        streams = batch.column(batch.schema.get_field_index("flac")).to_pylist()
        for lo, hi in _grouped(streams, CHUNK_BYTES):
            yield batch.slice(lo, hi - lo), streams[lo:hi], *decode(streams[lo:hi])


def _block_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, _, parts, blocks in _streams(batches):
        rows = [(d, k, at, n, x[at : at + n].tobytes()) for d, x, b in zip(batch.column(0).to_pylist(), parts, blocks, strict=True) for k, (at, n) in enumerate(b)]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "block", "sample_offset", "n_samples", "pcm"])


def pcm_blocks(stored: DataFrame) -> DataFrame:
    """Decoded PCM, one row per block: readers seek by ``sample_offset``."""
    return stored.select("doc_id", "flac").mapInArrow(_block_batches, "doc_id long, block long, sample_offset long, n_samples long, pcm binary")


def features(samples: np.ndarray, blocks: int) -> str:
    """Level, energy, sign changes and peaks of the decoded samples."""
    x = samples.astype(np.int64)
    changes = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return f"mean={x.mean():.4f};rms={np.sqrt((x * x).mean()):.4f};zero_crossings={changes};min={x.min()};max={x.max()};blocks={blocks}"


def _digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    for batch, streams, parts, blocks in _streams(batches):
        back = [(p.view(np.uint8) ^ np.uint8(0x80)).tobytes() for p in parts]
        cols = [
            batch.column(0),
            batch.column(1),
            pa.array([len(b) for b in back], pa.int64()),
            pa.array([hashlib.sha256(b).hexdigest() for b in back]),
            pa.array([zlib.crc32(b[-PAD_TO:]) for b in back], pa.int64()),
            pa.array([len(s) for s in streams], pa.int64()),
            pa.array([hashlib.sha256(s).hexdigest() for s in streams]),
            pa.array([features(p, len(b)) for p, b in zip(parts, blocks, strict=True)]),
        ]
        yield pa.RecordBatch.from_arrays(cols, names=names)


def media_digests(stored: DataFrame) -> DataFrame:
    """Reads the stored streams back: digests of payload and stream, and features."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return stored.select("doc_id", "n_bytes", "flac").mapInArrow(_digest_batches, schema)
