"""Lossless media columns in FLAC: an encoder, and a decoder that checks everything.

Payloads are stored as mono 8-bit samples in frames of 576, each with a fixed
or second-order linear predictor (or a constant) and Rice-coded residuals in
four partitions. A seek table holds the sample offset and byte offset of every
frame. The decoder reads the metadata, starts at all seek points at once, steps
through the Rice codes of many frames in parallel, runs the predictors (fixed,
or linear of any order), and verifies the header's CRC-8, the frame's CRC-16 and
the stream's MD5. It returns PCM blocks with their sample offsets.

Both work on arrays: a step handles one code of up to FRAMES frames, and no more
than FRAMES frames are unpacked at a time, however long a text is.

Cases: a null text is empty, and its payload one frame of bytes 255; equal texts
give equal bytes; a null or broken stream raises ValueError in the decoder
functions; repeated rows and an empty table need no care; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK, RATE = 576, 8000
#: Frames that are unpacked at a time, and seek points that a metadata block has room for.
FRAMES, POINTS = 2600, ((1 << 24) - 1) // 18
#: Coefficients of the fixed predictors of order 0 to 4 (as the format has them).
FIXED = [(), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1)]
PARTITIONS, LPC_SHIFT, LPC_BITS = 4, 7, 10


@lru_cache(2)
def crc_table(width: int, poly: int) -> np.ndarray:
    out = np.zeros(256, np.uint16)
    for b in range(256):
        r = b << (width - 8)
        for _ in range(8):
            r = (r << 1 ^ (poly if r >> (width - 1) & 1 else 0)) & ((1 << width) - 1)
        out[b] = r
    return out


def crc(data: np.ndarray, start: np.ndarray, end: np.ndarray, width: int) -> np.ndarray:
    """CRC-8 (0x07) or CRC-16 (0x8005) of data[start:end] for all ranges, a byte of each at a step."""
    table = crc_table(width, 0x07 if width == 8 else 0x8005)
    order = np.argsort(start - end, kind="stable")
    a, size = start[order], (end - start)[order]
    value = np.zeros(len(a), np.uint16)
    active = np.searchsorted(-size, -np.arange(int(size.max(initial=0))), side="left")
    for t, n in enumerate(active.tolist()):
        v, byte = value[:n], data[a[:n] + t]
        value[:n] = table[v ^ byte] if width == 8 else (v << 8) ^ table[(v >> 8) ^ byte]
    out = np.empty_like(value)
    out[order] = value
    return out


def coded_number(n: int) -> bytes:
    """A frame number in the format's extension of UTF-8."""
    if n < 0x80:
        return bytes([n])
    tail = []
    while n >= 1 << (6 - len(tail)):
        tail.append(0x80 | n & 0x3F)
        n >>= 6
    return bytes([(0xFF << (7 - len(tail)) & 0xFF) | n, *reversed(tail)])


def _predict(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Residuals of the best predictor of each frame, its order (5: linear of order 2), and linear coefficients."""
    best = x.copy()
    order = np.zeros(len(x), np.int64)
    d = x
    cost = np.abs(x).sum(1)
    for o in range(1, 5):
        d = np.diff(d, axis=1)
        c = np.abs(d).sum(1) + np.abs(x[:, :o]).sum(1)
        better = c < cost
        cost[better], order[better] = c[better], o
        best[better, o:] = d[better]
    f = x.astype(np.float64)
    r0, r1, r2 = (np.einsum("ij,ij->i", f[:, k:], f[:, : BLOCK - k]) for k in (0, 1, 2))
    below = np.maximum(r0 * r0 - r1 * r1, 1e-9)
    top = (1 << (LPC_BITS - 1)) - 1
    coef = np.clip(np.rint(np.stack([r1 * (r0 - r2) / below, (r0 * r2 - r1 * r1) / below], 1) * (1 << LPC_SHIFT)), -top, top).astype(np.int64)
    e = x[:, 2:] - ((coef[:, :1] * x[:, 1:-1] + coef[:, 1:] * x[:, :-2]) >> LPC_SHIFT)
    better = np.abs(e).sum(1) + np.abs(x[:, :2]).sum(1) < cost
    order[better] = 5
    best[better, 2:] = e[better]
    best[better, :2] = x[better, :2]
    return best, order, coef


def encode_frames(data: np.ndarray, numbers: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The frames of ``data`` (rows of BLOCK bytes), one after the other, and their sizes in bytes."""
    n = len(data)
    x = data.astype(np.int64) - 128
    residual, order, coef = _predict(x)
    constant = (x == x[:, :1]).all(1)
    warm = np.where(order == 5, 2, order)
    u = np.where(residual < 0, -2 * residual - 1, 2 * residual)
    size = BLOCK // PARTITIONS
    inside = np.arange(BLOCK)[None, :] >= warm[:, None]
    total = (u * inside).reshape(n, PARTITIONS, size).sum(2)
    k = np.clip(np.floor(np.log2(np.maximum(total / size * 0.7, 1))), 0, 14).astype(np.int64)
    kk = np.repeat(k, size, axis=1)
    # fields, in order: (value, bits) of header, subframe header, warm-up, and for each partition its parameter and codes
    heads = [b"\xff\xf8\x24\x02" + coded_number(int(i)) for i in numbers]
    head_size = np.fromiter(map(len, heads), np.int64, n)
    flat = np.frombuffer(b"".join(heads), np.uint8)
    ends = np.cumsum(head_size)
    check = crc(flat, ends - head_size, ends, 8)
    kind = np.where(constant, 0, np.where(order == 5, 0x20 | 1, 8 | order)) << 1
    values = np.zeros((n, 7 + BLOCK + PARTITIONS), np.int64)
    bits = np.zeros_like(values)
    coded = ~constant
    values[:, 0], bits[:, 0] = kind, 8
    # up to four warm-up samples, or the constant
    for j in range(4):
        on = (warm > j) & coded | constant & (j == 0)
        values[:, 1 + j], bits[:, 1 + j] = np.where(on, x[:, j] & 0xFF, 0), np.where(on, 8, 0)
    lpc = coded & (order == 5)
    low = (1 << LPC_BITS) - 1
    values[:, 5] = np.where(lpc, (LPC_BITS - 1) << 25 | LPC_SHIFT << 20 | (coef[:, 0] & low) << 10 | coef[:, 1] & low, 0)
    bits[:, 5] = np.where(lpc, 9 + 2 * LPC_BITS, 0)
    values[:, 6], bits[:, 6] = np.where(coded, PARTITIONS.bit_length() - 1, 0), np.where(coded, 6, 0)
    codes = (values[:, 7:].reshape(n, PARTITIONS, size + 1), bits[:, 7:].reshape(n, PARTITIONS, size + 1))
    codes[0][:, :, 0], codes[1][:, :, 0] = k * coded[:, None], 4 * coded[:, None]
    on = (inside & coded[:, None]).reshape(n, PARTITIONS, size)
    codes[0][:, :, 1:] = np.where(on, ((1 << kk) | (u & ((1 << kk) - 1))).reshape(on.shape), 0)
    codes[1][:, :, 1:] = np.where(on, ((u >> kk) + 1 + kk).reshape(on.shape), 0)
    body = bits.sum(1)
    frame = head_size + 1 + (body + 7) // 8 + 2
    start = np.cumsum(frame) - frame
    end = np.cumsum(bits, axis=1) + ((start + head_size + 1) * 8)[:, None]
    used = bits > 0
    last = end[used] - 1
    value = values[used].astype(np.uint64) << (31 - (last & 31)).astype(np.uint64)
    words = int(frame.sum()) // 4 + 2
    word = (last >> 5) + 1
    packed = np.bincount(word, weights=(value & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=words + 1)
    packed += np.bincount(word - 1, weights=(value >> np.uint64(32)).astype(np.float64), minlength=words + 1)
    out = packed[1:].astype(">u4").view(np.uint8)[: int(frame.sum())].copy()
    where = np.arange(len(flat)) + np.repeat(start - (ends - head_size), head_size)
    out[where] = flat
    out[start + head_size] = check
    stop = start + frame
    sums = crc(out, start, stop - 2, 16)
    out[stop - 2], out[stop - 1] = sums >> 8, sums & 0xFF
    return out.tobytes(), frame


def encode_streams(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream for each payload, whose size must be a positive multiple of BLOCK."""
    data = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, BLOCK)
    count = np.fromiter((len(p) // BLOCK for p in payloads), np.int64, len(payloads))
    number = np.arange(len(data)) - np.repeat(np.cumsum(count) - count, count)
    done = [encode_frames(data[at : at + FRAMES], number[at : at + FRAMES]) for at in range(0, len(data), FRAMES)]
    body, sizes = b"".join(d[0] for d in done), np.concatenate([d[1] for d in done])
    stop = np.cumsum(sizes)
    out, frame = [], 0
    for payload, n in zip(payloads, count.tolist(), strict=True):
        own = sizes[frame : frame + n]
        at = int(stop[frame] - own[0])
        digest = hashlib.md5((np.frombuffer(payload, np.uint8) ^ 0x80).tobytes()).digest()
        packed = RATE << 44 | 0 << 41 | 7 << 36 | len(payload)
        info = struct.pack(">HH", BLOCK, BLOCK) + int(own.min()).to_bytes(3, "big") + int(own.max()).to_bytes(3, "big") + packed.to_bytes(8, "big") + digest
        points = np.zeros(min(n, POINTS), [("sample", ">u8"), ("offset", ">u8"), ("size", ">u2")])
        points["sample"], points["size"] = np.arange(len(points)) * BLOCK, BLOCK
        points["offset"] = (stop[frame : frame + n] - own - at)[: len(points)]
        seek = points.tobytes()
        out.append(b"fLaC" + b"\0" + len(info).to_bytes(3, "big") + info + b"\x83" + len(seek).to_bytes(3, "big") + seek + body[at : at + int(own.sum())])
        frame += n
    return out


def metadata(stream: bytes) -> tuple[dict, int]:
    """STREAMINFO with the seek points of a stream, and where its first frame starts."""
    if stream[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, info = 4, {"points": [(0, 0)]}
    while True:
        head, size = stream[at], int.from_bytes(stream[at + 1 : at + 4], "big")
        block = stream[at + 4 : at + 4 + size]
        if head & 0x7F == 0:
            packed = int.from_bytes(block[10:18], "big")
            info |= {"block": int.from_bytes(block[2:4], "big"), "channels": (packed >> 41 & 7) + 1, "bits": (packed >> 36 & 31) + 1, "samples": packed & ((1 << 36) - 1), "md5": block[18:34]}
        elif head & 0x7F == 3:
            points = np.frombuffer(block, [("sample", ">u8"), ("offset", ">u8"), ("size", ">u2")])
            points = points[points["sample"] != (1 << 64) - 1]
            info["points"] = sorted({(0, 0)} | set(zip(points["sample"].tolist(), points["offset"].tolist(), strict=True)))
        at += 4 + size
        if head & 0x80:
            break
    if info.get("bits") != 8 or info.get("channels") != 1 or info.get("block") != BLOCK or info["samples"] % BLOCK:
        raise ValueError("only mono streams of 8 bits in whole blocks of 576 are read")
    return info, at


class _Bits:
    """Bits of a buffer for many readers at once."""

    def __init__(self, data: np.ndarray):
        self.data = np.concatenate([data, np.zeros(16, np.uint8)])
        wide = self.data.astype(np.int64)
        self.word = wide[:-3] << 24 | wide[1:-2] << 16 | wide[2:-1] << 8 | wide[3:]
        set_ = np.unpackbits(self.data)
        at = np.where(set_, np.arange(len(set_), dtype=np.int32), np.int32(len(set_) - 1))
        self.next_one = np.minimum.accumulate(at[::-1])[::-1]

    def get(self, pos: np.ndarray, n) -> np.ndarray:
        """n bits (up to 25) at each position, unsigned."""
        return (self.word[pos >> 3] << (pos & 7) & 0xFFFFFFFF) >> (32 - n)


def decode_frames(data: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The samples, frame numbers and end offsets of the frames that start at the given bytes."""
    try:
        return _decode_frames(data, start)
    except IndexError:
        raise ValueError("a frame's codes run beyond the stream; its CRC-16 can't fit") from None


def _decode_frames(data: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    bits, n = _Bits(data), len(start)
    if (bits.word[start] != 0xFFF82402).any():
        raise ValueError("a frame header is missing or of another kind")
    lead = bits.data[start + 4].astype(np.int64)
    tail = np.where(lead < 0x80, 0, 7 - np.floor(np.log2(np.maximum(lead ^ 0xFF, 1))).astype(np.int64) - 1)
    number = np.where(lead < 0x80, lead, lead & ((1 << np.maximum(6 - tail, 0)) - 1))
    for j in range(int(tail.max(initial=0))):
        on = tail > j
        number = np.where(on, number << 6 | bits.data[start + 5 + np.minimum(j, 6)] & 0x3F, number)
    body = start + 5 + tail
    if (crc(bits.data, start, body, 8) != bits.data[body]).any():
        raise ValueError("a frame header's CRC-8 does not fit")
    pos = (body + 1) * 8
    kind = bits.get(pos, 8) >> 1
    pos = pos + 8
    constant, verbatim, linear = kind == 0, kind == 1, kind >= 32
    fixed = (kind >= 8) & (kind <= 12)
    if not (constant | verbatim | linear | fixed).all():
        raise ValueError("a reserved subframe type")
    order = np.where(linear, (kind & 31) + 1, np.where(fixed, kind & 7, 0))
    deep = int(order.max(initial=0))
    out = np.zeros((n, BLOCK), np.int64)
    signed = lambda v, w: v - ((v >> (w - 1) & 1) << w)
    for j in range(deep):
        on = order > j
        out[on, j] = signed(bits.get(pos[on], 8), 8)
        pos = pos + 8 * on
    coef, shift = np.zeros((n, deep), np.int64), np.zeros(n, np.int64)
    for o in range(1, 5):
        coef[np.ix_(fixed & (order == o), range(min(o, deep)))] = FIXED[o][:deep] if deep >= o else 0
    if linear.any():
        width = np.where(linear, bits.get(pos, 4) + 1, 1)
        shift = np.where(linear, bits.get(pos + 4, 5), 0)
        pos = pos + 9 * linear
        for j in range(deep):
            on = linear & (order > j)
            coef[on, j] = signed(bits.get(pos[on], width[on]), width[on])
            pos = pos + width * on
    if constant.any():
        out[constant] = signed(bits.get(pos[constant], 8), 8)[:, None]
        pos = pos + 8 * constant
    coded = fixed | linear
    method, parts = bits.get(pos, 2), np.where(coded, bits.get(pos + 2, 4), 0)
    if (coded & (method > 1)).any():
        raise ValueError("a reserved residual coding")
    each = BLOCK >> parts
    pos = pos + 6 * coded
    k, raw, plain = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
    if verbatim.any():
        for t in range(BLOCK):
            out[verbatim, t] = signed(bits.get(pos[verbatim], 8), 8)
            pos = pos + 8 * verbatim
    group = np.flatnonzero(coded)
    p, size, warm = pos[group], each[group], order[group]
    wide = method[group] + 4
    k, plain, raw = (np.zeros(len(group), x) for x in (np.int64, bool, np.int64))
    rest = np.zeros((BLOCK, len(group)), np.int64)
    least, most = int(warm.min(initial=BLOCK)), int(warm.max(initial=0))
    alike = len(np.unique(size)) == 1
    for t in range(BLOCK):
        if not alike or t % size[0] == 0:
            new = t % size == 0
            param = bits.get(p, wide)
            k = np.where(new, param, k)
            plain = np.where(new, param == (1 << wide) - 1, plain)
            p = p + wide * new
            raw = np.where(new & plain, bits.get(p, 5), raw)
            p = p + 5 * (new & plain)
            escapes = plain.any()
        if t < least:
            continue
        stop = bits.next_one[p]
        low = stop + 1
        value = (stop - p) << k | (bits.word[low >> 3] << (low & 7) & 0xFFFFFFFF) >> (32 - k)
        value = value >> 1 ^ -(value & 1)
        after = low + k
        if escapes:
            value = np.where(plain, np.where(raw > 0, signed(bits.get(p, np.maximum(raw, 1)), np.maximum(raw, 1)), 0), value)
            after = np.where(plain, p + raw, after)
        if t < most:
            on = warm <= t
            value, after = np.where(on, value, 0), np.where(on, after, p)
        rest[t], p = value, after
    pos[group] = p
    if deep:
        line = np.ascontiguousarray(out[group].T)
        own, down = np.ascontiguousarray(coef[group].T), shift[group]
        for t in range(BLOCK):
            m = min(deep, t)
            told = sum((own[j] * line[t - 1 - j] for j in range(m)), np.zeros(len(group), np.int64)) >> down
            line[t] = np.where(warm <= t, rest[t] + told, line[t]) if t < most else rest[t] + told
        out[group] = line.T
    elif len(group):
        out[group] = rest.T
    end = (pos + 7) // 8
    sums = bits.data[end].astype(np.int64) << 8 | bits.data[end + 1]
    if (end + 2 > len(data)).any() or (crc(bits.data, start, end, 16) != sums).any():
        raise ValueError("a frame's CRC-16 does not fit")
    return out, number, end + 2


def decode_streams(streams: list[bytes]) -> list[list[tuple[int, bytes]]]:
    """For each stream its PCM blocks: (sample offset, samples as unsigned bytes)."""
    infos, begin, base = [], [], 0
    for s in streams:
        info, first = metadata(s)
        infos.append(info)
        begin.append(base + first)
        base += len(s)
    data = np.frombuffer(b"".join(streams), np.uint8)
    which = np.repeat(np.arange(len(streams)), [len(i["points"]) for i in infos])
    sample = np.fromiter((p[0] for i in infos for p in i["points"]), np.int64, len(which))
    at = np.fromiter((p[1] for i in infos for p in i["points"]), np.int64, len(which)) + np.array(begin, np.int64)[which]
    # where the next seek point or the stream ends: a segment is read until then
    until = np.append(sample[1:], 0)
    final = np.append(which[1:] != which[:-1], True)
    until[final] = np.array([i["samples"] for i in infos])[which[final]]
    blocks: list[dict[int, bytes]] = [{} for _ in streams]
    while len(which):
        going = []
        for c in range(0, len(which), FRAMES):
            w, s, a = which[c : c + FRAMES], sample[c : c + FRAMES], at[c : c + FRAMES]
            low = int(a.min())
            high = min(len(data), int(a.max()) + 4 * BLOCK)
            out, number, end = decode_frames(data[low:high], a - low)
            if (number * BLOCK != s).any():
                raise ValueError("a frame number and its place do not fit")
            pcm = (out + 128).astype(np.uint8).tobytes()
            for j, (stream, offset) in enumerate(zip(w.tolist(), s.tolist(), strict=True)):
                blocks[stream][offset] = pcm[j * BLOCK : (j + 1) * BLOCK]
            going.append(end + low)
        at, sample = np.concatenate(going), sample + BLOCK
        more = sample < until
        which, sample, at, until = which[more], sample[more], at[more], until[more]
    result = []
    for info, own in zip(infos, blocks, strict=True):
        found = sorted(own.items())
        whole = b"".join(b for _, b in found)
        if len(whole) != info["samples"] or hashlib.md5((np.frombuffer(whole, np.uint8) ^ 0x80).tobytes()).digest() != info["md5"]:
            raise ValueError("the stream's samples and its MD5 do not fit")
        result.append(found)
    return result


def features(payload: bytes) -> str:
    """Mean and root mean square in thousandths, zero crossings, and the lowest and highest sample, all signed."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    up = x >= 0
    return f"mean={int(x.sum()) * 1000 // len(x)};rms={int((int((x * x).sum()) * 10**6 / len(x)) ** 0.5)};crossings={int((up[1:] != up[:-1]).sum())};low={x.min()};high={x.max()}"


def padded(text: str | None) -> tuple[int, bytes]:
    """UTF-8 size of a text, and its bytes filled up with 255 to a positive multiple of BLOCK."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return len(data), data + b"\xff" * (-len(data) % BLOCK or (0 if data else BLOCK))


def _groups(items: list, limit: int = 8 << 20) -> Iterator[tuple[int, list]]:
    """(index of the first, items) of runs of about ``limit`` bytes."""
    first, part, size = 0, [], 0
    for i, x in enumerate(items):
        part.append(x)
        size += len(x)
        if size >= limit:
            yield first, part
            first, part, size = i + 1, [], 0
    if part:
        yield first, part


def encode(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each text (null: empty) as a FLAC stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, payloads = [], []
            for t in b.column("text").to_pylist():
                n, p = padded(t)
                sizes.append(n)
                payloads.append(p)
            for first, part in _groups(payloads):
                media = pa.array(encode_streams(part), pa.binary())
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(first, len(part)), pa.array(sizes[first : first + len(part)], pa.int64()), media], ["doc_id", "n_bytes", "media"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, n_bytes long, media binary")


def decode(streams: DataFrame) -> DataFrame:
    """``streams`` with blocks (array of sample_offset, n_samples, pcm) and feature, from the column media."""
    own = streams.drop("blocks", "feature")
    block = pa.struct([("sample_offset", pa.int64()), ("n_samples", pa.int32()), ("pcm", pa.binary())])
    names = own.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, part in _groups(b.column("media").to_pylist()):
                found = decode_streams(part)
                rows = [[{"sample_offset": at, "n_samples": len(x), "pcm": x} for at, x in own] for own in found]
                told = [features(b"".join(x for _, x in own)) for own in found]
                kept = b.slice(first, len(part))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(rows, pa.list_(block)), pa.array(told)], [*names, "blocks", "feature"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema)
    return own.mapInArrow(run, f"{schema}, blocks array<struct<sample_offset: bigint, n_samples: int, pcm: binary>>, feature string")


def op6_flac(spark, sf_dir: str) -> DataFrame:
    stored = encode(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    # latin-1 text keeps every byte, so joining the blocks' samples takes one pass
    joined = F.expr("encode(array_join(transform(blocks, b -> decode(b.pcm, 'ISO-8859-1')), ''), 'ISO-8859-1')")
    back = decode(stored).withColumn("payload", joined)
    return back.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -32, 32)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )
