"""FLAC media columns: encode, verify, decode and seek, a batch of streams at a time.

``store`` writes the bytes of a text as unsigned 8-bit samples (FLAC's signed samples, less 128) in a
mono stream with blocks of 192 samples. Each frame takes the smallest of constant, verbatim, fixed
predictors of order 0 to 2 and a linear predictor of order 4, residuals in Rice codes. A seek table has
a point for every eight frames. ``read`` decodes media bytes: it starts a lane at each seek point, checks
CRC-8 of each header, CRC-16 of each frame and the stream's MD5, and runs all lanes of a batch together,
one numpy operation for one step of every lane. ``pcm_blocks`` gives the samples as blocks with sample
and byte offsets.

The decoder takes mono streams of 8-bit samples with a fixed block size that divides the length; other
streams, damaged ones included, raise ValueError. Null and empty texts are one block of spaces; texts of
any length are streamed through in groups of about 1 MB, a longer text as a group of its own. Equal texts
give equal media. Repeated and null ids are carried through; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_blocks, text_buffer

BLOCK = 192
SEEK_EVERY = 8
RATE = 8000
LPC_ORDER, LPC_BITS = 4, 8
GROUP = 1 << 20  # bytes of text or media handled together


def _crc_table(bits: int, poly: int) -> np.ndarray:
    table = np.arange(256, dtype=np.uint32) << (bits - 8)
    for _ in range(8):
        table = np.where(table >> (bits - 1) & 1, table << 1 ^ poly, table << 1) & ((1 << bits) - 1)
    return table


CRC8, CRC16 = _crc_table(8, 0x07), _crc_table(16, 0x8005)  # FLAC's polynomials


def _crc8(rows: np.ndarray) -> np.ndarray:
    crc = np.zeros(len(rows), np.uint32)
    for j in range(rows.shape[1]):
        crc = CRC8[crc ^ rows[:, j]]
    return crc


def _crc16(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Checksums of many spans of ``data`` at once."""
    order = np.argsort(-length, kind="stable")
    start, sorted_length = start[order], length[order]
    crc = np.zeros(len(start), np.uint32)
    live = len(start)
    for j in range(int(sorted_length[0]) if live else 0):
        while live and sorted_length[live - 1] <= j:
            live -= 1
        crc[:live] = CRC16[crc[:live] >> 8 ^ data[start[:live] + j]] ^ (crc[:live] << 8 & 0xFFFF)
    out = np.empty_like(crc)
    out[order] = crc
    return out


def _coded_number(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame numbers in FLAC's UTF-8-like code: bytes (6 columns) and lengths."""
    n = numbers.astype(np.int64)
    size = np.select([n < 1 << 7, n < 1 << 11, n < 1 << 16, n < 1 << 21, n < 1 << 26], [1, 2, 3, 4, 5], 6)
    out = np.zeros((len(n), 6), np.uint8)
    for k in range(1, 7):
        rows = size == k
        if rows.any():
            x = n[rows]
            for j in range(k - 1, 0, -1):
                out[rows, j] = 0x80 | x & 0x3F
                x = x >> 6
            out[rows, 0] = x if k == 1 else (0xFF00 >> k & 0xFF) | x
    return out, size


def _fold(residual: np.ndarray) -> np.ndarray:
    return residual << 1 ^ residual >> 31


def _rice(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best of three Rice parameters around the mean, and the bits that it takes."""
    n = u.shape[1]
    guess = np.floor(np.log2(np.maximum(u.mean(1), 1))).astype(np.int32)
    best, cost = guess, np.full(len(u), 1 << 30, np.int64)
    top = u.max(1)
    for step in (-1, 0, 1):
        k = np.clip(guess + step, 0, 13)
        bits = (u >> k[:, None]).sum(1, dtype=np.int64) + n * (k + 1)
        bits[top >> k > 30] = 1 << 30
        take = bits < cost
        best, cost = np.where(take, k, best), np.where(take, bits, cost)
    return best, cost


def _predictors(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantised linear predictor of each row (Levinson-Durbin), and its shift."""
    f = x.astype(np.float64)
    r = np.stack([(f[:, j:] * f[:, : f.shape[1] - j]).sum(1) for j in range(LPC_ORDER + 1)], 1)
    error = r[:, 0] * (1 + 1e-9) + 1e-9
    a = np.zeros((len(x), LPC_ORDER))
    for i in range(LPC_ORDER):
        k = (r[:, i + 1] - (a[:, :i] * r[:, i:0:-1]).sum(1)) / error
        a[:, :i] = a[:, :i] - k[:, None] * a[:, :i][:, ::-1]
        a[:, i] = k
        error = np.maximum(error * (1 - k * k), 1e-9)
    most = np.maximum(np.abs(a).max(1), 1e-6)
    shift = np.clip(np.floor(np.log2(((1 << LPC_BITS - 1) - 1) / most)), 0, 15).astype(np.int32)
    limit = 1 << LPC_BITS - 1
    return np.clip(np.rint(a * 2.0 ** shift[:, None]), -limit, limit - 1).astype(np.int32), shift


def _frames(x: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of 192 signed samples as frames: bytes (padded rows) and lengths."""
    count = len(x)
    x = x.astype(np.int32)
    options = [(0, _fold(x))]
    d = x
    for order in (1, 2):
        d = d[:, 1:] - d[:, :-1]
        options.append((order, _fold(d)))
    coef, shift = _predictors(x)
    guess = sum(coef[:, j : j + 1] * x[:, LPC_ORDER - 1 - j : BLOCK - 1 - j] for j in range(LPC_ORDER)) >> shift[:, None]
    options.append((LPC_ORDER, _fold(x[:, LPC_ORDER:] - guess)))
    rice = [_rice(u) for _, u in options]
    cost = np.stack([bits + 8 + 8 * order + 10 + (9 + LPC_BITS * LPC_ORDER) * (i == 3) for i, ((order, _), (_, bits)) in enumerate(zip(options, rice))], 1)
    kind = cost.argmin(1)
    kind[cost.min(1) >= 8 + 8 * BLOCK] = 4  # verbatim
    kind[(x == x[:, :1]).all(1)] = 5  # constant

    header = np.zeros((count, 11), np.uint8)
    header[:, :4] = 0xFF, 0xF8, 0x10, 0x02
    code, size = _coded_number(numbers)
    header[:, 4:10] = code
    room = 8 * (11 + 2 + BLOCK + 1)
    bits = np.zeros((count, room), np.uint8)
    at = 8 * (5 + size)
    for n in np.unique(size):
        rows = np.flatnonzero(size == n)
        head = header[rows, : 4 + n]
        head = np.concatenate([head, _crc8(head)[:, None].astype(np.uint8)], 1)
        bits[rows, : 8 * (5 + n)] = np.unpackbits(head, axis=1)
    flat = bits.reshape(-1)

    def put(rows: np.ndarray, value: np.ndarray, width: int) -> None:
        base = rows * room + at[rows]
        for b in range(width):
            flat[base + b] = value >> (width - 1 - b) & 1
        at[rows] += width

    for i in range(6):
        rows = np.flatnonzero(kind == i)
        if not len(rows):
            continue
        if i >= 4:
            put(rows, np.full(len(rows), 0x02 if i == 4 else 0x00), 8)
            for j in range(BLOCK if i == 4 else 1):
                put(rows, x[rows, j], 8)
            continue
        order, u = options[i]
        put(rows, np.full(len(rows), (0x20 | order - 1) << 1 if i == 3 else (0x08 | order) << 1), 8)
        for j in range(order):
            put(rows, x[rows, j], 8)
        if i == 3:
            put(rows, np.full(len(rows), LPC_BITS - 1), 4)
            put(rows, shift[rows], 5)
            for j in range(LPC_ORDER):
                put(rows, coef[rows, j], LPC_BITS)
        put(rows, np.zeros(len(rows), np.int64), 6)  # Rice, one partition
        put(rows, rice[i][0][rows], 4)
        for k in np.unique(rice[i][0][rows]):
            some = rows[rice[i][0][rows] == k]
            v = u[some]
            quotient = v >> k
            ends = np.cumsum(quotient + (1 + k), axis=1)
            stop = (ends + (some * room + at[some])[:, None] - (1 + k)).ravel()
            flat[stop] = 1
            v = v.ravel()
            for b in range(k):
                flat[stop + 1 + b] = v >> (k - 1 - b) & 1
            at[some] += ends[:, -1]
    length = (at + 7) // 8
    rows = np.packbits(bits, axis=1)
    crc = _crc16(rows.reshape(-1), np.arange(count) * rows.shape[1], length)
    rows[np.arange(count), length] = crc >> 8
    rows[np.arange(count), length + 1] = crc & 0xFF
    return rows, length + 2


def encode(payloads: list[bytes]) -> list[bytes]:
    """FLAC streams of unsigned 8-bit payloads whose lengths are positive multiples of 192."""
    if not payloads:
        return []
    counts = np.array([len(p) // BLOCK for p in payloads])
    samples = (np.frombuffer(b"".join(payloads), np.uint8) ^ 0x80).view(np.int8).reshape(-1, BLOCK)
    first = np.cumsum(counts) - counts
    numbers = np.arange(counts.sum()) - np.repeat(first, counts)
    parts = []
    for at in range(0, len(samples), 4096):
        rows, lengths = _frames(samples[at : at + 4096], numbers[at : at + 4096])
        parts.append((rows[np.arange(rows.shape[1]) < lengths[:, None]], lengths))
    body = np.concatenate([p[0] for p in parts]).tobytes()
    ends = np.concatenate([[0], np.cumsum(np.concatenate([p[1] for p in parts]))])
    out = []
    for p, a, n in zip(payloads, first.tolist(), counts.tolist()):
        offsets = ends[a : a + n + 1] - ends[a]
        sizes = np.diff(offsets)
        digest = hashlib.md5((np.frombuffer(p, np.uint8) ^ 0x80).tobytes()).digest()
        info = struct.pack(">HH", BLOCK, BLOCK) + int(sizes.min()).to_bytes(3, "big") + int(sizes.max()).to_bytes(3, "big") + (RATE << 44 | 0 << 41 | 7 << 36 | n * BLOCK).to_bytes(8, "big") + digest
        points = b"".join(struct.pack(">QQH", j * BLOCK, offsets[j], BLOCK) for j in range(0, n, SEEK_EVERY))
        out.append(b"fLaC" + b"\x00\x00\x00\x22" + info + b"\x83" + len(points).to_bytes(3, "big") + points + body[ends[a] : ends[a + n]])
    return out


def _metadata(media: bytes) -> tuple[int, int, bytes, list[tuple[int, int]], int]:
    """Block size, samples, MD5, seek points and the first frame's offset."""
    if media[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, block, total, digest, points, last = 4, 0, 0, b"", [], False
    while not last:
        last, kind, size = media[at] >> 7 == 1, media[at] & 0x7F, int.from_bytes(media[at + 1 : at + 4], "big")
        body = media[at + 4 : at + 4 + size]
        at += 4 + size
        if kind == 0:
            low, block = struct.unpack(">HH", body[:4])
            packed = int.from_bytes(body[10:18], "big")
            total, digest = packed & (1 << 36) - 1, body[18:34]
            if low != block or packed >> 41 & 7 or (packed >> 36 & 31) != 7 or total % block:
                raise ValueError("only mono 8-bit streams of full blocks are read")
        elif kind == 3:
            points = [struct.unpack(">QQ", body[i : i + 16]) for i in range(0, size, 18) if body[i : i + 8] != b"\xff" * 8]
    return block, total, digest, points or [(0, 0)], at


class _Lanes:
    """Bit readers over one buffer, one for each lane."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        data = np.concatenate([data, np.zeros(16, np.uint8)])
        self.data = data
        self.words = np.zeros(n + 8, np.uint64)
        for j in range(8):
            self.words |= data[j : j + n + 8].astype(np.uint64) << np.uint64(56 - 8 * j)

    def peek(self, at: np.ndarray) -> np.ndarray:
        """The bits from ``at`` on, 57 of them at the left of a 64-bit word."""
        if len(at) and int(at.max()) >> 3 >= len(self.words):
            raise ValueError("stream ends within a frame")
        return self.words[at >> 3] << (at & 7).astype(np.uint64)

    def take(self, at: np.ndarray, width: int) -> np.ndarray:
        return (self.peek(at) >> np.uint64(64 - width)).astype(np.int64)

    def signed(self, at: np.ndarray, width: int) -> np.ndarray:
        return (self.peek(at).view(np.int64) >> (64 - width))

    def rice(self, at: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rice codes at ``at``: folded values and the bits that they take."""
        word = self.peek(at)
        top = word >> np.uint64(32)
        zeros = 31 - ((top.astype(np.float64).view(np.int64) >> 52) - 1023)
        far = top == 0
        if far.any():
            for i in np.flatnonzero(far):
                p = int(at[i])
                while not self.data[p >> 3] >> (7 - (p & 7)) & 1:
                    p += 1
                    if p >> 3 >= len(self.data):
                        raise ValueError("stream ends within a frame")
                zeros[i] = p - at[i]
            word = self.peek(at + zeros)
            rest = word << np.uint64(1)
        else:
            rest = word << (zeros + 1).astype(np.uint64)
        return zeros << k | ((rest >> np.uint64(1)) >> (63 - k).astype(np.uint64)).astype(np.int64), zeros + 1 + k


def decode(medias: list[bytes]) -> list[np.ndarray]:
    """Signed 8-bit samples of each stream, after all checksums."""
    if not medias:
        return []
    found = [_metadata(m) for m in medias]
    if len({f[0] for f in found}) > 1:
        out = {}
        for size in {f[0] for f in found}:
            some = [i for i, f in enumerate(found) if f[0] == size]
            out.update(zip(some, decode([medias[i] for i in some])))
        return [out[i] for i in range(len(medias))]
    block = found[0][0]
    lanes = _Lanes(np.frombuffer(b"".join(medias), np.uint8))
    base = np.cumsum([0, *map(len, medias)])
    sample0 = np.cumsum([0, *(f[1] for f in found)])
    starts, frames, target, number = [], [], [], []
    for i, (_, total, _, points, at) in enumerate(found):
        for (s, o), (t, _) in zip(points, [*points[1:], (total, 0)]):
            starts.append(base[i] + at + o)
            frames.append((t - s) // block)
            target.append((sample0[i] + s) // block)
            number.append(s // block)
    at, frames, target, number = (np.array(v, np.int64) for v in (starts, frames, target, number))
    samples = np.zeros((int(sample0[-1]) // block, block), np.int8)
    for step in range(int(frames.max()) if len(frames) else 0):
        live = np.flatnonzero(frames > step)
        samples[target[live] + step], at[live] = _decode_frame(lanes, at[live], number[live] + step, block)
    flat = samples.reshape(-1)
    out = []
    for i, (_, _, digest, _, _) in enumerate(found):
        own = flat[sample0[i] : sample0[i + 1]]
        if digest != bytes(16) and hashlib.md5(own.tobytes()).digest() != digest:
            raise ValueError("samples don't have the stream's MD5")
        out.append(own)
    return out


def _decode_frame(lanes: _Lanes, start: np.ndarray, number: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """The frame at each lane's byte offset, and the offset after it."""
    n = len(start)
    head = lanes.take(start * 8, 32)
    if (head >> 16 != 0xFFF8).any() or (head >> 4 & 15).any() or (head & 1).any() or ((head >> 1 & 7) % 3 != 1).any() and ((head >> 1 & 7) != 0).any():
        raise ValueError("no frame header at a lane's place")
    code, size = _coded_number(number)
    extra = np.select([(head >> 12 & 15) == 6, (head >> 12 & 15) == 7], [1, 2], 0)
    rate = head >> 8 & 15
    extra = extra + np.select([rate == 12, (rate == 13) | (rate == 14)], [1, 2], 0)
    for j in range(6):
        own = size > j
        if (lanes.data[start[own] + 4 + j] != code[own, j]).any():
            raise ValueError("a frame's number is not the expected one")
    length = 4 + size + extra
    for k in np.unique(length):
        rows = np.flatnonzero(length == k)
        if (_crc8(lanes.data[start[rows, None] + np.arange(k)]) != lanes.data[start[rows] + k]).any():
            raise ValueError("a frame header fails its CRC-8")
    at = (start + length + 1) * 8
    kind = lanes.take(at, 8) >> 1
    at = at + 8
    x = np.zeros((n, block), np.int64)
    order = np.full(n, -1)
    order[kind >> 3 == 1] = kind[kind >> 3 == 1] & 7
    order[kind >= 32] = (kind[kind >= 32] & 31) + 1
    if ((order < 0) & (kind > 1)).any() or ((kind < 32) & (order > 4)).any():
        raise ValueError("reserved subframe type")
    rows = np.flatnonzero(kind == 0)
    if len(rows):
        x[rows] = lanes.signed(at[rows], 8)[:, None]
        at[rows] += 8
    rows = np.flatnonzero(kind == 1)
    if len(rows):
        for j in range(block):
            x[rows, j] = lanes.signed(at[rows], 8)
            at[rows] += 8
    rows = np.flatnonzero(order >= 0)
    if len(rows):
        x[rows], at[rows] = _decode_residual(lanes, at[rows], order[rows], kind[rows] >= 32, block)
    end = (at + 7) // 8
    if (_crc16(lanes.data, start, end - start) != lanes.take(end * 8, 16)).any():
        raise ValueError("a frame fails its CRC-16")
    if len(x) and (x.min() < -128 or x.max() > 127):
        raise ValueError("a sample has more than 8 bits")
    return x.astype(np.int8), end + 2


def _decode_residual(lanes: _Lanes, at: np.ndarray, order: np.ndarray, linear: np.ndarray, block: int):
    n = len(at)
    x = np.zeros((n, block), np.int64)
    for j in range(int(order.max())):
        own = np.flatnonzero(order > j)
        x[own, j] = lanes.signed(at[own], 8)
        at[own] += 8
    coef, shift = np.zeros((n, 32), np.int64), np.zeros(n, np.int64)
    rows = np.flatnonzero(linear)
    if len(rows):
        width = lanes.take(at[rows], 4) + 1
        shift[rows] = lanes.signed(at[rows] + 4, 5)
        at[rows] += 9
        for j in range(int(order[rows].max())):
            own = order[rows] > j
            some = rows[own]
            coef[some, j] = lanes.peek(at[some]).view(np.int64) >> (64 - width[own])
            at[some] += width[own]
    method = lanes.take(at, 2)
    if (method > 1).any():
        raise ValueError("reserved residual code")
    parts = block >> lanes.take(at + 2, 4)
    at = at + 6
    wide = 4 + method
    k, raw = np.zeros(n, np.int64), np.full(n, -1)
    split = (parts < block).any()
    fewest = int(order.min())
    for i in range(fewest, block):
        fresh = (i == order) if i <= order.max() else np.zeros(n, bool)
        if split:
            fresh = fresh | ((i > order) & (i % parts == 0))
        if fresh.any():
            own = np.flatnonzero(fresh)
            k[own] = lanes.peek(at[own]) >> (64 - wide[own]).astype(np.uint64)
            at[own] += wide[own]
            escape = k[own] == (1 << wide[own]) - 1
            raw[own] = -1
            if escape.any():
                some = own[escape]
                raw[some] = lanes.take(at[some], 5)
                at[some] += 5
        if i < order.max() or (raw >= 0).any():
            coded, plain = np.flatnonzero((order <= i) & (raw < 0)), np.flatnonzero((order <= i) & (raw > 0))
            u, bits = lanes.rice(at[coded], k[coded])
            x[coded, i] = u >> 1 ^ -(u & 1)
            at[coded] += bits
            x[plain, i] = lanes.peek(at[plain]).view(np.int64) >> (64 - raw[plain])
            at[plain] += raw[plain]
        else:
            u, bits = lanes.rice(at, k)
            x[:, i] = u >> 1 ^ -(u & 1)
            at = at + bits
    for o in range(1, 5):  # fixed predictors are repeated sums
        rows = np.flatnonzero(~linear & (order == o))
        if len(rows):
            y = x[rows]
            warm = y[:, :o]
            lead = [warm]
            for _ in range(o):
                lead.append(np.diff(lead[-1], axis=1))
            d = y[:, o:]
            for level in range(o - 1, -1, -1):
                d = np.cumsum(np.concatenate([lead[level][:, -1:], d], 1), axis=1)[:, 1:]
            x[rows, o:] = d
    for o in np.unique(order[linear]):
        rows = np.flatnonzero(linear & (order == o))
        y, c, s = x[rows], coef[rows, :o], shift[rows]
        for i in range(o, block):
            y[:, i] += (c * y[:, i - o : i][:, ::-1]).sum(1) >> s
        x[rows] = y
    return x, at


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_buffer(batch.column(1))
        for a, b in row_blocks(offsets, GROUP):
            texts = [data[offsets[i] : offsets[i + 1]].tobytes() for i in range(a, b)]
            media = encode([t.ljust(max(1, -(-len(t) // BLOCK)) * BLOCK) for t in texts])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])


def block_places(media: bytes, n: int, frames_a_block: int) -> list[tuple[int, int | None]]:
    """First sample of each block of a stream of n samples, and the byte offset of its frame where the seek table has it."""
    block, _, _, points, at = _metadata(media)
    offset = dict(points)
    return [(i, at + offset[i] if i in offset else None) for i in range(0, n, block * frames_a_block)]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        media = batch.column(2).to_pylist()
        for a, b in row_blocks(np.cumsum([0, *map(len, media)]), GROUP):
            samples = decode(media[a:b])
            rows: dict[str, list] = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pcm_blocks", "last_block_offset")}
            for x, m in zip(samples, media[a:b]):
                payload = (x.view(np.uint8) ^ 0x80).tobytes()
                wide = x.astype(np.int32)
                rows["payload_bytes"].append(len(payload))
                rows["payload_sha256"].append(hashlib.sha256(payload).hexdigest())
                rows["tail_crc32"].append(zlib.crc32(payload[-16:]))
                rows["media_bytes"].append(len(m))
                rows["media_sha256"].append(hashlib.sha256(m).hexdigest())
                rows["feature"].append(f"peak={int(np.abs(wide).max())};energy={int((wide * wide).sum(dtype=np.int64))};sum={int(wide.sum(dtype=np.int64))};crossings={int(((x[1:] < 0) != (x[:-1] < 0)).sum())}")
                places = block_places(m, len(x), SEEK_EVERY)
                rows["pcm_blocks"].append(len(places))
                rows["last_block_offset"].append(places[-1][1])
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).slice(a, b - a), "n_bytes": batch.column(1).slice(a, b - a)} | {k: pa.array(v, pa.string() if isinstance(v[0], str) else pa.int64()) for k, v in rows.items()})


def _blocks(frames_a_block: int):
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, media in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if media is None:
                    continue
                samples = decode([media])[0]
                places = block_places(media, len(samples), frames_a_block)
                step = places[1][0] if len(places) > 1 else len(samples)
                firsts = [i for i, _ in places]
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(firsts), pa.int64()), pa.array(range(len(firsts)), pa.int64()), pa.array(firsts, pa.int64()), pa.array([o for _, o in places], pa.int64()), pa.array([samples[i : i + step].tobytes() for i in firsts], pa.binary())], ["doc_id", "block", "first_sample", "byte_offset", "pcm"])

    return blocks


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the FLAC stream (media) of every text, padded with spaces to whole blocks."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(_store, "doc_id long, n_bytes long, media binary")


def read(media: DataFrame) -> DataFrame:
    """Decode, verify and describe the streams that ``store`` returns, one row each: digests, features, and how many PCM blocks it gives and where the last one's frame begins."""
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_read, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pcm_blocks long, last_block_offset long")


def pcm_blocks(media: DataFrame, frames_a_block: int = SEEK_EVERY) -> DataFrame:
    """Decoded signed 8-bit samples in blocks: doc_id, block, first_sample, byte_offset (of the frame in the stream, where the seek table has it), pcm. A null stream has none."""
    return media.select("doc_id", "media").mapInArrow(_blocks(frames_a_block), "doc_id long, block long, first_sample long, byte_offset long, pcm binary")
