import zlib

import numpy as np
import pytest

from tidemark.llm import flac

from .helpers import documents, frame


def signals():
    rng = np.random.default_rng(1)
    yield bytes(192)
    yield bytes(range(192)) * 5
    yield rng.integers(0, 256, 192 * 40, dtype=np.uint8).tobytes()
    yield (128 + 100 * np.sin(np.arange(192 * 30) / 9)).astype(np.uint8).tobytes()
    yield (np.cumsum(rng.integers(-2, 3, 192 * 9)) % 256).astype(np.uint8).tobytes()
    yield b"the quick brown fox ".ljust(192) * 300


def test_round_trip_of_all_frame_kinds():
    data = list(signals())
    media = flac.encode(data)
    assert [(x.view(np.uint8) ^ 0x80).tobytes() for x in flac.decode(media)] == data
    assert len(media[3]) < 0.8 * len(data[3])  # a sine is predicted


def test_streams_without_seek_table_and_with_sizes_mixed():
    data = list(signals())
    media = flac.encode(data)
    bare = [m[:4] + b"\x80" + m[5:42] + m[42 + 4 + int.from_bytes(m[43:46], "big") :] for m in media]
    assert [(x.view(np.uint8) ^ 0x80).tobytes() for x in flac.decode(bare)] == data


@pytest.mark.parametrize("place", [-1, -2, -60, 30])
def test_damage_is_found(place):
    media = bytearray(flac.encode([b"some text or other".ljust(192) * 4])[0])
    media[place] ^= 1
    with pytest.raises(ValueError):
        flac.decode([bytes(media)])


def test_cut_stream_is_found():
    media = flac.encode([bytes(np.random.default_rng(2).integers(0, 256, 1920, dtype=np.uint8))])[0]
    with pytest.raises(ValueError):
        flac.decode([media[: len(media) // 2]])
    with pytest.raises(ValueError):
        flac.decode([b"RIFF" + media[4:]])


def test_store_read_and_blocks(spark):
    rows = documents() + [(None, "no id"), (4, "again"), (4, "again")]
    media = flac.store(frame(spark, rows)).cache()
    read = {(r.doc_id, r.payload_sha256): r for r in flac.read(media).collect()}
    import hashlib

    for i, t in rows:
        b = (t or "").encode()
        p = b.ljust(max(1, -(-len(b) // 192)) * 192)
        r = read[i, hashlib.sha256(p).hexdigest()]
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(b), len(p), zlib.crc32(p[-16:]))
        assert r.pcm_blocks == -(-len(p) // (8 * 192)) and r.last_block_offset > 0
    blocks = flac.pcm_blocks(media.filter("doc_id = 9")).orderBy("block").collect()
    stream = media.filter("doc_id = 9").first().media
    text = (dict(rows)[9] or "").encode()
    got = b"".join((np.frombuffer(b.pcm, np.uint8) ^ 0x80).tobytes() for b in blocks)
    assert got.rstrip(b" ") == text.rstrip(b" ")
    assert all(stream[b.byte_offset : b.byte_offset + 2] == b"\xff\xf8" and b.first_sample == b.block * 8 * 192 for b in blocks)
    assert flac.read(flac.store(frame(spark, []))).collect() == []


def bits(*fields):
    """(value, width) pairs as a string of bits."""
    return "".join(format(v & (1 << w) - 1, f"0{w}b") for v, w in fields)


def checksum(data, width, poly):
    """A CRC bit by bit."""
    crc = 0
    for byte in data:
        for i in range(7, -1, -1):
            top = crc >> (width - 1) ^ byte >> i & 1
            crc = (crc << 1 ^ (poly if top & 1 else 0)) & (1 << width) - 1
    return crc


def packed(text):
    text += "0" * (-len(text) % 8)
    return bytes(int(text[i : i + 8], 2) for i in range(0, len(text), 8))


def rice(value, k):
    folded = 2 * value if value >= 0 else -2 * value - 1
    return "0" * (folded >> k) + "1" + (format(folded & (1 << k) - 1, f"0{k}b") if k else "")


def test_stream_made_by_hand():
    """Frames written bit by bit from the format's description, without the encoder: constant, verbatim, fixed order 2 in two partitions, linear order 2."""
    import hashlib

    size = 16
    verbatim = [(i * 37) % 256 - 128 for i in range(size)]
    curve = [i * i // 4 - 20 for i in range(size)]
    wave = [10, 12]
    noise = [(i * 7) % 5 - 2 for i in range(size - 2)]
    for e in noise:  # coefficients 3 and -1 (latest first), shifted right by one
        wave.append(((3 * wave[-1] - wave[-2]) >> 1) + e)
    assert max(map(abs, wave)) < 128
    second = [curve[i] - 2 * curve[i - 1] + curve[i - 2] for i in range(2, size)]
    bodies = [
        bits((0, 8), (-7, 8)),
        bits((0b00000010, 8), *((x, 8) for x in verbatim)),
        # residuals: Rice with 4-bit parameters, partition order 1; 6 values with parameter 0, 8 with parameter 2
        bits((0b00010100, 8), (curve[0], 8), (curve[1], 8), (0, 2), (1, 4), (0, 4)) + "".join(rice(x, 0) for x in second[:6]) + bits((2, 4)) + "".join(rice(x, 2) for x in second[6:]),
        bits((0b01000010, 8), (wave[0], 8), (wave[1], 8), (3 - 1, 4), (1, 5), (3, 3), (-1, 3), (0, 2), (0, 4), (1, 4)) + "".join(rice(x, 1) for x in noise),
    ]
    frames = []
    for number, body in enumerate(bodies):
        # block size in 8 bits, less one; sample rate and depth from the stream's head
        head = bytes([0xFF, 0xF8, 0b01100000, 0b00000000, number, size - 1])
        frame_bytes = packed("".join(format(b, "08b") for b in head + bytes([checksum(head, 8, 0x07)])) + body)
        frames.append(frame_bytes + checksum(frame_bytes, 16, 0x8005).to_bytes(2, "big"))
    want = [-7] * size + verbatim + curve + wave
    digest = hashlib.md5(bytes(x & 255 for x in want)).digest()
    sizes = [len(f) for f in frames]
    info = packed(bits((size, 16), (size, 16), (min(sizes), 24), (max(sizes), 24), (8000, 20), (0, 3), (7, 5), (4 * size, 36))) + digest
    stream = b"fLaC" + b"\x80\x00\x00\x22" + info + b"".join(frames)
    assert flac.decode([stream])[0].tolist() == want
    for at in (4 + 4 + 34 + 7, len(stream) - 1):
        broken = bytearray(stream)
        broken[at] ^= 4
        with pytest.raises(ValueError):
            flac.decode([bytes(broken)])
