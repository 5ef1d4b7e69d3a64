from __future__ import annotations

import hashlib
import random
import struct
import zlib

import pyarrow as pa
import pytest

from lodespan.llm import media

RGB = bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])


def frame(pixels, at=(0, 0), size=(2, 2), delay=0, disposal=0, hidden=None, palette=b"", interlaced=False):
    flags = (0x80 | 1 if palette else 0) | (0x40 if interlaced else 0)
    control = b"\x21\xf9\x04" + struct.pack("<BHBB", disposal << 2 | (hidden is not None), delay, hidden or 0, 0)
    # Codes of 3 bits with a clear code before each sample, so that the width stays.
    codes = [c for p in pixels for c in (4, p)] + [5]
    bits = sum(c << 3 * i for i, c in enumerate(codes))
    data = bits.to_bytes((3 * len(codes) + 7) // 8, "little")
    return control + b"\x2c" + struct.pack("<HHHHB", *at, *size, flags) + palette + b"\x02" + bytes([len(data)]) + data + b"\0"


def gif(*frames, size=(2, 2)):
    return b"GIF89a" + struct.pack("<HHBBB", *size, 0x81, 0, 0) + RGB + b"".join(frames) + b"\x3b"


def red(image, n=0):
    return image["frames"][n]["histogram"][:16]


def test_round_trip():
    chance = random.Random(3)
    for n in range(40):
        size = 64 * chance.randint(1, 3000)
        data = [chance.randbytes(size), bytes([n]) * size, bytes(chance.choices(b"the cat sat ", k=size))][n % 3]
        image = media.read_gif(media.write_gif(data))
        assert image["samples"] == data and image["width"] == 64
        assert sum(sum(f["histogram"][:16]) for f in image["frames"]) >= len(data)
    with pytest.raises(ValueError):
        media.write_gif(b"x" * 65)


def test_frames_are_timed():
    image = media.read_gif(media.write_gif(b"a" * 64 * 5, rows=2, delay=7))
    assert [(f["start_ms"], f["delay_ms"], f["disposal"]) for f in image["frames"]] == [(0, 70, 1), (70, 70, 1), (140, 70, 1)]


def test_palettes_transparency_and_disposal():
    base = frame([1, 1, 1, 1])
    over = frame([2, 0, 0, 2], hidden=0)
    image = media.read_gif(gif(base, over))
    assert red(image, 0)[15] == 4 and red(image, 1)[15] == 2 and image["frames"][1]["histogram"][16 + 15] == 2
    cleared = media.read_gif(gif(frame([1], size=(1, 1), disposal=2), frame([2], at=(1, 1), size=(1, 1))))
    assert sum(red(cleared, 1)) == 1  # the background is transparent
    restored = media.read_gif(gif(base, frame([2] * 4, disposal=3), frame([3], size=(1, 1))))
    assert red(restored, 2)[15] == 3 and restored["frames"][2]["histogram"][32 + 15] == 1
    own = media.read_gif(gif(frame([0, 1, 0, 1], palette=bytes([9, 9, 9, 200, 200, 200, 0, 0, 0, 0, 0, 0]))))
    assert own["samples"] == bytes([9, 200, 9, 200])


def test_interlaced_rows():
    image = media.read_gif(gif(frame([0, 1, 2, 3], size=(1, 4), interlaced=True), size=(1, 4)))
    assert image["samples"] == bytes([0, 0, 255, 0])  # rows 0, 2, 1, 3 were sent: palette 0, 2, 1, 3


@pytest.mark.parametrize("bad", [b"", b"GIF89a", b"PNG" * 9, gif(frame([0, 1]))[:-1] + b"\x99", b"GIF89a" + struct.pack("<HHBBB", 65535, 65535, 0, 0, 0)])
def test_bad_files(bad):
    with pytest.raises(media.BadGif):
        media.read_gif(bad)


def test_repeated_codes_and_full_tables():
    assert media.lzw_decode(media.lzw_encode(b"aaaaaaaa"), 8, 8) == b"aaaaaaaa"
    data = random.Random(4).randbytes(40_000)
    assert media.lzw_decode(media.lzw_encode(data), 8, len(data)) == data


def test_rows(spark):
    rows = [(1, None, "m"), (2, "", "m"), (3, "é" * 33, None), (4, "long text " * 20_000, "m"), (5, "é" * 33, "m"), (5, "é" * 33, "m")]
    df = spark.createDataFrame(rows, "doc_id long, text string, media string")
    got = sorted(media.digests(df).collect(), key=lambda r: r["doc_id"])
    for (_, text, _), row in zip(rows, got):
        data = (text or "").encode()
        payload = data + b"\0" * (-len(data) % 64 or (0 if data else 64))
        assert (row["n_bytes"], row["payload_bytes"], row["payload_sha256"], row["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert row["media_sha256"] == hashlib.sha256(media.write_gif(payload)).hexdigest() and row["error"] is None
    assert got[2]["feature"] == got[4]["feature"] and got[2]["media_sha256"] == got[5]["media_sha256"]
    assert media.digests(df.limit(0)).count() == 0
    broken = spark.createDataFrame([(1, bytearray(b"GIF")), (2, None)], "doc_id long, media binary")
    assert [r["image"] and r["image"]["error"] for r in media.load(broken).orderBy("doc_id").collect()] == ["no GIF header", None]


def test_one_worker_stores_and_reads(spark):
    df = spark.createDataFrame([(1, "one"), (2, None)], "doc_id long, text string")
    plan = media.digests(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    rows = [(1, bytearray(b"a" * 64)), (2, None)]
    payloads = spark.createDataFrame(rows, "id long, payload binary")
    got = media.round_trip(payloads).orderBy("id").collect()
    apart = media.load(media.store(payloads)).orderBy("id").collect()
    assert [r["image"] for r in got] == [r["image"] for r in apart] and got[1]["media"] is None
    assert got[0]["media"] == media.write_gif(b"a" * 64) and got[0]["image"]["samples"] == b"a" * 64


def test_returned_batches_are_bounded_by_bytes():
    large, most = b"x" * (media.PART_BYTES // 2 + 1), media.PART_ROWS
    parts = lambda values: [n for _, n in media._parts(pa.array(values, pa.binary()))]
    assert parts([large] * 3) == [1, 1, 1] and parts([large * 4, b"", large]) == [1, 2]
    assert parts([b"", None] * most) == [most, most] and parts([]) == []
