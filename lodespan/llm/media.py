"""Media columns: byte payloads as animated GIF, and GIF read back as timed frames with colour histograms.

The writer stores each payload byte as one 8-bit sample under an identity grey palette, in frames of at most
`WIDTH * ROWS` samples. The reader takes any GIF: it decodes the LZW code streams, applies global and local palettes,
interlacing, transparency and the disposal rules, and gives each shown frame's time, disposal and colour histogram.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodespan.session import make_importable

#: Samples in a row, rows in a frame, and hundredths of a second that a frame stays.
WIDTH, ROWS, DELAY = 64, 1024, 4
#: Bins of each colour channel's histogram.
BINS = 16
#: A reader refuses canvases of more samples than this, as a damaged header may ask for 12 GB.
MOST_CANVAS = 1 << 26
#: Rows, and bytes that went into them, of a batch that a worker returns.
PART_ROWS, PART_BYTES = 200, 1 << 22

CLEAR, END, FIRST, FULL = 256, 257, 258, 4096


class BadGif(ValueError):
    """The bytes aren't a readable GIF."""


def _widths(bits: int, count: int) -> np.ndarray:
    """Bits of the n-th code after a clear code: the table grows by one entry with each code but the first."""
    size = (1 << bits) + 2 + np.maximum(np.arange(count) - 1, 0)
    return np.minimum(12, np.maximum(bits + 1, np.floor(np.log2(size)).astype(np.int64) + 1))


_WIDTHS = _widths(8, FULL)


def lzw_encode(data: bytes) -> bytes:
    """GIF's LZW code stream of 8-bit samples, a clear code first and whenever the table is full."""
    codes, starts, table, following = [CLEAR], [1], {}, FIRST
    add, known = codes.append, table.get
    if data:
        run = data[0]
        for sample in data[1:]:
            if code := known(key := run << 8 | sample):
                run = code
                continue
            add(run)
            run = sample
            if following < FULL:
                table[key] = following
                following += 1
            else:
                add(CLEAR)
                starts.append(len(codes))
                table.clear()
                following = FIRST
        add(run)
    add(END)
    values = np.array(codes, np.int64)
    at = np.arange(len(codes))
    at[0] = 0
    begins = np.array(starts)
    at[1:] -= begins[np.searchsorted(begins, at[1:], side="right") - 1]
    widths = _WIDTHS[np.minimum(at, FULL - 1)]
    ends = np.cumsum(widths)
    offsets = ends - widths
    place, shifted = offsets >> 3, values << (offsets & 7)
    out = np.zeros((int(ends[-1]) + 7) // 8 + 2)
    for part in range(3):
        out += np.bincount(place + part, shifted >> 8 * part & 255, len(out))
    return out.astype(np.uint8)[:-2].tobytes()


def lzw_decode(stream: bytes, bits: int, size: int) -> bytes:
    """The samples of a code stream, at most size; a stream that ends early gives fewer."""
    clear, end, first = 1 << bits, (1 << bits) + 1, (1 << bits) + 2
    padded = np.frombuffer(stream + b"\0\0\0", np.uint8).astype(np.int64)
    total, offset, out, made = 8 * len(stream), 0, [], 0
    widths = _WIDTHS if bits == 8 else _widths(bits, FULL)
    roots = [bytes([i]) for i in range(clear)] + [b"", b""]
    table, previous, position = list(roots), None, 0
    while made < size:
        count = min(FULL, (total - offset) // widths[min(position, FULL - 1)])
        if count <= 0:
            break
        wide = widths[np.minimum(position + np.arange(count), FULL - 1)]
        ends = offset + np.cumsum(wide)
        count = int(np.searchsorted(ends, total, side="right"))
        if not count:
            break
        ends, wide = ends[:count], wide[:count]
        starts = ends - wide
        place = starts >> 3
        codes = (padded[place] | padded[place + 1] << 8 | padded[place + 2] << 16) >> (starts & 7) & ((1 << wide) - 1)
        stops = np.flatnonzero((codes == clear) | (codes == end))
        stop = int(stops[0]) if len(stops) else count
        add, grow, fresh, todo = out.append, table.append, len(out), codes[:stop].tolist()
        done = 0
        if previous is None and todo:
            if todo[0] >= first:
                raise BadGif(f"code {todo[0]} after a clear code")
            add(previous := table[todo[0]])
            done = 1
        for code in todo[done : done + FULL - len(table)]:
            try:
                entry = table[code]
            except IndexError:
                if code != len(table):
                    raise BadGif(f"code {code} in a table of {len(table)}") from None
                entry = previous + previous[:1]
            grow(previous + entry[:1])
            add(entry)
            previous = entry
            done += 1
        for code in todo[done:]:  # the table is full
            add(previous := table[code])
        made += sum(map(len, out[fresh:]))
        if stop == count:
            offset, position = int(ends[-1]), position + count
            continue
        offset = int(ends[stop])
        if codes[stop] == end:
            break
        table, previous, position = list(roots), None, 0
    return b"".join(out)[:size]


def _blocks(data: bytes) -> bytes:
    whole = len(data) // 255
    body = np.empty((whole, 256), np.uint8)
    body[:, 0] = 255
    body[:, 1:] = np.frombuffer(data, np.uint8, whole * 255).reshape(whole, 255)
    rest = data[whole * 255 :]
    return body.tobytes() + (bytes([len(rest)]) + rest if rest else b"") + b"\0"


_GREY = bytes(x for i in range(256) for x in (i, i, i))


def write_gif(payload: bytes, width: int = WIDTH, rows: int = ROWS, delay: int = DELAY) -> bytes:
    """A GIF whose samples are the payload's bytes; their number must be a positive multiple of width."""
    if not payload or len(payload) % width:
        raise ValueError(f"{len(payload)} bytes aren't rows of {width}")
    height = min(rows, len(payload) // width)
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0xF7, 0, 0), _GREY]
    for start in range(0, len(payload), width * rows):
        frame = payload[start : start + width * rows]
        out.append(b"\x21\xf9\x04\x04" + struct.pack("<HBB", delay, 0, 0))
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, width, len(frame) // width, 0) + b"\x08" + _blocks(lzw_encode(frame)))
    return b"".join(out) + b"\x3b"


def _palette(data: bytes, at: int, flags: int) -> tuple[np.ndarray | None, int]:
    if not flags & 0x80:
        return None, at
    size = 3 << (flags & 7) + 1
    if at + size > len(data):
        raise BadGif("the palette is cut")
    return np.frombuffer(data, np.uint8, size, at).reshape(-1, 3), at + size


def _gather(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while at < len(data) and (size := data[at]):
        parts.append(data[at + 1 : at + 1 + size])
        at += 1 + size
    return b"".join(parts), at + 1


def _interlaced(rows: int) -> np.ndarray:
    return np.concatenate([np.arange(start, rows, step) for start, step in ((0, 8), (4, 8), (2, 4), (1, 2))])


def histogram(pixels: np.ndarray) -> list[int]:
    """BINS counts of the red, green and blue channel each, of opaque pixels; pixels are rows of red, green, blue, opaque."""
    seen = pixels[pixels[:, 3] > 0, :3] if not pixels[:, 3].all() else pixels[:, :3]
    bins = (seen >> 4) + np.array([0, BINS, 2 * BINS], np.uint8)
    return np.bincount(bins.ravel(), minlength=3 * BINS).tolist()


def read_gif(data: bytes) -> dict:
    """width, height, samples (palette's red of every frame's own area, in order) and frames of a GIF.

    A frame has start_ms, delay_ms, disposal (0 to 3) and histogram, that of the whole canvas as shown. Raises BadGif.
    """
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise BadGif("no GIF header")
    width, height, flags = struct.unpack_from("<HHB", data, 6)
    if width * height > MOST_CANVAS:
        raise BadGif(f"a canvas of {width} x {height}")
    common, at = _palette(data, 13, flags)
    canvas = np.zeros((height, width, 4), np.uint8)
    frames, samples, clock = [], [], 0
    delay, disposal, hidden = 0, 0, -1
    while at < len(data) and data[at] != 0x3B:
        kind = data[at]
        if kind == 0x21:
            if data[at + 1 : at + 2] == b"\xf9" and at + 8 <= len(data):
                packed, delay, index = struct.unpack_from("<BHB", data, at + 3)
                disposal, hidden = packed >> 2 & 7, index if packed & 1 else -1
            _, at = _gather(data, at + 2)
            continue
        if kind != 0x2C or at + 10 > len(data):
            raise BadGif(f"block {kind:#x} at {at}")
        left, top, wide, high, flags = struct.unpack_from("<HHHHB", data, at + 1)
        own, at = _palette(data, at + 10, flags)
        palette = common if own is None else own
        if palette is None:
            raise BadGif("a frame without a palette")
        if at >= len(data) or not 1 <= data[at] <= 8 or wide * high > MOST_CANVAS:
            raise BadGif("a frame without a code size, or too large")
        stream, at_next = _gather(data, at + 1)
        indices = np.frombuffer(lzw_decode(stream, data[at], wide * high), np.uint8)
        at = at_next
        if len(indices) < wide * high:
            raise BadGif("the samples are cut")
        indices = indices.reshape(high, wide)
        if flags & 0x40:
            ordered = np.empty_like(indices)
            ordered[_interlaced(high)] = indices
            indices = ordered
        if indices.size and int(indices.max()) >= len(palette):
            raise BadGif("a sample outside the palette")
        saved = canvas.copy() if disposal == 3 else None
        colours = palette[indices]
        area = canvas[top : top + high, left : left + wide]
        if hidden < 0:
            area[..., :3] = colours[: area.shape[0], : area.shape[1]]
            area[..., 3] = 255
        else:
            shown = indices[: area.shape[0], : area.shape[1]] != hidden
            area[shown, :3] = colours[: area.shape[0], : area.shape[1]][shown]
            area[shown, 3] = 255
        samples.append(colours[..., 0].tobytes())
        frames.append({"start_ms": clock, "delay_ms": 10 * delay, "disposal": disposal, "histogram": histogram(canvas.reshape(-1, 4))})
        clock += 10 * delay
        if disposal == 2:
            area[...] = 0
        elif disposal == 3:
            canvas = saved
        delay, disposal, hidden = 0, 0, -1
    return {"width": width, "height": height, "samples": b"".join(samples), "frames": frames, "error": None}


FRAME = T.StructType([T.StructField("start_ms", T.LongType()), T.StructField("delay_ms", T.IntegerType()), T.StructField("disposal", T.IntegerType()), T.StructField("histogram", T.ArrayType(T.LongType()))])
GIF = T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("samples", T.BinaryType()), T.StructField("frames", T.ArrayType(FRAME)), T.StructField("error", T.StringType())])
_GIF_ARROW = pa.struct([
    ("width", pa.int32()), ("height", pa.int32()), ("samples", pa.binary()),
    ("frames", pa.list_(pa.struct([("start_ms", pa.int64()), ("delay_ms", pa.int32()), ("disposal", pa.int32()), ("histogram", pa.list_(pa.int64()))]))),
    ("error", pa.string()),
])
_MEDIA, _IMAGE = (T.BinaryType(), pa.binary()), (GIF, _GIF_ARROW)


def _parts(values: pa.Array) -> Iterator[tuple[int, int]]:
    """Start and number of neighbouring values that are written as one batch: at most PART_ROWS, and PART_BYTES unless one alone has more."""
    sizes = pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    start = 0
    while start < len(sizes):
        within = np.searchsorted(np.cumsum(sizes[start : start + PART_ROWS]), PART_BYTES, side="right")
        yield start, (count := max(1, int(within)))
        start += count


def _map(df: DataFrame, source: str, made: dict[str, tuple[T.DataType, pa.DataType]], function) -> DataFrame:
    """Replaces the column source by those of made, of which function returns a tuple; null gives nulls."""
    make_importable(df.sparkSession)
    names = [c for c in df.columns if c != source and c not in made]
    schema = T.StructType([df.schema[n] for n in names] + [T.StructField(n, kind) for n, (kind, _) in made.items()])
    arrow = [kind for _, kind in made.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start, count in _parts(whole.column(source)):
                batch = whole.slice(start, count)
                rows = [(None,) * len(arrow) if x is None else function(x) for x in batch.column(source).to_pylist()]
                values = [pa.array([row[i] for row in rows], kind) for i, kind in enumerate(arrow)]
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *values], [*names, *made])

    return df.mapInArrow(run, schema)


def store(df: DataFrame, payload: str = "payload", media: str = "media") -> DataFrame:
    """Replaces the binary column payload by media, its bytes as a GIF.

    Payloads must be positive multiples of WIDTH bytes (see `padded`); null stays null. Other columns, ties and repeated
    rows pass through; an empty table gives an empty table.
    """
    return _map(df, payload, {media: _MEDIA}, lambda x: (write_gif(x),))


def _read_or_say(data: bytes) -> dict:
    try:
        return read_gif(data)
    except BadGif as error:
        return {"width": None, "height": None, "samples": None, "frames": None, "error": str(error)}


def load(df: DataFrame, media: str = "media", image: str = "image") -> DataFrame:
    """Replaces the binary column media by the struct image: width, height, samples, frames and error.

    Bytes that aren't a readable GIF give only an error text; null stays null.
    """
    return _map(df, media, {image: _IMAGE}, lambda x: (_read_or_say(x),))


def _there_and_back(data: bytes) -> tuple[bytes, dict]:
    stored = write_gif(data)
    return stored, _read_or_say(stored)


def round_trip(df: DataFrame, payload: str = "payload", media: str = "media", image: str = "image") -> DataFrame:
    """Replaces the binary column payload by media and image: `load` of what `store` gives, in one pass of one worker.

    The image is read from the stored bytes alone. One after the other, `store` and `load` keep twice the workers and send
    the media to Python once more.
    """
    return _map(df, payload, {media: _MEDIA, image: _IMAGE}, _there_and_back)


def padded(data: Column, unit: int = WIDTH) -> Column:
    """Binary data (null: empty) with zero bytes up to a positive multiple of unit."""
    data = F.coalesce(data, F.lit(b""))
    size = F.octet_length(data)
    missing = F.when(size == 0, F.lit(unit)).otherwise(F.pmod(-size, F.lit(unit)))
    return F.concat(data, F.unhex(F.repeat(F.lit("00"), missing)))


def described(image: Column) -> Column:
    """A text of what the frames show: their number, the time all take and the summed histogram of red."""
    frames = image["frames"]
    time = F.aggregate(frames, F.lit(0).cast("long"), lambda total, frame: total + frame["delay_ms"])
    sums = F.aggregate(frames, F.array_repeat(F.lit(0).cast("long"), BINS), lambda total, frame: F.zip_with(total, F.slice(frame["histogram"], 1, BINS), lambda a, b: a + b))
    return F.concat_ws(";", F.concat(F.lit("frames="), F.size(frames)), F.concat(F.lit("ms="), time), F.concat(F.lit("red="), F.array_join(sums, ",")))


def digests(df: DataFrame) -> DataFrame:
    """The media columns' digests of each row of documents, from the payload as read back."""
    data = F.col("text").cast("binary")
    coded = round_trip(df.select("doc_id", F.octet_length(F.coalesce(data, F.lit(b""))).cast("long").alias("n_bytes"), padded(data).alias("payload")))
    payload = F.col("image.samples")
    return coded.select(
        "doc_id",
        "n_bytes",
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha2(payload, 256).alias("payload_sha256"),
        F.crc32(F.substring(payload, -64, 64)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        described(F.col("image")).alias("feature"),
        F.size("image.frames").alias("n_frames"),
        F.col("image.error").alias("error"),
    )
