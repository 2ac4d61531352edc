"""TIFF: pages to rows.  Walks the image directories of a file, decodes strips and tiles, undoes predictors.

Read: both byte orders; chained directories; uncompressed, PackBits, LZW and deflate data; strips and tiles; horizontal
predictor; 8-bit samples, interleaved or in planes.  Write: gray 8-bit pages, one directory each, with the same
codecs and layouts.  Files stay below 4 GB, as the format's offsets demand.

A file that cannot be read gives one row with page -1 and the reason; null is such a file.  An empty table gives an empty
result, equal files equal rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from irquarry.llm.common import named, sliced, texts

# Fixed values of the format: codec numbers, tags, and field types with their sizes.
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
WIDTH, HEIGHT, BITS, CODEC, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, STRIP_ROWS, STRIP_COUNTS, PLANES, PREDICTOR = (
    256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317,
)
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS = 322, 323, 324, 325
_TYPES = {1: ("B", 1), 3: ("H", 2), 4: ("I", 4)}

_CLEAR, _END, _FIRST = 256, 257, 258

PAGE_FIELDS = (
    "page int, width int, height int, samples int, codec int, predictor int, tiled boolean, pixels binary, error string"
)


def packbits_encode(data: bytes) -> bytes:
    """Runs of three or more as repeats, the rest as literals of at most 128 bytes."""
    values = np.frombuffer(data, np.uint8)
    out = bytearray()
    edges = np.flatnonzero(np.diff(values)) + 1
    starts = np.concatenate([[0], edges]).tolist()
    stops = np.concatenate([edges, [len(values)]]).tolist()
    literal = 0  # start of the bytes not yet written

    def flush(until: int) -> None:
        for at in range(literal, until, 128):
            part = data[at : min(at + 128, until)]
            out.append(len(part) - 1)
            out.extend(part)

    for start, stop in zip(starts, stops):
        if stop - start < 3:
            continue
        flush(start)
        for at in range(start, stop, 128):
            run = min(128, stop - at)
            if run == 1:
                out.extend((0, data[at]))
            else:
                out.extend((257 - run, data[at]))
        literal = stop
    flush(len(data))
    return bytes(out)


def packbits_decode(data: bytes, size: int) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and len(out) < size:
        head = data[at]
        if head < 128:
            out += data[at + 1 : at + 2 + head]
            at += 2 + head
        elif head > 128:
            out += data[at + 1 : at + 2] * (257 - head)
            at += 2
        else:
            at += 1
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bits first, widened one code early; the table is cleared when full."""
    codes: list[int] = [_CLEAR]
    widths: list[int] = [9]
    known: dict[tuple[int, int], int] = {}
    fresh, width, prefix = _FIRST, 9, -1
    for byte in data:
        if prefix < 0:
            prefix = byte
            continue
        code = known.get((prefix, byte))
        if code is not None:
            prefix = code
            continue
        codes.append(prefix)
        widths.append(width)
        known[prefix, byte] = fresh
        fresh += 1
        prefix = byte
        if fresh == 4094:
            codes.append(_CLEAR)
            widths.append(width)
            known.clear()
            fresh, width = _FIRST, 9
        elif fresh + 1 > (1 << width):
            width += 1
    if prefix >= 0:
        codes.append(prefix)
        widths.append(width)
        if fresh + 2 > (1 << width) and width < 12:
            width += 1
    codes.append(_END)
    widths.append(width)
    code, size = np.array(codes, np.int64), np.array(widths, np.int64)
    bits = (code[:, None] << (16 - size)[:, None] >> np.arange(15, -1, -1)) & 1
    used = np.arange(16)[None, :] < size[:, None]
    return np.packbits(bits[used].astype(np.uint8)).tobytes()


def lzw_decode(data: bytes, size: int) -> bytes:
    out = bytearray()
    table: list[bytes] = [bytes([i]) for i in range(256)] + [b"", b""]
    width, held, bits, last = 9, 0, 0, b""
    for byte in data:
        held = (held << 8) | byte
        bits += 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == _CLEAR:
            del table[_FIRST:]
            width, last = 9, b""
            continue
        if code == _END or len(out) >= size:
            break
        if not last:
            last = table[code]
        else:
            if code < len(table):
                entry = table[code]
            elif code == len(table):
                entry = last + last[:1]
            else:
                raise ValueError("LZW code out of order")
            table.append(last + entry[:1])
            last = entry
            if len(table) + 1 >= 1 << width and width < 12:
                width += 1
        out += last
    return bytes(out)


def compress(data: bytes, codec: int) -> bytes:
    if codec == NONE:
        return data
    if codec == PACKBITS:
        return packbits_encode(data)
    if codec == LZW:
        return lzw_encode(data)
    return zlib.compress(data, 6)


def decompress(data: bytes, codec: int, size: int) -> bytes:
    if codec == NONE:
        plain = data
    elif codec == PACKBITS:
        plain = packbits_decode(data, size)
    elif codec == LZW:
        plain = lzw_decode(data, size)
    elif codec in (DEFLATE, OLD_DEFLATE):
        plain = zlib.decompress(data)
    else:
        raise ValueError(f"codec {codec} is not read")
    if len(plain) < size:
        raise ValueError(f"{len(plain)} bytes decoded where {size} are due")
    return plain[:size]


def encode(pages: list[np.ndarray], codec: int = DEFLATE, predictor: int = 1, rows: int = 512, tile: int = 0) -> bytes:
    """A little-endian file of gray pages; strips of ``rows`` rows, or square tiles (a multiple of 16)."""
    out = bytearray(struct.pack("<2sHI", b"II", 42, 0))
    link = 4
    for image in pages:
        height, width = image.shape
        if tile:
            padded = np.zeros((-(-height // tile) * tile, -(-width // tile) * tile), np.uint8)
            padded[:height, :width] = image
            parts = [
                padded[y : y + tile, x : x + tile]
                for y in range(0, padded.shape[0], tile)
                for x in range(0, padded.shape[1], tile)
            ]
        else:
            parts = [image[y : y + rows] for y in range(0, height, rows)]
        offsets, counts = [], []
        for part in parts:
            if predictor == 2:
                part = np.diff(part, axis=1, prepend=np.uint8(0))
            data = compress(np.ascontiguousarray(part).tobytes(), codec)
            offsets.append(len(out))
            counts.append(len(data))
            out += data
        entries = {WIDTH: [width], HEIGHT: [height], BITS: [8], CODEC: [codec], PHOTOMETRIC: [1], SAMPLES: [1]}
        if predictor != 1:
            entries[PREDICTOR] = [predictor]
        if tile:
            entries |= {TILE_WIDTH: [tile], TILE_HEIGHT: [tile], TILE_OFFSETS: offsets, TILE_COUNTS: counts}
        else:
            entries |= {STRIP_OFFSETS: offsets, STRIP_ROWS: [rows], STRIP_COUNTS: counts}
        fields = []
        for tag in sorted(entries):
            values = entries[tag]
            short = tag in (BITS, CODEC, PHOTOMETRIC, SAMPLES, PREDICTOR)
            body = struct.pack(f"<{len(values)}{'H' if short else 'I'}", *values)
            if len(body) > 4:
                out += b"\0" * (len(out) % 2)
                at = len(out)
                out += body
                body = struct.pack("<I", at)
            fields.append(struct.pack("<HHI", tag, 3 if short else 4, len(values)) + body.ljust(4, b"\0"))
        out += b"\0" * (len(out) % 2)
        out[link : link + 4] = struct.pack("<I", len(out))
        out += struct.pack("<H", len(fields)) + b"".join(fields)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def directories(data: bytes) -> Iterator[dict[int, tuple[int, ...]]]:
    """The entries of each image directory, in the order of the chain."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    at, seen = struct.unpack_from(order + "I", data, 4)[0], set()
    while at:
        if at in seen:
            raise ValueError("the chain of directories has a loop")
        seen.add(at)
        entries = {}
        (number,) = struct.unpack_from(order + "H", data, at)
        for i in range(number):
            place = at + 2 + 12 * i
            tag, kind, count = struct.unpack_from(order + "HHI", data, place)
            if kind not in _TYPES:
                continue
            letter, size = _TYPES[kind]
            body = place + 8 if size * count <= 4 else struct.unpack_from(order + "I", data, place + 8)[0]
            entries[tag] = struct.unpack_from(f"{order}{count}{letter}", data, body)
        yield entries
        (at,) = struct.unpack_from(order + "I", data, at + 2 + 12 * number)


def page_pixels(data: bytes, entries: dict[int, tuple[int, ...]]) -> np.ndarray:
    """height x width x samples of one directory."""
    one = lambda tag, default=None: entries.get(tag, (default,))[0]
    width, height, samples = one(WIDTH), one(HEIGHT), one(SAMPLES, 1)
    codec, predictor, planes = one(CODEC, NONE), one(PREDICTOR, 1), one(PLANES, 1)
    if width is None or height is None:
        raise ValueError("a page without size")
    if any(b != 8 for b in entries.get(BITS, (8,))):
        raise ValueError("only 8-bit samples are read")
    if predictor not in (1, 2):
        raise ValueError(f"predictor {predictor} is not read")
    tiled = TILE_OFFSETS in entries
    across, down = (one(TILE_WIDTH), one(TILE_HEIGHT)) if tiled else (width, min(one(STRIP_ROWS, height), height))
    offsets, counts = entries[TILE_OFFSETS if tiled else STRIP_OFFSETS], entries[TILE_COUNTS if tiled else STRIP_COUNTS]
    depth = 1 if planes == 2 else samples
    image = np.zeros((height, width, samples), np.uint8)
    places = [(y, x) for y in range(0, height, down) for x in range(0, width, across)]
    for i, (offset, count) in enumerate(zip(offsets, counts)):
        plane, (y, x) = i // len(places), places[i % len(places)]
        rows = down if tiled else min(down, height - y)
        plain = decompress(data[offset : offset + count], codec, rows * across * depth)
        block = np.frombuffer(plain, np.uint8).reshape(rows, across, depth)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=np.uint8)
        block = block[: height - y, : width - x]
        target = slice(plane, plane + 1) if planes == 2 else slice(0, samples)
        image[y : y + block.shape[0], x : x + block.shape[1], target] = block
    return image


def page_rows(data: bytes | None) -> list[tuple]:
    """The values of PAGE_FIELDS of each page, or one row that says why not."""
    rows: list[tuple] = []
    try:
        if data is None:
            raise ValueError("no file")
        for number, entries in enumerate(directories(data)):
            image = page_pixels(data, entries)
            height, width, samples = image.shape
            codec, predictor = entries.get(CODEC, (NONE,))[0], entries.get(PREDICTOR, (1,))[0]
            tiled = TILE_OFFSETS in entries
            rows.append((number, width, height, samples, codec, predictor, tiled, image.tobytes(), None))
        return rows
    except (ValueError, KeyError, IndexError, struct.error, zlib.error, TypeError, ZeroDivisionError) as broken:
        return [(-1, None, None, None, None, None, None, None, f"{type(broken).__name__}: {broken}")]


def pages(files: DataFrame, media: str = "media", keep: list[str] | None = None) -> DataFrame:
    """``row`` (the kept columns) and ``page`` (PAGE_FIELDS): one row per page of every file.  No shuffle."""
    kept = files.columns if keep is None else keep
    row = F.struct(*[named(c).alias(c) for c in kept]) if kept else F.struct(F.lit(0).alias("none"))
    packed = files.select(row.alias("row"), named(media).alias("media"))
    fields = StructType.fromDDL(PAGE_FIELDS)
    schema = StructType([StructField("row", packed.schema["row"].dataType), StructField("page", fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = [f.type for f in to_arrow_schema(fields)]
        for batch in batches:
            for part in sliced(batch, 1):
                at, found = [], []
                for i, data in enumerate(texts(part.column(1))):
                    mine = page_rows(data)
                    at.extend([i] * len(mine))
                    found.extend(mine)
                arrays = [pa.array(c, k) for c, k in zip(zip(*found), kinds)]
                page = pa.StructArray.from_arrays(arrays, fields.fieldNames())
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at, pa.int32())), page], ["row", "page"])

    return packed.mapInArrow(run, schema)


def signature(pixels: bytes, width: int, height: int) -> str:
    """Size, mean in thousandths, and an 8 x 8 hash of which parts are brighter than the mean."""
    flat = np.frombuffer(pixels, np.uint8)
    bounds = np.arange(64) * len(flat) // 64
    means = np.add.reduceat(flat, bounds, dtype=np.int64) / np.maximum(np.diff(np.append(bounds, len(flat))), 1)
    bits = np.packbits(means > flat.mean()).tobytes().hex()
    return f"{width}x{height}:{int(1000 * flat.mean())}:{bits}"
