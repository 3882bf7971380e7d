"""Image files as rows: grey PNG rasters to pixels, and the camera that a photo's tags name.

Files are rows (path, content), as Spark's `binaryFile` reader gives them. Decoding is by the public
formats and bounded: inflating stops at the size that the header states, and offsets outside the
file end the search.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.session import importable

# Fixed values of the formats.
PNG_HEAD = b"\x89PNG\r\n\x1a\n"
EXIF_HEAD = b"Exif\0\0"
MAKE, MODEL, ASCII = 0x010F, 0x0110, 2
MOST_PIXELS = 1 << 28


def image_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, content) of the files below `path` whose names match."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select("path", "content")


def chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(kind, body) of a PNG's chunks, as far as they are whole."""
    at = len(PNG_HEAD)
    while at + 12 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        if at + 12 + size > len(data):
            return
        yield kind, data[at + 8 : at + 8 + size]
        at += 12 + size


def unfilter(rows: np.ndarray, kinds: np.ndarray, unit: int) -> np.ndarray:
    """Undo a PNG's row filters; `unit` is the bytes of a pixel. Rows without a neighbour to the left go in one step."""
    out = np.zeros_like(rows)
    above = np.zeros(rows.shape[1], np.uint8)
    for y, (kind, row) in enumerate(zip(kinds.tolist(), rows, strict=True)):
        if kind == 0:
            got = row
        elif kind == 1:
            got = np.cumsum(row.reshape(-1, unit), axis=0, dtype=np.uint8).ravel()
        elif kind == 2:
            got = row + above
        elif kind in (3, 4):
            got = np.frombuffer(beside(row.tobytes(), above.tobytes(), unit, kind == 4), np.uint8)
        else:
            raise ValueError(f"filter {kind}")
        out[y] = above = got
    return out


def beside(row: bytes, above: bytes, unit: int, paeth: bool) -> bytes:
    """One row whose filter reads the pixel on the left: the average of left and above, or the nearest of left, above and corner."""
    out = bytearray(len(row))
    for k, value in enumerate(row):
        left, corner = (out[k - unit], above[k - unit]) if k >= unit else (0, 0)
        up = above[k]
        if paeth:
            to_left, to_up, to_corner = abs(up - corner), abs(left - corner), abs(left + up - 2 * corner)
            guess = left if to_left <= to_up and to_left <= to_corner else up if to_up <= to_corner else corner
        else:
            guess = (left + up) // 2
        out[k] = (value + guess) & 255
    return bytes(out)


def grey_png(data: bytes) -> np.ndarray:
    """The raster of an 8 or 16 bit grey PNG; any other file is an error."""
    if not data.startswith(PNG_HEAD):
        raise ValueError("no PNG")
    parts = list(chunks(data))
    if not parts or parts[0][0] != b"IHDR" or len(parts[0][1]) != 13:
        raise ValueError("no header")
    width, height, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", parts[0][1])
    if colour or depth not in (8, 16) or interlaced:
        raise ValueError("not a plain single-channel raster of 8 or 16 bits")
    if not 0 < width * height <= MOST_PIXELS:
        raise ValueError(f"{width} by {height} pixels")
    unit = depth // 8
    size = height * (1 + width * unit)
    body = zlib.decompressobj().decompress(b"".join(b for kind, b in parts if kind == b"IDAT"), size)
    if len(body) != size:
        raise ValueError("cut short")
    lines = np.frombuffer(body, np.uint8).reshape(height, -1)
    return unfilter(lines[:, 1:], lines[:, 0], unit).view(f">u{unit}").astype(np.uint16)


def put_png(raster: np.ndarray, filters: tuple[int, ...] = (0,)) -> bytes:
    """A grey PNG of a raster of 8 or 16 bit values; rows take the filters in turn."""
    unit = raster.dtype.itemsize
    plain = raster.astype(f">u{unit}").view(np.uint8).reshape(len(raster), -1)
    left = np.hstack([np.zeros((len(plain), unit), np.uint8), plain[:, :-unit]]).astype(int)
    up = np.vstack([np.zeros((1, plain.shape[1]), np.uint8), plain[:-1]]).astype(int)
    corner = np.hstack([np.zeros((len(plain), unit), int), up[:, :-unit]])
    d = np.stack([abs(up - corner), abs(left - corner), abs(left + up - 2 * corner)])
    guesses = [np.zeros_like(up), left, up, (left + up) // 2, np.choose(d.argmin(axis=0), [left, up, corner])]
    kinds = np.array([filters[y % len(filters)] for y in range(len(plain))])
    lines = np.array([(plain[y] - guesses[k][y]).astype(np.uint8) for y, k in enumerate(kinds)]).reshape(len(plain), -1)
    body = zlib.compress(np.hstack([kinds.astype(np.uint8)[:, None], lines]).tobytes())
    chunk = lambda kind, b: struct.pack(">I", len(b)) + kind + b + struct.pack(">I", zlib.crc32(kind + b))
    head = struct.pack(">IIBBBBB", raster.shape[1], raster.shape[0], 8 * unit, 0, 0, 0, 0)
    return PNG_HEAD + chunk(b"IHDR", head) + chunk(b"IDAT", body) + chunk(b"IEND", b"")


def png_pixels(files: DataFrame, step: int = 1) -> DataFrame:
    """(path, width, height, u, v, value): every `step`-th row and column of each file; one that can't be read fails the run."""
    schema = "path string, width int, height int, u int, v int, value int"
    importable(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    raster = grey_png(content.as_py() or b"")
                except (ValueError, zlib.error) as e:
                    raise ValueError(f"could not read {path}: {e}") from e
                height, width = raster.shape
                v, u = np.mgrid[0:height:step, 0:width:step]
                n = u.size
                whole = lambda x, n=n: np.full(n, x, np.int32)
                yield pa.RecordBatch.from_pydict({"path": pa.array([path] * n, pa.string()), "width": whole(width), "height": whole(height), "u": u.ravel().astype(np.int32), "v": v.ravel().astype(np.int32), "value": raster[::step, ::step].ravel().astype(np.int32)})

    return files.select("path", "content").mapInArrow(run, schema)


def tag_block(data: bytes) -> bytes:
    """The tag directory's bytes of a JPEG, PNG or TIFF file; empty if there is none."""
    if data[:4] in (b"II*\0", b"MM\0*"):
        return data
    if data.startswith(PNG_HEAD):
        return next((body for kind, body in chunks(data) if kind == b"eXIf"), b"")
    at = 2
    while data.startswith(b"\xff\xd8") and at + 4 <= len(data) and data[at] == 0xFF:
        mark, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        if mark in (0xD9, 0xDA) or size < 2:  # the picture itself begins
            break
        body = data[at + 4 : at + 2 + size]
        if mark == 0xE1 and body.startswith(EXIF_HEAD):
            return body[len(EXIF_HEAD) :]
        at += 2 + size
    return b""


def tags(block: bytes) -> dict[int, str]:
    """The text tags of a directory's first list, either byte order; values outside the block are left out."""
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(block[:4])
    if not order or len(block) < 8:
        return {}
    at = struct.unpack_from(f"{order}I", block, 4)[0]
    if at + 2 > len(block):
        return {}
    out: dict[int, str] = {}
    for k in range(struct.unpack_from(f"{order}H", block, at)[0]):
        entry = at + 2 + 12 * k
        if entry + 12 > len(block):
            break
        tag, kind, size = struct.unpack_from(f"{order}HHI", block, entry)
        spot = entry + 8 if size <= 4 else struct.unpack_from(f"{order}I", block, entry + 8)[0]
        if kind == ASCII and spot + size <= len(block):
            out.setdefault(tag, block[spot : spot + size].decode("utf-8", "replace").strip("\0"))
    return out


def cameras(files: DataFrame) -> DataFrame:
    """(path, make, model) as the files' tags say, empty where they don't; white space and NULs are runs of one space."""
    importable(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [tags(tag_block(x.as_py() or b"")) for x in batch.column(1)]
            said = lambda tag, found=found: pa.array([" ".join(f.get(tag, "").replace("\0", " ").split()) for f in found], pa.string())
            yield pa.RecordBatch.from_pydict({"path": batch.column(0), "make": said(MAKE), "model": said(MODEL)})

    return files.select("path", "content").mapInArrow(run, "path string, make string, model string")


def photo_device(named: DataFrame, by: str) -> DataFrame:
    """(by, device) of rows (by, make, model): the camera that all photos with tags name, or all of them in order; null without any.

    A make that the model repeats isn't said twice.
    """
    c = F.col
    make, model = F.coalesce("make", F.lit("")), F.coalesce("model", F.lit(""))
    own = F.when(F.contains(F.lower(model), F.lower(make)), model).otherwise(F.trim(F.concat_ws(" ", make, model)))
    seen = named.select(by, F.nullif(own, F.lit("")).alias("_own")).distinct().groupBy(by).agg(F.array_sort(F.collect_list("_own")).alias("_all"))
    one = F.concat(c("_all")[0], F.lit(" (EXIF; OS and capture app unknown)"))
    many = F.concat(F.lit("Mixed camera models in photo EXIF: "), F.array_join("_all", "; "))
    return seen.select(by, F.when(F.size("_all") == 1, one).when(F.size("_all") > 1, many).alias("device"))


def put_tags(make: str, model: str, order: str) -> bytes:
    """A tag directory that names a camera; `order` is < or >."""
    texts = [(MAKE, make.encode() + b"\0"), (MODEL, model.encode() + b"\0")]
    head, at, far = struct.pack(f"{order}HI", 42, 8) + struct.pack(f"{order}H", len(texts)), 8 + 2 + 12 * len(texts) + 4, b""
    for tag, value in texts:
        head += struct.pack(f"{order}HHI", tag, ASCII, len(value)) + (value.ljust(4, b"\0") if len(value) <= 4 else struct.pack(f"{order}I", at + len(far)))
        far += value if len(value) > 4 else b""
    return (b"II" if order == "<" else b"MM") + head + bytes(4) + far


def put_photo(kind: str, block: bytes) -> bytes:
    """A file without a picture around a tag directory: jpeg, png or tiff; an empty directory is left out."""
    if kind == "tiff":
        return block
    if kind == "png":
        return put_png(np.zeros((1, 1), np.uint8))[:33] + (struct.pack(">I", len(block)) + b"eXIf" + block + struct.pack(">I", zlib.crc32(b"eXIf" + block)) if block else b"")
    segment = lambda mark, b: b"\xff" + mark + struct.pack(">H", 2 + len(b)) + b
    return b"\xff\xd8" + segment(b"\xe0", b"JFIF\0\1\2\0\0\1\0\1\0\0") + (segment(b"\xe1", EXIF_HEAD + block) if block else b"") + b"\xff\xd9"
