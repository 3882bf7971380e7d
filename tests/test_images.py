"""PNG rasters and photo tags against what was written."""

import random
import struct
import zlib

import numpy as np
import pytest

from plumbline.sources import images


@pytest.mark.parametrize("kind", [np.uint8, np.uint16])
@pytest.mark.parametrize("filters", [(0,), (1,), (2,), (3,), (4,), (4, 2, 3, 0, 1)])
def test_png_round_trip(kind, filters):
    rng = np.random.default_rng(1)
    for shape in ((1, 1), (7, 5), (24, 32)):
        raster = rng.integers(0, np.iinfo(kind).max + 1, shape).astype(kind)
        raster[: shape[0] // 2] //= 50
        assert (images.grey_png(images.put_png(raster, filters)) == raster).all()


def test_png_by_hand():
    """A file put together without the library: 16 bits, the second row says its difference from the first."""
    chunk = lambda kind, b: struct.pack(">I", len(b)) + kind + b + struct.pack(">I", zlib.crc32(kind + b))
    lines = b"\0" + struct.pack(">2H", 300, 65535) + b"\2" + bytes([0, 1, 0, 1])
    body = zlib.compress(lines)
    data = images.PNG_HEAD + chunk(b"IHDR", struct.pack(">IIBBBBB", 2, 2, 16, 0, 0, 0, 0)) + chunk(b"tEXt", b"x\0y") + chunk(b"IDAT", body[:5]) + chunk(b"IDAT", body[5:]) + chunk(b"IEND", b"")
    assert images.grey_png(data).tolist() == [[300, 65535], [301, 65280]]
    colour = images.PNG_HEAD + chunk(b"IHDR", struct.pack(">IIBBBBB", 2, 2, 8, 2, 0, 0, 0))
    bomb = images.PNG_HEAD + chunk(b"IHDR", struct.pack(">IIBBBBB", 1 << 30, 1 << 30, 8, 0, 0, 0, 0))
    for bad in (b"", b"GIF89a", images.PNG_HEAD, data[:60], colour, bomb, data.replace(body[:5], b"\1\2\3\4\5")):
        with pytest.raises((ValueError, zlib.error)):
            images.grey_png(bad)


def test_png_files(spark, tmp_path):
    raster = np.arange(48, dtype=np.uint16).reshape(6, 8) * 1000
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "1.png").write_bytes(images.put_png(raster, (4, 3)))
    (tmp_path / "b.txt").write_text("no image")
    files = images.image_files(spark, str(tmp_path), "*.png")
    got = {(r.u, r.v): r.value for r in images.png_pixels(files, 3).collect()}
    assert got == {(u, v): int(raster[v, u]) for v in (0, 3) for u in (0, 3, 6)}
    with pytest.raises(Exception, match="could not read"):
        images.png_pixels(spark.createDataFrame([("x.png", b"no")], "path string, content binary")).count()
    assert images.png_pixels(files.where("false")).count() == 0


def test_tags_of_every_kind_of_file():
    for order in "<>":
        for make, model in (("Maker", "Model 7"), ("M", "Y"), ("", "a" * 300), ("é", "日本")):
            block = images.put_tags(make, model, order)
            for kind in ("jpeg", "png", "tiff"):
                assert images.tags(images.tag_block(images.put_photo(kind, block))) == {images.MAKE: make, images.MODEL: model}
    assert images.tags(images.tag_block(images.put_photo("jpeg", b""))) == images.tags(b"") == {}


def test_broken_tags_end_quietly():
    r = random.Random(2)
    for kind in ("jpeg", "png", "tiff"):
        whole = images.put_photo(kind, images.put_tags("Maker", "Model", "<"))
        for cut in range(len(whole)):
            images.tags(images.tag_block(whole[:cut]))
        for _ in range(500):
            broken = bytearray(whole)
            for _ in range(3):
                broken[r.randrange(len(broken))] = r.randrange(256)
            images.tags(images.tag_block(bytes(broken)))
    far = b"II*\0" + struct.pack("<IHHHII", 8, 1, images.MAKE, 2, 1 << 31, 1 << 31) + bytes(4)
    assert images.tags(far) == {}


def test_devices(spark):
    photo = lambda make, model: images.put_photo("jpeg", images.put_tags(make, model, ">"))
    rows = [("one", "1", photo("Apple", "iPhone 15")), ("one", "2", photo("Apple\0", "  iPhone   15 ")), ("one", "3", b"broken"), ("said", "4", photo("apple", "Apple iPhone")), ("two", "5", photo("B", "x")), ("two", "6", photo("", "Ay")), ("none", "7", b""), ("none", "8", None), ("make", "9", photo("Only", ""))]
    files = spark.createDataFrame([(f"{c}/{p}", x) for c, p, x in rows], "path string, content binary")
    named = images.cameras(files).selectExpr("split(path, '/')[0] AS capture", "make", "model")
    got = {r.capture: r.device for r in images.photo_device(named, "capture").collect()}
    said = " (EXIF; OS and capture app unknown)"
    assert got == {"one": f"Apple iPhone 15{said}", "said": f"Apple iPhone{said}", "two": "Mixed camera models in photo EXIF: Ay; B x", "none": None, "make": f"Only{said}"}
