"""Decoding of plain image formats, sizes, and difference maps."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from provq.functions import pixels
from provq.sources import formats as sources


def picture(h=40, w=30, k=3, seed=1):
    return np.random.default_rng(seed).integers(0, 256, (h, w, k)).astype(np.uint8)


def filtered_png(m, how):
    """A PNG whose lines all use one filter, made by its definition."""
    h, w, k = m.shape
    flat, lines = m.reshape(h, w * k).astype(int), []
    for y in range(h):
        up = flat[y - 1] if y else np.zeros(w * k, int)
        left, corner = np.r_[np.zeros(k, int), flat[y][:-k]], np.r_[np.zeros(k, int), up[:-k]]
        p = left + up - corner
        pa, pb, pc = abs(p - left), abs(p - up), abs(p - corner)
        paeth = np.where((pa <= pb) & (pa <= pc), left, np.where(pb <= pc, up, corner))
        lines.append(bytes([how]) + bytes(((flat[y] - [0 * up, left, up, (left + up) // 2, paeth][how]) % 256).astype(np.uint8)))
    chunk = lambda kind, part: struct.pack(">I", len(part)) + kind + part + struct.pack(">I", zlib.crc32(kind + part))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[k], 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(lines))) + chunk(b"IEND", b"")


@pytest.mark.parametrize("how", range(5))
def test_png_filters(how):
    m = picture()
    assert np.array_equal(pixels.decode(filtered_png(m, how)), m)
    four = picture(k=4)
    assert np.array_equal(pixels.decode(filtered_png(four, how)), four[:, :, :3])


def test_formats_come_back():
    m = picture()
    assert np.array_equal(pixels.decode(pixels.png(m)), m) and np.array_equal(pixels.decode(pixels.png(m[:, :, 0])), m[:, :, :1])
    assert np.array_equal(pixels.decode(b"P6\n# a note\n30 40\n255\n" + m.tobytes()), m)
    assert np.array_equal(pixels.decode(b"P5 30 40 255\n" + m[:, :, 0].tobytes()), m[:, :, :1])
    bits = (m[:, :, 0] > 127).astype(np.uint8)
    assert np.array_equal(pixels.decode(b"P4 30 40\n" + np.packbits(bits, axis=1).tobytes())[:, :, 0], (1 - bits) * 255)
    rows = np.pad(m[::-1, :, ::-1].reshape(40, 90), ((0, 0), (0, 2))).tobytes()
    assert np.array_equal(pixels.decode(b"BM" + struct.pack("<IIIIiiHHIIiiII", 54 + len(rows), 0, 54, 40, 30, 40, 1, 24, 0, len(rows), 0, 0, 0, 0) + rows), m)
    for broken in (None, b"", b"GIF89a", b"P6 9", b"BM", pixels.png(m)[:60], b"P5 30 40 255\n12"):
        assert pixels.decode(broken) is None


def test_sizes():
    assert pixels.working_size(640, 480) == (640, 480)
    w, h = pixels.working_size(8000, 6000)
    assert abs(w * h - pixels.MOST_PIXELS) < 3000 and abs(w / h - 4 / 3) < 0.01
    flat = np.full((10, 12, 3), 7, np.uint8)
    assert (pixels.resized(flat, 5, 4) == 7).all() and np.array_equal(pixels.resized(picture(), 30, 40), picture())


def test_difference_maps(spark):
    a = np.full((120, 120, 3), 100, np.uint8)
    b = a.copy()
    b[30:70, 30:70] = 220
    m, modified, everywhere, share = pixels.difference_map(a, b)
    assert modified and not everywhere and 0 < share < 0.3 and m[50, 50] > 0.9 * m.max() and m[100, 100] < 0.1 * m.max()
    assert pixels.difference_map(a, a) == (None, False, False, -1.0)
    mask = pixels.mean_mask([m, m])
    assert mask[50, 50] == 255 and mask[100, 100] == 0
    rows = spark.createDataFrame([(1, pixels.png(a), pixels.png(b)), (2, pixels.png(a), pixels.png(a)), (3, b"x", None)], "key bigint, a binary, b binary")
    got = {r["key"]: r for r in pixels.compared(rows).collect()}
    assert got[1]["modified"] and pixels.decode(bytes(got[1]["map"])).shape == (120, 120, 1) and got[2]["modified"] is False and got[3]["modified"] is None


def test_images_are_read(spark, tmp_path):
    m = picture()
    (tmp_path / "a.png").write_bytes(pixels.png(m))
    (tmp_path / "b.jpg").write_bytes(b"not an image")
    (tmp_path / "c.txt").write_text("x")
    got = {r["path"].rpartition("/")[2]: r for r in sources.images(spark, [str(tmp_path)]).collect()}
    assert set(got) == {"a.png", "b.jpg"} and bytes(got["a.png"]["pixels"]) == m.tobytes() and got["b.jpg"]["width"] is None
    assert bytes(sources.images(spark, [str(tmp_path)], flip=True).filter(F.col("width").isNotNull()).first()["pixels"]) == m[::-1].tobytes()
