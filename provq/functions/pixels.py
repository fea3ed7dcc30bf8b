"""Images as arrays: decoding and writing of plain formats, sizes, and maps of what differs between two images.

Only numpy and the standard library: PNM (P4 to P6), uncompressed BMP and PNG of 8 bits without interlacing. What can't be decoded is None, not an error.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Pixels of an image at most, and from where on an image counts as too large; weights of the grey value.
MOST_PIXELS, TOO_LARGE = 2_073_600, 3 * 2**24
GREY = (0.299, 0.587, 0.114)


def decode(content: bytes | None) -> np.ndarray | None:
    """(height, width, channels) of bytes, or None."""
    if not content:
        return None
    for start, read in ((b"P", _pnm), (b"BM", _bmp), (b"\x89PNG\r\n\x1a\n", _png)):
        if content.startswith(start):
            try:
                return read(content)
            except (ValueError, IndexError, KeyError, struct.error, zlib.error):
                return None
    return None


def _pnm(c: bytes) -> np.ndarray:
    kind = c[:2].decode("ascii")
    n = {"P4": 2, "P5": 3, "P6": 3}[kind]
    head = re.match(rb"P\d" + rb"(?:\s+(?:#[^\n]*\n\s*)*(\d+))" * n + rb"\s", c)
    if not head:
        raise ValueError("no header")
    w, h = int(head[1]), int(head[2])
    body = np.frombuffer(c, np.uint8, offset=head.end())
    if kind == "P4":
        row = -(-w // 8)
        return (1 - np.unpackbits(body[: row * h].reshape(h, row), axis=1)[:, :w, None]) * np.uint8(255)
    if int(head[3]) != 255:
        raise ValueError("8 bits only")
    k = 3 if kind == "P6" else 1
    return body[: h * w * k].reshape(h, w, k)


def _bmp(c: bytes) -> np.ndarray:
    at, _, w, h, _, depth, packed = struct.unpack_from("<IIiiHHI", c, 10)
    if packed or depth not in (24, 32):
        raise ValueError("plain bitmaps only")
    k = depth // 8
    row = -(-w * k // 4) * 4
    m = np.frombuffer(c, np.uint8, count=row * abs(h), offset=at).reshape(abs(h), row)[:, : w * k].reshape(abs(h), w, k)
    return (m[::-1] if h > 0 else m)[:, :, [2, 1, 0]]


def _png(c: bytes) -> np.ndarray:
    at, data, head = 8, b"", None
    while at < len(c):
        n, kind = struct.unpack_from(">I4s", c, at)
        part = c[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            data += part
        at += 12 + n
    w, h, depth, colour, _, _, interlaced = head
    if depth != 8 or interlaced or colour not in (0, 2, 4, 6):
        raise ValueError("8 bits without interlacing only")
    k = {0: 1, 2: 3, 4: 2, 6: 4}[colour]
    raw = np.frombuffer(zlib.decompress(data), np.uint8).reshape(h, w * k + 1)
    out, before = np.zeros((h, w * k), np.uint8), np.zeros(w * k, np.int64)
    for y in range(h):
        line, how = raw[y, 1:].astype(np.int64), raw[y, 0]
        if how == 2:
            line = line + before
        elif how == 1:
            line = np.cumsum(line.reshape(w, k), axis=0).ravel()
        elif how in (3, 4):
            for i in range(w * k):
                left, up, corner = (line[i - k] if i >= k else 0), before[i], (before[i - k] if i >= k else 0)
                if how == 3:
                    guess = (left + up) // 2
                else:
                    guess = min((left, up, corner), key=lambda v, p=left + up - corner: abs(p - v))
                line[i] = (line[i] + guess) % 256
        out[y] = before = line % 256
        before = before.astype(np.int64)
    m = out.reshape(h, w, k)
    return m[:, :, :1] if colour == 4 else m[:, :, :3] if colour == 6 else m


def png(image: np.ndarray) -> bytes:
    """An array of bytes, one channel or three, as PNG."""
    m = image if image.ndim == 3 else image[:, :, None]
    h, w, k = m.shape
    chunk = lambda kind, part: struct.pack(">I", len(part)) + kind + part + struct.pack(">I", zlib.crc32(kind + part))
    lines = np.concatenate([np.zeros((h, 1), np.uint8), m.reshape(h, w * k).astype(np.uint8)], axis=1)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2}[k], 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def working_size(width: int, height: int) -> tuple[int, int]:
    """The size that a too large image is brought down to, its shape kept."""
    if width * height <= MOST_PIXELS:
        return width, height
    shape = height / width
    w = round(np.sqrt(MOST_PIXELS / shape))
    return w, round(shape * w)


def resized(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Bilinear between pixel centres."""
    h, w = image.shape[:2]
    y, x = (np.clip((np.arange(n) + 0.5) * size / n - 0.5, 0, size - 1) for n, size in ((height, h), (width, w)))
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = (y - y0)[:, None, None], (x - x0)[None, :, None]
    m = image.astype(float)
    top = m[y0][:, x0] * (1 - fx) + m[y0][:, x1] * fx
    return np.rint(top * (1 - fy) + (m[y1][:, x0] * (1 - fx) + m[y1][:, x1] * fx) * fy).astype(image.dtype)


def grey(image: np.ndarray) -> np.ndarray:
    return image[:, :, :3] @ np.array(GREY) if image.shape[2] >= 3 else image[:, :, 0].astype(float)


def blurred(m: np.ndarray, sigma: float = 5.0) -> np.ndarray:
    """Gaussian blur, cut at two deviations; borders are mirrored."""
    r = int(np.ceil(2 * sigma))
    k = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma * sigma))
    k /= k.sum()
    for axis in (0, 1):
        pad = [(r, r) if a == axis else (0, 0) for a in (0, 1)]
        m = np.apply_along_axis(np.convolve, axis, np.pad(m, pad, mode="reflect" if m.shape[axis] > r else "symmetric"), k, "valid")
    return m


def difference_map(a: np.ndarray, b: np.ndarray, share: float = 0.06, least: int = 36) -> tuple[np.ndarray | None, bool, bool, float]:
    """(map from 0 to 1, modified, changed all over, share of the changed area) of two images of one size.

    Differences of the blurred grey values are turned into signal-to-noise ratios. Where the largest is below ``share`` of what is possible, or the area near
    it is smaller than ``least`` pixels, the images count as unmodified: no map, a share of -1.
    """
    x, y = blurred(grey(a)), blurred(grey(b))
    d = np.abs(x - y)
    possible = max(abs(x.max() - y.min()), abs(y.max() - x.min()))
    if d.max() < possible * share or (d > d.max() - possible * share * 3.5).sum() < least or d.max() == 0:
        return None, False, False, -1.0
    ratio = 10 * np.log10(255.0**2 / ((d / d.max()) ** 2 + 1))
    changed = float((ratio < ratio.min() * 1.065).mean())
    low, high = min(0.0, ratio.min()), ratio.max()
    scaled = (ratio - low) / (high - low) if high > low else ratio
    return scaled.max() - scaled, True, changed > 0.5, changed


def mean_mask(maps: list[np.ndarray]) -> np.ndarray:
    """The mean of maps of one size, cut into 0 and 255 at the level that separates it best."""
    m = np.mean(maps, axis=0)
    level = np.floor((m - m.min()) / max(m.max() - m.min(), 1e-12) * 255).astype(int)
    n = np.bincount(level.ravel(), minlength=256).astype(float)
    below, total, weighted = np.cumsum(n), n.sum(), np.cumsum(n * np.arange(256))
    with np.errstate(divide="ignore", invalid="ignore"):
        between = below / total * (1 - below / total) * (weighted / below - (weighted[-1] - weighted) / (total - below)) ** 2
    return np.where(level > np.nan_to_num(between).argmax(), 255, 0).astype(np.uint8)


def compared(pairs: DataFrame) -> DataFrame:
    """pairs(key BIGINT, a BINARY, b BINARY) -> (key, modified, everywhere, share, map BINARY): encoded images compared; null where one can't be decoded.

    The second image is brought to the size of the first, both to the working size; the map is a PNG.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, a, b in zip(batch["key"], batch["a"], batch["b"]):
                x, y = decode(a), decode(b)
                if x is None or y is None:
                    out.append((key, None, None, None, None))
                    continue
                w, h = working_size(x.shape[1], x.shape[0])
                m, modified, everywhere, share = difference_map(resized(x, w, h), resized(y, w, h))
                out.append((key, modified, everywhere, share, None if m is None else png(np.rint(m * 255))))
            yield pd.DataFrame(out, columns=["key", "modified", "everywhere", "share", "map"])

    return pairs.select("key", "a", "b").mapInPandas(run, "key bigint, modified boolean, everywhere boolean, share double, map binary")
