"""Text bytes as images: Netpbm and BMP files, decoded to arrays, resized, tiled and fingerprinted.

Edge cases: null text is empty; the payload always has a positive multiple of 192 bytes, so the
image has 64 columns of RGB and at least one row. Equal texts give equal values. Every row gives
one row; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import python_ready

ROW = 192
TILE = 16
_OUT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile_npy binary"


def encode_ppm(pixels: np.ndarray) -> bytes:
    return b"P6\n%d %d\n255\n" % (pixels.shape[1], pixels.shape[0]) + pixels.tobytes()


def encode_bmp(pixels: np.ndarray) -> bytes:
    """24 bits a pixel, rows from the bottom, each padded to four bytes."""
    height, width, _ = pixels.shape
    pad = -3 * width % 4
    rows = np.zeros((height, 3 * width + pad), np.uint8)
    rows[:, : 3 * width] = pixels[::-1, :, ::-1].reshape(height, -1)
    body = rows.tobytes()
    return struct.pack("<2sIHHI", b"BM", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, len(body), 2835, 2835, 0, 0) + body


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 as rows x columns x channels, scaled to 0 to 255; white space and # comments as the format has them. A depth above 255 is refused."""
    kind, at, head = data[1:2], 2, []
    for _ in range(2 if kind in b"14" else 3):
        m = re.compile(rb"(?:\s|#[^\n]*\n)+(\d+)").match(data, at)
        if not m:
            raise ValueError("not a Netpbm header")
        head.append(int(m[1]))
        at = m.end()
    width, height = head[:2]
    depth = head[2] if len(head) > 2 else 255
    if not 0 < depth < 256:
        raise ValueError("only Netpbm of up to 255 levels")
    if kind in b"123":  # plain numbers, among which comments may stand
        data = data[:at] + re.sub(rb"#[^\n]*", b"", data[at:])
    channels = 3 if kind in b"36" else 1
    count = width * height * channels
    if kind == b"4":
        bits = np.unpackbits(np.frombuffer(data, np.uint8, height * (-(-width // 8)), at + 1).reshape(height, -1), axis=1)[:, :width]
        return ((1 - bits) * 255).astype(np.uint8)[..., None]
    if kind in b"56":
        flat = np.frombuffer(data, np.uint8, count, at + 1)
    elif kind == b"1":
        flat = np.array([0 if x == b"1" else 255 for x in re.findall(rb"[01]", data[at:])[:count]], np.uint8)
    else:
        flat = np.array(data[at:].split()[:count], np.int64).astype(np.uint8)
    if depth < 255 and kind in b"2356":
        flat = (flat.astype(np.int64) * 255 // depth).clip(0, 255).astype(np.uint8)
    return flat.reshape(height, width, channels)


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 8 (palette), 24 or 32 bits."""
    start, = struct.unpack_from("<I", data, 10)
    head, width, height, _, bits, packed = struct.unpack_from("<IiiHHI", data, 14)
    if packed or bits not in (8, 24, 32):
        raise ValueError("only uncompressed BMP of 8, 24 or 32 bits")
    step = -(-width * bits // 32) * 4
    rows = np.frombuffer(data, np.uint8, step * abs(height), start).reshape(abs(height), step)[:, : width * bits // 8]
    rows = rows[::-1] if height > 0 else rows
    if bits == 8:
        colors = np.frombuffer(data, np.uint8, start - 14 - head, 14 + head).reshape(-1, 4)[:, 2::-1]
        return colors[rows]
    return rows.reshape(abs(height), width, bits // 8)[..., 2::-1]


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def area_resize(gray: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean over each target cell, with fractions of pixels at its edges, from an integral image."""
    total = np.zeros((gray.shape[0] + 1, gray.shape[1] + 1))
    total[1:, 1:] = gray.cumsum(0, dtype=float).cumsum(1)

    def along(a: np.ndarray, cells: int) -> np.ndarray:
        at = np.arange(cells + 1) * ((len(a) - 1) / cells)
        low = np.minimum(at.astype(int), len(a) - 2)
        part = (at - low)[:, None]
        return a[low] * (1 - part) + a[low + 1] * part

    corners = along(along(total, height).T, width).T
    sums = corners[1:, 1:] - corners[:-1, 1:] - corners[1:, :-1] + corners[:-1, :-1]
    return sums / (gray.shape[0] / height * gray.shape[1] / width)


def difference_hash(gray: np.ndarray) -> str:
    """64 bits: is each of 8 x 8 cells darker than its right neighbour; 16 hex digits."""
    cells = np.round(area_resize(gray, 8, 9), 6)
    return np.packbits(cells[:, 1:] > cells[:, :-1]).tobytes().hex()


def npy(tile: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, tile)
    return out.getvalue()


def media_row(raw: bytes, kind: str) -> tuple:
    payload = raw + b" " * ((-len(raw) % ROW) if raw else ROW)
    pixels = np.frombuffer(payload, np.uint8).reshape(-1, ROW // 3, 3)
    stored = encode_bmp(pixels) if kind == "bmp" else encode_ppm(pixels)
    back = decode(stored)
    read = back.tobytes()
    gray = back.mean(axis=2)
    tile = npy(np.round(area_resize(gray, TILE, TILE)).astype(np.uint8))
    feature = f"{difference_hash(gray)}:{zlib.crc32(tile):08x}"
    return len(raw), len(read), hashlib.sha256(read).hexdigest(), zlib.crc32(read[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), feature, tile


def kind_of(raw: bytes) -> str:
    """ppm or bmp, by a hash of the text, so that equal texts have equal forms and both are in use."""
    return ("ppm", "bmp")[zlib.crc32(raw) & 1]


def media_columns(docs: DataFrame, kind: str | None = None) -> DataFrame:
    """A row for each document: the stored image's digests, its difference hash and an NPY tile of 16 x 16 gray means.

    kind is ppm or bmp, or None for either by kind_of(); both store the payload losslessly.
    """
    python_ready(docs.sparkSession)

    def rows(batches):
        for b in batches:
            got = [media_row(x or b"", kind or kind_of(x or b"")) for x in b.column(1).to_pylist()]
            cols = list(zip(*got, strict=True)) if got else [()] * 8
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], [x.split()[0] for x in _OUT.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("raw")).mapInArrow(rows, _OUT)
