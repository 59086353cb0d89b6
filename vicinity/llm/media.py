"""Media columns: Netpbm and BMP images to numpy arrays, area-resized, as NPY tiles with difference hashes.

``wrap`` stores bytes as the samples of an image, ``decode`` reads an image of either format back,
``resize`` averages areas by integral images, ``npy`` writes an array in NPY form and
``difference_hash`` compares neighbouring cells of a small grey image.

A null image gives nulls; so does one of another format or a damaged one, with ``error`` saying why.
Stored texts: a null text counts as empty, and an empty payload is one row of spaces. Repeated rows
stay; an empty table gives none. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import pieces

#: Samples in a row of a stored payload: 64 pixels of 3 samples.
ROW = 192
TILE = 32
#: Rows of a picture that are summed at once.
BAND = 4096
_NUMBER = re.compile(rb"(?:\s|#[^\n\r]*[\n\r])*(\d+)")


def wrap(payload: bytes) -> bytes:
    """A binary pixmap (P6) whose samples are ``payload``, 64 pixels wide; its size must be a positive multiple of 192."""
    if not payload or len(payload) % ROW:
        raise ValueError("a payload has a positive multiple of 192 bytes")
    return b"P6\n%d %d\n255\n" % (ROW // 3, len(payload) // ROW) + payload


def wrap_bmp(pixels: np.ndarray) -> bytes:
    """An uncompressed 24-bit BMP of (height, width, 3) samples in red, green, blue order."""
    height, width, _ = pixels.shape
    rows = np.zeros((height, -(-width * 3 // 4) * 4), np.uint8)
    rows[:, : width * 3] = pixels[::-1, :, ::-1].reshape(height, -1)
    return struct.pack("<2sIHHI", b"BM", 54 + rows.size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, rows.size, 2835, 2835, 0, 0) + rows.tobytes()


def _netpbm(data: bytes) -> np.ndarray:
    kind, at, numbers = data[1] - 48, 2, []
    for _ in range(2 if kind in (1, 4) else 3):
        found = _NUMBER.match(data, at)
        if not found:
            raise ValueError("a header number is missing")
        numbers.append(int(found[1]))
        at = found.end()
    width, height, most = (*numbers, 1)[:3]
    if not 0 < most < 65536 or not width or not height:
        raise ValueError("bad size or depth")
    channels = 3 if kind in (3, 6) else 1
    n = width * height * channels
    if kind <= 3:
        body = re.sub(rb"#[^\n\r]*", b"", data[at:])
        samples = np.array([b - 48 for b in body if b in b"01"][:n] if kind == 1 else body.split()[:n], np.uint16)
    elif kind == 4:
        step = -(-width // 8)
        packed = np.frombuffer(data, np.uint8, step * height, at + 1)
        samples = np.unpackbits(packed.reshape(height, step), axis=1)[:, :width].ravel()
    else:
        samples = np.frombuffer(data, np.uint8 if most < 256 else ">u2", n, at + 1)
    if len(samples) != n:
        raise ValueError("samples are missing")
    if kind in (1, 4):
        samples = 255 * (1 - samples.astype(np.uint8))
    elif most != 255:
        samples = (samples.astype(np.uint32) * 255 + most // 2) // most
    return samples.astype(np.uint8, copy=False).reshape(height, width, channels)


def _bmp(data: bytes) -> np.ndarray:
    (start,) = struct.unpack_from("<I", data, 10)
    header, width, height, _, bits, packing = struct.unpack_from("<IiiHHI", data, 14)
    if packing or bits not in (8, 24, 32) or width <= 0 or not height:
        raise ValueError("only uncompressed 8, 24 and 32-bit bitmaps")
    step = -(-width * bits // 32) * 4
    rows = np.frombuffer(data, np.uint8, step * abs(height), start).reshape(abs(height), step)
    rows = rows[::-1] if height > 0 else rows
    if bits == 8:
        (used,) = struct.unpack_from("<I", data, 46)
        palette = np.frombuffer(data, np.uint8, 4 * (used or 256), 14 + header).reshape(-1, 4)
        return palette[rows[:, :width], 2::-1]
    return rows[:, : width * bits // 8].reshape(abs(height), width, -1)[:, :, 2::-1]


def decode(data: bytes) -> np.ndarray:
    """(height, width, channels) samples of 8 bits from a Netpbm (P1 to P6) or BMP image."""
    if len(data) > 2 and data[:1] == b"P" and data[1] in b"123456":
        return _netpbm(data)
    if data[:2] == b"BM":
        return _bmp(data)
    raise ValueError("neither Netpbm nor BMP")


def _rows_of_integral(pixels: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The integral image's rows ``wanted`` (sums of all pixels above), summed down the picture in bands."""
    places, back = np.unique(wanted, return_inverse=True)
    out = np.zeros((len(places), *pixels.shape[1:]))
    total = np.zeros(pixels.shape[1:])
    for start in range(0, len(pixels), BAND):
        sums = total + pixels[start : start + BAND].cumsum(0, dtype=np.float64)
        here = (places > start) & (places <= start + len(sums))
        out[here] = sums[places[here] - start - 1]
        total = sums[-1]
    return out[back]


def resize(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of each cell's area, whole and partial pixels, from an integral image of which only the rows at cells' edges are kept."""

    def between(edges: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        low = np.minimum(edges.astype(np.int64), size - 1)
        return low, (edges - low).reshape(-1, 1, 1)

    low, part = between(np.linspace(0, pixels.shape[0], height + 1), pixels.shape[0])
    above = _rows_of_integral(pixels, np.concatenate([low, low + 1]))
    rows = np.diff(above[: height + 1] * (1 - part) + above[height + 1 :] * part, axis=0)
    sums = np.concatenate([np.zeros((1, height, pixels.shape[2])), rows.swapaxes(0, 1).cumsum(0)])
    low, part = between(np.linspace(0, pixels.shape[1], width + 1), pixels.shape[1])
    cells = np.diff(sums[low] * (1 - part) + sums[low + 1] * part, axis=0).swapaxes(0, 1)
    return cells * (height * width / (pixels.shape[0] * pixels.shape[1]))


def grey(pixels: np.ndarray) -> np.ndarray:
    """One channel, by the luma weights of Rec. 601."""
    return pixels if pixels.shape[2] == 1 else (pixels[:, :, :3] @ np.array([0.299, 0.587, 0.114]))[:, :, None]


def difference_hash(pixels: np.ndarray) -> str:
    """64 bits: is a cell of an 8 by 9 grey image darker than the one to its right?"""
    small = np.round(grey(resize(pixels, 8, 9))[:, :, 0], 6)
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def npy(pixels: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, np.ascontiguousarray(pixels))
    return out.getvalue()


def tile(pixels: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(resize(pixels, TILE, TILE)), 0, 255).astype(np.uint8)


def features(media: DataFrame, column: str = "media") -> DataFrame:
    """``doc_id``, height, width, channels, the NPY tile and the difference hash of each image."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "height", "width", "channels", "tile", "feature", "error"]
        for b in pieces(batches, 500):
            rows = []
            for data in b.column("media").to_pylist():
                try:
                    pixels = decode(data) if data is not None else None
                    rows.append((None,) * 6 if pixels is None else (*pixels.shape, npy(tile(pixels)), difference_hash(pixels), None))
                except (ValueError, IndexError, struct.error) as e:
                    rows.append((None,) * 5 + (str(e),))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int32()] * 3 + [pa.binary(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    return media.selectExpr("cast(doc_id as bigint) doc_id", f"cast(`{column}` as binary) media").mapInArrow(run, "doc_id long, height int, width int, channels int, tile binary, feature string, error string")


def store(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_bytes`` and ``media``: each text's bytes, padded with spaces to whole rows, as a pixmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 1000):
            texts = [t or b"" for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array([wrap(pad(t)) for t in texts], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as binary) text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def pad(text: bytes) -> bytes:
    """``text`` and spaces (byte 32) up to a positive multiple of 192 bytes."""
    return text.ljust(max(ROW, -(-len(text) // ROW) * ROW), b" ")


def read_back(stored: DataFrame) -> DataFrame:
    """Digests of each stored image and of the payload decoded from it, with its tile's digest and hash."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "tile_sha256", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 1000):
            rows = []
            for data in b.column("media").to_pylist():
                pixels = decode(data)
                payload = pixels.tobytes()
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), hashlib.sha256(npy(tile(pixels))).hexdigest(), difference_hash(pixels)))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    return stored.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, tile_sha256 string, feature string")
