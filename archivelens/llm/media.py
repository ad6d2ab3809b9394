"""Media columns (operator 2): Netpbm and BMP images in binary columns.

Images are decoded to numpy arrays, resized by exact area averages out of an integral image, and written
as NPY tiles; difference hashes are read off the tiles. ``store`` turns payloads of bytes into images
without loss, ``describe`` makes figures and tiles of images, ``hashed`` adds the tiles' hashes.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archivelens.llm import tokens

#: Payload bytes in a row of samples, and the tile's height and width.
WIDTH, TILE = 64, (32, 32)
FEATURES = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, tile binary, error string"


def encode_pgm(samples: np.ndarray) -> bytes:
    """A binary greyscale Netpbm image of 8-bit samples."""
    return b"P5\n%d %d\n255\n" % samples.shape[::-1] + samples.tobytes()


def encode_bmp(samples: np.ndarray) -> bytes:
    """An uncompressed BMP of 8-bit samples with a palette of greys; rows are stored from the bottom up."""
    height, width = samples.shape
    rows = np.zeros((height, (width + 3) // 4 * 4), np.uint8)
    rows[:, :width] = samples[::-1]
    at = 14 + 40 + 1024
    head = struct.pack("<2sIHHIIiiHHIIiiII", b"BM", at + rows.size, 0, 0, at, 40, width, height, 1, 8, 0, rows.size, 0, 0, 256, 0)
    return head + (np.arange(256, dtype=np.uint8)[:, None] * np.array([1, 1, 1, 0], np.uint8)).tobytes() + rows.tobytes()


def _numbers(data: bytes, at: int, count: int) -> tuple[list[int], int]:
    """``count`` decimal numbers of a Netpbm header; comments run from # to the end of the line."""
    out: list[int] = []
    while len(out) < count:
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at) + 1
            continue
        end = at
        while data[end : end + 1].isdigit():
            end += 1
        if end == at:
            raise ValueError("a number is missing in the header")
        out.append(int(data[at:end]))
        at = end
    return out, at


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 as rows x columns (x 3 in colour); bitmaps give 0 for ink and 1 for paper."""
    kind = data[1] - 48 if len(data) > 1 else 0
    if data[:1] != b"P" or not 1 <= kind <= 6:
        raise ValueError("not a Netpbm image")
    (width, height, *top), at = _numbers(data, 2, 2 if kind in (1, 4) else 3)
    if not width or not height or (top and not 0 < top[0] < 65536):
        raise ValueError("no samples")
    shape = (height, width, 3) if kind in (3, 6) else (height, width)
    count = int(np.prod(shape))
    if kind == 1:
        digits = np.frombuffer(data[at:], np.uint8)
        digits = digits[(digits == 48) | (digits == 49)][:count]
        return (49 - digits).reshape(shape).astype(np.uint8)
    if kind in (2, 3):
        return np.array(data[at:].split()[:count], np.int64).reshape(shape).astype(np.uint8 if top[0] < 256 else np.uint16)
    body = memoryview(data)[at + 1 :]
    if kind == 4:
        rows = np.frombuffer(body, np.uint8, height * ((width + 7) // 8)).reshape(height, -1)
        return (1 - np.unpackbits(rows, axis=1)[:, :width]).astype(np.uint8)
    return np.frombuffer(body, np.uint8 if top[0] < 256 else ">u2", count).reshape(shape)


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 8 (palette), 24 or 32 bits a pixel, as rows x columns x RGB; a palette of greys
    gives rows x columns."""
    if data[:2] != b"BM":
        raise ValueError("not a BMP image")
    (at,) = struct.unpack_from("<I", data, 10)
    header, width, height, _, bits, packed = struct.unpack_from("<IiiHHI", data, 14)
    if packed or bits not in (8, 24, 32):
        raise ValueError("only uncompressed BMP of 8, 24 or 32 bits is read")
    stride = (width * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(data, np.uint8, stride * abs(height), at).reshape(abs(height), stride)[:, : width * bits // 8]
    rows = rows[::-1] if height > 0 else rows
    if bits == 8:
        colours = np.frombuffer(data, np.uint8, at - 14 - header, 14 + header).reshape(-1, 4)
        if (colours[:, :1] == colours[:, 1:3]).all():
            return colours[:, 0][rows]
        return colours[rows][:, :, 2::-1]
    return rows.reshape(abs(height), width, bits // 8)[:, :, 2::-1]


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def grey(image: np.ndarray) -> np.ndarray:
    return image if image.ndim == 2 else image.mean(2)


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over equal areas. The integral of a piecewise constant image is linear between its
    samples along each axis, so a fractional edge is read off by interpolation."""

    def integral_at_edges(values: np.ndarray, parts: int) -> np.ndarray:
        n = values.shape[0]
        sums = np.zeros((n + 1, *values.shape[1:]))
        np.cumsum(values, axis=0, out=sums[1:], dtype=np.float64)
        edges = np.arange(parts + 1) * n / parts
        low = np.minimum(edges.astype(np.int64), n - 1)
        part = (edges - low).reshape(-1, *[1] * (values.ndim - 1))
        return sums[low] * (1 - part) + sums[low + 1] * part

    rows = np.diff(integral_at_edges(image, height), axis=0)
    cells = np.diff(integral_at_edges(np.ascontiguousarray(rows.T), width), axis=0).T
    return cells * (height * width / (image.shape[0] * image.shape[1]))


def difference_hash(image: np.ndarray) -> str:
    """64 bits, in hex: whether each of 8 x 9 area means is below its right neighbour."""
    small = area_resize(image, 8, 9)
    return np.packbits(small[:, :-1] + 1e-9 < small[:, 1:]).tobytes().hex()


def npy(image: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array(out, np.ascontiguousarray(image), allow_pickle=False)
    return out.getvalue()


def store(docs: DataFrame, width: int = WIDTH, form: str = "netpbm") -> DataFrame:
    """doc_id, n_bytes, media: each whole text's UTF-8 bytes, filled up with zeros to a positive
    multiple of ``width``, as rows of 8-bit samples of a greyscale image. All are in one ``form``: binary
    "netpbm", or "bmp".

    A null text is empty; null and repeated doc_ids are ordinary rows; extra columns are left out; an
    empty table gives no rows.
    """
    encode = {"netpbm": encode_pgm, "bmp": encode_bmp}[form]

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tokens.slices(batch, "text"):
                sizes, media = [], []
                for text in part.column("text").to_pylist():
                    data = (text or "").encode()
                    rows = max(1, -(-len(data) // width))
                    sizes.append(len(data))
                    samples = np.frombuffer(data.ljust(rows * width, b"\0"), np.uint8).reshape(rows, width)
                    media.append(encode(samples))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(draw, "doc_id long, n_bytes long, media binary")


def describe(media: DataFrame) -> DataFrame:
    """doc_id with figures of the image in ``media`` (doc_id, n_bytes, media), all out of its bytes.

    payload_bytes, payload_sha256 and tail_crc32 (last 64 bytes) are of the decoded samples,
    media_bytes and media_sha256 of the stored form; tile is the area-resized image as NPY. A null
    image gives nulls; one that can't be decoded as well, but for media_bytes, media_sha256 and an
    error. Null and repeated doc_ids are ordinary rows; extra columns are left out; an empty table
    gives no rows.
    """

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in FEATURES.split(", ")]
        types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        schema = pa.schema([("doc_id", pa.int64()), *((c.split()[0], types[c.split()[1]]) for c in FEATURES.split(", "))])
        for batch in batches:
            for part in tokens.slices(batch, "media"):
                out: dict[str, list] = {n: [] for n in names}
                for n_bytes, data in zip(part.column("n_bytes").to_pylist(), part.column("media").to_pylist(), strict=True):
                    row = [n_bytes, *[None] * (len(names) - 1)]
                    if data is not None:
                        row[4:6] = len(data), hashlib.sha256(data).hexdigest()
                        try:
                            image = decode(data)
                            row[6] = npy(np.rint(area_resize(grey(image), *TILE)).astype(np.uint8 if image.dtype == np.uint8 else np.uint16))
                            payload = image.tobytes()
                            row[1:4] = len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])
                        except (ValueError, IndexError, OverflowError, struct.error) as error:
                            row[7] = f"{type(error).__name__}: {error}"
                    for n, v in zip(names, row, strict=True):
                        out[n].append(v)
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), **out}, schema=schema)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(look, f"doc_id long, {FEATURES}")


def hashed(tiles: DataFrame) -> DataFrame:
    """The rows of ``tiles`` with ``feature``, the difference hash of the NPY array in ``tile``.

    A null tile gives a null, as does one that isn't an array of rows and columns; other columns are
    kept, a clashing feature is replaced; an empty table stays empty.
    """

    @F.pandas_udf("string")
    def own(tile: pd.Series) -> pd.Series:
        def one(data: bytes | None) -> str | None:
            try:
                return None if data is None else difference_hash(np.load(io.BytesIO(data), allow_pickle=False))
            except (ValueError, IndexError, EOFError):
                return None

        return pd.Series([one(x) for x in tile], dtype="object")

    return tiles.withColumn("feature", own("tile"))
