"""Words of whole texts in numpy: where they lie, which are equal, and 64-bit hashes of the distinct ones.

A table gives each byte a kind: part of a word (0), a blank between words (1) or a mark that ends a piece (2).
All blanks and marks are ASCII, so bytes of longer UTF-8 characters always belong to words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

#: A-Z count as a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def kinds(blanks: bytes, marks: bytes = b"") -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[list(blanks)] = 1
    out[list(marks)] = 2
    return out


#: ASCII white space parts words.
SPACES = kinds(b"\x20\x09\x0a\x0b\x0c\x0d")


@dataclass
class Words:
    """The words of some texts in order: their row, piece (a number that only grows), code, and the
    distinct words that codes stand for; words of each row."""

    row: np.ndarray
    piece: np.ndarray
    code: np.ndarray
    distinct: pa.Array
    counts: np.ndarray


def split(texts: pa.Array, kind: np.ndarray) -> Words:
    """The words of all texts; a null text has none."""
    texts = texts.cast(pa.large_binary())
    texts = texts.fill_null(b"") if texts.null_count else texts
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    nothing = np.zeros(0, np.int64)
    if offsets[-1] == offsets[0]:
        return Words(nothing, nothing, nothing, pa.array([], pa.large_binary()), np.zeros(n, np.int64))
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    of = kind[data]
    inside = of == 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts], last[cuts - 1] = inside[cuts], inside[cuts - 1]
    begins, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    counts = np.diff(np.searchsorted(begins, offsets))
    places = np.concatenate([[0], np.cumsum(ends - begins)])
    flat = LOWER[data[inside]]
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(places), pa.py_buffer(flat)]).dictionary_encode()
    row = np.repeat(np.arange(n), counts)
    # a text's end ends a piece as a mark does
    piece = np.searchsorted(np.flatnonzero(of == 2), begins) + row
    return Words(row, piece, coded.indices.to_numpy().astype(np.int64), coded.dictionary, counts)


def hashes(values: pa.Array) -> np.ndarray:
    """A 64-bit keyed hash (SipHash) of each value."""
    if not len(values):
        return np.zeros(0, np.uint64)
    return pd.util.hash_array(np.array([*values.to_pylist(), None], dtype=object)[:-1], categorize=False)


def settle() -> None:
    """Give memory that Arrow keeps for later back to the system: a worker waits idle beside other stages."""
    pa.default_memory_pool().release_unused()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit over all."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def bounded(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with little more than ``most`` bytes of ``column`` each; one row at least."""
    lens = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(lens.tolist()):
        if total and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)
