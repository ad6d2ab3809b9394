"""Which keywords occur in which texts, for many of both: an index of byte grams.

Each keyword is keyed by the rarest of its grams of three bytes (a shorter keyword by all its bytes). Which grams
are keys is a set of bits of fixed size, sent to every task; a text reports those of its grams that are keys, each
once; texts and keywords meet by an equality on the gram, and only such pairs are compared.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from archivelens.functions import scratch

#: Bytes of a gram at most; where the codes of grams of each size begin, and how many there are in all.
SIZE = 3
BASE = {3: 0, 2: 1 << 24, 1: (1 << 24) + (1 << 16)}
CODES = (1 << 24) + (1 << 16) + (1 << 8)
#: Bytes of text handled at once, and texts that tell which grams are rare (this has no influence on results).
TEXTS, RARE = 1 << 19, 2000


def codes(data: np.ndarray, size: int) -> np.ndarray:
    """The code of the gram of ``size`` bytes at each place."""
    n = max(0, len(data) - size + 1)
    out = data[:n].astype(np.int32)
    for k in range(1, size):
        out = (out << 8) | data[k : n + k]
    return out + BASE[size]


class KeyGrams:
    """Of each text, the distinct grams that are in a set."""

    def __init__(self, wanted: np.ndarray) -> None:
        self.bits = np.packbits(wanted)
        self.sizes = [s for s in (3, 2, 1) if wanted[BASE[s] : BASE.get(s - 1, CODES)].any()]
        self.wanted: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return {"bits": self.bits, "sizes": self.sizes, "wanted": None}

    def of(self, texts: pa.Array) -> pa.ListArray:
        if self.wanted is None:
            self.wanted = np.unpackbits(self.bits, count=CODES).view(bool)
        texts = texts.cast(pa.large_binary())
        texts = texts.fill_null(b"") if texts.null_count else texts
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
        parts, start = [], 0
        cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // TEXTS, prepend=0)) + 1
        for stop in [*cuts.tolist(), len(texts)]:
            if stop > start:
                parts.append(self._slice(texts.slice(start, stop - start)))
                start = stop
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))

    def _slice(self, texts: pa.Array) -> pa.ListArray:
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        ends, keys = offsets - offsets[0], [np.zeros(0, np.int64)]
        for size in self.sizes:
            own = codes(data, size)
            at = np.flatnonzero(self.wanted[own])
            row = np.searchsorted(ends, at, "right") - 1
            inside = at + size <= ends[row + 1]
            keys.append(row[inside] * CODES + own[at[inside]])
        key = np.unique(np.concatenate(keys))
        places = np.searchsorted(key, np.arange(len(texts) + 1) * CODES).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(places), pa.array((key % CODES).astype(np.int32)))


def grams(text: Column, wanted: KeyGrams) -> Column:
    @F.arrow_udf(ArrayType(IntegerType()))
    def own(texts: pa.Array) -> pa.Array:
        found = wanted.of(texts)
        pa.default_memory_pool().release_unused()  # a worker waits idle beside other stages
        return found

    return own(text)


@F.arrow_udf(ArrayType(IntegerType()))
def keyword_grams(words: pa.Array) -> pa.Array:
    """All grams of a keyword of up to ``SIZE`` bytes, of as many as it has if they are fewer; none of an empty one."""
    found = [np.frombuffer(w.encode(), np.uint8) for w in words.to_pylist()]
    return pa.array([np.unique(codes(w, min(SIZE, len(w)))).tolist() if len(w) else [] for w in found], pa.list_(pa.int32()))


def _set(rows: DataFrame) -> KeyGrams:
    """The set of the codes in ``rows`` (gram); there are no more than ``CODES``."""
    wanted = np.zeros(CODES, bool)
    for r in rows.groupBy(F.shiftright("gram", 12).alias("block")).agg(F.collect_set("gram").alias("grams")).collect():
        wanted[r["grams"]] = True
    return KeyGrams(wanted)


def keyed(keywords: DataFrame, texts: DataFrame, rare: int = RARE) -> DataFrame:
    """keyword, gram: the rarest gram of each (distinct, lower-cased) keyword, by some of the ``texts`` (text)."""
    own = keywords.select("keyword", F.explode(keyword_grams("keyword")).alias("gram"))
    some = texts.filter("text is not null").limit(rare).select(grams(F.col("text"), _set(own.select("gram").distinct())).alias("grams"))
    common = some.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    return own.join(common, "gram", "left").groupBy("keyword").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))


def matches(rows: DataFrame, column: str, keywords: DataFrame, rare: int = RARE) -> DataFrame:
    """The rows of ``rows`` beside each distinct keyword (keyword) that occurs in a column, as ``matched``.

    Case doesn't count; ``matched`` is in lower case. A null text holds nothing; null and empty keywords occur
    nowhere. Repeated rows match each; a clashing ``matched`` is replaced; empty tables give no rows.
    """
    asked = keywords.select(F.lower("keyword").alias("keyword")).filter("keyword <> ''").distinct()
    texts = rows.select(F.lower(F.col(column)).alias("text"))
    keys = scratch.stored(keyed(asked, texts, rare), "keys")
    named = keys.select(F.col("keyword").alias("matched"), F.col("gram").alias("__gram"))
    # in lower case once a row, not once more for each of its grams
    met = rows.drop("matched").withColumn("__text", F.lower(F.col(column))).withColumn("__grams", grams(F.col("__text"), _set(keys.select("gram").distinct())))
    met = met.filter(F.size("__grams") > 0).withColumn("__gram", F.explode("__grams")).drop("__grams").join(named, "__gram")
    return met.filter(F.contains("__text", F.col("matched"))).drop("__gram", "__text")
