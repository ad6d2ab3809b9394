"""A quality classifier: generalised additive model with pairwise interactions (operator 10).

Shallow trees are boosted on one feature (later one pair of features) at a time, round after round,
each adding a little to that feature's lookup table. A text's score is the sum of the table entries
of its bins, so scoring is a few vectorised additions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from archivelens.llm import shingles, tokens

#: Labelled texts used to fit, at most; bins of a feature, and of each side of a pair.
SAMPLE, BINS, PAIR_BINS = 20_000, 64, 16
#: Rounds over all features and over all pairs, pairs kept, shrinkage, leaves of a feature's tree,
#: weight of the prior in a leaf.
ROUNDS, PAIR_ROUNDS, PAIRS, RATE, LEAVES, PRIOR = 150, 50, 8, 0.1, 3, 5.0
FEATURES = (
    "bytes", "words", "word_bytes", "upper", "digits", "exclaim", "symbols", "stops", "bars", "lines", "other",
    "repeated_words", "next_equal", "top_word", "repeated_lines", "longest_word",
)
_CLASS = np.zeros(256, np.uint8)
_CLASS[65:91] = 1
_CLASS[48:58] = 2
for _k, _set in ((3, b"!?"), (4, b"*#$%&@^~+=<>{}[]\\"), (5, b".,;:'\"()-"), (6, b"|"), (7, b"\n\r"), (8, b" \t")):
    _CLASS[list(_set)] = _k
_CLASS[128:] = 9
CLASSES = 10


def measure(texts: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` for each whole text; an empty or null one has zeros."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    out = np.zeros((n, len(FEATURES)))
    if not n or offsets[-1] == offsets[0]:
        return out
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    sizes = np.diff(offsets)
    owner = np.repeat(np.arange(n, dtype=np.int64) * CLASSES, sizes)
    tally = np.bincount(owner + _CLASS[data], minlength=n * CLASSES).reshape(n, CLASSES)
    hashes, counts = shingles.word_hashes(texts)
    ends = np.cumsum(counts)
    some, many = np.maximum(sizes, 1), np.maximum(counts, 1)
    visible = np.maximum(sizes - tally[:, 7] - tally[:, 8], 1)
    out[:, 0], out[:, 1], out[:, 2] = np.log1p(sizes), np.log1p(counts), visible / many
    for column, k in ((3, 1), (4, 2), (5, 3), (6, 4), (7, 5), (8, 6), (10, 9)):
        out[:, column] = tally[:, k] / visible
    out[:, 9] = tally[:, 7] / some
    equal = np.concatenate([[0], np.cumsum(hashes[1:] == hashes[:-1]), [0]]) if len(hashes) else np.zeros(2)
    for i, (a, b) in enumerate(zip((ends - counts).tolist(), ends.tolist(), strict=True)):
        text = data[offsets[i] - offsets[0] : offsets[i + 1] - offsets[0]].tobytes()
        if b > a:
            own = np.sort(hashes[a:b])
            runs = np.diff(np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1], [True]])))
            # repeats as expected of natural text grow with length, so compare with its root
            out[i, 11] = np.log1p(b - a) - np.log(len(runs))
            out[i, 12] = (equal[b - 1] - equal[a]) / max(1, b - a - 1)
            out[i, 13] = runs.max() / (b - a)
        if text:
            lines = text.split(b"\n")
            out[i, 14] = 1 - len(set(lines)) / len(lines)
            out[i, 15] = np.log1p(max(map(len, text.split())) if b > a else 0)
    out[sizes == 0] = 0
    return out


def edges_of(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.arange(1, bins) / bins))


@dataclass
class Model:
    """Lookup tables by feature and by pair of features, and the bins' edges."""

    start: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_edges: list[np.ndarray]
    pair_tables: list[np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Chance of label 1 for each row of features."""
        total = np.full(len(x), self.start)
        for j, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += table[np.searchsorted(edges, x[:, j], "right")]
        if self.pairs:
            coarse = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.pair_edges)]
            for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
                total += table[coarse[a], coarse[b]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _leaf(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g / (h + PRIOR)


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Leaf value of each bin after splitting the bins where the gain is largest, a leaf at a time."""
    sums_g, sums_h = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    cuts = [0, len(g)]
    for _ in range(LEAVES - 1):
        best = (1e-9, None)
        for a, b in zip(cuts, cuts[1:], strict=False):
            at = np.arange(a + 1, b)
            if not len(at):
                continue
            left_g, left_h = sums_g[at] - sums_g[a], sums_h[at] - sums_h[a]
            all_g, all_h = sums_g[b] - sums_g[a], sums_h[b] - sums_h[a]
            gain = left_g**2 / (left_h + PRIOR) + (all_g - left_g) ** 2 / (all_h - left_h + PRIOR) - all_g**2 / (all_h + PRIOR)
            k = int(gain.argmax())
            best = max(best, (float(gain[k]), int(at[k])), key=lambda x: x[0])
        if best[1] is None:
            break
        cuts = sorted([*cuts, best[1]])
    values = np.zeros(len(g))
    for a, b in zip(cuts, cuts[1:], strict=False):
        values[a:b] = _leaf(sums_g[b] - sums_g[a], sums_h[b] - sums_h[a])
    return values


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and leaf values of the best cut of a pair's table into four, a cut for each side."""
    total_g, total_h = (np.pad(x, ((1, 0), (1, 0))).cumsum(0).cumsum(1) for x in (g, h))
    a, b = total_g[1:-1, 1:-1], total_h[1:-1, 1:-1]
    if not a.size:
        return 0.0, np.zeros_like(g)
    row_g, row_h, col_g, col_h = total_g[1:-1, -1:], total_h[1:-1, -1:], total_g[-1:, 1:-1], total_h[-1:, 1:-1]
    quarters = ((a, b), (row_g - a, row_h - b), (col_g - a, col_h - b), (total_g[-1, -1] - row_g - col_g + a, total_h[-1, -1] - row_h - col_h + b))
    gain = sum(x**2 / (y + PRIOR) for x, y in quarters)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    values = np.zeros_like(g)
    for (x, y), rows, cols in zip(quarters, (slice(0, i + 1), slice(0, i + 1), slice(i + 1, None), slice(i + 1, None)), (slice(0, j + 1), slice(j + 1, None), slice(0, j + 1), slice(j + 1, None)), strict=True):
        values[rows, cols] = _leaf(x[i, j], y[i, j]) if x.shape == gain.shape else 0
    return float(gain[i, j] - total_g[-1, -1] ** 2 / (total_h[-1, -1] + PRIOR)), values


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Boost tables on rows of features and labels; without both labels every score is the share of 1."""
    share = float(np.clip(y.mean() if len(y) else 0.5, 0.001, 0.999))
    start = float(np.log(share / (1 - share)))
    if len(np.unique(y)) < 2:
        return Model(start, [np.zeros(0)] * x.shape[1], [np.zeros(1)] * x.shape[1], [], [], [])
    width = x.shape[1]
    edges = [edges_of(x[:, j], BINS) for j in range(width)]
    bins = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(edges)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    total = np.full(len(y), start)
    for _ in range(ROUNDS):
        for j in range(width):
            p = 1 / (1 + np.exp(-total))
            g, h = np.bincount(bins[j], y - p, len(tables[j])), np.bincount(bins[j], p * (1 - p), len(tables[j]))
            step = RATE * _tree(g, h)
            tables[j] += step
            total += step[bins[j]]
    pair_edges = [edges_of(x[:, j], PAIR_BINS) for j in range(width)]
    coarse = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(pair_edges)]

    def sums(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        shape = (len(pair_edges[a]) + 1, len(pair_edges[b]) + 1)
        cell = coarse[a] * shape[1] + coarse[b]
        return np.bincount(cell, y - p, shape[0] * shape[1]).reshape(shape), np.bincount(cell, p * (1 - p), shape[0] * shape[1]).reshape(shape)

    gains = sorted(((_quadrants(*sums(a, b))[0], a, b) for a in range(width) for b in range(a + 1, width)), key=lambda t: (-t[0], t[1], t[2]))
    pairs = [(a, b) for _, a, b in gains[:PAIRS]]
    pair_tables = [np.zeros((len(pair_edges[a]) + 1, len(pair_edges[b]) + 1)) for a, b in pairs]
    for _ in range(PAIR_ROUNDS):
        for k, (a, b) in enumerate(pairs):
            step = RATE * _quadrants(*sums(a, b))[1]
            pair_tables[k] += step
            total += step[coarse[a], coarse[b]]
    return Model(start, edges, tables, pairs, pair_edges, pair_tables)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3; 1 is held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on texts of ``docs`` with a label in ``labels`` (doc_id, quality) outside the held-out fold.

    At most ``sample`` labelled ids, those of least md5, are used; repeated labels of an id count as
    its lowest, null labels or ids not at all, and of the texts under one id the one with the least
    features. Only one row of features for each id of that bounded sample reaches the driver.
    """
    known = labels.filter("quality is not null and doc_id is not null").filter(fold(F.col("doc_id")) != 1)
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    chosen = known.orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id").limit(sample)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tokens.slices(batch, "text"):
                found = measure(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("quality"), tokens.binary_column(found.ravel(), np.full(len(found), found.shape[1]))], ["doc_id", "quality", "x"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    got = rows.select("doc_id", F.col("quality").cast("int").alias("quality"), "text").mapInArrow(look, "doc_id long, quality int, x binary")
    got = got.groupBy("doc_id", "quality").agg(F.min("x").alias("x")).toArrow().sort_by("doc_id")
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), np.float64).reshape(-1, len(FEATURES))
    return fit(x, got.column("quality").to_numpy().astype(np.float64))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` with ``quality_score`` (0 to 1) of each whole text; a null text is empty.

    All columns are kept, a clashing ``quality_score`` replaced; repeated rows score alike; an empty
    table stays empty.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # tables of a fixed size

    @F.pandas_udf("double")
    def own(text: pd.Series) -> pd.Series:
        array = pa.array(text, pa.large_string())
        parts = [measure(p.column("text")) for p in tokens.slices(pa.RecordBatch.from_arrays([array], ["text"]), "text")]
        return pd.Series(sent.value.score(np.concatenate(parts)) if parts else np.zeros(0))

    return docs.drop("quality_score").withColumn("quality_score", own(F.coalesce(F.col("text").cast("string"), F.lit(""))))
