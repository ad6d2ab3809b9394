"""Ranked lexical search by norm buckets, after LEMP (operator 13).

A document's impact vector has, for each query term, the term's weight times its saturated frequency; a query's
vector has how often it asks for a term. Scores are their inner products, exact in integers.

1. One pass makes term frequencies of the queries' terms; document frequencies and totals follow from it.
2. Impact vectors are dealt by length, longest first, and cut into buckets. The longest of all are searched
   first, which gives each query a threshold: the score that its last place has to reach.
3. Where a query's length times a bucket's greatest length can't reach the threshold (Cauchy-Schwarz), that
   bucket and all after it are left out. Inside a bucket, a query's coordinates in order of what they can add at
   most tell which of them a document needs one of; what those give is exact, and the rest of the document's
   length bounds what the others can add. Only documents that can still reach the threshold are rescored.

Queries come in blocks of bounded size; each block searches all documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from archivelens.functions import scratch
from archivelens.llm import words

#: Documents returned for an item; documents of a bucket, and the longest vectors that set the first thresholds.
TOP, BUCKET, LEAD = 20, 4096, 4096
#: Bytes of the items of a block, and of text that a task handles at once.
BLOCK, TEXTS = 1 << 20, 8 << 20
#: Everything in ASCII but digits and letters parts terms.
KINDS = words.kinds(bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
#: What a bound is raised by, so that rounding never lets it fall below a score.
SLACK = 1 + 1e-9


def frequencies(docs: DataFrame, vocabulary: pa.Array) -> DataFrame:
    """doc_id, n (terms of the whole text), ids (places in ``vocabulary``), tfs, for documents with a term."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = max(1, len(vocabulary))
        for batch in batches:
            for part in words.bounded(batch, "text", TEXTS):
                own = words.split(part.column("text"), KINDS)
                at = pc.fill_null(pc.index_in(own.distinct, value_set=vocabulary), -1).to_numpy(zero_copy_only=False)[own.code]
                known = at >= 0
                key, tfs = np.unique(own.row[known] * size + at[known], return_counts=True)
                offsets = np.searchsorted(key // size, np.arange(part.num_rows + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.astype(np.int32))) for x in (key % size, tfs)]
                rows = pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(own.counts), *lists], ["doc_id", "n", "ids", "tfs"])
                yield rows.filter(pa.array(own.counts > 0))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(count, "doc_id long, n long, ids array<int>, tfs array<int>")


def weights(vectors: DataFrame, size: int) -> tuple[np.ndarray, int, int]:
    """Each term's weight, the number of documents with a term, and all their terms with repeats."""
    total = vectors.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).head()
    df = np.zeros(size, np.int64)
    for row in vectors.select(F.explode("ids").alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("df")).collect():  # a row for each term
        df[row["id"]] = row["df"]
    return np.floor(1000 * np.log((2 * total["docs"] + 2) / (2 * df + 1))).astype(np.int64), total["docs"], total["terms"]


def impacts(vectors: DataFrame, weight: np.ndarray, docs: int, terms: int) -> DataFrame:
    """doc_id, length, ids, impacts of the documents that score above 0 for any query."""

    def value(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tfs = (batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("ids", "tfs"))
            sizes = pc.list_value_length(batch.column("ids")).to_numpy(zero_copy_only=False).astype(np.int64)
            m = 75 + 25 * batch.column("n").to_numpy(zero_copy_only=False) * docs // terms
            own = weight[ids] * (1_000_000_000 * tfs // (1000 * tfs + 12 * np.repeat(m, sizes)))
            row = np.repeat(np.arange(len(sizes)), sizes)
            length = np.sqrt(np.bincount(row, own.astype(np.float64) ** 2, len(sizes)))
            kept = own > 0
            offsets = np.searchsorted(row[kept], np.arange(len(sizes) + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x[kept])) for x in (ids.astype(np.int32), own)]
            rows = pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(length), *lists], ["doc_id", "length", "ids", "impacts"])
            yield rows.filter(pa.array(length > 0))

    return vectors.mapInArrow(value, "doc_id long, length double, ids array<int>, impacts array<long>")


class Bucket:
    """Some impact vectors by row and by coordinate."""

    def __init__(self, batch: pa.RecordBatch, size: int) -> None:
        self.doc_ids, self.length = batch.column("doc_id"), batch.column("length").to_numpy(zero_copy_only=False)
        self.ids, self.impacts = (batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("ids", "impacts"))
        sizes = pc.list_value_length(batch.column("ids")).to_numpy(zero_copy_only=False)
        self.ends = np.cumsum(sizes)
        self.begins = self.ends - sizes
        self.n, self.longest = len(sizes), float(self.length.max(initial=0))
        order = np.argsort(self.ids, kind="stable")
        self.rows, self.values = np.repeat(np.arange(self.n), sizes)[order], self.impacts[order]
        self.starts = np.searchsorted(self.ids[order], np.arange(size + 1))
        self.most = np.zeros(size, np.int64)
        filled = np.flatnonzero(np.diff(self.starts))
        if len(filled):
            self.most[filled] = np.maximum.reduceat(self.values, self.starts[filled])

    def postings(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, impact and which of the terms it is of, for all rows with one of them."""
        lens = self.starts[terms + 1] - self.starts[terms]
        at = np.arange(lens.sum()) + np.repeat(self.starts[terms] - np.cumsum(lens) + lens, lens)
        return self.rows[at], self.values[at], np.repeat(np.arange(len(terms)), lens)

    def survivors(self, terms: np.ndarray, asked: np.ndarray, least: int) -> np.ndarray:
        """Rows that may score ``least`` (1 or more) for a query."""
        gives = asked * self.most[terms]
        order = np.argsort(-gives, kind="stable")
        terms, asked, gives = terms[order], asked[order], gives[order]
        left = gives.sum() - np.cumsum(gives)  # what the coordinates after each can add at most
        if gives.sum() < least:
            return np.zeros(0, np.int64)
        needed = int(np.argmax(left < least)) + 1  # without one of these no score reaches it
        rows, values, which = self.postings(terms[:needed])
        sure = np.bincount(rows, asked[which] * values, self.n)
        rest = self.length**2 - np.bincount(rows, values.astype(np.float64) ** 2, self.n)
        # rounding of squares: never below 0, and never too small
        rest = np.sqrt(np.maximum(rest, 0) + 1e-9 * self.length**2) * np.sqrt((asked[needed:] ** 2).sum())
        bound = sure + np.minimum(rest, left[needed - 1])
        return np.flatnonzero((sure > 0) & (bound * SLACK >= least))

    def scores(self, rows: np.ndarray, dense: np.ndarray) -> np.ndarray:
        """Exact scores of some rows (none of them empty) for a query as a whole vector of integers."""
        lens = self.ends[rows] - self.begins[rows]
        ends = np.cumsum(lens)
        at = np.arange(ends[-1]) + np.repeat(self.begins[rows] - ends + lens, lens)
        return np.add.reduceat(dense[self.ids[at]] * self.impacts[at], ends - lens)


def search(vectors: DataFrame, queries: list[tuple[np.ndarray, np.ndarray]], size: int, top: int = TOP, reach: np.ndarray | None = None, bucket: int = BUCKET) -> DataFrame:
    """query (its place), doc_id, score of the documents that each task finds best for each query, among those that
    score ``reach`` (1 where it isn't given). Vectors come longest first in each task."""
    lengths = np.array([np.sqrt((asked.astype(np.float64) ** 2).sum()) for _, asked in queries])
    floors = np.maximum(1, reach) if reach is not None else np.ones(len(queries), np.int64)

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[Bucket]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            while batch.num_rows:
                room = bucket - sum(b.num_rows for b in held)
                held.append(batch.slice(0, room))
                batch = batch.slice(room)
                if sum(b.num_rows for b in held) == bucket:
                    yield Bucket(pa.Table.from_batches(held).combine_chunks().to_batches()[0], size)
                    held = []
        if held:
            yield Bucket(pa.Table.from_batches(held).combine_chunks().to_batches()[0], size)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.zeros(0, np.int64), pa.array([], pa.int64())) for _ in queries]
        least, dense = floors.copy(), np.zeros(size, np.int64)
        for own in buckets(batches):
            for q in np.flatnonzero(lengths * own.longest * SLACK >= least).tolist():  # Cauchy-Schwarz
                terms, asked = queries[q]
                rows = own.survivors(terms, asked, int(least[q]))
                if not len(rows):
                    continue
                dense[terms] = asked
                scores = own.scores(rows, dense)
                dense[terms] = 0
                good = scores >= least[q]
                scores = np.concatenate([best[q][0], scores[good]])
                ids = pa.concat_arrays([best[q][1], own.doc_ids.take(pa.array(rows[good]))])
                number = pc.fill_null(ids, np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
                order = np.lexsort((number, -scores))[:top]
                best[q] = scores[order], ids.take(pa.array(order))
                if len(order) == top:
                    least[q] = max(least[q], scores[order[-1]])
        sizes = [len(s) for s, _ in best]
        if sum(sizes):
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(queries)), sizes)), pa.concat_arrays([i for _, i in best]), pa.array(np.concatenate([s for s, _ in best]))], ["query", "doc_id", "score"])

    return vectors.mapInArrow(find, "query long, doc_id long, score long")


def _block(docs: DataFrame, texts: list[str], top: int) -> DataFrame:
    """query (place in ``texts``), doc_id, score: candidates among which are the best of each."""
    own = words.split(pa.array(texts, pa.string()), KINDS)
    key, asked = np.unique(own.row * max(1, len(own.distinct)) + own.code, return_counts=True)
    row, term = key // max(1, len(own.distinct)), key % max(1, len(own.distinct))
    cuts = np.searchsorted(row, np.arange(len(texts) + 1))
    queries, size = [(term[a:b], asked[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)], len(own.distinct)
    vectors = scratch.stored(frequencies(docs, own.distinct), "frequencies")
    weight, n, terms = weights(vectors, size)
    found = impacts(vectors, weight, n, terms)
    order = [F.desc("length"), F.xxhash64("doc_id", "ids")]  # equal lengths are dealt over tasks
    lead = found.orderBy(*order).limit(LEAD)
    ranked = Window.partitionBy("query").orderBy(F.desc("score"))
    last = search(lead, queries, size, top).withColumn("place", F.row_number().over(ranked)).filter(F.col("place") == top)
    reach = np.ones(len(texts), np.int64)
    for r in last.collect():  # a row for each query
        reach[r["query"]] = r["score"]
    return search(found.repartitionByRange(*order).sortWithinPartitions(F.desc("length")), queries, size, top, reach)


def best_documents(docs: DataFrame, items: DataFrame, top: int = TOP, block: int = BLOCK) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the ``top`` documents (doc_id, text) that score highest above 0 for each
    item (item_id, text), ties by doc_id, null last.

    A null text has no terms. Repeated documents are ranked each; equal items are asked once, and texts under
    one item_id (or none) have a ranking each. Other columns are left out; empty tables give no rows.
    """
    spark, kind = docs.sparkSession, dict(items.dtypes)["item_id"]
    asked = items.select("item_id", F.col("text").cast("string").alias("text")).filter("text is not null").distinct()
    upto = Window.orderBy("item_id", "text").rowsBetween(Window.unboundedPreceding, 0)  # the stated set of queries
    asked = asked.withColumn("block", F.floor((F.sum(F.octet_length("text") + 1).over(upto) - 1) / block))
    asked = scratch.stored(asked, "items")
    out = None
    for n in [r["block"] for r in asked.select("block").distinct().orderBy("block").collect()]:
        own = asked.filter(F.col("block") == n).collect()
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(own)], f"query long, item_id {kind}")
        best = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        found = _block(docs, [r["text"] for r in own], top).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
        found = found.join(names, "query").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
