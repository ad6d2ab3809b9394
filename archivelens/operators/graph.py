"""Connected components of an edge table by local forests and alternating large and small stars.

Each task first replaces its own edges by the stars of their components, which shortens paths and drops what one
task can see. Then steps relate neighbours to the least node around: a large star moves a node's larger neighbours
to its least one, a small star its smaller ones and itself. The edge table never grows by more than a constant
factor, and the number of rounds grows with the logarithm of the longest path. Least neighbours are combined before
the shuffle and stored, so the join that follows is a plain one whose hot nodes (the centre of a large component)
Spark splits over tasks. The rounds end as soon as all edges are stars, which one aggregation tells.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archivelens.functions import scratch

#: Edges of a task that are reduced at once.
HELD = 1 << 20


def stars(a: pa.Array, b: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Edges from each node of the given ones to the least node of its component, but for that node."""
    nodes = pa.concat_arrays([a, b]).dictionary_encode()
    order = pc.sort_indices(nodes.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    one, two = np.split(rank[nodes.indices.to_numpy()], 2)
    label = np.arange(len(order))
    while True:
        low = np.minimum(label[one], label[two])
        before = label.copy()
        for side in (one, two):
            np.minimum.at(label, label[side], low)
            np.minimum.at(label, side, low)
        while (label != label[label]).any():
            label = label[label]
        if (label == before).all():
            break
    child = np.flatnonzero(label != np.arange(len(order)))
    values = nodes.dictionary.take(pa.array(order))
    return values.take(pa.array(child)), values.take(pa.array(label[child]))


def _local(edges: DataFrame) -> DataFrame:
    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= HELD:
                held = [_reduced(held)]
                if held[0].num_rows >= HELD // 2:
                    yield held.pop()
        if held:
            yield _reduced(held)

    return edges.select("a", "b").mapInArrow(reduce, edges.select("a", "b").schema)


def _reduced(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    table = pa.Table.from_batches(held).combine_chunks()
    a, b = (table.column(c).chunk(0) if table.num_rows else pa.array([], table.schema.field(c).type) for c in ("a", "b"))
    return pa.RecordBatch.from_arrays(list(stars(a, b)), ["a", "b"])


def _large_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The edges after the step, and the stored table of least neighbours that they read."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = scratch.stored(both.groupBy("a").agg(F.min("b").alias("least")).withColumn("least", F.least("a", "least")), "least")
    return both.filter("b > a").join(least, "a").filter("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct(), least


def _small_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = scratch.stored(down.groupBy("a").agg(F.min("b").alias("least")), "least")
    moved = down.join(least, "a").filter("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.unionByName(least.select("a", F.col("least").alias("b"))), least


def _settled(edges: DataFrame) -> bool:
    """Whether no node has two edges up, or one up and one down."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0), F.lit(1)).toDF("node", "up", "down"))
    return not ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))).head(1)


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) for all nodes of ``edges`` (a, b; any one comparable type).

    Edges may repeat, run either way or join a node to itself (such an edge adds nothing); edges with
    a null end are left out. No edges give no rows. Every round is stored in the shared folder, so
    lineage stays short, and removed when the next one is there; no row of it reaches the driver.
    """
    own = scratch.stored(_local(edges.select("a", "b").filter("a is not null and b is not null and a <> b")), "edges")
    while not _settled(own):
        large, least = _large_star(own)
        small, less = _small_star(large)
        done, own = own, scratch.stored(_local(small.filter("a <> b")), "edges")
        scratch.release(done, least, less)
    roots = own.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return own.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
