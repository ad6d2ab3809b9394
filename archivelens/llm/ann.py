"""Approximate nearest neighbours with vantage-point trees per shard (operator 7).

Each shard of vectors holds one tree. Inner product becomes distance by one more coordinate that
gives all vectors of the shard the same length, so the nearest are those of largest inner product.
A subtree is left out if the triangle inequality, relaxed by ``factor``, says that nothing in it can
enter the query's list; factor 1 is exact search, larger factors search less.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from archivelens.functions import scratch

#: Vectors of a shard and queries of a block on average, vectors of a leaf, neighbours, relaxation.
SHARD, BLOCK, LEAF, NEAREST, FACTOR = 8192, 512, 256, 20, 4.0
#: Blocks of queries that one task asks a shard's tree at most, on average.
LANE = 64
#: Pairs whose products are taken at once.
PAIRS = 1 << 16


class Tree:
    """A vantage-point tree over the distinct rows of ``values``, searched for a block of queries at a time.

    ``ids`` are the rows' ids in ascending order; copies of a vector stand in the tree once.
    """

    def __init__(self, values: np.ndarray, ids: np.ndarray, leaf: int = LEAF, seed: int = 3) -> None:
        values = np.ascontiguousarray(values)
        _, first, copy, self.counts = np.unique(values.view(f"V{values.itemsize * values.shape[1]}").ravel(), return_index=True, return_inverse=True, return_counts=True)
        self.members, self.starts = np.argsort(copy.ravel(), kind="stable"), np.cumsum(self.counts) - self.counts
        self.values, self.ids, self.leaf = values[first], ids, leaf
        lengths = (self.values**2).sum(1)
        self.lengths, self.longest = np.sqrt(lengths), lengths.max()
        self.points = np.column_stack([self.values, np.sqrt(np.maximum(self.longest - lengths, 0))])
        #: Bound of the relative error of a sum of products.
        self.error = 4 * (values.shape[1] + 4) * np.finfo(np.float64).eps
        #: The distinct vectors so that each subtree's are on end, and by inner node, in the order in which
        #: they are met from the root down, the vantage point and the radius that halves its subtree.
        self.order = np.arange(len(self.points))
        self.inner: list[tuple[int, float]] = []
        random = np.random.default_rng(seed)
        todo = [(0, len(self.order))]
        while todo:
            a, b = todo.pop()
            if b - a <= leaf:
                continue
            rows = self.order[a:b]
            chosen = int(random.choice(rows))
            far = np.sqrt(np.maximum(((self.points[rows] - self.points[chosen]) ** 2).sum(1), 0))
            nearer = np.argsort(far, kind="stable")
            self.order[a:b] = rows[nearer]
            self.inner.append((chosen, float(far[nearer[(b - a) // 2]])))
            half = a + (b - a) // 2
            todo += [(half, b), (a, half)]

    def dump(self) -> bytes:
        """The tree as bytes that ``load`` takes."""
        return pickle.dumps(self, protocol=5)

    @staticmethod
    def load(data: bytes) -> Tree:
        return pickle.loads(data)  # noqa: S301  (written by this job's own tasks)

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` rows of largest inner product with each query, ties by row, and their products (row
        -1: none). ``own`` is the query's id, which the id of a row must not equal.

        Products of matrices only say which rows can enter the list, with room for their rounding; the
        list is ordered by each pair's own product.
        """
        none = len(self.members)
        best, rows = np.full((len(queries), k), -np.inf), np.full((len(queries), k), none)
        sizes, raised = (queries**2).sum(1), np.column_stack([queries, np.zeros(len(queries))])
        norms = np.sqrt(sizes)
        # of so many copies or vectors, k at least have another id
        most = k + np.searchsorted(self.ids, own, "right") - np.searchsorted(self.ids, own, "left")

        def enter(held: np.ndarray, some: np.ndarray) -> None:
            near = queries[some] @ self.values[held].T
            slack = self.error * norms[some, None] * self.lengths[held]
            floor, enough = best[some, -1], int(most[some].max())
            if len(held) > enough and np.isinf(floor).any():
                floor = np.maximum(floor, np.partition(near - slack, len(held) - enough, 1)[:, len(held) - enough])
            at, place = np.nonzero(near + slack >= floor[:, None])
            if not len(at):
                return
            held_at = held[place]
            score = np.concatenate([np.einsum("ij,ij->i", queries[some[at[i : i + PAIRS]]], self.values[held_at[i : i + PAIRS]]) for i in range(0, len(at), PAIRS)])
            copies = np.minimum(self.counts[held_at], most[some[at]])
            nth = np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
            at, score, member = np.repeat(at, copies), np.repeat(score, copies), self.members[np.repeat(self.starts[held_at], copies) + nth]
            other = self.ids[member] != own[some[at]]
            at, score, member = at[other], score[other], member[other]
            met = np.unique(at)
            at = np.concatenate([np.repeat(met, k), at])
            score, member = np.concatenate([best[some[met]].ravel(), score]), np.concatenate([rows[some[met]].ravel(), member])
            order = np.lexsort((member, -score, at))
            at = at[order]
            order = order[np.arange(len(at)) - np.searchsorted(at, at) < k]
            best[some[met]], rows[some[met]] = score[order].reshape(-1, k), member[order].reshape(-1, k)

        # where the inner nodes of a subtree begin: after its root come all of the nearer half's
        def nodes(n: int) -> int:
            return 0 if n <= self.leaf else 1 + nodes(n // 2) + nodes(n - n // 2)

        def visit(place: tuple[int, int, int], some: np.ndarray) -> None:
            a, b, at = place
            if not len(some):
                return
            if b - a <= self.leaf:
                enter(self.order[a:b], some)
                return
            (chosen, radius), half = self.inner[at], a + (b - a) // 2
            point, inner, outer = self.points[chosen], (a, half, at + 1), (half, b, at + 1 + nodes(half - a))
            far = np.sqrt(np.maximum(((raised[some] - point) ** 2).sum(1), 0))
            gap, inside = far - radius, far < radius
            for first, second, mine in ((inner, outer, inside), (outer, inner, ~inside)):
                asked = some[mine]
                visit(first, asked)
                whole = sizes[asked] + self.longest
                limit = np.sqrt(np.maximum(whole - 2 * best[asked, -1], 0) + self.error * whole) + self.error * (far[mine] + radius)
                visit(second, asked[np.abs(gap[mine]) * factor <= limit])

        visit((0, len(self.order), 0), np.arange(len(queries)))
        return np.where(rows == none, -1, rows), best


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def sound(vector: Column) -> Column:
    """Neither null nor empty nor zero, and all components finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def nearest(vectors: DataFrame, queries: Column | None = None, k: int = NEAREST, factor: float = FACTOR, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` rows of ``vectors`` (vec_id, embedding) with the
    largest inner product with each query (rows where ``queries`` holds; every 20th id by default).

    Scores are inner products in double precision; ties go to the smaller vec_id. Rows without a
    vec_id, and vectors that are null, empty, zero or have a null or non-finite component, take no
    part; vectors of different sizes don't meet. A query doesn't find rows under its own id; repeated
    rows are separate candidates, and repeated queries are asked once (different vectors under one
    query id share its list). Extra columns are ignored; an empty table gives no rows.

    Every block of queries meets every shard once. A shard's tree is planted once and stored; blocks are
    dealt to lanes of ``LANE`` blocks on average, and a task asks one tree for one lane, a block at a
    time. So neither side is sent whole to a task, and there are tasks for every pair of shard and lane.
    """
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).filter("vec_id is not null").filter(sound(F.col("v")))
    own = own.withColumn("dim", F.size("v").cast("long"))
    asked = (F.col("vec_id") % 20 == 0) if queries is None else queries
    sizes = own.agg(F.count(F.lit(1)).alias("n"), F.count_if(asked).alias("asked")).head()
    shards, blocks = max(1, -(-sizes["n"] // shard)), max(1, -(-sizes["asked"] // block))
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    lanes = min(blocks, max(-(-blocks // LANE), -(-2 * cores // shards)))

    def gathered(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        table = table.sort_by("vec_id").combine_chunks()
        return table.column("vec_id").to_numpy(), _vectors(table.column("v").chunk(0))

    def plant(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        ids, values = gathered(table)
        return pa.table({"dim": [key[0].as_py()], "shard": [key[1].as_py()], "tree": pa.array([Tree(values, ids).dump()], pa.binary())})

    def gather(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        ids, values = gathered(table)
        return pa.table({"dim": [key[0].as_py()], "block": [key[1].as_py()], "query_ids": [ids.astype("<i8").tobytes()], "queries": [values.tobytes()]})

    def search(trees: pa.Table, asked: pa.Table) -> pa.Table:
        out = []
        if trees.num_rows:
            tree = Tree.load(trees.column("tree")[0].as_py())
            for q, v, dim in zip(asked.column("query_ids"), asked.column("queries"), asked.column("dim").to_pylist(), strict=True):
                own_ids, wanted = np.frombuffer(q.as_buffer(), "<i8"), np.frombuffer(v.as_buffer()).reshape(-1, dim)
                found, products = tree.search(wanted, own_ids, k, factor)
                at, place = np.nonzero(found >= 0)
                out.append(pa.table({"query_id": own_ids[at], "vec_id": tree.ids[found[at, place]], "score": products[at, place]}))
        return pa.concat_tables(out) if out else pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})

    every = lambda name, n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>")).alias(name)
    salted = F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards))
    planted = scratch.stored(own.withColumn("shard", salted).groupBy("dim", "shard").applyInArrow(plant, "dim long, shard long, tree binary"), "trees")
    first = own.filter(asked).withColumn("block", F.pmod(F.xxhash64(F.lit(11), "vec_id"), F.lit(blocks))).dropDuplicates(["vec_id", "v"])
    blocked = scratch.stored(first.groupBy("dim", "block").applyInArrow(gather, "dim long, block long, query_ids binary, queries binary"), "queries")
    key = ["dim", "shard", "lane"]
    parts = min(2 * shards * lanes, max(8 * cores, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    trees = planted.select("*", every("lane", lanes)).repartition(parts, *key).groupBy(*key)
    lined = blocked.withColumn("lane", F.col("block") % lanes).select("*", every("shard", shards)).repartition(parts, *key).groupBy(*key)
    hits = trees.cogroup(lined).applyInArrow(search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
