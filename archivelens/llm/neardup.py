"""Near-duplicate documents by MinHash with sequential Bayesian verification (operator 8).

1. Texts with one set of shingles form a class; from here on classes are compared, not copies.
2. Signatures are cut into bands; classes that agree in a band are candidates. In a bucket, pairs are
   compared a batch of hashes at a time, and a pair is dropped once the posterior probability that
   its similarity reaches the threshold is below ``MISS``. A bucket reports a spanning forest of the
   pairs that remain, never all of them.
3. Full sets of the classes in those forests are made once. The forests' own pairs are verified first,
   each class against its root; links found make parts. A large group of near copies falls together
   here, at a cost that grows with its size.
4. Components of what is left of the forests between parts are units: every other link lies inside one. In
   units, sets of different parts meet, and their remaining pairs are verified exactly; units above ``UNIT``
   classes meet in pairs of blocks, but for two blocks of one part.
5. Components of the verified links are the groups of near-duplicates.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archivelens.functions import scratch
from archivelens.llm import shingles, tokens
from archivelens.operators import graph

#: Hashes in a band, chance to lose a link (once by bands, once by pruning), batches of a signature.
ROWS, MISS, BATCHES = 5, 1e-6, 4
#: Classes of a bucket, and of a unit, that are compared in one task; above that, blocks meet in pairs.
BUCKET, UNIT = 16_384, 512
_RANDOM = np.random.default_rng(97)
_FLIP, _SPREAD = (_RANDOM.integers(0, 1 << 32, 512, np.uint64).astype(np.uint32) for _ in range(2))
_SPREAD |= np.uint32(1)


def bands_for(percent: int, miss: float = MISS) -> int:
    """Bands so that two sets just at the threshold share none with probability ``miss`` at most."""
    return math.ceil(math.log(miss) / math.log1p(-((percent / 100) ** ROWS)))


def signature(own: np.ndarray, size: int) -> np.ndarray:
    """``size`` min-hashes of a set of 64-bit hashes."""
    high = (own >> np.uint64(32)).astype(np.uint32)
    out = np.full(size, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(high), 256):
        np.minimum(out, ((high[k : k + 256] ^ _FLIP[:size, None]) * _SPREAD[:size, None]).min(1), out=out)
    return out


def prune_bounds(size: int, percent: int, miss: float = MISS) -> list[tuple[int, int]]:
    """(hashes seen, most agreements at which a pair is dropped) after each batch.

    With a uniform prior the similarity's posterior after m agreements of n is Beta(m+1, n-m+1); its
    mass above t equals the chance of at most m successes in n+1 trials at t.
    """
    t, out = percent / 100, []
    for n in [size * (k + 1) // BATCHES for k in range(BATCHES)]:
        total, m = 0.0, -1
        while m < n:
            total += math.comb(n + 1, m + 1) * t ** (m + 1) * (1 - t) ** (n - m)
            if total >= miss:
                break
            m += 1
        out.append((n, m))
    return out


def alike(one: np.ndarray, others: np.ndarray, bounds: list[tuple[int, int]], at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows ``at`` of ``others`` may reach the threshold with signature ``one``; agreements."""
    agreed, seen = np.zeros(len(at), np.int32), 0
    for n, most in bounds:
        agreed = agreed + (others[at, seen:n] == one[seen:n]).sum(1, dtype=np.int32)
        keep = agreed > most
        at, agreed, seen = at[keep], agreed[keep], n
        if not len(at):
            break
    return at, agreed


def _comparable(sizes: np.ndarray, one: int, percent: int) -> np.ndarray:
    return 100 * np.minimum(sizes, one) >= percent * np.maximum(sizes, one)


def forest(signatures: np.ndarray, sizes: np.ndarray, bounds: list[tuple[int, int]], percent: int) -> np.ndarray:
    """Component (least row) of each row under pairs that survive pruning."""
    label = np.arange(len(sizes))
    for i in range(1, len(sizes)):
        at, _ = alike(signatures[i], signatures, bounds, np.flatnonzero(_comparable(sizes[:i], sizes[i], percent)))
        if len(at):
            met = np.unique(label[at])
            if len(met) > 1:
                label[:i][np.isin(label[:i], met)] = met[0]
            label[i] = met[0]
    return label


def similar(one: np.ndarray, other: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have a Jaccard similarity of ``percent`` or more."""
    small, large = (one, other) if len(one) < len(other) else (other, one)
    place = np.searchsorted(large, small)
    place[place == len(large)] = 0
    both = int((large[place] == small).sum())
    return 100 * both >= percent * (len(small) + len(large) - both)


def linked(sets: list[np.ndarray], signatures: np.ndarray, bounds: list[tuple[int, int]], percent: int, parts: np.ndarray) -> np.ndarray:
    """Component (least row) of each row under exact links, where rows of one part (the least row of each
    is given) are linked before. A pair that is joined already is skipped."""
    sizes, label = np.array([len(s) for s in sets]), parts.copy()
    for i in range(1, len(sets)):
        at, agreed = alike(signatures[i], signatures, bounds, np.flatnonzero(_comparable(sizes[:i], sizes[i], percent)))
        for j in at[np.argsort(-agreed, kind="stable")].tolist():
            if label[j] == label[i]:
                continue
            if similar(sets[i], sets[j], percent):
                a, b = sorted((label[i], label[j]))
                label[label == b] = a
    return label


def describe(docs: DataFrame, percent: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, print (of the set; null if it is empty), bands, low (a byte of each hash)."""
    count = bands_for(percent)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tokens.slices(batch, "text"):
                flat, sizes = shingles.shingle_sets(part.column("text"))
                ends = np.cumsum(sizes)
                prints: list = []
                signatures = np.zeros((part.num_rows, count * ROWS), np.uint32)
                for i, (a, b) in enumerate(zip((ends - sizes).tolist(), ends.tolist(), strict=True)):
                    prints.append(shingles.fingerprint(flat[a:b]) if b > a else None)
                    if b > a:
                        signatures[i] = signature(flat[a:b], count * ROWS)
                keys = np.zeros((part.num_rows, count), np.uint64)
                for k in range(count):
                    key = np.full(part.num_rows, k + 1, np.uint64)
                    for r in range(ROWS):
                        key = shingles.mix(key ^ signatures[:, k * ROWS + r])
                    keys[:, k] = key
                offsets = pa.array(np.arange(part.num_rows + 1) * count, pa.int32())
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), part.column("text_hash"), pa.array(sizes), pa.array(prints, pa.binary()),
                    pa.ListArray.from_arrays(offsets, pa.array(keys.view(np.int64).ravel())),
                    tokens.binary_column(signatures.astype(np.uint8).ravel(), np.full(part.num_rows, count * ROWS)),
                ], ["doc_id", "text_hash", "n_shingles", "print", "bands", "low"])

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    return rows.mapInArrow(sketch, "doc_id long, text_hash long, n_shingles long, print binary, bands array<long>, low binary")


def _blocks(rows: DataFrame, name: Column, members: str, most: int) -> DataFrame:
    """Add ``p`` and ``q``: groups with more than ``most`` members are cut into blocks by a hash of
    ``name``, and each pair of blocks meets; a smaller group is one block."""
    n = F.when(F.col(members) > most, F.ceil(F.col(members) / (most // 2))).otherwise(1).cast("int")
    rows = rows.withColumn("block", F.pmod(F.xxhash64(F.lit(5), name), n).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), n - 1)))
    # a block of its own is compared in every pair, so it needs a pair with itself only if it is alone
    rows = rows.filter((F.col(members) <= most) | (F.col("other") != F.col("block")))
    return rows.withColumn("p", F.least("block", "other")).withColumn("q", F.greatest("block", "other")).drop("block", "other")


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str], rest: list[str]) -> Iterator[tuple[pa.Table, list[int]]]:
    """Sorted batches as tables of whole groups with the groups' bounds; a group may span batches."""
    held: list[pa.Table] = []

    def groups(table: pa.Table) -> list[int]:
        change = np.zeros(max(0, table.num_rows - 1), bool)
        for k in keys:
            column = table.column(k).combine_chunks()
            change |= np.array(pa.compute.not_equal(column[:-1], column[1:]).to_pylist(), bool) if table.num_rows > 1 else change
        return [0, *(np.flatnonzero(change) + 1).tolist(), table.num_rows]

    import pyarrow.compute  # noqa: F401  (makes pa.compute known)

    for batch in batches:
        table = pa.Table.from_batches([batch]).select(keys + rest)
        bounds = groups(table)
        if held:
            last = held[-1].slice(held[-1].num_rows - 1)
            if all(last.column(k)[0].as_py() == table.column(k)[0].as_py() for k in keys):
                if len(bounds) == 2:
                    held.append(table)
                    continue
                held.append(table.slice(0, bounds[1]))
                table, bounds = table.slice(bounds[1]), [b - bounds[1] for b in bounds[1:]]
            whole = pa.concat_tables(held).combine_chunks()
            yield whole, [0, whole.num_rows]
            held = []
        if len(bounds) > 2:
            yield table.slice(0, bounds[-2]), bounds[:-1]
        held = [table.slice(bounds[-2])]
    if held:
        whole = pa.concat_tables(held).combine_chunks()
        yield whole, [0, whole.num_rows]


def _bytes_matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_buffer() for x in column), np.uint8).reshape(-1, width)


def _edges(names: list, label: np.ndarray, base: int, out: tuple[list, list], known: np.ndarray | None = None) -> None:
    """Note an edge from each row to the least of its component, unless it is known."""
    for i in np.flatnonzero(label != (np.arange(len(label)) if known is None else known)).tolist():
        out[0].append(names[base + i])
        out[1].append(names[base + int(label[i])])


def candidates(classes: DataFrame, percent: int) -> DataFrame:
    """a, b: spanning forests of the unpruned candidate pairs of each bucket."""
    width = bands_for(percent) * ROWS
    bounds = prune_bounds(width, percent)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cuts in _runs(batches, ["key", "p", "q"], ["print", "n_shingles", "low"]):
            low, sizes, names = _bytes_matrix(table.column("low"), width), table.column("n_shingles").to_numpy(), table.column("print").to_pylist()
            out: tuple[list, list] = ([], [])
            begins, lens = np.array(cuts[:-1]), np.diff(cuts)
            pairs = begins[lens == 2]  # most buckets: compared all at once
            agree = low[pairs] == low[pairs + 1]
            keep = _comparable(sizes[pairs], sizes[pairs + 1], percent)
            for n, most in bounds:
                keep &= agree[:, :n].sum(1) > most
            for i in pairs[keep].tolist():
                out[0].append(names[i + 1])
                out[1].append(names[i])
            for a, n in zip(begins[lens > 2].tolist(), lens[lens > 2].tolist(), strict=True):
                _edges(names, forest(low[a : a + n], sizes[a : a + n], bounds, percent), a, out)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary())], ["a", "b"])

    keys = classes.select("print", "n_shingles", F.explode("bands").alias("key"))
    shared = scratch.stored(keys.groupBy("key").agg(F.count(F.lit(1)).alias("members")).filter("members > 1"), "buckets")
    full = keys.join(shared, "key")
    full = _blocks(full, F.col("print"), "members", BUCKET).join(classes.select("print", "low"), "print")
    rows = full.select("key", "p", "q", "print", "n_shingles", "low").repartition("key", "p", "q").sortWithinPartitions("key", "p", "q")
    return rows.mapInArrow(compare, "a binary, b binary").distinct()


def full_sets(docs: DataFrame, classes: DataFrame, edges: DataFrame) -> DataFrame:
    """print, set (64-bit hashes) of the classes in ``edges``, once each."""

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tokens.slices(batch, "text"):
                flat, sizes = shingles.shingle_sets(part.column("text"))
                ends = np.cumsum(sizes)
                own = [shingles.fingerprint(flat[a:b]) if b > a else None for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
                # a doc_id may name other texts too
                same = pa.array([x == y for x, y in zip(own, part.column("print").to_pylist(), strict=True)])
                yield pa.RecordBatch.from_arrays([part.column("print"), tokens.binary_column(flat, sizes)], ["print", "set"]).filter(same)

    nodes = edges.select(F.explode(F.array("a", "b")).alias("print")).distinct()
    named = nodes.join(classes.select("print", F.col("first_id").alias("doc_id")), "print")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sets = texts.join(named, "doc_id").select("print", "text").mapInArrow(shingle, "print binary, set binary")
    return sets.groupBy("print").agg(F.first("set").alias("set"))  # repeated rows of one document


def _sets(table: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("set").combine_chunks()]


def verified_edges(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``edges`` (a, and b as its root) that are exact links. A root's sets come to tasks in chunks."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cuts in _runs(batches, ["root", "chunk"], ["leaf", "print", "set"]):
            names, held, out = table.column("print").to_pylist(), _sets(table), ([], [])
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                for i in range(a + 1, b):  # the root comes first
                    if similar(held[a], held[i], percent):
                        out[0].append(names[i])
                        out[1].append(names[a])
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary())], ["a", "b"])

    chunks = edges.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / UNIT).cast("int").alias("chunks"))
    leaves = edges.join(chunks, "b").select(F.col("b").alias("root"), F.pmod(F.xxhash64(F.lit(7), "a"), F.col("chunks")).cast("int").alias("chunk"), F.lit(1).alias("leaf"), F.col("a").alias("print"))
    roots = chunks.select(F.col("b").alias("root"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(0).alias("leaf"), F.col("b").alias("print"))
    rows = leaves.unionByName(roots).join(sets, "print").select("root", "chunk", "leaf", "print", "set")
    return rows.repartition("root", "chunk").sortWithinPartitions("root", "chunk", "leaf", "print").mapInArrow(check, "a binary, b binary")


def _meetings(members: DataFrame) -> DataFrame:
    """unit, p, q, part, print: which classes (unit, part, print) meet where, for units of several parts.

    A unit of up to ``UNIT`` classes meets as a whole. In a larger one, a large part has blocks of its own
    and small parts share blocks; all pairs of blocks meet but for two of one large part.
    """
    half = UNIT // 2
    sizes = scratch.stored(members.groupBy("unit", "part").agg(F.count(F.lit(1)).alias("n")), "parts")
    units = sizes.groupBy("unit").agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("parts"), F.coalesce(F.sum(F.when(F.col("n") < half, F.col("n"))), F.lit(0)).alias("small")).filter("parts > 1")
    large = (F.col("all") > UNIT) & (F.col("n") >= half)
    blocks = F.when(F.col("all") <= UNIT, 1).when(large, F.ceil(F.col("n") / half)).otherwise(F.ceil(F.col("small") / half)).cast("int")
    sizes = sizes.join(units, "unit").select("unit", "part", F.when(large, F.col("part")).otherwise(F.lit(b"")).alias("side"), blocks.alias("blocks"))
    sizes = scratch.stored(sizes, "blocks")
    sides = sizes.groupBy("unit", "side").agg(F.max("blocks").alias("blocks"))
    one, two = sides.toDF("unit", "s1", "n1"), sides.toDF("unit", "s2", "n2")
    pairs = one.join(two, "unit").filter((F.col("s1") < F.col("s2")) | ((F.col("s1") == F.col("s2")) & (F.col("s1") == F.lit(b""))))
    pairs = pairs.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n1") - 1)))
    pairs = pairs.withColumn("j", F.explode(F.sequence(F.when(F.col("s1") == F.col("s2"), F.col("i")).otherwise(0), F.col("n2") - 1)))
    pairs = pairs.withColumn("p", F.xxhash64("s1", "i")).withColumn("q", F.xxhash64("s2", "j"))
    met = pairs.select("unit", F.col("s1").alias("side"), F.col("i").alias("block"), "p", "q")
    met = met.unionByName(pairs.filter("p <> q").select("unit", F.col("s2").alias("side"), F.col("j").alias("block"), "p", "q"))
    spread = F.pmod(F.xxhash64(F.lit(5), F.when(F.col("side") == F.lit(b""), F.col("part")).otherwise(F.col("print"))), F.col("blocks")).cast("int")
    rows = members.join(sizes, ["unit", "part"]).withColumn("block", spread)
    return rows.join(met, ["unit", "side", "block"]).select("unit", "p", "q", "part", "print")


def verified(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b: exact links that join different parts of a unit, out of members (unit, part, print)."""
    width = bands_for(percent) * ROWS
    bounds = prune_bounds(width, percent)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cuts in _runs(batches, ["unit", "p", "q"], ["part", "print", "set"]):
            names, held, out = table.column("print").to_pylist(), _sets(table), ([], [])
            part = table.column("part").to_pylist()
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                least: dict[bytes, int] = {}
                parts = np.array([least.setdefault(x, i) for i, x in enumerate(part[a:b])])
                if len(least) > 1:
                    signatures = np.stack([signature(s, width) for s in held[a:b]])
                    _edges(names, linked(held[a:b], signatures, bounds, percent, parts), a, out, parts)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary())], ["a", "b"])

    rows = _meetings(members).join(sets, "print").select("unit", "p", "q", "part", "print", "set")
    return rows.repartition("unit", "p", "q").sortWithinPartitions("unit", "p", "q", "print").mapInArrow(check, "a binary, b binary").distinct()


def near_duplicates(docs: DataFrame, percent: int = 80, text_hash: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, kept (, text_hash: xxhash64) for each row of ``docs`` (doc_id, text).

    Two texts are linked if their sets of distinct 5-word shingles (A-Z lower-cased, words parted by
    ASCII white space, whole texts) have a Jaccard similarity of ``percent`` or more; component_id is
    the least doc_id reachable. A null or wordless text has an empty set and is linked with nothing.
    A row without a doc_id is linked with nothing either and is kept, its component_id null. Repeated
    rows get equal answers; texts under one doc_id are compared as different texts. Extra columns are
    ignored; an empty table gives no rows.
    """
    rows = scratch.stored(describe(docs, percent), "sketches")
    sound = rows.filter("print is not null and doc_id is not null")
    classes = sound.groupBy("print").agg(F.min("doc_id").alias("first_id"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("low").alias("low"))
    classes = scratch.stored(classes, "classes")
    edges = scratch.stored(candidates(classes, percent), "candidates")
    sets = scratch.stored(full_sets(docs, classes, edges), "sets")
    links = scratch.stored(verified_edges(edges, sets, percent), "links")
    parts = scratch.stored(graph.connected_components(links).toDF("print", "part"), "linked")
    of = lambda k: parts.select(F.col("print").alias(k), F.col("part").alias(f"part_{k}"))
    # what is left of the forests between parts; a class without links is a part of its own
    between = edges.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("part_a", "a").alias("a"), F.coalesce("part_b", "b").alias("b"))
    between = scratch.stored(between.filter("a <> b").distinct(), "between")
    groups = parts.withColumn("component", F.col("part"))
    if between.head(1):
        units = scratch.stored(graph.connected_components(between).toDF("part", "unit"), "units")
        grown = units.join(parts, "part", "left").select("unit", "part", F.coalesce("print", "part").alias("print"))
        members = scratch.stored(grown, "members")
        more = scratch.stored(verified(members, sets, percent), "links")
        held = lambda k: members.select(F.col("print").alias(k), F.col("part").alias(f"part_{k}"))
        joined = more.join(held("a"), "a").join(held("b"), "b").select(F.col("part_a").alias("a"), F.col("part_b").alias("b"))
        merged = graph.connected_components(joined).toDF("part", "whole")
        single = members.filter("part = print").join(parts.select("print"), "print", "left_anti").select("print", "part")
        groups = parts.unionByName(single).join(scratch.stored(merged, "merged"), "part", "left").select("print", "part", F.coalesce("whole", "part").alias("component"))
    first = classes.select("print", "first_id")
    linked_classes = scratch.stored(groups.join(first, "print").select("print", "first_id", "component"), "groups")
    least = scratch.stored(linked_classes.groupBy("component").agg(F.min("first_id").alias("component_id")), "least")
    ids = linked_classes.join(least, "component").select("print", "component_id")
    # a class without links is a group of its own
    named = scratch.stored(first.join(ids, "print", "left").select("print", F.coalesce("component_id", "first_id").alias("component_id")), "names")
    out = rows.select("doc_id", "n_shingles", "text_hash", F.when(F.col("doc_id").isNotNull(), F.col("print")).alias("print")).join(named, "print", "left")
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), *(["text_hash"] if text_hash else []))
