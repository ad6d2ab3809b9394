"""Two-pass external shuffle of whole tables into shards (operator 11, native).

1. Scatter: every record goes to a bucket by a seeded hash of the record. Buckets are sized for memory,
   by bytes and by rows, so their number grows with the table.
2. Shuffle: a bucket's records, in the order of their hashes, are dealt to its places by a Fisher-Yates
   permutation (``shuffle``, seeded). Buckets follow each other, so this is a shuffle of the whole table.

Shards are equal cuts of that order: their row counts differ by one at most. The first pass only reads ids and
hashes and stores a plan (a bucket's first place and its permutation); the second moves each text once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from archivelens.functions import scratch

#: Bytes and rows of a bucket on average, shards, and the seed of a shuffle.
BYTES, ROWS, SHARDS, SEED = 16 << 20, 1024, 40, 20_240_611
#: What a record weighs beside its text.
OVERHEAD = 16
#: Buckets whose first places one task sums up; their groups are summed in a second step.
SPAN = 4096
OWN = ("shard", "slot", "size", "shard_law")


def size(text: Column) -> Column:
    """Bytes of a record: its UTF-8 text (null: none) and ``OVERHEAD``."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long")


def _bucket(seed: int, buckets: int, *key: str) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(buckets)).cast("long")


def _first_places(sizes: DataFrame) -> DataFrame:
    """bucket, rows, first: the rows before each bucket; sums of spans of buckets first, then within spans."""
    spanned = sizes.withColumn("span", F.floor(F.col("bucket") / SPAN))
    spans = spanned.groupBy("span").agg(F.sum("rows").alias("span_rows"))
    upto = Window.orderBy("span").rowsBetween(Window.unboundedPreceding, 0)  # a row for each SPAN buckets
    spans = spans.select("span", (F.sum("span_rows").over(upto) - F.col("span_rows")).alias("before"))
    within = Window.partitionBy("span").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    return spanned.join(spans, "span").select("bucket", "rows", (F.col("before") + F.sum("rows").over(within) - F.col("rows")).alias("first"))


def plan(keys: DataFrame, buckets: int, seed: int, most: int) -> DataFrame:
    """bucket, first, places: where each bucket begins and the Fisher-Yates permutation of its places.

    ``keys`` has id, hash and copies; keys of more than ``most`` copies count each copy in a bucket of its own.
    Which numbers a generator gives depends on the task and on the order in it, so both are fixed.
    """
    few = keys.filter(F.col("copies") <= most).withColumn("copy", F.lit(0).cast("long"))
    many = keys.filter(F.col("copies") > most).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).withColumn("copies", F.lit(1).cast("long"))
    rows = few.unionByName(many).withColumn("bucket", _bucket(seed, buckets, "id", "hash", "copy"))
    sizes = scratch.stored(rows.groupBy("bucket").agg(F.sum("copies").alias("rows")), "buckets")
    dealt = _first_places(sizes).repartition(math.ceil(buckets / 256), "bucket").sortWithinPartitions("bucket")
    return dealt.select("bucket", "first", "rows", F.shuffle(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1), seed).alias("places"))


def shuffled(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BYTES, bucket_rows: int = ROWS) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, any others) with size, shard (0 to ``shards`` - 1) and slot (from 0
    in each shard, without gaps), in order of shard and slot within each task.

    Row counts of shards differ by one at most (law ``rows``). Null and repeated doc_ids and null texts are
    ordinary rows. Rows that are equal in all columns are interchangeable; where they are many, each copy is
    dealt anew, so that they fill no bucket. Reruns agree, however the input is cut into files. Columns of
    ``docs`` that are named like those added are left out; an empty table stays empty.
    """
    rows = docs.drop(*[c for c in docs.columns if c.lower() in OWN])
    names = rows.columns
    whole = [F.map_entries(f"`{c}`") if kind.startswith("map<") else F.col(f"`{c}`") for c, kind in rows.dtypes]
    rows = rows.withColumn("__id", F.col("doc_id").cast("string")).withColumn("__hash", F.xxhash64(*whole))
    keys = rows.groupBy(F.col("__id").alias("id"), F.col("__hash").alias("hash")).agg(F.count(F.lit(1)).alias("copies"), F.sum(size(F.col("text"))).alias("bytes"))
    keys = scratch.stored(keys, "keys")
    total = keys.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("rows"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.max("copies").alias("most")).head()
    buckets = max(1, -(-total["rows"] // bucket_rows), -(-total["bytes"] // bucket_bytes))
    most = max(1, bucket_rows // 4)
    planned = scratch.stored(plan(keys.drop("bytes"), buckets, seed, most), "plan")
    rows = rows.withColumn("__copy", F.lit(0).cast("long"))
    if (total["most"] or 0) > most:  # copies of such keys are made from one row of each
        hot = scratch.stored(keys.filter(F.col("copies") > most).select(F.col("id").alias("__i"), F.col("hash").alias("__h"), "copies"), "hot")
        same = F.col("__id").eqNullSafe(F.col("__i")) & (F.col("__hash") == F.col("__h"))
        one = rows.join(hot, same).groupBy("__i", "__h").agg(F.max("copies").alias("__n"), *[F.first(F.col(f"`{c}`")).alias(c) for c in names])
        copies = one.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), "__n"))).select(*[F.col(f"`{c}`") for c in names], F.col("__i").alias("__id"), F.col("__h").alias("__hash"), "__copy")
        rows = rows.join(hot, same, "left_anti").unionByName(copies)
    rows = rows.withColumn("__bucket", _bucket(seed, buckets, "__id", "__hash", "__copy"))
    order = Window.partitionBy("__bucket").orderBy(F.xxhash64(F.lit(seed + 1), "__id", "__hash", "__copy"), "__id", "__hash", "__copy")
    ordered = rows.withColumn("__at", F.row_number().over(order))
    met = ordered.join(planned.select(F.col("bucket").alias("__bucket"), F.col("first").alias("__first"), F.col("places").alias("__places")), "__bucket")
    met = met.withColumn("__place", F.col("__first") + F.element_at("__places", F.col("__at")))
    shard = F.expr(f"__place * {shards} div {total['rows'] or 1}")
    # the first place p with p * shards div rows = shard
    begin = F.expr(f"(shard * {total['rows']} + {shards - 1}) div {shards}")
    placed = met.select(*[F.col(f"`{c}`") for c in names], size(F.col("text")).alias("size"), shard.alias("shard"), "__place")
    return placed.withColumn("slot", F.col("__place") - begin).withColumn("shard", F.col("shard").cast("int")).drop("__place").sortWithinPartitions("shard", "slot")


def write(docs: DataFrame, folder: str, **options: int) -> DataFrame:
    """Write the shuffled rows of ``docs`` as Parquet, a folder for each shard, and return the table read back;
    ``slot`` gives a shard's order (see ``shuffled``)."""
    rows = shuffled(docs, **options)
    rows.write.option("compression", "zstd").partitionBy("shard").parquet(folder)
    return docs.sparkSession.read.schema(rows.schema).parquet(folder)
