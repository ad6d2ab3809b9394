"""Places of rows within groups, however large a group is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from archivelens.functions import scratch

#: Rows of a group that one task ranks; a larger group is cut into ranges first.
MOST = 100_000


def placed(rows: DataFrame, keys: list[str], order: list[Column], name: str = "rank", most: int = MOST) -> DataFrame:
    """``rows`` with ``name``: 1, 2, ... by ``order`` within each group of ``keys`` (nulls are a group).

    Groups of more than ``most`` rows are sorted as ranges over many tasks; a row's place is its place in its
    range after the rows of the ranges before. ``order`` should end in a unique key; rows that tie in all of it
    share a range and are placed in any order.
    """
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > most)
    hot = scratch.stored(sizes.select(*[F.col(k).alias(f"__{k}") for k in keys]), "hot")
    within = Window.partitionBy(*keys).orderBy(*order)
    if not hot.head(1):
        return rows.withColumn(name, F.row_number().over(within))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    cold = rows.join(hot, same, "left_anti").withColumn(name, F.row_number().over(within))
    ranged = rows.join(hot, same, "left_semi").repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("__range", F.spark_partition_id())
    ranged = scratch.stored(ranged, "ranges")
    counts = ranged.groupBy(*keys, "__range").agg(F.count(F.lit(1)).alias("__n"))
    upto = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, 0)  # a row for each range
    before = counts.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__range").alias("__part"), (F.sum("__n").over(upto) - F.col("__n")).alias("__before"))
    own = Window.partitionBy(*keys, "__range").orderBy(*order)
    met = ranged.withColumn("__at", F.row_number().over(own)).join(before, same & (F.col("__range") == F.col("__part")))
    return cold.unionByName(met.withColumn(name, (F.col("__at") + F.col("__before")).cast("int")).select(*cold.columns))
