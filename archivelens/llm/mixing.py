"""Mixing sources to target weights along a time-varying curriculum (operator 6, native).

A source's target share of all words is filled by walking its documents in a random but fixed order,
again and again while demand lasts. Each source has a weight schedule over training time 0 to 1; the
schedule's integral is its cumulative demand, and inverting that demand at a document's place in the
walk gives the document's training position. Range-sorting by position yields the training order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from archivelens.functions import scratch

#: A word; weights and schedules go round the sources in order; no source is repeated more often.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, MOST = (5, 2, 1), 3
#: Knots (time, weight) joined by straight lines: rising, level, falling.
SCHEDULES = (((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)))
#: Rows that one task orders, on average, of a source.
RUN = 16_384


def inverse_sql(knots: Sequence[tuple[float, float]], share: str) -> str:
    """SQL for the time by which the schedule has demanded ``share`` (0 to 1) of its total.

    Between knots demand is a quadratic in time; its root is taken in the form without cancellation.
    """
    areas = [(b[1] + a[1]) / 2 * (b[0] - a[0]) for a, b in zip(knots, knots[1:], strict=False)]
    total, done, cases = sum(areas), 0.0, []
    for (t0, w0), (t1, w1), area in zip(knots, knots[1:], areas, strict=False):
        slope = (w1 - w0) / (t1 - t0)
        rest = f"({share} * CAST({total!r} AS DOUBLE) - CAST({done!r} AS DOUBLE))"
        root = f"CAST({t0!r} AS DOUBLE) + 2 * {rest} / (CAST({w0!r} AS DOUBLE) + sqrt(CAST({w0 * w0!r} AS DOUBLE) + CAST({2 * slope!r} AS DOUBLE) * {rest}))"
        done += area
        cases.append((f"{share} * CAST({total!r} AS DOUBLE) < CAST({done!r} AS DOUBLE)", root))
    return "CASE " + " ".join(f"WHEN {when} THEN {root}" for when, root in cases[:-1]) + f" ELSE {cases[-1][1]} END" if len(cases) > 1 else cases[0][1]


def position_sql(kind: str, share: str, schedules: Sequence = SCHEDULES) -> str:
    return "CASE " + " ".join(f"WHEN {kind} % {len(schedules)} = {i} THEN {inverse_sql(k, share)}" for i, k in enumerate(schedules)) + " END"


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source_key, source_size, kind, target out of source_key and source_size, one row a source.

    Targets share all words by weight; none exceeds ``most`` times its source, the excess goes to the
    others by weight. Sources in ascending order of the most that they can take for their weight: a
    source is full if it can take no more than the level at which all from it on would share the rest.
    """
    ordered = Window.orderBy("source_key")  # a row for each source, already summed
    cycle = F.array(*map(F.lit, weights))
    own = sizes.withColumn("kind", F.row_number().over(ordered) - 1).withColumn("weight", F.element_at(cycle, (F.col("kind") % len(weights) + 1).cast("int")))
    fill = Window.orderBy("reach", "kind")
    level = (F.sum("source_size").over(Window.partitionBy()) - F.sum("full").over(fill.rowsBetween(Window.unboundedPreceding, 0)) + F.col("full")) / F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing))
    own = own.withColumn("full", F.col("source_size") * most).withColumn("reach", F.col("full") / F.col("weight")).withColumn("level", level)
    shared = F.min(F.when(F.col("reach") >= F.col("level"), F.struct("reach", "kind", "level"))).over(Window.partitionBy())["level"]
    target = F.when(F.col("reach") < F.col("level"), F.col("full").cast("double")).otherwise(F.col("weight") * shared)
    return own.select("source_key", "source_size", "kind", target.alias("target"))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, schedules: Sequence = SCHEDULES, run: int = RUN) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, source, any others) with what the mix takes of each.

    Added, all with the prefix ``mix_``: size (words of the text), source_size, target, taken (words
    taken, repeats counted: whole passes and, in the last, as many words as the target leaves, so
    that a source's words sum to its rounded target), start (words of the source before it in a
    pass), demand (the rounded target), kind (number of the source in order) and position (training
    time of its first word, null if nothing is taken). Rows are range-sorted by position.

    Sources sort by code point, null last. A null text has size 0 and nothing is taken of it; null or
    repeated doc_ids are ordinary rows; equal rows are interchangeable; an empty table stays empty.
    Columns of ``docs`` that start with mix_ are left out.
    The walk follows md5 of doc_id and text, so reruns agree, and rows without an id, or under one id,
    are spread like any others. A hot source is dealt over many tasks: its order is cut into ranges of
    md5, range totals are summed, and only within a range are rows ordered.
    """
    digits, rows = 1, docs.count()
    while 16**digits * run < rows and digits < 8:
        digits += 1
    docs = docs.drop(*[c for c in docs.columns if c.lower().startswith("mix_")])
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    own = docs.select(
        "*", F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("m"), "source")).alias("mix_source"), size.alias("mix_size"),
        F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), F.md5(F.coalesce("text", F.lit("")).cast("binary"))).cast("binary")).alias("mix_order"),
    ).withColumn("mix_range", F.substring("mix_order", 1, digits))
    ranges = scratch.stored(own.groupBy("mix_source", "mix_range").agg(F.sum("mix_size").alias("total")), "ranges")
    before = Window.partitionBy("mix_source").orderBy("mix_range")
    ranges = ranges.withColumn("mix_before", F.sum("total").over(before) - F.col("total")).withColumn("mix_source_size", F.sum("total").over(Window.partitionBy("mix_source")))
    sources = ranges.groupBy(F.col("mix_source").alias("source_key")).agg(F.max("mix_source_size").alias("source_size"))
    plan = targets(_nulls_last(sources), weights, most).select("source_key", F.col("kind").alias("mix_kind"), F.col("target").alias("mix_target"))
    ranges = ranges.join(plan, F.col("mix_source") == F.substring("source_key", 2, 1 << 30)).drop("total", "source_key")
    within = Window.partitionBy("mix_source", "mix_range").orderBy("mix_order", "doc_id", "mix_size").rowsBetween(Window.unboundedPreceding, 0)
    placed = own.join(ranges, ["mix_source", "mix_range"]).withColumn("mix_start", F.col("mix_before") + F.sum("mix_size").over(within) - F.col("mix_size"))
    placed = placed.withColumn("mix_demand", F.floor(F.col("mix_target") + 0.5).cast("long"))
    passes = F.when(F.col("mix_source_size") > 0, F.expr("mix_demand div mix_source_size")).otherwise(0)
    left = F.when(F.col("mix_source_size") > 0, F.expr("mix_demand % mix_source_size")).otherwise(0)
    taken = passes * F.col("mix_size") + F.greatest(F.lit(0), F.least(F.col("mix_size"), left - F.col("mix_start")))
    placed = placed.withColumn("mix_taken", taken.cast("long")).withColumn("mix_share", F.when(F.col("mix_taken") > 0, F.col("mix_start") / F.col("mix_demand")))
    placed = placed.withColumn("mix_position", F.expr(position_sql("mix_kind", "mix_share", schedules)))
    out = placed.select(*docs.columns, "mix_size", "mix_source_size", "mix_target", "mix_taken", "mix_start", "mix_demand", "mix_kind", "mix_position")
    order = [F.col("mix_position").asc_nulls_last(), F.col("doc_id")]
    return out.repartitionByRange(*order).sortWithinPartitions(*order)


def _nulls_last(sources: DataFrame) -> DataFrame:
    """A key whose order is that of the sources by code point with null last."""
    key = F.when(F.col("source_key") == "n", F.lit("1n")).otherwise(F.concat(F.lit("0"), "source_key"))
    return sources.withColumn("source_key", key)


def occurrences(mixed: DataFrame, columns: list[str], schedules: Sequence = SCHEDULES) -> DataFrame:
    """The mix itself out of ``mix``'s rows: each document as often as it is taken, by position.

    A document that the target cuts gives its first words, joined by spaces, in its last occurrence.
    Columns: ``columns`` (text among them) and mix_position; the rest of the rows isn't taken. Null and
    empty texts are never taken; null or repeated doc_ids are ordinary rows, equal rows each occur;
    columns that aren't asked for are left out; an empty table gives no rows.
    """
    start = F.col("mix_pass") * F.col("mix_source_size") + F.col("mix_start")
    words = F.greatest(F.lit(0), F.least(F.col("mix_size"), F.col("mix_demand") - start))
    rows = mixed.filter("mix_taken > 0").withColumn("mix_pass", F.explode(F.sequence(F.lit(0), F.expr("cast((mix_taken - 1) div mix_size as int)"))))
    rows = rows.withColumn("mix_words", words).withColumn("mix_share", start / F.col("mix_demand")).withColumn("mix_position", F.expr(position_sql("mix_kind", "mix_share", schedules)))
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1)), F.lit(1), F.col("mix_words").cast("int")), " ")
    text = F.when(F.col("mix_words") < F.col("mix_size"), cut).otherwise(F.col("text"))
    rows = rows.select(*[text.alias("text") if c == "text" else F.col(c) for c in columns], "mix_position")
    order = [F.col("mix_position"), F.col("doc_id")]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)
