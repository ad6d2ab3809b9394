"""Secret scans over an incremental blob ledger (operator 9, native).

Every version of every path is addressed by the hash of its content. A ledger holds one row for each
(blob, rule version) pair already scanned, with the spans found. New work is what the ledger lacks:
each unseen blob is scanned once however many paths and versions share it, and the findings are
joined back to all of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The kinds in order, with pattern, the group whose length counts, and that length.
#: The last two patterns state the least length themselves: their matches are whole runs either way.
RULES = (
    ("assign", r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    ("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
)
KINDS = tuple(r[0] for r in RULES)
VERSION = "1"
#: A span in code points, end exclusive; clear: the end of what earlier spans of the text cover.
SPAN = "struct<start: int, kind: int, end: int, clear: int>"
LEDGER = f"blob string, rule_version string, spans array<{SPAN}>"
MARK = "[REDACTED]"
#: Characters of a piece that a long text is cut into to be masked.
PIECE = 1024


def _lengths(text: Column, kind: int, pattern: str, group: int) -> Column:
    """kind, gap, match, counted of each match of one rule: the lengths of the text before it (since the
    match before), of the whole match and of what the rule counts."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    counted = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    zipped = F.arrays_zip(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(whole)).alias("gap"), whole.alias("match"), counted.alias("counted"))
    found = F.transform(zipped, lambda m: F.struct(F.lit(kind).alias("kind"), F.length(m["gap"]).alias("gap"), F.length(m["match"]).alias("match"), F.length(m["counted"]).alias("counted")))
    none = F.array().cast("array<struct<kind: int, gap: int, match: int, counted: int>>")
    return F.when(F.regexp_like(text, F.lit(pattern)), found).otherwise(none)


def spans(blobs: DataFrame) -> DataFrame:
    """blob, spans (by start, then kind) for rows (blob, text), one a blob; a null text has none. Other columns
    are left out; an empty table gives no rows.

    Only lengths leave the text. Places are running sums over a blob's matches by windows, so the work
    grows with the text and the number of matches, however many one text has.
    """
    matches = F.concat(*[_lengths(F.col("text"), k, pattern, group) for k, (_, pattern, group, _) in enumerate(RULES)])
    rows = blobs.select("blob", F.posexplode_outer(matches).alias("n", "m")).select("blob", "n", "m.*")
    upto = Window.partitionBy("blob", "kind").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("match")).over(upto).cast("int")).withColumn("start", F.col("end") - F.col("match"))
    least = F.element_at(F.array(*[F.lit(r[3]) for r in RULES]), F.col("kind") + 1)
    rows = rows.withColumn("kept", F.coalesce(F.col("counted") >= least, F.lit(False)))
    earlier = Window.partitionBy("blob").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("clear", F.coalesce(F.max(F.when(F.col("kept"), F.col("end"))).over(earlier), F.lit(0)))
    held = F.collect_list(F.when(F.col("kept"), F.struct("start", "kind", "end", "clear")))
    return rows.groupBy("blob").agg(F.array_sort(held).alias("spans"))


def blob(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def scan_unseen(versions: DataFrame, ledger: DataFrame | None, rule_version: str = VERSION) -> DataFrame:
    """New ledger rows (blob, rule_version, spans) for texts of ``versions`` that ``ledger`` lacks.

    Null texts count as empty; copies of a text are one blob (combined before the shuffle, so a hot
    text costs one row a task); other columns are ignored; an empty table gives no rows.
    """
    contents = versions.select(blob(F.col("text")).alias("blob"), F.coalesce("text", F.lit("")).alias("text"))
    unseen = contents.groupBy("blob").agg(F.first("text").alias("text"))
    if ledger is not None:
        unseen = unseen.join(ledger.filter(F.col("rule_version") == rule_version).select("blob"), "blob", "left_anti")
    return spans(unseen).select("blob", F.lit(rule_version).alias("rule_version"), F.col("spans").cast(f"array<{SPAN}>").alias("spans"))


def append_unseen(versions: DataFrame, folder: str, rule_version: str = VERSION) -> DataFrame:
    """Scan what the ledger in ``folder`` lacks of ``versions``, append it there and return the ledger.

    A folder that isn't there yet is an empty ledger; any other failure to read it is raised. A delivery that is
    repeated adds nothing. Null texts count as empty; an empty delivery adds nothing.
    """
    spark = versions.sparkSession
    try:
        ledger = spark.read.schema(LEDGER).parquet(folder)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        ledger = None  # the first delivery
    scan_unseen(versions, ledger, rule_version).write.mode("append").parquet(folder)
    return spark.read.schema(LEDGER).parquet(folder)


def findings(versions: DataFrame, ledger: DataFrame, rule_version: str = VERSION) -> DataFrame:
    """The rows of ``versions`` with ``secret_spans`` from the ledger; every path of a blob gets them.

    Only blobs with spans are joined, once each, so a hot blob is one row on that side. A blob that
    isn't in the ledger or has nothing gives an empty array. Columns that clash with ``secret_spans``
    are replaced.
    """
    held = ledger.filter((F.col("rule_version") == rule_version) & (F.size("spans") > 0)).select(F.col("blob").alias("secret_blob"), F.col("spans").alias("secret_spans"))
    rows = versions.drop("secret_spans", "secret_blob").withColumn("secret_blob", blob(F.col("text")))
    return rows.join(held, "secret_blob", "left").withColumn("secret_spans", F.coalesce("secret_spans", F.array().cast(f"array<{SPAN}>"))).drop("secret_blob")


def listed(found: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def counted(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda s: s["kind"] == KINDS.index(kind))).cast("long")


def redacted(text: Column, found: Column) -> Column:
    """The text with each run of overlapping spans replaced by a mark; nulls stay null, and a text
    without spans stays as it is.

    ``found`` are spans of the ledger. The text is cut into pieces once, so that what lies between
    two spans is read off near by and not searched from the text's beginning.
    """

    def let(value: Column, body: Callable[[Column], Column]) -> Column:
        return F.get(F.transform(F.array(value), body), 0)  # the value is computed once

    def masked(pieces: Column) -> Column:
        def cut(a: Column, b: Column) -> Column:
            """The characters from place a up to b."""
            i, j = (F.floor(x / PIECE).cast("int") for x in (a, b))
            first, last = F.get(pieces, i), F.coalesce(F.get(pieces, j), F.lit(""))
            within = F.substring(first, a - i * PIECE + 1, b - a)
            across = F.concat(F.substring(first, a - i * PIECE + 1, F.lit(PIECE)), F.array_join(F.slice(pieces, i + 2, j - i - 1), ""), F.substring(last, F.lit(1), b - j * PIECE))
            return F.when(a >= b, "").when(i == j, within).otherwise(across)

        apart = F.filter(found, lambda s: s["start"] >= s["clear"])
        gaps = F.transform(apart, lambda s: cut(s["clear"], s["start"]))
        end = F.array_max(F.transform(found, lambda s: s["end"]))
        return F.array_join(F.concat(gaps, F.array(let(end, lambda e: cut(e, F.length(text))))), MARK)

    return F.when(F.size(found) > 0, let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)), masked)).otherwise(text)
