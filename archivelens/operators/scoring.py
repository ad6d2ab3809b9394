"""Scores of documents and projects. Word lists and weights are parameters (own defaults)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from archivelens.functions import names, paths
from archivelens.functions.text import clamp, created_recency, recency

#: Points of an extension as a deliverable (own choice).
EXTENSION_POINTS = {".docx": 30, ".pptx": 35, ".xlsx": 28, ".pdf": 32, ".hwp": 30, ".md": 12, ".txt": 8, ".csv": 10}


@dataclass(frozen=True)
class Words:
    """Lists that the scores look for in names, folders and texts."""

    high: tuple[str, ...] = ("final", "report", "contract")
    medium: tuple[str, ...] = ("plan", "meeting", "review")
    exclude: tuple[str, ...] = ("sample", "test", "dummy")
    folder_bad: tuple[str, ...] = ("backup", "old", "temp")
    folder_good: tuple[str, ...] = ("project", "report")
    content: tuple[str, ...] = ("schedule", "budget", "deadline", "risk", "owner")
    bonus: tuple[str, ...] = ("final", "report", "proposal", "result")
    weak: tuple[str, ...] = ("draft", "memo", "note")
    strong: tuple[str, ...] = ("sample", "template", "test")
    core: tuple[str, ...] = ("report", "plan", "contract", "design")
    final: tuple[str, ...] = ("final", "approved", "signed")
    negative: tuple[str, ...] = ("draft", "copy", "old", "temp")


def has(target: Column, words: tuple[str, ...]) -> Column:
    """Whether any of the words occurs."""
    out = F.lit(False)
    for word in words:
        out = out | F.contains(target, F.lit(word))
    return out


def count_words(target: Column, words: tuple[str, ...]) -> Column:
    return sum((F.contains(target, F.lit(w)).cast("int") for w in words), F.lit(0))


def relevance(docs: DataFrame, as_of: Column, words: Words = Words()) -> DataFrame:  # noqa: B008
    """Relevance, final_score and label of docs (path, text, modified_at, created_at).

    Base 45; the first of exclude (less 45, 3 at least), high (plus 45, 90 at most) and medium (plus 15,
    65 at most) in the name; folders less 15 or plus 25; content plus 2 a hit, 10 at most.
    """
    name, folder = F.lower(paths.name(F.col("path"))), F.lower(paths.parent(F.col("path")))
    base = F.when(has(name, words.exclude), F.greatest(F.lit(3), F.lit(45 - 45))).when(has(name, words.high), F.least(F.lit(90), F.lit(45 + 45))).when(has(name, words.medium), F.least(F.lit(65), F.lit(45 + 15))).otherwise(45)
    place = F.when(has(folder, words.folder_bad), -15).when(has(folder, words.folder_good), 25).otherwise(0)
    content = F.least(F.lit(10), count_words(F.lower("text"), words.content) * 2)
    rows = docs.withColumn("relevance", clamp(base + place + content).cast("int"))
    total = (F.col("relevance") * 0.7).cast("int") + recency(as_of, F.col("modified_at")) + created_recency(as_of, F.col("created_at"))
    rows = rows.withColumn("final_score", clamp(total).cast("int"))
    return rows.withColumn("label", F.when(F.col("final_score") >= 80, "important").when(F.col("final_score") >= 50, "normal").otherwise("low"))


def deliverable(docs: DataFrame, words: Words = Words()) -> DataFrame:  # noqa: B008
    """Deliverable points: extension, plus 20 for a good word, less 30 for a strong or 15 for a weak
    bad one; noise scores -9999."""
    name, ext = F.lower(paths.name(F.col("path"))), paths.suffix(F.col("path"))
    points = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in EXTENSION_POINTS.items() for x in pair]), ext), F.lit(0))
    score = points + F.when(has(name, words.bonus), 20).otherwise(0) - F.when(has(name, words.strong), 30).when(has(name, words.weak), 15).otherwise(0)
    return docs.withColumn("deliverable", F.when(ext.isin(".tmp", ".log", ".lock", ".bak"), -9999).otherwise(score).cast("int"))


def filename_signal(name: Column, words: Words = Words()) -> Column:  # noqa: B008
    """Core +8, final +12, version 4 and its major number and 1 for a minor one (10 at most), negative -18;
    within 25 either way."""
    score = F.when(has(F.lower(name), words.core), 8).otherwise(0) + F.when(has(F.lower(name), words.final), 12).otherwise(0) + names.version_points(paths.stem(name), 4) - F.when(has(F.lower(name), words.negative), 18).otherwise(0)
    return clamp(score, -25, 25).cast("int")


def document_value(docs: DataFrame, as_of: Column, words: Words = Words()) -> DataFrame:  # noqa: B008
    """Value 0 to 100 and its reasons, out of relevance and deliverable points (rounded half to
    even), recency, final and version marks, place and noise."""
    rows = deliverable(relevance(docs, as_of, words), words)
    name, folder = F.lower(paths.name(F.col("path"))), F.lower(paths.parent(F.col("path")))
    days = F.datediff(as_of, F.col("modified_at"))
    fresh = F.when(days <= 30, 15).when(days <= 90, 10).otherwise(0)
    marks = F.greatest(F.when(has(name, words.final), 8).otherwise(0), names.version_points(paths.stem(F.col("path")), 5))
    place = clamp(F.when(has(folder, words.folder_good), 5).otherwise(0) - F.when(has(folder, words.folder_bad), 5).otherwise(0), -10, 10)
    noise = F.when(F.col("deliverable") <= -9999, 30).when(has(name, words.strong), 15).otherwise(0)
    normal = clamp(F.col("deliverable") * 2)
    value = F.bround(F.col("relevance") * 0.45) + F.bround(normal * 0.2) + fresh + marks + place - noise
    reasons = F.array_compact(F.array(F.when(F.col("relevance") >= 80, F.lit("relevant")), F.when(fresh > 0, F.lit("recent")), F.when(marks > 0, F.lit("version")), F.when(noise > 0, F.lit("noise"))))
    return rows.withColumn("value", clamp(value).cast("int")).withColumn("reasons", F.array_join(reasons, ","))


def representatives(families: DataFrame, keys: list[str], words: Words = Words(), top: int = 3, support: int = 5) -> DataFrame:  # noqa: B008
    """role of each document (value, family, rank in its family, path, modified_at) in its group.

    Candidates are the latest of each family and its first older member that has a version or final mark and no
    negative word. Without a negative word, the first ``top`` candidates with an adjusted value of 80 are
    representative, the next ``support`` with 50 support; all others are reference. They come in order of
    adjusted value, day of change, deliverable points (if there are such), signal (all descending) and path.
    """
    stem = paths.stem(F.coalesce("path", F.lit("")))
    rows = families.withColumn("signal", filename_signal(paths.name(F.col("path")), words)).withColumn("adjusted", clamp(F.col("value") + F.col("signal")).cast("int"))
    low = F.coalesce(has(F.lower(stem), words.negative), F.lit(False))
    marked = names.version(stem).isNotNull() | has(F.lower(stem), words.final)
    older = F.when((F.col("rank") > 1) & ~low & marked, F.col("rank"))
    second = rows.groupBy(*keys, "family").agg(F.min(older).alias("second"))
    same = F.lit(True)
    for k in (*keys, "family"):
        same = same & F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}"))
    rows = rows.alias("r").join(second.alias("s"), same).select("r.*", "s.second")
    candidate = (F.col("rank") == 1) | F.coalesce(F.col("rank") == F.col("second"), F.lit(False))
    grade = F.when(~candidate | low, 3).when(F.col("adjusted") >= 80, 1).when(F.col("adjusted") >= 50, 2).otherwise(3)
    rows = rows.withColumn("grade", grade)
    more = [F.desc("deliverable")] if "deliverable" in families.columns else []
    order = [F.desc("adjusted"), F.desc_nulls_last(F.to_date("modified_at")), *more, F.desc("signal"), F.col("path")]
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys, "grade").orderBy(*order)))
    first = rows.filter("grade = 1").groupBy(*keys).agg(F.count(F.lit(1)).alias("firsts"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"r.{k}").eqNullSafe(F.col(f"f.{k}"))
    rows = rows.alias("r").join(first.alias("f"), same, "left").select("r.*", F.coalesce("f.firsts", F.lit(0)).alias("firsts"))
    at = F.when(F.col("grade") == 1, F.col("place") - top).otherwise(F.col("place") + F.greatest(F.col("firsts") - top, F.lit(0)))
    role = F.when((F.col("grade") == 1) & (F.col("place") <= top), "representative").when((F.col("grade") <= 2) & (at <= support), "support").otherwise("reference")
    return rows.withColumn("role", role).drop("grade", "place", "second", "firsts")


def project_cap(docs: DataFrame, project: Column, most: int = 30) -> DataFrame:
    """the first documents of a project by (is_current, modified_at, score); reason for the rest."""
    order = Window.partitionBy("project").orderBy(F.desc("is_current"), F.desc_nulls_last("modified_at"), F.desc("score"), "path")
    return docs.withColumn("project", project).withColumn("rank", F.row_number().over(order)).withColumn("reason", F.when(F.col("rank") > most, "project_limit"))


def project_importance(docs: DataFrame, project: Column, as_of: Column) -> DataFrame:
    """Points for lateness, number of documents and deliverables, scale and activity, 100 at most."""
    deep = F.max(paths.depth(F.col("path")))
    grouped = docs.groupBy(project.alias("project")).agg(
        F.count(F.lit(1)).alias("docs"), F.max("modified_at").alias("latest"), F.count_if(F.col("deliverable") >= 30).alias("deliverables"),
        F.countDistinct(paths.suffix(F.col("path"))).alias("exts"), deep.alias("depth"), F.count_if(F.datediff(as_of, F.col("modified_at")) <= 30).alias("active"),
    )
    days = F.datediff(as_of, F.col("latest"))
    score = F.when(days <= 30, 30).when(days <= 90, 20).otherwise(0) + F.when(F.col("docs") >= 20, 20).when(F.col("docs") >= 10, 10).when(F.col("docs") >= 3, 5).otherwise(0)
    score = score + F.when(F.col("deliverables") >= 5, 15).when(F.col("deliverables") >= 3, 10).when(F.col("deliverables") >= 1, 5).otherwise(0)
    score = score + F.least(F.lit(15), F.col("exts") * 3 + F.greatest(F.lit(0), F.col("depth") - 3) * 2) + F.when(F.col("active") > 0, 20).otherwise(0)
    return grouped.withColumn("importance", F.least(F.lit(100), score).cast("int")).drop("latest")


def progress_split(docs: DataFrame, project: Column, as_of: Column) -> DataFrame:
    """projects by their latest change: in progress within 7 days, recently done within 30."""
    latest = docs.groupBy(project.alias("project")).agg(F.max("modified_at").alias("latest"))
    days = F.datediff(as_of, F.col("latest"))
    return latest.withColumn("days", days).withColumn("state", F.when(days <= 7, "in_progress").when(days <= 30, "recently_done").otherwise("idle")).drop("latest")


def priority_list(importance: DataFrame, progress: DataFrame) -> DataFrame:
    """projects with priority 1, 2 or 3 by state, most important first."""
    priority = F.when(F.col("state") == "in_progress", 1).when(F.col("state") == "recently_done", 2).otherwise(3)
    return importance.join(progress, "project").withColumn("priority", priority).orderBy(F.desc("importance"), "project")


def start_here(projects: DataFrame, most: int = 5) -> DataFrame:
    """where to begin: by (active, deliverables, docs), then name."""
    return projects.orderBy(F.desc("active"), F.desc("deliverables"), F.desc("docs"), "project").limit(most)


def top_documents(docs: DataFrame, most: int = 50) -> DataFrame:
    """F27."""
    return docs.orderBy(F.desc("value"), "path").limit(most)


def deliverable_names(docs: DataFrame, keys: list[str], most: int = 5) -> DataFrame:
    """distinct stems of a group's files, best deliverable first, noise left out."""
    best = docs.filter(F.col("deliverable") > -9999).groupBy(*keys, F.lower(paths.stem(F.col("path"))).alias("stem")).agg(F.max("deliverable").alias("deliverable"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("deliverable"), "stem"))).filter(F.col("rank") <= most)


def structure_signal(files: DataFrame, keys: list[str], as_of: Column) -> DataFrame:
    """+10 for two document types, +10 for three stems that share their first word, +5 for a change
    within 30 days. Both counts combine before the shuffle."""
    word = F.regexp_extract(F.lower(paths.stem(F.col("path"))), r"^([\p{L}\p{N}]+)", 1)
    prefixes = files.groupBy(*keys, word.alias("word")).agg(F.countDistinct(paths.stem(F.col("path"))).alias("stems")).groupBy(*keys).agg(F.max("stems").alias("stems"))
    rest = files.groupBy(*keys).agg(F.countDistinct(paths.suffix(F.col("path"))).alias("types"), F.max((F.datediff(as_of, F.col("modified_at")) <= 30).cast("int")).alias("recent"))
    points = F.when(F.col("types") >= 2, 10).otherwise(0) + F.when(F.col("stems") >= 3, 10).otherwise(0) + F.when(F.col("recent") == 1, 5).otherwise(0)
    return rest.join(prefixes, keys).withColumn("structure", points)


def evidence_importance(groups: DataFrame) -> DataFrame:
    """Up to 40 for documents, 35 for a deliverable, 15 for a date."""
    points = F.least(F.lit(40), F.col("docs") * 5) + F.when(F.col("deliverables") > 0, 35).otherwise(0) + F.when(F.col("dates") > 0, 15).otherwise(0)
    return groups.withColumn("importance", points.cast("int"))
