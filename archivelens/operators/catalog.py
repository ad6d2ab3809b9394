"""Catalogue statistics over files (path, name, size_bytes, modified_at, is_hidden).

A folder covers a path that equals it or lies under it. That test is always an equality with one of
the path's exploded ancestors, never a prefix comparison of all pairs. Times are relative to an
explicit ``as_of``; every order ends in the path, which is unique.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from archivelens.functions import paths

DAYS = (7, 30, 90)
#: Name of a file without extension in counts by extension.
NO_EXTENSION = "[no extension]"
DOCUMENTS = (".docx", ".xlsx", ".pdf", ".pptx", ".hwp", ".txt", ".md", ".csv")
SYSTEM = ("thumbs.db", "desktop.ini", ".ds_store")


def since(days: int, as_of: Column, at: Column) -> Column:
    return at >= as_of - F.make_dt_interval(F.lit(days))


def modified_counts(as_of: Column) -> list[Column]:
    return [F.count_if(since(d, as_of, F.col("modified_at"))).alias(f"modified_{d}d") for d in DAYS]


def archive_totals(files: DataFrame, as_of: Column) -> DataFrame:
    """Files, folders, bytes and files changed within 7, 30, 90 days (inclusive, nested)."""
    folders = files.select(F.explode(paths.ancestors(F.col("path"))).alias("folder")).agg(F.countDistinct("folder").alias("folders"))
    totals = files.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"), *modified_counts(as_of))
    return totals.crossJoin(folders)  # one row each


def folder_tree(files: DataFrame) -> DataFrame:
    """A2: path, parent, depth of every folder that holds a file somewhere below."""
    folders = files.select(F.explode(paths.ancestors(F.col("path"))).alias("path")).distinct()
    return folders.select("path", paths.parent(F.col("path")).alias("parent"), paths.depth(F.col("path")).alias("depth"))


def union_roots(roots: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """A3: files of several roots, paths prefixed with the root's name; the second root of one name
    becomes "name (2)" and so on, in the order given."""
    seen: dict[str, int] = {}
    parts = []
    for name, files in roots:
        seen[name] = seen.get(name, 0) + 1
        space = name if seen[name] == 1 else f"{name} ({seen[name]})"
        parts.append(files.withColumn("path", F.concat(F.lit(f"{space}/"), "path")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def resolve_roots(files: DataFrame, roots: DataFrame) -> DataFrame:
    """A4: absolute_path out of roots (namespace, root); reason "missing_file" where there is none."""
    rest = F.regexp_extract(paths.norm(F.col("path")), r"^[^/]*/(.*)$", 1)
    joined = files.withColumn("namespace", F.substring_index(paths.norm(F.col("path")), "/", 1)).join(roots, "namespace", "left")
    return joined.withColumn("absolute_path", F.concat_ws("/", "root", rest)).withColumn("absolute_path", F.when(F.col("root").isNotNull(), F.col("absolute_path"))).withColumn("reason", F.when(F.col("root").isNull(), "missing_file")).drop("root")


def folder_summary(files: DataFrame, as_of: Column) -> DataFrame:
    """The totals of each top-level folder."""
    return files.filter(paths.top(F.col("path")) != "").groupBy(paths.top(F.col("path")).alias("folder")).agg(F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("bytes"), *modified_counts(as_of))


def extension_top(files: DataFrame, most: int = 10) -> DataFrame:
    """The commonest extensions of each top-level folder, ties in order of the extension."""
    ext = F.when(paths.suffix(F.col("path")) == "", NO_EXTENSION).otherwise(paths.suffix(F.col("path")))
    counts = files.groupBy(paths.top(F.col("path")).alias("folder"), ext.alias("extension")).agg(F.count(F.lit(1)).alias("files"))
    return _first(counts, ["folder"], [F.desc("files"), F.col("extension")], most)


def extension_groups(files: DataFrame, groups: DataFrame, as_of: Column) -> DataFrame:
    """Files of each extension group by age (up to 10, 11 to 30, over 30 days); ``groups``
    has extension, group; what it lacks is "other"; empty groups give zeros."""
    age = F.datediff(as_of, F.col("modified_at"))
    own = files.withColumn("extension", paths.suffix(F.col("path"))).join(groups, "extension", "left").withColumn("group", F.coalesce("group", F.lit("other")))
    counts = own.groupBy("group").agg(F.count(F.lit(1)).alias("files"), F.count_if(age <= 10).alias("to_10d"), F.count_if((age > 10) & (age <= 30)).alias("to_30d"), F.count_if(age > 30).alias("older"))
    names = groups.select("group").distinct().unionByName(groups.sparkSession.createDataFrame([("other",)], "group string")).distinct()
    return names.join(counts, "group", "left").na.fill(0)


def scope_files(files: DataFrame, scopes: DataFrame) -> DataFrame:
    """Files that a folder of ``scopes`` (folder) covers, each once."""
    held = files.select("path", F.explode(paths.scopes(F.col("path"))).alias("folder")).join(scopes.select("folder").distinct(), "folder", "left_semi").select("path").distinct()
    return files.join(held, "path", "left_semi")


def folder_activity(files: DataFrame, scopes: DataFrame, as_of: Column, days: int = 30, most: int = 10) -> DataFrame:
    """E5: the folders under ``scopes`` with the most files changed lately, ties by lower-cased path."""
    counts = scope_files(files, scopes).filter(since(days, as_of, F.col("modified_at"))).groupBy(paths.parent(F.col("path")).alias("folder")).agg(F.count(F.lit(1)).alias("files"))
    return counts.orderBy(F.desc("files"), F.lower("folder"), "folder").limit(most)


def shared_folders(links: DataFrame, least: int = 2) -> DataFrame:
    """Folders that at least two memos link, with the memos' titles in order."""
    grouped = links.groupBy(F.col("target").alias("folder")).agg(F.array_sort(F.collect_set("title")).alias("all"))
    return grouped.filter(F.size("all") >= least).select("folder", F.array_join("all", ", ").alias("titles"), F.size("all").cast("long").alias("memos"))


def folder_window_counts(files: DataFrame, folders: DataFrame, as_of: Column, days: int) -> DataFrame:
    """For each row of ``folders`` (folder), the files below it changed within ``days`` days."""
    recent = files.filter(since(days, as_of, F.col("modified_at"))).select(F.explode(paths.scopes(F.col("path"))).alias("folder")).groupBy("folder").agg(F.count(F.lit(1)).alias("files"))
    return folders.select("folder").distinct().join(recent, "folder", "left").na.fill(0, ["files"])


def linked_folder_stats(links: DataFrame, summary: DataFrame) -> DataFrame:
    """D3: each memo link with the totals of its top-level folder, zeros where there is none."""
    own = links.withColumn("folder", F.substring_index(paths.norm(F.col("target")), "/", 1))
    return own.join(summary, "folder", "left").na.fill(0, [c for c in summary.columns if c != "folder"])


def unlinked_folders(summary: DataFrame, links: DataFrame) -> DataFrame:
    """Rows of a folder summary that no memo links, not even below."""
    linked = links.select(F.substring_index(paths.norm(F.col("target")), "/", 1).alias("folder")).distinct()
    return summary.join(linked, "folder", "left_anti")


def unlinked_recent(files: DataFrame, links: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Folders with a file changed lately and no memo link at or below them."""
    recent = files.filter(since(days, as_of, F.col("modified_at"))).select(F.explode(paths.ancestors(F.col("path"))).alias("folder")).groupBy("folder").agg(F.count(F.lit(1)).alias("files"))
    covered = links.select(F.explode(paths.scopes(F.col("target"))).alias("folder")).distinct()
    return recent.join(covered, "folder", "left_anti")


def unlink_deleted(links: DataFrame, deleted: DataFrame) -> DataFrame:
    """Links that survive the deletion of ``deleted`` (path); a mail in an archive goes with it."""
    whole = F.substring_index(F.col("target"), "::", 1)
    gone = links.withColumn("up", F.explode(paths.scopes(whole))).join(deleted.select(F.col("path").alias("up")).distinct(), "up", "left_semi").select("memo_id", "kind", "target").distinct()
    return links.join(gone, ["memo_id", "kind", "target"], "left_anti")


def selected_files(links: DataFrame, files: DataFrame) -> DataFrame:
    """Explicit file links (memo_id, targets array) with their files, in order of the links."""
    return links.select("memo_id", F.posexplode("targets").alias("position", "path")).join(files, "path")


def link_coverage(folders: DataFrame, links: DataFrame) -> DataFrame:
    """State of each folder of a tree (path, parent, depth): all, some or none of the leaf
    folders at or below it are linked (directly or by a folder above)."""
    leaves = folders.join(folders.select(F.col("parent").alias("path")).distinct(), "path", "left_anti").select(F.col("path").alias("leaf"))
    ups = leaves.select("leaf", F.explode(paths.scopes(F.col("leaf"))).alias("path"))
    linked = ups.join(links.select(F.col("target").alias("path")).distinct(), "path", "left_semi").select("leaf").distinct().withColumn("linked", F.lit(1))
    counts = ups.join(linked, "leaf", "left").groupBy("path").agg(F.count(F.lit(1)).alias("leaves"), F.coalesce(F.sum("linked"), F.lit(0)).alias("linked"))
    return counts.withColumn("state", F.when(F.col("linked") == 0, "none").when(F.col("linked") == F.col("leaves"), "all").otherwise("some"))


def subtree_search(files: DataFrame, word: str) -> DataFrame:
    """Folders whose own name or any path below holds ``word``."""
    hits = files.filter(F.contains(F.lower("path"), F.lit(word.lower())))
    folders = folder_tree(files)
    own = folders.filter(F.contains(F.lower(paths.name(F.col("path"))), F.lit(word.lower()))).select("path")
    return folders.join(hits.select(F.explode(paths.ancestors(F.col("path"))).alias("path")).unionByName(own).distinct(), "path", "left_semi")


def recent_files(files: DataFrame, most: int = 10) -> DataFrame:
    """the latest files of each top-level folder."""
    rows = files.withColumn("folder", paths.top(F.col("path")))
    return _first(rows, ["folder"], [F.desc_nulls_last("modified_at"), F.col("path")], most, "rank")


def review_score() -> Column:
    """how much a file is worth a look."""
    name, ext = F.lower("name"), paths.suffix(F.col("path"))
    return (
        F.when(ext.isin(*DOCUMENTS), 40).otherwise(0) + F.when(F.col("size_bytes") >= 1024, 10).otherwise(0) - F.when(F.col("size_bytes") == 0, 50).otherwise(0)
        - F.when(name.startswith("~$"), 40).otherwise(0) - F.when(ext.isin(".tmp", ".log"), 20).otherwise(0) - F.when(name.startswith(".") | F.col("is_hidden"), 20).otherwise(0)
    )


def review_candidates(files: DataFrame, most: int = 5) -> DataFrame:
    rows = files.withColumn("folder", paths.top(F.col("path"))).withColumn("score", review_score().cast("long"))
    return _first(rows, ["folder"], [F.desc("score"), F.desc_nulls_last("modified_at"), F.col("path")], most, "rank")


def namespace_hints(files: DataFrame, most: int = 5) -> DataFrame:
    """non-empty visible files that aren't lock files, documents first, then the latest."""
    rows = files.filter((F.col("size_bytes") > 0) & ~F.col("is_hidden") & ~F.col("name").startswith("~$")).withColumn("folder", paths.top(F.col("path")))
    return _first(rows, ["folder"], [F.when(paths.suffix(F.col("path")).isin(*DOCUMENTS), 0).otherwise(1), F.desc_nulls_last("modified_at"), F.col("path")], most, "rank")


def _first(rows: DataFrame, keys: list[str], order: list, most: int, name: str = "rank") -> DataFrame:
    """The first rows of each group; Spark prunes them before the shuffle."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= most)


def memo_picks(selected: DataFrame, files: DataFrame, scopes: DataFrame, most: int = 5, newest: int = 30) -> DataFrame:
    """a memo's files: those it links itself (memo_id, path, position) first, filled up with files of
    its scopes (memo_id, folder): of the ``newest`` latest, the best to review. Distinct by path."""
    own = selected.join(files.select("path"), "path").select("memo_id", "path", F.lit(0).alias("source"), F.col("position").cast("long").alias("place"))
    covered = files.select("path", "name", "size_bytes", "modified_at", "is_hidden", F.explode(paths.scopes(F.col("path"))).alias("folder")).join(scopes.select("memo_id", "folder").distinct(), "folder").drop("folder").distinct()
    latest = _first(covered, ["memo_id"], [F.desc_nulls_last("modified_at"), F.col("path")], newest, "age")
    order = Window.partitionBy("memo_id").orderBy(F.desc(review_score()), F.desc_nulls_last("modified_at"), "path")
    auto = latest.withColumn("place", F.row_number().over(order).cast("long")).select("memo_id", "path", F.lit(1).alias("source"), "place")
    both = own.unionByName(auto).groupBy("memo_id", "path").agg(F.min(F.struct("source", "place")).alias("first"))
    return _first(both, ["memo_id"], [F.col("first.source"), F.col("first.place"), F.col("path")], most).select("memo_id", "path", F.col("first.source").alias("source"), "rank")


def linked_items(items: DataFrame, links: DataFrame, kind: str, key: str = "source_file") -> DataFrame:
    """Items (mails, chats) that a memo links by their source file."""
    return items.join(links.filter(F.col("kind") == kind).select(F.col("target").alias(key)).distinct(), key, "left_semi")


def project_groups(files: DataFrame, other: str = "other") -> DataFrame:
    """The files with project: the first part of the path, or ``other`` for a file in no folder. A null
    path has no project."""
    return files.withColumn("project", F.when(F.col("path").isNull(), None).when(paths.top(F.col("path")) == "", other).otherwise(paths.top(F.col("path"))))
