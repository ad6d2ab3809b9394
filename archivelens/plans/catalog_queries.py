"""Catalogue and de-duplication queries with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archivelens.functions import paths
from archivelens.operators import catalog, dedup, filters
from archivelens.sources import adapters as A
from archivelens.sources.adapters import AS_OF, FILES, MEMO_LINKS

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, queries: dict = QUERIES, found: dict[str, str] = SQL):  # noqa: ANN201
    """Register the function under its name, with SQL if there is any."""

    def add(f):  # noqa: ANN001, ANN202
        queries[f.__name__] = f
        if sql:
            found[f.__name__] = sql
        return f

    return add


NOW = f"TIMESTAMP '{AS_OF}'"
COUNTS = ", ".join(f"count(*) FILTER (modified_at >= {NOW} - to_days({d})) AS modified_{d}d" for d in (7, 30, 90))
ANCESTORS = "SELECT path, unnest([top, parent]) AS folder FROM files"


@query(f"""WITH {FILES} SELECT count(*) AS files, sum(size_bytes)::BIGINT AS bytes, {COUNTS},
  (SELECT count(DISTINCT folder) FROM ({ANCESTORS})) AS folders FROM files""")
def archive_totals(spark: SparkSession, d: str) -> DataFrame:
    return catalog.archive_totals(A.files(spark, d), A.as_of())


@query(f"WITH {FILES} SELECT DISTINCT folder AS path, CASE WHEN folder LIKE '%/%' THEN split_part(folder, '/', 1) ELSE '' END AS parent, CASE WHEN folder LIKE '%/%' THEN 2 ELSE 1 END::INT AS depth FROM ({ANCESTORS})")
def folder_tree(spark: SparkSession, d: str) -> DataFrame:
    return catalog.folder_tree(A.files(spark, d))


@query(f"WITH {FILES} SELECT top AS folder, count(*) AS files, sum(size_bytes)::BIGINT AS bytes, {COUNTS} FROM files GROUP BY top")
def folder_summary(spark: SparkSession, d: str) -> DataFrame:
    return catalog.folder_summary(A.files(spark, d), A.as_of())


@query(f"""WITH {FILES} SELECT * FROM (SELECT top AS folder, ext AS extension, count(*) AS files,
  row_number() OVER (PARTITION BY top ORDER BY count(*) DESC, ext)::INT AS rank FROM files GROUP BY top, ext) WHERE rank <= 10""")
def extension_top10(spark: SparkSession, d: str) -> DataFrame:
    return catalog.extension_top(A.files(spark, d))


GROUPS = ((".docx", "document"), (".pdf", "document"), (".txt", "text"), (".md", "text"), (".xlsx", "sheet"), (".csv", "sheet"), (".eml", "mail"), (".zip", "archive"))


@query(f"""WITH {FILES}, groups(extension, grp) AS (VALUES {", ".join(map(str, GROUPS))}),
own AS (SELECT coalesce(grp, 'other') AS grp, date_diff('day', modified_at::DATE, {NOW}::DATE) AS age FROM files LEFT JOIN groups ON ext = extension),
counts AS (SELECT grp, count(*) AS files, count(*) FILTER (age <= 10) AS to_10d, count(*) FILTER (age > 10 AND age <= 30) AS to_30d, count(*) FILTER (age > 30) AS older FROM own GROUP BY grp)
SELECT n.grp AS "group", coalesce(files, 0) AS files, coalesce(to_10d, 0) AS to_10d, coalesce(to_30d, 0) AS to_30d, coalesce(older, 0) AS older
FROM (SELECT DISTINCT grp FROM groups UNION SELECT 'other') n LEFT JOIN counts c ON n.grp = c.grp""")
def extension_age_matrix(spark: SparkSession, d: str) -> DataFrame:
    groups = spark.createDataFrame(list(GROUPS), "extension string, group string")
    return catalog.extension_groups(A.files(spark, d), groups, A.as_of())


@query(f"""WITH {FILES}, {MEMO_LINKS} SELECT folder, count(*) AS files FROM (
  SELECT DISTINCT path, parent AS folder FROM files, memo_links WHERE (target = top OR target = parent) AND modified_at >= {NOW} - to_days(30))
GROUP BY folder ORDER BY files DESC, lower(folder), folder LIMIT 10""")
def folder_activity(spark: SparkSession, d: str) -> DataFrame:
    scopes = A.memo_links(spark, d).select(F.col("target").alias("folder"))
    return catalog.folder_activity(A.files(spark, d), scopes, A.as_of())


@query(f"""WITH {MEMO_LINKS} SELECT target AS folder, string_agg(title, ', ' ORDER BY title) AS titles, count(*) AS memos
FROM (SELECT DISTINCT target, title FROM memo_links) GROUP BY target HAVING count(*) >= 2""")
def shared_folders(spark: SparkSession, d: str) -> DataFrame:
    return catalog.shared_folders(A.memo_links(spark, d))


@query(f"""WITH {FILES}, {MEMO_LINKS} SELECT t.target AS folder, count(f.path) AS files
FROM (SELECT DISTINCT target FROM memo_links) t LEFT JOIN files f ON (t.target = f.top OR t.target = f.parent) AND f.modified_at >= {NOW} - to_days(90) GROUP BY t.target""")
def folder_window_counts(spark: SparkSession, d: str) -> DataFrame:
    return catalog.folder_window_counts(A.files(spark, d), A.memo_links(spark, d).select(F.col("target").alias("folder")), A.as_of(), 90)


@query(f"""WITH {FILES}, {MEMO_LINKS}, summary AS (SELECT top AS folder, count(*) AS files, sum(size_bytes)::BIGINT AS bytes, {COUNTS} FROM files GROUP BY top)
SELECT split_part(target, '/', 1) AS folder, memo_id, title, kind, target, coalesce(files, 0) AS files, coalesce(bytes, 0) AS bytes,
  coalesce(modified_7d, 0) AS modified_7d, coalesce(modified_30d, 0) AS modified_30d, coalesce(modified_90d, 0) AS modified_90d
FROM memo_links LEFT JOIN summary s ON split_part(target, '/', 1) = s.folder""")
def linked_folder_stats(spark: SparkSession, d: str) -> DataFrame:
    return catalog.linked_folder_stats(A.memo_links(spark, d), catalog.folder_summary(A.files(spark, d), A.as_of()))


@query(f"""WITH {FILES}, {MEMO_LINKS} SELECT top AS folder, count(*) AS files, sum(size_bytes)::BIGINT AS bytes, {COUNTS} FROM files
WHERE top NOT IN (SELECT split_part(target, '/', 1) FROM memo_links) GROUP BY top""")
def unlinked_folders(spark: SparkSession, d: str) -> DataFrame:
    return catalog.unlinked_folders(catalog.folder_summary(A.files(spark, d), A.as_of()), A.memo_links(spark, d))


@query(f"""WITH {FILES}, {MEMO_LINKS} SELECT folder, count(*) AS files FROM (SELECT unnest([top, parent]) AS folder FROM files WHERE modified_at >= {NOW} - to_days(30))
WHERE NOT EXISTS (SELECT 1 FROM memo_links WHERE target = folder OR target LIKE folder || '/%') GROUP BY folder""")
def unlinked_recent(spark: SparkSession, d: str) -> DataFrame:
    return catalog.unlinked_recent(A.files(spark, d), A.memo_links(spark, d), A.as_of())


@query(f"WITH {MEMO_LINKS} SELECT memo_id, title, kind, target FROM memo_links WHERE NOT (target = 'src3' OR target LIKE 'src3/%' OR target = 'src6/de')")
def unlink_deleted(spark: SparkSession, d: str) -> DataFrame:
    deleted = spark.createDataFrame([("src3",), ("src6/de",)], "path string")
    return catalog.unlink_deleted(A.memo_links(spark, d), deleted).select("memo_id", "title", "kind", "target")


@query(f"""WITH {FILES}, {MEMO_LINKS}, leaves AS (SELECT DISTINCT top, parent AS leaf FROM files),
state AS (SELECT top, leaf, EXISTS (SELECT 1 FROM memo_links WHERE target IN (top, leaf)) AS linked FROM leaves),
up AS (SELECT unnest([top, leaf]) AS path, linked FROM state)
SELECT path, count(*) AS leaves, count(*) FILTER (linked) AS linked,
  CASE WHEN count(*) FILTER (linked) = 0 THEN 'none' WHEN count(*) FILTER (linked) = count(*) THEN 'all' ELSE 'some' END AS state FROM up GROUP BY path""")
def link_coverage(spark: SparkSession, d: str) -> DataFrame:
    return catalog.link_coverage(catalog.folder_tree(A.files(spark, d)), A.memo_links(spark, d))


@query(f"""WITH {FILES}, hits AS (SELECT top, parent FROM files WHERE contains(lower(path), '_v2.md'))
SELECT DISTINCT folder AS path, CASE WHEN folder LIKE '%/%' THEN split_part(folder, '/', 1) ELSE '' END AS parent, CASE WHEN folder LIKE '%/%' THEN 2 ELSE 1 END::INT AS depth
FROM (SELECT unnest([top, parent]) AS folder FROM hits)""")
def subtree_search(spark: SparkSession, d: str) -> DataFrame:
    return catalog.subtree_search(A.files(spark, d), "_v2.md")


@query(f"""WITH {FILES} SELECT doc_id, path, top AS folder, modified_at, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY top ORDER BY modified_at DESC, path)::INT AS rank FROM files) WHERE rank <= 10""")
def recent_top10(spark: SparkSession, d: str) -> DataFrame:
    return catalog.recent_files(A.files(spark, d)).select("doc_id", "path", "folder", F.col("modified_at").cast("timestamp_ntz").alias("modified_at"), "rank")


SCORE = """(CASE WHEN ext IN ('.docx', '.xlsx', '.pdf', '.txt', '.md', '.csv') THEN 40 ELSE 0 END + CASE WHEN size_bytes >= 1024 THEN 10 ELSE 0 END
  - CASE WHEN size_bytes = 0 THEN 50 ELSE 0 END - CASE WHEN ext = '.tmp' THEN 20 ELSE 0 END - CASE WHEN is_hidden THEN 20 ELSE 0 END)::BIGINT"""


@query(f"""WITH {FILES} SELECT path, folder, score, rank FROM (SELECT *, top AS folder, {SCORE} AS score,
  row_number() OVER (PARTITION BY top ORDER BY {SCORE} DESC, modified_at DESC, path)::INT AS rank FROM files) WHERE rank <= 5""")
def review_priority_top5(spark: SparkSession, d: str) -> DataFrame:
    return catalog.review_candidates(A.files(spark, d)).select("path", "folder", "score", "rank")


@query(f"""WITH {FILES} SELECT path, folder, rank FROM (SELECT *, top AS folder, row_number() OVER (PARTITION BY top
  ORDER BY CASE WHEN ext IN ('.docx', '.xlsx', '.pdf', '.txt', '.md', '.csv') THEN 0 ELSE 1 END, modified_at DESC, path)::INT AS rank
  FROM files WHERE size_bytes > 0 AND NOT is_hidden) WHERE rank <= 5""")
def namespace_hints(spark: SparkSession, d: str) -> DataFrame:
    return catalog.namespace_hints(A.files(spark, d)).select("path", "folder", "rank")


@query(f"WITH {FILES}, {MEMO_LINKS} SELECT doc_id, path FROM files WHERE top IN (SELECT target FROM memo_links) OR parent IN (SELECT target FROM memo_links)")
def scope_files(spark: SparkSession, d: str) -> DataFrame:
    return catalog.scope_files(A.files(spark, d), A.memo_links(spark, d).select(F.col("target").alias("folder"))).select("doc_id", "path")


@query(f"""WITH {FILES} SELECT doc_id, path, sha256(text) AS content_hash, rank = 1 AS kept, CASE WHEN rank > 1 THEN 'duplicate_content' END AS reason
FROM (SELECT *, row_number() OVER (PARTITION BY sha256(text) ORDER BY modified_at DESC, path) AS rank FROM files)""")
def content_dedup(spark: SparkSession, d: str) -> DataFrame:
    return dedup.exact(A.files(spark, d, text=True)).select("doc_id", "path", "content_hash", "kept", "reason")


@query(f"""WITH {FILES} SELECT path, version_key, rank, winner FROM (SELECT parent || '/g' || (doc_id // 5) || '/report_v' || (doc_id % 7) || ext AS path, 'report' AS version_key,
  row_number() OVER w::INT AS rank, first_value(parent || '/g' || (doc_id // 5) || '/report_v' || (doc_id % 7) || ext) OVER w AS winner
  FROM files WINDOW w AS (PARTITION BY parent || '/g' || (doc_id // 5) ORDER BY modified_at DESC, parent || '/g' || (doc_id // 5) || '/report_v' || (doc_id % 7) || ext))""")
def version_dedup(spark: SparkSession, d: str) -> DataFrame:
    files = A.files(spark, d)
    path = F.concat(paths.parent(F.col("path")), F.lit("/g"), F.expr("doc_id div 5"), F.lit("/report_v"), F.col("doc_id") % 7, paths.suffix(F.col("path")))
    return dedup.versions(files.withColumn("path", path)).select("path", "version_key", "rank", "winner")


@query("""WITH chunks AS (SELECT e.event_id, user_id % 3 AS package_index, TIMESTAMP '2024-02-01' + to_days((user_id % 3)::INT) AS package_created_at,
  CASE WHEN event_id % 11 = 0 THEN 'memo:' || (event_id % 5) WHEN event_id % 13 = 0 THEN NULL ELSE 'p/' || user_id END AS source_path, date_trunc('day', ts) AS modified_at FROM events e),
best AS (SELECT source_path, max(row(modified_at, package_created_at, package_index)) AS b FROM chunks WHERE source_path NOT LIKE 'memo:%' GROUP BY source_path)
SELECT event_id, source_path, package_index FROM chunks WHERE source_path IS NULL OR source_path LIKE 'memo:%'
UNION ALL SELECT c.event_id, c.source_path, c.package_index FROM chunks c JOIN best USING (source_path) WHERE row(c.modified_at, c.package_created_at, c.package_index) = b""")
def package_merge(spark: SparkSession, d: str) -> DataFrame:
    events = A.table(spark, d, "events")
    path = F.when(F.col("event_id") % 11 == 0, F.concat(F.lit("memo:"), F.col("event_id") % 5)).when(F.col("event_id") % 13 == 0, F.lit(None)).otherwise(F.concat(F.lit("p/"), F.col("user_id")))
    chunks = events.select("event_id", (F.col("user_id") % 3).alias("package_index"), (F.to_timestamp(F.lit("2024-02-01")) + F.make_dt_interval((F.col("user_id") % 3).cast("int"))).alias("package_created_at"), path.alias("source_path"), F.date_trunc("day", "ts").cast("timestamp").alias("modified_at"))
    return dedup.merge_packages(chunks).select("event_id", "source_path", "package_index")


@query(f"""WITH {FILES} SELECT path, CASE WHEN is_hidden OR name IN ('thumbs.db', 'desktop.ini', '.ds_store') THEN 'excluded_extension_or_system'
  WHEN ext IN ('.png', '.jpg', '.tmp') THEN 'unsupported_type' WHEN modified_at < {NOW} - to_days(30) AND created_at < {NOW} - to_days(30) THEN 'older_than_30_days' END AS reason FROM files""")
def exclusion_ledger(spark: SparkSession, d: str) -> DataFrame:
    return filters.exclusions(A.files(spark, d), A.as_of()).select("path", "reason")


@query(f"""WITH {FILES}, limits(ext, max_bytes) AS (VALUES ('.docx', NULL), ('.xlsx', 2000), ('.csv', 0), ('.md', 1500))
SELECT path, CASE WHEN files.ext IN ('.docx', '.xlsx', '.md', '.pdf') AND l.ext IS NOT NULL AND (max_bytes IS NULL OR (max_bytes > 0 AND size_bytes <= max_bytes)) THEN 'content' ELSE 'name_only' END AS route
FROM files LEFT JOIN limits l ON files.ext = l.ext""")
def route_by_size(spark: SparkSession, d: str) -> DataFrame:
    limits = spark.createDataFrame([(".docx", None, True), (".xlsx", 2000, False), (".csv", 0, False), (".md", 1500, False)], "extension string, max_bytes long, unlimited boolean")
    return filters.route(A.files(spark, d), [".docx", ".xlsx", ".md", ".pdf"], limits=limits).select("path", "route")


@query(f"""WITH {FILES}, noisy AS (SELECT *, CASE doc_id % 10 WHEN 0 THEN 'node_modules/' WHEN 1 THEN 'backup/' WHEN 2 THEN 'a/b/backup/' ELSE '' END || path AS long_path FROM files)
SELECT long_path AS path, CASE WHEN doc_id % 10 = 0 THEN 'folder:node_modules' WHEN ext = '.tmp' THEN 'extension:.tmp' WHEN doc_id % 10 IN (1, 2) THEN 'folder:backup' END AS reason FROM noisy""")
def noise_paths(spark: SparkSession, d: str) -> DataFrame:
    files = A.files(spark, d)
    start = F.when(F.col("doc_id") % 10 == 0, "node_modules/").when(F.col("doc_id") % 10 == 1, "backup/").when(F.col("doc_id") % 10 == 2, "a/b/backup/").otherwise("")
    return files.select(F.concat(start, "path").alias("path")).withColumn("reason", filters.noise_reason(F.col("path")))


@query(f"""WITH {FILES} SELECT coalesce(reason, 'kept') AS reason, count(*) AS files, round(100.0 * count(*) / sum(count(*)) OVER (), 4)::DOUBLE AS percent FROM (
  SELECT CASE WHEN is_hidden THEN 'excluded_extension_or_system' WHEN ext = '.tmp' THEN 'unsupported_type'
    WHEN modified_at < {NOW} - to_days(30) AND created_at < {NOW} - to_days(30) THEN 'older_than_30_days' END AS reason FROM files) GROUP BY reason""")
def funnel(spark: SparkSession, d: str) -> DataFrame:
    return filters.funnel(filters.exclusions(A.files(spark, d), A.as_of()))


JACCARD = """words AS (SELECT doc_id, list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), lambda w: length(w) >= 2))) AS words FROM documents),
classes AS (SELECT min(doc_id) AS id, words FROM words WHERE len(words) > 0 GROUP BY words),
tokens AS (SELECT id, len(words) AS n, unnest(words) AS w FROM classes),
pairs AS (SELECT a.id AS a, b.id AS b, a.n AS na, b.n AS nb, count(*) AS "both" FROM tokens a JOIN tokens b ON a.w = b.w AND a.id < b.id AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 80 GROUP BY ALL),
alike AS (SELECT a, b, "both", na + nb - "both" AS "union" FROM pairs WHERE "both" * 100 >= (na + nb - "both") * 80)"""


@query(f"WITH {JACCARD} SELECT * FROM alike")
def jaccard_pairs(spark: SparkSession, d: str) -> DataFrame:
    return dedup.jaccard_pairs(A.table(spark, d, "documents"))


# the walk goes over classes that are similar to any other, newest first, with the list of those kept
@query(f"""WITH RECURSIVE {FILES}, {JACCARD},
firsts AS (SELECT c.id AS least, arg_min(f.doc_id, row(-epoch_us(f.modified_at), f.doc_id)) AS id, min(row(-epoch_us(f.modified_at), f.doc_id)) AS place
  FROM classes c JOIN words w ON w.words = c.words JOIN files f ON f.doc_id = w.doc_id GROUP BY c.id),
ends AS (SELECT a AS x, b AS y FROM alike UNION ALL SELECT b, a FROM alike),
walked AS (SELECT least, id, row_number() OVER (ORDER BY place) AS k FROM firsts WHERE least IN (SELECT x FROM ends)),
earlier AS (SELECT l.k, list(e.k) AS before FROM ends JOIN walked l ON l.least = x JOIN walked e ON e.least = y AND e.k < l.k GROUP BY l.k),
walk AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS kept UNION ALL
  SELECT o.k, CASE WHEN list_has_any(kept, coalesce(before, []::BIGINT[])) THEN kept ELSE list_append(kept, o.k) END FROM walk JOIN walked o ON o.k = walk.k + 1 LEFT JOIN earlier ON earlier.k = o.k)
SELECT id FROM walked WHERE k IN (SELECT unnest(kept) FROM (SELECT kept FROM walk ORDER BY k DESC LIMIT 1))
UNION ALL SELECT id FROM firsts WHERE least NOT IN (SELECT x FROM ends)
UNION ALL SELECT doc_id FROM words WHERE coalesce(len(words), 0) = 0""")
def near_dup_removed(spark: SparkSession, d: str) -> DataFrame:
    return dedup.near_dup_removed(A.files(spark, d, text=True))


@query()
def similar_names(spark: SparkSession, d: str) -> DataFrame:
    return dedup.similar_names(A.files(spark, d), paths.parent(F.col("path")))
