"""Queries of answers, reports, groups and streams with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archivelens.functions import paths, scratch, similarity, text
from archivelens.operators import audit, catalog, cluster, filters, rules, scoring, search
from archivelens.plans.catalog_queries import NOW
from archivelens.plans.catalog_queries import query as _query
from archivelens.plans.work_queries import NAMED, _named
from archivelens.sources import adapters as A
from archivelens.sources import packages
from archivelens.sources.adapters import FILES
from archivelens.streaming import streams

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    return _query(sql, QUERIES, SQL)


@query(f"""WITH {FILES}, known AS (SELECT doc_id // 20 AS query_id, name AS file_name, path AS source_path FROM files),
cited AS (SELECT doc_id // 20 AS query_id, CASE WHEN doc_id % 4 = 0 THEN upper(name) WHEN doc_id % 4 = 1 THEN path ELSE 'see ' || name || ', page 2' END AS cited FROM files WHERE doc_id % 4 < 3),
exact AS (SELECT * FROM cited JOIN known USING (query_id) WHERE lower(cited) = lower(file_name) OR lower(cited) = lower(source_path)),
near AS (SELECT * FROM cited c JOIN known USING (query_id) WHERE (contains(lower(cited), lower(file_name)) OR contains(lower(file_name), lower(cited))) AND NOT EXISTS (SELECT 1 FROM exact e WHERE e.query_id = c.query_id AND e.cited = c.cited))
SELECT query_id, cited, source_path, how FROM (SELECT *, row_number() OVER (PARTITION BY query_id, cited ORDER BY source_path) AS n FROM (SELECT *, 'exact' AS how FROM exact UNION ALL SELECT *, 'contains' FROM near)) WHERE n = 1""")
def answer_sources(spark: SparkSession, d: str) -> DataFrame:
    files = A.files(spark, d).withColumn("query_id", F.expr("doc_id div 20"))
    k = F.col("doc_id") % 4
    cited = files.filter(k < 3).select("query_id", F.when(k == 0, F.upper("name")).when(k == 1, F.col("path")).otherwise(F.concat(F.lit("see "), "name", F.lit(", page 2"))).alias("cited"))
    return search.resolve_sources(cited, files.select("query_id", F.col("name").alias("file_name"), F.col("path").alias("source_path"))).select("query_id", "cited", "source_path", "how")


@query("""WITH h AS (SELECT conv_id AS query_id, turn AS rank, role AS file_name, text FROM conversations),
f AS (SELECT query_id, file_name, min(rank) AS first FROM h GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY first, file_name) AS file_no FROM f),
b AS (SELECT query_id, file_no, '[File ' || file_no || '] ' || file_name || chr(10) || string_agg('(' || i || ') ' || text, chr(10) ORDER BY i) AS block
  FROM (SELECT h.*, file_no, row_number() OVER (PARTITION BY h.query_id, h.file_name ORDER BY rank, text) AS i FROM h JOIN n USING (query_id, file_name)) GROUP BY query_id, file_no, file_name)
SELECT query_id, string_agg(block, chr(10) || chr(10) ORDER BY file_no) AS context FROM b GROUP BY query_id""")
def context_packs(spark: SparkSession, d: str) -> DataFrame:
    rows = A.table(spark, d, "conversations")
    return search.pack_context(rows.select(F.col("conv_id").alias("query_id"), F.col("turn").alias("rank"), F.col("role").alias("file_name"), F.col("role").alias("source_path"), F.col("text").alias("chunk_text")))


@query("""WITH d AS (SELECT conv_id, CASE WHEN turn % 3 = 0 THEN 'representative' ELSE 'support' END AS role, 'turn ' || turn AS name, turn AS score, text FROM conversations),
b AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY role, score DESC, name) AS n, '[' || role || '] ' || name || chr(10) || left(text, CASE role WHEN 'support' THEN 30 ELSE 80 END) AS block FROM d)
SELECT conv_id, string_agg(block, chr(10) || chr(10) ORDER BY n) AS digest FROM b GROUP BY conv_id""")
def group_digest(spark: SparkSession, d: str) -> DataFrame:
    rows = A.table(spark, d, "conversations")
    docs = rows.select("conv_id", F.when(F.col("turn") % 3 == 0, "representative").otherwise("support").alias("role"), F.concat(F.lit("turn "), "turn").alias("name"), F.col("turn").alias("score"), "text")
    return audit.digest(docs, ["conv_id"], {"representative": 80, "support": 30})


@query("""SELECT source, docs, deliverables, dates, (least(40, docs * 5) + CASE WHEN deliverables > 0 THEN 35 ELSE 0 END + CASE WHEN dates > 0 THEN 15 ELSE 0 END)::INT AS importance
FROM (SELECT source || '/' || lang || '/' || (doc_id % 29) AS source, count(*) AS docs, count(*) FILTER (contains(lower(text), 'license')) AS deliverables, count(*) FILTER (regexp_matches(text, '[0-9]{4}')) AS dates FROM documents GROUP BY 1)""")
def evidence_importance(spark: SparkSession, d: str) -> DataFrame:
    group = F.concat_ws("/", "source", "lang", F.col("doc_id") % 29)
    groups = A.table(spark, d, "documents").groupBy(group.alias("source")).agg(F.count(F.lit(1)).alias("docs"), F.count_if(F.contains(F.lower("text"), F.lit("license"))).alias("deliverables"), F.count_if(F.regexp_like("text", F.lit("[0-9]{4}"))).alias("dates"))
    return scoring.evidence_importance(groups)


CONTEXT_RULES = (("objective", "win contracts", "contract", "name", 1, 1), ("objective", "plan work", "plan", "name", 1, 2), ("stage", "design", "design", "name", 1, 3), ("stage", "operation", "data", "name", 1, 4))
SIGNAL_RULES = (("status", "approval", "contract", "name", 1, 1), ("status", "review", "review", "name", 1, 2))


@query(f"""WITH {NAMED}, g AS (SELECT doc_id, low_name, top || '/' || (doc_id % 8) || '/' || (doc_id % 11) AS grp FROM named),
s AS (SELECT grp, count(*) AS docs, max(contains(low_name, 'contract')::INT) AS a, max(contains(low_name, 'review')::INT) AS r, max((contains(low_name, 'contract') OR contains(low_name, 'plan'))::INT) AS o, max(contains(low_name, 'contract')::INT) AS o1,
  max(contains(low_name, 'design')::INT) AS d1, max(contains(low_name, 'data')::INT) AS d2, count(DISTINCT CASE WHEN contains(low_name, 'contract') THEN 1 END) + count(DISTINCT CASE WHEN contains(low_name, 'review') THEN 1 END) AS signals FROM g GROUP BY grp),
c AS (SELECT *, 45 + least(15, docs * 3) + least(25, signals * 8) AS base, CASE WHEN a = 1 THEN 'approval' WHEN r = 1 THEN 'review' WHEN d1 = 1 THEN 'design' WHEN d2 = 1 THEN 'operation' ELSE 'planning' END AS stage FROM s)
SELECT grp, CASE WHEN o1 = 1 THEN 'win contracts' WHEN o = 1 THEN 'plan work' ELSE 'Unknown' END AS objective, stage,
  greatest(0, least(100, 35 + o * 15 + CASE WHEN stage <> 'planning' THEN 10 ELSE 0 END + least(15, docs * 5) + least(10, round_even(base / 10, 0))))::INT AS confidence FROM c""")
def business_context(spark: SparkSession, d: str) -> DataFrame:
    docs = _named(spark, d).select("doc_id", "name", F.lit("").alias("text"), F.concat_ws("/", paths.top(F.col("path")), F.col("doc_id") % 8, F.col("doc_id") % 11).alias("grp"))
    schema = "rule_set string, label string, keyword string, field string, weight int, rule_order int"
    status = rules.work_status(docs, rules.hits(docs, spark.createDataFrame(list(SIGNAL_RULES), schema)), ["grp"])
    return rules.business_context(status, rules.hits(docs, spark.createDataFrame(list(CONTEXT_RULES), schema)), ["grp"])


@query(f"""WITH {NAMED}, r AS (SELECT doc_id, path, doc_id // 10 AS cluster, ext AS family, value AS score, modified_at FROM valued),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster, family ORDER BY modified_at DESC, path) AS n FROM r) WHERE n = 1)
SELECT cluster, path, rank FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY score DESC, modified_at DESC, path)::INT AS rank FROM one) WHERE rank <= 3""")
def cluster_representatives(spark: SparkSession, d: str) -> DataFrame:
    docs = scoring.document_value(_named(spark, d), A.as_of()).select("doc_id", "path", "modified_at", F.col("value").alias("score"), paths.suffix(F.col("path")).alias("family"))
    return cluster.cluster_representatives(docs.select("doc_id", F.expr("doc_id div 10").alias("cluster")), docs).select("cluster", "path", "rank")


@query(f"""WITH {FILES} SELECT 'file' AS source_kind, 0 AS ord, path AS source_path, NULL AS sender FROM files
UNION ALL SELECT 'memo', 1, 'memo ' || s_suppkey, NULL FROM supplier UNION ALL SELECT 'chat', 2, 'chat ' || conv_id, role FROM conversations""")
def chunk_union(spark: SparkSession, d: str) -> DataFrame:
    files = A.files(spark, d).select(F.col("path").alias("source_path"))
    memos = A.table(spark, d, "supplier").select(F.concat(F.lit("memo "), "s_suppkey").alias("source_path"))
    chats = A.table(spark, d, "conversations").select(F.concat(F.lit("chat "), "conv_id").alias("source_path"), F.col("role").alias("sender"))
    return packages.union_sources([("file", files), ("memo", memos), ("chat", chats)])


@query(f"""WITH {FILES}, own AS (SELECT CASE WHEN doc_id % 5 = 0 THEN name WHEN doc_id % 5 = 1 THEN replace(path, '/', chr(92)) ELSE path END AS path, top, doc_id FROM files)
SELECT CASE WHEN doc_id % 5 = 0 THEN 'other' ELSE top END AS project, count(*) AS docs, min(path) AS first_path FROM own GROUP BY 1""")
def project_groups(spark: SparkSession, d: str) -> DataFrame:
    files = A.files(spark, d)
    path = F.when(F.col("doc_id") % 5 == 0, F.col("name")).when(F.col("doc_id") % 5 == 1, F.replace("path", F.lit("/"), F.lit("\\"))).otherwise(F.col("path"))
    return catalog.project_groups(files.withColumn("path", path)).groupBy("project").agg(F.count(F.lit(1)).alias("docs"), F.min("path").alias("first_path"))


@query("""SELECT doc_id, CASE WHEN lang IN ('en', 'fr') THEN array_to_string(list_filter(string_split(text, chr(10)), lambda l: NOT contains(lower(l), 'license')), chr(10)) ELSE text END AS text FROM documents""")
def preprocessed(spark: SparkSession, d: str) -> DataFrame:
    docs = A.table(spark, d, "documents")
    kind = F.when(F.col("lang").isin("en", "fr"), "document").otherwise("chat")
    return docs.select("doc_id", text.preprocess(F.col("text"), kind, ["license"], ["unsubscribe"]).alias("text"))


@query("""SELECT o_orderkey, 'key: ' || o_orderkey || ' | total: $' || format('{:,.2f}', o_totalprice) || ' | status: ' || o_orderstatus || CASE WHEN o_orderkey % 3 = 0 THEN ' | note: third' ELSE '' END AS line FROM orders""")
def sheet_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = A.table(spark, d, "orders")
    cells = F.array(text.cell(F.col("o_orderkey"), F.lit("integer")), text.cell(F.col("o_totalprice"), F.lit("currency")), F.col("o_orderstatus"), F.when(F.col("o_orderkey") % 3 == 0, "third").otherwise(""))
    return rows.select("o_orderkey", text.sheet_row(F.array(*map(F.lit, ("key", "total", "status", "note"))), cells).alias("line"))


@query(f"""WITH {FILES} SELECT 'folders' AS section, top AS label, count(*) AS n FROM files GROUP BY top UNION ALL SELECT 'types', ext, count(*) FROM files GROUP BY ext""")
def report_tables(spark: SparkSession, d: str) -> DataFrame:
    files, folder = A.files(spark, d), scratch.new_path(spark, "report")
    count = lambda label: files.groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("n"))
    packages.write_report({"folders": count(paths.top(F.col("path"))), "types": count(paths.suffix(F.col("path")))}, folder)
    parts = [spark.read.schema("label string, n long").json(f"{folder}/{s}").select(F.lit(s).alias("section"), "label", "n") for s in ("folders", "types")]
    return parts[0].unionByName(parts[1])


@query(f"""WITH {FILES} SELECT name, CASE WHEN is_hidden OR name IN ('thumbs.db', 'desktop.ini', '.ds_store') THEN 'excluded_extension_or_system'
  WHEN ext IN ('.png', '.jpg', '.tmp') THEN 'unsupported_type' WHEN modified_at < {NOW} - to_days(30) AND created_at < {NOW} - to_days(30) THEN 'older_than_30_days' ELSE 'kept' END AS reason FROM files""")
def ledger_split(spark: SparkSession, d: str) -> DataFrame:
    kept, gone = filters.split(filters.exclusions(A.files(spark, d), A.as_of()))
    return kept.select("name", F.lit("kept").alias("reason")).unionByName(gone)


@query(f"""WITH {FILES}, t AS (SELECT doc_id, list_distinct(string_split(lower(path), '/')) AS t FROM files)
SELECT a.doc_id, round(len(list_intersect(a.t, b.t))::DOUBLE / len(list_distinct(list_concat(a.t, b.t))), 6) AS alike FROM t a JOIN t b ON b.doc_id = a.doc_id + 1""")
def path_overlap(spark: SparkSession, d: str) -> DataFrame:
    own = A.files(spark, d).select("doc_id", F.array_distinct(F.split(F.lower("path"), "/")).alias("a"))
    after = own.select((F.col("doc_id") - 1).alias("doc_id"), F.col("a").alias("b"))
    return own.join(after, "doc_id").select("doc_id", F.round(similarity.jaccard(F.col("a"), F.col("b")), 6).alias("alike"))


@query("""SELECT s_suppkey AS query_id, CASE s_suppkey % 3 WHEN 0 THEN 'date_ranking' WHEN 1 THEN 'compound' ELSE 'search' END AS route, CASE WHEN s_suppkey % 3 = 1 THEN 2 ELSE 1 END::BIGINT AS parts FROM supplier""")
def query_routes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey") % 3
    asked = A.table(spark, d, "supplier").select(F.col("s_suppkey").alias("query_id"), F.when(k == 0, "latest files of s_name").when(k == 1, F.concat(F.lit("show "), "s_name", F.lit(" and then list orders please"))).otherwise("salt and then pepper").alias("text"))
    return search.route(asked, ["latest", "newest"], [" and then "], ["please"]).select("query_id", "route", "parts")


@query("""SELECT s_suppkey AS label, CASE WHEN s_suppkey % 3 = 0 THEN 'third' ELSE 'fallback' END AS items FROM supplier""")
def looked_up(spark: SparkSession, d: str) -> DataFrame:
    rows = A.table(spark, d, "supplier").select(F.col("s_suppkey").alias("label"))
    table = rows.filter("label % 3 = 0").withColumn("items", F.lit("third")).unionByName(spark.createDataFrame([(-1, "fallback")], "label long, items string").withColumn("label", F.col("label").cast(dict(rows.dtypes)["label"])))
    return rules.look_up(rows, table, -1)


def _stream(spark: SparkSession, parts: list[DataFrame], files: int = 2) -> DataFrame:
    """A stream of rows in deliveries, one a batch, in order."""
    path = scratch.new_path(spark, "deliveries")
    for k, part in enumerate(parts):
        part.repartition(files, F.xxhash64("event_id")).write.parquet(f"{path}/{k}")  # files come in order of time
    return spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", files).option("recursiveFileLookup", True).parquet(path)


def _deliveries(spark: SparkSession, d: str) -> DataFrame:
    """A stream of the events in four deliveries, times and keys mixed over them, so that rows come late."""
    events = A.table(spark, d, "events")
    return _stream(spark, [events.filter(F.pmod(F.xxhash64("event_id"), F.lit(4)) == k) for k in range(4)])


@query("""WITH e AS (SELECT *, date_trunc('day', ts) AS day FROM events),
marks AS (SELECT max(ts) FILTER (event_id % 5 < 3) - to_days(2) AS first, max(ts) - to_days(2) AS last FROM events),
taken AS (SELECT e.*, last FROM e, marks WHERE event_id % 5 < 4 OR day + to_days(1) > first)
SELECT day::TIMESTAMP AS day, event_type, count(*) AS events FROM taken WHERE day + to_days(1) <= last GROUP BY ALL""")
def stream_activity(spark: SparkSession, d: str) -> DataFrame:
    """Three deliveries over the same days: what the last brings for days that were closed by the first is too late
    (a batch tells late rows by the watermark that the batch before it began with)."""
    path, k = scratch.new_path(spark, "activity"), F.col("event_id") % 5
    events = A.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    stream = _stream(spark, [events.filter(k < 3), events.filter(k == 3), events.filter(k == 4)])
    streams.append_activity(stream, ["event_type"], f"{path}/table", f"{path}/progress").awaitTermination()
    return spark.read.schema("day timestamp, event_type string, events long").parquet(f"{path}/table").select(F.col("day").cast("timestamp_ntz").alias("day"), "event_type", "events")


@query("""SELECT user_id AS source_path, event_id AS version, ts AS modified_at FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1""")
def stream_upsert(spark: SparkSession, d: str) -> DataFrame:
    path = scratch.new_path(spark, "upsert")
    rows = _deliveries(spark, d).select(F.col("user_id").alias("source_path"), F.col("event_id").alias("version"), F.col("ts").alias("modified_at"))
    streams.upsert_latest(rows, f"{path}/table", f"{path}/progress").awaitTermination()
    return streams.read_latest(spark, f"{path}/table").select("source_path", "version", F.col("modified_at").cast("timestamp_ntz").alias("modified_at"))


@query("SELECT event_id, user_id FROM events")
def stream_once(spark: SparkSession, d: str) -> DataFrame:
    """Deliveries of six days each that repeat a third of the one before; state lasts for 13 days."""
    path = scratch.new_path(spark, "once")
    events = A.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    part = F.floor(F.dayofyear("ts") / 6)
    bounds = events.agg(F.min(part).alias("a"), F.max(part).alias("b")).head()
    parts = [events.filter(part == k).unionByName(events.filter((part == k - 1) & (F.col("event_id") % 3 == 0))) for k in range(bounds["a"], bounds["b"] + 2)]
    rows = streams.once(_stream(spark, parts), late="13 days")
    rows.select("event_id", "user_id").writeStream.format("parquet").option("path", f"{path}/table").option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("event_id long, user_id long").parquet(f"{path}/table")


@query("SELECT event_id, upper(event_type) AS kind FROM events")
def stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    path, stream = scratch.new_path(spark, "ingest"), _deliveries(spark, d)
    for _ in range(2):  # the second start finds nothing new
        streams.resumable(stream, lambda batch: batch.select("event_id", F.upper("event_type").alias("kind")), f"{path}/table", f"{path}/progress", "v1").awaitTermination()
    return spark.read.parquet(f"{path}/table").select("event_id", "kind")
