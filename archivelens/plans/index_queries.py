"""Queries of keyword and similarity indexes, archives, table functions, packages and units with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archivelens.functions import paths, scratch
from archivelens.operators import alike, chunking, cluster, comms, containment, rules
from archivelens.plans.catalog_queries import query as _query
from archivelens.plans.work_queries import NAMED, _named
from archivelens.sources import adapters as A
from archivelens.sources import archives, packages
from archivelens.sources.adapters import FILES

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    return _query(sql, QUERIES, SQL)


@query(r"""WITH k AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]{8,}')) AS keyword FROM benchmark)
SELECT doc_id, keyword FROM documents JOIN k ON contains(lower(text), keyword)""")
def dictionary_hits(spark: SparkSession, d: str) -> DataFrame:
    """Every word of eight letters or more of the benchmark, wherever it stands in a document."""
    words = A.table(spark, d, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]{8,}"), F.lit(0))).alias("keyword"))
    return containment.matches(A.table(spark, d, "documents").select("doc_id", "text"), "text", words).select("doc_id", F.col("matched").alias("keyword"))


@query()
def alike_names(spark: SparkSession, d: str) -> DataFrame:
    """H7, C4: pairs of alike names of parts."""
    return alike.similar_names(A.table(spark, d, "part").select(F.col("p_name").alias("name")), 0.9)


TEMPLATES = (("review", "check > correct > sign"), ("final_report", "draft > check > publish"), ("report", "collect > write"), ("plan", "ask > plan > agree"), ("contract", "offer > contract"), ("meeting_note", "meet > note"), ("nothing", "none"))


@query(f"""WITH {NAMED}, t(key, steps) AS (VALUES {", ".join(map(str, TEMPLATES))})
SELECT doc_id, key, steps FROM (SELECT n.doc_id, t.key, t.steps, row_number() OVER (PARTITION BY n.doc_id ORDER BY length(t.key) DESC, t.key) AS r FROM named n LEFT JOIN t ON contains(low_name, t.key)) WHERE r = 1""")
def workflow_templates(spark: SparkSession, d: str) -> DataFrame:
    """The template with the longest key in a file's name."""
    table = spark.createDataFrame([(k.upper(), k, s) for k, s in TEMPLATES], "template string, key string, steps string")
    return rules.longest_key(_named(spark, d).select("doc_id", "name"), "name", table).select("doc_id", "key", "steps")


@query("SELECT 'doc-' || doc_id || '.txt' AS member, strlen(text)::BIGINT AS size_bytes, sha256(text) AS content_sha256 FROM documents")
def zip_members(spark: SparkSession, d: str) -> DataFrame:
    """All documents in archives, read back by runs of members."""
    docs, folder = A.table(spark, d, "documents"), scratch.new_path(spark, "archives")
    rows = docs.select(F.format_string("doc-%d.txt", "doc_id").alias("member"), F.col("text").cast("binary").alias("content"))
    scratch.stored(archives.write(rows, folder, max(2, -(-docs.count() // 2000))), "packed")
    return archives.members(spark, folder, split=1 << 18).select("member", "size_bytes", F.sha2("content", 256).alias("content_sha256"))


@query(r"""SELECT c_custkey || '.eml' AS mail, c_name || ' <c' || c_custkey || '@x.org>' AS sender, 'office@x.org' AS recipient, 'Account ' || c_custkey AS subject, 'segment ' || c_mktsegment AS body FROM customer""")
def zip_mails(spark: SparkSession, d: str) -> DataFrame:
    """Mails in archives, a row each."""
    people, folder = A.table(spark, d, "customer"), scratch.new_path(spark, "mails")
    mail = F.format_string("From: %s <c%d@x.org>\nTo: office@x.org\nSubject: Account %d\nDate: Mon, 05 Jan 2026 10:00:00 +0000\n\nsegment %s\n", "c_name", "c_custkey", "c_custkey", "c_mktsegment")
    scratch.stored(archives.write(people.select(F.format_string("%d.eml", "c_custkey").alias("member"), mail.cast("binary").alias("content")), folder, max(2, -(-people.count() // 2000))), "packed")
    mails = comms.read_mails(archives.as_files(archives.members(spark, folder, suffix=".eml", split=1 << 16)))
    return mails.select(F.substring_index("source_file", "::", -1).alias("mail"), "sender", "recipient", "subject", F.trim(F.regexp_replace("body", r"\s+$", "")).alias("body"))


@query()
def chunk_function(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of all documents by a table function beside them."""
    chunking.register(spark)
    A.table(spark, d, "documents").createOrReplaceTempView("chunk_function_documents")
    return spark.sql("SELECT doc_id, chunk_index, chunk_text FROM chunk_function_documents, LATERAL line_chunks(text)")


@query()
def sheet_chunks(spark: SparkSession, d: str) -> DataFrame:
    """A sheet of customers for each nation, in chunks that repeat its header."""
    chunking.register(spark)
    rows = A.table(spark, d, "customer")
    sheet = F.col("c_nationkey").cast("string").alias("sheet")
    lines = rows.select(sheet, F.col("c_custkey").alias("n"), F.concat_ws(" | ", "c_custkey", "c_name", "c_mktsegment").alias("line"))
    heads = rows.select(sheet).distinct().select("sheet", F.lit(-1).cast("long").alias("n"), F.lit("key | name | segment").alias("line"))
    lines.unionByName(heads).createOrReplaceTempView("sheet_chunks_lines")
    return spark.sql("SELECT * FROM sheet_chunks(TABLE(sheet_chunks_lines) PARTITION BY sheet ORDER BY n)")


@query("""SELECT 'p' || (doc_id % 2) AS package_name, source || '/' || doc_id AS source_path, sha256(text) AS text_sha256, lang, doc_id % 2 AS package_index FROM documents""")
def package_tables(spark: SparkSession, d: str) -> DataFrame:
    """Two packages, written and read back with their chunks' metadata."""
    docs = A.table(spark, d, "documents")
    folders = [scratch.new_path(spark, f"package-{k}") for k in range(2)]
    rows = docs.select("doc_id", F.concat_ws("/", "source", "doc_id").alias("source_path"), F.lit(0).alias("chunk_index"), F.col("text").alias("chunk_text"), F.array(F.col("n_chars").cast("double")).alias("embedding"), "lang")
    for k, folder in enumerate(folders):
        packages.write_package(rows.filter(F.col("doc_id") % 2 == k).drop("doc_id"), folder, f"p{k}", "2026-01-01")
    read, _ = packages.read_packages(spark, folders)
    return read.select("package_name", "source_path", F.sha2(F.col("chunk_text").cast("binary"), 256).alias("text_sha256"), "lang", F.col("package_index").cast("long").alias("package_index"))


_PART = "sum(('0x' || substr(print, {at}, 15))::BIGINT)::HUGEINT"


@query(f"""WITH m AS (SELECT source, sha256(doc_id || chr(31) || coalesce(lang, '')) AS print FROM documents)
SELECT source, count(*) AS size, count(*) || '-' || {_PART.format(at=1)} || '-' || {_PART.format(at=16)} AS identity FROM m GROUP BY source""")
def set_identity(spark: SparkSession, d: str) -> DataFrame:
    return packages.set_identity(A.table(spark, d, "documents"), ["source"], ["doc_id", "lang"])


def _sources(spark: SparkSession, d: str) -> DataFrame:
    files = _named(spark, d)
    doc = F.regexp_replace("name", r"\.[a-z]+$", "")
    cluster_ = files.select(F.lit("cluster").alias("kind"), F.expr("doc_id div 4").alias("ord"), F.element_at(F.split(doc, "[ _-]"), 1).alias("name"), F.lit(None).cast("string").alias("client"), doc.alias("doc_name"))
    project = files.select(F.lit("project").alias("kind"), (F.col("doc_id") % 50).alias("ord"), F.when(F.col("doc_id") % 50 % 2 == 0, "archive").otherwise(paths.top(F.col("path"))).alias("name"), F.lit("Nord Bank").alias("client"), F.when(F.col("doc_id") % 50 % 3 == 0, "zeta_NordBank").otherwise(doc).alias("doc_name"))
    return cluster_.unionByName(project).unionByName(files.select(F.lit("family").alias("kind"), F.expr("doc_id div 3").alias("ord"), F.element_at(F.split(doc, "[ _-]"), -1).alias("name"), F.lit(None).cast("string").alias("client"), doc.alias("doc_name")))


def _any(target: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({target}, '{w}')" for w in words) + ")"


_FUNCTION = "CASE " + " ".join(f"WHEN {_any('both_', w)} THEN {k}" for k, (_, w) in enumerate(cluster.FUNCTION_WORDS)) + " END"
_OWN = "CASE function " + " ".join(f"WHEN {k} THEN {_any('lower(own)', w)}" for k, (_, w) in enumerate(cluster.FUNCTION_WORDS)) + " ELSE false END"
_SET = "CASE " + " ".join(f"WHEN contains(lower(own), '{w}') THEN '{w}'" for w in cluster.SET_WORDS) + " END"
_BOXED = "(" + ", ".join(f"'{c}'" for c in cluster.CONTAINERS) + ")"
_CUSTOMER = r"(?i)^[\p{L}\p{N}]+(?:systems|solutions|group|bank|school|university|tech|corp|inc)$"
CANDIDATES = rf"""{NAMED}, src AS (
  SELECT 'cluster' AS kind, doc_id // 4 AS ord, regexp_split_to_array(stem, '[ _-]')[1] AS name, NULL AS client, stem AS doc_name, doc_id FROM named
  UNION ALL SELECT 'project', doc_id % 50, CASE WHEN doc_id % 50 % 2 = 0 THEN 'archive' ELSE top END, 'Nord Bank', CASE WHEN doc_id % 50 % 3 = 0 THEN 'zeta_NordBank' ELSE stem END, doc_id FROM named
  UNION ALL SELECT 'family', doc_id // 3, regexp_split_to_array(stem, '[ _-]')[-1], NULL, stem, doc_id FROM named
), m AS (SELECT kind, ord, trim(name) AS own, coalesce(client, '') AS client, doc_name, lower(trim(name) || ' ' || doc_name) AS both_,
  list_filter(regexp_split_to_array(trim(name) || ' ' || doc_name, '[/\\_\-\s.]+'), lambda w: regexp_matches(w, '{_CUSTOMER}'))[1] AS customer,
  nullif(regexp_extract(doc_name, '(?i)((?:[\p{{L}}\p{{N}}]+[\s_\-]+){{0,2}}(?:{"|".join(cluster.PROJECT_WORDS)}))', 1), '') AS phrase FROM src),
g AS (SELECT kind, ord, own, client, count(*) AS docs, bool_or({_any("both_", cluster.PROJECT_WORDS)}) AS is_project, min({_FUNCTION}) AS function,
  arg_min(customer, row(doc_name, customer)) FILTER (customer IS NOT NULL) AS found, arg_min(phrase, row(doc_name, phrase)) FILTER (phrase IS NOT NULL) AS phrase FROM m GROUP BY ALL),
k AS (SELECT *, own <> '' AND lower(own) NOT IN {_BOXED} AS named_, CASE WHEN regexp_matches(own, '{_CUSTOMER}') THEN own ELSE found END AS customer, {_SET} AS set_word FROM g),
p AS (SELECT *, CASE WHEN named_ THEN own ELSE phrase END AS project_name FROM k),
c AS (SELECT *, CASE WHEN is_project AND project_name IS NOT NULL THEN 'project' WHEN function IS NOT NULL THEN 'function' WHEN customer IS NOT NULL THEN 'customer' ELSE 'document_set' END AS of FROM p),
u AS (SELECT *, kind = 'family' AND set_word IS NOT NULL AS named_set, kind = 'project' AND of = 'customer' AND client <> '' AS of_client FROM c),
t AS (SELECT *, CASE WHEN named_set OR (kind = 'family' AND of = 'customer') THEN 'document_set' ELSE of END AS unit_type FROM u),
candidates AS (SELECT kind, ord, unit_type, CASE WHEN unit_type = 'document_set' THEN coalesce(set_word, CASE WHEN named_ THEN own END, 'document') || ' set' WHEN of_client THEN client WHEN of = 'project' THEN project_name
  WHEN of = 'function' THEN CASE WHEN {_OWN} AND named_ THEN own ELSE [{", ".join(f"'{n}'" for n, _ in cluster.FUNCTION_WORDS)}][function + 1] END ELSE customer END AS name,
  CASE WHEN named_set THEN 72 ELSE CASE of WHEN 'project' THEN 88 WHEN 'function' THEN 82 WHEN 'customer' THEN 74 ELSE 58 END + CASE WHEN kind = 'cluster' THEN least(15, docs * 4) WHEN kind = 'family' OR of_client THEN 5 ELSE 0 END END::INT AS confidence FROM t)"""


@query(f"WITH {CANDIDATES} SELECT * FROM candidates")
def unit_candidates(spark: SparkSession, d: str) -> DataFrame:
    return cluster.unit_candidates(_sources(spark, d)).drop("reason")


@query(f"""WITH {CANDIDATES}, o AS (SELECT *, ord * 4 + list_position(['cluster', 'family', 'representative', 'project'], kind) AS place, lower(trim(name)) AS key FROM candidates),
i AS (SELECT *, row_number() OVER (PARTITION BY unit_type, key ORDER BY place, confidence, name) AS i, count(*) OVER (PARTITION BY unit_type, key) AS n FROM o),
r AS (SELECT unit_type, arg_min(name, i) AS name, least(100, max(confidence + 3 * CASE WHEN i = 1 THEN n - 1 ELSE n - i + 1 END))::INT AS confidence, count(*) AS sources FROM i GROUP BY unit_type, key)
SELECT *, row_number() OVER (ORDER BY list_position(['project', 'function', 'customer', 'document_set'], unit_type), confidence DESC, name)::INT AS rank FROM r""")
def resolved_units(spark: SparkSession, d: str) -> DataFrame:
    found = cluster.unit_candidates(_sources(spark, d))
    place = F.col("ord") * 4 + F.array_position(F.array(*map(F.lit, ("cluster", "family", "representative", "project"))), F.col("kind"))
    return cluster.ranked_units(cluster.resolve_units(found.withColumn("ord", place)))
