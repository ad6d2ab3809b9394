"""Text, chunking and search queries with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archivelens.functions import similarity, text
from archivelens.operators import chunking, search
from archivelens.plans.catalog_queries import query as _query
from archivelens.sources import adapters as A
from archivelens.sources.adapters import AS_OF, FILES

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    return _query(sql, QUERIES, SQL)


VECTORS = "v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)"


@query(f"""WITH {VECTORS}, s AS (SELECT vec_id AS chunk_id, label AS source, round(list_dot_product(e, q) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(q, q))), 6) AS similarity
  FROM v, (SELECT e AS q FROM v WHERE vec_id = 0))
SELECT * FROM s WHERE similarity >= 0.3 ORDER BY similarity DESC, chunk_id LIMIT 12""")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    chunks = A.chunks(spark, d)
    row = chunks.filter("chunk_id = 0").select("embedding").head()
    return search.one_query_topk(list(row["embedding"]) if row else [0.0], chunks)


@query(f"""WITH {VECTORS}, s AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id,
  round(list_dot_product(q.e, c.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(c.e, c.e))), 6) AS similarity
  FROM v q, v c WHERE q.vec_id % 20 = 0)
SELECT query_id, chunk_id, similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id)::INT AS rank FROM s WHERE similarity >= 0.1) WHERE rank <= 12""")
def vector_topk_batch(spark: SparkSession, d: str) -> DataFrame:
    chunks = A.chunks(spark, d)
    queries = chunks.filter("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("vector"))
    return search.vector_topk(queries, chunks, floor=0.1)


@query("""WITH v AS (SELECT vec_id, label, CASE WHEN vec_id % 9 = 0 THEN embedding[1:32] ELSE embedding END AS e FROM embeddings),
best AS (SELECT len(e) AS n FROM v GROUP BY len(e) ORDER BY count(*) DESC, n LIMIT 1)
SELECT vec_id AS chunk_id, label AS source, len(e)::INT AS n FROM v WHERE len(e) = (SELECT n FROM best)""")
def majority_dim(spark: SparkSession, d: str) -> DataFrame:
    mixed = A.chunks(spark, d).withColumn("embedding", F.when(F.col("chunk_id") % 9 == 0, F.slice("embedding", 1, 32)).otherwise(F.col("embedding")))
    return search.majority_size(mixed).select("chunk_id", "source", F.size("embedding").alias("n"))


WORDS = ("the", "que", "und", "les")


@query(f"""SELECT doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda l: NOT ({" OR ".join(f"contains(lower(l), ' {w} ')" for w in WORDS)})), chr(10)) AS text FROM documents""")
def clean_lines(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "documents").select("doc_id", text.drop_lines(F.col("text"), [f" {w} " for w in WORDS]).alias("text"))


def _html_sql() -> str:
    out = "regexp_replace(regexp_replace(html, '(?is)<script.*?</script>', ' ', 'g'), '(?is)<style.*?</style>', ' ', 'g')"
    out = f"regexp_replace(regexp_replace({out}, '{text.BREAKS}', chr(10), 'g'), '(?s)<[^>]*>', ' ', 'g')"
    for entity, char in text.ENTITIES:
        out = f"replace({out}, '{entity}', '{char.replace(chr(39), chr(39) * 2)}')"
    return f"array_to_string(list_filter(list_transform(string_split({out}, chr(10)), lambda l: trim(regexp_replace(l, '[ \\t\\r\\f]+', ' ', 'g'), ' ')), lambda l: l <> ''), chr(10))"


@query(f"SELECT page_id, {_html_sql()} AS text FROM pages")
def html_text(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "pages").select("page_id", text.html_text(F.col("html")).alias("text"))


@query("""SELECT doc_id, CASE WHEN length(text) <= 2000 THEN text ELSE substring(text, 1, 1200) || chr(10) || '[... middle ...]' || chr(10)
  || substring(text, (length(text) // 2 - 200 + 1)::INT, 400) || chr(10) || '[... end ...]' || chr(10) || substring(text, (length(text) - 400 + 1)::INT, 400) END AS text FROM documents""")
def sample_text(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "documents").select("doc_id", text.sample(F.col("text"), 2000).alias("text"))


@query("""WITH hit AS (SELECT doc_id, text, length(text) AS n, list_min(list_filter([strpos(lower(text), w) FOR w IN ['password', 'license', 'ment']], lambda p: p > 0)) AS p FROM documents),
own AS (SELECT *, greatest(1, least(p - 150, n - 300 + 1)) AS s FROM hit)
SELECT doc_id, CASE WHEN n <= 300 THEN text WHEN p IS NULL THEN substring(text, 1, 300) || '...'
  ELSE CASE WHEN s > 1 THEN '...' ELSE '' END || substring(text, s::INT, 300) || CASE WHEN s + 299 < n THEN '...' ELSE '' END END AS snippet FROM own""")
def snippets(spark: SparkSession, d: str) -> DataFrame:
    words = F.array(*map(F.lit, ("password", "license", "ment")))
    return A.table(spark, d, "documents").select("doc_id", text.snippet(F.col("text"), words).alias("snippet"))


@query(f"""WITH {FILES} SELECT path, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(path), '[\\s_\\-./]+'), lambda t: length(t) >= 2 AND t NOT IN ('docx', 'xlsx', 'pdf', 'pptx', 'txt', 'md', 'csv', 'eml', 'hwp') AND NOT regexp_matches(t, '^[0-9]+$')))) AS tokens FROM files""")
def source_tokens(spark: SparkSession, d: str) -> DataFrame:
    return A.files(spark, d).select("path", F.array_sort(text.source_tokens(F.col("path"))).alias("tokens"))


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks with names, texts and vectors: embeddings beside the documents of the same id."""
    files = A.files(spark, d, text=True).select("doc_id", F.col("name").alias("file_name"), F.col("path").alias("source_path"), "modified_at", F.col("text").alias("chunk_text"))
    return files.join(A.chunks(spark, d).withColumnRenamed("chunk_id", "doc_id"), "doc_id").withColumnRenamed("doc_id", "chunk_id")


def _questions(spark: SparkSession, d: str) -> DataFrame:
    rows = A.chunks(spark, d).filter("chunk_id % 20 = 0")
    words = F.element_at(F.array(*map(F.lit, ("fr entionsh src", "password stand de", "es license", "doc reou en"))), (F.col("chunk_id") / 20 % 4 + 1).cast("int"))
    return rows.select(F.col("chunk_id").alias("query_id"), words.alias("text"), F.col("embedding").alias("vector"))


CHUNKS = f"""{FILES}, chunks AS (SELECT f.doc_id AS chunk_id, f.name AS file_name, f.path AS source_path, f.modified_at, f.text AS chunk_text, e.embedding::DOUBLE[] AS e
  FROM files f JOIN embeddings e ON e.vec_id = f.doc_id),
questions AS (SELECT vec_id AS query_id, list_value('fr entionsh src', 'password stand de', 'es license', 'doc reou en')[(vec_id // 20 % 4 + 1)::INT] AS text, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 20 = 0),
terms AS (SELECT DISTINCT query_id, unnest(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda t: length(t) >= 2)) AS term FROM questions),
tokens AS (SELECT DISTINCT chunk_id, unnest(list_filter(regexp_split_to_array(lower(file_name || ' ' || source_path), '[\\s_\\-./]+'), lambda t: length(t) >= 2 AND t NOT IN ('docx', 'xlsx', 'pdf', 'txt', 'md', 'csv', 'eml') AND NOT regexp_matches(t, '^[0-9]+$'))) AS term FROM chunks),
source_terms AS (SELECT * FROM terms WHERE term IN (SELECT term FROM tokens)),
sims AS (SELECT query_id, chunk_id, round(list_dot_product(q.e, c.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(c.e, c.e))), 6) AS similarity FROM questions q, chunks c),
names AS (SELECT query_id, chunk_id, hits FROM (SELECT query_id, chunk_id, count(*) AS hits, rank() OVER (PARTITION BY query_id ORDER BY count(*) DESC) AS p FROM source_terms JOIN tokens USING (term) GROUP BY query_id, chunk_id) WHERE p = 1)"""


@query(f"WITH {CHUNKS}, exact AS (SELECT query_id, chunk_id, count(*) AS hits, rank() OVER (PARTITION BY query_id ORDER BY count(*) DESC) AS p FROM source_terms JOIN chunks ON contains(lower(file_name), term) GROUP BY query_id, chunk_id) SELECT query_id, chunk_id, hits::INT AS hits FROM exact WHERE p = 1")
def exact_name_hits(spark: SparkSession, d: str) -> DataFrame:
    chunks = _chunks(spark, d)
    terms = _questions(spark, d).select("query_id", F.explode(text.match_terms(F.col("text"))).alias("term")).distinct()
    return search.exact_name_hits(search.indexed_terms(terms, search.index(chunks)), chunks)


@query(f"WITH {CHUNKS} SELECT * FROM names")
def best_token_match(spark: SparkSession, d: str) -> DataFrame:
    chunks = _chunks(spark, d)
    terms = _questions(spark, d).select("query_id", F.explode(text.match_terms(F.col("text"))).alias("term")).distinct()
    return search.best_token_match(search.indexed_terms(terms, search.index(chunks)), chunks)


HYBRID = f"""{CHUNKS}, content_terms AS (SELECT * FROM terms EXCEPT SELECT * FROM source_terms),
matched AS (SELECT query_id, chunk_id FROM (SELECT query_id, chunk_id, count(*) AS s FROM source_terms JOIN tokens USING (term) GROUP BY ALL) JOIN (SELECT query_id, count(*) AS n FROM source_terms GROUP BY query_id) USING (query_id) WHERE s >= greatest(1, n - 1)),
content AS (SELECT DISTINCT query_id, chunk_id FROM matched JOIN content_terms USING (query_id) JOIN chunks USING (chunk_id) WHERE contains(lower(chunk_text), term)),
exact AS (SELECT query_id, chunk_id FROM (SELECT query_id, chunk_id, rank() OVER (PARTITION BY query_id ORDER BY count(*) DESC) AS p FROM source_terms JOIN chunks ON contains(lower(file_name), term) GROUP BY query_id, chunk_id) WHERE p = 1),
lists AS (
  SELECT * FROM (SELECT query_id, chunk_id, 0 AS list_no, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS position FROM content JOIN sims USING (query_id, chunk_id)) WHERE position <= 5
  UNION ALL SELECT * FROM (SELECT query_id, chunk_id, 1, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS position FROM sims WHERE similarity >= 0.3) WHERE position <= 12
  UNION ALL SELECT * FROM (SELECT query_id, chunk_id, 2, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS position FROM exact JOIN sims USING (query_id, chunk_id)) WHERE position <= 5),
firsts AS (SELECT query_id, chunk_id, min(row(list_no, position)) AS f FROM lists GROUP BY ALL),
found AS (SELECT * FROM (SELECT query_id, chunk_id, f[1]::INT AS list_no, similarity, row_number() OVER (PARTITION BY query_id ORDER BY f, chunk_id)::INT AS rank FROM firsts JOIN sims USING (query_id, chunk_id)) WHERE rank <= 16)"""


@query(f"WITH {HYBRID} SELECT * FROM found")
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    return search.hybrid(_questions(spark, d), _chunks(spark, d)).select("query_id", "chunk_id", "list_no", "similarity", "rank")


@query(f"""WITH {FILES}, asked(query_id, n) AS (VALUES (1, 3), (2, 5), (3, 8)), latest AS (SELECT path AS source_path, modified_at FROM files),
ranked AS (SELECT *, row_number() OVER (ORDER BY modified_at DESC, source_path)::INT AS rank FROM latest)
SELECT query_id, source_path, rank FROM asked JOIN ranked ON rank <= n""")
def date_ranking(spark: SparkSession, d: str) -> DataFrame:
    asked = spark.createDataFrame([(1, "latest 3 files"), (2, "newest files"), (3, "the 8 most recent")], "query_id int, text string")
    chunks = A.files(spark, d).select(F.col("path").alias("source_path"), "modified_at")
    return search.date_ranking(F.col("text"), chunks, asked).select("query_id", "source_path", "rank")


@query("""WITH lists AS (SELECT user_id AS query_id, event_id % 97 AS chunk_id, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 ELSE 2 END AS list_no, event_id % 40 AS position FROM events),
f AS (SELECT query_id, chunk_id, min(row(list_no, position)) AS f FROM lists GROUP BY ALL)
SELECT * FROM (SELECT query_id, chunk_id, f[1]::INT AS list_no, row_number() OVER (PARTITION BY query_id ORDER BY f, chunk_id)::INT AS rank FROM f) WHERE rank <= 16""")
def candidate_merge(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "view", 0).when(F.col("event_type") == "click", 1).otherwise(2)
    lists = A.table(spark, d, "events").select(F.col("user_id").alias("query_id"), (F.col("event_id") % 97).alias("chunk_id"), kind.alias("list_no"), (F.col("event_id") % 40).alias("position"))
    return search.merge_candidates(lists)


@query(f"""WITH {FILES}, hits AS (SELECT doc_id % 7 AS query_id, path AS source_path FROM files),
t AS (SELECT query_id, count(DISTINCT source_path) AS sources FROM hits GROUP BY query_id HAVING count(DISTINCT source_path) > 10),
l AS (SELECT query_id, string_agg(source_path, chr(10) ORDER BY source_path) AS names FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY source_path) AS r FROM (SELECT DISTINCT * FROM hits)) WHERE r <= 80 GROUP BY query_id)
SELECT query_id, sources, names, greatest(sources - 80, 0) AS omitted FROM t JOIN l USING (query_id)""")
def keyword_summary(spark: SparkSession, d: str) -> DataFrame:
    hits = A.files(spark, d).select((F.col("doc_id") % 7).alias("query_id"), F.col("path").alias("source_path"))
    return search.keyword_summary(hits)


@query(f"""WITH {CHUNKS}, best AS (SELECT query_id, max(similarity) AS top FROM sims WHERE query_id <> chunk_id GROUP BY query_id)
SELECT query_id, top, CASE WHEN top >= 0.55 THEN 'certain' WHEN top >= 0.42 THEN 'estimated' ELSE 'check' END AS confidence FROM best""")
def confidence(spark: SparkSession, d: str) -> DataFrame:
    sims = search.nearest(_questions(spark, d).withColumn("scope", F.lit("")), _chunks(spark, d).withColumn("scope", F.lit("")), 2)  # one may be the query's own
    return sims.filter("query_id <> chunk_id").groupBy("query_id").agg(F.max("similarity").alias("top")).withColumn("confidence", search.confidence(F.col("top")))


@query()
def chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk(A.table(spark, d, "documents"), lambda t: chunking.cut_paragraphs(t, break_at="\n"))


@query()
def name_ratio(spark: SparkSession, d: str) -> DataFrame:
    files = A.files(spark, d)
    return files.select("doc_id", "name", F.round(similarity.name_match(F.concat(F.lit("report "), F.col("doc_id") % 100, F.lit(" v2")), F.col("name")), 6).alias("match"))


@query()
def evidence(spark: SparkSession, d: str) -> DataFrame:
    rows = search.hybrid(_questions(spark, d), _chunks(spark, d)).join(_chunks(spark, d), "chunk_id").join(_questions(spark, d).select("query_id", F.col("text").alias("question")), "query_id")
    rows = rows.withColumn("name_match", similarity.name_match(F.col("question"), F.col("file_name"))).withColumn("overlap", text.query_overlap(text.match_terms(F.col("question")), F.concat_ws(" ", "file_name", "chunk_text")))
    return search.split_evidence(rows).select("query_id", "chunk_id", "source_path", F.round("similarity", 6).alias("similarity"), "rank", "role")
