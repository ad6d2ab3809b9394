"""The given tables under the engine's schemas, by arithmetic on their ids.

``FILES`` and the rest are the same mappings as SQL, for use in the queries' SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2026-01-01 00:00:00"
EXTENSIONS = (".docx", ".xlsx", ".pdf", ".txt", ".md", ".csv", ".eml", ".tmp")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_of() -> F.Column:
    return F.to_timestamp(F.lit(AS_OF))


def files(spark: SparkSession, sf_dir: str, text: bool = False) -> DataFrame:
    """doc_id, path, name, size_bytes, modified_at, created_at, is_hidden (, text) of documents."""
    docs = table(spark, sf_dir, "documents")
    ext = F.element_at(F.array(*map(F.lit, EXTENSIONS)), (F.col("doc_id") % 8 + 1).cast("int"))
    name = F.concat(F.lit("doc_"), F.col("doc_id"), F.lit("_v"), F.col("doc_id") % 3 + 1, ext)
    days = lambda n: as_of() - F.make_dt_interval(n.cast("int"))
    return docs.select(
        "doc_id", F.concat_ws("/", "source", "lang", name).alias("path"), name.alias("name"), F.col("n_chars").alias("size_bytes"),
        days(F.col("doc_id") * 37 % 400).alias("modified_at"), days(F.col("doc_id") * 37 % 400 + F.col("doc_id") % 30).alias("created_at"),
        (F.col("doc_id") % 50 == 0).alias("is_hidden"), *(["text"] if text else []),
    )


FILES = f"""files AS (
  SELECT doc_id, source || '/' || lang || '/' || name AS path, name, ext, source AS top, source || '/' || lang AS parent, n_chars AS size_bytes, text,
    TIMESTAMP '{AS_OF}' - to_days((doc_id * 37 % 400)::INT) AS modified_at,
    TIMESTAMP '{AS_OF}' - to_days((doc_id * 37 % 400 + doc_id % 30)::INT) AS created_at, doc_id % 50 = 0 AS is_hidden
  FROM (SELECT *, 'doc_' || doc_id || '_v' || (doc_id % 3 + 1) || ext AS name
    FROM (SELECT *, list_value({", ".join(f"'{e}'" for e in EXTENSIONS)})[(doc_id % 8 + 1)::INT] AS ext FROM documents))
)"""


def memo_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """memo_id, title, kind, target: notes that link folders, out of suppliers."""
    rows = table(spark, sf_dir, "supplier")
    langs = F.element_at(F.array(*map(F.lit, ("en", "de", "fr", "es"))), (F.col("s_suppkey") % 4 + 1).cast("int"))
    target = F.concat(F.lit("src"), F.col("s_suppkey") % 17, F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("/"), langs)).otherwise(""))
    return rows.select((F.col("s_suppkey") % 23).alias("memo_id"), F.concat(F.lit("memo "), F.col("s_suppkey") % 23).alias("title"), F.lit("folder").alias("kind"), target.alias("target")).distinct()


MEMO_LINKS = """memo_links AS (
  SELECT DISTINCT s_suppkey % 23 AS memo_id, 'memo ' || (s_suppkey % 23) AS title, 'folder' AS kind,
    'src' || (s_suppkey % 17) || CASE WHEN s_suppkey % 3 = 0 THEN '/' || list_value('en', 'de', 'fr', 'es')[(s_suppkey % 4 + 1)::INT] ELSE '' END AS target
  FROM supplier
)"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_file, line_no, sender, message: chat lines out of conversations."""
    rows = table(spark, sf_dir, "conversations")
    return rows.select(F.col("conv_id").alias("source_file"), F.col("turn").alias("line_no"), F.col("role").alias("sender"), F.col("text").alias("message"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chunk_id, source (label), embedding out of embeddings."""
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("source"), "embedding")
