"""A corpus pipeline out of the operators in ``archivelens.llm``.

Quality classifier (rejected documents go), MinHash near-dedup (one document of a group stays), secret
scans (secrets are masked in the text), mixing to target weights (documents repeat or go), packing.
Each stage takes the rows that the stage before it kept, as a table of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archivelens.functions import scratch
from archivelens.llm import mixing, neardup, packing, quality, secrets, tokens

#: Tokenising and packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model, fitted on the labelled ones among them, doesn't reject.

    A null text is scored as an empty one; null and repeated doc_ids are ordinary rows, equal rows are
    kept or rejected alike; other columns are left out; an empty table stays empty. Without labels
    nothing is known against any document, so all stay.
    """
    model = quality.train(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model).filter("quality_score >= 0.5").select(COLUMNS)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (similarity 0.8 or more), the one of least doc_id.

    Of rows under that doc_id the ones go whose own text belongs to a group of smaller doc_id, and of rows of one
    doc_id and text one stays, the first by lang, source and n_chars (nulls first). Rows without a doc_id or
    without words belong to no group, but of those with one doc_id (or none) and text one stays as well. Other
    columns are left out; an empty table stays empty.
    """
    marked = neardup.near_duplicates(docs, percent=80, text_hash=True).filter("kept")
    kept = marked.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("kept_rows")).toDF("kept_id", "kept_hash", "kept_rows")
    rows = docs.select(COLUMNS).withColumn("own_hash", F.xxhash64(F.col("text").cast("string")))
    rows = rows.join(kept, F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("own_hash") == F.col("kept_hash")))
    once, more = rows.filter("kept_rows = 1").select(COLUMNS), rows.filter("kept_rows > 1")
    first = more.groupBy("doc_id", "own_hash").agg(F.min(F.struct("lang", "source", "n_chars", "text")).alias("f"))
    return once.unionByName(first.select("doc_id", "f.*").select(COLUMNS))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret found by the ledger scan masked in the text.

    A null text stays null; null and repeated doc_ids and equal rows are ordinary rows; n_chars is that
    of the masked text; other columns are left out; an empty table stays empty.
    """
    ledger = scratch.stored(secrets.scan_unseen(docs, None), "ledger")
    text = secrets.redacted(F.col("text"), F.col("secret_spans"))
    masked = secrets.findings(docs, ledger).withColumn("text", text)
    return masked.withColumn("n_chars", F.when(F.size("secret_spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as its source's target takes it, in training order.

    A document that a target cuts has its own n_chars. Rows without words aren't taken; a null source is
    a source; null and repeated doc_ids and equal rows are ordinary rows; other columns are left out; an
    empty table stays empty. Packing deals documents anew, so of this stage the amounts take effect.
    """
    taken = mixing.occurrences(mixing.mix(docs.withColumn("whole_length", F.length("text"))), [*COLUMNS, "whole_length"])
    cut = F.length("text") != F.col("whole_length")
    return taken.withColumn("n_chars", F.when(cut, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences of the byte-level vocabulary; workers keep no words for the stages after.

    A null text packs its end id; null and repeated doc_ids and equal rows are packed each; other columns
    are left out; an empty table gives no rows.
    """
    return packing.pack(docs, tokens.vocabulary_path("byte_bpe_50k.json"), idle=0)


STAGES = [("quality classifier", classify), ("near-dedup", dedup), ("secret scan", mask_secrets), ("mixing", mix), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = f"{scratch.shared_dir(spark)}/stage-{k}-{uuid.uuid4().hex}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
