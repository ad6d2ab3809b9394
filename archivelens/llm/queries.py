"""The registered queries of this subpackage: thin, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archivelens.functions import scratch
from archivelens.llm import ann, binary, chat, lexical, media, mixing, neardup, packing, phrases, quality, secrets, sharding, sql, tokens, urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokens.vocabulary_path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("tokens").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = scratch.stored(media.store(table(spark, sf_dir, "documents")), "media")
    tiles = scratch.stored(media.describe(stored), "tiles")
    return media.hashed(tiles).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op3_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.perspectives(table(spark, sf_dir, "conversations"))


def op4_url_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), urls.CONTRACT).select("page_id", "host", "path", "rule", "verdict")


def op5_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch.new_path(spark, "token-files")
    binary.write(table(spark, sf_dir, "documents"), folder, tokens.vocabulary_path("word_bpe_49k.json"))
    return binary.read(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select(
        "doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"),
        F.col("mix_taken").alias("taken"), F.round("mix_position", 6).alias("position"),
    )


def op7_vantage_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op8_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op9_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    folder = scratch.new_path(spark, "ledger")
    delivery = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 2
    for part in range(2):  # all rows, in two deliveries: the second scans only what the first hasn't seen
        ledger = secrets.append_unseen(docs.filter(delivery == part), folder)
    found = secrets.findings(docs, ledger)
    spans = F.col("secret_spans")
    listed = secrets.listed(spans)
    counts = [secrets.counted(spans, k).alias(f"n_{k}") for k in secrets.KINDS]
    return found.select("doc_id", *counts, F.sha2(listed, 256).alias("base_sha256"), listed.alias("spans"))


def op10_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(spark, docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model).withColumnRenamed("quality_score", "score")
    held_out = F.coalesce(quality.fold(F.col("doc_id")) == 1, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch.new_path(spark, "shards")
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    return sharding.write(table(spark, sf_dir, "documents"), folder).select("doc_id", "size", crc.alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op12_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.best_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_packing, op2_media, op3_chat_perspectives, op4_url_words, op5_token_binary, op6_mixing, op7_vantage_points,
        op8_minhash_neardup, op9_secret_ledger, op10_quality_gam, op11_external_shuffle,
        op12_phrase_mining, op13_lexical_search,
    )
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op3_chat_perspectives": sql.CHAT, "op6_mixing": sql.MIXING, "op9_secret_ledger": sql.SECRETS, "op12_phrase_mining": sql.PHRASES, "op13_lexical_search": sql.LEXICAL}
