"""Packages of chunks as Parquet tables, and their incremental build."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archivelens.functions import text

#: Items and characters of a batch that an embedder gets.
BATCH, BATCH_CHARS = 200, 200_000


def scan(spark: SparkSession, path: str) -> DataFrame:
    """A1: path, name, size_bytes, modified_at, is_hidden of every file below a folder; contents aren't
    read, as no column of them is used."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")
    name = F.element_at(F.split("path", "/"), -1)
    return rows.select("path", name.alias("name"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"), name.startswith(".").alias("is_hidden"))


def decode(data: bytes) -> str:
    """UTF-8, else the common Korean code page, else UTF-8 with marks for what can't be read."""
    for code in ("utf-8-sig", "cp949"):
        try:
            return data.decode(code)
        except UnicodeDecodeError:
            continue
    return data.decode("utf-8", "replace")


def extract(files: DataFrame, extractors: dict[str, Callable[[bytes], str]] | None = None, plain: Sequence[str] = (".txt", ".md", ".csv", ".json", ".xml", ".log")) -> DataFrame:
    """Path, member, text, error of binary files (path, content).

    Plain texts are decoded; a .zip gives a row for each readable member; other extensions need an
    extractor of their own. A failure gives an empty text and its error.
    """
    own = {e: decode for e in plain} | (extractors or {})

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io
        import os
        import zipfile

        for batch in batches:
            out = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                ext = os.path.splitext(path.lower())[1]
                try:
                    if ext == ".zip":
                        with zipfile.ZipFile(io.BytesIO(content)) as z:
                            found = [(path, m, own[e](z.read(m)), None) for m in sorted(z.namelist()) if (e := os.path.splitext(m.lower())[1]) in own]
                        out += found or [(path, None, "", "no readable member")]
                    elif ext in own:
                        out.append((path, None, own[ext](content), None))
                    else:
                        out.append((path, None, "", f"unsupported: {ext}"))
                except Exception as e:  # noqa: BLE001  (a bad file becomes a row)
                    out.append((path, None, "", f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["path", "member", "text", "error"])

    return files.select("path", "content").mapInPandas(read, "path string, member string, text string, error string")


def join_members(rows: DataFrame) -> DataFrame:
    """One text for each archive, members labelled and in order."""
    label = F.when(F.col("member").isNotNull(), F.concat(F.lit("[file: "), "member", F.lit("]\n"), "text")).otherwise(F.col("text"))
    return rows.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("member", F.lit("")).alias("m"), label.alias("t")))), lambda r: r["t"]), "\n\n").alias("text"), F.max("error").alias("error"))


def embed(chunks: DataFrame, embedder: Callable[[list[str]], list[list[float]]], batch: int = BATCH, chars: int = BATCH_CHARS) -> DataFrame:
    """Chunks with embedding, or error, batch_no and a preview.

    Batches hold at most ``batch`` items and ``chars`` characters. A batch that fails, or for which as many vectors
    as texts don't come back, is halved until single items fail; those become rows with their error, never
    exceptions.
    """

    def run(texts: list[str]) -> list[tuple[list[float] | None, str | None]]:
        try:
            found = [(list(map(float, v)), None) for v in embedder(texts)]
            if len(found) != len(texts):
                raise ValueError(f"{len(found)} vectors for {len(texts)} texts")
            return found
        except Exception as e:  # noqa: BLE001
            if len(texts) == 1:
                return [(None, f"{type(e).__name__}: {e}")]
            half = len(texts) // 2
            return run(texts[:half]) + run(texts[half:])

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = 0
        for rows in batches:
            found: list = []
            held: list[str] = []
            numbers: list[int] = []
            size = 0
            for t in [*rows["chunk_text"].fillna(""), None]:
                if held and (t is None or len(held) >= batch or size + len(t) > chars):
                    found += run(held)
                    numbers += [number] * len(held)
                    held, size, number = [], 0, number + 1
                if t is not None:
                    held.append(t)
                    size += len(t)
            yield rows.assign(embedding=[f[0] for f in found], error=[f[1] for f in found], batch_no=numbers, preview=[t[:500] for t in rows["chunk_text"].fillna("")])

    schema = ", ".join(f"`{n}` {t}" for n, t in chunks.dtypes) + ", embedding array<double>, error string, batch_no int, preview string"
    return chunks.mapInPandas(each, schema)


def chunk_id(path: F.Column, index: F.Column) -> F.Column:
    return F.sha2(F.concat_ws("\x1f", path, index.cast("string")), 256)


def write_package(chunks: DataFrame, folder: str, name: str, created_at: str, excluded: DataFrame | None = None, failures: DataFrame | None = None) -> None:
    """Chunks, source_map, manifest and, if given, excluded and failures, each a Parquet table."""
    rows = chunks.withColumn("chunk_id", chunk_id(F.col("source_path"), F.col("chunk_index")))
    rows.select("chunk_id", "source_path", "chunk_text", "embedding").write.parquet(f"{folder}/chunks")
    rows.drop("chunk_text", "embedding").write.parquet(f"{folder}/source_map")
    manifest = rows.agg(F.lit(name).alias("package_name"), F.lit(created_at).cast("timestamp").alias("created_at"), F.count(F.lit(1)).alias("chunk_count"), F.countDistinct(F.nullif("source_path", F.lit(""))).alias("document_count"))
    manifest.write.parquet(f"{folder}/manifest")
    for table, part in (("excluded", excluded), ("failures", failures)):
        if part is not None:
            part.write.parquet(f"{folder}/{table}")


def read_packages(spark: SparkSession, folders: Sequence[str]) -> tuple[DataFrame | None, list[str]]:
    """Chunks of all readable packages with their metadata and the package's order and date;
    and the folders that lack a table."""
    parts, bad = [], []
    for number, folder in enumerate(folders):
        try:
            chunks, sources, manifest = (spark.read.parquet(f"{folder}/{t}") for t in ("chunks", "source_map", "manifest"))
        except AnalysisException:
            bad.append(folder)
            continue
        about = manifest.select("package_name", F.col("created_at").alias("package_created_at"))
        parts.append(chunks.join(sources.drop("source_path"), "chunk_id", "left").crossJoin(F.broadcast(about)).withColumn("package_index", F.lit(number)))  # one row
    out = None
    for part in parts:
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out, bad


def union_sources(parts: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """G1: chunks of several kinds (files, memos, mails, attachments, chats) in that order."""
    out = None
    for ord_, (kind, part) in enumerate(parts):
        own = part.withColumn("source_kind", F.lit(kind)).withColumn("ord", F.lit(ord_))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out


def pending(files: DataFrame, done: DataFrame, signature: str) -> DataFrame:
    """Files that no finished run under the same option signature has handled, by the
    fingerprint of path, size and time."""
    own = files.withColumn("print", text.fingerprint(F.col("path"), F.col("size_bytes"), F.col("modified_at")))
    return own.join(done.filter(F.col("signature") == signature).select("print"), "print", "left_anti")


def set_identity(rows: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Keys, size and identity of each set of rows, whatever their order: two sums of 60 bits each of the rows'
    fingerprints beside their number. Sums are combined before the shuffle, so a set of any size is one row a task.
    Null fields count as empty, repeated rows count each."""
    mark = text.fingerprint(*[F.col(c) for c in fields])
    part = lambda at: F.sum(F.conv(F.substring(mark, at, 15), 16, 10).cast("decimal(20,0)")).cast("string")
    out = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("size"), part(1).alias("__a"), part(16).alias("__b"))
    return out.select(*keys, "size", F.concat_ws("-", "size", "__a", "__b").alias("identity"))


def valid_entries(asked: DataFrame, cache: DataFrame, key: str, wanted: Sequence[str]) -> DataFrame:
    """The rows of ``asked`` (key, hash) whose entry in ``cache`` (key, hash, values: a map) is valid: its hash is
    equal and it has a value, not null, for each name ``wanted``. A null key or hash has no valid entry."""
    held = cache.filter(F.forall(F.array(*map(F.lit, wanted)), lambda k: F.element_at("values", k).isNotNull()) if wanted else F.lit(True))
    return asked.join(held.select(key, "hash", "values"), [key, "hash"])


def option_signature(options: dict) -> str:
    """Hash of options in a fixed order."""
    import hashlib
    import json

    return hashlib.sha256(json.dumps(options, sort_keys=True, ensure_ascii=False).encode()).hexdigest()


def write_report(tables: dict[str, DataFrame], folder: str) -> None:
    """Each section of a report as JSON lines."""
    for name, table in tables.items():
        table.write.mode("overwrite").json(f"{folder}/{name}")
