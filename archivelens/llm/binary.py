"""Token ids as compressed binary files (operator 5).

Ids are written with a canonical, length-limited Huffman code built from counts over all documents.
A file is a run of blocks; a block holds consecutive documents, can be decoded alone, and keeps a
bit offset every ``EVERY`` ids. All runs between two such checkpoints are decoded side by side, one
table lookup for each id, so decoding is vectorised over runs.

Stored form (Parquet in a folder, one row a block): file_no, block_no, before (ids of earlier blocks
in the file), doc_ids, counts, bits (offsets of the checkpoints, unsigned 32-bit), payload. The code
lengths, one byte an id, determine the canonical code and are stored beside them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from archivelens.functions import scratch
from archivelens.llm import tokens

#: Longest code, ids between checkpoints, ids in a block (a longer document has a block alone).
LIMIT, EVERY, BLOCK = 20, 512, 1 << 20
VOCABULARY, END = 49_408, 2
BLOCKS = "file_no int, block_no int, before long, n_ids long, doc_ids array<long>, counts array<long>, bits binary, payload binary"


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths of the optimal prefix code with none above ``limit``, by package-merge; 0: no code."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids don't fit codes of {limit} bits")
    used = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[used].astype(np.float64)
    levels, packages = [], np.zeros(0)
    for _ in range(limit):
        both = np.concatenate([leaves, packages])
        order = np.argsort(both, kind="stable")
        levels.append(order < len(leaves))
        merged = both[order]
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(1)
    take = 2 * len(used) - 2
    for leaf in reversed(levels):
        chosen = int(leaf[:take].sum())
        lengths[used[:chosen]] += 1
        take = 2 * (take - chosen)
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The canonical codes: shorter first, equal lengths in order of id."""
    order = np.lexsort([np.arange(len(lengths)), lengths])
    order = order[lengths[order] > 0]
    own = lengths[order].astype(np.int64)
    room = np.int64(1) << (LIMIT - own)  # codes of the longest length that each takes up
    codes = np.zeros(len(lengths), np.uint64)
    codes[order] = ((np.cumsum(room) - room) >> (LIMIT - own)).astype(np.uint64)
    return codes


def lookup(lengths: np.ndarray) -> np.ndarray:
    """For each possible next ``LIMIT`` bits: id * 32 + length of its code."""
    order = np.lexsort([np.arange(len(lengths)), lengths])
    order = order[lengths[order] > 0]
    own = lengths[order].astype(np.int64)
    table = np.zeros(1 << LIMIT, np.uint32)
    filled = np.repeat((order * 32 + own).astype(np.uint32), 1 << (LIMIT - own))
    table[: len(filled)] = filled
    return table


def encode(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bits of ``ids``, most significant first, and the bit offset of every ``EVERY``-th id."""
    own = lengths[ids].astype(np.int64)
    ends = np.cumsum(own)
    begins = ends - own
    word, shift = begins >> 6, 64 - (begins & 63) - own
    value = codes[ids]
    words = np.zeros((int(ends[-1]) >> 6) + 2 if len(ids) else 1, np.uint64)
    over = np.flatnonzero(shift < 0)  # these reach into the next word
    left = np.where(shift >= 0, value << np.maximum(shift, 0).astype(np.uint64), value >> np.maximum(-shift, 0).astype(np.uint64))
    first = np.flatnonzero(np.diff(word, prepend=-1))
    if len(ids):
        words[word[first]] = np.add.reduceat(left, first)
        words[word[over] + 1] += value[over] << (64 + shift[over]).astype(np.uint64)
    payload = words.astype(">u8").tobytes()[: (int(ends[-1]) + 7) // 8 if len(ids) else 0]
    return payload, begins[::EVERY].astype("<u4")


def decode(payload: bytes, bits: np.ndarray, count: int, table: np.ndarray) -> np.ndarray:
    """``count`` ids from a block's payload; all runs between checkpoints advance together."""
    padded = np.frombuffer(payload + b"\0" * 16, np.uint8)
    # big-endian 32-bit windows at every byte: LIMIT bits after any bit offset lie inside one
    window = padded[:-3].astype(np.uint32)
    for k in (1, 2, 3):
        window <<= np.uint32(8)
        window |= padded[k : len(padded) - 3 + k]
    at = bits.astype(np.int64)
    out = np.zeros((EVERY, len(at)), np.uint32)
    last = count - EVERY * (len(at) - 1)
    for step in range(EVERY):
        if step == last:
            at = at[:-1]
        if not len(at):
            break
        entry = table[(window[at >> 3] << (at & 7).astype(np.uint32)) >> np.uint32(32 - LIMIT)]
        out[step, : len(at)] = entry >> np.uint32(5)
        at = at + (entry & np.uint32(31))
    return out.T.reshape(-1)[:count]


def count_ids(ids: DataFrame, vocabulary: int) -> np.ndarray:
    """How often each id occurs in all documents, out of the tasks' own counts (column ``tally``, the
    only one read); at most ``vocabulary`` rows reach the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            for x in batch.column("tally"):
                total += np.frombuffer(x.as_buffer(), np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["id", "n"])

    counts = np.zeros(vocabulary, np.int64)
    for row in ids.select("tally").filter("tally is not null").mapInArrow(add, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[row["id"]] = row["n"]
    return counts


def write(docs: DataFrame, folder: str, path: str, end_id: int = END, vocabulary: int = VOCABULARY, partitions: int | None = None) -> None:
    """Tokenise all documents (doc_id, text) and write their ids, ascending by doc_id, to ``folder``.

    Null texts give the end id alone; null doc_ids come first; rows with one doc_id follow each
    other by checksum and ids; extra columns are ignored; an empty table gives no blocks.
    """
    spark = docs.sparkSession
    ids = scratch.stored(tokens.tokenize(docs, path, spaced=False, end_id=end_id, tally=vocabulary), "ids")
    lengths = code_lengths(count_ids(ids, vocabulary))
    spark.createDataFrame([(bytearray(lengths.tobytes()),)], "lengths binary").coalesce(1).write.parquet(f"{folder}/code")
    sent = spark.sparkContext.broadcast(lengths)  # a byte for each id of the vocabulary

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own = sent.value
        codes = canonical(own)
        file_no, block_no, before = TaskContext.get().partitionId(), 0, 0
        doc_ids: list = []
        held: list = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal block_no, before, size
            flat = np.concatenate(held)
            payload, bits = encode(flat, own, codes)
            row = {"file_no": [file_no], "block_no": [block_no], "before": [before], "n_ids": [len(flat)], "doc_ids": [list(doc_ids)], "counts": [[len(x) for x in held]], "bits": [bits.tobytes()], "payload": [payload]}
            block_no, before, size = block_no + 1, before + len(flat), 0
            doc_ids.clear()
            held.clear()
            return pa.RecordBatch.from_pydict(row, schema=pa.schema([("file_no", pa.int32()), ("block_no", pa.int32()), ("before", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("bits", pa.binary()), ("payload", pa.binary())]))

        for batch in batches:
            for doc_id, x in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                one = np.frombuffer(x.as_buffer(), "<u2").astype(np.int64)
                if held and size + len(one) > BLOCK:
                    yield flush()
                doc_ids.append(doc_id)
                held.append(one)
                size += len(one)
        if held:
            yield flush()

    n = partitions or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = ids.filter("n_tokens is not null").select("doc_id", "ids").withColumn("sum", F.crc32("ids")).repartitionByRange(n, F.col("doc_id").asc_nulls_first(), "sum").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "sum", "ids")
    ordered.select("doc_id", "ids").mapInArrow(blocks, BLOCKS).write.option("compression", "none").parquet(f"{folder}/blocks")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, ids (bytes of
    little-endian unsigned 32-bit integers), decoded from the files in ``folder``.

    One row for each document written, so null and repeated doc_ids come back as they went; a folder
    without blocks gives no rows.
    """
    blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")
    lengths = np.frombuffer(spark.read.parquet(f"{folder}/code").head()["lengths"], np.uint8)
    sent = spark.sparkContext.broadcast(lengths)
    files = blocks.groupBy("file_no").agg(F.sum("n_ids").alias("total"))  # a row for each file
    files = files.select("file_no", (F.sum("total").over(Window.orderBy("file_no")) - F.col("total")).alias("file_start"))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None
        for batch in batches:
            table = lookup(sent.value) if table is None else table
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                file_start, before, n_ids, payload, bits = (row.column(c)[0].as_py() for c in ("file_start", "before", "n_ids", "payload", "bits"))
                flat = decode(payload, np.frombuffer(bits, "<u4"), n_ids, table).astype("<u4")
                counts = row.column("counts").flatten().to_numpy()
                ends = np.cumsum(counts)
                sums = [zlib.crc32(flat[a:b]) for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([row.column("doc_ids").flatten(), pa.array(file_start + before + ends - counts), pa.array(counts), pa.array(sums, pa.int64()), tokens.binary_column(flat, counts)], ["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    placed = blocks.join(files, "file_no").select("file_start", "before", "n_ids", "doc_ids", "counts", "bits", "payload")
    return placed.mapInArrow(unpack, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")
