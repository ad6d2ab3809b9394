"""Cutting texts into chunks. A text is cut by a small function inside the task that holds it."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

#: Characters of a chunk and of the overlap with the chunk before.
SIZE, OVERLAP = 700, 100
#: Bytes of texts that a task cuts at once, one text at least (this has no influence on results).
TEXTS = 1 << 20


def cut_paragraphs(text: str, size: int = SIZE, overlap: int = OVERLAP, break_at: str = "\n\n") -> list[str]:
    """Paragraphs packed into chunks of ``size``; a longer one is sliced at steps that overlap.

    Each chunk but the first starts with the end of the one before (all of it if it is short), so it
    may exceed the size.
    """
    pieces: list[str] = []
    for paragraph in (p.strip() for p in text.split(break_at)):
        if not paragraph:
            continue
        if len(paragraph) <= size:
            pieces.append(paragraph)
        else:
            pieces += [paragraph[at : at + size] for at in range(0, len(paragraph), size - overlap)]
    plain: list[str] = []
    held = ""
    for piece in pieces:
        if held and len(held) + 2 + len(piece) > size:
            plain.append(held)
            held = piece
        else:
            held = f"{held}\n\n{piece}" if held else piece
    if held:
        plain.append(held)
    return [c if not i else f"{plain[i - 1][-overlap:]}\n\n{c}" for i, c in enumerate(plain)]


def cut_rows(text: str, size: int = SIZE) -> list[str]:
    """Lines of a sheet packed into chunks that each repeat its first line; a line is only split
    if it is too long alone."""
    lines = [line for line in text.split("\n") if line.strip()]
    if not lines:
        return []
    head, rows = lines[0], lines[1:]
    if not rows:
        return [head[i : i + size] for i in range(0, len(head), size)]
    out: list[str] = []
    held: list[str] = []
    room = max(1, size - len(head) - 1)
    for row in rows:
        for part in [row[i : i + room] for i in range(0, len(row), room)]:
            if held and len(head) + 1 + sum(map(len, held)) + len(held) + len(part) > size:
                out.append("\n".join([head, *held]))
                held = []
            held.append(part)
    return [*out, "\n".join([head, *held])] if held else out


class RowPacker:
    """H14 a line at a time: ``add`` gives the chunk that a line completes, ``rest`` what is left, so that a sheet of
    any length needs the room of one chunk."""

    def __init__(self, size: int = SIZE) -> None:
        self.size, self.head, self.held, self.used, self.any = size, None, [], 0, False

    def add(self, line: str | None) -> list[str]:
        if not line or not line.strip():
            return []
        if self.head is None:
            self.head = line
            return []
        self.any, out = True, []
        room = max(1, self.size - len(self.head) - 1)
        for part in (line[i : i + room] for i in range(0, len(line), room)):
            if self.held and len(self.head) + 1 + self.used + len(self.held) + len(part) > self.size:
                out.append("\n".join([self.head, *self.held]))
                self.held, self.used = [], 0
            self.held.append(part)
            self.used += len(part)
        return out

    def rest(self) -> list[str]:
        if self.held:
            return ["\n".join([self.head, *self.held])]
        return [self.head[i : i + self.size] for i in range(0, len(self.head), self.size)] if self.head and not self.any else []


class ParagraphChunks:
    """I4, H13 as a table function of a text: chunk_index, chunk_text."""

    def eval(self, text: str | None) -> Iterator[tuple[int, str]]:
        if text:
            yield from enumerate(cut_paragraphs(text))


class LineChunks:
    """H13 for texts whose paragraphs end with their lines."""

    def eval(self, text: str | None) -> Iterator[tuple[int, str]]:
        if text:
            yield from enumerate(cut_paragraphs(text, break_at="\n"))


class SheetChunks:
    """I4, H14 as a table function of a table (sheet, line) that is partitioned by sheet and ordered by row: sheet,
    chunk_index, chunk_text. The first line is the sheet's header. Blank and null lines are left out."""

    def __init__(self) -> None:
        self.packer, self.sheet, self.n = RowPacker(), None, 0

    def _numbered(self, chunks: list[str]) -> Iterator[tuple[str, int, str]]:
        for text in chunks:
            yield self.sheet, self.n, text
            self.n += 1

    def eval(self, row: Row) -> Iterator[tuple[str, int, str]]:
        self.sheet = row["sheet"]
        yield from self._numbered(self.packer.add(row["line"]))

    def terminate(self) -> Iterator[tuple[str, int, str]]:
        yield from self._numbered(self.packer.rest())


def register(spark: SparkSession) -> None:
    """``paragraph_chunks(text)``, ``line_chunks(text)`` and ``sheet_chunks(TABLE(...) PARTITION BY sheet ORDER BY ...)``
    for SQL; the first two go beside a table by a lateral join."""
    spark.udtf.register("paragraph_chunks", F.udtf(ParagraphChunks, returnType="chunk_index int, chunk_text string"))
    spark.udtf.register("line_chunks", F.udtf(LineChunks, returnType="chunk_index int, chunk_text string"))
    spark.udtf.register("sheet_chunks", F.udtf(SheetChunks, returnType="sheet string, chunk_index int, chunk_text string"))


def chunk(docs: DataFrame, cut: Callable[[str], list[str]] = cut_paragraphs, key: str = "doc_id") -> DataFrame:
    """I4: key, chunk_index, chunk_text of each text; null and blank texts have no chunks."""
    kind = dict(docs.dtypes)[key]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in in_parts(batches):
            yield _cut(part, cut)
        pa.default_memory_pool().release_unused()  # a worker waits idle beside other stages

    return docs.select(F.col(key).alias("key"), "text").mapInArrow(each, f"key {kind}, chunk_index int, chunk_text string").withColumnRenamed("key", key)


def in_parts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches (text, any others) cut where their texts pass a multiple of ``TEXTS``."""
    for rows in batches:
        sizes = pc.fill_null(pc.binary_length(rows.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // TEXTS, prepend=0)) + 1
        start = 0
        for stop in [*cuts.tolist(), rows.num_rows]:
            if stop > start:
                yield rows.slice(start, stop - start)
                start = stop


def _cut(rows: pa.RecordBatch, cut: Callable[[str], list[str]]) -> pa.RecordBatch:
    at, number, chunks = [], [], []
    for n, text in enumerate(rows.column("text")):
        own = cut(t) if (t := text.as_py()) else []
        at += [n] * len(own)
        number += range(len(own))
        chunks += own
    return pa.record_batch([rows.column("key").take(pa.array(at, pa.int32())), pa.array(number, pa.int32()), pa.array(chunks, pa.string())], ["key", "chunk_index", "chunk_text"])
