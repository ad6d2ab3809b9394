"""Packing documents into fixed-length training sequences (operator 1).

First-fit decreasing inside randomised groups of documents: a group is small enough for one task,
and thousands of pieces to choose from leave almost no padding. Within a group a tournament tree
over the bins' free room finds the first bin that takes a piece in logarithmic time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archivelens.llm import tokens

#: Sequence length, documents in a group on average, and the id that ends a document.
LENGTH, GROUP, END = 2048, 2048, 1
SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, tokens binary"


def first_fit(sizes: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece, placed in the order given into the first bin with room.

    The tree's leaves are the bins' free room and each inner node holds the larger of its children,
    so the leftmost bin that fits is found on one path from the root.
    """
    width = 1 << max(1, int(len(sizes) - 1).bit_length())
    tree = [room] * (2 * width)
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for i, size in enumerate(sizes.tolist()):
        node = 1
        while node < width:
            node *= 2
            if tree[node] < size:
                node += 1
        bins[i], offsets[i] = node - width, room - tree[node]
        tree[node] -= size
        node //= 2
        while node:
            larger = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == larger:
                break
            tree[node] = larger
            node //= 2
    return bins, offsets


def place(counts: np.ndarray, room: int) -> tuple[np.ndarray, ...]:
    """Pieces of documents with so many ids: document, start, length, bin, offset.

    A document gives full sequences while it lasts; what is left of each is packed.
    """
    full, rest = counts // room, counts % room
    doc = np.repeat(np.arange(len(counts)), full)
    start = (np.arange(len(doc)) - np.repeat(np.cumsum(full) - full, full)) * room
    left = np.flatnonzero(rest)
    left = left[np.argsort(-rest[left], kind="stable")]
    bins, offsets = first_fit(rest[left], room)
    return (
        np.concatenate([doc, left]),
        np.concatenate([start, full[left] * room]),
        np.concatenate([np.full(len(doc), room), rest[left]]),
        np.concatenate([np.arange(len(doc)), len(doc) + bins]),
        np.concatenate([np.zeros(len(doc), np.int64), offsets]),
    )


def pack(docs: DataFrame, path: str, length: int = LENGTH, group: int = GROUP, end_id: int = END, seed: int = 7, idle: int = tokens.IDLE) -> DataFrame:
    """Pack all documents (doc_id, text) into sequences of at most ``length`` tokens.

    One row a piece: doc_id, start (ids of its document before it), length, doc_tokens (of its
    document, the end id included), sequence_id, offset (in the sequence, gapless from 0), tokens
    (its ids as bytes of little-endian unsigned 32-bit integers). Each id lies in one piece.

    Documents are dealt to groups of ``group`` on average by a hash of doc_id, ids and the row's place
    in its task with ``seed``, so no id, text or repeated row makes a group large, and a rerun over
    the same files packs alike. ``idle`` is the number of words that a worker may keep between tasks.
    A null text is empty and packs its end id; null doc_ids form rows of their own; repeated rows are
    packed each; extra columns are ignored; an empty table gives no rows.
    """
    groups = max(1, -(-docs.count() // group))
    ids = tokens.tokenize(docs, path, spaced=True, end_id=end_id, idle=idle)

    def fill(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("n_tokens", "ascending"), ("ids", "ascending")]).combine_chunks()
        counts = table.column("n_tokens").to_numpy()
        doc, start, size, place_in, offset = place(counts, length)
        flat = [np.frombuffer(x.as_buffer(), "<u2") for x in table.column("ids")]
        pieces = [flat[d][s : s + n] for d, s, n in zip(doc.tolist(), start.tolist(), size.tolist(), strict=True)]
        found = np.concatenate(pieces).astype("<u4") if pieces else np.zeros(0, "<u4")
        return pa.table({
            "doc_id": table.column("doc_id").take(pa.array(doc)), "start": start, "length": size, "doc_tokens": counts[doc],
            "sequence_id": (key[0].as_py() << 32) + place_in, "offset": offset, "tokens": tokens.binary_column(found, size),
        })

    dealt = ids.withColumn("part", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "ids", F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.groupBy("part").applyInArrow(fill, SCHEMA)
