"""Phrase collocations by Toivonen's sampling method (operator 12).

1. A sample of the documents proposes words, then phrases of two and of three words, level by level: what is
   seen ``PROPOSED`` times there and whose parts were proposed.
2. One pass over all documents counts the proposed phrases exactly, and the negative border: phrases that were
   not proposed although all their parts were. The border is large and nearly all of it rare, so it is counted
   by 64-bit hashes, packed in blocks; a hash that reaches the least frequency is a failure of the border.
3. If there are failures, a further pass counts them exactly, and with them all that they open: phrases of which
   a part failed. Openings look one level ahead (a pair that is opened counts as a part), so for phrases of three
   words one expansion closes; two hashes that are equal only send a rare phrase there too.

Sets of proposed and failed phrases go to tasks as filters of a fixed size. A filter may let others through:
they are counted as well, exactly, and fall out by their frequency.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from archivelens.functions import scratch
from archivelens.llm import words

#: Least frequency of a phrase, phrases returned of each language.
LEAST, TOP = 10, 2000
#: One of so many documents is in the sample; occurrences there that propose a phrase.
SAMPLE, PROPOSED = 8, 2
#: Bits of a filter (8 MiB), bits set for a phrase, bytes of text that a task handles at once, hashes that it
#: sums up before it packs them, and bytes of text of all documents for each part of the border.
BITS, PROBES, TEXTS, HELD, PART = 1 << 26, 2, 4 << 20, 1 << 19, 8 << 20
#: The language of documents that name none.
NO_LANG = "und"
KINDS = words.kinds(b"\x20\x09", b".,;:!?\x0a\x0b\x0c\x0d")
_U = np.uint64


class Filter:
    """A set of hashes as bits; no bits hold nothing."""

    def __init__(self, bits: np.ndarray | None = None) -> None:
        self.bits = bits

    def holds(self, hashed: np.ndarray) -> np.ndarray:
        if self.bits is None:
            return np.zeros(len(hashed), bool)
        out = np.ones(len(hashed), bool)
        for k in range(PROBES):
            place = _place(hashed, k)
            out &= (self.bits[place >> _U(3)] >> (place & _U(7)).astype(np.uint8)) & 1 == 1
        return out


def _place(hashed: np.ndarray, probe: int) -> np.ndarray:
    return words.mix(hashed + _U(probe * 0x9E37_79B9_7F4A_7C15 % (1 << 64))) % _U(BITS)


def gathered(hashes: DataFrame) -> Filter:
    """The filter of a table of hashes (hash): blocks of bits are made where the hashes are and united."""
    block = 1 << 18

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = np.zeros(BITS // 8, np.uint8), False
        for batch in batches:
            own = batch.column("hash").to_numpy(zero_copy_only=False).view(np.uint64)
            seen |= bool(len(own))
            for k in range(PROBES):
                place = _place(own, k)
                np.bitwise_or.at(bits, place >> _U(3), (_U(1) << (place & _U(7))).astype(np.uint8))
        if seen:
            parts = bits.reshape(-1, block)
            some = np.flatnonzero(parts.any(1))
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([parts[i].tobytes() for i in some], pa.binary())], ["block", "bits"])

    def unite(key: tuple, table: pa.Table) -> pa.Table:
        rows = np.frombuffer(b"".join(x.as_py() for x in table.column("bits")), np.uint8).reshape(-1, block)
        return pa.table({"block": [key[0].as_py()], "bits": [np.bitwise_or.reduce(rows).tobytes()]})

    blocks = hashes.select("hash").coalesce(32).mapInArrow(put, "block long, bits binary").groupBy("block").applyInArrow(unite, "block long, bits binary")
    bits, any_row = np.zeros((BITS // 8 // block, block), np.uint8), False
    for row in blocks.collect():  # BITS bits in all
        bits[row["block"]], any_row = np.frombuffer(row["bits"], np.uint8), True
    return Filter(bits.ravel() if any_row else None)


class _Grams:
    """Distinct words, pairs and triples of a slice of texts, with hashes, counts and their texts."""

    def __init__(self, texts: pa.Array, langs: pa.Array) -> None:
        own = words.split(texts, KINDS)
        langs = pc.fill_null(langs.cast(pa.large_string()), NO_LANG).dictionary_encode()
        lang = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.langs, self.totals = langs.dictionary, np.bincount(lang, own.counts, len(langs.dictionary)).astype(np.int64)
        n = max(1, len(own.distinct))
        both, self.code = np.unique(lang[own.row] * n + own.code, return_inverse=True)
        self.word_lang, self.names = both // n, own.distinct.take(pa.array(both % n))
        self.counts = np.bincount(self.code, minlength=len(both))
        tongue = words.mix(words.hashes(self.langs) + _U(1))
        self.word_hash = words.mix(words.hashes(own.distinct)[both % n] ^ tongue[self.word_lang])
        self.at = np.flatnonzero(own.piece[1:] == own.piece[:-1])  # places of a word that another follows
        self.langs = self.langs.cast(pa.large_binary())

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First and second word, count and hash of distinct pairs, and the pair at each of ``at``."""
        n = max(1, len(self.word_hash))
        key, place, counts = np.unique(self.code[self.at] * n + self.code[self.at + 1], return_inverse=True, return_counts=True)
        one, two = key // n, key % n
        return one, two, counts, words.mix(self.word_hash[one] * _U(3) + words.mix(self.word_hash[two] + _U(2))), place

    def triples(self, place: np.ndarray, ok: np.ndarray, pair_hash: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First pair, second pair, count and hash of distinct triples of which both pairs are ``ok``."""
        good = ok[place]
        follow = np.flatnonzero((self.at[1:] == self.at[:-1] + 1) & good[1:] & good[:-1])
        n = max(1, len(pair_hash))
        key, counts = np.unique(place[follow] * n + place[follow + 1], return_counts=True)
        one, two = key // n, key % n
        return one, two, counts, words.mix(pair_hash[one] * _U(5) + words.mix(self.word_hash[second[two]] + _U(7)))

    def rows(self, level: int, lang: np.ndarray, counts: np.ndarray, *parts: np.ndarray) -> pa.RecordBatch:
        named = [self.names.take(pa.array(p)) for p in parts]
        phrase = pc.binary_join_element_wise(*named, pa.scalar(b" ", pa.large_binary())) if len(named) > 1 else named[0]
        return _row_batch(self.langs.take(pa.array(lang)), phrase, level, counts)


def _row_batch(lang: pa.Array, phrase: pa.Array, level: int, counts: np.ndarray) -> pa.RecordBatch:
    n = len(counts)
    columns = [lang.cast(pa.string()), phrase.cast(pa.string()), pa.array(np.full(n, level, np.int32)), pa.array(counts.astype(np.int64)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["lang", "phrase", "words", "n", "part", "hashes", "counts"])


def _short(counts: np.ndarray) -> np.ndarray:
    """Counts of 32 bits; one beyond that stays the largest, which is frequent in any case."""
    return np.minimum(counts, 0xFFFF_FFFF).astype(np.uint32)


def _summed(hashed: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes in order, one at least, and the sums of their counts."""
    order = np.argsort(hashed)
    hashed = hashed[order]
    first = np.flatnonzero(np.concatenate([[True], hashed[1:] != hashed[:-1]]))
    return hashed[first], np.add.reduceat(counts[order], first, dtype=np.int64)


def _blocks(held: list[tuple[np.ndarray, np.ndarray]], parts: int) -> pa.RecordBatch:
    """Hashes and their counts, summed and packed for each part that they belong to: a range of hashes. Empties ``held``."""
    hashed, counts = (np.concatenate(x) for x in zip(*held, strict=True))
    held.clear()
    hashed, counts = _summed(hashed, counts)
    counts = _short(counts)
    part = (hashed >> _U(32)) * _U(parts) >> _U(32)
    begins = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    ends = np.append(begins, len(part))[1:]
    n = len(begins)
    packed = [[x[a:b].tobytes() for a, b in zip(begins, ends, strict=True)] for x in (hashed, counts)]
    columns = [pa.nulls(n, pa.string()), pa.nulls(n, pa.string()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.array(part[begins].astype(np.int32)), pa.array(packed[0], pa.binary()), pa.array(packed[1], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["lang", "phrase", "words", "n", "part", "hashes", "counts"])


_ROW = "lang string, phrase string, words int, n long, part int, hashes binary, counts binary"


def _pieces(texts: pa.Array) -> Iterator[pa.Array]:
    """A text of more than ``TEXTS`` bytes in parts cut behind marks, where no phrase passes."""
    if len(texts) != 1 or not texts[0].is_valid or pc.binary_length(texts)[0].as_py() <= TEXTS:
        yield texts
        return
    whole = texts.cast(pa.large_binary())[0].as_buffer()
    data, start = np.frombuffer(whole, np.uint8), 0
    while start < len(data):
        stop = min(start + TEXTS, len(data))
        marks = np.flatnonzero(KINDS[data[start:stop]] == 2)
        if stop < len(data) and len(marks):
            stop = start + int(marks[-1]) + 1
        elif stop < len(data):  # none in reach: the next one
            more = np.flatnonzero(KINDS[data[stop:]] == 2)
            stop = stop + int(more[0]) + 1 if len(more) else len(data)
        yield pa.array([data[start:stop].tobytes()], pa.large_binary())
        start = stop


def _passed(docs: DataFrame, each: object, parts: int) -> DataFrame:
    """The rows that ``each(grams)`` gives of all slices of texts; hashes of several slices are packed together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for part in words.bounded(batch, "text", TEXTS):
                for texts in _pieces(part.column("text")):
                    for found in each(_Grams(texts, part.column("lang"))):
                        if isinstance(found, pa.RecordBatch):
                            yield found
                        elif len(found[0]):
                            held.append((found[0], _short(found[1])))
                    if sum(len(hashed) for hashed, _ in held) >= HELD:
                        yield _blocks(held, parts)
        if held:
            yield _blocks(held, parts)
        words.settle()

    return docs.mapInArrow(run, _ROW)


def _frequent(rows: DataFrame, least: int) -> DataFrame:
    """hash: those whose packed counts sum to ``least`` or more. A part holds a bounded share of the texts."""

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        hashed = np.frombuffer(b"".join(x.as_buffer() for c in table.column("hashes").chunks for x in c), np.uint64)
        counts = np.frombuffer(b"".join(x.as_buffer() for c in table.column("counts").chunks for x in c), np.uint32)
        hashed, total = _summed(hashed, counts)
        return pa.table({"hash": hashed[total >= least].view(np.int64)})

    return rows.filter("part is not null").select("part", "hashes", "counts").groupBy("part").applyInArrow(merge, "hash long")


def counted(docs: DataFrame, least: int = LEAST, sample: int = SAMPLE, proposed: int = PROPOSED) -> DataFrame:
    """lang, phrase, words, n: all words and phrases of two and three words that occur ``least`` times or more in
    ``docs`` (text, lang), and one row of no words for each lang, with the number of all its words.

    A null text has no words, a null lang is ``NO_LANG``; A-Z count as a-z; phrases lie within pieces between
    marks; repeated rows count each; other columns are left out; an empty table gives no rows.
    """
    rows = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).head()["n"]
    parts = max(8, -(-size // PART))
    some = rows.filter(F.pmod(F.xxhash64(F.lit(11), "text", "lang"), F.lit(sample)) == 0)

    def low(g: _Grams) -> Iterator[tuple]:
        yield g.word_hash, g.counts
        _, _, counts, hashed, _ = g.pairs()
        yield hashed, counts

    seen = scratch.stored(_frequent(_passed(some, low, parts), proposed), "proposed")
    first = gathered(seen)

    def high(g: _Grams) -> Iterator[tuple]:
        _, two, _, hashed, place = g.pairs()
        _, _, counts, triple = g.triples(place, first.holds(hashed), hashed, two)
        yield triple, counts

    known = gathered(seen.unionByName(scratch.stored(_frequent(_passed(some, high, parts), proposed), "proposed")))

    def full(g: _Grams) -> Iterator:
        """Proposed phrases by their texts, the negative border by hashes."""
        yield _row_batch(g.langs, pa.array([b""] * len(g.langs), pa.large_binary()), 0, g.totals)
        own = known.holds(g.word_hash)
        yield g.rows(1, g.word_lang[own], g.counts[own], np.flatnonzero(own))
        yield g.word_hash[~own], g.counts[~own]
        one, two, counts, hashed, place = g.pairs()
        pair = known.holds(hashed)
        yield g.rows(2, g.word_lang[one[pair]], counts[pair], one[pair], two[pair])
        border = own[one] & own[two] & ~pair
        yield hashed[border], counts[border]
        left, right, counts, hashed = g.triples(place, pair, hashed, two)
        triple = known.holds(hashed)
        yield g.rows(3, g.word_lang[one[left[triple]]], counts[triple], one[left[triple]], two[left[triple]], two[right[triple]])
        yield hashed[~triple], counts[~triple]

    passed = scratch.stored(_passed(rows, full, parts), "counts")
    failures = scratch.stored(_frequent(passed, least), "failures")
    exact = passed.filter("words is not null")
    if failures.head(1):
        failed = gathered(failures)

        def expand(g: _Grams) -> Iterator:
            """Failed phrases, and those with a part that failed or is opened, by their texts."""
            own, late = known.holds(g.word_hash), failed.holds(g.word_hash)
            late &= ~own
            yield g.rows(1, g.word_lang[late], g.counts[late], np.flatnonzero(late))
            one, two, counts, hashed, place = g.pairs()
            pair = known.holds(hashed)
            opened = (own | late)[one] & (own | late)[two] & ~(own[one] & own[two])
            more = (opened | (own[one] & own[two] & failed.holds(hashed))) & ~pair
            yield g.rows(2, g.word_lang[one[more]], counts[more], one[more], two[more])
            left, right, counts, hashed = g.triples(place, pair | more, hashed, two)
            bordered = pair[left] & pair[right]
            late = np.where(bordered, failed.holds(hashed) & ~known.holds(hashed), True)
            yield g.rows(3, g.word_lang[one[left[late]]], counts[late], one[left[late]], two[left[late]], two[right[late]])

        exact = exact.unionByName(_passed(rows, expand, parts))
    total = exact.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n"))
    return total.filter((F.col("n") >= least) | (F.col("words") == 0))


def scored(counts: DataFrame, least_share: int = 50) -> DataFrame:
    """lang, phrase, a, l, r, n, score of the phrases among ``counts`` (see ``counted``) that no longer one with at
    least ``least_share`` percent of their occurrences holds. The lowest-scoring cut counts, the earlier of equals."""
    whole = counts.filter("words = 0").select("lang", F.col("n").alias("total"))
    parts = counts.filter("words in (1, 2)").select("lang", F.col("phrase").alias("part"), F.col("n").alias("part_n"))
    split = F.split("phrase", " ")
    pairs = counts.filter("words = 2").withColumn("w", split)
    triples = counts.filter("words = 3").withColumn("w", split)
    inside = triples.select("lang", "n", F.explode(F.array_distinct(F.array(F.array_join(F.slice("w", 1, 2), " "), F.array_join(F.slice("w", 2, 2), " ")))).alias("phrase"))
    inside = inside.groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    kept = pairs.join(inside, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("n") * least_share)).drop("longer")

    def cut(rows: DataFrame, k: int, size: int) -> DataFrame:
        left, right = F.array_join(F.slice("w", 1, k), " "), F.array_join(F.slice("w", k + 1, size - k), " ")
        rows = rows.select("lang", "phrase", F.col("n").alias("a"), left.alias("left"), right.alias("right"), F.lit(k).alias("k"))
        by = lambda side, n: parts.select("lang", F.col("part").alias(side), F.col("part_n").alias(n))
        return rows.join(by("left", "l"), ["lang", "left"]).join(by("right", "r"), ["lang", "right"]).drop("left", "right")

    cuts = cut(triples, 1, 3).unionByName(cut(triples, 2, 3)).unionByName(cut(kept, 1, 2))
    wide: Column = F.col("a").cast("decimal(19,0)")
    score = (F.lit(1_000_000).cast("decimal(7,0)") * wide * wide).cast("decimal(38,0)")
    cuts = cuts.withColumn("score", F.call_function("div", score, (F.col("l").cast("decimal(19,0)") * F.col("r").cast("decimal(19,0)")).cast("decimal(38,0)")).cast("long"))
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    return best.join(whole, "lang").select("lang", "phrase", "a", "b.l", "b.r", F.col("total").alias("n"), "b.score")


def collocations(docs: DataFrame, most: int = TOP, least: int = LEAST, **options: int) -> DataFrame:
    """lang, rank (from 1), phrase, a, l, r, n, score: each lang's first ``most`` phrases of two and three words by
    score, then frequency (both descending), then phrase (see ``counted`` and ``scored``)."""
    rows = scored(scratch.stored(counted(docs, least, **options), "phrases"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
