"""Sharding, phrases and lexical search against plain Python."""

import math
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from archivelens.functions import scratch
from archivelens.llm import lexical, phrases, queries, sharding, words
from tests.llm.fixtures import documents, no_documents


def laws(rows, shards, texts):
    """Every row once, counts at most one apart, slots without gaps."""
    assert sorted(map(repr, ((r["doc_id"], r["text"]) for r in rows))) == sorted(map(repr, texts))
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        assert r["size"] == len((r["text"] or "").encode()) + 16
    counts = [len(slots[k]) for k in range(shards)]
    assert set(slots) <= set(range(shards)) and max(counts) - min(counts) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shuffle_keeps_all_rows_evenly(spark):
    docs = documents(spark)
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    for shards, rows in ((40, 1024), (7, 4), (1, 1), (3, 2)):
        folder = scratch.new_path(spark, "shards")
        got = sharding.write(docs, folder, shards=shards, bucket_rows=rows)
        laws(got.collect(), shards, texts)
        assert {"doc_id", "text", "lang", "source", "target", "n"} <= set(got.columns)
        again = sharding.shuffled(docs.repartition(5, "n_chars"), shards=shards, bucket_rows=rows)
        assert sorted(map(str, again.select("shard", "slot", "doc_id", "text").collect())) == sorted(map(str, got.select("shard", "slot", "doc_id", "text").collect()))
    assert sharding.write(no_documents(spark), scratch.new_path(spark, "shards")).count() == 0


def test_shuffle_spreads_equal_rows(spark):
    """A third of all rows are one row; no bucket holds many of them, and nothing is lost."""
    docs = spark.range(600).select(F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")).alias("text"), F.create_map(F.lit("k"), F.lit(1)).alias("kind"))
    rows = sharding.shuffled(docs, shards=8, bucket_rows=32)
    laws(rows.select("doc_id", "text", "shard", "slot", "size").collect(), 8, [(r["doc_id"], r["text"]) for r in docs.collect()])
    keys = docs.groupBy(F.col("doc_id").cast("string").alias("id"), F.xxhash64("text").alias("hash")).agg(F.count(F.lit(1)).alias("copies"))
    sizes = sharding.plan(keys, 19, 5, 8).select(F.size("places").alias("n"), F.col("rows"), "first").orderBy("first").collect()
    assert max(r["n"] for r in sizes) < 80 and sum(r["n"] for r in sizes) == 600
    assert [r["first"] for r in sizes] == [sum(x["n"] for x in sizes[:i]) for i in range(len(sizes))]


def test_places_are_permutations_of_all_orders(spark):
    """Of three places all six orders come about as often; another seed gives another shuffle."""
    keys = spark.range(30_000).select(F.col("id").cast("string").alias("id"), F.lit(0).cast("long").alias("hash"), F.lit(1).cast("long").alias("copies"))
    planned = sharding.plan(keys, 10_000, 1, 10).collect()
    assert all(sorted(r["places"]) == list(range(r["rows"])) for r in planned)
    orders = Counter(tuple(r["places"]) for r in planned if r["rows"] == 3)
    n = sum(orders.values())
    assert len(orders) == 6 and sum((c - n / 6) ** 2 / (n / 6) for c in orders.values()) < 25
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    one, two = ({r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.shuffled(docs, shards=4, seed=s).collect()} for s in (1, 2))
    assert sum(one[i] == two[i] for i in one) < 20


def test_sharding_query(spark):
    got = queries.op11_external_shuffle(spark, "/root/testdata/sf0.001").collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == sorted((r["doc_id"], len(r["text"].encode()) + 16, zlib.crc32(r["text"].encode())) for r in docs)
    assert {r["law"] for r in got} == {"rows"} and {r["grown_shard"] for r in got} == {None}
    counts = Counter(r["shard"] for r in got)
    assert len(counts) == 40 and max(counts.values()) - min(counts.values()) <= 1


LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_words_equal_regular_expressions():
    random = np.random.default_rng(4)
    letters = list("abAB. ,\n\t!é世\x00-9Z[`{\x7f\x1f\U0001f600")
    texts = ["".join(random.choice(letters, n)) for n in random.integers(0, 40, 300)] + [None, "", " ", "x" * 70_000]
    for kind, pattern in ((phrases.KINDS, r"[^\x20\x09.,;:!?\x0A-\x0D]+"), (lexical.KINDS, r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), (words.SPACES, r"[^\x20\x09-\x0D]+")):
        own = words.split(pa.array(texts)[3:], kind)
        wanted = [re.findall(pattern, (t or "").translate(LOW)) for t in texts[3:]]
        assert own.counts.tolist() == [len(w) for w in wanted]
        assert [x.decode() for x in own.distinct.take(pa.array(own.code)).to_pylist()] == [x for w in wanted for x in w]
        assert own.row.tolist() == [i for i, w in enumerate(wanted) for _ in w]
    assert len(set(words.hashes(pa.array([f"w{i}".encode() for i in range(50_000)])).tolist())) == 50_000


def mined(rows, least, most):
    """The contract's phrases by counting everything."""
    n, f = Counter(), defaultdict(Counter)
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            own = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(own)
            for k in (1, 2, 3):
                f[lang or "und"].update(tuple(own[i : i + k]) for i in range(len(own) - k + 1))
    out = []
    for lang, own in f.items():
        good = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        ranked = []
        for p, a in good.items():
            if any(len(q) > len(p) and 100 * b >= 50 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in good.items()):
                continue
            score, k = min((1_000_000 * a * a // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
            ranked.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, x, y, n[lang], -score) for i, (score, a, p, x, y) in enumerate(sorted(ranked)[:most])]
    return sorted(out)


@pytest.fixture(scope="module")
def prose(spark):
    random = np.random.default_rng(8)
    vocabulary = [f"w{i}" for i in range(40)] + ["É", "世界", "The", "the"]
    share = np.arange(1, 45) ** -1.2
    texts = []
    for i in range(240):
        own = random.choice(vocabulary, random.integers(0, 60), p=share / share.sum()).tolist()
        for at in range(0, len(own), 9):
            own[at:at] = ["fixed", "phrase", "here"] if i % 3 else ["rare"] * 3
        texts.append((i, re.sub(r"(w1[0-9]) ", r"\1, ", " ".join(own)) + "\n tail\tof text", ["en", None, "de"][i % 3]))
    texts += [(500 + i, "one copy of this", "en") for i in range(120)]
    made = [(i, t, lang, "x", 1) for i, t, lang in texts]
    return documents(spark).select("doc_id", "text", "lang", "source", F.col("n_chars").alias("words")).union(spark.createDataFrame(made, "doc_id long, text string, lang string, source string, words long"))


@pytest.mark.parametrize("sample, most, least", [(1, 2000, 10), (6, 15, 10), (10**9, 2000, 4)])
def test_phrases_equal_a_full_count(spark, prose, sample, most, least, monkeypatch):
    """Everything proposed; a sample that misses some; nothing proposed, so that all is border and expansion."""
    monkeypatch.setattr(phrases, "TEXTS", 2000)
    got = phrases.collocations(prose, most, least, sample=sample).collect()
    wanted = mined([(r["text"], r["lang"]) for r in prose.select("text", "lang").collect()], least, most)
    assert sorted(map(tuple, got)) == wanted and len(wanted) > 30


def test_phrases_of_nothing(spark):
    assert phrases.collocations(no_documents(spark)).count() == 0
    assert phrases.collocations(documents(spark).filter("text is null")).count() == 0


def test_long_texts_are_cut_behind_marks(monkeypatch):
    monkeypatch.setattr(phrases, "TEXTS", 50)
    for text in ("ab, cd ef. " * 40, "no marks at all " * 20, "x" * 49 + "!" + "y" * 200, "é, " * 60):
        parts = [p.to_pylist()[0] for p in phrases._pieces(pa.array([text]))]
        assert b"".join(parts) == text.encode() and all(p[-1:] in b",.!" for p in parts[:-1])
    assert [p.to_pylist() for p in phrases._pieces(pa.array([None], pa.string()))] == [[None]]


class OneTask:
    """Stands for a table of one partition: its batches go through a function here, in this process."""

    def __init__(self, *batches):
        self.batches = batches

    def mapInArrow(self, run, schema):
        return run(iter(self.batches))


@pytest.mark.parametrize("vocabulary", [3_000, 300_000])
def test_memory_of_a_phrase_task_is_bounded(vocabulary):
    """24 MB of text in one batch: what a task allocates beside it stays under 100 MB."""
    random = np.random.default_rng(5)
    texts = pa.array([" ".join(map("w{:06d}".format, (vocabulary * random.random(260) ** 3).astype(int))) + "." for _ in range(12_000)])
    batch = pa.RecordBatch.from_arrays([texts, pa.array(["en"] * len(texts))], ["text", "lang"])
    n = sum(len(t) for t in texts.to_pylist())
    assert n > 24e6

    def each(g):
        yield g.rows(1, g.word_lang, g.counts, np.arange(len(g.counts)))
        _, two, counts, hashed, place = g.pairs()
        yield hashed, counts
        _, _, counts, hashed = g.triples(place, counts > 1, hashed, two)
        yield hashed, counts

    total = Counter()
    tracemalloc.start()
    try:
        before, arrow = tracemalloc.get_traced_memory()[0], pa.total_allocated_bytes()
        for out in phrases._passed(OneTask(batch), each, 8):
            total["words"] += pc.sum(out.column("n")).as_py() or 0
            total["others"] += sum(int(np.frombuffer(c, np.uint32).sum()) for c in out.column("counts").to_pylist() if c)
            assert pa.total_allocated_bytes() - arrow < 50e6
            del out
        most = tracemalloc.get_traced_memory()[1] - before
    finally:
        tracemalloc.stop()
    assert total["words"] == 260 * len(texts) and total["others"] >= 259 * len(texts)
    assert most < 100e6, f"{most / 1e6:.0f} MB"


def test_packed_hashes_are_summed_over_slices():
    """Each hash once in its part, whatever slices it came from; parts are all of the hashes in a range."""
    random = np.random.default_rng(6)
    hashed = random.integers(0, 1 << 64, 500, np.uint64)
    held = [(h := random.choice(hashed, 900), np.arange(900) % 5 + 1) for _ in range(3)] + [(hashed[:1], np.array([1 << 40]))]
    wanted = Counter()
    for own, counts in held:
        for h, c in zip(own.tolist(), counts.tolist(), strict=True):
            wanted[h] += c
    out, got = phrases._blocks(held, 7), []
    for part, h, c in zip(*(out.column(k).to_pylist() for k in ("part", "hashes", "counts")), strict=True):
        own = np.frombuffer(h, np.uint64).tolist()
        assert {x * 7 >> 64 for x in own} == {part}
        got += zip(own, np.frombuffer(c, np.uint32).tolist(), strict=True)
    assert sorted(got) == sorted((h, min(c, (1 << 32) - 1)) for h, c in wanted.items())


def test_filters_hold_what_was_put_in(spark):
    put = spark.range(5000).select(F.xxhash64("id").alias("hash"))
    own = phrases.gathered(put)
    held = np.array([r["hash"] for r in put.collect()], np.int64).view(np.uint64)
    assert own.holds(held).all() and own.holds(np.arange(100_000, dtype=np.uint64)).mean() < 0.001
    assert not phrases.gathered(put.limit(0)).holds(held).any()


def ranked(docs, items, top):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    held = [(i, Counter(find(t))) for i, t in docs if find(t)]
    total, terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    w = {t: math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) for t in df}
    out = []
    for item, text in items:
        scores = []
        for i, c in held:
            m = 75 + 25 * sum(c.values()) * total // terms
            score = sum(w[t] * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t in find(text) if c[t])
            if score > 0:
                scores.append((-score, i is None, i or 0))
        out += [(item, k + 1, None if none else i, -s) for k, (s, none, i) in enumerate(sorted(scores)[:top])]
    return sorted(map(str, out))


@pytest.mark.parametrize("top, bucket, lead, block", [(20, 4096, 4096, 1 << 20), (3, 7, 5, 60), (2, 16, 1, 1 << 20)])
def test_lexical_search_equals_brute_force(spark, prose, top, bucket, lead, block, monkeypatch):
    monkeypatch.setattr(lexical, "LEAD", lead)
    monkeypatch.setattr(lexical.search, "__defaults__", (lexical.TOP, None, bucket))
    items = [(1, "the fixed phrase HERE"), (2, "w3 w3 w30 é"), (3, None), (4, ""), (5, "unknown-term"), (6, "w1 w2 w5 rare tail 世界"), (7, "one copy of this"), (None, "fox dog"), (6, "quick")]
    table = spark.createDataFrame([(*i, 1) for i in [*items, items[0]]], "item_id long, text string, rank int")
    got = lexical.best_documents(prose, table, top, block=block).collect()
    assert sorted(map(str, map(tuple, got))) == ranked([(r["doc_id"], r["text"]) for r in prose.collect()], items, top)


def test_lexical_search_of_nothing(spark):
    items = spark.createDataFrame([(1, "the fox")], "item_id long, text string")
    assert lexical.best_documents(no_documents(spark), items).count() == 0
    assert lexical.best_documents(documents(spark), items.limit(0)).count() == 0


def test_bounds_prune_but_never_below_a_score():
    random = np.random.default_rng(1)
    size, rows = 30, 500
    dense = np.where(random.random((rows, size)) < 0.2, random.integers(1, 10**6, (rows, size)), 0).astype(np.int64)
    dense[:, 0] += 1
    lists = [(np.flatnonzero(r).astype(np.int32), r[r > 0]) for r in dense]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(rows)), "length": np.sqrt((dense.astype(float) ** 2).sum(1)), "ids": pa.array([i for i, _ in lists], pa.list_(pa.int32())), "impacts": pa.array([v for _, v in lists], pa.list_(pa.int64()))})
    own, looked = lexical.Bucket(batch, size), 0
    for _ in range(60):
        terms = np.sort(random.choice(size, 6, False))
        asked = random.integers(1, 4, 6)
        scores = dense[:, terms] @ asked
        least = int(np.sort(scores)[-5])
        kept = own.survivors(terms, asked, least)
        assert set(np.flatnonzero(scores >= least)) <= set(kept.tolist())
        whole = np.zeros(size, np.int64)
        whole[terms] = asked
        assert own.scores(kept, whole).tolist() == scores[kept].tolist()
        looked += len(kept)
    assert looked < 60 * rows / 4
