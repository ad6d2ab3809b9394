"""Containment and similarity joins against brute force."""

from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from archivelens.functions import similarity
from archivelens.operators import alike, audit, chunking, containment, rules, search


def test_keywords_are_found_wherever_they_stand(spark):
    random = np.random.default_rng(3)
    letters = list("abcdeé世 \U0001f600A")
    make = lambda n, most: ["".join(random.choice(letters, k)) for k in random.integers(0, most, n)]
    texts = [*make(120, 60), None, "", "İstanbul ẞ", "x" * 9000 + "needle" + "y" * 9000, "edge", "ee"]
    words = [*make(150, 6), "needle", "EDGE", "e", "ee", "xx", None, "", "not there at all", "ẞ"]
    rows = spark.createDataFrame([(i, t, "old", 1) for i, t in enumerate(texts)], "doc_id long, text string, matched string, n int")
    asked = spark.createDataFrame([(w,) for w in [*words, words[0]]], "keyword string")
    # lower case as the engine has it
    low = {r["x"]: r["y"] for r in spark.createDataFrame([(t,) for t in [*texts, *words] if t is not None], "x string").select("x", F.lower("x").alias("y")).collect()}
    wanted = {(i, low[w]) for i, t in enumerate(texts) for w in words if t and w and low[w] in low[t]}
    for rare in (2000, 0):
        got = containment.matches(rows, "text", asked, rare).collect()
        assert {(r["doc_id"], r["matched"]) for r in got} == wanted and len(got) == len(wanted) > 300
    assert containment.matches(rows.limit(0), "text", asked).count() == 0 and containment.matches(rows, "text", asked.limit(0)).count() == 0


def test_large_slices_keep_rows_apart(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(containment, "TEXTS", 10)
    wanted = np.zeros(containment.CODES, bool)
    wanted[containment.codes(np.frombuffer(b"abcd", np.uint8), 3)] = True
    own = containment.KeyGrams(wanted)
    texts = pa.array(["ab", "cd", "abc", None, "xxabcdxxabcd", "", "bcd", "ab", "c"])
    wanted = [[c for c in (b"abc", b"bcd") if c in (t or "").encode()] for t in texts.to_pylist()]
    assert [[g.to_bytes(3, "big") for g in x] for x in own.of(texts).to_pylist()] == wanted
    assert own.of(texts.slice(2, 3)).to_pylist() == own.of(texts).to_pylist()[2:5] and own.of(texts.slice(0, 0)).to_pylist() == []


def test_many_rules_meet_many_texts(spark):
    """10,000 rules over names and texts, as often as a plain search finds them."""
    random = np.random.default_rng(5)
    words = [f"k{i}x" for i in range(10_000)]
    docs = [(i, " ".join(random.choice(words, 20)), f"{words[i]} report") for i in range(200)] + [(900, None, "K7X"), (901, "", None)]
    table = spark.createDataFrame([("s", w, w.upper() if i % 2 else w, "name" if i % 3 == 0 else "text", 1, i) for i, w in enumerate(words)] + [("s", "k0x", "k0x", "name", 1, 0), ("s", "z", None, "text", 1, 1)], "rule_set string, label string, keyword string, field string, weight int, rule_order int")
    got = rules.hits(spark.createDataFrame(docs, "doc_id long, text string, name string"), table)
    found = {"name": 2, "text": 1}
    wanted = [(d[0], w) for d in docs for i, w in enumerate(words) if w in (d[found["name" if i % 3 == 0 else "text"]] or "").lower()]
    wanted += [(d[0], "k0x") for d in docs if "k0x" in (d[2] or "")]
    assert sorted((r["doc_id"], r["label"]) for r in got.collect()) == sorted(wanted)
    assert rules.hits(docs := spark.createDataFrame(docs, "doc_id long, text string, name string"), table.limit(0)).count() == 0
    assert got.columns == [*docs.columns, *rules.RULE]


def test_entities_and_terms_by_containment(spark):
    texts = spark.createDataFrame([("Acme sells",), ("acme and Zeta",), (None,), ("acme and Zeta",)], "text string")
    names = spark.createDataFrame([("Acme",), ("ACME",), ("zeta",), ("nobody",), ("x",), (None,)], "name string")
    assert {(r["name"], r["texts"]) for r in audit.entity_frequency(texts, names).collect()} == {("Acme", 3), ("ACME", 3), ("zeta", 2), ("nobody", 0)}
    chunks = spark.createDataFrame([(1, "Budget plan.docx"), (2, "budget.docx"), (3, None)], "chunk_id int, file_name string")
    terms = spark.createDataFrame([(1, "budget"), (1, "plan"), (2, "budget"), (1, "plan")], "query_id int, term string")
    assert {(r["query_id"], r["chunk_id"], r["hits"]) for r in search.exact_name_hits(terms, chunks).collect()} == {(1, 1, 2), (2, 1, 1), (2, 2, 1)}


def ratio(a, b):
    return SequenceMatcher(None, *sorted((a, b))).ratio()


@pytest.mark.parametrize("least", [0.72, 0.9, 1.0])
def test_alike_names_equal_all_pairs(spark, least):
    random = np.random.default_rng(2)
    base = ["".join(random.choice(list("abcdefghijklmnopqrstuvwxyz "), n)) for n in random.integers(1, 30, 330)]
    names = set(base)
    for name in base[:110]:  # near ones
        letters = list(name)
        for _ in range(random.integers(1, 4)):
            letters[random.integers(0, len(letters))] = random.choice(list("xyzé世"))
        names |= {"".join(letters), name + "s", name[::-1]}
    names = sorted(names) + ["aaaa", "aaaaa", "aa", "世界世界", "世界世界x", ""]
    rows = spark.createDataFrame([(n, 1) for n in [*names, None, names[0]]], "name string, ratio int")
    wanted = {(a, b) for i, a in enumerate(names) for b in names[:i] if ratio(a, b) >= least}
    wanted = {tuple(sorted(p)) for p in wanted}
    got = alike.similar_names(rows, least).collect()
    assert {(r["one"], r["other"]) for r in got} == wanted and len(got) == len(wanted)
    assert all(r["ratio"] == ratio(r["one"], r["other"]) for r in got)
    reach = alike.candidates(rows, least).count()  # what Python is asked for
    assert reach < len(names) * (len(names) - 1) / 2 / 100
    assert alike.similar_names(rows.limit(0), least).count() == 0


def test_bounds_are_never_below_the_ratio(spark):
    random = np.random.default_rng(9)
    make = lambda n: ["".join(random.choice(list("abé"), k)) for k in random.integers(0, 14, n)]
    pairs = [tuple(sorted(p)) for p in zip(make(400), make(400), strict=True)]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", alike.ratio_bound(F.col("a"), F.col("b")).alias("most")).collect()
    assert all(r["most"] >= ratio(r["a"], r["b"]) for r in got) and sum(r["most"] < 0.9 for r in got) > 50


def test_best_name_match(spark):
    rows = [(1, "show 내용 budget plan.xlsx", "budget plan 2024.xlsx"), (1, "show 내용 budget plan.xlsx", "zebra.md"), (2, "budget plan", "my-budget_plan.docx"), (3, "파일", "x.md"), (4, None, "x.md"), (5, "quux", None), (5, "quux", "quuxer.pdf")]
    got = {r["query_id"]: r["name_match"] for r in search.best_name_match(spark.createDataFrame(rows, "query_id int, text string, file_name string")).collect()}
    assert got == {1: pytest.approx(SequenceMatcher(None, "showbudgetplan", "budgetplan2024").ratio()), 2: 1.0, 3: 0.0, 4: 0.0, 5: 1.0}
    assert spark.range(1).select(similarity.name_key(F.lit("보고서 파일 알려줘.PDF"))).head()[0] == "보고서"


def test_texts_are_cut_and_searched_a_part_at_a_time(spark):
    """A task holds the chunks of a bounded part of a batch, and a row is put in lower case once, not for each gram."""
    rows = [(n, "word " * size if size else None) for n, size in enumerate((0, 3, 150_000, 2, 150_000, 150_000, 1))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    found = chunking.chunk(docs)
    assert sorted(map(tuple, found.collect())) == [(n, i, c) for n, t in rows if t for i, c in enumerate(chunking.cut_paragraphs(t))]
    table = pa.record_batch([pa.array([n for n, _ in rows]), pa.array([t for _, t in rows])], ["key", "text"])
    assert [b.num_rows for b in chunking.in_parts([table])] == [5, 1, 1]
    words = spark.createDataFrame([("Word",)], "keyword string")
    plan = containment.matches(docs, "text", words)._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.split("\n") if "Filter" in x and "lower(text" in x.split("Contains")[-1] and "Contains" in x]
    assert containment.matches(docs, "text", words).count() == 6
