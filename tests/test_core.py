"""Core operators on hand-made rows with answers worked out by hand, and brute-force twins."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from archivelens.functions import names, paths, scratch, similarity, text
from archivelens.operators import audit, catalog, chunking, cluster, comms, dedup, filters, graph, rules, scoring, search
from archivelens.sources import packages
from archivelens.streaming import streams

def now():
    return F.to_timestamp(F.lit("2026-01-01 00:00:00"))


def day(n):
    return dt.datetime(2026, 1, 1) - dt.timedelta(days=n)


def files(spark, rows):
    """(path, size, age in days) as files."""
    made = [(p, (p or "").split("/")[-1], s, day(a), day(a), (p or "").split("/")[-1].startswith(".")) for p, s, a in rows]
    return spark.createDataFrame(made, "path string, name string, size_bytes long, modified_at timestamp, created_at timestamp, is_hidden boolean")


def one(spark, expression, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expression(F.col("x")).alias("y")).head()["y"]


def many(spark, expression, values):
    """The expression of each value, in one job."""
    return {r["x"]: r["y"] for r in spark.createDataFrame([(v,) for v in values], "x string").select("x", expression(F.col("x")).alias("y")).collect()}


def test_path_parts(spark):
    for path, wanted in {"a/b/c.tar.gz": ("c.tar.gz", "c.tar", ".gz", "a/b", "a"), ".bashrc": (".bashrc", ".bashrc", "", "", ""), "A\\B.TXT": ("B.TXT", "B", ".txt", "A", "A"), "x": ("x", "x", "", "", "")}.items():
        assert tuple(one(spark, f, path) for f in (paths.name, paths.stem, paths.suffix, paths.parent, paths.top)) == wanted
    assert one(spark, paths.ancestors, "a/b/c") == ["a", "a/b"] and one(spark, paths.ancestors, "a") == []


def test_routes(spark):
    rows = files(spark, [("a.docx", 40 << 20, 1), ("s.xlsx", 4 << 20, 1), ("b.xlsx", 6 << 20, 1), ("h.hwp", 1, 1)])
    got = {r["name"]: r["route"] for r in filters.route(rows, [".xlsx"], most=5 << 20).collect()}
    assert got == {"a.docx": "name_only", "s.xlsx": "content", "b.xlsx": "name_only", "h.hwp": "name_only"}
    limits = spark.createDataFrame([(".docx", None, True), (".xlsx", 5 << 20, False), (".hwp", 0, False)], "extension string, max_bytes long, unlimited boolean")
    got = {r["name"]: r["route"] for r in filters.route(rows, [".docx", ".xlsx", ".hwp"], limits=limits).collect()}
    assert got == {"a.docx": "content", "s.xlsx": "content", "b.xlsx": "name_only", "h.hwp": "name_only"}


def test_noise(spark):
    wanted = {"node_modules/a.md": "folder:node_modules", "x/y/backup/a.md": "folder:backup", "backup/a.md": None, "x/a.tmp": "extension:.tmp", "x/README.md": "stem:readme", "x/y.md": None}
    for path, reason in wanted.items():
        assert one(spark, filters.noise_reason, path) == reason


def test_sketches_bound_what_sets_differ_in(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(63) for _ in range(400)]
    own = [sorted(set(base[: 300 + rng.randrange(60)]) - set(rng.sample(base, rng.randrange(80))) | {rng.getrandbits(63) - (1 << 62) for _ in range(rng.randrange(60))}) for _ in range(60)]
    table = spark.createDataFrame([(i, i, s) for i, s in enumerate([*own, []])], "set long, id long, hashes array<long>")
    drawn = {r["set"]: r for r in dedup.sketches(table).collect()}
    bits = lambda i, j: sum(((a ^ b) & (1 << 64) - 1).bit_count() for a, b in zip(drawn[i]["sketch"], drawn[j]["sketch"], strict=True))
    assert all(bits(i, j) <= len(set(own[i]) ^ set(own[j])) for i in range(60) for j in range(60))
    for percent in (50, 80, 100):
        got = {tuple(sorted((r["i"], r["j"]))) for r in dedup.alike_sets(table, percent).collect()}
        assert got == {(i, j) for i in range(60) for j in range(i + 1, 60) if 100 * len(set(own[i]) & set(own[j])) >= percent * len(set(own[i]) | set(own[j]))}


def test_alike_families_are_chained_not_paired(spark):
    rows = [(i, f"src{i % 3}/en/doc_{i}.md", dt.datetime(2026, 1, 1) + dt.timedelta(days=i * 37 % 400)) for i in range(300)] + [(900, "q/zu/other thing.md", None), (901, "src1/en/zz.md", dt.datetime(2026, 1, 1))]
    docs = spark.createDataFrame(rows, "doc_id long, path string, modified_at timestamp")
    own = scratch.stored(cluster.kinds(cluster.profiles(docs)), "kinds")
    days = spark.createDataFrame([(r["id"], 1) for r in own.select("id").collect()], "id long, day int")
    assert cluster.pair_scores(own, days).count() < 300 * 20  # all pairs are alike in great part, 44,850 of them


def test_equal_questions_are_asked_once(spark):
    terms = spark.createDataFrame([(q, t) for q in range(40) for t in (("doc", "en") if q % 2 else ("src1",))] + [(40, "doc"), (40, "doc"), (41, "none")], "query_id long, term string")
    asked, members = search.questions(terms)
    assert sorted(map(tuple, asked.collect())) == [(0, "src1"), (1, "doc"), (1, "en"), (40, "doc"), (41, "none")]
    assert members.count() == 42
    chunks = spark.createDataFrame([(i, f"doc {i}.md", f"src{i % 3}/{'en' if i % 2 else 'de'}/doc {i}.md") for i in range(30)], "chunk_id long, file_name string, source_path string")
    got = sorted(map(tuple, search.best_token_match(terms, chunks).collect()))
    wanted = [(q, c, 2 if q % 2 else 1) for q in range(40) for c in range(30) if (c % 2 if q % 2 else c % 3 == 1)] + [(40, c, 1) for c in range(30)]
    assert got == sorted(wanted)


def test_noise_by_folders_above(spark):
    above = lambda path: filters.noise_reason(path, above=True)
    wanted = {"node_modules/a.md": "folder:node_modules", "top/in/backup/a.md": "folder:backup", "top/in/backup/d1/a.md": "folder:backup", "top/backup/d1/a.md": None, "backup/top/in/a.md": None, "C:/x/top/backup/a.md": None, "x/a.tmp": "extension:.tmp"}
    for path, reason in wanted.items():
        assert one(spark, above, path) == reason


def test_category_audit_counts_noise_as_its_sql(spark, tmp_path):
    import __spark_entry__ as entry

    rows = [(i, f"src{i % 4}", "en", "words", 5) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, source string, lang string, text string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    [got] = entry.queries()["category_audit"](spark, str(tmp_path)).collect()
    assert got["files"] == 60 and got["noise_files"] == 12 and got["customers"] == 4 and got["projects"] == 60


def test_exact_and_version_dedup(spark):
    rows = files(spark, [(f"f/r_v{i}.txt", 10, 20 - i) for i in range(12)]).withColumn("text", F.lit("same"))
    got = dedup.exact(rows).collect()
    assert [r["path"] for r in got if r["kept"]] == ["f/r_v11.txt"] and sum(r["reason"] == "duplicate_content" for r in got) == 11
    assert {r["winner"] for r in dedup.versions(rows).collect()} == {"f/r_v11.txt"}
    assert dedup.cap_versions(rows).filter("role = 'primary'").count() == 2
    unread = rows.withColumn("text", F.lit(None).cast("string"))
    assert {r["reason"] for r in dedup.exact(unread).collect()} == {"read_error"}


def test_version_numbers_compare_as_numbers(spark):
    wanted = {"plan_v1.10 (v1.9)": "1.10", "plan": None, "serv3r": None, "v20251231235959001122": "20251231235959001122", "a v9 Ver. 10": "10", "version3": "3", "v2x": None, "v007": "7"}
    got = many(spark, names.version, wanted)
    assert {name: ".".join(n["number"] for n in v) if v else None for name, v in got.items()} == wanted


def test_families_of_names(spark):
    wanted = {
        "plan": "plan", "plan_v2": "plan", "plan_version3": "plan", "old_plan": "plan", "plan_final": "plan", "plan_final_copy": "plan", "2026-06-01 plan": "plan", "plan20260601": "plan",
        "plan_final_kim": "plan kim", "plan_manager": "plan", "plan-copy": "plan", "data_v20251231235959": "data", "serv3r": "serv3r", "rev2 plan": "rev2 plan", "v2": "v2", "final": "final", "": "",
        "평가기획안_최종": "평가기획안", "가이드_팀장": "가이드", "finality report": "finality report",
    }
    assert many(spark, names.family, wanted) == wanted
    rows = files(spark, [(f"f/{n}.md", 1, 5) for n in wanted] + [("f/plan.txt", 1, 1), (None, 1, 1)])
    got = {r["path"]: (r["family"], r["rank"]) for r in dedup.families(rows).collect()}
    assert len(got) == len(wanted) + 2 and got["f/plan_final.md"] == ("plan", 1) and got["f/plan_final_copy.md"] == ("plan", 2) and got["f/plan_version3.md"] == ("plan", 3)
    order = dedup.families(rows).filter("family = 'plan'").orderBy("rank").select("path").collect()
    for most in (3, 1):  # cut into ranges
        assert dedup.families(rows, most=most).filter("family = 'plan'").orderBy("rank").select("path").collect() == order
        assert {r["path"]: (r["family"], r["rank"]) for r in dedup.families(rows, most=most).collect()} == got
    assert dedup.families(rows.limit(0)).count() == 0


def test_an_older_member_is_promoted(spark):
    rows = [("p/plan final v3.docx", 1, 90), ("p/plan_v2.docx", 2, 85), ("p/plan_v1.docx", 3, 99), ("p/old_plan.docx", 4, 99), ("p/note.md", 1, 60)]
    docs = spark.createDataFrame([(*r, "p", "plan" if "plan" in r[0] else "note", None) for r in rows], "path string, rank int, value int, top string, family string, modified_at timestamp")
    got = {r["path"].split("/")[1]: r["role"] for r in scoring.representatives(docs, ["top"]).collect()}
    assert got == {"plan final v3.docx": "representative", "plan_v2.docx": "representative", "plan_v1.docx": "reference", "old_plan.docx": "reference", "note.md": "support"}


def test_package_merge(spark):
    rows = [(0, day(9), "p", day(1), "new"), (0, day(9), "p", day(1), "new too"), (0, day(9), "p", day(5), "old"), (1, day(2), "p", day(3), "other"), (0, day(9), "memo:1", day(1), "m0"), (1, day(2), "memo:1", day(1), "m1"), (1, day(2), None, day(1), "free")]
    got = dedup.merge_packages(spark.createDataFrame(rows, "package_index int, package_created_at timestamp, source_path string, modified_at timestamp, t string"))
    assert {r["t"] for r in got.collect()} == {"new", "new too", "m0", "m1", "free"}


@pytest.mark.parametrize("seed", range(3))
def test_greedy_removal_equals_the_walk(spark, seed):
    random = np.random.default_rng(seed)
    docs = [(int(i), day(int(random.integers(0, 6)))) for i in range(60)]
    pairs = sorted({tuple(sorted(map(int, random.choice(60, 2, False)))) for _ in range(90)})
    near = {i: set() for i, _ in docs}
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    kept: set[int] = set()
    for i, _ in sorted(docs, key=lambda d: (-d[1].timestamp(), d[0])):
        if not near[i] & kept:
            kept.add(i)
    got = dedup.remove_similar(spark.createDataFrame(docs, "id long, modified_at timestamp"), spark.createDataFrame(pairs, "a long, b long"))
    assert {r["id"] for r in got.collect()} == kept


def test_jaccard_pairs_equal_brute_force(spark):
    random = np.random.default_rng(3)
    rows = [(i, " ".join(f"w{x}" for x in random.integers(0, 12, random.integers(1, 14)))) for i in range(80)] + [(90, ""), (91, None)]
    rows += [(5, "v1 v2 v3 v4 v5"), (95, "v1 v2 v3 v4 v5 v6"), (95, "v1 v2 v3 v4 v5 v6"), (None, "v1 v2 v3 v4 v5 v7")]  # a second text of 5
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    classes: dict[frozenset, int] = {}
    for i, t in rows:
        if t and i is not None:
            classes.setdefault(frozenset(t.split()), i)
    own = sorted((i, s) for s, i in classes.items())
    wanted = {(a, b, len(x & y)) for a, x in own for b, y in own if a < b and 100 * len(x & y) >= 80 * len(x | y)}
    assert {(r["a"], r["b"], r["both"]) for r in dedup.jaccard_pairs(docs).collect()} == wanted
    assert (5, 95, 5) in wanted


def test_near_dup_query_equals_the_walk(spark, tmp_path):
    from archivelens.plans import catalog_queries

    random = np.random.default_rng(4)
    texts = [" ".join(f"w{x}" for x in random.integers(0, 12, random.integers(6, 20))) for _ in range(60)]
    texts += [texts[i] for i in random.integers(0, 60, 30)] + ["", "", "!!! ???", "a b", None, None]
    rows = [(i, t, "en", "src1", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    kept: list[int] = []
    for i in sorted(range(len(texts)), key=lambda i: (i * 37 % 400, i)):  # newest first
        own = {w for w in (texts[i] or "").split() if len(w) > 1 and w[0] == "w"}
        others = [{w for w in (texts[j] or "").split() if len(w) > 1 and w[0] == "w"} for j in kept]
        if not any(own and 100 * len(own & s) >= 80 * len(own | s) for s in others):
            kept.append(i)
    got = [r["id"] for r in catalog_queries.near_dup_removed(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(kept)
    assert {90, 91, 92, 93, 94, 95} <= set(got)


def test_components(spark):
    random = np.random.default_rng(7)
    edges = [(int(a), int(b)) for a, b in random.integers(0, 300, (220, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, None), (6, 6)]
    label = {x: x for e in edges for x in e if x is not None and None not in e}
    for _ in range(400):
        for a, b in edges:
            if b is not None:
                label[a] = label[b] = min(label[a], label[b])
    got = {r["node"]: r["component"] for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: c for x, c in label.items() if x in got} and {x for e in edges if e[0] != e[1] and e[1] is not None for x in e} == set(got)
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_paragraph_chunks():
    text_ = "x" * 1400
    got = chunking.cut_paragraphs(text_)
    assert [len(c) for c in got] == [700, 802, 302] and got[1].startswith("x" * 100 + "\n\n")
    assert chunking.cut_paragraphs("a\n\nb\n\n\n\nc") == ["a\n\nb\n\nc"] and chunking.cut_paragraphs(" \n\n ") == []
    for size in (20, 50):
        pieces = chunking.cut_paragraphs("\n\n".join(f"paragraph {i}" for i in range(30)), size=size, overlap=3)
        assert all(any(f"paragraph {i}"[-5:] in p for p in pieces) for i in range(30))


def test_sheet_chunks_keep_rows():
    rows = [f"row {i}, value {i * 7}" for i in range(43)]
    got = chunking.cut_rows("\n".join(["[sheet] a, b", *rows]), 180)
    assert len(got) > 1 and all(c.startswith("[sheet] a, b\n") for c in got)
    assert [r for c in got for r in c.split("\n")[1:]] == rows


def test_chunk_table(spark):
    docs = spark.createDataFrame([(1, "a\n\nb"), (2, None), (3, " ")], "doc_id long, text string")
    assert [(r["doc_id"], r["chunk_index"], r["chunk_text"]) for r in chunking.chunk(docs).collect()] == [(1, 0, "a\n\nb")]


def test_text_functions(spark):
    assert one(spark, lambda c: text.drop_lines(c, ["secret"]), "keep\nSECRET line\nend") == "keep\nend"
    assert one(spark, text.html_text, "<html><script>x<1</script><p>One&nbsp;&amp;</p><br>two</html>") == "One &\ntwo"
    assert one(spark, text.without_quotes, "hello\n> quoted\nafter") == "hello"
    assert one(spark, text.without_quotes, "body\n--\nAnn\ntel 1\ne-mail a@b") == "body"
    assert one(spark, text.without_quotes, "hi\nOn Monday Bob wrote:\nold") == "hi"
    assert one(spark, text.gigabytes, 350_000_000, "long") == "0.35"
    assert one(spark, lambda c: F.transform(text.name_dates(c), lambda d: d.cast("string")), "r_2024-03-05_240306 v20249999") == ["2024-03-05", "2024-03-06"]
    for raw in ("2024-03-05T10:20:30Z", "2024-03-05 10:20:30", "Tue, 5 Mar 2024 10:20:30 +0000"):
        assert one(spark, text.parse_time, raw) == dt.datetime(2024, 3, 5, 10, 20, 30)
    assert one(spark, text.parse_time, "soon") is None
    assert one(spark, lambda c: text.match_terms(c, ("the",), ("ing",)), "The meeting of 2024 meeting A") == ["meet", "of"]
    assert one(spark, lambda c: text.section(c, "Risk", ("Risk", "Next")), "Goal: x\nRisk: late\nand dear\nNext: y") == "late\nand dear"
    assert one(spark, text.numbered, "1. one\n2) two\nno") == ["one", "two"]
    assert one(spark, lambda c: text.preview(c, 5), "a  b\n c d") == "a b c..."
    assert one(spark, lambda c: text.sample(c, 100), "y" * 100) == "y" * 100
    assert one(spark, text.common_prefix, ["big plan a", "big plan b"], "array<string>") == "big plan"
    assert one(spark, text.common_tokens, ["b a", "a c b"], "array<string>") == ["a", "b"]
    assert one(spark, lambda c: text.block_of(c, F.lit("two")), "### one\nA\n### two\nB\n### three\nC") == "B"


def test_similarity(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0], "final report.docx", "report"), ([0.0, 0.0], [1.0, 1.0], "abc", "xyz")], "a array<double>, b array<double>, n string, q string")
    got = rows.select(similarity.cosine(F.col("a"), F.col("b")).alias("c"), similarity.name_match(F.col("q"), F.col("n")).alias("m")).collect()
    assert got[0]["c"] == pytest.approx(2**-0.5) and got[1]["c"] == 0 and got[0]["m"] == 1 and got[1]["m"] == 0


def test_gate_labels_and_evidence(spark):
    labels = spark.createDataFrame([(0.7,), (0.48,), (0.36,)], "s double").select(search.confidence(F.col("s")).alias("l")).collect()
    assert [r["l"] for r in labels] == ["certain", "estimated", "check"]
    rows = [(1, False, True, 0.1, 0.71), (2, True, False, 0.9, 0.82), (3, False, True, 0.6, 0.1), (4, False, False, 0.0, 0.34), (5, False, False, 0.0, 0.2)]
    got = search.answerable(spark.createDataFrame(rows, "q int, is_external boolean, is_file_like boolean, name_match double, top_similarity double"))
    assert {r["q"]: r["answerable"] for r in got.collect()} == {1: False, 2: False, 3: True, 4: True, 5: False}
    queries = spark.createDataFrame([(1, "budget", [1.0, 0.0]), (2, "other thing", [0.0, 1.0])], "query_id int, text string, vector array<double>")
    chunks = spark.createDataFrame([(1, "budget.docx", "a/budget.docx", "x", [1.0, 0.0]), (2, "other.docx", "a/other.docx", "y", [0.0, 1.0]), (3, "none", "none", "z", [1.0])], "chunk_id int, file_name string, source_path string, chunk_text string, embedding array<double>")
    got = search.hybrid(queries, chunks).filter("rank = 1").collect()
    assert {(r["query_id"], r["chunk_id"]) for r in got} == {(1, 1), (2, 2)}
    more = spark.createDataFrame([(4, "the budgetplan.xlsx", "b/the budgetplan.xlsx", "x", [0.0, 1.0]), (5, "budgetplan two.xlsx", "b/budgetplan two.xlsx", "a roof", [1.0, 0.1])], chunks.schema)
    got = search.exact_name_hits(spark.createDataFrame([(1, "budget"), (1, "two")], "query_id int, term string"), chunks.union(more))
    assert {(r["query_id"], r["chunk_id"], r["hits"]) for r in got.collect()} == {(1, 5, 2)}
    found = search.hybrid(spark.createDataFrame([(1, "budget roof", [0.0, 1.0])], queries.schema), chunks.union(more)).orderBy("rank").collect()
    assert [(r["chunk_id"], r["list_no"]) for r in found] == [(2, 1), (4, 1), (1, 2), (5, 2)] or [(r["chunk_id"], r["list_no"]) for r in found] == [(2, 1), (4, 1), (5, 2), (1, 2)]
    table = spark.createDataFrame([("a", "x")], "label string, items string")
    assert {(r["label"], r["items"]) for r in rules.look_up(spark.createDataFrame([("a",), ("b",)], "label string"), table, "none").collect()} == {("a", "x"), ("b", None)}
    parts = search.split_compound(spark.createDataFrame([(1, "show a and then list b please"), (2, "salt and pepper")], "query_id int, text string"), [" and then ", " and "], ["please"])
    assert [(r["query_id"], r["part_no"]) for r in parts.orderBy("query_id", "part_no").collect()] == [(1, 0), (1, 1), (2, 0)]


def test_self_contact_and_windows(spark):
    mails = [("a@x", ["b@x"])] * 3 + [("b@x", ["a@x"])] + [("c@x", ["a@x"])]
    rows = spark.createDataFrame([(i, "mail", day(i * 40), "work" if i == 0 else "", s, r) for i, (s, r) in enumerate(mails)], "item_id int, kind string, ts timestamp, text string, sender string, recipients array<string>")
    assert comms.guess_self(rows).head()["contact"] == "a@x"
    got = {r["contact"]: (r["items"], r["work"], r["last_31d"], r["last_92d"], r["last_183d"]) for r in comms.contacts(rows, now(), work_terms=("work",)).collect()}
    assert got == {"a@x": (5, 1, 1, 3, 5), "b@x": (4, 1, 1, 3, 4), "c@x": (1, 0, 0, 0, 1)}


def test_chat_context(spark):
    rows = spark.createDataFrame([("f", i, "hit" if i in (3, 9) else "-") for i in range(30)], "source_file string, line_no long, message string")
    hit = F.col("message") == "hit"
    blocks = comms.chat_blocks(rows, hit)
    assert {(r["block_no"], r["line_no"]) for r in blocks.collect()} == {(1, i) for i in range(15)}
    got = comms.chat_context(rows, hit).collect()
    assert len(got) == 30 and not any(r["gap"] for r in got)
    few = sorted((r["line_no"], r["gap"]) for r in comms.chat_context(rows, hit, around=1, budget=5).collect())
    assert few == [(8, False), (9, False), (10, False), (28, True), (29, False)]


def test_mail_and_chat_files(spark):
    mail = b"From: Ann <a@x>\r\nTo: b@x\r\nSubject: Hi\r\nDate: Tue, 5 Mar 2024 10:20:30 +0000\r\n\r\nbody\r\n"
    rows = spark.createDataFrame([("m.eml", bytearray(mail)), ("bad.zip", bytearray(b"no"))], "path string, content binary")
    got = {r["source_file"]: r for r in comms.read_mails(rows).collect()}
    assert got["m.eml"]["subject"] == "Hi" and got["m.eml"]["body"].strip() == "body" and got["m.eml"]["error"] is None and got["bad.zip"]["error"]
    assert comms.mail_texts(comms.read_mails(rows).filter("error is null")).head()["text"].startswith("From: Ann")
    log = "--- 2024/3/5 ---\n[Ann] [pm 1:05] hello\nnoise\n[Bob] [am 12:10] late"
    lines = comms.parse_chat(spark.createDataFrame([("c.txt", log)], "path string, text string")).orderBy("line_no").collect()
    assert [(r["sender"], r["ts"], r["message"]) for r in lines] == [("Ann", dt.datetime(2024, 3, 5, 13, 5), "hello"), ("Bob", dt.datetime(2024, 3, 5, 0, 10), "late")]


def test_unit_resolution_equals_the_fold(spark):
    random = np.random.default_rng(0)
    rows = [("project", f"n{int(random.integers(0, 5))}", int(random.integers(20, 80)), i) for i in range(40)] + [("project", "Archive", 90, 99)]
    wanted: dict[str, int] = {}
    for _, name, confidence, _ in rows[:-1]:
        wanted[name] = confidence if name not in wanted else max(wanted[name], confidence) + 3
    got = cluster.resolve_units(spark.createDataFrame(rows, "unit_type string, name string, confidence int, ord long"))
    assert {r["name"]: r["confidence"] for r in got.collect()} == {n: min(100, c) for n, c in wanted.items()}


def test_unit_merging(spark):
    rows = [("Data Platform", ["a"]), ("new data platform project", ["b"]), ("Billing", ["c"]), ("x", None)]
    got = cluster.merge_similar_units(spark.createDataFrame(rows, "name string, evidence array<string>"))
    assert {(r["name"], tuple(r["evidence"])) for r in got.collect()} == {("Data Platform", ("a", "b")), ("Billing", ("c",)), ("x", ())}
    units = spark.createDataFrame([("t", "Archive", 50), ("t", "Billing", 70), ("t", "misc", 40)], "unit_type string, name string, confidence int")
    evidence = spark.createDataFrame([("Archive", "Design", 3)], "name string, label string, hits int")
    assert {(r["name"], r["confidence"]) for r in cluster.normalize_units(units, evidence).collect()} == {("Design", 65), ("Billing", 70)}
    assert {(r["name"], r["confidence"]) for r in cluster.clean_units(units.filter("name = 'Archive'"), evidence).collect()} == {("Design", 64)}
    assert cluster.report_units(units, spark.createDataFrame([("billing 2024",), ("zzz",)], "project string")).filter("unit = 'Billing'").count() == 2
    assert cluster.report_units(units.limit(0), spark.createDataFrame([("zzz",)], "project string")).head()["confidence"] == 35


def test_structure_mode(spark):
    docs = spark.createDataFrame([(i, f"p{i % 3}", "org", True, None) for i in range(12)], "doc_id int, folder string, organisation string, is_project_style boolean, operation string")
    none = spark.createDataFrame([], "doc_id int, cluster int")
    assert cluster.structure_mode(docs, none).head()["mode"] == "PROJECT"
    other = spark.createDataFrame([(i, "archive", None, False, f"op{i % 4}") for i in range(12)], docs.schema)
    assert cluster.structure_mode(other, spark.createDataFrame([(i, i % 4) for i in range(12)], none.schema)).head()["mode"] == "CLUSTER"


def test_rule_engines(spark):
    docs = spark.createDataFrame([(1, "plan.docx", "we use sparktool", "g"), (2, "sparktool guide", "sparktool", "g"), (3, "none", None, "h")], "doc_id int, name string, text string, grp string")
    table = spark.createDataFrame([("tools", "Spark", "sparktool", "text", 3, 1), ("tools", "Spark", "sparktool", "name", 3, 2)], "rule_set string, label string, keyword string, field string, weight int, rule_order int")
    found = rules.hits(docs, table)
    assert sorted((r["doc_id"], r["field"]) for r in found.collect()) == [(1, "text"), (2, "name"), (2, "text")]
    assert rules.token_hits(docs, table).count() == 2
    tool = rules.tools(found, ["grp"]).head()
    assert (tool["docs"], tool["confidence"]) == (2, 100)
    best = rules.with_unknown(docs.select("grp").distinct(), rules.purposes(found, ["grp"]), ["grp"]).collect()
    assert {(r["grp"], r["label"], r["confidence"]) for r in best} == {("g", "Spark", 79), ("h", "Unknown", 25)}
    status = rules.work_status(docs, found.limit(0), ["grp"])
    assert {(r["status"], r["confidence"]) for r in status.collect()} == {("unknown", 51), ("unknown", 48)}
    whole = rules.assemble(rules.purposes(found, ["grp"]), rules.tools(found, ["grp"]), rules.descriptions(found, ["grp"]), rules.knowhow(found, ["grp"]), ["grp"]).head()
    assert whole["purpose"] == "Spark" and whole["tools"] == "Spark" and whole["missing"] == ""


def test_value_and_roles(spark):
    rows = files(spark, [("project/final_report_v2.docx", 5000, 3), ("project/draft.md", 100, 400), ("backup/sample.tmp", 10, 800)]).withColumn("text", F.lit("budget and schedule"))
    got = {r["name"]: (r["relevance"], r["final_score"], r["deliverable"], r["value"]) for r in scoring.document_value(rows, now()).collect()}
    assert got["final_report_v2.docx"] == (100, 100, 50, 93)
    assert got["sample.tmp"][2] == -9999 and got["sample.tmp"][3] == 0
    summary = audit.evidence_summary(spark.createDataFrame([("g", day(1).date(), True, True), ("g", day(9).date(), False, False), ("g", day(9).date(), False, False)], "grp string, day date, is_deliverable boolean, is_final boolean"), ["grp"]).head()
    assert (summary["importance"], summary["dates"], summary["recent"], summary["finals"]) == (65, 2, 3, 1)


def test_audit_of_good_and_bad(spark):
    good = spark.createDataFrame([], "section string, measure string, n long")
    assert {r["score"] for r in audit.structural_audit(good).collect()} == {100}
    bad = spark.createDataFrame([("clusters", "leakage", 9), ("status", "unknown", 2)], good.schema)
    got = {r["section"]: (r["score"], r["warnings"]) for r in audit.structural_audit(bad).collect()}
    assert got["clusters"] == (55, "leakage=9") and got["status"] == (70, "unknown=2") and got["overall"][0] == 81


def test_roots_links_and_trees(spark):
    a, b = files(spark, [("x/1.md", 1, 1)]), files(spark, [("2.md", 1, 1)])
    both = catalog.union_roots([("r", a), ("r", b)])
    assert {r["path"] for r in both.collect()} == {"r/x/1.md", "r (2)/2.md"}
    roots = spark.createDataFrame([("r", "/mnt/r")], "namespace string, root string")
    assert {(r["absolute_path"], r["reason"]) for r in catalog.resolve_roots(both, roots).collect()} == {("/mnt/r/x/1.md", None), (None, "missing_file")}
    links = spark.createDataFrame([(1, "mail", "box/a.zip::m1"), (1, "folder", "box2"), (2, "folder", "keep/x")], "memo_id int, kind string, target string")
    left = catalog.unlink_deleted(links, spark.createDataFrame([("box",)], "path string"))
    assert {r["target"] for r in left.collect()} == {"box2", "keep/x"}


def test_packages(spark, tmp_path):
    rows = spark.createDataFrame([("p.md", i, f"text {i}", [float(i), 1.0, 0.0], "p.md") for i in range(600)], "source_path string, chunk_index int, chunk_text string, embedding array<double>, file_name string")
    packages.write_package(rows, f"{tmp_path}/one", "one", "2026-01-01 00:00:00")
    got, bad = packages.read_packages(spark, [f"{tmp_path}/one", f"{tmp_path}/missing"])
    assert got.count() == 600 and bad == [f"{tmp_path}/missing"] and got.select("chunk_id").distinct().count() == 600
    assert spark.read.parquet(f"{tmp_path}/one/manifest").head()["document_count"] == 1


def test_embedding_failures_are_rows(spark):
    def embedder(texts):
        if any("bad" in t for t in texts):
            raise ValueError("no")
        return [[float(len(t))] for t in texts]

    rows = spark.createDataFrame([(i, "bad" if i == 2 else "ok" * i) for i in range(5)], "chunk_index int, chunk_text string").coalesce(1)
    got = {r["chunk_index"]: (r["embedding"], r["error"]) for r in packages.embed(rows, embedder, batch=5).collect()}
    assert got[2] == (None, "ValueError: no") and got[3] == ([6.0], None)


def test_extraction(spark, tmp_path):
    import zipfile

    (tmp_path / "a.txt").write_bytes("한글".encode("cp949"))
    (tmp_path / "b.docx").write_bytes(b"?")
    with zipfile.ZipFile(tmp_path / "c.zip", "w") as z:
        z.writestr("m2.md", "two")
        z.writestr("m1.txt", "one")
    rows = spark.read.format("binaryFile").load(str(tmp_path))
    got = {r["path"].split("/")[-1]: r for r in packages.join_members(packages.extract(rows)).collect()}
    assert got["a.txt"]["text"] == "한글" and got["b.docx"]["error"].startswith("unsupported")
    assert got["c.zip"]["text"] == "[file: m1.txt]\none\n\n[file: m2.md]\ntwo"
    assert packages.scan(spark, str(tmp_path)).count() == 3


def test_streams(spark, tmp_path):
    source = f"{tmp_path}/in"
    schema = "source_path string, version long, modified_at timestamp"
    spark.createDataFrame([("p", 1, day(5)), ("q", 1, day(5))], schema).coalesce(1).write.parquet(f"{source}/1")
    stream = lambda: spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(source)
    for _ in range(2):  # a restart finds nothing new
        streams.resumable(stream(), lambda df: df, f"{tmp_path}/out", f"{tmp_path}/state", "s1").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2
    streams.upsert_latest(stream(), f"{tmp_path}/table", f"{tmp_path}/up").awaitTermination()
    spark.createDataFrame([("p", 2, day(1)), ("q", 0, day(9))], schema).coalesce(1).write.parquet(f"{source}/2")
    streams.upsert_latest(stream(), f"{tmp_path}/table", f"{tmp_path}/up").awaitTermination()
    assert {(r["source_path"], r["version"]) for r in streams.read_latest(spark, f"{tmp_path}/table").collect()} == {("p", 2), ("q", 1)}
    rows = [("p", n, day(0)) for n in (3, 5, 4)] + [("r", None, None), ("r", 1, None), (None, 1, day(3)), ("q", 9, day(9))]
    for n, row in enumerate(rows):  # late and equal versions lose, also those without a time
        spark.createDataFrame([row, row], schema).coalesce(1).write.parquet(f"{source}/{n + 3}")
        if n % 3 == 2 or n == len(rows) - 1:  # several deliveries between restarts
            streams.upsert_latest(stream(), f"{tmp_path}/table", f"{tmp_path}/up").awaitTermination()
    whole = streams.latest_versions(spark.read.schema(schema).option("recursiveFileLookup", True).parquet(source))
    got = sorted(map(str, streams.read_latest(spark, f"{tmp_path}/table").select("source_path", "version", "modified_at").collect()))
    assert got == sorted(map(str, whole.select("source_path", "version", "modified_at").collect())) and len(got) == 4
    assert spark.read.parquet(f"{tmp_path}/table").filter("source_path = 'q'").count() == 1  # what lost was never written
    assert spark.conf.get(streams.PROVIDER) != streams.ROCKS
    streams.resumable(stream(), lambda df: df, f"{tmp_path}/out", f"{tmp_path}/state", "s1").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 18


def test_state_has_no_more_parts_than_cores(spark, tmp_path):
    schema, before = "source_path string, version long, modified_at timestamp", spark.conf.get(streams.PARTITIONS)
    spark.createDataFrame([("p", 2, day(1))], schema).coalesce(1).write.parquet(f"{tmp_path}/in/1")
    spark.conf.set(streams.PARTITIONS, "9")
    try:
        query = streams.upsert_latest(spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in"), f"{tmp_path}/table", f"{tmp_path}/up")
        query.awaitTermination()
        assert spark.conf.get(streams.PARTITIONS) == "9"
    finally:
        spark.conf.set(streams.PARTITIONS, before)
    assert {op["numShufflePartitions"] for p in query.recentProgress for op in p["stateOperators"]} == {spark.sparkContext.defaultParallelism}


def test_upsert_in_a_session_that_sets_no_partitions(spark, tmp_path):
    schema, before = "source_path string, version long, modified_at timestamp", spark.conf.get(streams.PARTITIONS)
    spark.createDataFrame([("p", 2, day(1)), ("p", 1, day(1))], schema).coalesce(1).write.parquet(f"{tmp_path}/in/1")
    spark.conf.unset(streams.PARTITIONS)
    try:
        streams.upsert_latest(spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in"), f"{tmp_path}/table", f"{tmp_path}/up").awaitTermination()
        assert spark.conf.get(streams.PARTITIONS, None) is None
    finally:
        spark.conf.set(streams.PARTITIONS, before)
    assert [(r["source_path"], r["version"]) for r in streams.read_latest(spark, f"{tmp_path}/table").collect()] == [("p", 2)]


def test_forgotten_paths_are_passed_on_once_more(spark, tmp_path):
    """With a timer of no time at all, state is gone by the next batch; the log's readers don't mind."""
    schema = "source_path string, version long, modified_at timestamp"
    stream = lambda: spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    for n, row in enumerate([("p", 2, day(1)), ("q", 1, day(1)), ("p", 1, day(9))]):
        spark.createDataFrame([row], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
        query = streams.upsert_latest(stream(), f"{tmp_path}/table", f"{tmp_path}/up", idle=1)
        query.awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/table").filter("source_path = 'p'").count() == 2
    assert {(r["source_path"], r["version"]) for r in streams.read_latest(spark, f"{tmp_path}/table").collect()} == {("p", 2), ("q", 1)}


def test_stream_windows_and_delivery(spark, tmp_path):
    schema = "event_id long, k string, ts timestamp"
    parts = [[(1, "a", day(40)), (1, "a", day(40)), (2, "a", day(39))], [(3, "b", day(20)), (2, "a", day(39))], [(4, "b", day(10)), (3, "b", day(20))], [(9, "a", day(40)), (5, "b", day(0))]]
    for n, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    sink = lambda rows, name: rows.writeStream.format("parquet").option("path", f"{tmp_path}/{name}").option("checkpointLocation", f"{tmp_path}/{name}-progress").trigger(availableNow=True).start()
    query = sink(streams.once(stream, late="19 days 12 hours"), "once")
    query.awaitTermination()
    assert sorted(r["event_id"] for r in spark.read.parquet(f"{tmp_path}/once").collect()) == [1, 2, 3, 4, 5]  # 9 was too late
    told = streams.state_progress(query)
    assert told["late"] == 1 and told["kept"] <= 4  # the key of the first day is gone
    query = streams.append_activity(stream, ["k"], f"{tmp_path}/days", f"{tmp_path}/days-progress", late="5 days")
    query.awaitTermination()
    days = spark.read.parquet(f"{tmp_path}/days")
    assert {(r["day"], r["k"], r["events"]) for r in days.collect()} == {(day(40), "a", 2), (day(39), "a", 2), (day(20), "b", 2), (day(10), "b", 1)}
    told = streams.state_progress(query)
    assert told["late"] >= 1 and told["removed"] == days.count() and told["kept"] >= 1  # day 0 is still open
    got = {r["k"]: (r["last_25d"], r["last_60d"]) for r in streams.sliding(days, ["k"], (25, 60), now()).collect()}
    assert got["a"][0] == 0 and got["b"] == (3, 3)


def test_registry_is_consistent():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_scratch_without_a_shared_folder(spark, monkeypatch):
    from archivelens.functions import scratch

    class Unset:
        conf = type("conf", (), {"get": staticmethod(lambda key, default: default)})
        sparkContext = type("context", (), {"getCheckpointDir": staticmethod(lambda: None), "master": "local[2]", "applicationId": "some", "setCheckpointDir": staticmethod(lambda path: None)})

    first = scratch.shared_dir(Unset)
    assert first.startswith("file://") and scratch.shared_dir(Unset) == first
    monkeypatch.setattr(Unset.sparkContext, "master", "spark://some:7077")
    with pytest.raises(ValueError):
        scratch.shared_dir(Unset)
    monkeypatch.setattr(Unset.sparkContext, "getCheckpointDir", staticmethod(lambda: "file:///set/"))
    assert scratch.shared_dir(Unset) == "file:///set"
    table = scratch.stored(spark.range(5), "numbers")
    files = table.inputFiles()
    scratch.release(table)
    assert files and not any(__import__("os").path.exists(f.replace("file://", "")) for f in files)


def test_outline_and_placeholders(spark):
    rows = text.outline(spark.createDataFrame([(1, "1. Plan\n - first\n1.1 second\n\n2) Build\n\tthird\nalone")], "doc_id int, text string")).orderBy("line_no").collect()
    assert [(r["level"], r["label"], r["parent"]) for r in rows] == [(1, "Plan", None), (2, "first", "Plan"), (2, "second", "Plan"), (1, "Build", None), (2, "third", "Build"), (1, "alone", None)]
    hits = spark.createDataFrame([(1, "a", 2, 0.6, True), (1, "b", 1, 0.9, False), (2, "c", 1, 0.7, True), (2, "d", 1, 0.7, False)], "query_id int, source_path string, source_hits int, similarity double, p boolean")
    assert [(r["query_id"], r["sources"]) for r in search.placeholder_only(hits, F.col("p")).collect()] == [(1, "a")]


def test_text_hits_need_a_source_term(spark):
    chunks = spark.createDataFrame([(1, "budget.docx", "x/budget.docx", "the roof leaks"), (2, "other.docx", "x/other.docx", "the roof leaks")], "chunk_id int, file_name string, source_path string, chunk_text string")
    terms = spark.createDataFrame([(1, "budget"), (1, "roof"), (2, "budget")], "query_id int, term string")
    own = search.indexed_terms(terms, search.index(chunks))
    assert [(r["query_id"], r["chunk_id"], r["content_hits"]) for r in search.text_hits_with_source(terms, own, chunks).collect()] == [(1, 1, 1)]


def test_results_do_not_depend_on_partitions(spark):
    rows = files(spark, [(f"p{i % 3}/doc_{i % 40}_v{i % 5}.md", i, i % 50) for i in range(120)]).withColumn("doc_id", F.monotonically_increasing_id()).dropDuplicates(["path"])
    for f in (lambda d: dedup.versions(d), lambda d: dedup.families(d), lambda d: catalog.recent_files(d), lambda d: catalog.review_candidates(d)):
        columns = [c for c in f(rows).columns if c != "doc_id"]
        assert {tuple(map(str, r)) for r in f(rows).select(columns).collect()} == {tuple(map(str, r)) for r in f(rows.repartition(7)).select(columns).collect()}


def test_date_ranking_reads_a_number(spark):
    chunks = spark.createDataFrame([(f"p{i}", day(i)) for i in range(9)], "source_path string, modified_at timestamp")
    asked = spark.createDataFrame([(1, "latest 2"), (2, "latest")], "query_id int, text string")
    got = [(r["query_id"], r["source_path"]) for r in search.date_ranking(F.col("text"), chunks, asked).orderBy("query_id", "rank").collect()]
    assert got == [(1, "p0"), (1, "p1"), *[(2, f"p{i}") for i in range(5)]]


def test_similar_names_and_clusters(spark):
    rows = files(spark, [("a/budget plan 1.docx", 1, 1), ("a/budget plan 2.docx", 1, 2), ("a/zebra.md", 1, 3), ("b/budget plan 3.docx", 1, 1)])
    kept = {r["path"] for r in dedup.similar_names(rows, paths.parent(F.col("path"))).filter("kept").collect()}
    assert kept == {"a/budget plan 1.docx", "a/zebra.md", "b/budget plan 3.docx"}
    own = files(spark, [("p/design_v1.docx", 1, 1), ("p/design_v2.docx", 1, 2), ("p/other.md", 1, 300)]).withColumn("doc_id", F.when(F.col("path").contains("v1"), 1).when(F.col("path").contains("v2"), 2).otherwise(3))
    assert {(r["doc_id"], r["cluster"]) for r in cluster.work_clusters(own).collect()} == {(1, 1), (2, 1), (3, 3)}


def test_document_profile(spark):
    rows = [(1, "Acme Systems/misc/onboarding-website build_v2.docx", "training course", day(3)), (2, None, None, None), (3, "a/123_v1.md", None, day(1))]
    own = spark.createDataFrame(rows, "doc_id long, path string, summary string, modified_at timestamp")
    got = {r["doc_id"]: r for r in cluster.profiles(own.withColumn("path", F.replace("path", F.lit("Acme Systems"), F.lit("AcmeSystems"))), summary=F.col("summary")).collect()}
    assert got[1]["folders"] == ["AcmeSystems", "misc"] and got[1]["orgs"] == ["acmesystems"] and got[1]["family"] == "onboarding website build"
    assert got[1]["tokens"] == ["build", "onboarding", "website"] and got[1]["keywords"] == got[1]["tokens"]
    assert got[1]["category"] == "Education"  # three words against two
    assert (got[2]["family"], got[2]["tokens"], got[2]["folders"], got[2]["category"], got[2]["day"]) == ("", [], [], "General", None)
    assert (got[3]["family"], got[3]["tokens"]) == ("123", [])
    assert {r["doc_id"]: r["cluster"] for r in cluster.work_clusters(own.unionByName(own)).collect()} == {1: 1, 2: 2, 3: 3}
    assert cluster.work_clusters(own.limit(0)).count() == 0


def test_chains_join_short_names(spark):
    """Among many long names short ones are in different heaps, where none is near their length."""
    own = spark.range(6010).select("id", F.concat(F.lit("doc "), F.when(F.col("id") < 10, F.col("id")).otherwise(F.col("id") + 1000000)).alias("family"), F.lit(0).alias("shape"))
    rest = spark.createDataFrame([(0, 0, cluster.LINKED - cluster.ALIKE)], "a int, b int, score int")
    links = cluster._chains(rest, own, held=512).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))
    found = cluster.graph.connected_components(links).filter("node < 10")
    assert {(r["node"], r["component"]) for r in found.collect()} == {(k, 0) for k in range(10)}


def test_texts_of_a_profile_are_read_once(spark):
    own = spark.createDataFrame([(1, "a/b.md", "Sales budget invoice", day(1))], "doc_id long, path string, summary string, modified_at timestamp")
    profile = cluster.profiles(own, summary=F.col("summary"))
    assert profile.head()["category"] == "Finance"
    plan = profile._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(concat_ws( , coalesce(path") + plan.count("lower(concat_ws( , __path") == 1


def test_alike_sets_meet_in_cells(spark, monkeypatch):
    """Near copies that all pair: sets go to cells, not along with each pair."""
    random = np.random.default_rng(3)
    rows = [(g, f"w{g}x{k}") for g in range(6) for k in range(30)]
    words = {g: [w for h, w in rows if h == g] for g in range(6)}
    texts = [(n, " ".join(words[n % 6][: 30 - int(random.integers(0, 4))]) + f" own{n}" + " plus" * int(random.integers(0, 2))) for n in range(150)]
    docs = spark.createDataFrame([*texts, (900, texts[0][1]), (5, texts[1][1]), (901, "lone"), (902, None)], "doc_id long, text string")
    held = [(i, frozenset(t.split())) for i, t in [*texts, (5, texts[1][1])]]
    first = {}
    for i, own in held:
        first[own] = min(i, first.get(own, i))
    classes = [(i, own) for own, i in first.items()]
    wanted = {(min(i, j), max(i, j), len(x & y), len(x | y)) for i, x in classes for j, y in classes if i != j and 100 * len(x & y) >= 80 * len(x | y)}
    for load in (1 << 21, 2048 * 7, 1):
        monkeypatch.setattr(dedup, "LOAD", load)
        found = dedup.jaccard_pairs(docs)
        got = [tuple(r) for r in found.collect()]
        assert len(got) == len(set(got)) and set(got) == wanted and len(wanted) > 1000
        assert "hashes_i" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_the_walk_reads_pairs_that_are_stored(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(dedup, "remove_similar", lambda docs, pairs: seen.append(pairs) or docs)
    text = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, text, day(1)), (2, f"{text} more", day(2))], "doc_id long, text string, modified_at timestamp")
    dedup.near_dup_removed(docs)
    assert [sorted(r) for r in seen[0].collect()] == [[1, 2]]
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "InArrow" not in plan and "hashes" not in plan


def test_clusters_are_described_from_profiles_made_once(spark):
    own = spark.createDataFrame([(1, "a/b.md", "Sales budget invoice", day(1)), (2, "a/c.md", "budget", day(2))], "doc_id long, path string, summary string, modified_at timestamp")
    out = cluster.describe_clusters(own.select("doc_id", F.lit(7).alias("cluster")), cluster.profiles(own, summary=F.col("summary")))
    assert [(r["cluster"], r["docs"], r["category"]) for r in out.collect()] == [(7, 2, "Finance")]
    assert "lower(concat_ws" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_kinds_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(cluster, "BLOCK", 3)
    own = spark.createDataFrame([(i, f"f{i}", i % 3 if i < 20 else 3) for i in range(21)], "id long, family string, shape int")
    rest = spark.createDataFrame([(0, 0, 31), (0, 1, 32), (2, 3, 33)], "a int, b int, score int")
    got = [(r["id_a"], r["id_b"], r["family_b"], r["score"]) for r in cluster._met(rest, own).collect()]
    ids = {k: [i for i in range(21) if (i % 3 if i < 20 else 3) == k] for k in range(4)}
    assert sorted(got) == sorted((i, j, f"f{j}", s) for a, b, s in ((0, 0, 31), (0, 1, 32), (2, 3, 33)) for i in ids[a] for j in ids[b])


def test_clusters_equal_all_pairs(spark, monkeypatch):
    from difflib import SequenceMatcher

    random = np.random.default_rng(6)
    words = [f"t{c}" for c in "abcdefghijklmn"]
    rows = [(f"f{random.integers(0, 5)}/" + "_".join(random.choice(words, random.integers(1, 5), False)) + f"_v{random.integers(1, 4)}.md", int(random.integers(0, 200))) for _ in range(60)]
    rows += [(f"g/{n}.md", d) for n, d in (("123", 3), ("124", 3), ("doc_4_v2", 9), ("doc_5_v1", 90), ("doc_7_v2", 180))]
    # containers: kinds whose own files aren't always linked; organisations, categories and alike families
    folders = ("misc", "old", "acmegroup", "acmegroup/misc", "zetabank", "h/budget", "h")
    stems = ("zza", "zzb_v1", "archive", "archive_v2", "12", "13_v1", "budgetplan", "budgetplans", "budgetplano", "salesboard", "campaigns", "zzcontract", "temp")
    rows += [(f"{random.choice(folders)}/{random.choice(stems)}.md", int(random.integers(0, 120))) for _ in range(90)]
    rows += [rows[-1], rows[-2], (None, 5), ("misc/zza.md", None), ("misc/zza.md", None)]
    own = spark.createDataFrame([(i, p, None if d is None else day(d)) for i, (p, d) in enumerate(rows)], "doc_id long, path string, modified_at timestamp")
    facts = {r["doc_id"]: {k: set(v) if isinstance(v, list) else v for k, v in r.asDict().items()} for r in cluster.profiles(own).collect()}
    label, used = list(range(len(rows))), set()
    for i in range(len(rows)):
        for j in range(i):
            a, b = facts[i], facts[j]
            x, y = a["tokens"], b["tokens"]
            days = abs((a["day"] - b["day"]).days) if a["day"] and b["day"] else 99
            score = round(25 * len(x & y) / len(x | y)) if x | y else 0
            equal = a["family"] == b["family"] != ""
            alike = not equal and SequenceMatcher(None, *sorted((a["family"], b["family"]))).ratio() >= 0.72 and a["family"] != b["family"]
            shared = a["folders"] & b["folders"]
            parts = {
                "equal": 22 * equal, "alike": 14 * alike, "keywords": min(18, 6 * len(a["keywords"] & b["keywords"])), "orgs": min(15, 15 * len(a["orgs"] & b["orgs"])),
                "folder": (-12 if shared <= set(cluster.CONTAINERS) else 10) if shared else 0, "category": 10 * (a["category"] == b["category"] != "General"),
                "named": -20 * bool({a["family"], b["family"]} & set(cluster.CONTAINERS)), "days": 10 if days <= 7 else 6 if days <= 30 else 0,
            }
            total = score + sum(parts.values())
            used |= {k for k, v in parts.items() if (total >= 45) != (total - v >= 45)}  # points that decide
            if total >= 45:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if v == old else v for v in label]
    assert used == {"equal", "alike", "keywords", "orgs", "folder", "category", "named", "days"}
    for block in (512, 3):
        monkeypatch.setattr(cluster, "BLOCK", block, raising=False)
        got = {r["doc_id"]: r["cluster"] for r in cluster.work_clusters(own).collect()}
        assert {i: v for i, v in got.items() if v != label[i]} == {} and len(got) == len(rows)
    assert 10 < len(set(label)) < 100
