"""Archives as a source, chunkers as table functions, phrases, templates, units and set identities."""

import zipfile
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from archivelens.functions import text
from archivelens.operators import chunking, cluster, comms, phrases, rules
from archivelens.sources import archives, packages


def test_one_large_archive_is_many_partitions(spark, tmp_path):
    random = np.random.default_rng(1)
    mails = {f"box/{i}.eml": b"From: a@x.org\r\nTo: b@x.org\r\nSubject: s%d\r\n\r\n" % i + random.bytes(300).hex().encode() for i in range(1000)}
    with zipfile.ZipFile(tmp_path / "mails.ZIP", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("box/", b"")
        for name, data in mails.items():
            z.writestr(name, data)
        z.writestr("note.txt", b"not a mail")
    with zipfile.ZipFile(tmp_path / "small.zip", "w") as z:
        z.writestr("bad.eml", b"x" * 50)
    data = bytearray((tmp_path / "small.zip").read_bytes())
    data[40] ^= 0xFF  # its checksum no longer holds
    (tmp_path / "small.zip").write_bytes(data)
    (tmp_path / "broken.zip").write_bytes(b"no archive" * 10_000)
    rows = archives.members(spark, str(tmp_path), split=20_000)
    assert rows.rdd.getNumPartitions() > 10
    got = {(r["path"].split("/")[-1], r["member"]): r for r in rows.collect()}
    assert {m: bytes(r["content"]) for (p, m), r in got.items() if p == "mails.ZIP" and m != "note.txt"} == mails
    assert "Bad" in got["small.zip", "bad.eml"]["error"] and got["small.zip", "bad.eml"]["content"] is None
    assert "BadZipFile" in got["broken.zip", None]["error"] and len(got) == 1003
    only = archives.members(spark, f"file://{tmp_path}/mails.ZIP", suffix=".txt", most=5)
    assert [(r["member"], "more than 5" in r["error"]) for r in only.collect()] == [("note.txt", True)]
    read = comms.read_mails(archives.as_files(archives.members(spark, f"{tmp_path}/mails.ZIP", suffix=".eml", split=20_000)))
    assert read.filter("error is null and subject like 's%'").count() == 1000
    (tmp_path / "none").mkdir()
    assert archives.members(spark, f"{tmp_path}/none").count() == 0


def test_archives_are_written_in_streams(spark, tmp_path):
    rows = spark.createDataFrame([(f"m{i}", f"text {i}".encode()) for i in range(50)] + [("empty", None), (None, b"x")], "member string, content binary")
    done = archives.write(rows, f"{tmp_path}/out", 3).collect()
    assert len(done) == 3 and sum(r["members"] for r in done) == 51 and len(list(tmp_path.glob("out/*"))) == 3
    got = {r["member"]: bytes(r["content"]) for r in archives.members(spark, f"{tmp_path}/out").collect()}
    assert got == {**{f"m{i}": f"text {i}".encode() for i in range(50)}, "empty": b""}


def test_table_functions_cut_as_the_plain_ones(spark):
    random = np.random.default_rng(6)
    line = lambda n: "".join(random.choice(list("abc de"), n))
    texts = ["\n\n".join(line(n) for n in random.integers(0, 1500, k)) for k in (0, 1, 3, 9)] + [None, "", "x" * 2000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    chunking.register(spark)
    docs.createOrReplaceTempView("function_docs")
    wanted = sorted(map(tuple, chunking.chunk(docs).collect()))
    sql = spark.sql("SELECT doc_id, chunk_index, chunk_text FROM function_docs, LATERAL paragraph_chunks(text)")
    assert sorted(map(tuple, sql.collect())) == wanted and len(wanted) > 10
    own = F.udtf(chunking.ParagraphChunks, returnType="chunk_index int, chunk_text string")
    assert sorted(map(tuple, docs.lateralJoin(own(F.col("text").outer())).select("doc_id", "chunk_index", "chunk_text").collect())) == wanted
    sheets = {f"s{k}": [f"head {k}", *[line(n) for n in random.integers(0, 900, rows)]] for k, rows in enumerate((0, 1, 5, 40))} | {"long": ["h" * 1500], "blank": [" ", None]}
    rows = [(s, i, x) for s, lines in sheets.items() for i, x in enumerate(lines)]
    spark.createDataFrame([rows[i] for i in random.permutation(len(rows))], "sheet string, n int, line string").createOrReplaceTempView("function_lines")
    got = defaultdict(list)
    for r in spark.sql("SELECT * FROM sheet_chunks(TABLE(function_lines) PARTITION BY sheet ORDER BY n)").collect():
        got[r["sheet"]].append((r["chunk_index"], r["chunk_text"]))
    assert {s: [x for _, x in sorted(c)] for s, c in got.items()} == {s: chunking.cut_rows("\n".join(x or "" for x in lines)) for s, lines in sheets.items() if s != "blank"}


def test_phrases_equal_counting(spark):
    random = np.random.default_rng(4)
    words = ["the", "budget", "plan", "of", "march", "Ünit", "x1"]
    texts = [(i // 2, " ".join(random.choice(words, random.integers(0, 14)))) for i in range(120)] + [(500, None), (None, "budget plan")]
    docs = spark.createDataFrame([(*t, 1) for t in texts], "doc_id long, text string, pos int")
    for least, longest, stop in ((6, 4, ()), (9, 3, ("the", "of"))):
        held = defaultdict(set)
        for i, t in texts:
            own = (t or "").lower().split()
            for k in range(1, longest + 1):
                for at in range(len(own) - k + 1):
                    if i is not None:
                        held[i].add(tuple(own[at : at + k]))
        df = Counter(p for own in held.values() for p in own)
        wanted = {(i, " ".join(p), len(p), df[p]) for i, own in held.items() for p in own if len(p) > 1 and df[p] >= least and p[0] not in stop and p[-1] not in stop}
        got = phrases.occurrences(docs, least, longest, stop).collect()
        assert {tuple(r) for r in got} == wanted and len(got) == len(wanted) > 20
        best = {i: min((-k, -n, p) for j, p, k, n in wanted if j == i)[2] for i, *_ in wanted}
        assert {r["doc_id"]: r["phrase"] for r in phrases.longest_phrase(docs, least, longest, stop).collect()} == best
    assert phrases.longest_phrase(docs.limit(0)).count() == 0


def test_phrases_are_counted_without_a_table_of_places(spark, monkeypatch):
    """What is stored is a row a document and the frequent phrases; a set that lets everything pass changes nothing."""
    random, kept, stored = np.random.default_rng(5), [], phrases.scratch.stored
    docs = spark.createDataFrame([(i, " ".join(random.choice(list("abcdefgh"), 60))) for i in range(40)], "doc_id long, text string")
    whole = sorted(map(tuple, phrases.occurrences(docs, 12, 3).collect()))
    monkeypatch.setattr(phrases.scratch, "stored", lambda df, name, *a: kept.append(stored(df, name, *a)) or kept[-1])
    monkeypatch.setattr(phrases, "_set", lambda found: b"\xff" * (1 << phrases.SLOTS >> 3))
    assert sorted(map(tuple, phrases.occurrences(docs, 12, 3).collect())) == whole and len(whole) > 100
    assert max(t.count() for t in kept) < 600  # 2,400 places


def test_cluster_names(spark):
    rows = [(1, 1, "AcmeGroup/a/budget plan.md", "finance"), (2, 1, "AcmeGroup/a/plan of budget_v2.md", "invoice"), (3, 2, "b/unit one.md", ""), (4, 2, "b/unit two.md", ""), (5, 3, "misc/archive.md", ""), (6, 4, "x/Alpha.md", ""), (7, 5, "y/q 1.md", ""), (8, 5, "y/q 2.md", "")]
    files = spark.createDataFrame([(i, p, s, None) for i, _, p, s in rows], "doc_id long, path string, summary string, modified_at timestamp")
    members = spark.createDataFrame([(i, c) for i, c, *_ in rows], "doc_id long, cluster long")
    profile = cluster.profiles(files, summary=F.col("summary"))
    got = {r["cluster"]: (r["docs"], r["category"], r["name"]) for r in cluster.describe_clusters(members, profile).collect()}
    assert got == {1: (2, "Finance", "budget plan"), 2: (2, "General", "unit"), 3: (1, "General", "Other"), 4: (1, "General", "Alpha"), 5: (2, "General", "q")}
    told = spark.createDataFrame([(1, "yearly budget"), (2, "yearly budget"), (3, "acmegroup")], "doc_id long, phrase string")
    named = {r["cluster"]: r["name"] for r in cluster.describe_clusters(members, profile, told).collect()}
    assert named[1] == "acmegroup yearly budget" and named[2] == "acmegroup" and named[4] == "Alpha"


def test_templates_and_steps(spark):
    table = spark.createDataFrame([("T1", "report", "a > b"), ("T2", "Final Report", "c"), ("T3", "plan", "d")], "template string, key string, steps string")
    groups = spark.createDataFrame([("my final report plan",), ("PLAN",), ("none",), (None,), ("report x",)], "grp string")
    got = {r["grp"]: (r["key"], r["template"]) for r in rules.longest_key(groups, "grp", table).collect()}
    assert got == {"my final report plan": ("final report", "T2"), "PLAN": ("plan", "T3"), "none": (None, None), None: (None, None), "report x": ("report", "T1")}
    found = spark.createDataFrame([("report x", "draft", 1), ("report x", "check", 2), ("PLAN", "draft", 1)], "grp string, label string, rule_order int")
    got = {r["grp"]: (r["steps"], r["source"]) for r in rules.workflow_or_template(found, groups.filter("grp is not null"), "grp", table).collect()}
    assert got == {"report x": ("draft > check", "inferred"), "PLAN": ("d", "template"), "none": ("", "none"), "my final report plan": ("c", "template")}


def test_unit_candidates(spark):
    rows = [
        ("cluster", 1, "archive", None, "web renewal 2024"), ("cluster", 1, "archive", None, "notes"), ("cluster", 2, "Hiring 2024", None, "list"), ("cluster", 3, "misc", None, "NordBank_a"), ("cluster", 4, "zzz", None, None),
        ("family", 1, "contract one", None, "contract one v2"), ("family", 2, "AcmeGroup", None, "AcmeGroup x"), ("project", 1, "temp", "Acme Inc", "AcmeGroup y"), ("project", 2, "salary", None, "x"),
    ]
    found = cluster.unit_candidates(spark.createDataFrame(rows, "kind string, ord int, name string, client string, doc_name string"))
    got = {(r["kind"], r["ord"]): (r["unit_type"], r["name"], r["confidence"]) for r in found.collect()}
    assert got == {
        ("cluster", 1): ("project", "web renewal", 96), ("cluster", 2): ("function", "Hiring 2024", 86), ("cluster", 3): ("customer", "NordBank", 78), ("cluster", 4): ("document_set", "zzz set", 58),
        ("family", 1): ("document_set", "contract set", 72), ("family", 2): ("document_set", "AcmeGroup set", 79), ("project", 1): ("customer", "Acme Inc", 79), ("project", 2): ("function", "salary", 82),
    }
    units = cluster.ranked_units(cluster.resolve_units(found)).orderBy("rank").collect()
    assert [u["unit_type"] for u in units] == ["project", "function", "function", "customer", "customer", *["document_set"] * 3] and units[0]["name"] == "web renewal"
    assert [(u["name"], u["confidence"]) for u in cluster.ranked_units(cluster.resolve_units(found.limit(0))).collect()] == [("document set", 30)]


def test_similar_units_lose_all_generic_words(spark):
    units = spark.createDataFrame([(n, [e]) for n, e in (("alpha work project", "a"), ("Alpha", "b"), ("beta_task", "c"), ("work", "d"), ("new alpha", "e"), (None, "f"))], "name string, evidence array<string>")
    got = {r["name"]: r["evidence"] for r in cluster.merge_similar_units(units).collect()}
    assert got == {"Alpha": ["a", "b", "e"], "beta_task": ["c"], "work": ["d"]}


def test_set_identity_and_valid_entries(spark):
    rows = spark.createDataFrame([("s", 1, "a"), ("s", 2, None), ("s", 2, None), ("t", 1, "a")], "k string, n int, v string")
    ids = lambda df: {r["k"]: (r["size"], r["identity"]) for r in packages.set_identity(df, ["k"], ["n", "v"]).collect()}
    first = ids(rows)
    assert first == ids(rows.orderBy(F.desc("n")).repartition(3)) and first["s"][0] == 3
    assert ids(rows.distinct())["s"] != first["s"] and ids(rows.withColumn("v", F.lit("a")))["s"] != first["s"] and ids(rows)["t"] == first["t"]
    asked = spark.createDataFrame([("a", "h1"), ("b", "h1"), ("c", "h1"), (None, "h1")], "key string, hash string")
    cache = spark.createDataFrame([("a", "h1", {"x": "1", "y": "2"}), ("b", "h2", {"x": "1", "y": "2"}), ("c", "h1", {"x": "1"})], "key string, hash string, values map<string,string>")
    assert [r["key"] for r in packages.valid_entries(asked, cache, "key", ["x", "y"]).collect()] == ["a"]


def test_unfinished_json(spark):
    raw = ['{"primary": {"answer": "He said \\"hi\\"\\n and', '{"answer": "x"', '{"primary": {"a": 1, "answer" : "\\u00e9\\u00', '{"other": 1}', None, '{"answer":"no", "primary":{"answer":"tab\\tand \\q end"}}', '{"answer": "line\nbreak']
    got = [r["y"] for r in spark.createDataFrame([(i, t) for i, t in enumerate(raw)], "i int, t string").select("i", text.json_prefix(F.col("t")).alias("y")).orderBy("i").collect()]
    assert got == ['He said "hi"\n and', "x", "é", "", None, "tab\tand q end", "line\nbreak"]


def test_embedder_that_returns_too_few(spark):
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(5)], "i int, chunk_text string").coalesce(1)
    few = lambda texts: [[1.0]] * (len(texts) - (len(texts) > 1))
    got = packages.embed(rows, few).collect()
    assert len(got) == 5 and all(r["embedding"] == [1.0] and r["error"] is None for r in got)
    none = packages.embed(rows, lambda texts: []).collect()
    assert len(none) == 5 and all(r["embedding"] is None and "0 vectors for 1 texts" in r["error"] for r in none)
