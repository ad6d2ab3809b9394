"""Queries of contacts, scores, rules, clusters, audits and streams with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archivelens.functions import names, paths
from archivelens.operators import audit, cluster, comms, dedup, phrases, rules, scoring
from archivelens.plans.catalog_queries import NOW
from archivelens.plans.catalog_queries import query as _query
from archivelens.sources import adapters as A
from archivelens.sources.adapters import FILES

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    return _query(sql, QUERIES, SQL)


def _items(spark: SparkSession, d: str) -> DataFrame:
    rows = A.table(spark, d, "events")
    user = lambda n: F.concat(F.lit("User"), n.cast("string"), F.lit("@x.org"))
    return rows.select(F.col("event_id").alias("item_id"), F.when(F.col("event_id") % 4 == 0, "chat").otherwise("mail").alias("kind"), "ts", F.col("event_type").alias("text"), user(F.col("user_id")).alias("sender"), F.array(user(F.col("user_id") * 7 % 40), user(F.col("event_id") % 25)).alias("recipients"))


ITEMS = """items AS (SELECT event_id AS item_id, CASE WHEN event_id % 4 = 0 THEN 'chat' ELSE 'mail' END AS kind, ts, event_type AS text, 'User' || user_id || '@x.org' AS sender,
  ['User' || (user_id * 7 % 40) || '@x.org', 'User' || (event_id % 25) || '@x.org'] AS recipients FROM events)"""
LAST = "TIMESTAMP '2024-01-31 00:00:00'"


@query(f"""WITH {ITEMS}, people AS (SELECT kind, ts, text, unnest(list_append(recipients, sender)) AS who FROM items)
SELECT CASE WHEN kind = 'chat' THEN 'messenger:' || lower(who) ELSE lower(who) END AS contact, count(*) AS items, count(*) FILTER (contains(lower(text), 'purchase')) AS work,
  count(*) FILTER (ts <= {LAST} AND ts >= {LAST} - to_days(1)) AS last_1d, count(*) FILTER (ts <= {LAST} AND ts >= {LAST} - to_days(7)) AS last_7d, count(*) FILTER (ts <= {LAST} AND ts >= {LAST} - to_days(30)) AS last_30d
FROM people GROUP BY contact ORDER BY work DESC, last_1d DESC, last_7d DESC, last_30d DESC, contact LIMIT 10""")
def contacts(spark: SparkSession, d: str) -> DataFrame:
    return comms.contacts(_items(spark, d), F.to_timestamp(F.lit("2024-01-31 00:00:00")), (1, 7, 30), ("purchase",))


@query(f"""WITH {ITEMS}, sent AS (SELECT lower(sender) AS contact, count(*) AS sent FROM items GROUP BY 1), got AS (SELECT lower(r) AS contact, count(*) AS received FROM (SELECT unnest(recipients) AS r FROM items) GROUP BY 1),
ranked AS (SELECT *, rank() OVER (ORDER BY least(sent, received) DESC, sent + received DESC) AS p FROM sent JOIN got USING (contact))
SELECT contact, sent, received FROM ranked WHERE p = 1 AND (SELECT count(*) FROM ranked WHERE p = 1) = 1""")
def self_guess(spark: SparkSession, d: str) -> DataFrame:
    return comms.guess_self(_items(spark, d))


@query(f"WITH {ITEMS} SELECT item_id, kind, sender, rank FROM (SELECT *, row_number() OVER (PARTITION BY kind, sender ORDER BY ts DESC, item_id)::INT AS rank FROM items) WHERE rank <= 5")
def recent_items(spark: SparkSession, d: str) -> DataFrame:
    return comms.recent_items(_items(spark, d), ["kind", "sender"]).select("item_id", "kind", "sender", "rank")


@query(f"""WITH {ITEMS}, p AS (SELECT *, row_number() OVER (PARTITION BY sender ORDER BY (text = 'purchase') DESC, ts DESC, item_id) AS pick FROM items)
SELECT item_id, sender, text = 'purchase' AS matched, row_number() OVER (PARTITION BY sender ORDER BY ts DESC, item_id)::INT AS rank FROM p WHERE pick <= 10""")
def mail_selection(spark: SparkSession, d: str) -> DataFrame:
    return comms.select_relevant(_items(spark, d), ["sender"], F.col("text") == "purchase").select("item_id", "sender", "matched", "rank")


BLOCKS = """own AS (SELECT conv_id AS source_file, turn AS line_no, text AS message, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations),
near AS (SELECT *, max(contains(message, 'the')::INT) OVER (PARTITION BY source_file ORDER BY line_no ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near FROM own),
gaps AS (SELECT *, CASE WHEN place - lag(place) OVER (PARTITION BY source_file ORDER BY line_no) > 1 THEN 1 ELSE 0 END AS gap FROM near WHERE near = 1),
blocks AS (SELECT source_file, line_no, place, (sum(gap) OVER (PARTITION BY source_file ORDER BY line_no) + 1)::BIGINT AS block_no FROM gaps)"""


@query(f"WITH {BLOCKS} SELECT source_file, line_no, block_no FROM blocks")
def chat_blocks(spark: SparkSession, d: str) -> DataFrame:
    return comms.chat_blocks(A.messages(spark, d), F.contains("message", F.lit("the")), around=1).select("source_file", "line_no", F.col("block_no").cast("long").alias("block_no"))


@query(f"""WITH RECURSIVE {BLOCKS},
bounds AS (SELECT *, last - first + 1 AS n, row_number() OVER (PARTITION BY source_file ORDER BY first DESC) AS k FROM (SELECT source_file, min(place) AS first, max(place) AS last FROM blocks GROUP BY source_file, block_no)),
walk AS (SELECT DISTINCT source_file, 0::BIGINT AS k, 4::BIGINT AS room, 0::BIGINT AS first, 0::BIGINT AS last, false AS taken FROM bounds UNION ALL
  SELECT b.source_file, b.k, CASE WHEN n <= room THEN room - n ELSE room END, b.first, b.last, n <= room FROM walk w JOIN bounds b ON b.source_file = w.source_file AND b.k = w.k + 1),
marked AS (SELECT o.source_file, o.line_no, o.place, w.taken IS NOT NULL AS hit FROM own o LEFT JOIN walk w ON w.taken AND w.source_file = o.source_file AND o.place BETWEEN w.first AND w.last),
filled AS (SELECT *, sum(hit::INT) OVER (PARTITION BY source_file) AS used, row_number() OVER (PARTITION BY source_file ORDER BY hit, place DESC) AS fill FROM marked)
SELECT source_file, line_no, coalesce(place - lag(place) OVER (PARTITION BY source_file ORDER BY place) > 1, false) AS gap FROM filled WHERE hit OR fill <= 4 - used""")
def chat_context(spark: SparkSession, d: str) -> DataFrame:
    return comms.chat_context(A.messages(spark, d), F.contains("message", F.lit("the")), around=1, budget=4)


W = scoring.Words()


def _has(target: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({target}, '{w}')" for w in words) + ")"


#: Names as people give them: states, dates, versions of any length, copies, and look-alikes of versions.
KINDS = (
    "final_report {b}", "draft_plan {b}", "sample {b}", "contract {b}_v5", "meeting_note {b}", "old_review {b}", "design {b}_final", "data {b}",
    "2026-06-01 plan {b}", "plan {b}_version3", "plan_{b}_v20251231235959", "serv3r {b}", "contract {b} v5.10", "contract {b} ver 5.9", "plan {b}-copy", "plan {b} final_kim",
)


def _named(spark: SparkSession, d: str) -> DataFrame:
    """Files under telling names (several of a family), each in a folder of its own."""
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("doc_id") % 16 + 1).cast("int"))
    folder = F.element_at(F.array(F.lit("project"), F.lit("backup"), F.lit("misc")), (F.col("doc_id") % 3 + 1).cast("int"))
    ext = F.element_at(F.array(F.lit(".docx"), F.lit(".pdf"), F.lit(".md"), F.lit(".xlsx"), F.lit(".tmp")), (F.col("doc_id") % 5 + 1).cast("int"))
    name = F.concat(F.replace(kind, F.lit("{b}"), F.concat(F.lit("b"), F.expr("doc_id div 16 % 40"))), ext)
    files = A.files(spark, d, text=True)
    return files.withColumn("name", name).withColumn("path", F.concat_ws("/", paths.top(F.col("path")), folder, F.concat(F.lit("d"), "doc_id"), name))


#: Version of a lower-cased stem as numbers, its points, and a stem's family, for names in ASCII.
_VERSIONS = r"regexp_extract_all(low_stem, '(?:^|[^a-z0-9])v(?:er(?:sion)?)?\.?\s*([0-9]+(?:\.[0-9]+)*)\b', 1)"
VERSION = f"list_sort(list_transform({_VERSIONS}, lambda v: list_transform(string_split(v, '.'), lambda n: n::HUGEINT)), 'DESC')[1]"


def _points(base: int) -> str:
    return f"CASE WHEN version IS NULL THEN 0 ELSE least(10, version[1] + {base} + (len(version) > 1)::INT) END"


def _family(stem: str) -> str:
    out = stem
    word = r"(^|[_\-\s])(?:final|copy|old|backup|draft|sample)(?:[_\-\s]|$)"
    for pattern, instead in ((r"(^|[^0-9])(?:19|20)[0-9]{2}[-_.]?[0-9]{2}[-_.]?[0-9]{2}($|[^0-9])", r"\1\2"), (r"(?:^|[_\-\s])v(?:er(?:sion)?)?\.?\s*[0-9]+(?:\.[0-9]+)*\b", " "), (word, " "), (word, " "), (r"[_\-\s]+(?:member|leader|manager|admin)$", ""), (r"[_\-\s]+", " ")):
        out = f"regexp_replace({out}, '{pattern}', '{instead}', 'gi')"
    return f"coalesce(nullif(trim({out}), ''), {stem})"


NAMED = f"""{FILES}, named AS (SELECT *, lower(top || '/' || folder || '/d' || doc_id) AS low_folder, lower(name) AS low_name, left(name, length(name) - length(ext)) AS stem, lower(left(name, length(name) - length(ext))) AS low_stem FROM (
  SELECT doc_id, text, top, folder, modified_at, created_at, size_bytes, ext2 AS ext, name2 AS name, top || '/' || folder || '/d' || doc_id || '/' || name2 AS path FROM (SELECT *, replace(kind, '{{b}}', 'b' || (doc_id // 16 % 40)) || ext2 AS name2 FROM (
    SELECT *, list_value({", ".join(f"'{k}'" for k in KINDS)})[(doc_id % 16 + 1)::INT] AS kind,
      list_value('project', 'backup', 'misc')[(doc_id % 3 + 1)::INT] AS folder, list_value('.docx', '.pdf', '.md', '.xlsx', '.tmp')[(doc_id % 5 + 1)::INT] AS ext2 FROM files)))),
days AS (SELECT *, {VERSION} AS version, date_diff('day', modified_at::DATE, {NOW}::DATE) AS m, date_diff('day', created_at::DATE, {NOW}::DATE) AS c FROM named),
relevant AS (SELECT *, greatest(0, least(100, CASE WHEN {_has("low_name", W.exclude)} THEN 3 WHEN {_has("low_name", W.high)} THEN 90 WHEN {_has("low_name", W.medium)} THEN 60 ELSE 45 END
  + CASE WHEN {_has("low_folder", W.folder_bad)} THEN -15 WHEN {_has("low_folder", W.folder_good)} THEN 25 ELSE 0 END
  + least(10, 2 * ({" + ".join(f"contains(lower(text), '{w}')::INT" for w in W.content)}))))::INT AS relevance FROM days),
finals AS (SELECT *, greatest(0, least(100, trunc(relevance * 0.7::DOUBLE)::INT + CASE WHEN m <= 7 THEN 20 WHEN m <= 30 THEN 15 WHEN m <= 90 THEN 10 WHEN m <= 180 THEN 5 WHEN m <= 730 THEN 0 ELSE -5 END
  + CASE WHEN c <= 90 THEN 10 WHEN c <= 365 THEN 5 ELSE 0 END))::INT AS final_score FROM relevant),
delivered AS (SELECT *, CASE WHEN ext = '.tmp' THEN -9999 ELSE CASE ext WHEN '.docx' THEN 30 WHEN '.pdf' THEN 32 WHEN '.md' THEN 12 WHEN '.xlsx' THEN 28 ELSE 0 END + CASE WHEN {_has("low_name", W.bonus)} THEN 20 ELSE 0 END
  - CASE WHEN {_has("low_name", W.strong)} THEN 30 WHEN {_has("low_name", W.weak)} THEN 15 ELSE 0 END END::INT AS deliverable FROM finals),
valued AS (SELECT *, greatest(0, least(100, round_even(relevance * 0.45::DOUBLE, 0) + round_even(greatest(0, least(100, deliverable * 2)) * 0.2::DOUBLE, 0) + CASE WHEN m <= 30 THEN 15 WHEN m <= 90 THEN 10 ELSE 0 END
  + greatest(CASE WHEN {_has("low_name", W.final)} THEN 8 ELSE 0 END, {_points(5)})
  + CASE WHEN {_has("low_folder", W.folder_good)} THEN 5 ELSE 0 END - CASE WHEN {_has("low_folder", W.folder_bad)} THEN 5 ELSE 0 END
  - CASE WHEN deliverable <= -9999 THEN 30 WHEN {_has("low_name", W.strong)} THEN 15 ELSE 0 END))::INT AS value FROM delivered)"""


@query(f"WITH {NAMED} SELECT path, relevance, final_score, CASE WHEN final_score >= 80 THEN 'important' WHEN final_score >= 50 THEN 'normal' ELSE 'low' END AS label FROM finals")
def relevance_score(spark: SparkSession, d: str) -> DataFrame:
    return scoring.relevance(_named(spark, d), A.as_of()).select("path", "relevance", "final_score", "label")


@query(f"WITH {NAMED} SELECT path, deliverable FROM delivered")
def deliverable_score(spark: SparkSession, d: str) -> DataFrame:
    return scoring.deliverable(_named(spark, d)).select("path", "deliverable")


@query(f"WITH {NAMED} SELECT path, value FROM valued")
def document_value(spark: SparkSession, d: str) -> DataFrame:
    return scoring.document_value(_named(spark, d), A.as_of()).select("path", "value")


SIGNAL = f"""greatest(-25, least(25, CASE WHEN {_has("low_name", W.core)} THEN 8 ELSE 0 END + CASE WHEN {_has("low_name", W.final)} THEN 12 ELSE 0 END
  + {_points(4)} - CASE WHEN {_has("low_name", W.negative)} THEN 18 ELSE 0 END))"""


#: Families ranked by final mark, version, day, value, base name, no mark of a copy, and path.
RANKED = f"""ranked AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY contains(low_stem, 'final') DESC, version DESC NULLS LAST, modified_at::DATE DESC, value DESC,
  (regexp_replace(low_stem, '[_\\-\\s]+', '', 'g') = lower(regexp_replace(family, '[_\\-\\s]+', '', 'g'))) DESC, {_has("low_stem", names.DERIVED)}, path)::INT AS rank FROM (SELECT *, {_family("stem")} AS family FROM valued))"""


@query(f"WITH {NAMED}, {RANKED} SELECT path, family, rank FROM ranked")
def families(spark: SparkSession, d: str) -> DataFrame:
    return dedup.families(scoring.document_value(_named(spark, d), A.as_of())).select("path", "family", "rank")


@query(f"WITH {NAMED}, {RANKED} SELECT path, CASE WHEN rank <= 2 THEN 'primary' ELSE 'obsolete' END AS role FROM ranked")
def version_cap(spark: SparkSession, d: str) -> DataFrame:
    return dedup.cap_versions(scoring.document_value(_named(spark, d), A.as_of())).select("path", "role")


@query(f"""WITH {NAMED}, {RANKED}, signals AS (SELECT *, {SIGNAL} AS signal, {_has("low_stem", W.negative)} AS low FROM ranked),
seconds AS (SELECT top, family, min(rank) AS second FROM signals WHERE rank > 1 AND NOT low AND (version IS NOT NULL OR {_has("low_stem", W.final)}) GROUP BY ALL),
graded AS (SELECT s.*, greatest(0, least(100, value + signal)) AS adjusted, s.rank = 1 OR s.rank IS NOT DISTINCT FROM c.second AS candidate FROM signals s LEFT JOIN seconds c ON s.top = c.top AND s.family = c.family),
g AS (SELECT *, CASE WHEN NOT candidate OR low THEN 3 WHEN adjusted >= 80 THEN 1 WHEN adjusted >= 50 THEN 2 ELSE 3 END AS grade FROM graded),
p AS (SELECT *, row_number() OVER (PARTITION BY top, grade ORDER BY adjusted DESC, modified_at::DATE DESC, deliverable DESC, signal DESC, path) AS place, greatest(count(*) FILTER (grade = 1) OVER (PARTITION BY top) - 3, 0) AS spare FROM g)
SELECT path, top, adjusted::INT AS adjusted, CASE WHEN grade = 1 AND place <= 3 THEN 'representative' WHEN grade = 1 AND place <= 8 THEN 'support' WHEN grade = 2 AND place + spare <= 5 THEN 'support' ELSE 'reference' END AS role FROM p""")
def representatives(spark: SparkSession, d: str) -> DataFrame:
    docs = dedup.families(scoring.document_value(_named(spark, d), A.as_of())).withColumn("top", paths.top(F.col("path")))
    return scoring.representatives(docs, ["top"]).select("path", "top", "adjusted", "role")


@query(f"""WITH {NAMED}, r AS (SELECT *, row_number() OVER (PARTITION BY top ORDER BY (m <= 30) DESC, modified_at DESC, final_score DESC, path)::INT AS rank FROM finals)
SELECT path, top AS project, rank, CASE WHEN rank > 30 THEN 'project_limit' END AS reason FROM r""")
def project_cap(spark: SparkSession, d: str) -> DataFrame:
    docs = scoring.relevance(_named(spark, d), A.as_of()).withColumn("is_current", F.datediff(A.as_of(), "modified_at") <= 30).withColumn("score", F.col("final_score"))
    return scoring.project_cap(docs, paths.top(F.col("path"))).select("path", "project", "rank", "reason")


@query(f"""WITH {NAMED}, g AS (SELECT top AS project, count(*) AS docs, min(m) AS days, count(*) FILTER (deliverable >= 30) AS deliverables, count(DISTINCT ext) AS exts, 4 AS depth, count(*) FILTER (m <= 30) AS active FROM delivered GROUP BY top)
SELECT project, docs, deliverables, exts, depth::INT AS depth, active, least(100, CASE WHEN days <= 30 THEN 30 WHEN days <= 90 THEN 20 ELSE 0 END + CASE WHEN docs >= 20 THEN 20 WHEN docs >= 10 THEN 10 WHEN docs >= 3 THEN 5 ELSE 0 END
  + CASE WHEN deliverables >= 5 THEN 15 WHEN deliverables >= 3 THEN 10 WHEN deliverables >= 1 THEN 5 ELSE 0 END + least(15, exts * 3 + greatest(0, depth - 3) * 2) + CASE WHEN active > 0 THEN 20 ELSE 0 END)::INT AS importance FROM g""")
def project_importance(spark: SparkSession, d: str) -> DataFrame:
    return scoring.project_importance(scoring.deliverable(_named(spark, d)), paths.top(F.col("path")), A.as_of())


@query(f"WITH {FILES} SELECT project, days, CASE WHEN days <= 7 THEN 'in_progress' WHEN days <= 30 THEN 'recently_done' ELSE 'idle' END AS state FROM (SELECT parent AS project, min(date_diff('day', modified_at::DATE, {NOW}::DATE))::INT AS days FROM files GROUP BY parent)")
def progress_split(spark: SparkSession, d: str) -> DataFrame:
    return scoring.progress_split(A.files(spark, d), paths.parent(F.col("path")), A.as_of())


@query(f"""WITH {NAMED}, s AS (SELECT top, lower(left(name, length(name) - length(ext))) AS stem, max(deliverable) AS deliverable FROM delivered WHERE deliverable > -9999 GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY top ORDER BY deliverable DESC, stem)::INT AS rank FROM s) WHERE rank <= 5""")
def deliverable_names(spark: SparkSession, d: str) -> DataFrame:
    docs = scoring.deliverable(_named(spark, d)).withColumn("top", paths.top(F.col("path")))
    return scoring.deliverable_names(docs, ["top"])


@query(f"WITH {NAMED} SELECT path, value FROM valued ORDER BY value DESC, path LIMIT 50")
def top_documents(spark: SparkSession, d: str) -> DataFrame:
    return scoring.top_documents(scoring.document_value(_named(spark, d), A.as_of())).select("path", "value")


@query(f"""WITH {NAMED}, w AS (SELECT unnest(regexp_extract_all(regexp_replace(lower(regexp_replace(path, '\\.[A-Za-z0-9]{{1,5}}$', '')), 'v[0-9]+(\\.[0-9]+)*|(19|20)[0-9]{{2}}', ' ', 'g'), '[a-z]{{3,}}')) AS word FROM named)
SELECT word, count(*) AS n FROM w WHERE word NOT IN ('misc', 'src') GROUP BY word ORDER BY n DESC, word LIMIT 50""")
def keyword_freq(spark: SparkSession, d: str) -> DataFrame:
    return audit.keyword_frequency(_named(spark, d), spark.createDataFrame([("misc",), ("src",)], "word string"))


@query("SELECT n_name AS name, (SELECT count(*) FROM documents WHERE contains(lower(text), lower(n_name))) AS texts FROM (SELECT n_name FROM nation UNION SELECT 'tion' UNION SELECT 'password') ")
def entity_freq(spark: SparkSession, d: str) -> DataFrame:
    names = A.table(spark, d, "nation").select(F.col("n_name").alias("name")).union(spark.createDataFrame([("tion",), ("password",)], "name string"))
    return audit.entity_frequency(A.table(spark, d, "documents"), names)


@query("""WITH e AS (SELECT DISTINCT left(text, 12) AS name FROM benchmark UNION SELECT 'ZZZZ'), c AS (SELECT name, (SELECT count(*) FROM documents WHERE contains(lower(text), lower(name))) AS texts FROM e WHERE length(name) >= 2),
a AS (SELECT *, name IN (SELECT left(text, 12) FROM benchmark WHERE item_id % 2 = 0 UNION SELECT 'ZZZZ') AS allowed FROM c)
SELECT name, texts, CASE WHEN texts > 0 AND NOT allowed THEN 'FAIL' WHEN texts = 0 THEN 'ABSENT' ELSE 'PASS' END AS verdict FROM a WHERE texts > 0 OR allowed""")
def mention_audit(spark: SparkSession, d: str) -> DataFrame:
    items = A.table(spark, d, "benchmark").select("item_id", F.substring("text", 1, 12).alias("name"))
    allowed = items.filter("item_id % 2 = 0").select("name").union(spark.createDataFrame([("ZZZZ",)], "name string"))
    return audit.mention_audit(A.table(spark, d, "documents"), items.select("name"), allowed)


@query("""SELECT event_type AS category, count(*) AS runs, count(*) FILTER (event_id % 9 <> 0) AS succeeded, round(avg(value) FILTER (event_id % 9 <> 0), 2) AS mean_seconds,
  round(avg((event_id % 5 > 0)::INT::DOUBLE) * 100, 2) AS percent_sources, sum(user_id)::BIGINT AS credits FROM events GROUP BY event_type""")
def eval_summary(spark: SparkSession, d: str) -> DataFrame:
    runs = A.table(spark, d, "events").select(F.col("event_type").alias("category"), F.when(F.col("event_id") % 9 == 0, "timeout").alias("error"), F.col("value").alias("elapsed_seconds"), (F.col("event_id") % 5 > 0).alias("has_sources"), F.col("user_id").alias("credits_used"))
    return audit.evaluation_summary(runs, ["category"])


RULES = (
    ("work", "contract work", "contract", "name", 3, 1), ("work", "planning", "plan", "name", 2, 2), ("work", "planning", "meeting", "name", 2, 3), ("work", "design", "design", "name", 3, 4),
    ("work", "design", "tion", "text", 1, 5), ("work", "planning", "que", "text", 1, 6), ("work", "reporting", "report", "name", 3, 7), ("work", "reporting", "und", "text", 1, 8),
)
RULES_SQL = "rules(rule_set, label, keyword, field, weight, rule_order) AS (VALUES " + ", ".join(map(str, RULES)) + ")"
HITS_SQL = f"{NAMED}, {RULES_SQL}, hits AS (SELECT doc_id, top, label, keyword, field, weight, rule_order FROM named, rules WHERE CASE WHEN field = 'name' THEN contains(low_name, keyword) ELSE contains(lower(text), keyword) END)"


def _hits(spark: SparkSession, d: str) -> DataFrame:
    table = spark.createDataFrame(list(RULES), "rule_set string, label string, keyword string, field string, weight int, rule_order int")
    docs = _named(spark, d).select("doc_id", "name", "text", paths.top(F.col("path")).alias("top"))
    return rules.hits(docs, table)


@query(f"""WITH {HITS_SQL}, o AS (SELECT label, least(100, 35 + least(count(DISTINCT doc_id), 8) * 10 + least(count(DISTINCT keyword), 8) * 8 + count(*) FILTER (doc_id % 100 = 0) * 12 + sum(weight) * 2)::INT AS confidence, count(DISTINCT doc_id) AS files FROM hits GROUP BY label)
SELECT coalesce(o.label, u.label) AS label, CASE WHEN u.label IS NOT NULL AND confidence IS NOT NULL THEN 'HYBRID' WHEN u.label IS NOT NULL THEN 'USER' ELSE 'AUTO' END AS source, coalesce(confidence, 100) AS confidence, coalesce(files, 0) AS files
FROM o FULL JOIN (SELECT unnest(['design', 'travel']) AS label) u ON o.label = u.label WHERE u.label IS NOT NULL OR confidence >= 70""")
def category_discovery(spark: SparkSession, d: str) -> DataFrame:
    found = _hits(spark, d).withColumn("is_representative", F.col("doc_id") % 100 == 0)
    return rules.discover_categories(found, spark.createDataFrame([("design",), ("travel",)], "label string"))


@query(f"""WITH {NAMED}, words(label, token, child) AS (VALUES ('finance', 'contract', true), ('finance', 'report', false), ('build', 'design', true), ('build', 'project', false), ('talk', 'meeting', true)),
t AS (SELECT DISTINCT project, place, token FROM (SELECT top AS project, 'folder' AS place, unnest(string_split(low_folder, '/')) AS token FROM named UNION ALL SELECT top, 'file', unnest(regexp_split_to_array(low_name, '[^a-z]+')) FROM named)),
s AS (SELECT project, label, sum(CASE WHEN place = 'folder' THEN CASE WHEN child THEN 15 ELSE 5 END ELSE CASE WHEN child THEN 8 ELSE 3 END END) AS score FROM t JOIN words USING (token) GROUP BY ALL)
SELECT p.project, coalesce(label, 'other') AS label, coalesce(score, 0)::BIGINT AS score FROM (SELECT DISTINCT top AS project FROM named) p LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY score DESC, label) AS n FROM s) WHERE n = 1) b ON p.project = b.project""")
def category_mapping(spark: SparkSession, d: str) -> DataFrame:
    words = spark.createDataFrame([("finance", "contract", True), ("finance", "report", False), ("build", "design", True), ("build", "project", False), ("talk", "meeting", True)], "label string, keyword string, is_child boolean")
    docs = _named(spark, d).withColumn("project", paths.top(F.col("path")))
    folder = docs.select("project", F.lit("folder").alias("place"), F.explode(F.split(F.lower(paths.parent(F.col("path"))), "/")).alias("token"))
    file = docs.select("project", F.lit("file").alias("place"), F.explode(F.split(F.lower("name"), "[^a-z]+")).alias("token"))
    return rules.map_categories(docs, words, folder.union(file))


SIGNALS = (("status", "approval", "contract", "name", 1, 1), ("status", "review", "review", "name", 1, 2), ("status", "final", "final", "name", 1, 3), ("status", "progress", "draft", "name", 1, 4), ("status", "risk", "sample", "name", 1, 5))


@query(f"""WITH {NAMED}, s(label, keyword) AS (VALUES {", ".join(str((r[1], r[2])) for r in SIGNALS)}), g AS (SELECT *, top || '/' || (doc_id % 8) AS grp FROM named),
h AS (SELECT grp, max((label = 'approval')::INT) AS a, max((label = 'review')::INT) AS r, max((label = 'final')::INT) AS f, max((label = 'progress')::INT) AS p, count(DISTINCT label) AS signals, count(*) FILTER (label = 'final') AS done, count(*) FILTER (label = 'risk') AS risks FROM g, s WHERE contains(low_name, keyword) GROUP BY grp)
SELECT d.grp, d.docs, CASE WHEN a = 1 THEN 'waiting_approval' WHEN r = 1 THEN 'waiting_review' WHEN f = 1 THEN 'completed' WHEN p = 1 THEN 'in_progress' ELSE 'unknown' END AS status,
  (45 + least(15, docs * 3) + least(25, coalesce(signals, 0) * 8) + least(10, coalesce(done, 0) * 2) - least(10, coalesce(risks, 0) * 2))::INT AS confidence
FROM (SELECT grp, count(*) AS docs FROM g GROUP BY grp) d LEFT JOIN h ON d.grp = h.grp""")
def work_status(spark: SparkSession, d: str) -> DataFrame:
    docs = _named(spark, d).select("doc_id", "name", "text", F.concat_ws("/", paths.top(F.col("path")), F.col("doc_id") % 8).alias("grp"))
    table = spark.createDataFrame(list(SIGNALS), "rule_set string, label string, keyword string, field string, weight int, rule_order int")
    return rules.work_status(docs, rules.hits(docs, table), ["grp"])


EVIDENCE = "ev AS (SELECT top, label, doc_id, max(weight) AS w, count(DISTINCT keyword) AS m, count(DISTINCT field) AS fields FROM hits GROUP BY ALL)"


@query(f"""WITH {HITS_SQL}, {EVIDENCE}, s AS (SELECT top, label, count(*) AS docs, sum(m)::BIGINT AS keyword_hits, greatest(0, least(100, 45 + count(*) * 12 + sum(m) * 5))::INT AS confidence FROM ev GROUP BY ALL)
SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY top ORDER BY confidence DESC, label) AS n FROM s) WHERE n = 1""")
def purpose(spark: SparkSession, d: str) -> DataFrame:
    return rules.purposes(_hits(spark, d), ["top"])


@query(f"""WITH {HITS_SQL}, {EVIDENCE} SELECT top, label, count(*) AS docs, greatest(0, least(100, sum(w * 18 + CASE WHEN fields > 1 THEN 8 ELSE 0 END) + least(20, count(*) * 4)))::INT AS confidence FROM ev GROUP BY ALL""")
def tools(spark: SparkSession, d: str) -> DataFrame:
    return rules.tools(_hits(spark, d), ["top"])


@query(f"""WITH {HITS_SQL}, {EVIDENCE}, s AS (SELECT top, label, count(*) AS docs, greatest(0, least(100, sum(w * 12 + least(12, m * 4)) + least(18, count(*) * 5) + least(15, sum(m) * 3)))::INT AS confidence FROM ev GROUP BY ALL)
SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY top ORDER BY confidence DESC, label) AS n FROM s WHERE confidence >= 45 AND docs >= 2) WHERE n = 1""")
def descriptions(spark: SparkSession, d: str) -> DataFrame:
    return rules.descriptions(_hits(spark, d), ["top"])


@query(f"""WITH {HITS_SQL}, {EVIDENCE} SELECT top, label, count(*) AS docs, greatest(0, least(100, sum(w * 14 + CASE WHEN fields > 1 THEN 6 ELSE 0 END) + least(24, count(*) * 8)))::INT AS confidence FROM ev GROUP BY ALL HAVING count(*) >= 3""")
def knowhow(spark: SparkSession, d: str) -> DataFrame:
    return rules.knowhow(_hits(spark, d), ["top"], least=3)


@query(f"""WITH {HITS_SQL}, s AS (SELECT top, label, min(rule_order) AS step_order FROM hits GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY top ORDER BY step_order, label)::INT AS step, count(*) OVER (PARTITION BY top) AS steps FROM s)
SELECT top, label, step_order, step FROM r WHERE steps >= 2 AND step <= 7""")
def workflow(spark: SparkSession, d: str) -> DataFrame:
    return rules.workflow(_hits(spark, d), ["top"])


@query("""WITH c AS (SELECT event_type AS unit_type, 'unit ' || (user_id % 12) AS name, (event_id % 60)::INT AS confidence, event_id AS ord FROM events),
i AS (SELECT *, row_number() OVER (PARTITION BY unit_type, name ORDER BY ord) AS i, count(*) OVER (PARTITION BY unit_type, name) AS n FROM c)
SELECT unit_type, name, least(100, max(confidence + 3 * CASE WHEN i = 1 THEN n - 1 ELSE n - i + 1 END))::INT AS confidence, count(*) AS sources FROM i GROUP BY ALL""")
def unit_resolver(spark: SparkSession, d: str) -> DataFrame:
    rows = A.table(spark, d, "events")
    return cluster.resolve_units(rows.select(F.col("event_type").alias("unit_type"), F.concat(F.lit("unit "), F.col("user_id") % 12).alias("name"), (F.col("event_id") % 60).cast("int").alias("confidence"), F.col("event_id").alias("ord")))


@query(f"""WITH {FILES}, m AS (SELECT 'families' AS section, 'impure' AS measure, count(*) FILTER (doc_id % 97 = 0) AS n FROM files UNION ALL SELECT 'clusters', 'weak', count(*) FILTER (doc_id % 501 = 0) FROM files UNION ALL SELECT 'status', 'unknown', count(*) FILTER (doc_id % 401 = 0) FROM files),
k(section, measure, each, most) AS (VALUES {", ".join(str((s, *r)) for s, rows in audit.PENALTIES.items() for r in rows)}),
j AS (SELECT k.*, coalesce(n, 0) AS n FROM k LEFT JOIN m USING (section, measure)),
s AS (SELECT section, greatest(0, 100 - sum(least(most, each * n)))::BIGINT AS score, coalesce(string_agg(measure || '=' || n, ', ' ORDER BY measure) FILTER (n > 0), '') AS warnings FROM j GROUP BY section)
SELECT * FROM s UNION ALL SELECT 'overall', round_even(avg(score), 0)::BIGINT, '' FROM s""")
def quality_audit(spark: SparkSession, d: str) -> DataFrame:
    files = A.files(spark, d)
    parts = [files.agg(F.lit(s).alias("section"), F.lit(m).alias("measure"), F.count_if(F.col("doc_id") % k == 0).alias("n")) for s, m, k in (("families", "impure", 97), ("clusters", "weak", 501), ("status", "unknown", 401))]
    return audit.structural_audit(parts[0].unionByName(parts[1]).unionByName(parts[2]))


@query(f"""WITH {FILES}, r AS (SELECT top, max((doc_id % 7 = 0)::INT) AS representative, max((doc_id % 11 = 1)::INT) AS support, max((doc_id % 2 = 0)::INT) AS reference FROM files GROUP BY top),
s AS (SELECT *, representative * 70 + support * 20 + reference * 10 AS t FROM r),
p AS (SELECT top, representative, support, reference, CASE WHEN t > 0 THEN round_even(representative * 70 * 100.0 / t, 0) ELSE 0 END::INT AS a, CASE WHEN t > 0 THEN round_even(support * 20 * 100.0 / t, 0) ELSE 0 END::INT AS b, CASE WHEN t > 0 THEN round_even(reference * 10 * 100.0 / t, 0) ELSE 0 END::INT AS c FROM s)
SELECT top, CASE WHEN a > 0 THEN a + 100 - a - b - c ELSE a END::INT AS representative, CASE WHEN a = 0 AND b > 0 THEN b + 100 - a - b - c ELSE b END::INT AS support, CASE WHEN a = 0 AND b = 0 AND c > 0 THEN 100 ELSE c END::INT AS reference FROM p""")
def basis_ratio(spark: SparkSession, d: str) -> DataFrame:
    files = A.files(spark, d).withColumn("top", paths.top(F.col("path")))
    roles = F.array_compact(F.array(F.when(F.col("doc_id") % 7 == 0, "representative"), F.when(F.col("doc_id") % 11 == 1, "support"), F.when(F.col("doc_id") % 2 == 0, "reference"), F.lit("none")))
    return audit.basis_ratio(files.select("top", F.explode(roles).alias("role")), ["top"])


@query(f"""WITH {FILES}, c AS (SELECT name, count(*) AS times FROM (SELECT split_part(path, '/', 2) AS name FROM files) GROUP BY name)
SELECT doc_id, split_part(path, '/', 2) AS label, times, times > 1 AND split_part(path, '/', 2) <> 'en' AS is_repeated FROM files JOIN c ON split_part(path, '/', 2) = c.name""")
def repeated_values(spark: SparkSession, d: str) -> DataFrame:
    files = A.files(spark, d).select("doc_id", F.split_part("path", F.lit("/"), F.lit(2)).alias("label"))
    return audit.repeated(files, "label", ignore="en")


@query()
def work_clusters(spark: SparkSession, d: str) -> DataFrame:
    return cluster.work_clusters(A.files(spark, d))


@query()
def cluster_labels(spark: SparkSession, d: str) -> DataFrame:
    files = A.files(spark, d, text=True)
    told = phrases.longest_phrase(files)
    return cluster.describe_clusters(cluster.work_clusters(files), cluster.profiles(files, summary=F.col("text")), told)


#: The longest phrase of two to four words in twenty documents or more, of each document.
PHRASES_SQL = r"""texts AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM files),
grams AS (SELECT DISTINCT doc_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM texts, (VALUES (2), (3), (4)) AS t(k) WHERE len(w) >= k),
often AS (SELECT phrase, k, count(*) AS docs FROM grams GROUP BY ALL HAVING count(*) >= 20),
longest AS (SELECT doc_id, phrase FROM grams JOIN often USING (phrase, k) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY k DESC, docs DESC, phrase) = 1)"""


@query(f"WITH {FILES}, {PHRASES_SQL} SELECT doc_id, phrase FROM longest")
def longest_phrases(spark: SparkSession, d: str) -> DataFrame:
    return phrases.longest_phrase(A.files(spark, d, text=True))


_CATEGORY = ", ".join(f"({k}, '{name}', [{', '.join(repr(w) for w in own)}])" for k, (name, own) in enumerate(cluster.CATEGORIES))


@query(f"""WITH {NAMED}, {PHRASES_SQL}, f AS (SELECT doc_id, path, text, modified_at::DATE AS day, doc_id // 16 AS cluster FROM named),
hits AS (SELECT doc_id, category, k, len(list_filter(words, lambda w: contains(lower(path || ' ' || text), w))) AS n FROM f, (VALUES {_CATEGORY}) AS c(k, category, words)),
kinds AS (SELECT cluster, category FROM (SELECT doc_id, category FROM hits WHERE n > 0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, k) = 1) JOIN f USING (doc_id)),
major AS (SELECT cluster, category FROM (SELECT cluster, category, count(*) AS n FROM kinds GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY n DESC, category) = 1),
told AS (SELECT cluster, phrase FROM (SELECT cluster, phrase, count(*) AS n FROM f JOIN longest USING (doc_id) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY n DESC, phrase) = 1)
SELECT f.cluster, count(*) AS docs, max(day)::TIMESTAMP AS latest, coalesce(any_value(major.category), 'General') AS category, any_value(told.phrase) AS name
FROM f LEFT JOIN major ON f.cluster = major.cluster JOIN told ON f.cluster = told.cluster GROUP BY f.cluster""")
def cluster_names(spark: SparkSession, d: str) -> DataFrame:
    """J7 of given groups: those whose documents have a phrase."""
    files = _named(spark, d)
    members = files.select("doc_id", F.expr("doc_id div 16").alias("cluster"))
    told = phrases.longest_phrase(files)
    own = cluster.describe_clusters(members, cluster.profiles(files, summary=F.col("text")), told)
    return own.join(members.join(told, "doc_id").select("cluster").distinct(), "cluster", "left_semi").drop("top_keywords").withColumn("latest", F.col("latest").cast("timestamp_ntz"))


@query(f"""WITH {NAMED}, f AS (SELECT doc_id, {_family("stem")} AS family, doc_id % 7 AS cluster FROM named),
sizes AS (SELECT cluster, count(*) AS n FROM f GROUP BY cluster),
shared AS (SELECT cluster, string_agg(token, ' ' ORDER BY token) AS common FROM (SELECT cluster, token, count(*) AS c FROM (SELECT DISTINCT doc_id, cluster, unnest(regexp_split_to_array(lower(family), '[^a-z0-9]+')) AS token FROM f) WHERE length(token) > 1 GROUP BY ALL) JOIN sizes USING (cluster) WHERE c = n GROUP BY cluster),
often AS (SELECT cluster, family FROM (SELECT cluster, family, count(*) AS c FROM f GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY c DESC, family) = 1)
SELECT cluster, n AS docs, coalesce(common, family) AS name FROM sizes LEFT JOIN shared USING (cluster) LEFT JOIN often USING (cluster)""")
def cluster_common_names(spark: SparkSession, d: str) -> DataFrame:
    """J7 of given groups without phrases: the words that all names share, else the commonest family."""
    files = _named(spark, d)
    return cluster.describe_clusters(files.select("doc_id", (F.col("doc_id") % 7).alias("cluster")), cluster.profiles(files)).select("cluster", "docs", "name")
