"""Rule engines: keyword tables meet documents, hits are grouped, weighed by a formula and ranked.

A rule table has rule_set, label, keyword, field, weight, rule_order. Documents have doc_id, name, text
and whatever groups them. All engines below share ``hits``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from archivelens.functions import scratch
from archivelens.functions.text import clamp
from archivelens.operators import containment

#: Columns of a rule.
RULE = ("rule_set", "label", "keyword", "field", "weight", "rule_order")


def hits(docs: DataFrame, rules: DataFrame, fields: Sequence[str] = ("name", "text")) -> DataFrame:
    """The rows of docs beside each rule whose keyword occurs in the rule's field, whatever its case.

    Rules can be many: keywords are looked up by their rarest grams (``containment``). Null and empty keywords
    occur nowhere, a null field holds nothing; repeated rules give a row each.
    """
    out = None
    used = [r["field"] for r in rules.select("field").distinct().collect() if r["field"] in fields]  # one of ``fields`` each
    for field in sorted(used) or list(fields)[:1]:
        own = rules.filter(F.col("field") == field).select(F.lower("keyword").alias("__word"), F.struct(*RULE).alias("__rule"))
        met = containment.matches(docs, field, own.select(F.col("__word").alias("keyword")))
        found = met.join(own, F.col("matched") == F.col("__word")).select(*docs.columns, "__rule.*")
        out = found if out is None else out.unionByName(found)
    return out


def token_hits(docs: DataFrame, rules: DataFrame, field: str = "text") -> DataFrame:
    """As ``hits`` for whole words, by an equi-join: the form for large dictionaries."""
    words = docs.withColumn("word", F.explode(F.array_distinct(F.regexp_extract_all(F.lower(field), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))))
    own = rules.filter(F.col("field") == field).withColumn("word", F.lower("keyword"))
    return words.join(own, "word").drop("word")


def first_match(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The label of the first rule that holds for each group."""
    return rows.groupBy(*keys).agg(F.min_by("label", F.struct("rule_order", "label")).alias("label"))


def look_up(rows: DataFrame, table: DataFrame, default: str) -> DataFrame:
    """Fixed entries (label, items) of a label, or the default's."""
    own = rows.join(table.select("label", "items"), "label", "left")
    other = table.filter(F.col("label") == default).groupBy().agg(F.first("items").alias("other"))  # one row, null without a default
    return own.join(F.broadcast(other), F.lit(True), "left").withColumn("items", F.coalesce("items", "other")).drop("other")


def discover_categories(found: DataFrame, user: DataFrame) -> DataFrame:
    """Categories out of hits (label, doc_id, keyword, weight, is_representative), merged with a
    user's own list (label): source USER, AUTO (confidence 70 or more) or HYBRID."""
    own = found.groupBy("label").agg(F.countDistinct("doc_id").alias("files"), F.countDistinct("keyword").alias("keywords"), F.count_if("is_representative").alias("reps"), F.sum("weight").alias("weight"))
    score = F.lit(35) + F.least("files", F.lit(8)) * 10 + F.least("keywords", F.lit(8)) * 8 + F.col("reps") * 12 + F.col("weight") * 2
    own = own.withColumn("confidence", F.least(F.lit(100), score).cast("int"))
    both = own.join(user.select("label").distinct().withColumn("listed", F.lit(True)), "label", "full")
    source = F.when(F.col("listed") & F.col("confidence").isNotNull(), "HYBRID").when(F.col("listed"), "USER").when(F.col("confidence") >= 70, "AUTO")
    return both.withColumn("source", source).filter("source is not null").select("label", "source", F.coalesce("confidence", F.lit(100)).alias("confidence"), F.coalesce("files", F.lit(0)).alias("files"))


def map_categories(projects: DataFrame, rules: DataFrame, tokens: DataFrame, other: str = "other") -> DataFrame:
    """The category of each project. tokens has project, token, place (name, folder or file); rules
    has label, keyword, is_child. Points of distinct hits: child and parent words 30 and 10 in the
    name, 15 and 5 in a folder, 8 and 3 in a file. No points: ``other``; ties: by label."""
    own = rules.select("label", F.lower("keyword").alias("token"), "is_child")
    met = tokens.select("project", "place", F.lower("token").alias("token")).distinct().join(own, "token")
    points = F.when(F.col("place") == "name", F.when(F.col("is_child"), 30).otherwise(10)).when(F.col("place") == "folder", F.when(F.col("is_child"), 15).otherwise(5)).otherwise(F.when(F.col("is_child"), 8).otherwise(3))
    scored = met.groupBy("project", "label").agg(F.sum(points).alias("score"))
    best = scored.withColumn("n", F.row_number().over(Window.partitionBy("project").orderBy(F.desc("score"), "label"))).filter("n = 1").drop("n")
    return projects.select("project").distinct().join(best, "project", "left").select("project", F.coalesce("label", F.lit(other)).alias("label"), F.coalesce("score", F.lit(0)).alias("score"))


def path_scores(found: DataFrame) -> DataFrame:
    """Score of (path, label) out of distinct hits (path, label, kind, keyword)."""
    points = {"folder_keyword": 20, "folder_fingerprint": 6, "organisation": 20, "file_fingerprint": 5, "file_keyword": 8, "content": 3}
    worth = F.element_at(F.create_map(*[F.lit(x) for p in points.items() for x in p]), F.col("kind"))
    return found.select("path", "label", "kind", "keyword").distinct().groupBy("path", "label").agg(F.sum(F.coalesce(worth, F.lit(0))).alias("score"))


#: Signals in order of precedence and the status that each gives.
STATUS = (("approval", "waiting_approval"), ("review", "waiting_review"), ("final", "completed"), ("progress", "in_progress"), ("maintenance", "maintenance"))


def work_status(docs: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Status and confidence of each group out of the signals its documents show.

    Confidence: 45 + min(15, 3 docs) + min(25, 8 signals) + min(10, 2 completed) - min(10, 2 risks).
    """
    seen = found.groupBy(*keys).agg(*[F.max((F.col("label") == s).cast("int")).alias(s) for s, _ in STATUS], F.countDistinct("label").alias("signals"), F.count_if(F.col("label") == "final").alias("completed"), F.count_if(F.col("label") == "risk").alias("risks"))
    rows = docs.groupBy(*keys).agg(F.count(F.lit(1)).alias("docs")).join(seen, keys, "left").na.fill(0, ["signals", "completed", "risks"])
    status = F.lit("unknown")
    for signal, name in reversed(STATUS):
        status = F.when(F.col(signal) == 1, name).otherwise(status)
    score = F.lit(45) + F.least(F.lit(15), F.col("docs") * 3) + F.least(F.lit(25), F.col("signals") * 8) + F.least(F.lit(10), F.col("completed") * 2) - F.least(F.lit(10), F.col("risks") * 2)
    return rows.select(*keys, "docs", status.alias("status"), score.cast("int").alias("confidence"))


def action_items(found: DataFrame, keys: list[str], most: int = 5) -> DataFrame:
    """Distinct items (label) of each group in order of the rules, at most ``most``."""
    first = found.groupBy(*keys, "label").agg(F.min(F.struct("rule_order", "doc_id")).alias("first"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("first.rule_order", "first.doc_id", "label"))).filter(F.col("rank") <= most).drop("first")


def _evidence(found: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each (group, label, doc): its largest weight, its keywords, and in which fields."""
    return found.groupBy(*keys, "label", "doc_id").agg(F.max("weight").alias("w"), F.countDistinct("keyword").alias("m"), F.countDistinct("field").alias("fields"))


def purposes(found: DataFrame, keys: list[str]) -> DataFrame:
    """The best purpose of each group: clamp(45 + 12 docs + 5 keyword hits)."""
    scored = _evidence(found, keys).groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("docs"), F.sum("m").alias("keyword_hits"))
    scored = scored.withColumn("confidence", clamp(F.lit(45) + F.col("docs") * 12 + F.col("keyword_hits") * 5).cast("int"))
    return _best(scored, keys)


def with_unknown(groups: DataFrame, best: DataFrame, keys: list[str], confidence: int = 25) -> DataFrame:
    """Groups that nothing was found for: label Unknown."""
    return groups.join(best, keys, "left").withColumn("label", F.coalesce("label", F.lit("Unknown"))).withColumn("confidence", F.coalesce("confidence", F.lit(confidence)))


def tools(found: DataFrame, keys: list[str]) -> DataFrame:
    """Tools of each group: 18 a document's weight, 8 if a keyword is in its text too, min(20, 4 n)."""
    scored = _evidence(found, keys).groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.col("w") * 18 + F.when(F.col("fields") > 1, 8).otherwise(0)).alias("points"))
    return scored.withColumn("confidence", clamp(F.col("points") + F.least(F.lit(20), F.col("docs") * 4)).cast("int")).drop("points")


def descriptions(found: DataFrame, keys: list[str]) -> DataFrame:
    """The best description with at least 45 points and two documents."""
    scored = _evidence(found, keys).groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.col("w") * 12 + F.least(F.lit(12), F.col("m") * 4)).alias("points"), F.sum("m").alias("hits"))
    total = F.col("points") + F.least(F.lit(18), F.col("docs") * 5) + F.least(F.lit(15), F.col("hits") * 3)
    scored = scored.withColumn("confidence", clamp(total).cast("int")).filter("confidence >= 45 and docs >= 2")
    return _best(scored, keys).drop("points", "hits")


def knowhow(found: DataFrame, keys: list[str], least: int = 1) -> DataFrame:
    """Items: 14 a weight, 6 if in name and text, min(24, 8 n); at least ``least`` documents."""
    scored = _evidence(found, keys).groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.col("w") * 14 + F.when(F.col("fields") > 1, 6).otherwise(0)).alias("points"))
    scored = scored.withColumn("confidence", clamp(F.col("points") + F.least(F.lit(24), F.col("docs") * 8)).cast("int"))
    return scored.filter(F.col("docs") >= least).drop("points")


def purpose_candidates(found: DataFrame, units: DataFrame, keys: list[str], most: int = 5) -> DataFrame:
    """clamp(42 + 14 m + min(18, 6 (m - 1)) + unit confidence // 10) for m matching keywords."""
    scored = found.groupBy(*keys, "label").agg(F.countDistinct("keyword").alias("m")).join(units.select(*keys, F.col("confidence").alias("unit")), keys)
    score = F.lit(42) + F.col("m") * 14 + F.least(F.lit(18), (F.col("m") - 1) * 6) + F.floor(F.col("unit") / 10)
    scored = scored.withColumn("confidence", clamp(score).cast("int"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("confidence"), "label"))).filter(F.col("rank") <= most).drop("unit")


def workflow(found: DataFrame, keys: list[str], least: int = 2, most: int = 7) -> DataFrame:
    """Steps (labels) of each group in order of their least rule_order; fewer than ``least``: none."""
    steps = found.groupBy(*keys, "label").agg(F.min("rule_order").alias("step_order"))
    ranked = steps.withColumn("step", F.row_number().over(Window.partitionBy(*keys).orderBy("step_order", "label"))).withColumn("steps", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    return ranked.filter((F.col("steps") >= least) & (F.col("step") <= most)).drop("steps")


def longest_key(rows: DataFrame, column: str, table: DataFrame) -> DataFrame:
    """The rows beside the entry of ``table`` (template, key, steps) whose key is the longest that occurs in a
    column, whatever its case; of equally long ones the first. Keys are looked up by their rarest grams, so neither
    rows nor keys are searched one by one. Rows without any have nulls."""
    tagged = rows.withColumn("__row", F.monotonically_increasing_id())
    tagged = scratch.stored(tagged, "rows")
    met = containment.matches(tagged.select("__row", column), column, table.select(F.col("key").alias("keyword")))
    best = met.groupBy("__row").agg(F.min_by("matched", F.struct(-F.length("matched"), "matched")).alias("matched"))
    own = table.select(F.lower("key").alias("matched"), "template", "steps").groupBy("matched").agg(F.min(F.struct("template", "steps")).alias("t"))
    found = best.join(own, "matched").select("__row", F.col("matched").alias("key"), "t.template", "t.steps")
    return tagged.join(found, "__row", "left").drop("__row")


def workflow_or_template(found: DataFrame, groups: DataFrame, name: str, table: DataFrame, least: int = 2, most: int = 7) -> DataFrame:
    """Groups (name, any others) with steps (joined by " > ") and source: inferred ones (``workflow``), else those
    of the template with the longest key in the group's name, else none."""
    steps = workflow(found, [name], least, most).groupBy(name).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step", "label"))), lambda s: s["label"]), " > ").alias("inferred"))
    rows = longest_key(groups, name, table).join(steps, name, "left")
    source = F.when(F.col("inferred").isNotNull(), "inferred").when(F.col("template").isNotNull(), "template").otherwise("none")
    return rows.select(*groups.columns, F.coalesce("inferred", "steps", F.lit("")).alias("steps"), source.alias("source"))


def business_context(status: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Objective (the label of the first objective rule), stage (from the status and stage rules)
    and confidence: 35 + 15 for an objective + 10 for a stage + min(15, 5 documents) + status // 10."""
    objective = found.filter("rule_set = 'objective'").groupBy(*keys).agg(F.min_by("label", F.struct("rule_order", "label")).alias("objective"))
    stage = found.filter("rule_set = 'stage'").groupBy(*keys).agg(F.min_by("label", F.struct("rule_order", "label")).alias("found_stage"))
    rows = status.join(objective, keys, "left").join(stage, keys, "left")
    from_status = F.when(F.col("status") == "waiting_approval", "approval").when(F.col("status") == "waiting_review", "review").when(F.col("status") == "completed", "completed").when(F.col("status") == "maintenance", "operation")
    name = F.coalesce(from_status, "found_stage", F.lit("planning"))
    score = F.lit(35) + F.when(F.col("objective").isNotNull(), 15).otherwise(0) + F.when(name != "planning", 10).otherwise(0) + F.least(F.lit(15), F.col("docs") * 5) + F.least(F.lit(10), F.bround(F.col("confidence") / 10))
    return rows.select(*keys, F.coalesce("objective", F.lit("Unknown")).alias("objective"), name.alias("stage"), clamp(score).cast("int").alias("confidence"))


def assemble(purpose: DataFrame, tool: DataFrame, description: DataFrame, item: DataFrame, keys: list[str]) -> DataFrame:
    """One row a group: purpose, description, tools and items; confidence is the least of the
    parts that are there, and ``missing`` says which aren't."""
    listed = lambda df, name: df.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set("label")), ", ").alias(name), F.max("confidence").alias(f"{name}_confidence"))
    rows = purpose.select(*keys, F.col("label").alias("purpose"), F.col("confidence").alias("purpose_confidence"))
    rows = rows.join(description.select(*keys, F.col("label").alias("description"), F.col("confidence").alias("description_confidence")), keys, "left").join(listed(tool, "tools"), keys, "left").join(listed(item, "items"), keys, "left")
    parts = ("purpose", "description", "tools", "items")
    missing = F.array_join(F.array_compact(F.array(*[F.when(F.col(p).isNull(), F.lit(p)) for p in parts])), ", ")
    return rows.withColumn("confidence", F.least(*[f"{p}_confidence" for p in parts])).withColumn("missing", missing).drop(*[f"{p}_confidence" for p in parts])


def _best(scored: DataFrame, keys: list[str]) -> DataFrame:
    return scored.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("confidence"), "label"))).filter("n = 1").drop("n")
