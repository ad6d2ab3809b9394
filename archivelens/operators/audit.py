"""Counts, evaluations and audits of results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from archivelens.functions import paths
from archivelens.operators import containment


def keyword_frequency(files: DataFrame, stopwords: DataFrame | None = None, most: int = 50, noise: Column | None = None) -> DataFrame:
    """The commonest words of three letters or more in path parts without extensions and versions.

    Words are counted before anything else is sent; stop words (word) leave by an anti-join."""
    rows = files if noise is None else files.filter(~noise)
    bare = F.regexp_replace(F.lower(F.regexp_replace(paths.norm(F.col("path")), r"\.[A-Za-z0-9]{1,5}$", "")), r"v[0-9]+(\.[0-9]+)*|(19|20)[0-9]{2}", " ")
    counts = rows.select(F.explode(F.regexp_extract_all(bare, F.lit(r"[a-z]{3,}"), F.lit(0))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    if stopwords is not None:
        counts = counts.join(stopwords.select("word"), "word", "left_anti")
    return counts.orderBy(F.desc("n"), "word").limit(most)


def entity_frequency(texts: DataFrame, entities: DataFrame) -> DataFrame:
    """How many texts (text) hold each entity (name, two characters or more), whatever the case.

    Names are looked up by their rarest grams, so rows are only made for what may occur. Null names and texts
    take no part; repeated texts count each.
    """
    names = entities.select("name").filter(F.length("name") >= 2).distinct()
    found = containment.matches(texts.select("text"), "text", names.select(F.col("name").alias("keyword"))).groupBy("matched").agg(F.count(F.lit(1)).alias("texts"))
    return names.join(found, F.lower("name") == F.col("matched"), "left").select("name", F.coalesce("texts", F.lit(0)).alias("texts"))


def mention_audit(texts: DataFrame, entities: DataFrame, allowed: DataFrame) -> DataFrame:
    """Verdict FAIL for entities mentioned that aren't allowed, ABSENT for allowed ones that no text
    mentions, PASS for the rest that are mentioned."""
    counts = entity_frequency(texts, entities.select("name").unionByName(allowed.select("name")))
    rows = counts.join(allowed.select("name").distinct().withColumn("allowed", F.lit(True)), "name", "left").withColumn("allowed", F.coalesce("allowed", F.lit(False)))
    verdict = F.when((F.col("texts") > 0) & ~F.col("allowed"), "FAIL").when((F.col("texts") == 0) & F.col("allowed"), "ABSENT").when(F.col("texts") > 0, "PASS")
    return rows.withColumn("verdict", verdict).filter("verdict is not null").select("name", "texts", "verdict")


def evaluation_summary(runs: DataFrame, keys: list[str]) -> DataFrame:
    """By group, runs, successes, mean seconds of successes (2 digits), share with sources, credits."""
    ok = F.col("error").isNull()
    return runs.groupBy(*keys).agg(F.count(F.lit(1)).alias("runs"), F.count_if(ok).alias("succeeded"), F.round(F.avg(F.when(ok, F.col("elapsed_seconds"))), 2).alias("mean_seconds"), F.round(F.avg(F.col("has_sources").cast("double")) * 100, 2).alias("percent_sources"), F.sum("credits_used").alias("credits"))


def classification_quality(docs: DataFrame, other: str = "other") -> DataFrame:
    """Percent classified, mean winning score (50 is 100), percent with a summary, percent other."""
    share = lambda c: F.round(F.avg(c.cast("double")) * 100, 2)
    return docs.agg(share(F.col("label") != other).alias("classified"), F.round(F.least(F.lit(100.0), F.avg(F.col("score")) / 50 * 100), 2).alias("mean_score"), share(F.length("summary") > 20).alias("summarised"), share(F.col("label") == other).alias("other"))


#: Penalties by section: (measure, points each, most). A section starts at 100.
PENALTIES = {
    "families": (("impure", 8, 30), ("oversized", 10, 10), ("none_duplicated", 12, 12)),
    "clusters": (("leakage", 20, 45), ("weak", 8, 25), ("mostly_single", 10, 10)),
    "representatives": (("missing", 12, 35), ("final_not_preferred", 12, 30), ("duplicate_versions", 10, 25)),
    "status": (("unknown", 15, 45), ("low_confidence", 8, 25), ("no_risk", 10, 10), ("low_mean", 10, 10)),
}


def structural_audit(measures: DataFrame) -> DataFrame:
    """Score and warnings of each section out of measures (section, measure, n), and "overall",
    their mean rounded half to even."""
    table = [(s, m, each, most) for s, rows in PENALTIES.items() for m, each, most in rows]
    known = measures.sparkSession.createDataFrame(table, "section string, measure string, each long, most long")
    rows = known.join(measures, ["section", "measure"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    lost = F.least(F.col("most"), F.col("each") * F.col("n"))
    warnings = F.array_join(F.array_sort(F.collect_set(F.when(F.col("n") > 0, F.concat_ws("=", "measure", "n")))), ", ")
    sections = rows.groupBy("section").agg(F.greatest(F.lit(0), F.lit(100) - F.sum(lost)).alias("score"), warnings.alias("warnings"))
    overall = sections.agg(F.lit("overall").alias("section"), F.bround(F.avg("score")).cast("long").alias("score"), F.lit("").alias("warnings"))
    return sections.unionByName(overall)


def volume(files: DataFrame, unit_price: float, sheets: Sequence[str] = (".xlsx", ".csv")) -> DataFrame:
    """Files, characters, tokens and price to embed: the text's length, for sheets twelve a cell and
    half the size (20,000 at most), for name-only rows the placeholder's length."""
    chars = F.when(F.col("route") == "name_only", F.length("path") + 60).when(paths.suffix(F.col("path")).isin(*sheets), F.col("cells") * 12 + F.least(F.col("size_bytes") / 2, F.lit(20000))).otherwise(F.length("text"))
    total = files.agg(F.count(F.lit(1)).alias("files"), F.ceil(F.coalesce(F.sum(chars.cast("double")), F.lit(0.0))).alias("chars"))
    return total.withColumn("tokens", F.col("chars")).withColumn("cost", F.ceil(F.col("tokens") / 1000 * unit_price))


def token_price(chars: Column, price_in: float, price_out: float, output_tokens: Column) -> Column:
    """Price of a call: characters / 1.7 as tokens, one at least."""
    tokens = F.greatest(F.lit(1), (chars / 1.7).cast("int"))
    return tokens * price_in + output_tokens * price_out


def repeated(rows: DataFrame, value: str, ignore: str = "unknown") -> DataFrame:
    """Flag values that occur more than once; counts are joined back so a hot value is combined."""
    counts = rows.groupBy(value).agg(F.count(F.lit(1)).alias("times"))
    return rows.join(counts, value, "left").withColumn("is_repeated", F.coalesce((F.col("times") > 1) & (F.lower(value) != ignore), F.lit(False)))


def category_audit(files: DataFrame, noise: Column) -> DataFrame:
    """By category, files, noise files, distinct customers and projects."""
    return files.withColumn("noise", noise).groupBy("category").agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("noise")).alias("noise_files"), F.countDistinct("customer").alias("customers"), F.countDistinct("project").alias("projects"))


def project_flags(items: DataFrame, selected: DataFrame) -> DataFrame:
    """By selected project, critical items and whether any is incomplete or a risk."""
    own = items.join(selected.select("project"), "project", "left_semi")
    return own.groupBy("project").agg(F.count_if("is_critical").alias("critical"), F.coalesce(F.max("is_incomplete"), F.lit(False)).alias("has_incomplete"), F.coalesce(F.max("is_risk"), F.lit(False)).alias("has_risk"))


def basis_ratio(docs: DataFrame, keys: list[str]) -> DataFrame:
    """Shares 70, 20 and 10 of the roles a group has, made 100, rounding left to the first."""
    weights = {"representative": 70, "support": 20, "reference": 10}
    present = docs.groupBy(*keys).agg(*[F.max((F.col("role") == r).cast("int")).alias(r) for r in weights])
    total = sum((F.col(r) * w for r, w in weights.items()), F.lit(0))
    shares = present.select(*keys, *[F.when(total > 0, F.bround(F.col(r) * w * 100.0 / total)).otherwise(0).cast("int").alias(r) for r, w in weights.items()])
    rest = F.lit(100) - sum((F.col(r) for r in weights), F.lit(0))
    first = F.when(F.col("representative") > 0, "representative").when(F.col("support") > 0, "support").when(F.col("reference") > 0, "reference")
    return shares.withColumn("first", first).withColumn("rest", rest).select(*keys, *[F.when(F.col("first") == r, F.col(r) + F.col("rest")).otherwise(F.col(r)).alias(r) for r in weights])


def unit_documents(units: DataFrame, documents: DataFrame) -> DataFrame:
    """Documents of each unit: its own list, else its projects' files; with their number."""
    own = units.select("unit", F.explode_outer("documents").alias("doc")).filter("doc is not null")
    lent = units.filter("documents is null or size(documents) = 0").select("unit", F.explode("projects").alias("project")).join(documents, "project").select("unit", F.col("path").alias("doc"))
    counts = own.unionByName(lent).distinct().groupBy("unit").agg(F.count(F.lit(1)).alias("docs"))
    return units.select("unit").join(counts, "unit", "left").na.fill(0, ["docs"])


def customer_of(project: Column, valid: Column | None = None) -> Column:
    """A customer's name out of a project key: a valid one that it holds, else the part before "_",
    else a word with a company suffix, else the first word."""
    before = F.nullif(F.regexp_extract(project, r"^([^_]+)_", 1), F.lit(""))
    company = F.nullif(F.regexp_extract(project, r"(\S+(?:Inc|Ltd|GmbH|Corp|Co))\b", 1), F.lit(""))
    first = F.nullif(F.regexp_extract(project, r"^(\S+)", 1), F.lit(""))
    return F.coalesce(*([valid] if valid is not None else []), before, company, first, project)


def customer_rollup(projects: DataFrame) -> DataFrame:
    """By customer (own, else of the key), projects and distinct critical items in order."""
    rows = projects.withColumn("customer", F.coalesce("customer", customer_of(F.col("project"))))
    items = rows.select("customer", F.posexplode("critical").alias("pos", "item")).groupBy("customer", "item").agg(F.min("pos").alias("pos"))
    listed = items.groupBy("customer").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "item"))), lambda i: i["item"]).alias("critical"))
    return rows.groupBy("customer").agg(F.countDistinct("project").alias("projects")).join(listed, "customer", "left")


def overlap_match(projects: DataFrame, statuses: DataFrame) -> DataFrame:
    """The status (name, status, ord) that shares most name tokens with each project; without any
    the first status."""
    tokens = lambda c: F.explode(F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda t: t != "")))
    met = projects.select("project", tokens("project").alias("t")).join(statuses.select("status", "ord", tokens("name").alias("t")), "t").groupBy("project", "status", "ord").agg(F.count(F.lit(1)).alias("shared"))
    best = met.groupBy("project").agg(F.max_by("status", F.struct("shared", -F.col("ord"))).alias("status"))
    first = statuses.orderBy("ord").limit(1).select(F.col("status").alias("first"))
    return projects.select("project").distinct().join(best, "project", "left").join(F.broadcast(first), F.lit(True), "left").select("project", F.coalesce("status", "first").alias("status"))  # one row


def digest(docs: DataFrame, keys: list[str], caps: dict[str, int]) -> DataFrame:
    """One text for each group: blocks of its documents by role and score, each cut to its role's
    length. Groups are bounded by F20's document cap."""
    cap = F.element_at(F.create_map(*[F.lit(x) for p in caps.items() for x in p]), F.col("role"))
    block = F.concat(F.lit("["), "role", F.lit("] "), "name", F.lit("\n"), F.substring(F.col("text"), F.lit(1), cap))
    ranked = docs.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("role", F.desc("score"), "name"))).withColumn("block", block)
    return ranked.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "block"))), lambda b: b["block"]), "\n\n").alias("digest"))


def evidence_summary(docs: DataFrame, keys: list[str]) -> DataFrame:
    """Documents, deliverables, dates, those within 30 days of the latest, finals, importance."""
    latest = docs.groupBy(*keys).agg(F.max("day").alias("latest"))
    rows = docs.join(latest, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("docs"), F.count_if("is_deliverable").alias("deliverables"), F.countDistinct("day").alias("dates"), F.count_if(F.datediff("latest", "day") <= 30).alias("recent"), F.count_if("is_final").alias("finals"))
    points = F.least(F.lit(40), F.col("docs") * 5) + F.when(F.col("deliverables") > 0, 35).otherwise(0) + F.when(F.col("dates") > 0, 15).otherwise(0)
    return rows.withColumn("importance", points.cast("int"))
