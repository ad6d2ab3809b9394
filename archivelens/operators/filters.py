"""Filters that say why: each rule is a branch of a reason column, and rows are split by it after."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archivelens.functions import paths
from archivelens.operators import catalog

#: Default lists, replaceable by parameter (own choice).
STRICT_FOLDERS = ("node_modules", "__pycache__", ".git", "dist", "build", ".venv")
CONTEXT_FOLDERS = ("backup", "temp", "cache", "archive")
NOISE_EXTENSIONS = (".tmp", ".log", ".lock", ".bak", ".pyc")
NOISE_STEMS = ("readme", "license", "changelog", "untitled")
NOISE_PARTS = ("autosave", "~$", "conflicted copy")
UNSUPPORTED = (".png", ".jpg", ".jpeg", ".gif", ".bmp", ".tmp", ".exe", ".dll")


def route(files: DataFrame, selected: Sequence[str], most: int | None = None, limits: DataFrame | None = None) -> DataFrame:
    """B2: ``route`` is "content" for a selected extension within its size limit, else "name_only".

    Without ``limits`` one size ``most`` (null: none) holds. With ``limits`` (extension, max_bytes,
    unlimited) an extension that isn't listed, or has limit 0, is off.
    """
    chosen = paths.suffix(F.col("path")).isin(*selected)
    if limits is None:
        fits = F.lit(True) if most is None else F.col("size_bytes") <= most
        return files.withColumn("route", F.when(chosen & fits, "content").otherwise("name_only"))
    own = limits.select(F.col("extension").alias("limit_ext"), F.col("max_bytes").alias("limit_bytes"), F.coalesce("unlimited", F.lit(False)).alias("limit_none"))
    rows = files.join(own, paths.suffix(F.col("path")) == F.col("limit_ext"), "left")
    fits = F.col("limit_none") | ((F.coalesce("limit_bytes", F.lit(0)) > 0) & (F.col("size_bytes") <= F.col("limit_bytes")))
    return rows.withColumn("route", F.when(chosen & F.coalesce(fits, F.lit(False)), "content").otherwise("name_only")).drop("limit_ext", "limit_bytes", "limit_none")


def noise_reason(path: Column, above: bool = False) -> Column:
    """Why a path is noise, the first rule that holds; null if none does.

    Strict folders anywhere; bad extensions; whole stems; parts of a stem; folders such as backups
    only if at least two other folders give the path a meaning, with ``above`` two folders above them, of two
    characters or more and no drives.
    """
    folders = F.transform(F.slice(F.split(paths.norm(path), "/"), F.lit(1), paths.depth(path) - 1), F.lower)
    strict = F.filter(folders, lambda f: f.isin(*STRICT_FOLDERS))
    context = F.filter(folders, lambda f: f.isin(*CONTEXT_FOLDERS))
    enough = (F.size(context) > 0) & (F.size(folders) - F.size(context) >= 2)
    if above:
        told = F.transform(folders, lambda f: ((F.length(f) > 1) & ~F.regexp_like(f, F.lit("^.:.?$"))).cast("int"))
        context = F.filter(folders, lambda f, i: f.isin(*CONTEXT_FOLDERS) & (F.aggregate(F.slice(told, F.lit(1), i), F.lit(0), lambda n, x: n + x) >= 2))
        enough = F.size(context) > 0
    stem, ext = F.lower(paths.stem(path)), paths.suffix(path)
    inside = F.filter(F.array(*map(F.lit, NOISE_PARTS)), lambda p: F.contains(stem, p))
    return (
        F.when(F.size(strict) > 0, F.concat(F.lit("folder:"), F.get(strict, 0)))
        .when(ext.isin(*NOISE_EXTENSIONS), F.concat(F.lit("extension:"), ext))
        .when(stem.isin(*NOISE_STEMS), F.concat(F.lit("stem:"), stem))
        .when(F.size(inside) > 0, F.concat(F.lit("part:"), F.get(inside, 0)))
        .when(enough, F.concat(F.lit("folder:"), F.get(context, 0)))
    )


def exclusions(files: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Reason why a file goes: system or hidden, unsupported type, too old; null: stays."""
    system = F.col("is_hidden") | F.lower("name").isin(*catalog.SYSTEM)
    old = ~catalog.since(days, as_of, F.greatest("modified_at", "created_at"))
    reason = F.when(system, "excluded_extension_or_system").when(paths.suffix(F.col("path")).isin(*UNSUPPORTED), "unsupported_type").when(old, f"older_than_{days}_days")
    return files.withColumn("reason", reason)


def empty_extract(docs: DataFrame, extension: str = ".pdf", least: int = 80) -> DataFrame:
    """Reason "image_only" for extracted texts of ``extension`` that are almost empty."""
    bare = (paths.suffix(F.col("path")) == extension) & (F.length(F.trim(F.coalesce("text", F.lit("")))) < least)
    return docs.withColumn("reason", F.when(bare, "image_only"))


def placeholders(files: DataFrame) -> DataFrame:
    """A stand-in text for rows whose content isn't read (status tells why)."""
    text = F.format_string("[no content] name: %s, path: %s, modified: %s, status: %s", "name", "path", F.date_format("modified_at", "yyyy-MM-dd HH:mm:ss"), "status")
    return files.withColumn("text", text)


def is_placeholder(status: Column, text: Column) -> Column:
    """B10."""
    return F.coalesce(status.isin("not_in_whitelist", "skipped_large_file", "unsupported_format", "extract_timeout"), F.lit(False)) | F.coalesce(F.contains(text, F.lit("[no content]")), F.lit(False))


def source_type(path: Column, chat_word: str = "chat") -> Column:
    """B12."""
    ext = paths.suffix(path)
    return F.when(ext.isin(".eml", ".msg"), "email").when((ext == ".txt") & F.contains(F.lower(paths.name(path)), F.lit(chat_word)), "chat").otherwise("document")


def media_filter(query: Column, path: Column, mail_words: Sequence[str] = ("mail",), chat_words: Sequence[str] = ("chat", "message")) -> Column:
    """Whether a row passes: a query about mails wants mails, one about chats wants chats."""
    has = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(query), w))
    kind = source_type(path)
    return F.when(has(mail_words), kind == "email").when(has(chat_words), kind == "chat").otherwise(F.lit(True))


def not_memo(query: Column, path: Column, words: Sequence[str] = ("memo", "note")) -> Column:
    """Memo paths only pass if the query speaks of memos."""
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(query), w)) | ~path.startswith("memo:")


def all_terms(target: Column, terms: Column) -> Column:
    """Every term occurs."""
    return F.forall(terms, lambda t: F.contains(F.lower(target), t))


def funnel(ledger: DataFrame) -> DataFrame:
    """Rows and percent by reason, "kept" for those without."""
    counts = ledger.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("files"))
    total = ledger.agg(F.count(F.lit(1)).alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("reason", "files", F.round(F.lit(100.0) * F.col("files") / F.col("total"), 4).alias("percent"))  # one row each side at most a reason


def split(ledger: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows that stay, and the exclusion ledger (name, reason)."""
    return ledger.filter("reason is null").drop("reason"), ledger.filter("reason is not null").select("name", "reason")
