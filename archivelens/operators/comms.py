"""Mails, chats and contacts."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WINDOWS = (31, 92, 183)


def attachments(emails: DataFrame) -> DataFrame:
    """source_file, filename, content, content_hash of distinct attachments; without content none."""
    rows = emails.select("source_file", F.explode("attachments").alias("a")).select("source_file", "a.filename", "a.content").filter("content is not null")
    hashed = rows.withColumn("content_hash", F.sha2("content", 256))
    return hashed.groupBy("source_file", "filename", "content_hash").agg(F.first("content").alias("content"))


def mail_texts(emails: DataFrame, missing: str = "(no subject)") -> DataFrame:
    """One text for each source file (the least by subject and date): header lines and body."""
    one = emails.groupBy("source_file").agg(F.min(F.struct("subject", "date_raw", "sender", "recipient", "body")).alias("m")).select("source_file", "m.*")
    subject = F.when(F.coalesce(F.trim("subject"), F.lit("")) == "", missing).otherwise(F.col("subject"))
    head = F.concat(F.lit("From: "), F.coalesce("sender", F.lit("")), F.lit("\nTo: "), F.coalesce("recipient", F.lit("")), F.lit("\nSubject: "), subject, F.lit("\nDate: "), F.coalesce("date_raw", F.lit("")))
    return one.select("source_file", F.concat(head, F.lit("\n\n"), F.coalesce("body", F.lit(""))).alias("text"))


def contacts(items: DataFrame, as_of: Column, windows: Sequence[int] = WINDOWS, work_terms: Sequence[str] = (), most: int = 10, own_names: Sequence[str] = ()) -> DataFrame:
    """The main contacts out of items (sender, recipients array, ts, text, kind "mail" or "chat").

    A contact is a lower-cased address, or "messenger:" and a lower-cased name in chats; each
    occurrence as sender or recipient counts. Windows are nested and end at ``as_of`` (later items
    don't count); work counts items with a work term. Order: work, windows from short to long, key.
    """
    people = F.array_append(F.coalesce("recipients", F.array().cast("array<string>")), F.col("sender"))
    rows = items.select("kind", "ts", "text", F.explode(people).alias("who")).filter(F.coalesce(F.trim("who"), F.lit("")) != "")
    if own_names:
        rows = rows.filter((F.col("kind") != "chat") | ~F.col("who").isin(*own_names))
    key = F.when(F.col("kind") == "chat", F.concat(F.lit("messenger:"), F.lower(F.trim("who")))).otherwise(F.lower(F.trim("who")))
    inside = [F.count_if((F.col("ts") <= as_of) & (F.col("ts") >= as_of - F.make_dt_interval(F.lit(d)))).alias(f"last_{d}d") for d in windows]
    work = F.count_if(F.exists(F.array(*map(F.lit, work_terms)), lambda w: F.contains(F.lower("text"), w)) if work_terms else F.lit(False)).alias("work")
    grouped = rows.groupBy(key.alias("contact")).agg(F.count(F.lit(1)).alias("items"), work, *inside)
    return grouped.orderBy(F.desc("work"), *[F.desc(f"last_{d}d") for d in windows], "contact").limit(most)


def guess_self(items: DataFrame) -> DataFrame:
    """The address that both sends and receives most: largest (least of both counts, their sum);
    no row if two tie."""
    sent = items.groupBy(F.lower("sender").alias("contact")).agg(F.count(F.lit(1)).alias("sent"))
    got = items.select(F.explode("recipients").alias("r")).groupBy(F.lower("r").alias("contact")).agg(F.count(F.lit(1)).alias("received"))
    both = sent.join(got, "contact").withColumn("score", F.struct(F.least("sent", "received").alias("least"), (F.col("sent") + F.col("received")).alias("sum")))
    best = both.agg(F.max("score").alias("score"))
    return both.join(F.broadcast(best), "score").groupBy("score").agg(F.min("contact").alias("contact"), F.count(F.lit(1)).alias("n"), F.max("sent").alias("sent"), F.max("received").alias("received")).filter("n = 1").select("contact", "sent", "received")  # best is one row


def recent_items(items: DataFrame, keys: list[str], most: int = 5) -> DataFrame:
    """the latest items of each group, ties by item_id."""
    return items.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc_nulls_last("ts"), "item_id"))).filter(F.col("rank") <= most)


def select_relevant(items: DataFrame, keys: list[str], matched: Column, most: int = 10) -> DataFrame:
    """matching items, newest first, filled up with the newest others; numbered newest first."""
    rows = items.withColumn("matched", F.coalesce(matched, F.lit(False)))
    first = rows.withColumn("pick", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("matched"), F.desc_nulls_last("ts"), "item_id"))).filter(F.col("pick") <= most)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc_nulls_last("ts"), "item_id")))


def chat_blocks(messages: DataFrame, hit: Column, around: int = 5) -> DataFrame:
    """F18, blocks: lines within ``around`` lines of a hit, with block_no of each run of lines."""
    own = Window.partitionBy("source_file").orderBy("line_no")
    near = F.max(F.coalesce(hit, F.lit(False)).cast("int")).over(own.rowsBetween(-around, around))
    rows = messages.withColumn("place", F.row_number().over(own)).withColumn("near", near).filter("near = 1")
    gap = (F.col("place") - F.lag("place").over(own) > 1).cast("int")
    return rows.withColumn("block_no", F.sum(F.coalesce(gap, F.lit(0))).over(own) + 1).drop("near")


def chat_context(messages: DataFrame, hit: Column, around: int = 5, budget: int = 50) -> DataFrame:
    """source_file, line_no, gap of the lines of a chat that are kept.

    Blocks around hits are taken newest first while a whole block still fits the budget, then the
    newest other lines fill it; gap marks a break before a line. Python looks at the bounds of blocks
    only: of each length n the newest ``budget / n`` of a file, as more of them can't be taken.
    """
    numbered = messages.withColumn("place", F.row_number().over(Window.partitionBy("source_file").orderBy("line_no")))
    blocks = chat_blocks(messages, hit, around).groupBy("source_file", "block_no").agg(F.min("place").alias("first"), F.max("place").alias("last"))
    length = F.col("last") - F.col("first") + 1
    newest = F.row_number().over(Window.partitionBy("source_file", "length").orderBy(F.desc("first")))
    blocks = blocks.withColumn("length", length).filter(F.col("length") <= budget).withColumn("n", newest).filter(F.col("n") * F.col("length") <= budget)
    kind = dict(messages.dtypes)["source_file"]

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        left, taken = budget, []
        for first, last in rows.sort_values("first", ascending=False)[["first", "last"]].itertuples(index=False):
            if last - first + 1 <= left:
                left -= last - first + 1
                taken.append((first, last))
        return pd.DataFrame([(rows["source_file"].iloc[0], a, b) for a, b in taken], columns=["source_file", "first", "last"])

    chosen = blocks.groupBy("source_file").applyInPandas(choose, f"source_file {kind}, first int, last int")
    lines = chosen.select("source_file", F.explode(F.sequence("first", "last")).alias("place"))
    marked = numbered.join(lines.withColumn("block", F.lit(1)), ["source_file", "place"], "left")
    used = F.coalesce(F.sum("block").over(Window.partitionBy("source_file")), F.lit(0))
    fill = F.row_number().over(Window.partitionBy("source_file").orderBy(F.col("block").asc_nulls_first(), F.desc("place")))
    kept = marked.withColumn("used", used).withColumn("fill", fill).filter((F.col("block") == 1) | (F.col("fill") <= F.lit(budget) - F.col("used")))
    before = F.lag("place").over(Window.partitionBy("source_file").orderBy("place"))
    return kept.withColumn("gap", F.coalesce(F.col("place") - before > 1, F.lit(False))).select("source_file", "line_no", "gap")


def parse_mail(data: bytes) -> dict:
    """One mail as a row, by the standard library."""
    from email import message_from_bytes, policy

    message = message_from_bytes(data, policy=policy.default)
    body = message.get_body(preferencelist=("plain", "html"))
    files = [{"filename": part.get_filename() or "", "content": part.get_payload(decode=True), "size": len(part.get_payload(decode=True) or b"")} for part in message.iter_attachments()]
    return {"sender": str(message["from"] or ""), "recipient": str(message["to"] or ""), "subject": str(message["subject"] or ""), "date_raw": str(message["date"] or ""), "body": body.get_content() if body else "", "attachments": files}


MAIL = "source_file string, sender string, recipient string, subject string, date_raw string, body string, attachments array<struct<filename: string, content: binary, size: long>>, error string"


def read_mails(files: DataFrame) -> DataFrame:
    """Rows out of binary files (path, content): .eml files, and the mails of .zip files as
    "zip::member". A file that can't be read is a row with its error."""

    def members(path: str, content: bytes) -> Iterator[tuple[str, bytes]]:
        if not path.lower().endswith(".zip"):
            yield path, content
            return
        import io
        import zipfile

        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for name in sorted(z.namelist()):
                if name.lower().endswith(".eml"):
                    yield f"{path}::{name}", z.read(name)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in ("source_file", "sender", "recipient", "subject", "date_raw", "body", "attachments", "error")]
        for batch in batches:
            out = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    out += [{"source_file": name, **parse_mail(data), "error": None} for name, data in members(path, content)]
                except Exception as e:  # noqa: BLE001  (any bad file becomes a row)
                    out.append(dict.fromkeys(columns) | {"source_file": path, "attachments": [], "error": f"{type(e).__name__}: {e}"})
            yield pd.DataFrame(out, columns=columns)

    return files.select("path", "content").mapInPandas(read, MAIL)


def parse_chat(texts: DataFrame) -> DataFrame:
    """A10: source_file, line_no, ts, sender, message of line logs (path, text).

    A separator line with dashes and a date sets the day of the lines after it; a message line is
    "[sender] [am|pm h:mm] text"; other lines are skipped. One pass over a file's lines in order.
    """
    lines = texts.select(F.col("path").alias("source_file"), F.posexplode(F.split("text", "\r?\n")).alias("line_no", "line"))
    day = F.when(F.contains("line", F.lit("---")), F.regexp_extract("line", r"(\d{4})[^\d]+(\d{1,2})[^\d]+(\d{1,2})", 0))
    parts = F.array(*[F.regexp_extract("line", r"(\d{4})[^\d]+(\d{1,2})[^\d]+(\d{1,2})", k) for k in (1, 2, 3)])
    date = F.when(F.coalesce(day, F.lit("")) != "", F.concat_ws("-", F.get(parts, 0), F.lpad(F.get(parts, 1), 2, "0"), F.lpad(F.get(parts, 2), 2, "0")))
    pattern = r"^\[([^\]]+)\]\s*\[(am|pm|AM|PM)\s*(\d{1,2}):(\d{2})\]\s?(.*)$"
    dated = lines.withColumn("day", F.last(date, ignorenulls=True).over(Window.partitionBy("source_file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)))
    rows = dated.filter(F.regexp_like("line", F.lit(pattern)))
    hour = F.regexp_extract("line", pattern, 3).cast("int") % 12 + F.when(F.lower(F.regexp_extract("line", pattern, 2)) == "pm", 12).otherwise(0)
    clock = F.format_string("%s %02d:%s:00", "day", hour, F.regexp_extract("line", pattern, 4))
    return rows.select("source_file", F.col("line_no").cast("long").alias("line_no"), F.when(F.col("day").isNotNull(), F.try_to_timestamp(clock, F.lit("yyyy-MM-dd HH:mm:ss"))).alias("ts"), F.regexp_extract("line", pattern, 1).alias("sender"), F.regexp_extract("line", pattern, 5).alias("message"))
