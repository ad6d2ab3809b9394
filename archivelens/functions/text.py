"""Text columns: cleaning, sampling, snippets, dates in names, and small parsers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tags that end a line, and the entities decoded in SQL (fixed values).
BREAKS = r"(?i)<(?:br|/p|/div|/tr|/li|/h[1-6])\s*/?>"
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))
SIGNATURE_WORDS = ("tel", "phone", "mobile", "fax", "e-mail", "email", "address", "www")


def terms(query: Column, stopwords: Sequence[str] = ()) -> Column:
    """H2: lower-cased runs of letters and digits with at least two characters, stop words left out."""
    found = F.regexp_extract_all(F.lower(query), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.filter(found, lambda t: (F.length(t) >= 2) & (~t.isin(*stopwords) if stopwords else F.lit(True)))


def strip_suffix(term: Column, suffixes: Sequence[str]) -> Column:
    """H3: without the first suffix of the list that ends it and leaves at least two characters."""
    out = term
    for suffix in reversed(suffixes):
        out = F.when(term.endswith(suffix) & (F.length(term) > len(suffix) + 1), F.substring(term, F.lit(1), F.length(term) - len(suffix))).otherwise(out)
    return out


def match_terms(query: Column, stopwords: Sequence[str] = (), suffixes: Sequence[str] = ()) -> Column:
    """H4: terms to look for, distinct, without suffixes, stop words or any with digits."""
    bare = F.transform(terms(query, stopwords), lambda t: strip_suffix(t, suffixes))
    keep = lambda t: (F.length(t) >= 2) & ~F.regexp_like(t, F.lit(r"[0-9]")) & (~t.isin(*stopwords) if stopwords else F.lit(True))
    return F.array_distinct(F.filter(bare, keep))


def source_tokens(name: Column, stopwords: Sequence[str] = (), suffixes: Sequence[str] = ()) -> Column:
    """H5: tokens of a name or path, without extension words and pure numbers."""
    parts = F.transform(F.split(F.lower(name), r"[\s_\-./\\()\[\]{},;:+&@#!~]+"), lambda t: strip_suffix(t, suffixes))
    skip = [*stopwords, "docx", "xlsx", "pdf", "pptx", "txt", "md", "csv", "eml", "hwp"]
    return F.array_distinct(F.filter(parts, lambda t: (F.length(t) >= 2) & ~t.isin(*skip) & ~F.regexp_like(t, F.lit(r"^[0-9]+$"))))


def query_overlap(wanted: Column, target: Column) -> Column:
    """H8: share of the terms that occur in a text."""
    hits = F.size(F.filter(wanted, lambda t: F.contains(F.lower(target), t)))
    return F.when(F.size(wanted) > 0, hits / F.size(wanted)).otherwise(F.lit(0.0))


def drop_lines(text: Column, words: Sequence[str]) -> Column:
    """H9: without the lines that hold any of the words, whatever their case."""
    lines = F.filter(F.split(text, "\n"), lambda line: ~F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(line), w)))
    return F.array_join(lines, "\n")


def is_html(text: Column) -> Column:
    return F.regexp_like(F.substring(text, 1, 2000), F.lit(r"(?i)<(?:html|body|div|p|table|br|head|!doctype)[\s>/]"))


def html_text(html: Column) -> Column:
    """Readable lines of an html text: scripts and styles go, breaking tags end lines, other
    tags go, common entities are decoded, blanks collapse and empty lines go."""
    out = F.regexp_replace(F.regexp_replace(html, r"(?is)<script.*?</script>", " "), r"(?is)<style.*?</style>", " ")
    out = F.regexp_replace(F.regexp_replace(out, BREAKS, "\n"), r"(?s)<[^>]*>", " ")
    for entity, char in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    lines = F.transform(F.split(out, "\n"), lambda line: F.trim(F.regexp_replace(line, r"[ \t\r\f]+", " ")))
    return F.array_join(F.filter(lines, lambda line: line != ""), "\n")


def without_quotes(text: Column) -> Column:
    """A mail without what it quotes (from "Original Message", the first line that starts with
    ">", or "On ... wrote:" to the end) and without a signature: from a separator line that two
    signature words follow within seven lines."""
    cut = F.regexp_replace(text, r"(?is)-*\s*original message.*$", "")
    cut = F.regexp_replace(F.regexp_replace(cut, r"(?ms)^>.*\z", ""), r"(?ims)^on [^\n]* wrote:.*\z", "")
    lines = F.split(cut, "\n")
    words = F.array(*map(F.lit, SIGNATURE_WORDS))

    def signed(at: Column) -> Column:
        after = F.lower(F.array_join(F.slice(lines, at + 1, F.lit(7)), "\n"))
        return F.regexp_like(F.get(lines, at - 1), F.lit(r"^\s*(?:--+|__+|==+)\s*$")) & (F.size(F.filter(words, lambda w: F.contains(after, w))) >= 2)

    first = F.array_min(F.filter(F.sequence(F.lit(1), F.size(lines)), signed))
    kept = F.when(first.isNotNull(), F.slice(lines, F.lit(1), first - 1)).otherwise(lines)
    return F.btrim(F.array_join(kept, "\n"), F.lit(" \t\r\n"))


def preprocess(text: Column, kind: Column, common: Sequence[str], mail: Sequence[str]) -> Column:
    """By source type: mails from html, without boilerplate lines, quotes and signatures;
    documents without common boilerplate lines; chats as they are."""
    body = F.when(is_html(text), html_text(text)).otherwise(text)
    return F.when(kind == "email", without_quotes(drop_lines(body, [*common, *mail]))).when(kind == "document", drop_lines(text, common)).otherwise(text)


def sample(text: Column, most: int = 5000) -> Column:
    """Of a long text, 60 % from its front, 20 % from around its centre and 20 % from its end."""
    front, part, n = most * 6 // 10, most * 2 // 10, F.length(text)
    middle = F.substring(text, F.floor(n / 2).cast("int") - part // 2 + 1, F.lit(part))
    return F.when(n <= most, text).otherwise(F.concat(F.substring(text, 1, front), F.lit("\n[... middle ...]\n"), middle, F.lit("\n[... end ...]\n"), F.substring(text, n - part + 1, F.lit(part))))


def snippet(text: Column, words: Column, most: int = 300) -> Column:
    """A window of a long text around the earliest word that occurs, else its head."""
    at = F.array_min(F.filter(F.transform(words, lambda w: F.call_function("instr", F.lower(text), F.lower(w))), lambda p: p > 0))
    start = F.greatest(F.lit(1), F.least(at - most // 2, F.length(text) - most + 1))
    window = F.concat(F.when(start > 1, "...").otherwise(""), F.substring(text, start, F.lit(most)), F.when(start + most - 1 < F.length(text), "...").otherwise(""))
    return F.when(F.length(text) <= most, text).when(at.isNull(), F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(window)


def preview(text: Column, most: int) -> Column:
    """Blanks collapsed, cut with dots."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most), F.lit("..."))).otherwise(flat)


def cell(value: Column, kind: Column) -> Column:
    """A number as its cell format shows it (percent, currency, grouped, integer, plain)."""
    return F.when(kind == "percent", F.concat(F.format_number(value * 100, 1), F.lit("%"))).when(kind == "currency", F.concat(F.lit("$"), F.format_number(value, 2))).when(kind == "grouped", F.format_number(value, 0)).when(kind == "integer", value.cast("long").cast("string")).otherwise(value.cast("string"))


def sheet_row(headers: Column, cells: Column, columns: int = 20) -> Column:
    """H19: "header: value" pairs of a row, empty cells left out, at most ``columns`` of them."""
    pairs = F.zip_with(F.slice(headers, 1, columns), F.slice(cells, 1, columns), lambda h, c: F.when(c.isNotNull() & (c != ""), F.concat_ws(": ", h, c)))
    return F.array_join(F.filter(pairs, lambda p: p.isNotNull()), " | ")


def parse_time(raw: Column) -> Column:
    """ISO (also with Z), slashed or dotted dates and mail dates; null if none fits."""
    bare = F.regexp_replace(F.trim(raw), r"^[A-Za-z]{3},\s*", "")
    forms = ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd", "yyyy.MM.dd", "d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss")
    return F.coalesce(*[F.try_to_timestamp(bare, F.lit(f)) for f in forms])


def name_dates(name: Column) -> Column:
    """Distinct dates written in a name as yyyymmdd or yymmdd, with or without separators."""
    eight = F.regexp_extract_all(name, F.lit(r"(?<![0-9])(20[0-9]{2}[-_.]?(?:0[1-9]|1[0-2])[-_.]?(?:0[1-9]|[12][0-9]|3[01]))(?![0-9])"), F.lit(1))
    six = F.regexp_extract_all(name, F.lit(r"(?<![0-9])([12][0-9](?:0[1-9]|1[0-2])(?:0[1-9]|[12][0-9]|3[01]))(?![0-9])"), F.lit(1))
    digits = F.concat(F.transform(eight, lambda d: F.regexp_replace(d, "[-_.]", "")), F.transform(six, lambda d: F.concat(F.lit("20"), d)))
    return F.array_distinct(F.filter(F.transform(digits, lambda d: F.try_to_timestamp(d, F.lit("yyyyMMdd")).cast("date")), lambda d: d.isNotNull()))


def recency(as_of: Column, at: Column) -> Column:
    """Points for how lately a file was changed."""
    days = F.datediff(as_of, at)
    return F.when(at.isNull(), 0).when(days <= 7, 20).when(days <= 30, 15).when(days <= 90, 10).when(days <= 180, 5).when(days <= 730, 0).otherwise(-5)


def created_recency(as_of: Column, at: Column) -> Column:
    days = F.datediff(as_of, at)
    return F.when(at.isNull(), 0).when(days <= 90, 10).when(days <= 365, 5).otherwise(0)


def clamp(value: Column, low: float = 0, high: float = 100) -> Column:
    """H24."""
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def gigabytes(size: Column) -> Column:
    """Decimal gigabytes without trailing zeros."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.9f", size / F.lit(1e9)), r"0+$", ""), r"\.$", "")


def section(text: Column, label: str, labels: Sequence[str]) -> Column:
    """What follows "label:" up to the next of the labels; "" if it isn't there."""
    rest = "|".join(labels)
    return F.trim(F.regexp_extract(text, rf"(?s)(?:^|\n)\s*{label}\s*:\s*(.*?)(?=\n\s*(?:{rest})\s*:|\z)", 1))


def json_prefix(text: Column, outer: str = "primary", inner: str = "answer") -> Column:
    """The part that is there already of the string under ``inner``, behind an object ``outer`` if there is
    one, in JSON that may be unfinished; "" without it. What ends in the middle of an escape ends before it; an
    escape that JSON doesn't know is its character. A null text gives a null."""
    opened = rf'"{outer}"\s*:\s*\{{'
    start = rf'"{inner}"\s*:\s*"'
    body = r'((?:[^"\\]++|\\u[0-9a-fA-F]{4}|\\[^u])*+)'
    behind = F.when(F.regexp_like(text, F.lit(opened)), F.regexp_extract(text, rf"(?s){opened}(.*)", 1)).otherwise(text)
    raw = F.regexp_extract(behind, rf"(?s){start}{body}", 1)
    options = {"allowUnquotedControlChars": "true", "allowBackslashEscapingAnyCharacter": "true", "maxStringLen": str((1 << 31) - 1)}
    return F.from_json(F.concat(F.lit('{"s":"'), raw, F.lit('"}')), "s string", options)["s"]


def numbered(text: Column, most: int = 10) -> Column:
    """Entries of a numbered list."""
    return F.slice(F.transform(F.regexp_extract_all(text, F.lit(r"(?m)^\s*[0-9]+[.)]\s*(.+)$"), F.lit(1)), F.trim), 1, most)


def outline_level(line: Column) -> Column:
    """1 for "1." or a plain line, 2 for "1.1", bullets or indented lines."""
    return F.when(F.regexp_like(line, F.lit(r"^(?:\s{2,}|\t|\s*[-*•]|\s*[0-9]+\.[0-9]+)")), 2).otherwise(1)


def common_prefix(names: Column) -> Column:
    """Leading words that all names share."""
    words = F.transform(names, lambda n: F.split(n, r"[\s_\-]+"))
    first = F.get(words, 0)
    upto = F.array_max(F.filter(F.sequence(F.lit(0), F.size(first)), lambda k: F.forall(words, lambda w: F.slice(w, F.lit(1), k) == F.slice(first, F.lit(1), k))))
    return F.array_join(F.slice(first, F.lit(1), upto), " ")


def common_tokens(names: Column) -> Column:
    """Words that all names share, sorted."""
    sets = F.transform(names, lambda n: F.array_distinct(F.split(F.lower(n), r"[\s_\-]+")))
    return F.array_sort(F.aggregate(F.slice(sets, 2, 1 << 30), F.get(sets, 0), lambda a, b: F.array_intersect(a, b)))


def fingerprint(*columns: Column) -> Column:
    """Hash of fields in order, nulls as empty."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns]), 256)


def summary(name: Column, text: Column, most: int = 800) -> Column:
    """A rule-based summary: the name and the head of the text."""
    return F.format_string("Document: %s\nExcerpt: %s", name, preview(text, most))


def block_of(answer: Column, name: Column, most: int = 800) -> Column:
    """One document's block out of a batched answer: between its delimiters, else from its name
    to the next blank line, else the head of the answer."""
    marked = F.call_function("substring_index", F.call_function("substring_index", answer, F.concat(F.lit("### "), name, F.lit("\n")), F.lit(-1)), F.lit("\n### "), F.lit(1))
    has = F.contains(answer, F.concat(F.lit("### "), name, F.lit("\n")))
    after = F.call_function("substring_index", F.call_function("substring_index", answer, name, F.lit(-1)), F.lit("\n\n"), F.lit(1))
    return F.trim(F.when(has, marked).when(F.contains(answer, name), after).otherwise(F.substring(answer, 1, most)))


def outline(texts: DataFrame, key: str = "doc_id") -> DataFrame:
    """Key, line_no, level, label and parent of outline lines: numbered lines are parents, bullets,
    sub-numbers and indented lines their children. The parent is carried forward over a text's lines."""
    lines = texts.select(key, F.posexplode(F.split("text", "\n")).alias("line_no", "line")).filter(F.trim("line") != "")
    rows = lines.withColumn("level", outline_level(F.col("line"))).withColumn("label", F.trim(F.regexp_replace("line", r"^\s*(?:(?:[0-9]+(?:\.[0-9]+)*[.)]?|[-*•])\s*)?", "")))
    order = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    above = F.last(F.when(F.col("level") == 1, F.col("label")), ignorenulls=True).over(order)
    return rows.select(key, "line_no", "level", "label", F.when(F.col("level") == 2, above).alias("parent"))
