"""URL filters by host word segmentation (operator 4).

Host names run words together. The most likely split under a unigram model of the pages' own words is
found by the Viterbi algorithm, and a multinomial naive Bayes model over host words and path tokens
judges each url. Explicit rules come first. The model is taught one thing over all pages: whether the text
that a page shows is junk. A page is judged by a model that has seen no page of its own host.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archivelens.functions import scratch

#: (verdict, host, path); the longest rule that fits wins. The operator's own example.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("block", "net", "/de/"), ("allow", "example.net", "/de/8"), ("block", "org", "/es/"))
#: The rules of the registered query's contract.
CONTRACT = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
#: Hash buckets of naive Bayes (a fixed size, so the model can be sent to every task); added to each count;
#: folds of hosts.
BUCKETS, SMOOTH, FOLDS = 1 << 16, 0.5, 2
#: Marks that prose hardly has, and the share of them from which a page's text is junk.
MARKS, JUNK = "*#%$&@^~|", 0.05


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without "://" or a url."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(host, upper, lower), F.lit("")), F.coalesce(path, F.lit(""))


def rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits (host and path joined) and its verdict; nulls if none does."""
    name = verdict = F.lit(None).cast("string")
    for kind, own, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(start)
        name, verdict = F.when(fits, F.lit(own + start)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def word_counts(pages: DataFrame) -> DataFrame:
    """word, n: the unigram model: runs of two letters or more, of any script, lower-cased, counted over the whole
    html of all pages. A null html has none; other columns don't count; an empty table gives no rows."""
    runs = F.regexp_extract_all(F.lower("html"), F.lit(r"\p{L}{2,}"), F.lit(0))
    return pages.select(F.explode(runs).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def junk(html: Column) -> Column:
    """Whether the text that a page shows is junk: ``JUNK`` or more of its characters are ``MARKS``."""
    shown = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", " "), r"(?s)<[^>]*>|&[a-zA-Z0-9#]+;", " ")
    left = F.length(F.translate(shown, MARKS, ""))
    return F.coalesce(F.length(shown) - left >= F.greatest(F.length(shown) * JUNK, F.lit(1.0)), F.lit(False))


def viterbi(label: str, found: list[tuple[int, int, float]], total: float) -> list[str]:
    """The split of ``label`` with the highest likelihood, of equals the one with the longest last word, and so on.
    ``found`` has (start, length, count) of known words of two letters or more; any other piece counts as a word
    whose odds fall tenfold with each character, so the best such piece up to a place is a running maximum."""
    fall, base = float(np.log(10)), 1.0 - float(np.log(total))
    known: dict[int, list[tuple[int, float]]] = {}
    for start, size, n in found:
        known.setdefault(start + size, []).append((start, float(np.log(n / total))))
    best: list[tuple[float, int]] = [(0.0, 0)]
    lead = (0.0, 0)  # the best of score + fall * start, and where it starts
    for end in range(1, len(label) + 1):
        options = [(lead[0] + base - fall * end, -lead[1])]
        options += [(best[start][0] + cost, -start) for start, cost in known.get(end, ())]
        score, start = max(options)
        best.append((score, -start))
        lead = max(lead, (score + fall * end, end), key=lambda x: (x[0], -x[1]))
    words, end = [], len(label)
    while end:
        start = best[end][1]
        words.append(label[start:end])
        end = start
    return words[::-1]


def segment(labels: DataFrame, counts: DataFrame) -> DataFrame:
    """label, words for each distinct ``label``, however long. Only those of its substrings that have the length of a
    word meet the word counts, by an ordinary join, so neither the model nor the labels need to fit one task.

    Null and empty labels are left out; repeats give one row; other columns don't count; an empty table gives no
    rows. Without word counts a label is one word.
    """
    labels = labels.select("label").filter("label <> ''").distinct()
    total = float(counts.agg(F.sum("n")).head()[0] or 1)
    sizes = sorted(r[0] for r in counts.select(F.length("word")).distinct().collect())  # one row for each length
    starts = labels.select("label", F.explode(F.sequence(F.lit(1), F.length("label"))).alias("start"))
    fitting = F.filter(F.array(*map(F.lit, sizes)).cast("array<int>"), lambda k: k <= F.length("label") - F.col("start") + 1)
    pieces = starts.select("label", "start", F.explode(fitting).alias("size")).withColumn("word", F.expr("substring(label, start, size)")).join(counts, "word")
    known = pieces.groupBy("label").agg(F.collect_list(F.struct("start", "size", "n")).alias("known"))

    @F.pandas_udf("array<string>")
    def split(label: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([viterbi(x, [(w["start"] - 1, w["size"], w["n"]) for w in ([] if k is None else k)], total) for x, k in zip(label, found, strict=True)])

    return labels.join(known, "label", "left").select("label", split("label", "known").alias("words"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, odds, host_words and junk for each row of ``pages`` (page_id,
    url, html).

    odds is the model's log odds that the page is junk; it decides where no rule fits (block above 0). Letters of
    any script make words. A null url or one without "://" has an empty host and path; with no word of either
    there is nothing to judge by, and the page is allowed. A null html teaches no words and isn't junk; null or
    repeated page_ids are ordinary rows, as equal rows are; extra columns are ignored; an empty table gives no
    rows. Where no page is junk, everything without a rule is allowed.
    """
    host, path = parts(F.col("url"))
    name, verdict = rule(F.col("host"), F.col("path"), rules)
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), junk(F.col("html")).alias("junk"))
    hosts = rows.select("host").distinct()
    labels = hosts.select("host", F.posexplode(F.split(F.lower("host"), "[^\\p{L}\\p{N}]+")).alias("place", "label"))
    counts = scratch.stored(word_counts(pages), "words")  # the html is read once for them
    words = segment(labels, counts)
    split = labels.join(words, "label").groupBy("host").agg(F.array_sort(F.collect_list(F.struct("place", "words"))).alias("all"))
    split = split.select("host", F.flatten(F.transform("all", lambda x: x["words"])).alias("host_words"))
    rows = rows.join(scratch.stored(split, "hosts"), "host", "left").withColumn("host_words", F.coalesce("host_words", F.array().cast("array<string>")))
    # digits count as one token whatever their value
    steps = F.filter(F.split(F.regexp_replace(F.lower("path"), "[0-9]+", "0"), "[^\\p{L}\\p{N}]+"), lambda t: t != "")
    features = F.concat(F.transform("host_words", lambda t: F.concat(F.lit("host "), t)), F.transform(steps, lambda t: F.concat(F.lit("path "), t)))
    rows = rows.withColumn("rule", name).withColumn("known", verdict)
    rows = rows.withColumn("fold", F.pmod(F.xxhash64(F.lit(3), "host"), F.lit(FOLDS)).cast("int"))
    rows = scratch.stored(rows.withColumn("buckets", F.transform(features, lambda t: F.pmod(F.xxhash64(t), F.lit(BUCKETS)))), "urls")
    weights, priors = naive_bayes(rows)

    @F.pandas_udf("double")
    def odds(fold: pd.Series, buckets: pd.Series) -> pd.Series:
        own = weights.value
        return pd.Series([priors[k] + float(own[k, np.asarray(b, np.int64)].sum()) for k, b in zip(fold, buckets, strict=True)])

    rows = rows.withColumn("odds", odds("fold", "buckets"))
    verdict = F.coalesce("known", F.when((F.col("odds") > 0) & (F.size("buckets") > 0), "block").otherwise("allow"))
    return rows.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "odds", "host_words", "junk")


def naive_bayes(rows: DataFrame) -> tuple[Broadcast, list[float]]:
    """For each fold, the log odds of each hash bucket (0 where no page has it) and the prior log odds, out
    of the rows (fold, junk, buckets) of the other folds; a broadcast array of fixed size.

    Counts are summed over all rows on the executors; a few rows a bucket reach the driver at most.
    """
    counts, sizes = np.zeros((FOLDS, 2, BUCKETS)), np.zeros((FOLDS, 2))
    kind = F.col("junk").cast("int").alias("k")
    for r in rows.select("fold", kind, F.explode("buckets").alias("b")).groupBy("fold", "k", "b").agg(F.count(F.lit(1)).alias("n")).collect():
        counts[r["fold"], r["k"], r["b"]] = r["n"]
    for r in rows.groupBy("fold", kind).agg(F.count(F.lit(1)).alias("n")).collect():
        sizes[r["fold"], r["k"]] = r["n"]
    counts, sizes = counts.sum(0) - counts, sizes.sum(0) - sizes
    seen = counts.sum(1) > 0
    logs = np.log((counts + SMOOTH) / (counts.sum(2, keepdims=True) + SMOOTH * np.maximum(seen.sum(1), 1)[:, None, None]))
    priors = np.log((sizes[:, 1] + SMOOTH) / (sizes[:, 0] + SMOOTH))
    return rows.sparkSession.sparkContext.broadcast(np.where(seen, logs[:, 1] - logs[:, 0], 0.0)), priors.tolist()
