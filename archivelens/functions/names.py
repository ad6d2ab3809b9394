"""Marks of versions, dates and states in file names, and what is left of a name without them.

Names are stems (no folders, no extension). Each mark is a pattern and what takes its place; ``SQL`` forms use
no look-around, so that engines without it can run them as well.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of state and of series.
FINAL = ("final", "최종", "확정")
DERIVED = ("copy", "복사본", "old", "backup", "draft", "sample")
SERIES = ("팀원", "팀장", "부서장", "담당자", "관리자", "실무자", "임원", "리더", "member", "leader", "manager", "admin")

#: Fixed patterns: yyyymmdd with or without separators; "v2", "ver 2", "version3.1" (the number is a group); a word of state.
DATE = r"(?<![0-9])(?:19|20)[0-9]{2}[-_.]?[0-9]{2}[-_.]?[0-9]{2}(?![0-9])"
_NUMBER = r"v(?:er(?:sion)?)?\.?\s*([0-9]+(?:\.[0-9]+)*)(?![\p{L}\p{N}_])"
VERSION = r"(?i)(?:^|[_\-\s])" + _NUMBER
STATE = r"(?i)(?<![^_\-\s])(?:" + "|".join((*FINAL, *DERIVED)) + r")(?:[_\-\s]|$)"
LAST = r"(?i)[_\-\s]+(?:" + "|".join(SERIES) + r")$"
#: Fixed pattern: marks by which copies in one folder are told (C2), wherever they stand; the numbers of a series aren't among them.
COPY = r"(?i)_v[0-9]+|_ver\.?[0-9]+|_최종[0-9]*|_final[0-9]*|_수정[0-9]*|_revised[0-9]*|_draft[0-9]*|\([0-9]+\)|_copy[0-9]*|_[0-9]{8}|_[0-9]{6}"


def family(stem: Column) -> Column:
    """The name that all versions and copies of a document share: without dates, versions, words of
    state and a series' last word, blanks and separators collapsed. A name made of marks only stays whole."""
    out = F.trim(stem)
    for pattern, instead in ((DATE, ""), (VERSION, " "), (STATE, " "), (LAST, ""), (r"[_\-\s]+", " ")):
        out = F.regexp_replace(out, pattern, instead)
    return F.coalesce(F.nullif(F.trim(out), F.lit("")), F.trim(stem))


def version(stem: Column) -> Column:
    """The largest version of a name, its numbers as (digits, number) so that any length is in order; null
    without one. "v" must not follow a letter or digit: "serv3r" has no version."""
    found = F.regexp_extract_all(F.lower(stem), F.lit(r"(?<![a-z0-9])" + _NUMBER), F.lit(1))

    def part(number: Column) -> Column:
        bare = F.regexp_replace(number, r"^0+(?=[0-9])", "")
        return F.struct(F.length(bare).alias("digits"), bare.alias("number"))

    return F.array_max(F.transform(found, lambda v: F.transform(F.split(v, r"\."), part)))


def version_points(stem: Column, base: int, most: int = 10) -> Column:
    """``base`` and the major version, 1 more for a minor one, ``most`` at most; 0 without a version."""
    own = version(stem)
    first = F.get(own, 0)
    major = F.when(first["digits"] > 2, most).otherwise(first["number"].try_cast("int"))
    return F.when(own.isNotNull(), F.least(F.lit(most), major + base + F.when(F.size(own) > 1, 1).otherwise(0))).otherwise(0)


def holds(stem: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for word in words:
        out = out | F.contains(F.lower(stem), F.lit(word))
    return out


def bare(name: Column) -> Column:
    """Lower-cased without blanks and separators, to compare names by."""
    return F.lower(F.regexp_replace(name, r"[\s_\-]+", ""))


def copied(stem: Column) -> Column:
    """The lower-cased name without the marks of copies in one folder; one made of them stays whole."""
    cut = F.trim(F.regexp_replace(F.regexp_replace(stem, COPY, ""), r"[\s_\-]+$", ""))
    return F.lower(F.coalesce(F.nullif(cut, F.lit("")), stem))
