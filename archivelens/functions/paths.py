"""Path columns: parts, names and ancestors. Back-slashes count as slashes everywhere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def norm(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def name(path: Column) -> Column:
    """The last part."""
    return F.element_at(F.split(norm(path), "/"), -1)


def suffix(path: Column) -> Column:
    """Lower-cased extension with its dot; "" without one. A leading dot starts a name, not one."""
    return F.lower(F.regexp_extract(name(path), r"^.+?(\.[^.]+)$", 1))


def stem(path: Column) -> Column:
    own = name(path)
    return F.substring(own, F.lit(1), F.length(own) - F.length(suffix(path)))


def parent(path: Column) -> Column:
    """All but the last part; "" at the top."""
    return F.regexp_extract(norm(path), r"^(.*)/[^/]*$", 1)


def top(path: Column) -> Column:
    """The first part of a path that has more than one, else ""."""
    return F.when(F.instr(norm(path), "/") > 0, F.substring_index(norm(path), "/", 1)).otherwise("")


def depth(path: Column) -> Column:
    return F.size(F.split(norm(path), "/"))


def ancestors(path: Column) -> Column:
    """All folders above a path, outermost first: "a/b/c" gives ["a", "a/b"]."""
    parts = F.split(norm(path), "/")
    count = F.size(parts) - 1
    built = F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    return F.when(count >= 1, built).otherwise(F.array().cast("array<string>"))


def scopes(path: Column) -> Column:
    """The path itself and all folders above it: what a scope must equal to cover the path."""
    return F.array_append(ancestors(path), norm(path))
