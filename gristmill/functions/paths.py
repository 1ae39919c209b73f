"""Path arithmetic as column expressions (no UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def basename(p: Column) -> Column:
    return F.element_at(F.split(p, "/"), -1)


def dirname(p: Column) -> Column:
    """The folder of a relative path, '' at the root."""
    return F.regexp_replace(p, r"/?[^/]*$", "")


def extension(p: Column) -> Column:
    """Lower-case extension with its dot; names that only begin with dots have none."""
    return F.lower(F.regexp_extract(p, r"(?:^|/)\.*[^/.][^/]*?(\.[^./]*)$", 1))


def depth(p: Column) -> Column:
    return F.length(p) - F.length(F.replace(p, F.lit("/"), F.lit("")))


def occurrences(s: Column, char: str) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(char), F.lit("")))


def ancestors(p: Column) -> Column:
    """Every proper folder prefix of a path, top down; none for a file at the root."""
    parts = F.split(p, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).otherwise(F.array().cast("array<string>"))


def is_safe(p: Column) -> Column:
    """Relative and without a step upwards."""
    return p.isNotNull() & ~p.startswith("/") & ~p.rlike(r"(?:^|/)\.\.(?:/|$)")
