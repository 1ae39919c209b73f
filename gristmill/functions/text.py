"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that decide the class of a question, in order of precedence, and token budgets by class (fixed values).
CLASSES = {
    "codebase": ["entire", "whole", "all", "codebase", "repository"],
    "directory": ["directory", "folder"],
    "file": ["file"],
    "function": ["function", "method", "class"],
}
BUDGETS = {"codebase": 8000, "directory": 6000, "file": 4000, "function": 2000, "general": 6000}


def newline_normalized(c: Column) -> Column:
    return F.regexp_replace(c, r"\r\n?", "\n")


def token_count(c: Column) -> Column:
    """Runs of anything but white space."""
    return F.size(F.filter(F.split(c, r"(?U)\s+"), lambda x: x != ""))


def query_class(c: Column) -> Column:
    low = F.lower(c)
    out = None
    for name, words in CLASSES.items():
        hit = None
        for w in words:
            hit = low.contains(w) if hit is None else hit | low.contains(w)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("general")


def budget_of(cls: Column) -> Column:
    out = F.when(cls == "codebase", BUDGETS["codebase"])
    for k, v in BUDGETS.items():
        out = out.when(cls == k, v)
    return out


def valid_json(c: Column) -> Column:
    return F.try_parse_json(c).isNotNull()


def decoded(b64: Column) -> Column:
    """UTF-8 text of a base64 payload, '' if there is none, null if the bytes are no UTF-8."""
    raw = F.unbase64(F.coalesce(b64, F.lit("")))
    return F.when(F.is_valid_utf8(raw.cast("string")) & (F.encode(raw.cast("string"), "utf-8") == raw), raw.cast("string"))


def endpoint(sub_directory: Column, rest: Column) -> Column:
    """The folder that is listed: the one asked for, else that of the address, else the root."""
    given = lambda c: F.when(F.trim(c, F.lit("/")) != "", F.trim(c, F.lit("/")))
    return F.coalesce(given(sub_directory), given(rest), F.lit(""))


def repo_url(url: Column, strict: bool = False) -> tuple[Column, Column]:
    """(base, rest of the path or null); both null if it is no repository address, which is an error if ``strict``."""
    u = F.regexp_replace(url, r"/+$", "")
    pat = r"^https://github\.com/([^/]+)/([^/]+)(/.*)?$"
    ok = u.rlike(pat)
    if strict:
        ok = F.when(ok, True).otherwise(F.raise_error(F.concat(F.lit("no repository address: "), F.coalesce(url, F.lit("null")))).cast("boolean"))
    base = F.when(ok, F.concat(F.lit("https://github.com/"), F.regexp_extract(u, pat, 1), F.lit("/"), F.regexp_extract(u, pat, 2)))
    rest = F.regexp_extract(u, pat, 3)
    return base, F.when(ok & (rest != ""), rest)
