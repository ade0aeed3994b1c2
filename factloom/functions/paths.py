"""Paths and ids."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def path_from_id(node_id: Column) -> Column:
    """Text between the first `:` and the first `#` after it; null without a `:`."""
    rest = F.regexp_extract(node_id, r"(?s)^[^:]*:(.*)$", 1)
    return F.when(F.instr(node_id, ":") > 0, F.substring_index(rest, "#", 1))


def endpoint_path(node_id: Column) -> Column:
    """The other rule: a `file:` id keeps a `#` in its path; null if nothing matches."""
    of_file = F.regexp_extract(node_id, r"(?s)^file:(.+)$", 1)
    other = F.regexp_extract(node_id, r"(?s)^[^:]+:([^#]+)(?:#.*)?$", 1)
    return F.coalesce(F.nullif(of_file, F.lit("")), F.nullif(other, F.lit("")))


def edge_id(kind: Column, src: Column, dst: Column) -> Column:
    return F.concat(F.lit("edge:"), kind, F.lit(":"), src, F.lit("->"), dst)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """Lower-level rule: text after the last dot of the basename, null without one or if the name only starts with it."""
    return F.nullif(F.regexp_extract(basename(path), r"^.+\.([^.]+)$", 1), F.lit(""))


def first_segment(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), 1)


def normalize_path(path: Column) -> Column:
    """Trimmed, `\\` as `/`, without empty and `.` parts; null if absolute, with `..` or NUL, or empty."""
    p = F.replace(F.trim(path), F.lit("\\"), F.lit("/"))
    parts = F.filter(F.split(p, "/"), lambda x: ~x.isin("", "."))
    bad = p.startswith("/") | p.rlike(r"^[A-Za-z]:/") | (F.instr(p, "\x00") > 0) | F.array_contains(parts, "..") | (F.size(parts) == 0)
    return F.when(~bad, F.array_join(parts, "/"))


def join_relative(base_dir: Column, target: Column) -> Column:
    """`target` from `base_dir`, with `.` and `..` folded; null if it climbs out."""
    parts = F.filter(F.concat(F.split(base_dir, "/"), F.split(target, "/")), lambda x: ~x.isin("", "."))
    step = lambda acc, x: F.when(acc.isNull(), acc).when(x != "..", F.concat(acc, F.array(x))).when(F.size(acc) > 0, F.slice(acc, F.lit(1), F.size(acc) - 1))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def glob_regex(glob: str) -> str:
    """A repository glob as an anchored pattern: `**/` any folders, `**` anything, `*` and `?` within a part."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return f"^{out}$"


def percent_match(path: Column, pattern: Column) -> Column:
    """`%` stands for anything; the path matches with or without a leading slash."""
    like = F.replace(F.replace(pattern, F.lit("\\"), F.lit("\\\\")), F.lit("_"), F.lit("\\_"))
    return F.like(path, like) | F.like(F.concat(F.lit("/"), path), like)


def within(path: Column, root: Column) -> Column:
    """The path is the root or lies below it."""
    return (path == root) | path.startswith(F.concat(root, F.lit("/")))
