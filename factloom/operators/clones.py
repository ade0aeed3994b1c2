"""Clone detection: sliding windows of normalised lines, grouped by digest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.text import lines, token_count


def excluded(path: Column, patterns: list[str]) -> Column:
    """Any of `x/**`, `x/` (all below x) or an exact path or prefix folder."""
    out = F.lit(False)
    for p in patterns:
        root = p.removesuffix("**").rstrip("/")
        out = out | (path == root) | path.startswith(root + "/")
    return out


def with_overlays(files: DataFrame, overlays: DataFrame | None) -> DataFrame:
    """(path, content, introduced): writes replace or add a file, deletes remove it."""
    base = files.select("path", "content", F.lit(False).alias("introduced"))
    if overlays is None:
        return base
    kept = base.join(overlays.select("path").distinct(), "path", "left_anti")
    return kept.unionByName(overlays.where("action = 'write'").select("path", "content", F.lit(True).alias("introduced")))


def normal_lines(files: DataFrame) -> DataFrame:
    """(path, introduced, no, line): trimmed lines in order, without blanks and comments; inline `//` cut, white space collapsed."""
    line = F.regexp_replace(F.trim(F.regexp_replace(F.trim("raw"), r"//.*$", "")), r"\s+", " ")
    rows = files.select("path", "introduced", F.posexplode(lines(F.col("content"))).alias("at", "raw"))
    rows = rows.where(~F.trim("raw").rlike(r"^(//|#)") & (F.trim("raw") != "")).withColumn("line", line).where("line <> ''")
    return rows.select("path", "introduced", F.row_number().over(Window.partitionBy("path").orderBy("at")).alias("no"), "line")


def windows(files: DataFrame, *, min_lines: int = 5, min_tokens: int = 20) -> DataFrame:
    """(path, introduced, no, hash): every window of `min_lines` normalised lines with enough tokens."""
    ahead = Window.partitionBy("path").orderBy("no").rowsBetween(0, min_lines - 1)
    block = normal_lines(files).withColumn("block", F.collect_list("line").over(ahead)).where(F.size("block") == min_lines)
    text = F.array_join("block", "\n")
    return block.where(token_count(text) >= min_tokens).select("path", "introduced", "no", F.sha2(text, 256).alias("hash"))


def occurrences(files: DataFrame, **params) -> DataFrame:
    """(hash, path, introduced): one for each class and file, of classes in two files or more."""
    found = windows(files, **params).groupBy("hash", "path").agg(F.bool_or("introduced").alias("introduced"))
    shared = found.groupBy("hash").agg(F.count("*").alias("files")).where("files > 1").select("hash")
    return found.join(shared, "hash", "left_semi")


def clone_classes(found: DataFrame) -> DataFrame:
    """(class_id, files): classes with the number of files."""
    return found.groupBy("hash").agg(F.count("*").alias("files")).select(F.concat(F.lit("clone-"), F.substring("hash", 1, 16)).alias("class_id"), "files")


def findings(found: DataFrame, *, scope: DataFrame | None = None, introduced_only: bool = False, partitions: list[list[str]] | None = None) -> DataFrame:
    """(path, peer_path, class_id): for each occurrence in scope its first other path, of the same partition if there are any.

    The first and second smallest paths of a class answer for all its members, so no pairs are made.
    """
    part = F.lit(0)
    if partitions:
        part = F.coalesce(*(F.when(excluded(F.col("path"), patterns), i) for i, patterns in enumerate(partitions)), F.lit(-1))
    rows = found.withColumn("part", part)
    if partitions:
        rows = rows.where("part >= 0")
    first = rows.groupBy("hash", "part").agg(F.min("path").alias("p1"), F.bool_or("introduced").alias("any_new"))
    second = rows.join(first, ["hash", "part"]).where("path <> p1").groupBy("hash", "part").agg(F.min("path").alias("p2"))
    out = rows.join(first, ["hash", "part"]).join(second, ["hash", "part"])
    if introduced_only:
        out = out.where("any_new AND introduced")
    if scope is not None:
        out = out.join(scope.select("path"), "path", "left_semi")
    peer = F.when(F.col("path") == F.col("p1"), F.col("p2")).otherwise(F.col("p1"))
    return out.select("path", peer.alias("peer_path"), F.concat(F.lit("clone-"), F.substring("hash", 1, 16)).alias("class_id"))


def clone_summary(files: DataFrame, found: DataFrame, reported: DataFrame) -> DataFrame:
    """One row: files, classes, findings."""
    a = files.agg(F.count("*").alias("files"))
    b = found.agg(F.countDistinct("hash").alias("classes"))
    c = reported.agg(F.count("*").alias("findings"))
    return a.join(F.broadcast(b)).join(F.broadcast(c))


def clone_diagnostics(reported: DataFrame) -> DataFrame:
    message = F.concat(F.lit("Duplicated block shared with "), "peer_path")
    return reported.select(F.lit("clone.duplication").alias("check_id"), F.lit("error").alias("severity"), "path", F.lit("CLONE_DUPLICATE").alias("code"), message.alias("message"))
