"""Change impact, change detection and review context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.paths import path_from_id
from factloom.functions.text import json_flag
from factloom.operators.traverse import IMPORTS, reach, reach_limited
from factloom.plans.durable import written


def is_test() -> Column:
    return (F.col("kind") == "Test") | json_flag(F.col("attributes"), "isTest")


def impact(nodes: DataFrame, edges: DataFrame, paths: DataFrame, max_depth: int = 3) -> DataFrame:
    """(id, role) for changed paths (path): the files and those that import them, what these contain, and their tests.

    Roles: file, symbol, test. A path without a file node adds nothing. A changed or test file is an impacted file, too.
    """
    starts = nodes.where("kind = 'File'").join(paths.select("path"), "path", "left_semi").select("id")
    files = reach(nodes, edges, starts, IMPORTS, False, max_depth).select("id")
    files = nodes.where("kind = 'File'").join(files, "id", "left_semi").select("id")
    inside = reach(nodes, edges, files, ("CONTAINS",), True, None).select("id")
    facts = nodes.select("id", "kind", "path", is_test().alias("test"))
    known = written(facts.join(inside, "id", "left_semi"), "impact")
    symbols = known.where((F.col("kind") != "File") & ~F.coalesce("test", F.lit(False))).select("id")
    tests = edges.where("kind = 'TESTED_BY'").join(symbols.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
    tests = written(facts.join(tests, "id", "left_semi"), "impact")
    paths_of_tests = tests.select(F.coalesce("path", path_from_id(F.col("id"))).alias("path")).distinct()
    test_files = facts.where("kind = 'File'").join(paths_of_tests, "path", "left_semi").select("id", "kind", "path", "test")
    role = F.when(F.col("kind") == "File", "file").when(F.col("test"), "test").otherwise("symbol")
    every = known.unionByName(tests).unionByName(test_files)
    return every.select("id", role.alias("role"), F.coalesce("path", path_from_id(F.col("id"))).alias("path")).distinct()


def _descendants(nodes: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, id): what CONTAINS edges reach from each root (id)."""
    steps = edges.where("kind = 'CONTAINS'").select(F.col("src").alias("a"), F.col("dst").alias("b")).join(nodes.select(F.col("id").alias("b")), "b", "left_semi").distinct()
    front = roots.select(F.col("id").alias("root"), "id")
    seen = None
    while True:
        new = front.join(steps, F.col("id") == F.col("a")).select("root", F.col("b").alias("id")).distinct()
        front = written(new if seen is None else new.join(seen, ["root", "id"], "left_anti"), "inside")
        if front.isEmpty():
            return front if seen is None else seen
        seen = front if seen is None else seen.unionByName(front)


def impact_limited(nodes: DataFrame, edges: DataFrame, paths: DataFrame, max_depth: int, limit: int) -> tuple[DataFrame, bool]:
    """(id, role, path) of at most `limit` nodes, in the order in which impact admits them; whether any was turned away.

    paths: (path, pos). First come the files, as a queue admits them; then, by file, what each contains, by id; then, by
    symbol, its tests, each followed by the test's file. At most `limit` rows stay of each phase.
    """
    starts = nodes.where("kind = 'File'").join(paths.select("path", "pos"), "path").select("id", "pos")
    files, truncated = reach_limited(nodes, edges, starts, IMPORTS, False, max_depth, limit)
    taken = written(files.select("id"), "impact")

    def admit(candidates: DataFrame) -> None:
        nonlocal taken, truncated
        room = limit - taken.count()
        new = candidates.groupBy("id").agg(F.min("key").alias("key")).join(taken, "id", "left_anti")
        first = written(new.orderBy("key").limit(room + 1).select("id", "key"), "impact")
        truncated = truncated or first.count() > room
        taken = written(taken.unionByName(first.orderBy("key").limit(room).select("id")), "impact")

    roots = nodes.where("kind = 'File'").join(taken, "id", "left_semi").select("id")
    admit(_descendants(nodes, edges, roots).select("id", F.struct("root", "id").alias("key")))
    symbols = nodes.where((F.col("kind") != "File") & ~is_test()).join(taken, "id", "left_semi").select(F.col("id").alias("src"))
    tested = edges.where("kind = 'TESTED_BY'").join(symbols, "src", "left_semi").select("src", "dst", F.struct("src", F.struct("kind", "src", "dst", "id")).alias("by"))
    tested = tested.join(nodes.select(F.col("id").alias("dst"), F.coalesce("path", path_from_id(F.col("id"))).alias("path")), "dst")
    own = tested.select(F.col("dst").alias("id"), F.struct("by", F.lit(0).alias("nth")).alias("key"))
    homes = tested.join(nodes.where("kind = 'File'").select("id", "path"), "path").select("id", F.struct("by", F.lit(1).alias("nth")).alias("key"))
    admit(own.unionByName(homes))
    role = F.when(F.col("kind") == "File", "file").when(is_test(), "test").otherwise("symbol")
    return nodes.join(taken, "id", "left_semi").select("id", role.alias("role"), F.coalesce("path", path_from_id(F.col("id"))).alias("path")), truncated


def impacted_files(found: DataFrame) -> DataFrame:
    return found.where("role = 'file'").select("path").distinct()


def impacted_symbols(found: DataFrame) -> DataFrame:
    return found.where("role = 'symbol'").select("id")


def impacted_tests(found: DataFrame) -> DataFrame:
    return found.where("role = 'test'").select("path").distinct()


def detect_changes(stored: DataFrame, current: DataFrame) -> DataFrame:
    """(path, status, old_path) of two tables (path, sha256): changed (new or other hash), deleted, renamed.

    A deleted path whose hash a changed path has is renamed to the last such path, which stays changed as well.
    """
    s = stored.select("path", F.col("sha256").alias("old"))
    both = s.join(current.select("path", F.col("sha256").alias("new")), "path", "full")
    none = F.lit(None).cast("string").alias("old_path")
    changed = both.where("new IS NOT NULL AND (old IS NULL OR old <> new)")
    deleted = both.where("new IS NULL")
    last = changed.groupBy(F.col("new").alias("sha")).agg(F.max("path").alias("to"))
    moved = deleted.join(last, F.col("old") == F.col("sha"), "left")
    gone = moved.where("to IS NULL").select("path", F.lit("deleted").alias("status"), none)
    renamed = moved.where("to IS NOT NULL").select(F.col("to").alias("path"), F.lit("renamed").alias("status"), F.col("path").alias("old_path"))
    return changed.select("path", F.lit("changed").alias("status"), none).unionByName(gone).unionByName(renamed)


def detect_listed(listed: DataFrame, current: DataFrame) -> DataFrame:
    """Listed paths (path): changed if they exist now, else deleted; hashes don't matter."""
    here = current.select("path", F.lit(True).alias("here"))
    return listed.select("path").distinct().join(here, "path", "left").select("path", F.when(F.col("here"), "changed").otherwise("deleted").alias("status"))


def review_context(nodes: DataFrame, edges: DataFrame, changes: DataFrame, max_depth: int = 3) -> DataFrame:
    """Impact of changed and deleted paths and of the old names of renamed ones."""
    paths = changes.select(F.when(F.col("status") == "renamed", F.col("old_path")).otherwise(F.col("path")).alias("path")).distinct()
    return impact(nodes, edges, paths, max_depth)


def freshness(stored: DataFrame, current: DataFrame, age_ms: int, max_age_ms: int, *, has_metadata: bool = True, root_exists: bool = True, discovery_error: str | None = None) -> DataFrame:
    """One row (state, reason, path): the first that holds of no metadata, no root, discovery error, hash difference, age."""
    spark = stored.sparkSession
    if not has_metadata:
        return spark.sql("SELECT 'unavailable' AS state, 'no metadata' AS reason, CAST(NULL AS STRING) AS path")
    if not root_exists:
        return spark.sql("SELECT 'error' AS state, 'root missing' AS reason, CAST(NULL AS STRING) AS path")
    if discovery_error:
        return spark.range(1).select(F.lit("error").alias("state"), F.lit(discovery_error).alias("reason"), F.lit(None).cast("string").alias("path"))
    both = stored.select("path", F.col("sha256").alias("old")).join(current.select("path", F.col("sha256").alias("new")), "path", "full")
    first = both.agg(F.min(F.when(F.col("new").isNull(), F.col("path"))).alias("removed"), F.min(F.when(F.col("new").isNotNull() & (F.col("old").isNull() | (F.col("old") != F.col("new"))), F.col("path"))).alias("changed"))
    old = age_ms > max_age_ms
    state = F.when(F.col("removed").isNotNull() | F.col("changed").isNotNull() | F.lit(old), "stale").otherwise("fresh")
    reason = F.when(F.col("removed").isNotNull(), "removed").when(F.col("changed").isNotNull(), "changed").when(F.lit(old), "age").otherwise("current")
    return first.select(state.alias("state"), reason.alias("reason"), F.coalesce("removed", "changed").alias("path"))
