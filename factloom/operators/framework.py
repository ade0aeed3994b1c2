"""Validation framework: scopes, overlays, introduced diagnostics, status and order."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.paths import within

#: The diagnostic's sort key.
ORDER = ("path", "line", "col", "end_line", "end_col", "category", "severity", "code", "message")
PRIORITY = ("infrastructure_failure", "provider_failure", "unsupported", "policy_failure")


def file_view(files: DataFrame, overlays: DataFrame) -> DataFrame:
    """(path, content): files under hypothetical writes and deletes; the last overlay (seq) of a path counts."""
    last = overlays.withColumn("__n", F.row_number().over(Window.partitionBy("path").orderBy(F.desc("seq")))).where("__n = 1")
    kept = files.select("path", "content").join(last.select("path"), "path", "left_anti")
    return kept.unionByName(last.where("action = 'write'").select("path", "content"))


def failed_preconditions(files: DataFrame, overlays: DataFrame) -> DataFrame:
    """(path): overlays whose checksum_before isn't that of the file they shadow."""
    want = overlays.where("checksum_before IS NOT NULL").select("path", "checksum_before")
    have = files.select("path", F.sha2("content", 256).alias("now"))
    return want.join(have, "path", "left").where("now IS NULL OR now <> checksum_before").select("path").distinct()


def scope_files(files: DataFrame, overlays: DataFrame | None = None) -> DataFrame:
    """(path): the scope's files and those of overlays, once each."""
    out = files.select("path")
    return (out if overlays is None else out.unionByName(overlays.select("path"))).distinct()


def package_files(files: DataFrame, root: str) -> DataFrame:
    return files.where(within(F.col("path"), F.lit(root)))


def fingerprint(blank_message_codes: tuple[str, ...] = ("TS_FILE_LINES",)) -> Column:
    message = F.when(F.col("code").isin(*blank_message_codes), "").otherwise(F.col("message"))
    return F.to_json(F.struct("check_id", "category", "severity", "path", "code", "line", "col", "end_line", "end_col", message.alias("message")), {"ignoreNullFields": "false"})


def introduced(after: DataFrame, before: DataFrame) -> DataFrame:
    """Diagnostics of `after` whose fingerprint `before` doesn't have; repeats stay."""
    b = before.select(fingerprint().alias("__f")).distinct()
    return after.withColumn("__f", fingerprint()).join(b, "__f", "left_anti").drop("__f")


def run_status(runs: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """(check_id, status, errors, warnings): a run fails on an error, never on a warning; skipped runs stay skipped."""
    n = diagnostics.groupBy("check_id").agg(F.count(F.when(F.col("severity") == "error", 1)).alias("e"), F.count(F.when(F.col("severity") == "warning", 1)).alias("w"))
    both = runs.select("check_id", "outcome").join(n, "check_id", "left")
    errors, warnings = F.coalesce("e", F.lit(0)), F.coalesce("w", F.lit(0))
    status = F.when(F.col("outcome") != "ran", F.col("outcome")).when(errors > 0, "policy_failure").otherwise("passed")
    return both.select("check_id", status.alias("status"), errors.alias("errors"), warnings.alias("warnings"))


def rollup(runs: DataFrame) -> DataFrame:
    """One row (status): the worst by priority; then skipped if all runs are skipped, also if there are none; else passed."""
    flags = [F.coalesce(F.bool_or(F.col("status") == p), F.lit(False)).alias(p) for p in PRIORITY]
    skipped = F.coalesce(F.bool_and(F.col("status") == "skipped"), F.lit(True)).alias("skipped")
    status = F.coalesce(*(F.when(F.col(p), F.lit(p)) for p in (*PRIORITY, "skipped")), F.lit("passed"))
    return runs.agg(*flags, skipped).select(status.alias("status"))


def last_by_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).where("__n = 1").drop("__n")


def in_order(diagnostics: DataFrame) -> DataFrame:
    return diagnostics.orderBy(*(F.asc_nulls_first(c) for c in ORDER if c in diagnostics.columns))


@dataclass
class Check:
    """A check of a pack: its id, the scopes it supports, whether it needs the graph, and what makes its diagnostics."""

    id: str
    run: Callable[["Context"], DataFrame]
    scopes: tuple[str, ...] = ("all",)
    severity: str = "error"
    needs_graph: bool = False


@dataclass
class Context:
    """What checks read, and a repository's policy: thresholds, layer rules, partitions."""

    files: DataFrame
    nodes: DataFrame | None = None
    edges: DataFrame | None = None
    scope: str = "all"
    policy: dict = field(default_factory=dict)


def select_checks(checks: Iterable[Check], requested: Iterable[str] | None, scope: str) -> list[Check]:
    """Requested checks in their order, once each; an unknown id is an error. None: those that support the scope."""
    known = {c.id: c for c in checks}
    if requested is None:
        return [c for c in known.values() if scope in c.scopes]
    wanted = list(dict.fromkeys(requested))
    if unknown := [x for x in wanted if x not in known]:
        raise ValueError(f"unknown checks {unknown}")
    return [known[x] for x in wanted]


def run_checks(checks: Iterable[Check], context: Context, requested: Iterable[str] | None = None, fail_fast: bool = False) -> Iterator[tuple[str, str, DataFrame | None]]:
    """(check id, outcome, diagnostics) one by one: skipped without a graph it needs, stopped after an infrastructure failure."""
    for c in select_checks(checks, requested, context.scope):
        if c.needs_graph and (context.nodes is None or context.edges is None):
            yield c.id, "skipped", None
            continue
        try:
            found = c.run(context)
        except Exception as e:  # what a check raises is its outcome
            yield c.id, f"infrastructure_failure: {type(e).__name__}", None
            return
        yield c.id, "ran", found
        if fail_fast and not found.where("severity = 'error'").isEmpty():
            return
