"""Metrics: signals from diagnostics and structure, deltas, latency against budgets, telemetry and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.paths import extension, path_from_id
from factloom.operators.select import broadcast_few

#: Signals by id: what of a diagnostic must hold. Codes end in % for a prefix; ext is a path's extensions. Fixed values.
TS = ("ts", "tsx", "js", "jsx", "mts", "cts")
PY = ("py", "pyi")
SIGNALS = (
    ("typescript.syntax_errors", "error", {"category": "syntax", "ext": TS}),
    ("typescript.type_errors", "error", {"category": "types", "ext": TS}),
    ("typescript.untested_surface", "warning", {"code": "TS_RELEVANT_TESTS_ABSENT"}),
    ("typescript.dead_exports", "warning", {"code": "TS_DEAD_CODE_UNUSED_EXPORT"}),
    ("rust.source_hygiene", "error", {"code": "RUST_SOURCE_%"}),
    ("rust.oversized_files", "warning", {"code": "RUST_FILE_LINES"}),
    ("rust.untested_surface", "warning", {"code": "RUST_GRAPH_UNTESTED_SURFACE"}),
    ("rust.dead_pub_exports", "warning", {"code": "RUST_GRAPH_DEAD_PUB_EXPORT"}),
    ("rust.module_resolution", "error", {"code": "RUST_IMPORT_%"}),
    ("rust.module_orphans", "warning", {"code": "RUST_GRAPH_MODULE_ORPHAN"}),
    ("rust.module_cycles", "error", {"code": "RUST_GRAPH_CYCLE"}),
    ("rust.dead_orphan_sources", "warning", {"code": "RUST_DEAD_ORPHAN_SOURCE"}),
    ("rust.toolchain_drift", "error", {"code": "RUST_TOOLCHAIN_%"}),
    ("python.syntax_errors", "error", {"category": "syntax", "ext": PY}),
    ("python.type_errors", "error", {"category": "types", "ext": PY}),
    ("python.untested_modules", "warning", {"code": "PY_RELEVANT_TESTS_ABSENT"}),
    ("python.dead_exports", "warning", {"code": "PY_DEAD_CODE_UNUSED_EXPORT"}),
    ("python.source_hygiene", "error", {"code": "PY_SOURCE_%"}),
    ("python.import_graph", "warning", {"code": "PY_IMPORT_GRAPH_MISSING_EDGE"}),
)
GOD_FILE, FAN_IN, SUBTREE, LATENCY_TOP = 50, 10, 10_000, 20
RING_RECORDS, RING_BYTES = 500, 1 << 20


def signals(diagnostics: DataFrame, rules=SIGNALS) -> DataFrame:
    """(signal_id, severity, count, first_path): diagnostics with a path, by the signals that they match."""
    hits = []
    for name, severity, want in rules:
        on = F.col("path").isNotNull()
        if "category" in want:
            on = on & (F.col("category") == want["category"])
        if "ext" in want:
            on = on & extension(F.col("path")).isin(*want["ext"])
        if "code" in want:
            on = on & (F.col("code").startswith(want["code"][:-1]) if want["code"].endswith("%") else F.col("code") == want["code"])
        hits.append(F.when(on, F.struct(F.lit(name).alias("signal_id"), F.lit(severity).alias("severity"))))
    rows = diagnostics.select("path", F.explode(F.filter(F.array(*hits), lambda x: x.isNotNull())).alias("s"))
    return rows.groupBy("s.signal_id", F.col("s.severity").alias("severity")).agg(F.count("*").alias("count"), F.min("path").alias("first_path"))


def god_files(nodes: DataFrame, edges: DataFrame, most: int = GOD_FILE) -> DataFrame:
    """(path, contained): files with many CONTAINS edges, by the source's path."""
    e = edges.where("kind = 'CONTAINS'").join(nodes.select(F.col("id").alias("src"), "path"), "src", "left")
    path = F.coalesce("path", path_from_id(F.col("src")))
    return e.groupBy(path.alias("path")).agg(F.count("*").alias("contained")).where(F.col("contained") > most)


def fan_in(edges: DataFrame, most: int = FAN_IN) -> DataFrame:
    """(path, importers): targets with many distinct importers."""
    e = edges.where("kind = 'IMPORTS_FROM'").select(path_from_id(F.col("dst")).alias("path"), "src")
    return e.groupBy("path").agg(F.countDistinct("src").alias("importers")).where(F.col("importers") > most)


def untested_files(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(path): files none of whose symbols has a TESTED_BY edge; the fallback when no check ran."""
    t = edges.where("kind = 'TESTED_BY'").select(path_from_id(F.col("src")).alias("path")).distinct()
    return nodes.where("kind = 'File'").select("path").distinct().join(t, "path", "left_anti")


def degradations(evidence: DataFrame) -> DataFrame:
    """(id, message) once each, of missing evidence (id, message, present)."""
    return evidence.where("NOT present").select("id", "message").dropDuplicates(["id", "message"])


def signal_delta(history: DataFrame) -> DataFrame:
    """(signal_id, current, previous, baseline, previous_delta, baseline_delta) of the last report.

    history: (report_id, sequence, signal_id, amount). A report's place is its last sequence; equal ones go by id. The
    baseline is the first report, and undefined if there is only one.
    """
    place = history.groupBy("report_id").agg(F.max("sequence").alias("at"))
    ends = place.agg(F.max(F.struct("at", "report_id")).alias("last"), F.min(F.struct("at", "report_id")).alias("first"))
    before = place.join(F.broadcast(ends)).where(F.struct("at", "report_id") < F.col("last")).agg(F.max(F.struct("at", "report_id")).alias("prev"))
    marks = ends.join(F.broadcast(before))
    rows = history.join(F.broadcast(marks)).groupBy("signal_id").agg(
        F.sum(F.when(F.col("report_id") == F.col("last.report_id"), F.col("amount"))).alias("current"),
        F.sum(F.when(F.col("report_id") == F.col("prev.report_id"), F.col("amount"))).alias("previous"),
        F.sum(F.when((F.col("report_id") == F.col("first.report_id")) & (F.col("first") != F.col("last")), F.col("amount"))).alias("baseline"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    rows = rows.where("current IS NOT NULL OR previous IS NOT NULL OR baseline IS NOT NULL")
    return rows.withColumns({"previous_delta": zero("current") - zero("previous"), "baseline_delta": zero("current") - zero("baseline")})


def latency_observations(records: DataFrame, budgets: DataFrame) -> DataFrame:
    """(command, state, bucket, phase, recorded_at, record_id, duration_ms, budget_ms): records against the budgets they match.

    records: record_id, command, state, bucket, recorded_at, duration_ms, phases (phase, duration_ms). budgets: command,
    scope, bucket, budget_ms, phase_budgets (phase, budget_ms); a budget's command is a prefix of words. Budgets are
    policy, broadcast if few. A record without a budget is one total.
    """
    b = budgets.select(F.col("command").alias("b_command"), F.col("scope").alias("b_scope"), F.col("bucket").alias("b_bucket"), "budget_ms", "phase_budgets")
    prefix = (F.col("command") == F.col("b_command")) | F.col("command").startswith(F.concat("b_command", F.lit(" ")))
    both = records.join(broadcast_few(b, 200), (F.col("state") == F.col("b_scope")) & (F.col("bucket") == F.col("b_bucket")) & prefix, "left")
    name = F.coalesce("b_command", "command").alias("command")
    keep = [name, "state", "bucket"]
    total = both.select(*keep, F.lit("total").alias("phase"), "recorded_at", "record_id", "duration_ms", "budget_ms")
    each = both.where("b_command IS NOT NULL").withColumn("pb", F.explode("phase_budgets"))
    each = each.withColumn("p", F.element_at(F.filter("phases", lambda x: x["phase"] == F.col("pb.phase")), 1)) if "phases" in records.columns else each.limit(0).withColumn("p", F.col("pb"))
    duration = F.col("p.duration_ms") if "phases" in records.columns else F.col("duration_ms")
    phases = each.where("p IS NOT NULL").select(*keep, F.col("pb.phase").alias("phase"), "recorded_at", "record_id", duration.alias("duration_ms"), F.col("pb.budget_ms").alias("budget_ms"))
    return total.unionByName(phases)


def latency_groups(observations: DataFrame) -> DataFrame:
    """A row for each (command, state, bucket, phase): the last duration against budget, the one before and the first.

    Maxima of structs are pre-aggregated; no group is gathered in one task.
    """
    keys = ["command", "state", "bucket", "phase"]
    row = F.struct("recorded_at", "record_id", "duration_ms", "budget_ms")
    ends = observations.groupBy(*keys).agg(F.max(row).alias("cur"), F.min(row).alias("base"))
    prev = observations.join(ends.select(*keys, F.col("cur.recorded_at").alias("t"), F.col("cur.record_id").alias("r")), keys)
    prev = prev.where("NOT (recorded_at = t AND record_id = r)").groupBy(*keys).agg(F.max(row).alias("prev"))
    g = ends.join(prev, keys, "left")
    only = F.col("prev").isNull()
    out = g.select(
        *keys, F.col("cur.duration_ms").alias("current_ms"), F.col("cur.budget_ms").alias("budget_ms"), F.greatest(F.lit(0.0), F.col("cur.duration_ms") - F.col("cur.budget_ms")).alias("over0"),
        (F.col("cur.duration_ms") - F.col("prev.duration_ms")).alias("previous_delta_ms"), F.when(~only, F.col("cur.duration_ms") - F.col("base.duration_ms")).alias("baseline_delta_ms"),
    )
    over = F.when(F.col("budget_ms").isNotNull(), F.col("over0"))
    status = F.when(over > 0, "over_budget").when((F.col("previous_delta_ms") > 0) | (F.col("baseline_delta_ms") > 0), "slower").otherwise("ok")
    return out.withColumn("over_budget_ms", over).withColumn("status", status).drop("over0")


def latency_findings(observations: DataFrame, top: int = LATENCY_TOP) -> DataFrame:
    """The groups that aren't ok, the worst `top` of them: by time over budget, then deltas, then name."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    found = latency_groups(observations).where("status <> 'ok'")
    return found.orderBy(zero("over_budget_ms").desc(), zero("previous_delta_ms").desc(), zero("baseline_delta_ms").desc(), "command", F.desc("current_ms"), "state", "bucket", "phase").limit(top)


def budget_gate(observations: DataFrame) -> DataFrame:
    """(status, n) of observations with a budget (pass, over) and without (skipped)."""
    status = F.when(F.col("budget_ms").isNull(), "skipped").when(F.col("duration_ms") > F.col("budget_ms"), "over").otherwise("pass")
    return observations.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def ring(records: DataFrame, order: list[str], line: str, most: int = RING_RECORDS, most_bytes: int = RING_BYTES) -> DataFrame:
    """The newest records, at most `most` of them and `most_bytes` of their lines with a newline each."""
    newest = records.orderBy(*(F.desc(c) for c in order)).limit(most)
    w = Window.orderBy(*(F.desc(c) for c in order))  # over at most `most` rows
    return newest.withColumn("__bytes", F.sum(F.octet_length(line) + 1).over(w.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("__bytes") <= most_bytes).drop("__bytes")


def coverage(files: DataFrame, supported: tuple[str, ...]) -> DataFrame:
    """(ext, files, supported, examples): files by extension, the first three paths as examples.

    The three are taken by rank among the smallest, three at a time, so no group's paths are gathered.
    """
    f = files.select("path", F.coalesce(F.lower(extension(F.col("path"))), F.lit("")).alias("ext"))
    n = f.groupBy("ext").agg(F.count("*").alias("files"), F.min("path").alias("p1"))
    second = f.join(n.select("ext", "p1"), "ext").where("path > p1").groupBy("ext").agg(F.min("path").alias("p2"))
    third = f.join(second, "ext").where("path > p2").groupBy("ext").agg(F.min("path").alias("p3"))
    return n.join(second, "ext", "left").join(third, "ext", "left").select("ext", "files", F.col("ext").isin(*supported).alias("supported"), F.concat_ws(",", "p1", "p2", "p3").alias("examples"))


def unsupported_stack(covered: DataFrame, least: int = 1) -> DataFrame:
    return covered.where(~F.col("supported") & (F.col("ext") != "") & (F.col("files") >= least))


def next_actions(found: DataFrame, most: int = 3) -> list[str]:
    """The first signals to look at, errors first; at most `most` rows reach the driver."""
    rows = found.orderBy(F.col("severity") != "error", F.desc("count"), "signal_id").limit(most).collect()
    return [f"{r['signal_id']}: {r['count']}" for r in rows]
