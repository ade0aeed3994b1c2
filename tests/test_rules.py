"""Checks, the framework, records, metrics and streams on small tables."""

import json

import pytest

from factloom.operators import checks, clones, extract, framework, metrics
from factloom.sources import records


def pairs(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_rust_hygiene(spark):
    text = '#![allow(warnings, dead_code)]\n#[rustfmt::skip]\nfn a() { include!("b.rs"); }\n#[expect(clippy::all)]\nfn c() {}\n'
    files = spark.createDataFrame([("a.rs", text), ("b.inc", ""), ("c.rs", None)], "path string, content string")
    assert pairs(checks.rust_hygiene(files), "path", "code", "hits") == [
        ("a.rs", "RUST_SOURCE_INCLUDE_MACRO", 1), ("a.rs", "RUST_SOURCE_LINT_SUPPRESSION", 2), ("a.rs", "RUST_SOURCE_RUSTFMT_SKIP", 1), ("b.inc", "RUST_SOURCE_INC_FILE", 1),
    ]


def test_function_metrics(spark):
    text = "def f(a, b, c, d, *e):\n" + "".join(f"    if a > {i} and b:\n        pass\n" for i in range(6))
    files = spark.createDataFrame([("a.py", text), ("b.py", "def broken(:")], "path string, content string")
    found = checks.function_metrics(extract.python_function_metrics(files))
    assert pairs(found, "name", "code", "amount") == [("f", "FUNCTION_COMPLEXITY", 13), ("f", "FUNCTION_PARAMS", 5)]


def test_aliases(spark):
    aliases = [("@lib/*", ["src/lib/*", "src/old/*"]), ("config", ["src/config"])]
    assert extract.alias_targets("@lib/x", aliases) == ["src/lib/x", "src/old/x"]
    imports = spark.createDataFrame([("src/app/a.ts", "@lib/x", "x"), ("src/b.ts", "config", "y"), ("src/b.ts", "./c", "z")], "path string, target string, name string")
    files = spark.createDataFrame([(p,) for p in ("src/old/x.ts", "src/config/index.ts", "src/c.tsx")], "path string")
    found = extract.resolve_imports(extract.with_aliases(imports, aliases), files)
    assert pairs(found, "path", "to") == [("src/app/a.ts", "src/old/x.ts"), ("src/b.ts", "src/c.tsx"), ("src/b.ts", "src/config/index.ts")]


def test_python_imports_by_unique_suffix(spark):
    files = spark.createDataFrame([("one/pkg/a.py", "import pkg.b\nimport twice\n"), ("one/pkg/b.py", ""), ("x/twice.py", ""), ("y/twice.py", "")], "path string, content string")
    assert pairs(extract.python_import_pairs(files), "from_path", "to_path") == [("one/pkg/a.py", "one/pkg/b.py")]


def test_reexports_settle(spark):
    rows = [("a", "f", "function:a#f", None, None), ("b", "g", None, "a", "f"), ("c", "h", None, "b", "g"), ("d", "k", None, "d", "k")]
    found = extract.reexport_closure(spark.createDataFrame(rows, "path string, name string, id string, from_path string, from_name string"), 4)
    assert pairs(found, "path", "name") == [("a", "f"), ("b", "g"), ("c", "h")]


def test_check_selection_and_runs(spark):
    files = spark.createDataFrame([("a", "x\n" * 400)], "path string, content string")
    row = lambda c: checks.long_files(c.files).selectExpr("path", "'error' AS severity")
    pack = [framework.Check("length", row), framework.Check("graph", row, needs_graph=True), framework.Check("bad", lambda c: 1 / 0), framework.Check("late", row)]
    seen = [(i, o) for i, o, _ in framework.run_checks(pack, framework.Context(files))]
    assert seen == [("length", "ran"), ("graph", "skipped"), ("bad", "infrastructure_failure: ZeroDivisionError")]
    assert [c.id for c in framework.select_checks(pack, ["late", "length", "late"], "all")] == ["late", "length"]
    with pytest.raises(ValueError):
        framework.select_checks(pack, ["none"], "all")


def test_rollup_of_nothing_is_skipped(spark):
    runs = spark.createDataFrame([], "status string")
    assert framework.rollup(runs).first()["status"] == "skipped"
    assert framework.rollup(spark.createDataFrame([("passed",), ("provider_failure",)], "status string")).first()["status"] == "provider_failure"


def test_file_length_messages_are_blanked(spark):
    schema = "check_id string, category string, severity string, path string, code string, line int, col int, end_line int, end_col int, message string"
    rows = [("c", "p", "error", "a", code, None, None, None, None, text) for code, text in (("TS_FILE_LINES", "now 310"), ("OTHER", "now 310"))]
    old = [(*r[:9], "was 305") for r in rows]
    assert pairs(framework.introduced(spark.createDataFrame(rows, schema), spark.createDataFrame(old, schema)), "code") == [("OTHER",)]


def test_clone_comments_and_tokens(spark):
    block = "alpha beta gamma delta = one\n// note\n# note\nepsilon zeta eta théta // end\n\niota  kappa lambda mu\n nu xi omicron pi rho\nsigma tau upsilon phi\n"
    files = spark.createDataFrame([("a", block), ("b", "// other\n" + block), ("c", "short\n" * 9)], "path string, content string")
    found = clones.occurrences(clones.with_overlays(files, None))
    assert pairs(clones.findings(found), "path", "peer_path") == [("a", "b"), ("b", "a")]


def test_records(spark, tmp_path):
    (tmp_path / "budgets.json").write_text(json.dumps({"budgets": [{"command": "scan all", "scope": "cold", "bucket": "small", "budget_ms": 5.0, "phase_budgets": [{"phase": "parse", "budget_ms": 1.0}]}]}))
    (tmp_path / "t.json").write_text('{"record_id":1,"command":"scan all now","state":"cold","bucket":"small","recorded_at":"2024-01-01T00:00:00Z","duration_ms":7.0,"phases":[{"phase":"parse","duration_ms":0.5}]}\n')
    budgets = records.budgets(spark, str(tmp_path / "budgets.json"))
    seen = metrics.latency_observations(records.telemetry(spark, str(tmp_path / "t.json")), budgets)
    assert pairs(seen, "command", "phase", "duration_ms", "budget_ms") == [("scan all", "parse", 0.5, 1.0), ("scan all", "total", 7.0, 5.0)]
    assert pairs(metrics.latency_findings(seen), "phase", "status", "over_budget_ms") == [("total", "over_budget", 2.0)]
    (tmp_path / "bad.json").write_text('{"report_id": 1\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        records.history(spark, str(tmp_path / "bad.json")).collect()
    with pytest.raises(ValueError):
        records.telemetry(spark, str(tmp_path / "t.json"), most_bytes=10)


def test_watch_updates_in_batches(spark, tmp_path):
    from factloom.streaming.latency import watch

    source, got = str(tmp_path / "in"), []
    spark.createDataFrame([("a", "1")], "path string, sha256 string").write.parquet(source)
    stream = spark.readStream.schema("path string, sha256 string").parquet(source)
    q = watch(stream, lambda df, i: got.extend(r["path"] for r in df.collect()), str(tmp_path / "checkpoint"), idle_seconds=8)
    assert got == ["a"] and not q.isActive
