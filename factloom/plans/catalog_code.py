"""Registered queries over source files: extraction, linking, and the checks that read code.

The files come from the driver's tables by a rule (`code_files`), so SQL can say from the tables what must be found.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import json_flag
from factloom.operators import checks, extract, inspect, metrics
from factloom.plans.catalog import Tables, query
from factloom.plans.durable import written
from factloom.sources import repo

PY, TS, RS = "concat('pkg/m', k, '.py')", "concat('web/s', k, '.ts')", "concat('rs/src/n', k, '.rs')"
PY_Q, TS_Q, RS_Q = (x.replace(", k,", ", q,") for x in (PY, TS, RS))
#: Declarations: links, path, kind of node, its name, whether it is exported.
DECLARED = (
    ("py", PY, "Module", "'module'", "true"), ("py", PY, "Class", "concat('C', k)", "true"), ("py", PY, "Function", "concat('C', k, '.go')", "true"), ("py", PY, "Function", "concat('f', k)", "true"),
    ("py", PY, "Function", "concat('_hidden', k)", "false"), ("py", PY, "Function", "concat('test_f', k)", "true"),
    ("ts", TS, "Type", "concat('Shape', k)", "true"), ("ts", TS, "Type", "concat('Loose', k)", "true"), ("ts", TS, "Class", "concat('Box', k)", "true"), ("ts", TS, "Function", "concat('run', k)", "true"), ("ts", TS, "Test", "concat('runs ', k)", "false"),
    ("rs", RS, "Struct", "concat('S', k)", "true"), ("rs", RS, "Trait", "concat('T', k)", "true"), ("rs", RS, "Function", "concat('go', k)", "true"),
)


def _id(kind: str, path: str, name: str) -> str:
    return f"concat('{kind.lower()}:', {path}, '#', {name})"


NODES = ", xn AS (SELECT concat('file:', path) AS id, 'File' AS kind, path, CAST(NULL AS VARCHAR) AS name, false AS exported FROM code_files WHERE path NOT LIKE '%.go'" + "".join(
    f" UNION ALL SELECT {_id(kind, path, name)}, '{kind}', {path}, " + ("concat('m', k)" if kind == "Module" else name) + f", {exported} FROM {links}_links" for links, path, kind, name, exported in DECLARED
) + ")"


def _contains(links: str, path: str, kind: str, name: str) -> str:
    if links == "py" and kind != "Module":
        owner = _id("class", path, "concat('C', k)") if ".go" in name else _id("module", path, "'module'")
    else:
        owner = f"concat('file:', {path})"
    return f"SELECT 'CONTAINS' AS kind, {owner} AS src, {_id(kind, path, name)} AS dst FROM {links}_links"


def _edge(kind: str, links: str, src: str, dst: str, where: str = "true") -> str:
    return f"SELECT '{kind}', {src}, {dst} FROM {links}_links WHERE {where}"


F_P, F_Q, TEST_P = _id("function", PY, "concat('f', k)"), _id("function", PY_Q, "concat('f', q)"), _id("function", PY, "concat('test_f', k)")
RUN, RUN_Q, RUNS = _id("function", TS, "concat('run', k)"), _id("function", TS_Q, "concat('run', q)"), _id("test", TS, "concat('runs ', k)")
EDGES = ", xe AS (" + " UNION ALL ".join([
    *(_contains(*d[:4]) for d in DECLARED),
    *(_edge(kind, links, f"concat('file:', {a})", f"concat('file:', {b})", "q IS NOT NULL") for kind in ("IMPORTS_FROM", "DEPENDS_ON") for links, a, b in (("py", PY, PY_Q), ("ts", TS, TS_Q), ("rs", RS, RS_Q))),
    _edge("CALLS", "py", _id("function", PY, "concat('C', k, '.go')"), F_Q, "q IS NOT NULL"), _edge("CALLS", "py", _id("function", PY, "concat('_hidden', k)"), F_P), _edge("CALLS", "py", TEST_P, F_P), _edge("TESTED_BY", "py", F_P, TEST_P),
    _edge("INHERITS", "py", _id("class", PY, "concat('C', k)"), _id("class", PY_Q, "concat('C', q)"), "q IS NOT NULL"),
    _edge("CALLS", "ts", RUN, RUN_Q, "q IS NOT NULL"), _edge("CALLS", "ts", RUNS, RUN), _edge("TESTED_BY", "ts", RUN, RUNS), _edge("IMPLEMENTS", "ts", _id("class", TS, "concat('Box', k)"), _id("type", TS, "concat('Shape', k)")),
    _edge("IMPLEMENTS", "rs", _id("struct", RS, "concat('S', k)"), _id("trait", RS, "concat('T', k)")),
]) + ")"


def _linked(t: Tables, more: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    files = written(t.code_files if more is None else t.code_files.unionByName(more), "code")
    return extract.link(extract.parse(files), files)


@query("q_extract_dispatch", " SELECT path, CASE WHEN path LIKE '%.py' THEN 'python' WHEN path LIKE '%.ts' THEN 'typescript' WHEN path LIKE '%.rs' THEN 'rust' END AS language, path NOT LIKE '%.go' AS parsed FROM code_files")
def _(t):
    files = written(t.code_files, "code")
    found = extract.parse(files).select("path").distinct().withColumn("parsed", F.lit(True))
    return files.select("path", repo.language(F.col("path")).alias("language")).join(found, "path", "left").withColumn("parsed", F.coalesce("parsed", F.lit(False)))


@query("q_unsupported_files", " SELECT path, 'go' AS ext FROM code_files WHERE path LIKE '%.go'")
def _(t):
    return repo.unsupported(t.code_files)


for _name, _path, _language in (("typescript", "web/%", "ts"), ("python", "pkg/%", "py"), ("rust", "rs/%", "rs")):

    @query(f"q_extract_{_name}", NODES + f" SELECT id, kind, name, exported FROM xn WHERE path LIKE '{_path}' AND kind <> 'File'")
    def _(t, path=_path):
        facts = extract.parse(t.code_files.where(F.col("path").like(path))).where("fact = 'declare'")
        return facts.select("id", "kind", "name", "exported")


@query("q_extract_nodes", NODES + " SELECT id, kind, path, name, exported FROM xn")
def _(t):
    return _linked(t)[0].select("id", "kind", "path", "name", json_flag(F.col("attributes"), "exported").alias("exported"))


@query("q_extract_edges", EDGES + " SELECT DISTINCT concat('edge:', kind, ':', src, '->', dst) AS id, kind, src, dst FROM xe")
def _(t):
    return _linked(t)[1].select("id", "kind", "src", "dst")


@query("q_extract_calls", EDGES + " SELECT kind, count(DISTINCT concat(src, ' ', dst)) AS n FROM xe WHERE kind IN ('CALLS', 'TESTED_BY', 'INHERITS', 'IMPLEMENTS') GROUP BY kind")
def _(t):
    return _linked(t)[1].where("kind IN ('CALLS', 'TESTED_BY', 'INHERITS', 'IMPLEMENTS')").groupBy("kind").agg(F.count("*").alias("n"))


@query("q_extract_imports", f" SELECT {PY} AS path, concat('pkg.m', q) AS target, {PY_Q} AS \"to\" FROM py_links WHERE q IS NOT NULL UNION ALL SELECT {TS}, concat('./s', q), {TS_Q} FROM ts_links WHERE q IS NOT NULL UNION ALL SELECT {RS}, concat('crate::n', q, '::go', q), {RS_Q} FROM rs_links WHERE q IS NOT NULL")
def _(t):
    files = written(t.code_files, "code")
    return extract.resolve_imports(extract.parse(files).where("fact = 'import'"), files).select("path", "target", "to").distinct()


@query("q_python_imports", f" SELECT DISTINCT {PY} AS from_path, {PY_Q} AS to_path FROM py_links WHERE q IS NOT NULL")
def _(t):
    return extract.python_import_pairs(t.code_files.where("path LIKE '%.py'"))


@query("q_import_submodules", f" SELECT concat('app/u', k, '.py') AS path, {PY} AS \"to\" FROM py_links WHERE k % 3 = 0")
def _(t):
    files = t.code_files.where("path LIKE '%.py'")
    users = t.py_links.where("k % 3 = 0").select(F.format_string("app/u%d.py", "k").alias("path"), F.format_string("from pkg import m%d\n", "k").alias("content"))
    every = written(files.unionByName(users), "code")
    found = extract.resolve_imports(extract.parse(every.where("path LIKE 'app/%'")).where("fact = 'import'"), every)
    return found.select("path", "to")


@query("q_import_aliases", " SELECT concat('ui/a', k, '.ts') AS path, concat('web/s', k, '.ts') AS \"to\" FROM ts_links WHERE k % 2 = 0 UNION ALL SELECT concat('ui/a', k, '.ts'), 'web/s1.ts' FROM ts_links WHERE k % 2 = 1")
def _(t):
    users = t.ts_links.select(F.format_string("ui/a%d.ts", "k").alias("path"), F.expr("CASE WHEN k % 2 = 0 THEN concat('import { a } from \"@web/s', k, '\";') ELSE 'import { b } from \"first\";' END").alias("content"))
    every = written(t.code_files.where("path LIKE 'web/%'").unionByName(users), "code")
    imports = extract.with_aliases(extract.parse(every.where("path LIKE 'ui/%'")).where("fact = 'import'"), [("@web/*", ["gone/*", "web/*"]), ("first", ["web/s1"])])
    return extract.resolve_imports(imports, every).select("path", "to").distinct()


@query("q_unresolved_prefixes", " SELECT concat('app/v', k, '.py') AS path, concat('pkg.gone', k) AS target FROM py_links WHERE k % 5 = 0")
def _(t):
    users = t.py_links.where("k % 5 = 0").select(F.format_string("app/v%d.py", "k").alias("path"), F.format_string("import pkg.gone%d\nimport json.decoder\n", "k").alias("content"))
    every = written(t.code_files.where("path LIKE 'pkg/%'").unionByName(users), "code")
    imports = written(extract.parse(every).where("fact = 'import'"), "imports")
    return extract.unresolved_prefixes(imports, extract.resolve_imports(imports, every), every)


@query("q_reexports", " SELECT concat('lib/x', a.s_suppkey, '.ts') AS path, concat('base', b.s_suppkey) AS name, concat('function:lib/x', b.s_suppkey, '.ts#base') AS id FROM supplier a JOIN supplier b ON b.s_suppkey // 8 = a.s_suppkey // 8 AND b.s_suppkey <= a.s_suppkey")
def _(t):
    s = t.supplier.select(F.col("s_suppkey").alias("k"))
    path = lambda k: F.concat(F.lit("lib/x"), k, F.lit(".ts"))
    name = F.concat(F.lit("base"), "k")
    own = s.select(path(F.col("k")).alias("path"), name.alias("name"), F.concat(F.lit("function:"), path(F.col("k")), F.lit("#base")).alias("id"), F.lit(None).cast("string").alias("from_path"), F.lit(None).cast("string").alias("from_name"))
    # Each file says again, from the file before it, all names of its eight.
    again = s.where("k % 8 <> 0").select("k", F.explode(F.expr("sequence(k - k % 8, k - 1)")).alias("b"))
    again = again.select(path(F.col("k")).alias("path"), F.concat(F.lit("base"), "b").alias("name"), F.lit(None).cast("string").alias("id"), path(F.col("k") - 1).alias("from_path"), F.concat(F.lit("base"), "b").alias("from_name"))
    return extract.reexport_closure(own.unionByName(again), 10)


@query("q_extract_all_or_nothing", " SELECT 'nodes' AS part, CAST(0 AS BIGINT) AS n UNION ALL SELECT 'edges', 0 UNION ALL SELECT 'diagnostics', 1")
def _(t):
    nodes, edges, diagnostics = _linked(t, t.spark.createDataFrame([("pkg/broken.py", "def f(:\n")], "path string, content string"))
    parts = (("nodes", nodes), ("edges", edges), ("diagnostics", diagnostics))
    return t.spark.createDataFrame([(name, df.count()) for name, df in parts], "part string, n long")


@query("q_function_metrics", f" SELECT {PY} AS path, name, CAST(2 AS BIGINT) AS lines, CAST(complexity AS BIGINT) AS complexity, CAST(params AS BIGINT) AS params FROM (SELECT k, 'go' AS name, 1 AS complexity, 1 AS params FROM py_links UNION ALL SELECT k, concat('f', k), 2, 1 FROM py_links UNION ALL SELECT k, concat('_hidden', k), 1, 0 FROM py_links UNION ALL SELECT k, concat('test_f', k), 1, 0 FROM py_links) z")
def _(t):
    return extract.python_function_metrics(t.code_files)


@query("q_function_limits", f" SELECT {PY} AS path, concat('f', k) AS name, 'FUNCTION_COMPLEXITY' AS code, CAST(2 AS BIGINT) AS amount FROM py_links")
def _(t):
    return checks.function_metrics(extract.python_function_metrics(t.code_files), most_complexity=1)


@query("q_rust_hygiene", f" SELECT {RS} AS path, 'RUST_SOURCE_LINT_SUPPRESSION' AS code, CAST(1 AS BIGINT) AS hits FROM rs_links WHERE k % 2 = 1 UNION ALL SELECT {RS}, 'RUST_SOURCE_INCLUDE_MACRO', 1 FROM rs_links WHERE k % 3 = 0")
def _(t):
    return checks.rust_hygiene(t.code_files.where("path LIKE '%.rs'"))


@query("q_dead_rust_files", f" SELECT concat('file:', {RS}) AS id FROM rs_links WHERE q IS NULL AND k NOT IN (SELECT q FROM rs_links WHERE q IS NOT NULL)")
def _(t):
    nodes, edges, _ = _linked(t)
    return checks.dead_rust_files(nodes, edges)


@query("q_unused_types", f" SELECT {_id('type', TS, "concat('Loose', k)")} AS id FROM ts_links WHERE k NOT IN (SELECT q FROM ts_links WHERE q IS NOT NULL)")
def _(t):
    nodes, edges, _ = _linked(t)
    return checks.unused_types(nodes, edges)


@query("q_unsupported_stack", " SELECT 'go' AS ext, count(*) AS files FROM region")
def _(t):
    covered = metrics.coverage(t.code_files, ("py", "ts", "rs"))
    return metrics.unsupported_stack(covered).select("ext", "files")


@query("q_rust_methods", " SELECT concat('method:rs/m', n_nationkey, '.rs#', t, '::new') AS id FROM nation, (VALUES ('A'), ('B')) AS v(t)")
def _(t):
    text = "concat('struct A;\\nstruct B;\\nimpl A {\\n    pub fn new() -> A { A }\\n}\\nimpl Clone for B {\\n    fn new() -> B { B }\\n}\\n')"
    files = t.nation.select(F.format_string("rs/m%d.rs", "n_nationkey").alias("path"), F.expr(text).alias("content"))
    return extract.parse(files).where("kind = 'Method'").select("id")


@query("q_inspect_definitions", NODES + " SELECT id, kind FROM xn WHERE name LIKE 'C%.go'")
def _(t):
    return inspect.definitions(_linked(t)[0], "go").select("id", "kind")


@query("q_inspect_references", EDGES + " SELECT DISTINCT kind, src, dst FROM xe WHERE kind <> 'CONTAINS' AND (dst LIKE 'function:%' OR dst LIKE 'class:%')")
def _(t):
    nodes, edges, _ = _linked(t)
    return inspect.references(edges, nodes.where("kind IN ('Function', 'Class')")).where("kind <> 'TESTED_BY' OR dst LIKE 'function:%'").select("kind", "src", "dst")


@query("q_inspect_implementations", EDGES + " SELECT DISTINCT src AS id, dst AS target, CASE kind WHEN 'IMPLEMENTS' THEN 4 ELSE 3 END AS priority FROM xe WHERE kind IN ('IMPLEMENTS', 'INHERITS')")
def _(t):
    nodes, edges, _ = _linked(t)
    return inspect.implementations(nodes, edges, nodes.where("kind IN ('Class', 'Type', 'Trait')"))


@query("q_inspect_signatures", f" SELECT {_id('function', PY, "concat('f', k)")} AS id, concat('def f', k, '(x):') AS signature FROM py_links UNION ALL SELECT {_id('class', TS, "concat('Box', k)")}, concat('export class Box', k, ' implements Shape', k, ' {{') FROM ts_links UNION ALL SELECT {_id('struct', RS, "concat('S', k)")}, concat('pub struct S', k, ';') FROM rs_links")
def _(t):
    nodes = _linked(t)[0].where("(kind = 'Function' AND name RLIKE '^f[0-9]+$') OR (kind = 'Class' AND path LIKE 'web/%') OR kind = 'Struct'")
    return inspect.signatures(nodes, t.code_files)
