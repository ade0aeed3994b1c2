"""Extraction: source files to facts. Parsing is per file in Arrow batches; linking is joins.

Python is parsed by `ast`. TypeScript, JavaScript and Rust are read by patterns: declarations, imports, calls, heritage
and tests in the common spellings.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.paths import edge_id
from factloom.plans.durable import written

ROW = "path string, fact string, id string, kind string, name string, owner string, target string, local string, pos int, exported boolean, is_test boolean, message string"
FIELDS = [x.split()[0] for x in ROW.split(", ")]
BUILTINS = frozenset("print len range open sorted list dict set tuple str int float bool super isinstance enumerate zip map filter sum min max abs any all repr type getattr setattr hasattr".split())


def _row(path: str, fact: str, **values) -> dict:
    return {**dict.fromkeys(FIELDS), "path": path, "fact": fact, **values}


class _Python(ast.NodeVisitor):
    """Declarations with nested names, imports, calls and bases of one module."""

    def __init__(self, path: str, public: set[str] | None):
        self.path, self.public, self.scope, self.rows, self.pos = path, public, [], [], 0

    def add(self, fact: str, **values) -> None:
        self.pos += 1
        self.rows.append(_row(self.path, fact, pos=self.pos, **values))

    def owner(self) -> str:
        return self.scope[-1][0] if self.scope else f"module:{self.path}#module"

    def declare(self, kind: str, name: str, test: bool = False) -> str:
        qualified = ".".join([*(n for _, n in self.scope), name])
        node = f"{kind.lower()}:{self.path}#{qualified}"
        top = not self.scope
        exported = name in self.public if top and self.public is not None else not name.startswith("_")
        self.add("declare", id=node, kind=kind, name=qualified, owner=self.owner(), exported=exported, is_test=test)
        return node

    def inside(self, node: str, name: str, body) -> None:
        self.scope.append((node, name))
        for child in body:
            self.visit(child)
        self.scope.pop()

    def visit_FunctionDef(self, n) -> None:
        for d in n.decorator_list:
            self.visit(d)
        self.inside(self.declare("Function", n.name, n.name.startswith("test")), n.name, n.body)

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_ClassDef(self, n) -> None:
        node = self.declare("Class", n.name, n.name.startswith("Test"))
        for b in n.bases:
            if name := _dotted(b):
                self.add("heritage", owner=node, target=name, kind="INHERITS")
        self.inside(node, n.name, n.body)

    def visit_Assign(self, n) -> None:
        if not self.scope:
            for t in n.targets:
                if isinstance(t, ast.Name) and t.id != "__all__":
                    self.declare("Variable", t.id)
        self.generic_visit(n)

    def visit_Import(self, n) -> None:
        for a in n.names:
            self.add("import", target=a.name, local=a.asname or a.name, name=None)

    def visit_ImportFrom(self, n) -> None:
        for a in n.names:
            self.add("import", target="." * n.level + (n.module or ""), local=a.asname or a.name, name=a.name)

    def visit_Call(self, n) -> None:
        name = _dotted(n.func)
        if name and name not in BUILTINS:
            self.add("call", owner=self.owner(), target=name)
        self.generic_visit(n)


def _dotted(n) -> str | None:
    if isinstance(n, ast.Name):
        return n.id
    if isinstance(n, ast.Attribute):
        base = _dotted(n.value)
        return f"{base}.{n.attr}" if base else None
    return None


def parse_python(path: str, text: str) -> list[dict]:
    try:
        return _parsed_python(path, ast.parse(text))
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:  # the last two: nested too deeply
        return [_row(path, "diagnostic", kind="error", message=f"syntax: {e}"[:300])]


def _parsed_python(path: str, tree: ast.Module) -> list[dict]:
    public = None
    for n in tree.body:
        if isinstance(n, ast.Assign) and any(isinstance(t, ast.Name) and t.id == "__all__" for t in n.targets) and isinstance(n.value, (ast.List, ast.Tuple)):
            public = {x.value for x in n.value.elts if isinstance(x, ast.Constant)}
    v = _Python(path, public)
    v.rows.append(_row(path, "declare", id=f"module:{path}#module", kind="Module", name=path.rsplit("/", 1)[-1].split(".")[0], owner=f"file:{path}", exported=True, is_test=False, pos=0))
    v.visit(tree)
    return v.rows


TS_DECLARE = re.compile(r"^[ \t]*(export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?(function\*?|class|interface|type|enum|const|let|var)\s+([A-Za-z_$][\w$]*)(?:<[^>{]*>)?(?:\s+extends\s+([\w$.]+))?(?:\s+implements\s+([\w$., ]+))?", re.MULTILINE)
TS_IMPORT = re.compile(r"""(?:import|export)\s+(?:type\s+)?(?:([\w$]+)\s*,?\s*)?(?:\{([^}]*)\}|\*(?:\s+as\s+([\w$]+))?)?\s*(?:from\s*)?["']([^"']+)["']|import\(\s*["']([^"']+)["']\s*\)|require\(\s*["']([^"']+)["']\s*\)""")
TS_CALL = re.compile(r"(?<![\w$.])(?:new\s+|((?:function|class)\b[*\s]*))?([A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*)\s*\(")
TS_TEST = re.compile(r"""(?<![\w$.])(?:test|it)\(\s*["'`]([^"'`]+)["'`]""")
TS_KIND = {"function": "Function", "function*": "Function", "class": "Class", "interface": "Type", "type": "Type", "enum": "Type"}
TS_WORDS = frozenset("if for while switch catch return function import require typeof super test it describe expect constructor".split())


def parse_typescript(path: str, text: str) -> list[dict]:
    rows, pos = [], 0
    spans = [(0, f"file:{path}")]
    for m in TS_DECLARE.finditer(text):
        pos += 1
        kind = TS_KIND.get(m[2], "Variable")
        node = f"{kind.lower()}:{path}#{m[3]}"
        if m[0][:1] not in " \t":
            spans.append((m.start(), node))
        rows.append(_row(path, "declare", id=node, kind=kind, name=m[3], owner=f"file:{path}", exported=m[1] is not None, is_test=False, pos=pos))
        for name, edge in [(m[4], "INHERITS")] + [(x.strip(), "IMPLEMENTS") for x in (m[5] or "").split(",")]:
            if name:
                rows.append(_row(path, "heritage", owner=node, target=name, kind=edge, pos=pos))
    for m in TS_TEST.finditer(text):
        pos += 1
        node = f"test:{path}#{m[1]}"
        spans.append((m.start(), node))
        rows.append(_row(path, "declare", id=node, kind="Test", name=m[1], owner=f"file:{path}", exported=False, is_test=True, pos=pos))
    spans.sort()
    for m in TS_IMPORT.finditer(text):
        pos += 1
        target = m[4] or m[5] or m[6]
        names = [(m[1], "default")] if m[1] else []
        names += [(x.split(" as ")[-1].strip(), x.split(" as ")[0].strip()) for x in (m[2] or "").replace("type ", "").split(",") if x.strip()]
        names += [(m[3], "*")] if m[3] else []
        for local, name in names or [(None, None)]:
            rows.append(_row(path, "import", target=target, local=local, name=name, pos=pos))
    from bisect import bisect_right

    starts = [a for a, _ in spans]
    for m in TS_CALL.finditer(text):
        if not m[1] and m[2].split(".")[0] not in TS_WORDS:
            owner = spans[bisect_right(starts, m.start()) - 1][1]
            rows.append(_row(path, "call", owner=owner, target=m[2], pos=pos, is_test=owner.startswith("test:")))
    return rows


RUST_DECLARE = re.compile(r"^([ \t]*)(pub(?:\([^)]*\))?\s+)?(?:async\s+|unsafe\s+|const\s+(?=fn))*(fn|struct|enum|trait|mod|type|const|static|macro_rules!)\s+([A-Za-z_]\w*)", re.MULTILINE)
RUST_USE = re.compile(r"^\s*(?:pub\s+)?use\s+([\w:]+)(?:::\{([^}]*)\})?\s*;", re.MULTILINE)
RUST_MOD = re.compile(r"^\s*(?:pub\s+)?mod\s+(\w+)\s*;", re.MULTILINE)
RUST_IMPL = re.compile(r"^impl(?:<[^>]*>)?\s+(?:([\w:]+)(?:<[^>]*>)?\s+for\s+)?([\w:]+)", re.MULTILINE)
RUST_KIND = {"fn": "Function", "struct": "Struct", "enum": "Enum", "trait": "Trait", "mod": "Module", "type": "TypeAlias", "const": "Const", "static": "Static", "macro_rules!": "Macro"}


RUST_CLOSE = re.compile(r"^\}", re.MULTILINE)


def parse_rust(path: str, text: str) -> list[dict]:
    """Items of one file; a method's id has the type of its impl, so that methods of one name stay apart."""
    from bisect import bisect_left, bisect_right

    rows, pos = [], 0
    closes = [m.start() for m in RUST_CLOSE.finditer(text)]
    impls = [(m.start(), m[2].split("::")[-1]) for m in RUST_IMPL.finditer(text)]
    starts = [a for a, _ in impls]

    def within_impl(at: int) -> str | None:
        k = bisect_right(starts, at) - 1
        if k < 0:
            return None
        end = bisect_left(closes, starts[k])
        return impls[k][1] if end == len(closes) or at < closes[end] else None

    for m in RUST_DECLARE.finditer(text):
        pos += 1
        test = m[3] == "fn" and "#[test]" in text[max(0, m.start() - 80) : m.start()].rsplit("}", 1)[-1]
        kind = "Test" if test else "Method" if m[3] == "fn" and m[1] else RUST_KIND[m[3]]
        of = within_impl(m.start()) if kind == "Method" else None
        rows.append(_row(path, "declare", id=f"{kind.lower()}:{path}#{f'{of}::' if of else ''}{m[4]}", kind=kind, name=m[4], owner=f"file:{path}", exported=m[2] is not None, is_test=test, pos=pos))
    for m in RUST_IMPL.finditer(text):
        if m[1]:
            rows.append(_row(path, "heritage", owner=f"struct:{path}#{m[2]}", target=m[1].split("::")[-1], kind="IMPLEMENTS", pos=pos))
    for m in RUST_USE.finditer(text):
        for name in (x.strip() for x in (m[2] or "").split(",")) if m[2] else [None]:
            rows.append(_row(path, "import", target=m[1] + (f"::{name}" if name else ""), local=(name or m[1].split("::")[-1]), name=name, pos=pos))
    rows += [_row(path, "import", target=f"self::{m[1]}", local=m[1], name=None, pos=pos) for m in RUST_MOD.finditer(text)]
    return rows


PARSERS = {"py": parse_python, "pyi": parse_python, "rs": parse_rust, **dict.fromkeys(("ts", "tsx", "js", "jsx", "mts", "cts"), parse_typescript)}


def parse(files: DataFrame) -> DataFrame:
    """Facts of each file (path, content), unlinked: declare, import, call, heritage and diagnostic rows."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"pos": pa.int32(), "exported": pa.bool_(), "is_test": pa.bool_()}
        schema = pa.schema([(f, kinds.get(f, pa.string())) for f in FIELDS])
        for batch in batches:
            rows = []
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parser = PARSERS.get(path.rsplit(".", 1)[-1])
                if parser:
                    rows += parser(path, text or "")
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.select("path", "content").mapInArrow(part, ROW)


BRANCHES = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.comprehension, ast.BoolOp, ast.match_case)


def python_function_metrics(files: DataFrame) -> DataFrame:
    """(path, name, lines, complexity, params) of every function in Python files that parse."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("name", pa.string()), ("lines", pa.int64()), ("complexity", pa.int64()), ("params", pa.int64())])
        for batch in batches:
            rows = []
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    tree = ast.parse(text or "")
                except (SyntaxError, ValueError, RecursionError, MemoryError):
                    continue
                for n in ast.walk(tree):
                    if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
                        branches = sum(len(x.values) - 1 if isinstance(x, ast.BoolOp) else 1 for x in ast.walk(n) if isinstance(x, BRANCHES))
                        a = n.args
                        params = len(a.posonlyargs) + len(a.args) + len(a.kwonlyargs) + (a.vararg is not None) + (a.kwarg is not None)
                        rows.append({"path": path, "name": n.name, "lines": n.end_lineno - n.lineno + 1, "complexity": 1 + branches, "params": params})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.where(F.col("path").rlike(r"\.pyi?$")).select("path", "content").mapInArrow(part, "path string, name string, lines long, complexity long, params long")


def alias_targets(target: str, aliases: list[tuple[str, list[str]]]) -> list[str]:
    """What an import specifier may mean by aliases, in order: a pattern has at most one `*`, whose text goes to the target's `*`."""
    out = []
    for pattern, targets in aliases:
        head, star, tail = pattern.partition("*")
        if star and target.startswith(head) and target.endswith(tail) and len(target) >= len(head) + len(tail):
            held = target[len(head) : len(target) - len(tail)]
        elif target == pattern:
            held = ""
        else:
            continue
        out += [t.replace("*", held, 1) for t in targets]
    return out


def with_aliases(imports: DataFrame, aliases: list[tuple[str, list[str]]]) -> DataFrame:
    """Imports whose specifier an alias matches, once for each meaning, as a path from the importing file; others as they are.

    Aliases are a project's few patterns and become one expression.
    """
    meanings = []
    for pattern, targets in aliases:
        head, star, tail = pattern.partition("*")
        on = (F.col("target") == pattern) if not star else F.col("target").startswith(head) & F.col("target").endswith(tail) & (F.length("target") >= len(head) + len(tail))
        held = F.expr(f"substring(target, {len(head) + 1}, length(target) - {len(head) + len(tail)})") if star else F.lit("")
        for t in targets:
            a, s, b = t.partition("*")
            meanings.append(F.when(on, F.concat(F.lit(a), held, F.lit(b)) if s else F.lit(a)))
    if not meanings:
        return imports
    up = F.repeat(F.lit("../"), F.size(F.split("path", "/")) - 1)
    found = F.transform(F.filter(F.array(*meanings), lambda x: x.isNotNull()), lambda x: F.concat(F.lit("./"), up, x))
    return imports.withColumn("target", F.explode(F.when(F.size(found) > 0, found).otherwise(F.array("target"))))


def unresolved_prefixes(imports: DataFrame, resolved: DataFrame, files: DataFrame) -> DataFrame:
    """(path, target): Python imports that resolve to nothing though their first part is a top-level folder or module here."""
    top = files.where(F.col("path").rlike(r"\.pyi?$")).select(F.regexp_replace(F.element_at(F.split("path", "/"), 1), r"\.pyi?$", "").alias("first")).distinct()
    i = imports.where(F.col("path").rlike(r"\.pyi?$")).select("path", "target").distinct().join(resolved.select("path", "target"), ["path", "target"], "left_anti")
    return i.withColumn("first", F.substring_index("target", ".", 1)).join(top, "first", "left_semi").select("path", "target")


def _candidates(imports: DataFrame) -> DataFrame:
    """(path, target, candidate, at): the paths an import may mean, in order of preference."""
    folder = F.regexp_replace("path", r"/?[^/]+$", "")
    i = imports.select("path", "target", "name").distinct()
    js = i.where(F.col("path").rlike(r"\.[cm]?[jt]sx?$") & F.col("target").startswith(".")).withColumn("base", F.concat_ws("/", folder, "target"))
    from factloom.functions.paths import join_relative

    stem = F.regexp_replace(join_relative(folder, F.col("target")), r"\.([cm]?)js(x?)$", "")
    whole = join_relative(folder, F.col("target"))
    js_names = F.array(whole, *(F.concat(stem, F.lit(e)) for e in (".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js", "/index.jsx")))
    js = js.select("path", "target", F.lit(None).cast("string").alias("name"), js_names.alias("names"))
    py = i.where(F.col("path").rlike(r"\.pyi?$"))
    dots = F.length(F.regexp_extract("target", r"^\.*", 0))
    up = F.array_join(F.slice(F.split("path", "/"), F.lit(1), F.greatest(F.size(F.split("path", "/")) - dots, F.lit(0))), "/")
    dotted = F.replace(F.regexp_replace("target", r"^\.+", ""), F.lit("."), F.lit("/"))
    base = F.when(dots > 0, F.array_join(F.filter(F.array(up, dotted), lambda x: x != ""), "/")).otherwise(dotted)
    ends = lambda b: [F.concat(b, F.lit(e)) for e in (".py", "/__init__.py", ".pyi")]
    sub = F.concat_ws("/", base, "name")
    py = py.select("path", "target", "name", F.array(*(F.when(F.col("name").isNotNull(), c) for c in ends(sub)), *ends(base)).alias("names"))
    rs = i.where(F.col("path").endswith(".rs") & F.col("target").rlike(r"^(crate|self|super)::"))
    src = F.regexp_extract("path", r"^(.*?src)/", 1)
    inner = F.when(F.col("path").rlike(r"(^|/)(lib|main|mod)\.rs$"), folder).otherwise(F.regexp_replace("path", r"\.rs$", ""))
    root = F.when(F.col("target").startswith("crate::"), src).when(F.col("target").startswith("self::"), inner).otherwise(folder)
    rest = F.replace(F.regexp_replace("target", r"^(crate|self|super)::", ""), F.lit("::"), F.lit("/"))
    parent = F.regexp_replace(rest, r"/[^/]+$", "")
    rs_names = F.array(*(F.concat_ws("/", root, F.concat(b, F.lit(e))) for b in (rest, parent) for e in (".rs", "/mod.rs")))
    rs = rs.select("path", "target", F.lit(None).cast("string").alias("name"), rs_names.alias("names"))
    return js.unionByName(py).unionByName(rs).select("path", "target", "name", F.posexplode("names").alias("at", "candidate")).where("candidate IS NOT NULL")


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(path, target, name, to): the first candidate that exists; for Python else the only file whose path ends so."""
    known = files.select(F.col("path").alias("candidate"))
    c = _candidates(imports)
    exact = c.join(known, "candidate").groupBy("path", "target", "name").agg(F.min(F.struct("at", "candidate")).alias("m")).select("path", "target", "name", F.col("m.candidate").alias("to"))
    rest = c.where(F.col("path").rlike(r"\.pyi?$") & ~F.col("target").startswith(".")).join(exact.select("path", "target"), ["path", "target"], "left_anti")
    parts = F.split("candidate", "/")
    suffixes = known.select(F.col("candidate").alias("to"), F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))).alias("candidate"))
    suffix = rest.join(suffixes, "candidate").groupBy("path", "target", "name", "at").agg(F.min("to").alias("to"), F.countDistinct("to").alias("n")).where("n = 1")
    suffix = suffix.groupBy("path", "target", "name").agg(F.min(F.struct("at", "to")).alias("m")).select("path", "target", "name", F.col("m.to").alias("to"))
    return exact.unionByName(suffix).distinct()


def link(facts: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, diagnostics) of parsed facts. Any error diagnostic empties nodes and edges."""
    facts = written(facts, "facts")
    diagnostics = facts.where("fact = 'diagnostic'").select("path", F.col("kind").alias("severity"), "message")
    if not diagnostics.where("severity = 'error'").isEmpty():
        facts = facts.limit(0)
        files = files.limit(0)
    decl = facts.where("fact = 'declare'")
    attributes = F.to_json(F.struct("exported", F.col("is_test").alias("isTest")))
    nodes = decl.select("id", "kind", "path", "name", attributes.alias("attributes"))
    parsed = files.where(F.regexp_extract("path", r"\.([^.]+)$", 1).isin(*PARSERS))
    none = F.lit(None).cast("string")
    nodes = parsed.select(F.concat(F.lit("file:"), "path").alias("id"), F.lit("File").alias("kind"), "path", none.alias("name"), none.alias("attributes")).unionByName(nodes).dropDuplicates(["id"])
    contains = decl.select(F.lit("CONTAINS").alias("kind"), F.col("owner").alias("src"), F.col("id").alias("dst"))
    imports = facts.where("fact = 'import'")
    to = written(resolve_imports(imports, parsed), "imports")
    pair = to.select(F.explode(F.array(F.lit("IMPORTS_FROM"), F.lit("DEPENDS_ON"))).alias("kind"), F.concat(F.lit("file:"), "path").alias("src"), F.concat(F.lit("file:"), "to").alias("dst"))
    # Names that a file can use: its own, and those it imports from files that declare them.
    own = decl.select("path", F.col("name").alias("symbol"), "id", F.lit(0).alias("rank"))
    t = to.select(*(F.col(c).alias(f"t_{c}") for c in ("path", "target", "name")), "to").withColumn("t_any", F.col("t_name").isNull())
    same = (F.col("path") == F.col("t_path")) & (F.col("target") == F.col("t_target")) & (F.col("t_any") | F.col("name").eqNullSafe(F.col("t_name")))
    bound = imports.select("path", "target", "name", "local").join(t, same).select("path", "local", "name", "to")
    by_path = decl.select(F.col("path").alias("to"), F.col("name").alias("member"), "id")
    alias = bound.join(by_path, "to").where("local IS NOT NULL")
    named = alias.where("member = name OR (name = 'default' AND member = local)").select("path", F.col("local").alias("symbol"), "id", F.lit(1).alias("rank"))
    dotted = alias.select("path", F.concat_ws(".", "local", "member").alias("symbol"), "id", F.lit(1).alias("rank"))
    names = own.unionByName(named).unionByName(dotted).groupBy("path", "symbol").agg(F.min(F.struct("rank", "id")).alias("m")).select("path", "symbol", F.col("m.id").alias("dst"))
    named_here = names.select(F.col("path").alias("used_in"), F.col("symbol").alias("used_name"), "dst")
    used = facts.where("fact IN ('call', 'heritage')").join(named_here, (F.col("path") == F.col("used_in")) & (F.col("target") == F.col("used_name")))
    called = used.where("fact = 'call'")
    tests = decl.where("is_test").select(F.col("id").alias("owner"), F.lit(True).alias("in_test"))
    calls = called.select(F.lit("CALLS").alias("kind"), F.col("owner").alias("src"), "dst")
    tested = called.join(tests, "owner").select(F.lit("TESTED_BY").alias("kind"), F.col("dst").alias("src"), F.col("owner").alias("dst"))
    heritage = used.where("fact = 'heritage'").select("kind", F.col("owner").alias("src"), "dst")
    edges = contains.unionByName(pair).unionByName(calls).unionByName(tested).unionByName(heritage).where("src <> dst")
    edges = edges.select(edge_id(F.col("kind"), F.col("src"), F.col("dst")).alias("id"), "kind", "src", "dst").dropDuplicates(["id"])
    ids = nodes.select("id")
    for end in ("src", "dst"):
        edges = edges.join(ids.withColumnRenamed("id", end), end, "left_semi").select("id", "kind", "src", "dst")
    return nodes, edges, diagnostics


def reexport_closure(exports: DataFrame, most: int) -> DataFrame:
    """(path, name, id): what each file exports, with re-exports followed to a fixed point, in at most `most` rounds.

    exports: path, name, id (null for a re-export), from_path, from_name.
    """
    have = written(exports.where("id IS NOT NULL").select("path", "name", "id").distinct(), "exports")
    links = exports.where("id IS NULL").select("path", "name", "from_path", "from_name")
    for _ in range(most):
        h = have.select(F.col("path").alias("from_path"), F.col("name").alias("from_name"), "id")
        new = links.join(h, ["from_path", "from_name"]).select("path", "name", "id").join(have, ["path", "name", "id"], "left_anti").distinct()
        new = written(new, "exports")
        if new.isEmpty():
            break
        have = have.unionByName(new)
    return have


def python_import_pairs(files: DataFrame) -> DataFrame:
    """(from_path, to_path) of supplied Python files, sorted."""
    facts = parse(files).where("fact = 'import'")
    return resolve_imports(facts, files).select(F.col("path").alias("from_path"), F.col("to").alias("to_path")).distinct().orderBy("from_path", "to_path")


def snapshot_metadata(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: sorted distinct kinds of nodes and edges."""
    n = nodes.agg(F.array_sort(F.collect_set("kind")).alias("node_kinds"))
    return n.join(F.broadcast(edges.agg(F.array_sort(F.collect_set("kind")).alias("edge_kinds"))))
