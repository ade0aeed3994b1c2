"""Rule checks over facts and texts. Each returns diagnostics or the rows behind them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.paths import basename, first_segment, path_from_id, percent_match
from factloom.functions.text import json_flag, line_count, lines, paragraphs
from factloom.operators.select import broadcast_few
from factloom.operators.traverse import IMPORTS, reach


def unused_exports(nodes: DataFrame, edges: DataFrame, kinds: tuple[str, ...] = ("Function", "Class"), reachable: DataFrame | None = None) -> DataFrame:
    """(id): exported symbols without a CALLS edge in, and not among `reachable` (id), if given; tests are left out."""
    out = nodes.where(F.col("kind").isin(*kinds) & json_flag(F.col("attributes"), "exported") & ~json_flag(F.col("attributes"), "isTest"))
    out = out.join(edges.where("kind = 'CALLS'").select(F.col("dst").alias("id")), "id", "left_anti")
    return (out if reachable is None else out.join(reachable, "id", "left_anti")).select("id")


def unused_types(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id): exported types that nothing inherits or implements and whose file nothing imports."""
    out = nodes.where((F.col("kind") == "Type") & json_flag(F.col("attributes"), "exported"))
    out = out.join(edges.where("kind IN ('INHERITS', 'IMPLEMENTS')").select(F.col("dst").alias("id")), "id", "left_anti")
    imported = edges.where("kind = 'IMPORTS_FROM'").select(path_from_id(F.col("dst")).alias("path")).distinct()
    return out.join(imported, "path", "left_anti").select("id")


def unused_files(nodes: DataFrame, edges: DataFrame, entry_files: DataFrame) -> DataFrame:
    """(id): files that contain something, are never imported and aren't reached from the entry files."""
    out = nodes.where("kind = 'File'").join(edges.where("kind = 'CONTAINS'").select(F.col("src").alias("id")).distinct(), "id", "left_semi")
    out = out.join(edges.where("kind = 'IMPORTS_FROM'").select(F.col("dst").alias("id")), "id", "left_anti")
    return out.join(reach(nodes, edges, entry_files, ("IMPORTS_FROM",), True, None).select("id"), "id", "left_anti").select("id")


def untested_surface(nodes: DataFrame, edges: DataFrame, kinds: tuple[str, ...] = ("Function", "Method", "Macro")) -> DataFrame:
    """(id): exported symbols without a TESTED_BY edge."""
    out = nodes.where(F.col("kind").isin(*kinds) & json_flag(F.col("attributes"), "exported"))
    return out.join(edges.where("kind = 'TESTED_BY'").select(F.col("src").alias("id")), "id", "left_anti").select("id")


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id): files that no import edge touches."""
    touched = edges.where(F.col("kind").isin(*IMPORTS)).select(F.explode(F.array("src", "dst")).alias("id"))
    return nodes.where("kind = 'File'").join(touched, "id", "left_anti").select("id")


def missing_edges(expected: DataFrame, edges: DataFrame, kind: str = "IMPORTS_FROM") -> DataFrame:
    """(src, dst) that should have an edge and don't."""
    return expected.select("src", "dst").distinct().join(edges.where(F.col("kind") == kind).select("src", "dst"), ["src", "dst"], "left_anti")


def layer_violations(edges: DataFrame, rules: DataFrame) -> DataFrame:
    """(name, src, dst): imports that a rule (name, from_pat, to_pat, from_not) forbids. Rules are policy: broadcast if few."""
    imports = edges.where("kind = 'IMPORTS_FROM'").select("src", "dst", path_from_id(F.col("src")).alias("f"), path_from_id(F.col("dst")).alias("t"))
    hit = percent_match(F.col("f"), F.col("from_pat")) & percent_match(F.col("t"), F.col("to_pat"))
    spared = F.exists("from_not", lambda p: percent_match(F.col("f"), p))
    return imports.join(broadcast_few(rules, 1000), hit & ~spared).select("name", "src", "dst")


def relevant_tests(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(path, tested): for each file whether a TESTED_BY edge touches it at either end."""
    t = edges.where("kind = 'TESTED_BY'").select(F.explode(F.array("src", "dst")).alias("id")).select(path_from_id(F.col("id")).alias("path")).distinct()
    files = nodes.where("kind = 'File'").select("path").distinct()
    return files.join(t.withColumn("tested", F.lit(True)), "path", "left").select("path", F.coalesce("tested", F.lit(False)).alias("tested"))


def long_files(files: DataFrame, most: int = 300) -> DataFrame:
    return files.select("path", line_count(F.col("content")).alias("lines")).where(F.col("lines") > most)


#: Patterns of suppressions in Python source, by code: fixed values.
PYTHON_HYGIENE = {
    "PY_SOURCE_TYPE_IGNORE": r"(?i)#\s*type:\s*ignore(?:\b|\[)",
    "PY_SOURCE_NOQA_BROAD": r"(?i)#\s*(?:ruff:\s*)?noqa(?:\s*$|(?::\s*$))",
    "PY_SOURCE_FORMATTER_DISABLED": r"(?i)#\s*(?:fmt:\s*off|yapf:\s*disable|autopep8:\s*off)\b",
    "PY_SOURCE_PYLINT_DISABLE_ALL": r"(?i)#\s*pylint:\s*disable\s*=\s*(?:all|.*\ball\b)",
}


def line_hits(files: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """(path, line, code): lines, from 1, that match a pattern."""
    rows = files.select("path", F.posexplode(lines(F.col("content"))).alias("at", "text"))
    codes = F.filter(F.array(*(F.when(F.col("text").rlike(p), F.lit(c)) for c, p in patterns.items())), lambda x: x.isNotNull())
    return rows.select("path", (F.col("at") + 1).cast("long").alias("line"), F.explode(codes).alias("code"))


#: Documentation rules: fixed patterns.
CONTENT_QUALITY = {"DOCS_CONTENT_PLACEHOLDER": r"(?i)\b(TODO|TBD|FIXME|placeholder|lorem ipsum)\b", "DOCS_CONTENT_CONFLICT_MARKER": r"^(<{7}|={7}|>{7})"}
HEADING = r"^\s*#{1,6}\s+"


def docs_existence(roots: DataFrame, files: DataFrame, names: list[str]) -> DataFrame:
    """(root): required roots (root) without a context document of one of the names right in them."""
    have = files.where(basename(F.col("path")).isin(names)).select(F.regexp_replace("path", r"/?[^/]+$", "").alias("root")).distinct()
    return roots.select("root").distinct().join(have, "root", "left_anti")


def docs_length(files: DataFrame, *, least_chars: int, most_lines: int, most_section: int, heading: str = HEADING) -> DataFrame:
    """(path, code, amount): too short, too long, or with a section too long. A section starts at a heading."""
    size = files.select("path", "content", F.length(F.trim(F.regexp_replace("content", r"^\s+|\s+$", ""))).cast("long").alias("chars"), line_count(F.col("content")).alias("n_lines"))
    rows = files.select("path", F.posexplode(lines(F.regexp_replace("content", r"\r?\n\z", ""))).alias("at", "text"))
    island = rows.withColumn("section", F.sum(F.col("text").rlike(heading).cast("int")).over(Window.partitionBy("path").orderBy("at")))
    longest = island.groupBy("path", "section").count().groupBy("path").agg(F.max("count").alias("amount"))
    a = size.where(F.col("chars") < least_chars).select("path", F.lit("DOCS_TOO_SHORT").alias("code"), F.col("chars").alias("amount"))
    b = size.where(F.col("n_lines") > most_lines).select("path", F.lit("DOCS_TOO_LONG").alias("code"), F.col("n_lines").alias("amount"))
    c = longest.where(F.col("amount") > most_section).select("path", F.lit("DOCS_SECTION_TOO_LONG").alias("code"), "amount")
    return a.unionByName(b).unionByName(c)


def docs_dry(files: DataFrame) -> DataFrame:
    """(path, first_path): per document its first paragraph that an earlier document, by path, has already."""
    rows = files.select("path", F.posexplode(paragraphs(F.col("content"))).alias("at", "text"))
    first = rows.groupBy("text").agg(F.min(F.struct("path", "at")).alias("first"))
    again = rows.join(first, "text").where("path > first.path")
    return again.groupBy("path").agg(F.min(F.struct("at", "first.path")).alias("hit")).select("path", F.col("hit.path").alias("first_path"))


def open_fences(files: DataFrame, fence: str = "```") -> DataFrame:
    """(path, line): the line, from 1, of a code fence that is never closed."""
    rows = files.where(F.col("path").rlike(r"(?i)\.(md|mdx|markdown)$")).select("path", F.posexplode(lines(F.col("content"))).alias("at", "text"))
    marks = rows.where(F.ltrim("text").startswith(fence)).groupBy("path").agg(F.count("*").alias("n"), F.max("at").alias("last"))
    return marks.where("n % 2 = 1").select("path", (F.col("last") + 1).cast("long").alias("line"))


def rules_without_why(files: DataFrame, rule: str = r"^(?:[-*]\s*)?(ALWAYS|NEVER|MUST|SHOULD)\b") -> DataFrame:
    """(path, line): rule lines that give no reason."""
    rows = files.select("path", F.posexplode(lines(F.col("content"))).alias("at", "raw")).withColumn("text", F.trim("raw"))
    bare = F.col("text").rlike(rule) & ~F.col("text").rlike(r"\bWHY:") & ~F.col("text").rlike(r"(?i)\bbecause\b")
    return rows.where(bare).select("path", (F.col("at") + 1).cast("long").alias("line"))


def hubs(edges: DataFrame, least_in: int, least_out: int) -> DataFrame:
    """(path, fan_in, fan_out): files by counts of import edges, not of distinct ends."""
    e = edges.where("kind = 'IMPORTS_FROM'").select(path_from_id(F.col("src")).alias("s"), path_from_id(F.col("dst")).alias("t"))
    ends = e.select(F.col("t").alias("path"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionByName(e.select(F.col("s").alias("path"), F.lit(0).alias("i"), F.lit(1).alias("o")))
    both = ends.groupBy("path").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))
    return both.where((F.col("fan_in") >= least_in) | (F.col("fan_out") >= least_out))


def unmentioned(names: DataFrame, docs: DataFrame, word: str = r"[A-Za-z0-9_./-]+") -> DataFrame:
    """Names (path) that no document mentions, by the whole path or its basename, as words of the text: an equi join."""
    said = docs.select(F.explode(F.regexp_extract_all("content", F.lit(word), 0)).alias("said")).select(F.rtrim(F.col("said"), F.lit(".")).alias("said")).distinct()
    out = names.join(said, F.col("path") == F.col("said"), "left_anti")
    return out.withColumn("__base", basename(F.col("path"))).join(said, F.col("__base") == F.col("said"), "left_anti").drop("__base")


def subtrees(files: DataFrame, least: int = 10_000) -> DataFrame:
    """(subtree, loc): lines below each first path segment, if many."""
    return files.groupBy(first_segment(F.col("path")).alias("subtree")).agg(F.sum(line_count(F.col("content"))).alias("loc")).where(F.col("loc") >= least)


def stale_references(files: DataFrame, known: DataFrame, pattern: str) -> DataFrame:
    """(path, ref): what the pattern's first group finds in a text and no known path (path) has."""
    refs = files.select("path", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(pattern), 1))).alias("ref"))
    return refs.join(known.select(F.col("path").alias("ref")), "ref", "left_anti").select("path", "ref")


def stale_by_age(history: DataFrame, now: str, most_days: int = 90) -> DataFrame:
    """(path, days) of documents whose last commit (path, committed_at) is too old."""
    last = history.groupBy("path").agg(F.max("committed_at").alias("last"))
    days = (F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("last")) / 86400
    return last.select("path", days.alias("days")).where(F.col("days") > most_days)


def newer_source(docs: DataFrame, sources: DataFrame) -> DataFrame:
    """Roots (root, path, committed_at) whose newest document is older than their newest source; ties keep the lowest path."""
    last = lambda df, name: df.groupBy("root").agg(F.max("committed_at").alias(name))
    both = last(docs, "doc_at").join(last(sources, "source_at"), "root").where("doc_at < source_at")
    newest = sources.join(both, "root").where("committed_at = source_at").groupBy("root").agg(F.min("path").alias("path"))
    return both.join(newest, "root")


def dead_rust_files(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id): Rust files that nothing imports and that are no crate root or test."""
    roots = r"(^|/)(lib|main|mod|build)\.rs$|(^|/)tests/"
    return orphans(nodes.where(F.col("path").endswith(".rs") & ~F.col("path").rlike(roots)), edges)


#: Lints that may not be switched off as a whole, and source composition in Rust: fixed values.
RUST_BROAD_LINTS = ("warnings", "clippy::all", "clippy::restriction")
RUST_HYGIENE = {"RUST_SOURCE_INCLUDE_MACRO": r"\binclude!\s*\(", "RUST_SOURCE_RUSTFMT_SKIP": r"#\s*\[\s*rustfmt::skip\s*\]"}


def rust_hygiene(files: DataFrame, lints: tuple[str, ...] = RUST_BROAD_LINTS) -> DataFrame:
    """(path, code, hits): `.inc` sources, include macros, rustfmt skips, and broad lints allowed in attributes."""
    f = files.select("path", "content")
    named = [f.select("path", F.lit(code).alias("code"), F.size(F.regexp_extract_all("content", F.lit(p), 0)).cast("long").alias("hits")) for code, p in RUST_HYGIENE.items()]
    inc = f.where(F.col("path").endswith(".inc")).select("path", F.lit("RUST_SOURCE_INC_FILE").alias("code"), F.lit(1).cast("long").alias("hits"))
    attributes = f.select("path", F.explode(F.regexp_extract_all("content", F.lit(r"#\s*!?\s*\[[^\]]*\]"), 0)).alias("attribute"))
    listed = attributes.select("path", F.explode(F.regexp_extract_all("attribute", F.lit(r"\b(?:allow|expect)\s*\(([^)]*)\)"), 1)).alias("listed"))
    broad = listed.select("path", F.explode(F.transform(F.split("listed", ","), F.trim)).alias("lint")).where(F.col("lint").isin(*lints))
    allowed = broad.groupBy("path").agg(F.count("*").alias("hits")).select("path", F.lit("RUST_SOURCE_LINT_SUPPRESSION").alias("code"), "hits")
    out = named[0].unionByName(named[1]).unionByName(inc).unionByName(allowed)
    return out.where("hits > 0")


def function_metrics(metrics: DataFrame, *, most_lines: int = 80, most_complexity: int = 10, most_params: int = 4) -> DataFrame:
    """(path, name, code, amount) of functions (path, name, lines, complexity, params) above a threshold."""
    limits = {"FUNCTION_LINES": ("lines", most_lines), "FUNCTION_COMPLEXITY": ("complexity", most_complexity), "FUNCTION_PARAMS": ("params", most_params)}
    hits = F.array(*(F.when(F.col(c) > most, F.struct(F.lit(code).alias("code"), F.col(c).cast("long").alias("amount"))) for code, (c, most) in limits.items()))
    return metrics.select("path", "name", F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("h")).select("path", "name", "h.code", "h.amount")
