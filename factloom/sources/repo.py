"""A repository's files as a table: scan, languages, ignore rules, guards and hashes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.paths import extension, glob_regex, within

#: Extensions by language, and source extensions without an extractor: fixed values.
LANGUAGES = {"ts": "typescript", "mts": "typescript", "cts": "typescript", "tsx": "tsx", "js": "javascript", "jsx": "jsx", "py": "python", "pyi": "python", "rs": "rust"}
UNSUPPORTED = ("mjs", "cjs", "vue", "svelte", "go", "java", "rb", "php", "swift", "kt", "kts", "scala", "lua", "cs", "c", "cc", "cpp", "h", "hpp")
#: Folders that are never read, at any depth: fixed values.
IGNORED = (
    ".git", "node_modules", ".pnpm", "vendor", "dist", "target", ".agents", ".venv", "venv", "env", "__pycache__", ".eggs", "build",
    ".tox", ".mypy_cache", ".pytest_cache", ".ruff_cache", "site-packages", "*.egg-info", "*.dist-info",
)
MAX_DEPTH = 64


def scan(spark: SparkSession, root: str, suffixes: str = "*", ignore: list[str] = (), max_depth: int = MAX_DEPTH) -> DataFrame:
    """(path, content, sha256): files below a root that Spark can read, by path relative to it.

    Ignored and too deep files are left out by their names, so their bytes are never read; Spark lists names on the driver anyway.
    """
    source = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    base = root.rstrip("/").rsplit(":", 1)[-1].lstrip("/")
    relative = F.regexp_replace(F.col("path"), r"^[a-z0-9+.-]+:/*" + re.escape(base) + "/", "")
    listed = source.option("pathGlobFilter", suffixes).load(root).select("path", relative.alias("relative"))
    kept = listed.where(~is_ignored(F.col("relative"), ignore_rules(ignore)) & (F.size(F.split("relative", "/")) <= max_depth))
    paths = [re.sub(r"([\\\[\]{}*?])", r"\\\1", r["path"]) for r in kept.select("path").collect()]
    if not paths:
        return spark.createDataFrame([], "path string, content string, sha256 string")
    df = spark.read.format("binaryFile").load(paths)
    return df.select(relative.alias("path"), F.decode("content", "UTF-8").alias("content"), F.sha2("content", 256).alias("sha256"))


def language(path: Column) -> Column:
    ext = extension(path)
    return F.coalesce(*(F.when(ext == e, F.lit(n)) for e, n in LANGUAGES.items()))


def unsupported(files: DataFrame) -> DataFrame:
    """(path, ext): source files of languages without an extractor."""
    ext = extension(F.col("path"))
    return files.select("path", ext.alias("ext")).where(F.col("ext").isin(*UNSUPPORTED))


def ignore_rules(lines: list[str] = ()) -> list[tuple[str, bool]]:
    """(pattern, negated) in order: built-in folders, then lines of ignore files."""
    rules = [(f"**/{d}/**", False) for d in IGNORED]
    for raw in lines:
        line = raw.strip()
        if not line or line.startswith("#"):
            continue
        negated, line = line.startswith("!"), line.lstrip("!")
        rooted, line = line.startswith("/") or "/" in line.rstrip("/"), line.strip("/") if line.startswith("/") else line
        folder, line = line.endswith("/"), line.rstrip("/")
        start = line if rooted or line.startswith("**/") else f"**/{line}"
        rules.append((f"{start}/**", negated))
        if not folder:
            rules.append((start, negated))
    return rules


def is_ignored(path: Column, rules: list[tuple[str, bool]]) -> Column:
    """The last rule that matches decides; no rule keeps the file."""
    verdict = F.lit(False)
    for pattern, negated in rules:
        verdict = F.when(path.rlike(glob_regex(pattern)), F.lit(not negated)).otherwise(verdict)
    return verdict


def guarded(files: DataFrame, max_depth: int = MAX_DEPTH, max_files: int | None = None) -> DataFrame:
    """Files not too deep, and with a limit the first ones by path."""
    out = files.where(F.size(F.split("path", "/")) <= max_depth)
    return out if max_files is None else out.orderBy("path").limit(max_files)


def watched(files: DataFrame, roots: list[str]) -> DataFrame:
    """Files at or below one of the roots; no roots: all."""
    if not roots:
        return files
    hit = F.lit(False)
    for r in roots:
        hit = hit | within(F.col("path"), F.lit(r))
    return files.where(hit)


def census(files: DataFrame, skipped: tuple[str, ...] = IGNORED) -> DataFrame:
    """Files none of whose folders is a skipped one."""
    plain = [s for s in skipped if "*" not in s]
    return files.where(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, plain))))
