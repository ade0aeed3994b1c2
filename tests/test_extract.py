"""Extraction, linking, ignore rules and the store."""

import pytest

from factloom.operators import extract, store
from factloom.sources import repo

FILES = [
    ("pkg/__init__.py", ""), ("pkg/a.py", "from pkg.b import helper\nfrom . import b\n\nclass Base:\n    pass\n\ndef run(x):\n    return helper(x)\n"), ("pkg/b.py", "def helper(x):\n    return len(x)\n"),
    ("tests/test_a.py", "from pkg.a import run\n\ndef test_run():\n    run(1)\n"),
    ("src/main.ts", "import { add } from './util';\nexport function go() { return add(1, 2); }\n"), ("src/util.ts", "export function add(a: number, b: number) { return a + b; }\n"),
]


def test_python_and_typescript_link(spark):
    files = spark.createDataFrame(FILES, "path string, content string")
    nodes, edges, diagnostics = extract.link(extract.parse(files), files)
    triples = {(r["kind"], r["src"], r["dst"]) for r in edges.collect()}
    assert diagnostics.count() == 0
    for want in (
        ("IMPORTS_FROM", "file:pkg/a.py", "file:pkg/b.py"), ("DEPENDS_ON", "file:tests/test_a.py", "file:pkg/a.py"), ("CALLS", "function:pkg/a.py#run", "function:pkg/b.py#helper"),
        ("TESTED_BY", "function:pkg/a.py#run", "function:tests/test_a.py#test_run"), ("IMPORTS_FROM", "file:src/main.ts", "file:src/util.ts"), ("CALLS", "function:src/main.ts#go", "function:src/util.ts#add"),
    ):
        assert want in triples, want
    assert store.dangling(nodes, edges).count() == 0


def test_an_error_empties_the_facts(spark):
    files = spark.createDataFrame([("a.py", "def broken(:\n"), ("b.py", "x = 1\n")], "path string, content string")
    nodes, edges, diagnostics = extract.link(extract.parse(files), files)
    assert (nodes.count(), edges.count(), diagnostics.count()) == (0, 0, 1)


def test_ignore_last_match_wins(spark):
    rules = repo.ignore_rules(["*.log", "!keep.log", "/out/"])
    df = spark.createDataFrame([(p,) for p in ("a/x.log", "a/keep.log", "out/y", "in/out/y", "node_modules/z.js")], "path string")
    got = {r["path"]: r["i"] for r in df.select("path", repo.is_ignored(df["path"], rules).alias("i")).collect()}
    assert got == {"a/x.log": True, "a/keep.log": False, "out/y": True, "in/out/y": False, "node_modules/z.js": True}


def test_store_replaces_whole_and_checks_ends(spark, tmp_path):
    s = store.FactStore(spark, str(tmp_path / "store"))
    nodes = spark.createDataFrame([("file:a", "File", "a", None, None), ("file:b", "File", "b", None, None)], store.TABLES["nodes"])
    edges = spark.createDataFrame([("e", "IMPORTS_FROM", "file:a", "file:b")], store.TABLES["edges"])
    hashes = spark.createDataFrame([("a", "1"), ("b", "2")], store.TABLES["file_hashes"])
    with pytest.raises(store.StoreError):
        s.read("nodes")
    s.replace({"nodes": nodes, "edges": edges, "file_hashes": hashes})
    with pytest.raises(store.StoreError):
        s.replace({"nodes": nodes.where("id = 'file:a'"), "edges": edges, "file_hashes": hashes})
    assert s.read("edges").count() == 1 and s.metadata("node_kinds") == ["File"]
    touched = spark.createDataFrame([("b",)], "path string")
    s.update(nodes.limit(0), edges.limit(0), hashes.limit(0), touched)
    assert (s.read("nodes").count(), s.read("edges").count()) == (1, 0)
