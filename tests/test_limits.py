"""Nothing is cut silently; writers, scans and deep files."""

import pytest

from factloom.functions.paths import edge_id
from factloom.operators import checks, extract, impact, metrics, store
from factloom.plans import durable
from factloom.sources import repo


def test_all_rules_and_budgets_take_part(spark):
    edges = spark.createDataFrame([("IMPORTS_FROM", f"file:a/{i}", "file:b/x") for i in range(1001)], "kind string, src string, dst string")
    edges = edges.select(edge_id(edges["kind"], edges["src"], edges["dst"]).alias("id"), "*")
    rules = spark.createDataFrame([(f"r{i}", f"a/{i}", "b/%", []) for i in range(1001)], "name string, from_pat string, to_pat string, from_not array<string>")
    assert checks.layer_violations(edges, rules).count() == 1001
    records = spark.createDataFrame([(i, f"c{i}", "warm", "small", i, float(i)) for i in range(201)], "record_id long, command string, state string, bucket string, recorded_at long, duration_ms double")
    budgets = spark.createDataFrame([(f"c{i}", "warm", "small", 100.0, None) for i in range(201)], "command string, scope string, bucket string, budget_ms double, phase_budgets array<struct<phase:string,budget_ms:double>>")
    assert metrics.latency_observations(records, budgets).where("budget_ms IS NOT NULL").count() == 201


def test_one_writer_makes_a_snapshot(spark, tmp_path):
    s = store.FactStore(spark, str(tmp_path / "store"))
    s._point({"sequence": 1, "snapshot": "a", "metadata": "{}"})
    with pytest.raises(store.StoreError, match="another writer"):
        s._point({"sequence": 1, "snapshot": "b", "metadata": "{}"})
    assert s.current()[1] == "a"


def test_ignored_files_are_not_scanned(spark, tmp_path):
    for name in ("src/a.py", "node_modules/b.py", ".git/c.py", "d/e/f/g.py", "x[1].py"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("x = 1\n")
    assert {r["path"] for r in repo.scan(spark, str(tmp_path), "*.py", max_depth=3).collect()} == {"src/a.py", "x[1].py"}
    assert repo.scan(spark, str(tmp_path), "*.none").count() == 0


def test_a_file_nested_too_deeply_is_a_diagnostic():
    rows = extract.parse_python("deep.py", "x = " + "-" * 200_000 + "1\n")
    assert [r["fact"] for r in rows] == ["diagnostic"]


def test_limited_impact(spark):
    """The base graph: a file with a symbol and its test, and a chain of importers."""
    nodes = spark.createDataFrame([(i, k, None, None, None) if k != "File" else (i, k, i[5:], None, None) for i, k in (("file:src/card.ts", "File"), ("file:src/models.ts", "File"), ("file:tests/card.ts", "File"), ("function:src/models.ts#f", "Function"), ("test:tests/card.ts#t", "Test"))], "id string, kind string, path string, name string, attributes string")
    edges = [("CONTAINS", "file:src/models.ts", "function:src/models.ts#f"), ("DEPENDS_ON", "file:src/card.ts", "file:src/models.ts"), ("DEPENDS_ON", "file:tests/card.ts", "file:src/card.ts"), ("TESTED_BY", "function:src/models.ts#f", "test:tests/card.ts#t")]
    edges = spark.createDataFrame([(f"edge:{k}:{a}->{b}", k, a, b) for k, a, b in edges], "id string, kind string, src string, dst string")
    paths = spark.createDataFrame([("src/models.ts", 0)], "path string, pos int")
    order = ["file:src/models.ts", "file:src/card.ts", "file:tests/card.ts", "function:src/models.ts#f", "test:tests/card.ts#t"]
    for limit in (1, 2, 3, 4, 5, 6):
        found, truncated = impact.impact_limited(nodes, edges, paths, 3, limit)
        assert {r["id"] for r in found.collect()} == set(order[:limit]) and truncated == (limit < 5)


def test_durable_needs_a_shared_folder_off_local_mode(spark, monkeypatch):
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="checkpoint.dir"):
        durable.shared_dir(Session())
    df = durable.written(spark.range(3).toDF("x"), "kept")
    assert df.count() == 3 and durable._made
    made = list(durable._made)
    durable.delete(spark, durable._made.pop())
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(made[-1])


def test_differences_count_rows_of_both_sides(spark):
    a = spark.createDataFrame([("a", None), ("a", None), ("b", "1"), ("c", "2")], "x string, y string")
    b = spark.createDataFrame([("1", "b"), (None, "a"), ("3", "c"), ("4", "d")], "y string, x string")
    assert store.differences(a, a) == store.differences(a.limit(0), a.limit(0)) == 0
    assert store.differences(a, b) == store.differences(b, a) == a.exceptAll(b.select("x", "y")).count() + b.select("x", "y").exceptAll(a).count() == 4
    assert store.differences(a, a.limit(0)) == 4


def test_the_same_tables_are_not_shuffled_whole(spark, monkeypatch):
    def refuse(*_):
        raise AssertionError("rows of equal tables were compared one by one")

    monkeypatch.setattr(type(spark.range(1)), "exceptAll", refuse)
    a = spark.range(100).selectExpr("cast(id AS string) AS x", "cast(id % 7 AS string) AS y")
    assert store.differences(a, a.repartition(3)) == 0


@pytest.mark.parametrize("few", [0, 100_000])
def test_dangling_edges_by_either_end(spark, monkeypatch, few):
    monkeypatch.setattr(store, "FEW_MISSING", few)
    nodes = spark.createDataFrame([("a",), ("b",), ("b",)], "id string")
    edges = spark.createDataFrame([("1", "a", "b"), ("2", "a", "x"), ("3", "x", "b"), ("4", "x", "y"), ("4", "x", "y")], "id string, src string, dst string")
    assert sorted(r["id"] for r in store.dangling(nodes, edges).collect()) == ["2", "3", "4"]


def test_an_increment_writes_only_a_layer(spark, tmp_path):
    """Edges that lose an end go, of edges with one id the kept one stays, and what isn't touched isn't written again."""
    s = store.FactStore(spark, str(tmp_path / "store"))
    node = lambda *ids: spark.createDataFrame([(i, "File" if i.startswith("file") else "Function", i.split(":")[1].split("#")[0], None, None) for i in ids], store.TABLES["nodes"])
    edge = lambda *rows: spark.createDataFrame([(i or f"edge:{k}:{a}->{b}", k, a, b) for i, k, a, b in rows], store.TABLES["edges"])
    hashes = lambda *rows: spark.createDataFrame(list(rows), store.TABLES["file_hashes"])
    rows = lambda t: sorted(map(tuple, s.read(t).collect()), key=str)
    first = edge((None, "CALLS", "function:a#f", "function:b#g"), ("own", "CALLS", "function:b#g", "function:a#f"), (None, "X", "file:a", "file:b"))
    s.replace({"nodes": [node("file:a", "function:a#f"), node("file:b", "function:b#g")], "edges": first, "file_hashes": hashes(("a", "1"), ("b", "2"))})
    assert rows("edges") == sorted(map(tuple, first.collect()), key=str)
    fresh = edge(("own", "CALLS", "file:b", "file:a"), (None, "X", "file:b", "file:a"), (None, "X", "file:b", "file:a"), (None, "X", "file:b", "file:none"))
    snapshot = s.update(node("file:b"), fresh, hashes(("b", "3")), spark.createDataFrame([("b",)], "path string"))
    assert rows("nodes") == sorted(map(tuple, node("file:a", "file:b", "function:a#f").collect()), key=str)
    assert rows("edges") == sorted(map(tuple, edge((None, "X", "file:a", "file:b"), (None, "X", "file:b", "file:a"), ("own", "CALLS", "file:b", "file:a")).collect()), key=str)
    assert rows("file_hashes") == [("a", "1"), ("b", "3")]
    assert spark.read.parquet(f"{s.root}/snapshots/{snapshot}/nodes").count() == 1
    assert store.differences(s.read("nodes"), [node("file:a"), node("file:b", "function:a#f")]) == 0
    # A kept edge has the same id as a new one, and a second layer.
    s.update(node("file:b"), edge(("edge:X:file:a->file:b", "X", "file:b", "file:b")), hashes(), spark.createDataFrame([("b",)], "path string"))
    assert rows("edges") == [("edge:X:file:a->file:b", "X", "file:a", "file:b")] and rows("file_hashes") == [("a", "1")]
    s.update(node(), edge(), hashes(), spark.createDataFrame([("b",)], "path string"))
    assert rows("edges") == [] and s.metadata("edge_kinds") == [] and s.metadata("node_kinds") == ["File", "Function"]
