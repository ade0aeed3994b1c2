"""Traversals against a literal queue, and the fixed small graphs."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from factloom.operators import impact, select, traverse

NODES = "id string, kind string, path string, name string, attributes string"
EDGES = "id string, kind string, src string, dst string"


def graph(spark, nodes, edges):
    n = spark.createDataFrame([(i, k, i.split(":", 1)[1].split("#")[0], None, None) for i, k in nodes], NODES)
    e = spark.createDataFrame([(f"edge:{k}:{a}->{b}", k, a, b) for k, a, b in edges], EDGES)
    return n, e


BASE_NODES = [("file:src/card.ts", "File"), ("file:src/models.ts", "File"), ("file:test/card.test.ts", "File"), ("function:src/card.ts#pay", "Function"), ("test:test/card.test.ts#pays", "Test")]
BASE_EDGES = [
    ("CONTAINS", "file:src/card.ts", "function:src/card.ts#pay"), ("DEPENDS_ON", "file:src/card.ts", "file:src/models.ts"), ("DEPENDS_ON", "file:test/card.test.ts", "file:src/card.ts"),
    ("TESTED_BY", "function:src/card.ts#pay", "test:test/card.test.ts#pays"), ("CALLS", "function:src/card.ts#pay", "function:missing#gone"),
]


def queue_search(nodes, edges, starts, depth, limit):
    known, order, seen, truncated = set(nodes), [], {}, False

    def admit(x, d):
        nonlocal truncated
        if x not in known:
            return False
        if x in seen:
            return True
        if len(seen) >= limit:
            truncated = True
            return False
        seen[x] = d
        order.append(x)
        return True

    queue = deque()
    for s in starts:
        if s not in seen and admit(s, 0):
            queue.append(s)
    while queue:
        x = queue.popleft()
        if seen[x] >= depth:
            continue
        for k, a, b in sorted(edges):
            if a == x and b not in seen and admit(b, seen[x] + 1):
                queue.append(b)
    return order, seen, truncated


@pytest.mark.parametrize("seed", range(4))
def test_limited_search_is_the_queue(spark, seed):
    rng = random.Random(seed)
    names = [f"file:n{i}" for i in range(14)]
    known = names[:12]
    edges = sorted({("CALLS", rng.choice(names), rng.choice(names)) for _ in range(40)})
    edges = [e for e in edges if e[1] != e[2]]
    n, e = graph(spark, [(x, "File") for x in known], edges)
    starts = rng.sample(known, 2)
    limit, depth = rng.randint(1, 12), rng.randint(0, 3)
    s = spark.createDataFrame([(x, i) for i, x in enumerate(starts)], "id string, pos int")
    found, truncated = traverse.reach_limited(n, e, s, ("CALLS",), True, depth, limit)
    rows = sorted(found.collect(), key=lambda r: r["pos"])
    order, seen, cut = queue_search(known, edges, starts, depth, limit)
    assert [r["id"] for r in rows] == order
    assert {r["id"]: r["depth"] for r in rows} == seen
    assert truncated == cut


def test_impact_of_one_file(spark):
    n, e = graph(spark, BASE_NODES, BASE_EDGES)
    found = impact.impact(n, e, spark.createDataFrame([("src/models.ts",)], "path string"))
    assert impact.impacted_files(found).count() == 3
    assert [r["id"] for r in impact.impacted_symbols(found).collect()] == ["function:src/card.ts#pay"]
    assert [r["path"] for r in impact.impacted_tests(found).collect()] == ["test/card.test.ts"]
    none = impact.impact(n, e, spark.createDataFrame([("new.ts",)], "path string"))
    assert none.count() == 0


def test_missing_nodes_never_come_back(spark):
    n, e = graph(spark, BASE_NODES, BASE_EDGES)
    start = n.where("kind = 'Function'").select("id")
    assert {r["id"] for r in traverse.reach(n, e, start, ("CALLS",), True, 3).collect()} == {"function:src/card.ts#pay"}
    assert "function:missing#gone" not in {r["dst"] for r in select.select_edges(n, e).collect()}


def test_unknown_target_is_empty(spark):
    n, e = graph(spark, BASE_NODES, BASE_EDGES)
    assert traverse.resolve_targets(n, e, "no/such.ts", True).count() == 0
    ids = [r["id"] for r in traverse.resolve_targets(n, e, "./src/card.ts", True).orderBy("pos").collect()]
    assert ids == ["file:src/card.ts", "function:src/card.ts#pay"]


def test_cycles_and_components(spark):
    n, e = graph(spark, [(f"file:{x}", "File") for x in "abcde"], [("IMPORTS_FROM", f"file:{a}", f"file:{b}") for a, b in ("ab", "bc", "ca", "de", "ed", "cd")])
    found = {r["id"]: r["component"] for r in traverse.strong_components(e).collect()}
    assert found == {"file:a": "file:a", "file:b": "file:a", "file:c": "file:a", "file:d": "file:d", "file:e": "file:d"}
    assert traverse.cycles_of({"a": ["b"], "b": ["c"], "c": ["a"], "d": ["e"], "e": ["d"]}) == [["a", "b", "c"], ["d", "e"]]


def test_selector_limits_and_edge_ids(spark):
    n, e = graph(spark, BASE_NODES, BASE_EDGES)
    one = "edge:DEPENDS_ON:file:src/card.ts->file:src/models.ts"
    assert select.select_edges(n, e, ids=[one]).count() == 1
    assert select.select_edges(n, e, ids=[one], neighbors=True).count() == 0
    assert select.select_nodes(n, limit=2).count() == 2
    with pytest.raises(ValueError):
        select.select_nodes(n, limit=0)


def test_renames(spark):
    stored = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "2"), ("d", "3")], "path string, sha256 string")
    now = spark.createDataFrame([("x", "1"), ("y", "1"), ("c", "9")], "path string, sha256 string")
    rows = {(r["path"], r["status"], r["old_path"]) for r in impact.detect_changes(stored, now).collect()}
    assert rows == {("x", "changed", None), ("y", "changed", None), ("c", "changed", None), ("y", "renamed", "a"), ("y", "renamed", "b"), ("d", "deleted", None)}


def test_cycles_of_large_and_dense_components(spark):
    import random

    rng = random.Random(1)
    dense = {(f"n{rng.randrange(40):02}", f"n{rng.randrange(40):02}") for _ in range(300)}
    ring = {(f"r{i:06}", f"r{(i + 1) % 110_000:06}") for i in range(110_000)}  # above 100,000 edges
    edges = spark.createDataFrame(sorted((a, b) for a, b in dense | ring if a != b), "src string, dst string")
    near: dict[str, list[str]] = {}
    for a, b in sorted(dense):
        if a != b:
            near.setdefault(a, []).append(b)
    parts = traverse.strong_components(edges.where("src < 'r'"))
    members = {r["id"]: r["component"] for r in parts.collect()}
    inside = {a: [b for b in bs if members.get(b) == members[a]] for a, bs in near.items() if a in members}
    expected = sorted(" -> ".join([*c, c[0]]) for c in traverse.cycles_of(inside))
    both = parts.unionByName(edges.where("src >= 'r'").selectExpr("src AS id", "'r000000' AS component"))
    found = sorted(r["cycle"] for r in traverse.component_cycles(edges, both).where("component < 'r'").collect())
    assert found == expected and len(expected) > 20
    large = traverse.component_cycles(edges, both).where("component = 'r000000'").collect()
    assert [(r["cycle"][:18], r["cycle"].count(" -> ")) for r in large] == [("r000000 -> r000001", 110_000)]


def test_levels_beyond_what_is_broadcast(spark, monkeypatch):
    n, e = graph(spark, BASE_NODES, BASE_EDGES)
    n = n.unionByName(n)  # repeated nodes
    start = n.where("kind = 'File'").select("id")
    few = sorted(map(tuple, traverse.reach(n, e, start, None, True, None).collect()))
    monkeypatch.setattr(traverse, "FEW_IDS", 0)
    assert sorted(map(tuple, traverse.reach(n, e, start, None, True, None).collect())) == few
    assert len({x for x, _ in few}) == len(few) > 0
    assert traverse.reach(n, e, start.limit(0), None, True, None).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_cycles_of_one_component_are_many_tasks_work(spark, monkeypatch, seed):
    monkeypatch.setattr(traverse, "BLOCK_BYTES", 300)
    rng = random.Random(seed)
    near = {f"é{i}" if i % 3 else f"n{i:02}": set() for i in range(40)}
    names = list(near)
    for i, x in enumerate(names):
        near[x] = {names[(i + 1) % 40], *rng.sample(names, 3)} - {x}
    edges = spark.createDataFrame([(a, b) for a in near for b in near[a]], "src string, dst string")
    own = spark.createDataFrame([(x, "c") for x in near], "id string, component string")
    found = traverse.component_cycles(edges, own).select("component", "cycle", F.spark_partition_id().alias("task")).collect()
    expected = sorted(" -> ".join([*c, c[0]]) for c in traverse.cycles_of({a: list(b) for a, b in near.items()}))
    assert sorted(r["cycle"] for r in found) == expected and {r["component"] for r in found} == {"c"}
    assert len({r["task"] for r in found}) > 3
    assert traverse.component_cycles(edges, own.limit(0)).count() == 0


@pytest.mark.parametrize("few", [0, 200_000])
def test_components_write_edges_again_only_if_some_are_lost(spark, monkeypatch, few):
    names, write = [], traverse.written
    monkeypatch.setattr(traverse, "FEW_IDS", few)
    monkeypatch.setattr(traverse, "written", lambda df, name: names.append(name) or write(df, name))
    ring = spark.createDataFrame([(f"n{i}", f"n{(i + 1) % 5}") for i in range(5)] + [("n0", "n3"), ("n1", "n1"), ("n0", None)], "src string, dst string")
    assert {tuple(r) for r in traverse.cyclic_core(ring).collect()} == {(f"n{i}", f"n{(i + 1) % 5}") for i in range(5)} | {("n0", "n3")}
    assert names.count("core") == 1
    tail = ring.unionByName(spark.createDataFrame([("n0", "x"), ("x", "y"), ("z", "n2"), ("a", "b"), ("b", "a"), ("b", "n4")], "src string, dst string"))
    found = {r["id"]: r["component"] for r in traverse.strong_components(tail).collect()}
    assert found == {**{f"n{i}": "n0" for i in range(5)}, "a": "a", "b": "a"}
    assert traverse.strong_components(ring.limit(0)).count() == 0
