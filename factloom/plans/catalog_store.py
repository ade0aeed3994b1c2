"""Registered queries over the store, record files, paths, check loops and limited traversals."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions.paths import normalize_path
from factloom.operators import clones, framework, impact, inspect, metrics, select, store, traverse
from factloom.plans.catalog import DIAGNOSTICS, FINDING, IMPORT_KINDS, Tables, _diagnostics, _most, _occurrences, _start, query
from factloom.plans.durable import new_path, written
from factloom.sources import records, repo

FILE_PATHS = ", fp AS (SELECT path, doc_id, CASE doc_id % 5 WHEN 0 THEN concat('./', path) WHEN 1 THEN concat(' ', replace(path, '/', '\\'), ' ') WHEN 2 THEN concat('../', path) WHEN 3 THEN concat('/', path) ELSE concat('a//./', path) END AS raw FROM files)"


def _folder(t: Tables, name: str) -> str:
    return new_path(t.spark, name)


# Paths and scans

@query("q_normalized_paths", FILE_PATHS + " SELECT path, CASE doc_id % 5 WHEN 0 THEN path WHEN 1 THEN path WHEN 4 THEN concat('a/', path) END AS normal FROM fp")
def _(t):
    p, n = F.col("path"), F.col("doc_id") % 5
    raw = F.when(n == 0, F.concat(F.lit("./"), p)).when(n == 1, F.concat(F.lit(" "), F.replace(p, F.lit("/"), F.lit("\\")), F.lit(" "))).when(n == 2, F.concat(F.lit("../"), p)).when(n == 3, F.concat(F.lit("/"), p)).otherwise(F.concat(F.lit("a//./"), p))
    return t.files.select("path", normalize_path(raw).alias("normal"))


@query("q_watched", " SELECT path FROM files WHERE path LIKE 'src1/%' OR path = 'src2/3.md'")
def _(t):
    return repo.watched(t.files.select("path"), ["src1", "src2/3.md"])


@query("q_guarded", ", d AS (SELECT concat(CASE WHEN doc_id % 3 = 0 THEN 'deep/er/' ELSE '' END, path) AS path FROM files) SELECT path FROM d WHERE path NOT LIKE 'deep/%' ORDER BY path LIMIT 150")
def _(t):
    deep = t.files.select(F.concat(F.when(F.col("doc_id") % 3 == 0, "deep/er/").otherwise(""), "path").alias("path"))
    return repo.guarded(deep, max_depth=2, max_files=150)


@query("q_scan", " SELECT path, sha256(content) AS sha256 FROM code_files WHERE path LIKE 'rs/%'")
def _(t):
    """Files written one by one below a root, then scanned."""
    root = _folder(t, "repo")
    for r in t.code_files.where("path LIKE 'rs/%'").collect():  # a file for each nation
        jvm, conf = t.spark._jvm, t.spark._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(f"{root}/{r['path']}")
        out = path.getFileSystem(conf).create(path, True)
        out.write(bytearray(r["content"].encode()))
        out.close()
    return repo.scan(t.spark, root, "*.rs").select("path", "sha256")


# Record files

@query("q_history_scan", " SELECT report_id, signal_id, sequence, amount FROM history")
def _(t):
    path = _folder(t, "history")
    t.history.select(F.col("report_id").cast("string"), "sequence", "signal_id", "amount").write.json(path)
    return records.history(t.spark, path).select(F.col("report_id").cast("long"), "signal_id", "sequence", "amount")


@query("q_telemetry_scan", " SELECT record_id, command, state, bucket, duration_ms FROM latency_records")
def _(t):
    path = _folder(t, "telemetry")
    t.latency_records.write.json(path)
    return records.telemetry(t.spark, path, most_bytes=1 << 40).select("record_id", "command", "state", "bucket", "duration_ms")


@query("q_budget_scan", " SELECT r_name AS command, 'warm' AS scope, CAST(r_regionkey * 10 AS DOUBLE) AS budget_ms FROM region")
def _(t):
    path = _folder(t, "budgets")
    rows = t.region.select(F.struct(F.col("r_name").alias("command"), F.lit("warm").alias("scope"), F.lit("small").alias("bucket"), (F.col("r_regionkey") * 10).cast("double").alias("budget_ms")).alias("b"))
    rows.agg(F.to_json(F.struct(F.collect_list("b").alias("budgets"))).alias("value")).write.text(path)  # one policy file
    return records.budgets(t.spark, path).select("command", "scope", "budget_ms")


@query("q_history_append", " SELECT signal_id, 2 * count(*) AS n, 2 * sum(amount) AS amount FROM history GROUP BY signal_id")
def _(t):
    path = _folder(t, "appended")
    rows = t.history.select(F.col("report_id").cast("string"), "sequence", "signal_id", "amount")
    for _ in range(2):
        store.append_history(rows, path)
    return records.history(t.spark, path).groupBy("signal_id").agg(F.count("*").alias("n"), F.sum("amount").alias("amount"))


# Store

def _snapshot(t: Tables) -> dict:
    nodes = t.nodes.where("kind IN ('Module', 'Class')")
    return {"nodes": nodes, "edges": select.edges_between(t.edges, nodes), "file_hashes": t.nodes.where("kind = 'File'").select("path", F.sha2("path", 256).alias("sha256"))}


@query("q_store_metadata", " SELECT 1 AS version, 'Class,Module' AS node_kinds, 'CONTAINS,INHERITS' AS edge_kinds, CAST(2 AS BIGINT) AS sequence, 'second' AS summary")
def _(t):
    s = store.FactStore(t.spark, _folder(t, "store"))
    tables = {k: written(v, k) for k, v in _snapshot(t).items()}
    for summary in ("first", "second"):
        s.replace(tables, {"summary": summary})
    row = (s.metadata("version"), ",".join(s.metadata("node_kinds")), ",".join(s.metadata("edge_kinds")), s.current()[0], s.metadata("summary"))
    return t.spark.createDataFrame([row], "version int, node_kinds string, edge_kinds string, sequence long, summary string")


@query("q_store_rows", ", n AS (SELECT * FROM nodes WHERE kind IN ('Module', 'Class')) SELECT id, kind, src, dst FROM edges WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n)")
def _(t):
    s = store.FactStore(t.spark, _folder(t, "store"))
    s.replace({k: written(v, k) for k, v in _snapshot(t).items()})
    return s.read("edges")


@query("q_store_refuses", " SELECT 'dangling' AS fault, true AS refused UNION ALL SELECT 'missing table', true UNION ALL SELECT 'empty store', true UNION ALL SELECT 'version', true")
def _(t):
    tables, rows = {k: written(v, k) for k, v in _snapshot(t).items()}, []
    dangling = {**tables, "nodes": tables["nodes"].where("kind = 'Class'")}

    def newer(s: store.FactStore) -> None:
        s.replace(tables, {"version": store.VERSION + 1})
        s.read("nodes")

    faults = (("dangling", lambda s: s.replace(dangling)), ("missing table", lambda s: s.replace({"nodes": tables["nodes"]})), ("empty store", lambda s: s.read("nodes")), ("version", newer))
    for fault, act in faults:
        try:
            act(store.FactStore(t.spark, _folder(t, "store")))
            rows.append((fault, False))
        except store.StoreError:
            rows.append((fault, True))
    return t.spark.createDataFrame(rows, "fault string, refused boolean")


@query("q_compact", " SELECT event_id, event_type FROM events")
def _(t):
    path, target = _folder(t, "small"), _folder(t, "compact")
    t.events.select("event_id", "event_type").repartition(20).write.parquet(path)
    store.compact(t.spark, path, target, 2)
    return t.spark.read.parquet(target)


@query("q_clone_index", FINDING + " SELECT path, peer_path, class_id FROM fi")
def _(t):
    found, path = written(clones.findings(written(_occurrences(t), "occurrences")), "findings"), _folder(t, "clones")
    refused = [store.guarded_index(found, path, overlays=a, scoped=b, clean=c) for a, b, c in ((True, False, True), (False, True, True), (False, False, False))]
    return t.spark.read.parquet(path) if not any(refused) and store.guarded_index(found, path, overlays=False, scoped=False, clean=True) else found.limit(0)


@query("q_clone_diagnostics", FINDING + " SELECT 'clone.duplication' AS check_id, 'error' AS severity, path, 'CLONE_DUPLICATE' AS code, concat('Duplicated block shared with ', peer_path) AS message FROM fi")
def _(t):
    return clones.clone_diagnostics(clones.findings(written(_occurrences(t), "occurrences")))


# Selectors and requests

@query("q_merged_requirements", " SELECT id, kind FROM nodes WHERE kind IN ('Class', 'Module') UNION ALL SELECT id, kind FROM (SELECT id, kind FROM nodes WHERE kind = 'Test' ORDER BY id LIMIT 5) y")
def _(t):
    asked = [{"kind": "nodes", "kinds": ["Class"]}, {"kind": "nodes", "kinds": ["Test"], "limit": 5}, {"kind": "nodes", "kinds": ["Module", "Class"]}]
    parts = [select.select_nodes(t.nodes, kinds=r["kinds"], limit=r.get("limit")).select("id", "kind") for r in select.merged_requirements(asked)]
    return parts[0].unionByName(parts[1])


@query("q_covering_reuse", " SELECT 'class' AS asked, count(*) AS n, CAST(1 AS BIGINT) AS reused FROM nodes WHERE kind = 'Class' UNION ALL SELECT 'brand', count(*), 2 FROM nodes WHERE kind = 'Class' AND (contains(id, 'Brand#13') OR contains(coalesce(name, ''), 'Brand#13'))")
def _(t):
    have = select.Covered(t.nodes)
    have.nodes_of({"kind": "nodes", "kinds": ["Class", "Module"]})
    rows = []
    for asked, want in (("class", {"kinds": ["Class"]}), ("brand", {"kinds": ["Class"], "text": "Brand#13"})):
        n = have.nodes_of({"kind": "nodes", **want}).count()
        rows.append((asked, n, have.reused))
    return t.spark.createDataFrame(rows, "asked string, n long, reused long")


@query("q_request_answers", """, rq AS (SELECT p_partkey AS request_id, CASE p_partkey % 3 WHEN 0 THEN 'importers_of' WHEN 1 THEN 'children_of' ELSE 'none_of' END AS q, CASE WHEN p_partkey % 7 = 0 THEN 'file:none' ELSE concat('file:part/', p_partkey) END AS t FROM part),
  an AS (SELECT request_id, e.src AS x FROM rq JOIN edges e ON q = 'importers_of' AND e.kind IN ('IMPORTS_FROM', 'DEPENDS_ON') AND e.dst = t UNION SELECT request_id, e.dst FROM rq JOIN edges e ON q = 'children_of' AND e.kind = 'CONTAINS' AND e.src = t),
  g AS (SELECT request_id, count(*) AS n, min(x) AS first_id FROM an WHERE x IN (SELECT id FROM nodes) GROUP BY request_id)
  SELECT rq.request_id, CASE WHEN q = 'none_of' THEN 'unknown_query' WHEN t = 'file:none' THEN 'unknown_target' ELSE 'ok' END AS status, coalesce(n, 0) AS n, first_id FROM rq LEFT JOIN g ON g.request_id = rq.request_id""")
def _(t):
    k = F.col("p_partkey")
    name = F.when(k % 3 == 0, "importers_of").when(k % 3 == 1, "children_of").otherwise("none_of")
    requests = t.part.select(k.alias("request_id"), name.alias("query"), F.when(k % 7 == 0, "file:none").otherwise(F.concat(F.lit("file:part/"), k)).alias("target"))
    return inspect.answers(requests, t.nodes, t.edges)


@query("q_impact_selector", " SELECT 'impact is no fact selector; use operators.impact' AS message")
def _(t):
    try:
        select.select_impact(t.nodes)
    except NotImplementedError as e:
        return t.spark.createDataFrame([(str(e),)], "message string")


# Limited traversals and paths

LIMITED = f", st AS ({_most(IMPORT_KINDS, 'dst')}), l1 AS (SELECT src AS id, min(kind || ' ' || src || ' ' || dst || ' ' || id) AS k FROM edges WHERE kind IN {IMPORT_KINDS} AND dst IN (SELECT id FROM st) AND src NOT IN (SELECT id FROM st) GROUP BY src)"


@query("q_importers_first", LIMITED + " SELECT id, 0 AS depth, true AS truncated FROM st UNION ALL SELECT id, 1, true FROM (SELECT id FROM l1 ORDER BY k LIMIT 9) y")
def _(t):
    start = written(_start(t, list(traverse.IMPORTS), "dst"), "start").withColumn("pos", F.lit(0))
    found, truncated = traverse.reach_limited(t.nodes, t.edges, start, traverse.IMPORTS, False, 3, 10)
    return found.select("id", "depth").withColumn("truncated", F.lit(truncated))


@query("q_impact_limited", ", im AS (SELECT src AS id, min(kind || ' ' || src) AS k FROM edges WHERE kind IN " + IMPORT_KINDS + " AND dst = 'file:part/7' AND src <> 'file:part/7' GROUP BY src) SELECT 'file:part/7' AS id, 'file' AS role, true AS truncated UNION ALL SELECT id, 'file', true FROM (SELECT id FROM im ORDER BY k LIMIT 7) y")
def _(t):
    paths = t.spark.createDataFrame([("no/such", 0), ("part/7", 1)], "path string, pos int")
    found, truncated = impact.impact_limited(t.nodes, t.edges, paths, 3, 8)
    return found.select("id", "role").withColumn("truncated", F.lit(truncated))


@query("q_impact_limited_inside", """, own AS (SELECT dst AS id FROM edges WHERE kind = 'CONTAINS' AND src = 'file:part/7'), sy AS (SELECT id, 'symbol' AS role, 1 AS phase, id AS k FROM own),
  te AS (SELECT dst AS id, min(e.src || ' ' || dst) AS k FROM edges e JOIN own ON own.id = e.src WHERE kind = 'TESTED_BY' GROUP BY dst),
  ph AS (SELECT id, 'test' AS role, 2 AS phase, k || ' 0' AS k FROM te UNION ALL SELECT n.id, 'file', 2, min(te.k || ' 1') FROM te JOIN nodes t ON t.id = te.id JOIN nodes n ON n.path = t.path AND n.kind = 'File' GROUP BY n.id),
  al AS (SELECT 'file:part/7' AS id, 'file' AS role, 0 AS phase, '' AS k UNION ALL SELECT * FROM sy UNION ALL SELECT * FROM ph)
  SELECT id, role, (SELECT count(*) FROM al) > 12 AS truncated FROM (SELECT * FROM al ORDER BY phase, k LIMIT 12) y""")
def _(t):
    paths = t.spark.createDataFrame([("part/7", 0)], "path string, pos int")
    found, truncated = impact.impact_limited(t.nodes, t.edges, paths, 0, 12)
    return found.select("id", "role").withColumn("truncated", F.lit(truncated))


#: Nations in rings by region: each imports the next of its region, the last the first.
RINGS = ", ri AS (SELECT n_regionkey AS r, n_name AS a, coalesce(lead(n_name) OVER (PARTITION BY n_regionkey ORDER BY n_name), min(n_name) OVER (PARTITION BY n_regionkey)) AS b FROM nation)"
RING_PATH = ", rp AS (SELECT r, min(a) AS component, string_agg(a, ' -> ' ORDER BY a) || ' -> ' || min(a) AS cycle FROM ri GROUP BY r HAVING count(*) > 1)"


def _rings(t: Tables):
    from pyspark.sql import Window

    w = Window.partitionBy("n_regionkey").orderBy("n_name")
    first = F.min("n_name").over(Window.partitionBy("n_regionkey"))
    return t.nation.select(F.col("n_name").alias("src"), F.coalesce(F.lead("n_name").over(w), first).alias("dst"))


@query("q_ring_cycles", RINGS + RING_PATH + " SELECT component, cycle FROM rp")
def _(t):
    edges = written(_rings(t), "rings")
    return traverse.component_cycles(edges, written(traverse.strong_components(edges), "components"))


@query("q_cycle_variants", RINGS + ", k AS (SELECT CAST(count(*) AS BIGINT) AS n FROM (SELECT r FROM ri GROUP BY r HAVING count(*) > 1) y) SELECT 'rotated' AS variant, n AS cycles FROM k UNION ALL SELECT 'as found', n FROM k UNION ALL SELECT 'repeated', n FROM k")
def _(t):
    near: dict[str, list[str]] = {}
    for r in _rings(t).collect():  # 25 nations
        near.setdefault(r["src"], []).append(r["dst"])
    kinds = (("rotated", {}), ("as found", {"rotate": False}), ("repeated", {"rotate": False, "dedupe": False}))
    return t.spark.createDataFrame([(name, sum(len(c) > 1 for c in traverse.cycles_of(near, **how))) for name, how in kinds], "variant string, cycles long")


# Check loops

def _checks() -> list[framework.Check]:
    def fails(_):
        raise OSError("no disk")

    return [
        framework.Check("docs.length", lambda c: c.files, ("all", "package")), framework.Check("graph.rules", lambda c: c.files, ("all",), needs_graph=True),
        framework.Check("disk", fails, ("package",)), framework.Check("last", lambda c: c.files, ("all",)),
    ]


@query("q_check_selection", " SELECT 'asked' AS how, 'last,docs.length' AS checks UNION ALL SELECT 'scope all', 'docs.length,graph.rules,last' UNION ALL SELECT 'scope package', 'docs.length,disk' UNION ALL SELECT 'unknown', 'error'")
def _(t):
    ids = lambda *a: ",".join(c.id for c in framework.select_checks(_checks(), *a))
    rows = [("asked", ids(["last", "docs.length", "last"], "all")), ("scope all", ids(None, "all")), ("scope package", ids(None, "package"))]
    try:
        rows.append(("unknown", ids(["none"], "all")))
    except ValueError:
        rows.append(("unknown", "error"))
    return t.spark.createDataFrame(rows, "how string, checks string")


@query("q_check_loop", DIAGNOSTICS + " SELECT 'docs.length' AS check_id, 'ran' AS outcome, count(*) AS found FROM dg UNION ALL SELECT 'graph.rules', 'skipped', NULL UNION ALL SELECT 'disk', 'infrastructure_failure: OSError', NULL")
def _(t):
    context = framework.Context(_diagnostics(t, 400))
    done = framework.run_checks(_checks(), context, ["docs.length", "graph.rules", "disk", "last"])
    return t.spark.createDataFrame([(name, outcome, None if found is None else found.count()) for name, outcome, found in done], "check_id string, outcome string, found long")


@query("q_check_fail_fast", " SELECT 'docs.length' AS check_id UNION ALL SELECT 'last' FROM (SELECT count(*) AS n FROM files WHERE length(content) < 80) y WHERE n = 0")
def _(t):
    done = framework.run_checks(_checks(), framework.Context(_diagnostics(t, 400)), ["docs.length", "last"], fail_fast=True)
    return t.spark.createDataFrame([(name,) for name, _, _ in done], "check_id string")


@query("q_diagnostic_order", DIAGNOSTICS + " SELECT path, severity, CAST(row_number() OVER (ORDER BY path, severity, code, CAST(n AS VARCHAR)) AS BIGINT) AS place FROM dg")
def _(t):
    """Places by the order in which the sorted rows are written: partitions follow each other."""
    ordered = framework.in_order(_diagnostics(t, 400)).select("path", "severity", F.monotonically_increasing_id().alias("at"))
    ordered = written(ordered, "ordered")
    part = F.shiftright("at", 33)
    sizes = {r["p"]: r["n"] for r in ordered.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}  # a row for each partition
    starts, n = [], 0
    for p in sorted(sizes):
        starts.append((p, n))
        n += sizes[p]
    first = t.spark.createDataFrame(starts, "p long, start long")
    return ordered.withColumn("p", part).join(F.broadcast(first), "p").select("path", "severity", (F.col("start") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias("place"))


@query("q_degradations", " SELECT DISTINCT source AS id, concat('no ', lang) AS message FROM documents WHERE doc_id % 4 = 1")
def _(t):
    evidence = t.documents.select(F.col("source").alias("id"), F.concat(F.lit("no "), "lang").alias("message"), (F.col("doc_id") % 4 != 1).alias("present"))
    return metrics.degradations(evidence)


@query("q_next_actions", ", s AS (SELECT lang AS signal_id, CASE WHEN lang = 'de' THEN 'error' ELSE 'warning' END AS severity, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang) SELECT concat(signal_id, ': ', n) AS action FROM s ORDER BY severity <> 'error', n DESC, signal_id LIMIT 3")
def _(t):
    found = t.documents.where("lang IS NOT NULL").groupBy(F.col("lang").alias("signal_id")).agg(F.count("*").alias("count"))
    found = found.withColumn("severity", F.when(F.col("signal_id") == "de", "error").otherwise("warning"))
    return t.spark.createDataFrame([(a,) for a in metrics.next_actions(found)], "action string")


@query("q_failed_preconditions", " SELECT path FROM files WHERE doc_id % 6 = 5 UNION ALL SELECT 'none.md'")
def _(t):
    sums = t.files.where("doc_id % 3 = 2").select("path", F.when(F.col("doc_id") % 6 == 5, "other").otherwise(F.sha2("content", 256)).alias("checksum_before"))
    return framework.failed_preconditions(t.files, sums.unionByName(t.spark.createDataFrame([("none.md", "x")], "path string, checksum_before string")))
