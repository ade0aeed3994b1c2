"""The registered queries on the driver's tables, each with the SQL that gives the same rows where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.text import line_count
from factloom.operators import checks, clones, framework, impact, metrics, search, select, traverse
from factloom.plans.durable import new_path, shuffles_dropped, written
from factloom.sources import repo
from factloom.sources.star import made, once, oracle_views, stored, view

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Views of one folder, by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return stored(self.spark, self.sf_dir, name) if name in ("nodes", "edges") else view(self.spark, self.sf_dir, name)

    def has(self, name: str) -> bool:
        """Whether an earlier query has built this."""
        return made(self.spark, self.sf_dir, name)

    @property
    def search_index(self) -> search.Index:
        """The search index of the folder's nodes, written once for each application, as the nodes are."""
        return once(self.spark, self.sf_dir, "search", lambda: search.build_index(search.search_documents(self.nodes)))

    def searched(self, query: str) -> DataFrame | search.Index:
        """What a query that needs only its matches reads: the index if it is there, else the nodes in one pass.

        Candidates are written: with the exact match in the same stage, the JVM leaves the pass uncompiled for its length.
        """
        if self.has("search"):
            return self.search_index
        nodes = self.nodes if self.has("nodes") else view(self.spark, self.sf_dir, "nodes")
        return search.search_documents(written(search.candidates(nodes, query), "candidates"))


def query(name: str, sql: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], Callable[[Tables], DataFrame]]:
    """Register a query on Tables; `sql` follows the views' WITH clause: `, more AS (...) SELECT ...`."""

    def put(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = f"WITH RECURSIVE {oracle_views()}{sql}"
        return f

    return put


# Selectors

KNOWN = " FROM edges e WHERE src IN (SELECT id FROM nodes) AND dst IN (SELECT id FROM nodes)"


@query("q_nodes", " SELECT id, kind, path FROM nodes WHERE kind IN ('Class', 'Test') ORDER BY id LIMIT 200")
def _(t):
    return select.select_nodes(t.nodes, kinds=["Class", "Test"], limit=200).select("id", "kind", "path")


@query("q_nodes_text", " SELECT id, kind FROM nodes WHERE contains(id, 'part/1') OR contains(coalesce(name, ''), 'part/1')")
def _(t):
    return select.select_nodes(t.nodes, text="part/1").select("id", "kind")


@query("q_nodes_edges", ", n AS (SELECT id FROM nodes WHERE kind = 'Function') SELECT id, kind, src, dst FROM edges WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n)")
def _(t):
    return select.edges_between(t.edges, select.select_nodes(t.nodes, kinds=["Function"])).select("id", "kind", "src", "dst")


@query("q_edges", f" SELECT id, kind, src, dst {KNOWN} AND kind IN ('CALLS', 'INHERITS') ORDER BY kind, src, dst, id LIMIT 500")
def _(t):
    return select.select_edges(t.nodes, t.edges, kinds=["CALLS", "INHERITS"], limit=500).select("id", "kind", "src", "dst")


EDGE_IDS = ["file:part/7", "edge:CONTAINS:module:region/1->module:nation/1", "module:nation/3"]
EDGE_LIST = ", ".join(f"'{x}'" for x in EDGE_IDS)


@query("q_edges_by_ids", f" SELECT id, kind {KNOWN} AND (src IN ({EDGE_LIST}) OR dst IN ({EDGE_LIST}) OR id IN ({EDGE_LIST}))")
def _(t):
    return select.select_edges(t.nodes, t.edges, ids=EDGE_IDS).select("id", "kind")


@query("q_neighbors", f" SELECT id, kind {KNOWN} AND (src IN ({EDGE_LIST}) OR dst IN ({EDGE_LIST}))")
def _(t):
    return select.select_edges(t.nodes, t.edges, ids=EDGE_IDS, neighbors=True).select("id", "kind")


@query("q_edge_endpoints", f", f AS (SELECT src, dst {KNOWN} AND kind = 'INHERITS') SELECT id, kind FROM nodes WHERE id IN (SELECT src FROM f UNION SELECT dst FROM f)")
def _(t):
    return select.endpoints(select.select_edges(t.nodes, t.edges, kinds=["INHERITS"]), t.nodes).select("id", "kind")


@query("q_symbols", " SELECT id, kind, name FROM nodes WHERE kind <> 'File' AND (contains(id, 'Brand') OR contains(coalesce(name, ''), 'Brand'))")
def _(t):
    return select.select_symbols(t.nodes, text="Brand").select("id", "kind", "name")


@query("q_direct_node_counts", " SELECT kind, count(*) AS n FROM nodes GROUP BY kind")
def _(t):
    return select.count_by_kind(t.nodes)


@query("q_direct_edge_counts", " SELECT kind, count(*) AS n FROM edges GROUP BY kind")
def _(t):
    return select.count_by_kind(t.edges)


@query("q_edges_from_file", " SELECT id, kind FROM edges WHERE split_part(substr(src, strpos(src, ':') + 1), '#', 1) = 'part/11'")
def _(t):
    return select.edges_of_file(t.edges, "part/11").select("id", "kind")


@query("q_name_like", " SELECT id, name FROM nodes WHERE name LIKE 'Customer#%1' ORDER BY name, id LIMIT 50")
def _(t):
    return select.nodes_like(t.nodes, "Customer#%1", 50).select("id", "name")


@query("q_node_rows", ", h AS (SELECT path, sha256(path) AS sha256 FROM nodes WHERE kind = 'File') SELECT n.id, n.kind = 'Test' OR coalesce(attributes LIKE '%\"isTest\":true%', false) AS is_test, coalesce(attributes LIKE '%\"exported\":true%', false) AS is_exported, h.sha256 AS file_hash FROM nodes n LEFT JOIN h USING (path)")
def _(t):
    hashes = t.nodes.where("kind = 'File'").select("path", F.sha2("path", 256).alias("sha256"))
    return select.with_file_facts(t.nodes, hashes).select("id", "is_test", "is_exported", "file_hash")


@query("q_edge_rows", " SELECT e.id, coalesce(s.path, d.path) AS file_path FROM edges e LEFT JOIN nodes s ON s.id = e.src LEFT JOIN nodes d ON d.id = e.dst")
def _(t):
    return select.with_edge_files(t.edges, t.nodes).select("id", "file_path")


@query("q_dangling_edges", " SELECT id FROM edges WHERE src NOT IN (SELECT id FROM nodes WHERE kind <> 'Test') OR dst NOT IN (SELECT id FROM nodes WHERE kind <> 'Test')")
def _(t):
    from factloom.operators.store import dangling

    return dangling(t.nodes.where("kind <> 'Test'"), t.edges)


@query("q_snapshot_kinds", " SELECT (SELECT string_agg(DISTINCT kind, ',' ORDER BY kind) FROM nodes) AS node_kinds, (SELECT string_agg(DISTINCT kind, ',' ORDER BY kind) FROM edges) AS edge_kinds")
def _(t):
    from factloom.operators.extract import snapshot_metadata

    return snapshot_metadata(t.nodes, t.edges).select(F.array_join("node_kinds", ",").alias("node_kinds"), F.array_join("edge_kinds", ",").alias("edge_kinds"))


# Traversals

IMPORT_KINDS = "('IMPORTS_FROM', 'DEPENDS_ON')"


def _most(kinds: str, end: str) -> str:
    return f"SELECT {end} AS id FROM edges WHERE kind IN {kinds} GROUP BY {end} ORDER BY count(*) DESC, {end} LIMIT 1"


def _reach_sql(kinds: str, outward: bool, start: str, depth: int | None) -> str:
    a, b = ("src", "dst") if outward else ("dst", "src")
    bound = "" if depth is None else f" AND d < {depth}"
    step = "d" if depth is None else "d + 1"
    return f""", start AS ({start}), adj AS (SELECT DISTINCT {a} AS a, {b} AS b FROM edges WHERE kind IN {kinds} AND {b} IN (SELECT id FROM nodes)),
      r(id, d) AS (SELECT id, 0 FROM start UNION SELECT b, {step} FROM r JOIN adj ON a = id WHERE true{bound})"""


def _start(t: Tables, kinds: list[str], end: str) -> DataFrame:
    ranked = t.edges.where(F.col("kind").isin(kinds)).groupBy(F.col(end).alias("id")).agg(F.count("*").alias("n"))
    return ranked.orderBy(F.desc("n"), "id").limit(1).select("id")


def _traversal(name: str, kinds: tuple[str, ...], outward: bool, end: str, depth: int) -> None:
    listed = "(" + ", ".join(f"'{k}'" for k in kinds) + ")"
    sql = _reach_sql(listed, outward, _most(listed, end), depth) + " SELECT id, CAST(min(d) AS INT) AS depth FROM r GROUP BY id"

    @query(f"q_{name}", sql)
    def _(t):
        edges = t.edges
        start = written(_start(t, list(kinds), end), "start")
        return traverse.reach(t.nodes.select("id"), edges, start, kinds, outward, depth)


_traversal("callers", ("CALLS",), False, "dst", 3)
_traversal("callees", ("CALLS",), True, "src", 3)
_traversal("importers", ("IMPORTS_FROM", "DEPENDS_ON"), False, "dst", 2)
_traversal("imports", ("IMPORTS_FROM", "DEPENDS_ON"), True, "src", 3)
_traversal("inheritors", ("INHERITS",), False, "dst", 3)
_traversal("children", ("CONTAINS",), True, "src", 3)


@query("q_importers_edges", _reach_sql(IMPORT_KINDS, False, _most(IMPORT_KINDS, "dst"), 2) + ", m AS (SELECT id, min(d) AS d FROM r GROUP BY id) SELECT e.id FROM edges e WHERE kind IN " + IMPORT_KINDS + " AND dst IN (SELECT id FROM m WHERE d < 2) AND src IN (SELECT id FROM m)")
def _(t):
    edges, nodes = t.edges, t.nodes.select("id")
    found = traverse.reach(nodes, edges, written(_start(t, list(traverse.IMPORTS), "dst"), "start"), traverse.IMPORTS, False, 2)
    return traverse.reached_edges(nodes, edges, found, traverse.IMPORTS, False, 2).select("id")


@query("q_importers_limited")
def _(t):
    start = written(_start(t, list(traverse.IMPORTS), "dst"), "start").withColumn("pos", F.lit(0))
    found, truncated = traverse.reach_limited(t.nodes, t.edges, start, traverse.IMPORTS, False, 3, 25)
    return found.withColumn("truncated", F.lit(truncated))


@query("q_tests_for", ", start AS (" + _most("('TESTED_BY')", "src") + "), x AS (SELECT dst AS id FROM edges WHERE kind = 'TESTED_BY' AND src IN (SELECT id FROM start)) SELECT id FROM start UNION SELECT id FROM x UNION SELECT id FROM nodes WHERE kind = 'File' AND path IN (SELECT path FROM nodes WHERE id IN (SELECT id FROM x))")
def _(t):
    return traverse.tests_for(t.nodes, t.edges, _start(t, ["TESTED_BY"], "src"))


@query("q_descendants", _reach_sql("('CONTAINS')", True, "SELECT 'module:region/1' AS id", None) + " SELECT DISTINCT id FROM r WHERE id <> 'module:region/1'")
def _(t):
    roots = t.nodes.where("id = 'module:region/1'").select("id")
    return traverse.contained(t.nodes.select("id"), t.edges, roots)


@query("q_file_summary", ", i AS (SELECT dst AS id FROM edges WHERE kind = 'CONTAINS' AND src = 'file:part/7') SELECT 'file:part/7' AS id UNION SELECT id FROM i UNION SELECT dst FROM edges WHERE kind IN " + IMPORT_KINDS + " AND src = 'file:part/7' UNION SELECT src FROM edges WHERE kind IN " + IMPORT_KINDS + " AND dst = 'file:part/7'")
def _(t):
    return traverse.file_summary(t.nodes, t.edges, "file:part/7")[0]


IMPACT = _reach_sql(IMPORT_KINDS, False, "SELECT id FROM nodes WHERE kind = 'File' AND path IN ('part/7', 'part/19', 'order/40')", 3) + """, fl AS (SELECT DISTINCT id FROM r),
  ins(id) AS (SELECT dst FROM edges WHERE kind = 'CONTAINS' AND src IN (SELECT id FROM fl) UNION SELECT dst FROM edges JOIN ins ON src = ins.id WHERE kind = 'CONTAINS'),
  kn AS (SELECT * FROM nodes WHERE id IN (SELECT id FROM fl UNION SELECT id FROM ins)),
  ts AS (SELECT DISTINCT n.id, n.path FROM edges e JOIN nodes n ON n.id = e.dst WHERE e.kind = 'TESTED_BY' AND e.src IN (SELECT id FROM kn WHERE kind NOT IN ('File', 'Test'))),
  ev AS (SELECT id, kind, path FROM kn UNION SELECT id, 'Test', path FROM ts UNION SELECT id, kind, path FROM nodes WHERE kind = 'File' AND path IN (SELECT path FROM ts))"""


def _impact(t: Tables) -> DataFrame:
    paths = t.spark.createDataFrame([("part/7",), ("part/19",), ("order/40",), ("no/such",)], "path string")
    return impact.impact(t.nodes, t.edges, paths, 3)


@query("q_impact_files", IMPACT + " SELECT DISTINCT path FROM ev WHERE kind = 'File'")
def _(t):
    return impact.impacted_files(_impact(t))


@query("q_impact_symbols", IMPACT + " SELECT id FROM ev WHERE kind NOT IN ('File', 'Test')")
def _(t):
    return impact.impacted_symbols(_impact(t))


@query("q_impact_tests", IMPACT + " SELECT DISTINCT path FROM ev WHERE kind = 'Test'")
def _(t):
    return impact.impacted_tests(_impact(t))


@query("q_dependents", _reach_sql(IMPORT_KINDS, False, "SELECT 'file:part/7' AS id", None) + " SELECT DISTINCT id FROM r WHERE id <> 'file:part/7'")
def _(t):
    edges = t.edges
    roots = t.spark.createDataFrame([("file:part/7",)], "id string")
    return traverse.dependents(edges.where("kind = 'IMPORTS_FROM'"), edges.where("kind = 'DEPENDS_ON'"), roots)


REACHABLE = _reach_sql("('IMPORTS_FROM')", True, "SELECT id FROM nodes WHERE kind = 'File' AND path IN ('part/7', 'part/23')", None) + """, ro AS (SELECT DISTINCT dst AS id FROM edges WHERE kind = 'CONTAINS' AND src IN (SELECT id FROM r) AND dst IN (SELECT id FROM nodes)),
  sy(id) AS (SELECT id FROM ro UNION SELECT dst FROM edges JOIN sy ON src = sy.id WHERE kind IN ('CALLS', 'INHERITS', 'IMPLEMENTS') AND dst IN (SELECT id FROM nodes))"""


@query("q_reachable", REACHABLE + " SELECT id FROM r UNION SELECT id FROM sy")
def _(t):
    entry = t.nodes.where("kind = 'File' AND path IN ('part/7', 'part/23')").select("id")
    return traverse.reachable_symbols(t.nodes, t.edges, entry)


@query("q_cycles")
def _(t):
    edges = view(t.spark, t.sf_dir, "edges") if not t.has("edges") else t.edges
    edges = written(edges.where("kind = 'IMPORTS_FROM'").select("src", "dst"), "imports")
    return traverse.component_cycles(edges, written(traverse.strong_components(edges), "components"))


@query("q_strong_components", """, im AS (SELECT DISTINCT src, dst FROM edges WHERE kind = 'IMPORTS_FROM' AND src <> dst),
  rr(a, b) AS (SELECT src, dst FROM im UNION SELECT rr.a, im.dst FROM rr JOIN im ON im.src = rr.b) SELECT x.a AS id, min(x.b) AS component FROM rr x JOIN rr y ON x.a = y.b AND x.b = y.a GROUP BY x.a""")
def _(t):
    return traverse.strong_components(t.edges.where("kind = 'IMPORTS_FROM'"))


@query("q_shortest_path", """, o AS (SELECT min(o_orderkey) AS o FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1),
  w AS (SELECT o, c_custkey AS c, c_nationkey AS n FROM o JOIN orders ON o_orderkey = o JOIN customer ON o_custkey = c_custkey)
  SELECT 0 AS step, 'module:region/1' AS id, CAST(NULL AS VARCHAR) AS edge_kind UNION ALL SELECT 1, concat('module:nation/', n), 'CONTAINS' FROM w UNION ALL SELECT 2, concat('module:customer/', c), 'CONTAINS' FROM w UNION ALL SELECT 3, concat('file:order/', o), 'CONTAINS' FROM w""")
def _(t):
    nodes, edges = t.nodes.select("id"), t.edges
    held = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    order = held.where("n_regionkey = 1").agg(F.min("o_orderkey")).first()[0]
    return traverse.shortest_path(nodes, edges, "module:region/1", f"file:order/{order}", ["CONTAINS"])


# Changes

CHANGES = """, bo AS (SELECT coalesce(s.path, c.path) AS path, s.sha256 AS o, c.sha256 AS n FROM stored_hashes s FULL JOIN current_hashes c ON s.path = c.path),
  ch AS (SELECT * FROM bo WHERE n IS NOT NULL AND (o IS NULL OR o <> n)), de AS (SELECT * FROM bo WHERE n IS NULL),
  la AS (SELECT n AS sha, max(path) AS t FROM ch GROUP BY n), mo AS (SELECT de.path, t FROM de LEFT JOIN la ON sha = o)"""


def _changes(t: Tables) -> DataFrame:
    return impact.detect_changes(t.stored_hashes, t.current_hashes)


@query("q_changed", CHANGES + " SELECT path FROM ch")
def _(t):
    return _changes(t).where("status = 'changed'").select("path")


@query("q_deleted", CHANGES + " SELECT path FROM mo WHERE t IS NULL")
def _(t):
    return _changes(t).where("status = 'deleted'").select("path")


@query("q_renamed", CHANGES + " SELECT t AS path, path AS old_path FROM mo WHERE t IS NOT NULL")
def _(t):
    return _changes(t).where("status = 'renamed'").select("path", "old_path")


@query("q_detect_explicit", " SELECT DISTINCT s.path, CASE WHEN c.path IS NULL THEN 'deleted' ELSE 'changed' END AS status FROM stored_hashes s LEFT JOIN current_hashes c ON s.path = c.path")
def _(t):
    return impact.detect_listed(t.stored_hashes, t.current_hashes)


@query("q_freshness", CHANGES + ", z AS (SELECT (SELECT min(path) FROM de) AS gone, (SELECT min(path) FROM ch) AS new) SELECT 'stale' AS state, CASE WHEN gone IS NOT NULL THEN 'removed' ELSE 'changed' END AS reason, coalesce(gone, new) AS path FROM z")
def _(t):
    return impact.freshness(t.stored_hashes, t.current_hashes, 0, 1000)


REVIEW = IMPACT.replace("'part/7', 'part/19', 'order/40'", "'part/5', 'part/31'")


@query("q_review_context", REVIEW + " SELECT id, CASE kind WHEN 'File' THEN 'file' WHEN 'Test' THEN 'test' ELSE 'symbol' END AS role FROM ev")
def _(t):
    rows = [("part/5", "changed", None), ("part/new", "renamed", "part/31"), ("part/none", "deleted", None)]
    changes = t.spark.createDataFrame(rows, "path string, status string, old_path string")
    return impact.review_context(t.nodes, t.edges, changes).select("id", "role")


# Search

TEXT = "trim(regexp_replace(regexp_replace({}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[^A-Za-z0-9]+', ' ', 'g'), ' ')"
SEARCH = ", sd AS (SELECT id AS node_id, kind, path, name AS raw_name, " + ", ".join(f"{TEXT.format(e)} AS {c}" for c, e in (
    ("name", "coalesce(name, split_part(path, '/', -1), '')"), ("qualified_name", "id"), ("file_path", "coalesce(path, '')"), ("signature", "concat_ws(' ', kind, coalesce(name, split_part(path, '/', -1), ''), path, id)"),
)) + " FROM nodes), tk AS (SELECT *, list_distinct(string_split(lower(name || ' ' || qualified_name || ' ' || file_path || ' ' || signature), ' ')) AS tokens FROM sd)"
SEARCH_QUERY = "Brand 13"


@query("q_search_match", SEARCH + " SELECT node_id, kind FROM tk WHERE list_contains(tokens, 'brand') AND list_contains(tokens, '13')")
def _(t):
    return search.matches(t.searched(SEARCH_QUERY), SEARCH_QUERY).select("node_id", "kind")


def _bonus_sql(words: list[str]) -> str:
    q = " ".join(words)
    has = " AND ".join(f"list_contains(tokens, '{w}')" for w in words)
    b = lambda c: f"(CASE WHEN lower({c}) = '{q}' THEN 160 WHEN list_contains(string_split(lower({c}), ' '), '{q}') THEN 120 WHEN contains(lower({c}), '{q}') THEN 80 ELSE 0 END)"
    raw = TEXT.format("coalesce(raw_name, '')")
    return f"""CAST((CASE kind WHEN 'Class' THEN 320 WHEN 'Function' THEN 280 WHEN 'Type' THEN 240 WHEN 'Test' THEN -400 WHEN 'File' THEN -500 ELSE 0 END)
      + 2 * {b(raw)} + {b('qualified_name')} + 0.25 * {b('signature')} + (CASE WHEN kind = 'Function' AND split_part(lower({raw}), ' ', 1) = '{words[0]}' THEN 90 ELSE 0 END) AS DOUBLE) AS bonus FROM tk WHERE {has}"""


@query("q_search_bonus", SEARCH + f" SELECT node_id, {_bonus_sql(['brand', '13'])}")
def _(t):
    return search.bonuses(t.searched(SEARCH_QUERY), SEARCH_QUERY)


@query("q_search_columns", SEARCH + " SELECT node_id, concat_ws(',', " + ", ".join(f"CASE WHEN contains(lower({c}), 'brand 13') THEN '{c}' END" for c in search.WEIGHTS) + ") AS columns FROM tk WHERE list_contains(tokens, 'brand') AND list_contains(tokens, '13')")
def _(t):
    return search.match_columns(t.searched(SEARCH_QUERY), SEARCH_QUERY)


def _rank_sql(words: list[str], limit: int) -> str:
    length = " + ".join(f"len(list_filter(string_split(lower({c}), ' '), lambda x: x <> ''))" for c in search.WEIGHTS)
    tf = lambda w: " + ".join(f"{v} * len(list_filter(string_split(lower({c}), ' '), lambda x: x = '{w}'))" for c, v in search.WEIGHTS.items())
    parts = " + ".join(f"greatest(ln((n - d{i} + 0.5) / (d{i} + 0.5)), 1e-6) * t{i} * 2.2 / (t{i} + 1.2 * (0.25 + 0.75 * length / mean))" for i in range(len(words)))
    return f"""{SEARCH}, ln AS (SELECT *, {length} AS length, {', '.join(f'{tf(w)} AS t{i}' for i, w in enumerate(words))} FROM tk),
      st AS (SELECT count(*) AS n, avg(length) AS mean, {', '.join(f"sum(CASE WHEN list_contains(tokens, '{w}') THEN 1 ELSE 0 END) AS d{i}" for i, w in enumerate(words))} FROM ln),
      bo AS (SELECT node_id, {_bonus_sql(words)}),
      sc AS (SELECT ln.*, round({parts} + bonus, 6) AS score FROM ln JOIN bo USING (node_id), st)
      SELECT CAST(row_number() OVER (ORDER BY score DESC, path NULLS FIRST, kind, qualified_name, node_id) AS INT) AS rank, node_id, kind, path, round(score, 4) AS score FROM sc ORDER BY rank LIMIT {limit}"""


@query("q_search_rank", _rank_sql(["brand", "13"], 20))
def _(t):
    return search.search(t.search_index, SEARCH_QUERY).withColumn("score", F.round("score", 4))


@query("q_search_rank_many", _rank_sql(["brand"], 20))
def _(t):
    return search.search(t.search_index, "brand").withColumn("score", F.round("score", 4))


@query("q_search_rank_names", _rank_sql(["supply7", "part"], 15))
def _(t):
    return search.search(t.search_index, "supply7 part", limit=15).withColumn("score", F.round("score", 4))


@query("q_search_context_boost", SEARCH + " SELECT node_id, " + _bonus_sql(["brand"]).replace("AS DOUBLE)", "+ (CASE WHEN path = 'part/7' AND kind NOT IN ('File', 'Test') THEN 1000 ELSE 0 END) AS DOUBLE)"))
def _(t):
    return search.bonuses(t.searched("brand"), "brand", ["part/7"])


@query("q_search_summary", SEARCH + " SELECT count(*) AS total, CAST(least(count(*), 20) AS BIGINT) AS returned, (SELECT string_agg(DISTINCT kind, ',' ORDER BY kind) FROM sd) AS kinds FROM tk WHERE list_contains(tokens, 'brand') AND list_contains(tokens, '13')")
def _(t):
    return search.search_summary(t.search_index, SEARCH_QUERY)


@query("q_search_incremental", SEARCH + " SELECT node_id, kind, path, name FROM sd")
def _(t):
    docs = search.search_documents(t.nodes)
    touched = t.nodes.where("path LIKE 'part/1%'").select("path").distinct()
    old = docs.where("path NOT LIKE 'part/12%'").withColumn("name", F.when(F.col("path").like("part/1%"), "old").otherwise(F.col("name")))
    return search.refresh(old, docs, touched).select("node_id", "kind", "path", "name")


# Clones

CLONE = r""", lr AS (SELECT path, unnest(string_split_regex(content, '\r?\n')) AS raw, generate_subscripts(string_split_regex(content, '\r?\n'), 1) AS ln FROM files),
  ll AS (SELECT path, ln, trim(regexp_replace(trim(regexp_replace(trim(raw, ' '), '//.*$', ''), ' '), '\s+', ' ', 'g'), ' ') AS line FROM lr WHERE trim(raw, ' ') <> '' AND NOT regexp_matches(trim(raw, ' '), '^(//|#)')),
  nl AS (SELECT path, line, row_number() OVER (PARTITION BY path ORDER BY ln) AS no FROM ll WHERE line <> ''),
  wi AS (SELECT path, no, list(line) OVER (PARTITION BY path ORDER BY no ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS b FROM nl),
  wh AS (SELECT path, no, sha256(array_to_string(b, chr(10))) AS hash FROM wi WHERE len(b) = 5 AND len(list_filter(string_split_regex(array_to_string(b, chr(10)), '[^\p{L}\p{N}_]+'), lambda x: x <> '')) >= 20),
  oc AS (SELECT DISTINCT hash, path FROM wh), cl AS (SELECT hash, count(*) AS files, min(path) AS p1 FROM oc GROUP BY hash HAVING count(*) > 1)"""


def _occurrences(t: Tables) -> DataFrame:
    return clones.occurrences(clones.with_overlays(t.files, None))


@query("q_clone_classes", CLONE + " SELECT 'clone-' || substr(hash, 1, 16) AS class_id, files FROM cl")
def _(t):
    return clones.clone_classes(_occurrences(t))


FINDING = CLONE + ", fi AS (SELECT o.path, (SELECT min(x.path) FROM oc x WHERE x.hash = o.hash AND x.path <> o.path) AS peer_path, 'clone-' || substr(o.hash, 1, 16) AS class_id FROM oc o WHERE o.hash IN (SELECT hash FROM cl))"


@query("q_clone_findings", FINDING + " SELECT * FROM fi WHERE path LIKE 'src1%'")
def _(t):
    return clones.findings(written(_occurrences(t), "occurrences"), scope=t.files.where("path LIKE 'src1%'"))


@query("q_clone_introduced", FINDING + " SELECT * FROM fi WHERE path LIKE 'src3/%'")
def _(t):
    overlays = t.files.where("path LIKE 'src3/%'").select("path", F.lit("write").alias("action"), "content")
    found = written(clones.occurrences(clones.with_overlays(t.files, overlays)), "occurrences")
    return clones.findings(found, introduced_only=True)


PART = "(CASE WHEN o.path LIKE 'src0/%' THEN 0 WHEN o.path LIKE 'src1/%' OR o.path LIKE 'src2/%' THEN 1 END)"


@query("q_clone_partitioned", CLONE + f", pt AS (SELECT o.hash, o.path, {PART} AS part FROM oc o WHERE o.hash IN (SELECT hash FROM cl)) SELECT o.path, min(x.path) AS peer_path, 'clone-' || substr(o.hash, 1, 16) AS class_id FROM pt o JOIN pt x ON x.hash = o.hash AND x.part = o.part AND x.path <> o.path GROUP BY o.path, o.hash")
def _(t):
    return clones.findings(written(_occurrences(t), "occurrences"), partitions=[["src0/**"], ["src1/", "src2/**"]])


@query("q_clone_summary", FINDING + " SELECT (SELECT count(*) FROM files) AS files, (SELECT count(*) FROM cl) AS classes, (SELECT count(*) FROM fi) AS findings")
def _(t):
    found = written(_occurrences(t), "occurrences")
    return clones.clone_summary(t.files, found, clones.findings(found))


# Rules

EXPORTED = "attributes LIKE '%\"exported\":true%'"


@query("q_dead_exports", f" SELECT id FROM nodes WHERE kind IN ('Function', 'Class') AND {EXPORTED} AND id NOT IN (SELECT dst FROM edges WHERE kind = 'CALLS')")
def _(t):
    return checks.unused_exports(t.nodes, t.edges)


@query("q_dead_exports_reachable", REACHABLE + f" SELECT id FROM nodes WHERE kind IN ('Function', 'Class') AND {EXPORTED} AND id NOT IN (SELECT dst FROM edges WHERE kind = 'CALLS') AND id NOT IN (SELECT id FROM sy)")
def _(t):
    nodes, edges = t.nodes, t.edges
    entry = nodes.where("kind = 'File' AND path IN ('part/7', 'part/23')").select("id")
    return checks.unused_exports(nodes, edges, reachable=traverse.reachable_symbols(nodes, edges, entry))


@query("q_unused_files", _reach_sql("('IMPORTS_FROM')", True, "SELECT 'file:part/7' AS id", None) + " SELECT id FROM nodes WHERE kind = 'File' AND id IN (SELECT src FROM edges WHERE kind = 'CONTAINS') AND id NOT IN (SELECT dst FROM edges WHERE kind = 'IMPORTS_FROM') AND id NOT IN (SELECT id FROM r)")
def _(t):
    return checks.unused_files(t.nodes, t.edges, t.spark.createDataFrame([("file:part/7",)], "id string"))


@query("q_untested_surface", f" SELECT id FROM nodes WHERE kind IN ('Function', 'Method', 'Macro') AND {EXPORTED} AND id NOT IN (SELECT src FROM edges WHERE kind = 'TESTED_BY')")
def _(t):
    return checks.untested_surface(t.nodes, t.edges)


@query("q_untested_files", " SELECT DISTINCT path FROM nodes WHERE kind = 'File' AND path NOT IN (SELECT split_part(substr(src, strpos(src, ':') + 1), '#', 1) FROM edges WHERE kind = 'TESTED_BY')")
def _(t):
    return metrics.untested_files(t.nodes, t.edges)


@query("q_orphans", f" SELECT id FROM nodes WHERE kind = 'File' AND id NOT IN (SELECT src FROM edges WHERE kind IN {IMPORT_KINDS} UNION SELECT dst FROM edges WHERE kind IN {IMPORT_KINDS})")
def _(t):
    return checks.orphans(t.nodes, t.edges)


@query("q_missing_edges", " SELECT src, dst FROM edges WHERE kind = 'IMPORTS_FROM' AND length(src) % 3 = 0")
def _(t):
    edges = t.edges
    return checks.missing_edges(edges.where("kind = 'IMPORTS_FROM'"), edges.where("length(src) % 3 <> 0"))


@query("q_layer_rules", " SELECT name, src, dst FROM edges, (VALUES ('low', 'part/1%', 'part/2%', ['part/11%']), ('mid', '/part/5%', 'part/_%', ['part/5%9'])) AS p(name, f, t, n) WHERE kind = 'IMPORTS_FROM' AND name = 'low' AND substr(src, 6) LIKE 'part/1%' AND substr(dst, 6) LIKE 'part/2%' AND NOT substr(src, 6) LIKE 'part/11%' UNION ALL SELECT 'mid', src, dst FROM edges WHERE kind = 'IMPORTS_FROM' AND substr(src, 6) LIKE 'part/5%' AND substr(dst, 6) LIKE 'part/9%' AND NOT substr(src, 6) LIKE 'part/5%9'")
def _(t):
    rules = [("low", "part/1%", "part/2%", ["part/11%"]), ("mid", "/part/5%", "part/9%", ["part/5%9"])]
    return checks.layer_violations(t.edges, t.spark.createDataFrame(rules, "name string, from_pat string, to_pat string, from_not array<string>"))


@query("q_relevant_tests", ", tp AS (SELECT split_part(substr(src, strpos(src, ':') + 1), '#', 1) AS p FROM edges WHERE kind = 'TESTED_BY' UNION SELECT split_part(substr(dst, strpos(dst, ':') + 1), '#', 1) FROM edges WHERE kind = 'TESTED_BY') SELECT DISTINCT path, path IN (SELECT p FROM tp) AS tested FROM nodes WHERE kind = 'File'")
def _(t):
    return checks.relevant_tests(t.nodes, t.edges)


LINES = r"CASE WHEN content IS NULL OR content = '' THEN 0 ELSE len(string_split(regexp_replace(regexp_replace(content, '\r\n?', chr(10), 'g'), '\n\z', ''), chr(10))) END"


@query("q_file_length", f" SELECT path, CAST({LINES} AS BIGINT) AS lines FROM files WHERE {LINES} > 12")
def _(t):
    return checks.long_files(t.files, 12)


LINE_ROWS = r", lr AS (SELECT path, unnest(string_split_regex(content, '\r?\n')) AS raw, generate_subscripts(string_split_regex(content, '\r?\n'), 1) AS ln FROM files)"
HYGIENE = {"SECRET": r"(?i)(password|token)\s*=", "SHOUT": r"[A-Z]{6,}!!"}


@query("q_hygiene", LINE_ROWS + " SELECT path, CAST(ln AS BIGINT) AS line, 'SECRET' AS code FROM lr WHERE regexp_matches(raw, '" + HYGIENE["SECRET"] + "') UNION ALL SELECT path, CAST(ln AS BIGINT), 'SHOUT' FROM lr WHERE regexp_matches(raw, '" + HYGIENE["SHOUT"] + "')")
def _(t):
    return checks.line_hits(t.files, HYGIENE)


@query("q_docs_length", LINE_ROWS + rf""", lt AS (SELECT * FROM (SELECT path, raw, ln, max(ln) OVER (PARTITION BY path) AS most FROM lr) z WHERE NOT (ln = most AND raw = '' AND ln > 1)),
  se AS (SELECT path, sum(CASE WHEN regexp_matches(raw, '^The ') THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY ln) AS s FROM lt),
  lo AS (SELECT path, max(n) AS n FROM (SELECT path, s, count(*) AS n FROM se GROUP BY path, s) y GROUP BY path)
  SELECT path, 'DOCS_TOO_SHORT' AS code, CAST(length(trim(regexp_replace(content, '^\s+|\s+$', '', 'g'))) AS BIGINT) AS amount FROM files WHERE length(trim(regexp_replace(content, '^\s+|\s+$', '', 'g'))) < 200
  UNION ALL SELECT path, 'DOCS_TOO_LONG', CAST({LINES} AS BIGINT) FROM files WHERE {LINES} > 15 UNION ALL SELECT path, 'DOCS_SECTION_TOO_LONG', n FROM lo WHERE n > 12""")
def _(t):
    return checks.docs_length(t.files, least_chars=200, most_lines=15, most_section=12, heading=r"^The ")


@query("q_docs_dry", r""", pr AS (SELECT path, generate_subscripts(string_split_regex(content, '\n'), 1) AS ln, trim(regexp_replace(unnest(string_split_regex(content, '\n')), '\s+', ' ', 'g'), ' ') AS p FROM files),
  ok AS (SELECT * FROM pr WHERE length(p) >= 80 AND NOT starts_with(p, '```')), fs AS (SELECT p, min(path) AS fp FROM ok GROUP BY p), hi AS (SELECT ok.path, ln, fp FROM ok JOIN fs USING (p) WHERE ok.path > fp)
  SELECT path, arg_min(fp, ln) AS first_path FROM hi GROUP BY path""")
def _(t):
    return checks.docs_dry(t.files.withColumn("content", F.regexp_replace("content", "\n", "\n\n")))


QUALITY = {"PLACEHOLDER": r"(?i)\b(license|lorem)\b", "MARKER": r"^The "}


@query("q_docs_quality", LINE_ROWS + " SELECT path, CAST(ln AS BIGINT) AS line, 'PLACEHOLDER' AS code FROM lr WHERE regexp_matches(raw, '" + QUALITY["PLACEHOLDER"] + "') UNION ALL SELECT path, CAST(ln AS BIGINT), 'MARKER' FROM lr WHERE regexp_matches(raw, '^The ')")
def _(t):
    return checks.line_hits(t.files, QUALITY)


@query("q_docs_fences", LINE_ROWS + " SELECT path, CAST(max(ln) AS BIGINT) AS line FROM lr WHERE starts_with(ltrim(raw, ' '), 'The ') GROUP BY path HAVING count(*) % 2 = 1")
def _(t):
    return checks.open_fences(t.files, "The ")


@query("q_docs_rules_why", LINE_ROWS + r" SELECT path, CAST(ln AS BIGINT) AS line FROM lr WHERE regexp_matches(trim(raw, ' '), '^(?:[-*]\s*)?(The|Der|Les|La)( |$)') AND NOT regexp_matches(raw, '\bWHY:') AND NOT regexp_matches(raw, '(?i)\bbecause\b')")
def _(t):
    return checks.rules_without_why(t.files, r"^(?:[-*]\s*)?(The|Der|Les|La)( |$)")


HUBS = """, fi AS (SELECT path, CAST(sum(i) AS BIGINT) AS fan_in, CAST(sum(o) AS BIGINT) AS fan_out FROM (SELECT substr(dst, 6) AS path, 1 AS i, 0 AS o FROM edges WHERE kind = 'IMPORTS_FROM' UNION ALL SELECT substr(src, 6), 0, 1 FROM edges WHERE kind = 'IMPORTS_FROM') y GROUP BY path)"""


@query("q_hubs", HUBS + " SELECT * FROM fi WHERE fan_in >= 3 OR fan_out >= 4")
def _(t):
    return checks.hubs(t.edges, 3, 4)


@query("q_hub_coverage", HUBS + ", sa AS (SELECT DISTINCT rtrim(unnest(regexp_extract_all(content, '[A-Za-z0-9_./-]+')), '.') AS said FROM files) SELECT path FROM fi WHERE (fan_in >= 3 OR fan_out >= 4) AND path NOT IN (SELECT said FROM sa) AND split_part(path, '/', -1) NOT IN (SELECT said FROM sa)")
def _(t):
    return checks.unmentioned(checks.hubs(t.edges, 3, 4).select("path"), t.files)


@query("q_subtree_loc", f" SELECT split_part(path, '/', 1) AS subtree, CAST(sum({LINES}) AS BIGINT) AS loc FROM files GROUP BY 1 HAVING sum({LINES}) >= 300")
def _(t):
    return checks.subtrees(t.files, 300)


@query("q_stale_refs", r", rf AS (SELECT DISTINCT path, unnest(regexp_extract_all(content, 'AKIA([A-Z0-9]{4})', 1)) AS ref FROM files) SELECT path, ref FROM rf WHERE ref NOT IN (SELECT path FROM nodes WHERE path IS NOT NULL)")
def _(t):
    return checks.stale_references(t.files, t.nodes.where("path IS NOT NULL"), r"AKIA([A-Z0-9]{4})")


@query("q_docs_existence", " SELECT DISTINCT source AS root FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE doc_id % 100 = 7)")
def _(t):
    roots = t.documents.select(F.col("source").alias("root"))
    names = t.files.where("doc_id % 100 = 7").select(F.concat(F.regexp_replace("path", "[^/]+$", ""), F.lit("README.md")).alias("path"))
    return checks.docs_existence(roots, names, ["README.md"])


HISTORY = ", hs AS (SELECT concat('user/', user_id) AS path, event_type AS root, ts AS committed_at, event_id FROM events)"


def _commits(t: Tables) -> DataFrame:
    return t.events.select(F.concat(F.lit("user/"), "user_id").alias("path"), F.col("event_type").alias("root"), F.col("ts").alias("committed_at"), "event_id")


@query("q_docs_staleness", HISTORY + " SELECT path, (epoch(TIMESTAMP '2024-02-01') - epoch(max(date_trunc('second', committed_at)))) / 86400 AS days FROM hs GROUP BY path HAVING (epoch(TIMESTAMP '2024-02-01') - epoch(max(date_trunc('second', committed_at)))) / 86400 > 2")
def _(t):
    return checks.stale_by_age(_commits(t), "2024-02-01 00:00:00", 2)


@query("q_docs_freshness", HISTORY + ", d AS (SELECT root, max(committed_at) AS doc_at FROM hs WHERE event_id % 3 = 0 GROUP BY root), s AS (SELECT root, max(committed_at) AS source_at FROM hs WHERE event_id % 3 <> 0 GROUP BY root) SELECT root, (SELECT min(path) FROM hs WHERE hs.root = d.root AND committed_at = source_at AND event_id % 3 <> 0) AS path FROM d JOIN s USING (root) WHERE doc_at < source_at")
def _(t):
    c = _commits(t)
    return checks.newer_source(c.where("event_id % 3 = 0"), c.where("event_id % 3 <> 0")).select("root", "path")


# Framework

DIAGNOSTICS = ", dg AS (SELECT 'docs.length' AS check_id, 'policy' AS category, CASE WHEN length(content) < 80 THEN 'error' ELSE 'warning' END AS severity, path, 'SHORT' AS code, length(content) AS n, doc_id FROM files WHERE length(content) < 400)"


def _diagnostics(t: Tables, most: int) -> DataFrame:
    d = t.files.where(F.length("content") < most)
    none = F.lit(None).cast("int")
    return d.select(
        F.lit("docs.length").alias("check_id"), F.lit("policy").alias("category"), F.when(F.length("content") < 80, "error").otherwise("warning").alias("severity"), "path", F.lit("SHORT").alias("code"),
        none.alias("line"), none.alias("col"), none.alias("end_line"), none.alias("end_col"), F.length("content").cast("string").alias("message"), "doc_id",
    )


@query("q_introduced", DIAGNOSTICS + " SELECT path, severity FROM dg WHERE n >= 200")
def _(t):
    return framework.introduced(_diagnostics(t, 400), _diagnostics(t, 200)).select("path", "severity")


@query("q_overlay_view", " SELECT path, CASE WHEN doc_id % 5 = 2 THEN 'new' ELSE content END AS content FROM files WHERE doc_id % 5 <> 1 UNION ALL SELECT 'added.md', 'x'")
def _(t):
    rows = t.files.where("doc_id % 5 IN (1, 2)").select("path", F.when(F.col("doc_id") % 5 == 1, "delete").otherwise("write").alias("action"), F.lit("new").alias("content"), F.lit(1).alias("seq"))
    more = t.spark.createDataFrame([("added.md", "write", "x", 2), ("added.md", "delete", None, 1)], "path string, action string, content string, seq int")
    return framework.file_view(t.files, rows.unionByName(more))


@query("q_run_status", DIAGNOSTICS + " SELECT 'docs.length' AS check_id, CASE WHEN count(*) FILTER (severity = 'error') > 0 THEN 'policy_failure' ELSE 'passed' END AS status, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings FROM dg UNION ALL SELECT 'x.skip', 'skipped', 0, 0 UNION ALL SELECT 'y.clean', 'passed', 0, 0")
def _(t):
    runs = t.spark.createDataFrame([("docs.length", "ran"), ("x.skip", "skipped"), ("y.clean", "ran")], "check_id string, outcome string")
    return framework.run_status(runs, _diagnostics(t, 400))


@query("q_status_rollup", " SELECT CASE WHEN count(*) > 0 THEN 'policy_failure' ELSE 'passed' END AS status FROM files WHERE length(content) < 80")
def _(t):
    runs = t.spark.createDataFrame([("docs.length", "ran"), ("x.skip", "skipped")], "check_id string, outcome string")
    return framework.rollup(framework.run_status(runs, _diagnostics(t, 400)))


@query("q_scope_package", " SELECT path FROM files WHERE starts_with(path, 'src7/')")
def _(t):
    return framework.scope_files(framework.package_files(t.files, "src7"))


@query("q_last_by_key", " SELECT lang, source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id DESC) AS n FROM documents) y WHERE n = 1")
def _(t):
    return framework.last_by_key(t.documents, ["lang", "source"], "doc_id").select("lang", "source", "doc_id")


# Metrics

SIGNAL_RULES = (("short", "error", {"code": "SHO%"}), ("notes", "warning", {"category": "policy", "ext": ("md",)}), ("never", "error", {"code": "NONE"}))


@query("q_signals", DIAGNOSTICS + " SELECT 'short' AS signal_id, 'error' AS severity, count(*) AS count, min(path) AS first_path FROM dg UNION ALL SELECT 'notes', 'warning', count(*), min(path) FROM dg")
def _(t):
    return metrics.signals(_diagnostics(t, 400), SIGNAL_RULES)


@query("q_god_files", " SELECT coalesce(n.path, split_part(substr(src, strpos(src, ':') + 1), '#', 1)) AS path, count(*) AS contained FROM edges e LEFT JOIN nodes n ON n.id = e.src WHERE e.kind = 'CONTAINS' GROUP BY 1 HAVING count(*) > 5")
def _(t):
    return metrics.god_files(t.nodes, t.edges, 5)


@query("q_fan_in", " SELECT substr(dst, 6) AS path, count(DISTINCT src) AS importers FROM edges WHERE kind = 'IMPORTS_FROM' GROUP BY 1 HAVING count(DISTINCT src) > 3")
def _(t):
    return metrics.fan_in(t.edges, 3)


@query("q_signal_delta", """, pl AS (SELECT report_id, max(sequence) AS pos FROM history GROUP BY report_id), rk AS (SELECT report_id, row_number() OVER (ORDER BY pos DESC, report_id DESC) AS r, row_number() OVER (ORDER BY pos, report_id) AS f FROM pl),
  v AS (SELECT signal_id, sum(amount) FILTER (r = 1) AS c, sum(amount) FILTER (r = 2) AS p, sum(amount) FILTER (f = 1 AND r <> 1) AS b FROM history JOIN rk USING (report_id) GROUP BY signal_id)
  SELECT signal_id, CAST(c AS BIGINT) AS current, CAST(p AS BIGINT) AS previous, CAST(b AS BIGINT) AS baseline, CAST(coalesce(c, 0) - coalesce(p, 0) AS BIGINT) AS previous_delta, CAST(coalesce(c, 0) - coalesce(b, 0) AS BIGINT) AS baseline_delta FROM v WHERE c IS NOT NULL OR p IS NOT NULL OR b IS NOT NULL""")
def _(t):
    return metrics.signal_delta(t.history)


BUDGET_ROWS = [("click", "warm", "medium", 50.0), ("view", "cold", "medium", 20.0), ("purchase", "warm", "large", 90.0), ("click", "cold", "large", 10.0)]
BUDGETS = ", bg AS (SELECT * FROM (VALUES " + ", ".join(f"('{c}', '{s}', '{b}', {m})" for c, s, b, m in BUDGET_ROWS) + ") AS b(command, scope, bucket, budget_ms))"
OBSERVED = BUDGETS + ", ob AS (SELECT r.command, r.state, r.bucket, recorded_at, record_id, duration_ms, budget_ms FROM latency_records r LEFT JOIN bg ON bg.command = r.command AND scope = state AND bg.bucket = r.bucket)"


def _observed(t: Tables) -> DataFrame:
    budgets = t.spark.createDataFrame([(*r, None) for r in BUDGET_ROWS], "command string, scope string, bucket string, budget_ms double, phase_budgets array<struct<phase:string,budget_ms:double>>")
    return metrics.latency_observations(t.latency_records, budgets)


@query("q_latency_obs", OBSERVED + " SELECT record_id, command, state, bucket, 'total' AS phase, duration_ms, budget_ms FROM ob")
def _(t):
    return _observed(t).select("record_id", "command", "state", "bucket", "phase", "duration_ms", "budget_ms")


LATENCY = OBSERVED + """, rw AS (SELECT *, row_number() OVER (PARTITION BY command, state, bucket ORDER BY recorded_at DESC, record_id DESC) AS l, row_number() OVER (PARTITION BY command, state, bucket ORDER BY recorded_at, record_id) AS f FROM ob),
  gr AS (SELECT command, state, bucket, max(duration_ms) FILTER (l = 1) AS current_ms, max(budget_ms) FILTER (l = 1) AS budget_ms, max(duration_ms) FILTER (l = 2) AS p, max(duration_ms) FILTER (f = 1 AND l <> 1) AS b FROM rw GROUP BY command, state, bucket),
  fd AS (SELECT command, state, bucket, current_ms, budget_ms, current_ms - p AS previous_delta_ms, current_ms - b AS baseline_delta_ms, CASE WHEN budget_ms IS NOT NULL THEN greatest(0, current_ms - budget_ms) END AS over_budget_ms FROM gr),
  fs AS (SELECT *, CASE WHEN over_budget_ms > 0 THEN 'over_budget' WHEN previous_delta_ms > 0 OR baseline_delta_ms > 0 THEN 'slower' ELSE 'ok' END AS status FROM fd)"""


@query("q_latency_groups", LATENCY + " SELECT command, state, bucket, 'total' AS phase, current_ms, budget_ms, previous_delta_ms, baseline_delta_ms, over_budget_ms, status FROM fs")
def _(t):
    return metrics.latency_groups(_observed(t))


@query("q_latency_findings", LATENCY + " SELECT command, state, bucket, status, current_ms FROM fs WHERE status <> 'ok' ORDER BY coalesce(over_budget_ms, 0) DESC, coalesce(previous_delta_ms, 0) DESC, coalesce(baseline_delta_ms, 0) DESC, command, current_ms DESC LIMIT 20")
def _(t):
    return metrics.latency_findings(_observed(t)).select("command", "state", "bucket", "status", "current_ms")


@query("q_budget_gate", OBSERVED + " SELECT CASE WHEN budget_ms IS NULL THEN 'skipped' WHEN duration_ms > budget_ms THEN 'over' ELSE 'pass' END AS status, count(*) AS n FROM ob GROUP BY 1")
def _(t):
    return metrics.budget_gate(_observed(t))


@query("q_telemetry_ring", ", nw AS (SELECT event_id, octet_length(CAST(props AS BLOB)) + 1 AS b, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 500), ac AS (SELECT event_id, sum(b) OVER (ORDER BY ts DESC, event_id DESC) AS a FROM nw) SELECT event_id FROM ac WHERE a <= 3000")
def _(t):
    return metrics.ring(t.events, ["ts", "event_id"], "props", 500, 3000).select("event_id")


COVERED = ", cf AS (SELECT 'p/' || page_id || CASE page_id % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.go' WHEN 2 THEN '.rs' ELSE '' END AS path, CASE page_id % 4 WHEN 0 THEN 'py' WHEN 1 THEN 'go' WHEN 2 THEN 'rs' ELSE '' END AS ext FROM pages)"


@query("q_coverage", COVERED + ", rn AS (SELECT *, row_number() OVER (PARTITION BY ext ORDER BY path) AS n FROM cf) SELECT ext, count(*) AS files, ext IN ('py', 'rs') AS supported, string_agg(path, ',' ORDER BY path) FILTER (n <= 3) AS examples FROM rn GROUP BY ext")
def _(t):
    end = F.element_at(F.array(F.lit(".py"), F.lit(".go"), F.lit(".rs"), F.lit("")), (F.col("page_id") % 4 + 1).cast("int"))
    return metrics.coverage(t.pages.select(F.concat(F.lit("p/"), F.col("page_id").cast("string"), end).alias("path")), ("py", "rs"))


@query("q_repo_scan_rules", " SELECT path, CASE WHEN path LIKE 'src1/%' AND NOT path LIKE 'src1/1%' THEN true ELSE false END AS ignored, CAST(NULL AS VARCHAR) AS language FROM files")
def _(t):
    rules = repo.ignore_rules(["src1/", "!src1/1*", "# note"])
    return t.files.select("path", repo.is_ignored(F.col("path"), rules).alias("ignored"), repo.language(F.col("path")).alias("language"))


@query("q_census", " SELECT path, sha256(content) AS sha256 FROM files WHERE split_part(path, '/', 1) NOT IN ('src2', 'src3')")
def _(t):
    return repo.census(t.files, ("src2", "src3")).select("path", F.sha2("content", 256).alias("sha256"))


@query("q_line_counts", f" SELECT path, CAST({LINES} AS BIGINT) AS lines FROM files")
def _(t):
    return t.files.select("path", line_count(F.col("content")).alias("lines"))


# Store and streams

#: Kinds of edges that are written one after another.
EDGE_KINDS = ["IMPORTS_FROM", "DEPENDS_ON", "CONTAINS", "CALLS", "TESTED_BY", "INHERITS"]


@query("q_incremental_equals_full", " SELECT 'nodes' AS \"table\", CAST(0 AS BIGINT) AS differences UNION ALL SELECT 'edges', 0 UNION ALL SELECT 'file_hashes', 0")
def _(t):
    from factloom.functions.paths import path_from_id
    from factloom.operators.store import FactStore, StoreError, differences, missing_ends, without

    nodes, edges = (getattr(t, x) if t.has(x) else view(t.spark, t.sf_dir, x) for x in ("nodes", "edges"))
    root = new_path(t.spark, "store")
    store = FactStore(t.spark, root)
    with shuffles_dropped(t.spark):
        # Edges by kind, so that only one kind's rows are shuffled at a time; the last part is of any other kind.
        parts = [edges.where(F.col("kind") == k) for k in EDGE_KINDS] + [edges.where(~F.col("kind").isin(EDGE_KINDS))]
        full = {"nodes": nodes, "edges": parts, "file_hashes": nodes.where("kind = 'File'").select("path", F.sha2("path", 256).alias("sha256"))}
        try:
            store.replace(full)
        except StoreError:  # some ends don't exist; the facts are then the edges that have both
            lost = missing_ends(nodes, edges)
            full["edges"] = [without(x, lost) for x in parts]
            store.replace(full)
        now = {name: store.read(name) for name in full}
        touched = written(now["nodes"].where("path LIKE 'part/1%'").select("path").distinct(), "touched")
        new = now["nodes"].join(touched, "path", "left_semi").select("id", "kind", "path", "name", "attributes")
        some = now["edges"].withColumn("path", path_from_id(F.col("src"))).join(touched, "path", "left_semi").select("id", "kind", "src", "dst")
        store.update(new, some, now["file_hashes"].join(touched, "path", "left_semi").select("path", "sha256"), touched)
        found = [(name, differences(store.read(name), full[name])) for name in full]
    return t.spark.createDataFrame(found, "table string, differences long")


@query("q_stream_latency", ", z AS (SELECT max(recorded_at) - INTERVAL 1 HOUR AS mark FROM latency_records) SELECT date_trunc('day', recorded_at) AS window_start, command, count(*) AS n, avg(duration_ms) AS mean_ms, max(duration_ms) AS max_ms FROM latency_records, z WHERE date_trunc('day', recorded_at) + INTERVAL 1 DAY <= mark GROUP BY 1, 2")
def _(t):
    from factloom.streaming.latency import latency_windows, run_available

    base = new_path(t.spark, "stream")
    records = t.latency_records.withColumn("recorded_at", F.col("recorded_at").cast("timestamp"))
    records.write.parquet(f"{base}/in")
    schema = records.schema
    stream = t.spark.readStream.schema(schema).parquet(f"{base}/in")
    run_available(latency_windows(stream), f"{base}/out", f"{base}/checkpoint")
    return t.spark.read.parquet(f"{base}/out")


@query("q_latency_windows", " SELECT date_trunc('day', recorded_at) AS window_start, command, count(*) AS n, avg(duration_ms) AS mean_ms, max(duration_ms) AS max_ms FROM latency_records GROUP BY 1, 2")
def _(t):
    from factloom.streaming.latency import latency_windows

    return latency_windows(t.latency_records)
