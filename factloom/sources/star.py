"""The driver's tables as facts: nodes, edges, files and records.

Everything is a projection or one window per order, so filters and columns reach the Parquet scan. The fact graph is over
all orders and line items.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.plans.durable import new_path

T = TypeVar("T")

#: Views by name; each is SQL that Spark and DuckDB both run over the driver's tables.
VIEWS = {
    "seq": """SELECT o, n, p, s, f, lead(p) OVER (PARTITION BY o ORDER BY n, p, s) AS np, lead(s) OVER (PARTITION BY o ORDER BY n, p, s) AS ns
      FROM (SELECT l_orderkey AS o, l_linenumber AS n, l_partkey AS p, l_suppkey AS s, l_returnflag AS f FROM lineitem) x""",
    "edges0": """SELECT DISTINCT 'IMPORTS_FROM' AS kind, concat('file:part/', p) AS src, concat('file:part/', np) AS dst FROM seq WHERE np IS NOT NULL AND p <> np
      UNION ALL SELECT DISTINCT 'DEPENDS_ON', concat('file:part/', p), concat('file:part/', np) FROM seq WHERE np IS NOT NULL AND p <> np
      UNION ALL SELECT DISTINCT 'CONTAINS', concat('file:part/', p), concat('function:part/', p, '#', s) FROM seq
      UNION ALL SELECT DISTINCT 'CALLS', concat('function:part/', p, '#', s), concat('function:part/', np, '#', ns) FROM seq WHERE np IS NOT NULL AND (p <> np OR s <> ns)
      UNION ALL SELECT DISTINCT 'TESTED_BY', concat('function:part/', p, '#', s), concat('test:order/', o, '#returns') FROM seq WHERE f = 'R'
      UNION ALL SELECT DISTINCT 'CONTAINS', concat('file:order/', o), concat('test:order/', o, '#returns') FROM seq WHERE f = 'R'
      UNION ALL SELECT 'CONTAINS', concat('module:region/', n_regionkey), concat('module:nation/', n_nationkey) FROM nation
      UNION ALL SELECT 'CONTAINS', concat('module:nation/', c_nationkey), concat('module:customer/', c_custkey) FROM customer
      UNION ALL SELECT 'CONTAINS', concat('module:customer/', o_custkey), concat('file:order/', o_orderkey) FROM orders
      UNION ALL SELECT 'CONTAINS', concat('file:part/', p_partkey), concat('class:part/', p_partkey, '#Part') FROM part
      UNION ALL SELECT 'INHERITS', concat('class:part/', p_partkey, '#Part'), concat('class:brand/', p_brand, '#Brand') FROM part
      UNION ALL SELECT 'INHERITS', concat('class:brand/', p_brand, '#Brand'), concat('class:type/', min(p_type), '#Type') FROM part GROUP BY p_brand""",
    "edges": "SELECT concat('edge:', kind, ':', src, '->', dst) AS id, kind, src, dst FROM edges0",
    "nodes": f"""SELECT concat('file:part/', p_partkey) AS id, 'File' AS kind, concat('part/', p_partkey) AS path, CAST(NULL AS STRING) AS name, CAST(NULL AS STRING) AS attributes FROM part
      UNION ALL SELECT concat('class:part/', p_partkey, '#Part'), 'Class', concat('part/', p_partkey), p_name, concat('{{"exported":', CASE WHEN p_size % 2 = 0 THEN 'true' ELSE 'false' END, '}}') FROM part
      UNION ALL SELECT DISTINCT concat('class:brand/', p_brand, '#Brand'), 'Class', concat('brand/', p_brand), p_brand, '{{"exported":true}}' FROM part
      UNION ALL SELECT concat('class:type/', t, '#Type'), 'Class', concat('type/', t), t, '{{"exported":true}}' FROM (SELECT DISTINCT min(p_type) AS t FROM part GROUP BY p_brand) y
      UNION ALL SELECT concat('function:part/', p, '#', s), 'Function', concat('part/', p), concat('supply', s), concat('{{"exported":', CASE WHEN p_size % 2 = 0 THEN 'true' ELSE 'false' END, '}}') FROM (SELECT DISTINCT p, s FROM seq) z JOIN part ON p_partkey = p
      UNION ALL SELECT concat('file:order/', o_orderkey), 'File', concat('order/', o_orderkey), CAST(NULL AS STRING), CAST(NULL AS STRING) FROM orders
      UNION ALL SELECT DISTINCT concat('test:order/', o, '#returns'), 'Test', concat('order/', o), 'returns', '{{"isTest":true}}' FROM seq WHERE f = 'R'
      UNION ALL SELECT concat('module:region/', r_regionkey), 'Module', concat('region/', r_regionkey), r_name, CAST(NULL AS STRING) FROM region
      UNION ALL SELECT concat('module:nation/', n_nationkey), 'Module', concat('nation/', n_nationkey), n_name, CAST(NULL AS STRING) FROM nation
      UNION ALL SELECT concat('module:customer/', c_custkey), 'Module', concat('customer/', c_custkey), c_name, CAST(NULL AS STRING) FROM customer""",
    "files": "SELECT concat(source, '/', doc_id, '.md') AS path, text AS content, doc_id FROM documents",
    "current_hashes": "SELECT path, sha2(content, 256) AS sha256 FROM files",
    "stored_hashes": """SELECT CASE WHEN doc_id % 11 = 2 THEN concat('old/', path) ELSE path END AS path,
        CASE WHEN doc_id % 7 = 1 THEN sha2(concat(content, 'x'), 256) ELSE sha2(content, 256) END AS sha256 FROM files WHERE doc_id % 10 <> 0
      UNION ALL SELECT concat('gone/', doc_id, '.md'), sha2(concat(content, 'y'), 256) FROM files WHERE doc_id % 13 = 5""",
    "latency_records": """SELECT event_id AS record_id, event_type AS command, CASE WHEN user_id % 2 = 0 THEN 'warm' ELSE 'cold' END AS state, ts AS recorded_at,
        CASE WHEN user_id * 100 <= 100 THEN 'small' WHEN user_id * 100 <= 5000 THEN 'medium' ELSE 'large' END AS bucket, value AS duration_ms FROM events""",
    # Source files made from the tables by a rule: a module for each part, supplier and nation, which imports another one.
    "py_links": "SELECT p_partkey AS k, q FROM part LEFT JOIN (SELECT p AS a, min(np) AS q FROM seq WHERE np IS NOT NULL AND p <> np GROUP BY p) y ON a = p_partkey",
    "ts_links": "SELECT x.s_suppkey AS k, y.s_suppkey AS q FROM supplier x LEFT JOIN supplier y ON y.s_suppkey = x.s_suppkey + 1 AND x.s_suppkey % 4 <> 0",
    "rs_links": "SELECT x.n_nationkey AS k, y.n_nationkey AS q FROM nation x LEFT JOIN nation y ON y.n_nationkey = x.n_nationkey + 1 AND x.n_nationkey % 5 < 2",
    "code_files": """SELECT concat('pkg/m', k, '.py') AS path, concat('import os', chr(10), CASE WHEN q IS NULL THEN concat('class C', k, ':', chr(10), '    def go(self):', chr(10), '        return 1')
        ELSE concat('from pkg.m', q, ' import f', q, ', C', q, chr(10), chr(10), chr(10), 'class C', k, '(C', q, '):', chr(10), '    def go(self):', chr(10), '        return f', q, '(1)') END, chr(10), chr(10), chr(10),
        'def f', k, '(x):', chr(10), '    return len(x) if x else 0', chr(10), chr(10), chr(10), 'def _hidden', k, '():', chr(10), '    return f', k, '(2)', chr(10), chr(10), chr(10), 'def test_f', k, '():', chr(10), '    f', k, '(3)', chr(10)) AS content FROM py_links
      UNION ALL SELECT concat('web/s', k, '.ts'), concat(CASE WHEN q IS NULL THEN '' ELSE concat('import { run', q, ' } from "./s', q, '";', chr(10)) END, 'export interface Shape', k, ' {', chr(10), '  size: number;', chr(10), '}', chr(10),
        'export interface Loose', k, ' {', chr(10), '}', chr(10), 'export class Box', k, ' implements Shape', k, ' {', chr(10), '}', chr(10), 'export function run', k, '() {', chr(10), '  return ', CASE WHEN q IS NULL THEN '1' ELSE concat('run', q, '()') END, ';', chr(10), '}', chr(10),
        'test("runs ', k, '", () => {', chr(10), '  run', k, '();', chr(10), '});', chr(10)) FROM ts_links
      UNION ALL SELECT concat('rs/src/n', k, '.rs'), concat(CASE WHEN k % 2 = 1 THEN concat('#![allow(warnings, dead_code)]', chr(10)) ELSE '' END, CASE WHEN q IS NULL THEN '' ELSE concat('use crate::n', q, '::go', q, ';', chr(10)) END,
        'pub struct S', k, ';', chr(10), 'pub trait T', k, ' {}', chr(10), 'impl T', k, ' for S', k, ' {}', chr(10), 'pub fn go', k, '() {}', chr(10), CASE WHEN k % 3 = 0 THEN concat('include!("n', k, '.inc");', chr(10)) ELSE '' END) FROM rs_links
      UNION ALL SELECT concat('go/r', r_regionkey, '.go'), 'package r' FROM region""",
    "history": "SELECT conv_id AS report_id, role AS signal_id, turn AS sequence, CAST(length(text) AS BIGINT) AS amount FROM conversations",
}

NEEDS = {
    "seq": ("lineitem",), "edges0": ("seq", "nation", "customer", "orders", "part"), "edges": ("edges0",), "nodes": ("seq", "part", "orders", "region", "nation", "customer"),
    "files": ("documents",), "current_hashes": ("files",), "stored_hashes": ("files",), "latency_records": ("events",), "history": ("conversations",),
    "py_links": ("part", "seq"), "ts_links": ("supplier",), "rs_links": ("nation",), "code_files": ("py_links", "ts_links", "rs_links", "region"),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view, or a driver table, as a DataFrame; nothing is registered in the session's catalogue."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = VIEWS[name].replace("{", "{{").replace("}", "}}")
    for n in NEEDS[name]:
        sql = re.sub(rf"\b(FROM|JOIN) {n}\b", rf"\1 {{{n}}}", sql)
    return spark.sql(sql, **{n: view(spark, sf_dir, n) for n in NEEDS[name]})


_stored: dict[tuple[str, str, str], object] = {}


def once(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], T]) -> T:
    """What `make` gives for a folder, made once for each application. What changes in the folder later isn't seen."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _stored:
        _stored[key] = make()
    return _stored[key]


def made(spark: SparkSession, sf_dir: str, name: str) -> bool:
    """Whether `once` has made it."""
    return (spark.sparkContext.applicationId, sf_dir, name) in _stored


def stored(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The nodes or edges of a folder, built once for each application into the shared folder, as a fact store is: by kind, in order of ids.

    A query by kind reads that kind's files alone, and one by ids skips row groups.
    """

    def make() -> str:
        path = new_path(spark, name)
        df = view(spark, sf_dir, name)
        df.repartition("kind", F.hash("id") % 8).sortWithinPartitions("kind", "dst" if name == "edges" else "id").write.partitionBy("kind").parquet(path)
        return path

    columns = ["id", "kind", "src", "dst"] if name == "edges" else ["id", "kind", "path", "name", "attributes"]
    return spark.read.schema(", ".join(f"{c} string" for c in columns)).parquet(once(spark, sf_dir, name, make)).select(*columns)


def oracle_views() -> str:
    """The views as a WITH clause for DuckDB, without the word WITH."""
    out = []
    for name, sql in VIEWS.items():
        sql = sql.replace("CAST(NULL AS STRING)", "CAST(NULL AS VARCHAR)")
        sql = re.sub(r"sha2\((concat\([^()]*\)|\w+), 256\)", r"sha256(\1)", sql)
        out.append(f"{name} AS ({sql})")
    return ",\n".join(out)
