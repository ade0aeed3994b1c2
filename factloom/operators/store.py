"""The fact store: snapshots as Parquet folders with a pointer, replaced whole or by increments.

An increment is a layer on the snapshot before it: the new rows, the touched paths and the lost edges, so that what stays
isn't written again. Replacing the whole ends the layers. An edge's id that follows from its kind and ends is stored as null.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions.paths import edge_id, path_from_id
from factloom.plans.durable import delete, shuffles_dropped, written

TABLES = {
    "nodes": "id string, kind string, path string, name string, attributes string",
    "edges": "id string, kind string, src string, dst string",
    "file_hashes": "path string, sha256 string",
}
VERSION = 1
#: Missing ends up to which they go to all tasks that read edges; buckets in which tables are compared.
FEW_MISSING, BUCKETS = 100_000, 512
#: Touched paths, and bytes in them, up to which they go to all tasks.
FEW_PATHS, FEW_BYTES = 1_000_000, 32 << 20


class StoreError(Exception):
    """A store that isn't what its version says, or a snapshot that can't be written."""


def missing_ends(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(src) of ends that don't exist, to go to all tasks if few. Ends are made distinct first, so edges aren't shuffled."""
    ends = edges.select("src").unionByName(edges.select(F.col("dst").alias("src"))).distinct()
    missing = written(ends.join(nodes.select(F.col("id").alias("src")), "src", "left_anti"), "missing")
    return F.broadcast(missing) if missing.count() <= FEW_MISSING else missing


def dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id) of edges with an end that doesn't exist."""
    lost = missing_ends(nodes, edges)
    return edges.join(lost, "src", "left_semi").select("id").unionByName(edges.join(lost.withColumnRenamed("src", "dst"), "dst", "left_semi").select("id")).distinct()


def without(edges: DataFrame, lost: DataFrame) -> DataFrame:
    """Edges with no end among the lost (src)."""
    for end in ("src", "dst"):
        edges = edges.join(lost.withColumnRenamed("src", end), end, "left_anti").select(*edges.columns)
    return edges


def parts_of(table: DataFrame | Sequence[DataFrame]) -> list[DataFrame]:
    return [table] if isinstance(table, DataFrame) else list(table)


def differences(a: DataFrame, b: DataFrame | Sequence[DataFrame]) -> int:
    """Rows of either table that the other lacks, repeats counted. `b` may come in parts, which are read one after another.

    Rows fall into buckets by a hash; count and sums of two hashes of the rows (by halves, as longs) are compared by bucket, and only buckets
    that differ are compared row by row. Tables that are the same are not shuffled. Spark's hashes pass over nulls, so these are hashed too.
    """
    b = [x.select(*a.columns) for x in parts_of(b)]
    nulls = sum((F.col(c).isNull().cast("long") * (1 << i) for i, c in enumerate(a.columns)), F.lit(0))
    bucket = F.pmod(F.xxhash64(F.lit(1), *a.columns, nulls), F.lit(BUCKETS)).cast("int")
    halves = [F.sum(half).alias(f"{h}{n}") for h in ("h1", "h2") for n, half in enumerate((F.shiftrightunsigned(h, 32), F.col(h).bitwiseAND((1 << 32) - 1)))]

    def digest(parts: list[DataFrame]) -> set[tuple]:
        total: dict[int, tuple] = {}
        for row in (r for df in parts for r in digest_part(df).collect()):  # at most BUCKETS rows of a part
            total[row[0]] = tuple(map(sum, zip(total.get(row[0], (0,) * 5), row[1:])))
        return {(k, *v) for k, v in total.items()}

    def digest_part(df: DataFrame) -> DataFrame:
        rows = df.select(*(F.xxhash64(F.lit(seed), *df.columns, nulls).alias(f"h{seed}") for seed in (1, 2)))
        return rows.groupBy(F.pmod("h1", F.lit(BUCKETS)).cast("int").alias("bucket")).agg(F.count("*").alias("n"), *halves)

    x, y = digest([a]), digest(b)
    apart = sorted({r[0] for r in x ^ y})
    if not apart:
        return 0
    a, b = (df.where(bucket.isin(apart)) for df in (a, reduce(DataFrame.unionByName, b)))
    return a.exceptAll(b).count() + b.exceptAll(a).count()


class FactStore:
    """snapshots/{id}/{table} below a root that all machines see, and a CURRENT table whose last row names the snapshot."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _pointer(self) -> DataFrame | None:
        try:
            return self.spark.read.schema("sequence long, snapshot string, metadata string").json(f"{self.root}/CURRENT")
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise

    def current(self) -> tuple[int, str, dict] | None:
        """The last pointer: its sequence, snapshot and metadata."""
        p = self._pointer()
        row = None if p is None else p.orderBy(F.desc("sequence")).first()
        return None if row is None else (row["sequence"], row["snapshot"], json.loads(row["metadata"]))

    def read(self, table: str) -> DataFrame:
        now = self.current()
        if now is None:
            raise StoreError("the store is empty")
        if now[2].get("version") != VERSION:
            raise StoreError(f"version {now[2].get('version')}; this code reads {VERSION}")
        return self._layers(table, now[2].get("layers", [now[1]]))

    def _file(self, snapshot: str, table: str) -> DataFrame:
        """The rows that one snapshot has written of a table."""
        df = self.spark.read.parquet(f"{self.root}/snapshots/{snapshot}/{table}")
        want = T.StructType.fromDDL(TABLES[table])
        have = {f.name: f.dataType for f in df.schema}
        if any(have.get(f.name) != f.dataType for f in want):
            raise StoreError(f"{table} has columns {sorted(have)}")
        if table == "edges":
            df = df.withColumn("id", F.coalesce("id", edge_id(F.col("kind"), F.col("src"), F.col("dst"))))
        return df.select(*want.names)

    def _touched(self, snapshot: str) -> DataFrame:
        paths = self.spark.read.schema("path string").parquet(f"{self.root}/snapshots/{snapshot}/touched")
        n, size = paths.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("path")), F.lit(0))).first()
        return F.broadcast(paths) if n <= FEW_PATHS and size <= FEW_BYTES else paths

    def _layers(self, table: str, layers: list[str]) -> DataFrame:
        """A table of the whole snapshot that comes first, and its increments in order."""
        df = self._file(layers[0], table)
        for at in layers[1:]:
            df = kept(table, df, self._touched(at))
            lost = self.spark.read.schema("id string").parquet(f"{self.root}/snapshots/{at}/lost")
            if table == "edges" and not lost.isEmpty():
                df = df.join(lost, "id", "left_anti").select(*df.columns)
            df = df.unionByName(self._file(at, table))
        return df

    def metadata(self, key: str):
        now = self.current()
        return None if now is None else now[2].get(key)

    def _write(self, snapshot: str, name: str, df: DataFrame) -> None:
        columns = T.StructType.fromDDL(TABLES[name]).names
        df, order = df.select(*columns), columns[:1]
        if name == "edges":
            derived = edge_id(F.col("kind"), F.col("src"), F.col("dst"))
            df, order = df.withColumn("id", F.when(F.col("id").eqNullSafe(derived), F.lit(None)).otherwise(F.col("id"))), ["kind", "src", "dst"]
        df.sortWithinPartitions(*order).write.mode("append").option("compression", "zstd").parquet(f"{self.root}/snapshots/{snapshot}/{name}")

    def replace(self, tables: dict[str, DataFrame | Sequence[DataFrame]], metadata: dict | None = None) -> str:
        """Write a whole snapshot, then swap the pointer last: readers see the old one or the new one.

        Each table, or each of its parts, is made once; what is written is checked before the swap, and deleted if it can't stand.
        """
        if missing := TABLES.keys() - tables.keys():
            raise StoreError(f"missing {sorted(missing)}")
        now, snapshot = self.current(), uuid.uuid4().hex
        with shuffles_dropped(self.spark):
            for name in TABLES:
                for part in parts_of(tables[name]):
                    self._write(snapshot, name, part)
            new = {t: self._file(snapshot, t) for t in TABLES}
            bad = dangling(new["nodes"], new["edges"]).limit(3).collect()
        if bad:
            delete(self.spark, f"{self.root}/snapshots/{snapshot}")
            raise StoreError(f"edges without an end, such as {[r['id'] for r in bad]}")
        self._swap(now, snapshot, new, metadata)
        return snapshot

    def _swap(self, now: tuple | None, snapshot: str, tables: dict[str, DataFrame], metadata: dict | None) -> None:
        kinds = {t: sorted(r["kind"] for r in tables[t].select("kind").distinct().collect()) for t in ("nodes", "edges")}  # kinds are a fixed vocabulary
        meta = {"version": VERSION, "node_kinds": kinds["nodes"], "edge_kinds": kinds["edges"], **(metadata or {})}
        self._point({"sequence": (now[0] if now else 0) + 1, "snapshot": snapshot, "metadata": json.dumps(meta)})

    def _point(self, row: dict) -> None:
        """The pointer's next row, in a file named by its sequence, that only one writer can create."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        path = hadoop.Path(f"{self.root}/CURRENT/{row['sequence']:012d}.json")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        try:
            out = fs.create(path, False)
        except Exception as e:
            if "AlreadyExists" in str(e) or fs.exists(path):
                raise StoreError(f"another writer made snapshot {row['sequence']} first") from e
            raise
        out.write(bytearray((json.dumps(row) + "\n").encode()))
        out.close()

    def update(self, nodes: DataFrame, edges: DataFrame, hashes: DataFrame, touched: DataFrame, metadata: dict | None = None) -> str:
        """Replace the facts of touched paths (path): their nodes, hashes and the edges that start in them.

        Edges that lose an end are lost, and of edges with the same id a kept one stays. Only a layer is written.
        """
        old, now, snapshot = {t: self.read(t) for t in TABLES}, self.current(), uuid.uuid4().hex
        own = f"{self.root}/snapshots/{snapshot}"
        with shuffles_dropped(self.spark):
            touched.select("path").distinct().write.parquet(f"{own}/touched")
            touched = self._touched(snapshot)
            self._write(snapshot, "nodes", nodes)
            self._write(snapshot, "file_hashes", hashes)
            fresh, stay = self._file(snapshot, "nodes").select("id"), kept("edges", old["edges"], touched)
            ids = fresh.unionByName(kept("nodes", old["nodes"], touched).select("id"))
            # An end is gone if its node was in a touched path and nothing has its id now.
            gone = written(old["nodes"].join(touched, "path", "left_semi").select(F.col("id").alias("src")).distinct().join(fresh.withColumnRenamed("id", "src"), "src", "left_anti"), "gone")
            if few := gone.count():
                gone = written(gone.join(ids.withColumnRenamed("id", "src"), "src", "left_anti"), "gone")
                gone = F.broadcast(gone) if few <= FEW_MISSING else gone
                lost = stay.join(gone, "src", "left_semi").select("id").unionByName(stay.join(gone.withColumnRenamed("src", "dst"), "dst", "left_semi").select("id")).distinct()
            else:
                lost = gone.select(F.col("src").alias("id"))
            lost.write.parquet(f"{own}/lost")
            # Where ids follow from kind and ends in one way only, repeats have the same ends, and an edge of a touched path has no kept edge's id.
            derived = edge_id(F.col("kind"), F.col("src"), F.col("dst"))
            odd = ~F.col("id").eqNullSafe(derived) | F.col("kind").contains(":") | F.col("src").contains("->") | F.col("dst").contains("->")
            edges = edges.select("id", "kind", "src", "dst")
            if strange := not edges.where(odd).isEmpty():
                edges = edges.dropDuplicates(["id"])
            else:
                edges = edges.select("kind", "src", "dst").distinct().withColumn("id", derived)
            self._write(snapshot, "edges", edges)
            edges = self._file(snapshot, "edges")
            missing = missing_ends(ids, edges)
            if clash := strange or not stay.where(odd).isEmpty() or not kept("edges", edges, touched).isEmpty():
                stays = stay.select("id").join(self.spark.read.schema("id string").parquet(f"{own}/lost"), "id", "left_anti")
            if clash or not missing.isEmpty():
                fixed = without(edges, missing)
                fixed = written(fixed.join(stays, "id", "left_anti").select(*edges.columns) if clash else fixed, "fresh")
                delete(self.spark, f"{own}/edges")
                self._write(snapshot, "edges", fixed)
            layers = [*now[2].get("layers", [now[1]]), snapshot]
            self._swap(now, snapshot, {t: self._layers(t, layers) for t in TABLES}, {**(metadata or {}), "layers": layers})
        return snapshot


def kept(table: str, df: DataFrame, touched: DataFrame) -> DataFrame:
    """Rows of a table that aren't of the touched paths (path)."""
    if table != "edges":
        return df.join(touched, "path", "left_anti").select(*df.columns)
    return df.withColumn("path", path_from_id(F.col("src"))).join(touched, "path", "left_anti").select(*df.columns)


def append_history(df: DataFrame, path: str) -> None:
    """One line for each report row."""
    df.coalesce(1).write.mode("append").json(path)


def guarded_index(found: DataFrame, path: str, *, overlays: bool, scoped: bool, clean: bool) -> bool:
    """Write the clone index, only of a whole, clean tree without overlays."""
    if overlays or scoped or not clean:
        return False
    found.write.mode("overwrite").parquet(path)
    return True


def compact(spark: SparkSession, path: str, target: str, files: int) -> None:
    """Rewrite a table's many small files as `files` larger ones."""
    spark.read.parquet(path).repartition(files).write.mode("overwrite").parquet(target)
