"""Fact selectors. An empty list is no constraint; lists are OR inside and AND between; sorting comes before a limit."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.paths import path_from_id

EDGE_KEY = ("kind", "src", "dst", "id")


def _limited(df: DataFrame, order: Sequence[str], limit: int | None) -> DataFrame:
    if limit is None:
        return df
    if limit <= 0:
        raise ValueError("limit must be positive")
    return df.orderBy(*order).limit(limit)


def _contains(text: str | None, *columns: str) -> Column:
    if not text:
        return F.lit(True)
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.col(c).contains(text), F.lit(False))
    return hit


def edges_between(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    ids = nodes.select("id")
    out = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi")
    return out.join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*edges.columns)


def select_nodes(nodes: DataFrame, *, kinds: Iterable[str] = (), ids: Iterable[str] = (), text: str | None = None, limit: int | None = None) -> DataFrame:
    """Nodes by kind, id and text in id or name (case counts), in order of id if limited."""
    found = nodes.where(_contains(text, "id", "name"))
    if kinds := list(kinds):
        found = found.where(F.col("kind").isin(kinds))
    if ids := list(ids):
        found = found.where(F.col("id").isin(ids))
    return _limited(found, ["id"], limit)


def select_symbols(nodes: DataFrame, **params) -> DataFrame:
    """Nodes that aren't files."""
    return select_nodes(nodes.where("kind <> 'File'"), **params)


def select_edges(nodes: DataFrame, edges: DataFrame, *, kinds: Iterable[str] = (), ids: Iterable[str] = (), text: str | None = None, limit: int | None = None, neighbors: bool = False) -> DataFrame:
    """Edges whose ends exist, by kind, text in id or ends, and ids of an end or of the edge.

    As a neighbour query an edge's own id alone doesn't count.
    """
    found = edges.where(_contains(text, "id", "src", "dst"))
    if kinds := list(kinds):
        found = found.where(F.col("kind").isin(kinds))
    if ids := list(ids):
        touch = F.col("src").isin(ids) | F.col("dst").isin(ids)
        found = found.where(touch if neighbors else touch | F.col("id").isin(ids))
    return _limited(edges_between(found, nodes), EDGE_KEY, limit)


def endpoints(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes that are an end of the edges."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return nodes.join(ends, "id", "left_semi")


def select_impact(*_: object) -> None:
    raise NotImplementedError("impact is no fact selector; use operators.impact")


def merged_requirements(requests: Iterable[dict]) -> list[dict]:
    """Selectors of the same kind and text without a limit become one, the lists united; an empty list stays no constraint."""
    out: dict[tuple, dict] = {}
    kept: list[dict] = []
    for r in requests:
        if r.get("limit") is not None:
            kept.append(dict(r))
            continue
        key = (r["kind"], r.get("text"))
        if key not in out:
            out[key] = {**r, **{k: sorted(set(r.get(k) or ())) for k in ("kinds", "ids")}}
            kept.append(out[key])
            continue
        have = out[key]
        for k in ("kinds", "ids"):
            new = r.get(k) or ()
            have[k] = sorted({*have[k], *new}) if have[k] and new else []
    return kept


def covers(have: dict, want: dict) -> bool:
    """Whether the result of one selector (kind, text, kinds, ids, limit) holds all rows of another: it is as broad, and not cut by a limit."""
    wider = lambda k: not have.get(k) or bool(want.get(k)) and set(want[k]) <= set(have[k])
    said = not have.get("text") or bool(want.get("text")) and have["text"] in want["text"]
    return have["kind"] == want["kind"] and have.get("limit") is None and said and wider("kinds") and wider("ids")


class Covered:
    """Results of node selectors, kept as tables; a narrower selector is answered by filtering a broader one's result."""

    def __init__(self, nodes: DataFrame):
        self.nodes, self.held, self.reused = nodes, [], 0

    def nodes_of(self, want: dict) -> DataFrame:
        for have, rows in self.held:
            if covers(have, want):
                self.reused += 1
                break
        else:
            from factloom.plans.durable import written

            rows = written(select_nodes(self.nodes, kinds=want.get("kinds") or (), ids=want.get("ids") or (), text=want.get("text")), "covering")
            self.held.append(({**want, "limit": None}, rows))
        return select_nodes(rows, kinds=want.get("kinds") or (), ids=want.get("ids") or (), text=want.get("text"), limit=want.get("limit"))


def count_by_kind(facts: DataFrame) -> DataFrame:
    return facts.groupBy("kind").agg(F.count("*").alias("n"))


def edges_of_file(edges: DataFrame, path: str) -> DataFrame:
    """Edges that start in a file: by the path in their source's id."""
    return edges.where(path_from_id(F.col("src")) == path)


def nodes_like(nodes: DataFrame, pattern: str, limit: int) -> DataFrame:
    return nodes.where(F.col("name").like(pattern)).orderBy("name", "id").limit(limit)


def with_file_facts(nodes: DataFrame, hashes: DataFrame) -> DataFrame:
    """Stored node rows: language and hash by path, and the flags from attributes."""
    from factloom.functions.text import json_flag

    h = hashes.select(F.col("path"), F.col("sha256").alias("file_hash"))
    flagged = nodes.withColumns({"is_test": (F.col("kind") == "Test") | json_flag(F.col("attributes"), "isTest"), "is_exported": json_flag(F.col("attributes"), "exported")})
    return flagged.join(h, "path", "left")


def with_edge_files(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Stored edge rows: file_path is the source node's path, else the target's."""
    s = nodes.select(F.col("id").alias("src"), F.col("path").alias("__src_path"))
    d = nodes.select(F.col("id").alias("dst"), F.col("path").alias("__dst_path"))
    return edges.join(s, "src", "left").join(d, "dst", "left").withColumn("file_path", F.coalesce("__src_path", "__dst_path")).drop("__src_path", "__dst_path")


def broadcast_few(policy: DataFrame, most: int) -> DataFrame:
    """A policy table with a broadcast hint if it has at most `most` rows; a larger one is whole, and the planner's choice."""
    return F.broadcast(policy) if policy.limit(most + 1).count() <= most else policy
