"""Connected components of a graph too large for one machine: alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.shared import written


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b") % 1_000_003).alias("s")).first()
    return r["n"], r["s"]


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Edges (a, b) to rows (node, label): the smallest node that each node reaches. Nodes without edges are left out.

    Minima are pre-aggregated before each shuffle and hot nodes meet by joins, which can be split; each round is written
    to the shared folder. A round shortens paths to the smallest node, so rounds grow with the logarithm of the diameter.
    """
    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    before = _state(e)
    for _ in range(rounds):
        if not before[0]:
            break
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        e = written(small.distinct(), "cc")
        after = _state(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """`labels` (node, label) after more links (a, b): components of the labels that the links join, which are few."""
    ends = links.select("a", "b")
    for end in ("a", "b"):
        own = labels.select(F.col("node").alias(end), F.col("label").alias(f"to_{end}"))
        ends = ends.join(own, end, "left").withColumn(f"to_{end}", F.coalesce(f"to_{end}", end))
    ends = written(ends, "ends")
    found = components(ends.select(F.col("to_a").alias("a"), F.col("to_b").alias("b")))
    new = ends.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(labels, "node", "left_anti").select("node", F.col("node").alias("label"))
    old = labels.unionByName(new)
    to = found.select(F.col("node").alias("label"), F.col("label").alias("to"))
    return written(old.join(to, "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
