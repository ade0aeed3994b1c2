"""Mixing sources to target weights, with a curriculum that varies over time.

Every source has a target number of words: its share of all words by weight, stopped at `max_repeat` times what it has,
the excess reshared by weight until no source is above. Its documents, in an order fixed by a digest of doc_id, are laid
end to end, once per repeat, and the mix takes them up to the target; the copy that crosses the target is cut there. A
source's weight changes over training as a ramp; its integral is the cumulative demand for words, and inverting that at a
copy's place gives the copy's training position in 0..1. The result is sorted by position, as a range sort.

Defined results. A null text has size 0. Null sources come last, as one source. A document of size 0 is taken with 0
words. Rows that repeat a doc_id are documents of their own; identical rows are interchangeable. No document exceeds
`max_repeat` times its size. An empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.shared import plain_columns, written

WHITE = " \t\n\x0b\x0c\r"


def word_count(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+` in a text; null has none."""
    core = F.btrim(text, F.lit(WHITE))
    return F.when(core.isNull() | (core == ""), F.lit(0)).otherwise(F.size(F.split(core, r"[\x20\x09-\x0D]+"))).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], max_repeat: int) -> DataFrame:
    """sizes: source_key, source_size (a row each). Adds rank (from 0, by source_key) and target: shares by weight, filled up to the caps."""
    ordered = Window.orderBy("source_key")  # one row for each source, not for each document
    s = sizes.withColumn("rank", F.row_number().over(ordered) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), F.col("rank") % len(weights) + 1)
    s = s.withColumn("weight", weight.cast("double")).withColumn("cap", (F.col("source_size") * max_repeat).cast("double"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "source_key")
    s = s.withColumn("full", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("open", F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    s = s.withColumn("all_words", F.sum("source_size").over(Window.partitionBy()).cast("double"))
    s = s.withColumn("level", (F.col("all_words") - F.col("full")) / F.col("open"))
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "source_key", "level"))
    s = s.withColumn("found", F.min(fits).over(Window.partitionBy())["level"])
    return s.select("source_key", "source_size", "rank", F.least(F.col("cap"), F.col("found") * F.col("weight")).alias("target"))


def demand_inverse(u: Column, ramp: Column) -> Column:
    """The time at which a share `u` of a source's words is used up, if its weight over time is 1 + ramp * (2t - 1)."""
    root = F.sqrt((1 - ramp) * (1 - ramp) + 4 * ramp * u)
    return F.when(ramp == 0, u).otherwise((root - (1 - ramp)) / (2 * ramp))


def mix_plan(docs: DataFrame, *, weights: tuple[int, ...] = (5, 2, 1), max_repeat: int = 3, ramps: tuple[float, ...] = (-0.5, 0.0, 0.5), order_hex: int = 3) -> DataFrame:
    """`docs` with size, source_size, target, taken, and copies: an array of (words, position), one for each copy taken.

    A source is cut into 16 ** order_hex ranges of its order, so that one that holds most rows is summed by many tasks.
    """
    key = F.when(F.col("source").isNull(), "1").otherwise(F.concat(F.lit("0"), "source"))
    d = docs.withColumns({"source_key": key, "size": word_count(F.col("text")), "__md5": F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), "__tie": F.xxhash64("text")})
    d = d.withColumn("__range", F.substring("__md5", 1, order_hex))
    ranges = written(d.groupBy("source_key", "__range").agg(F.sum("size").alias("range_size")), "mix-ranges")
    targets = source_targets(ranges.groupBy("source_key").agg(F.sum("range_size").alias("source_size")), weights, max_repeat)
    ahead = Window.partitionBy("source_key").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.withColumn("__ahead", F.coalesce(F.sum("range_size").over(ahead), F.lit(0))).drop("range_size")
    starts = starts.join(targets, "source_key")
    within = Window.partitionBy("source_key", "__range").orderBy("__md5", "__tie").rowsBetween(Window.unboundedPreceding, -1)
    d = d.join(starts, ["source_key", "__range"]).withColumn("__start", F.col("__ahead") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    whole = F.round("target").cast("long")
    ramp = F.element_at(F.array(*map(F.lit, ramps)), F.col("rank") % len(ramps) + 1)

    def copy(e: int) -> Column:
        begin = F.col("__start") + e * F.col("source_size")
        words = F.least(F.col("size"), F.greatest(whole - begin, F.lit(0)))
        at = F.when(whole > 0, F.least(F.lit(1.0), (begin + words / 2) / whole)).otherwise(F.lit(0.0))
        return F.struct(words.cast("long").alias("words"), demand_inverse(at, ramp).alias("position"))

    copies = F.filter(F.array(*(copy(e) for e in range(max_repeat))), lambda c: c["words"] > 0)
    d = d.withColumn("copies", copies).withColumn("taken", F.aggregate("copies", F.lit(0).cast("long"), lambda a, c: a + c["words"]))
    return d.drop("source_key", "__range", "__md5", "__tie", "__ahead", "__start", "rank")


def mix_sizes(docs: DataFrame, **params) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken, first_position; sorted by position."""
    plan = mix_plan(plain_columns(docs, "doc_id", "source", "text"), **params)
    rows = plan.select("doc_id", "size", "source_size", "target", "taken", F.when(F.size("copies") > 0, F.col("copies")[0]["position"]).alias("first_position"))
    return rows.orderBy(F.col("first_position").asc_nulls_last(), "doc_id")


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its `n`-th word."""
    parts = F.slice(F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), 0), F.lit(1), n)
    return F.array_join(parts, "")


def mix(docs: DataFrame, **params) -> DataFrame:
    """The mixed documents, a row for each copy taken, with the columns of `docs`, sorted by training position.

    A document without words has nothing to take and stays out; the copy cut at a target keeps its first words.
    """
    others = [c for c in docs.columns if c != "text"]
    base = docs.select("doc_id", "source", "text", F.struct(*others).alias("__row"))  # so that no column of theirs meets one of ours
    plan = mix_plan(base, **params).withColumn("__copy", F.explode("copies"))
    text = F.when(F.col("__copy.words") < F.col("size"), first_words(F.col("text"), F.col("__copy.words").cast("int"))).otherwise(F.col("text"))
    rows = plan.withColumn("text", text).orderBy("__copy.position", "doc_id")
    return rows.select(*(F.col("text") if c == "text" else F.col("__row")[c].alias(c) for c in docs.columns))
