"""Benchmark decontamination: a prefix-filtered join of benchmark windows with whole document texts.

A window is `width` consecutive words of an item (a shorter item is one window), so a document is hit only where it
holds all of a window. For that overlap the necessary prefix of a window has one word; taking the rarest, by its count
over all documents, makes few candidates. A candidate's offset in the window and the window's length bound where the
match can lie; the words there are then compared exactly.

Defined results. A null or empty text has no words, no hits and is not contaminated. Items without words, null items
and an empty benchmark match nothing; an item whose id is null hits words, but is not listed. Rows that repeat a doc_id
are judged each by its own text. Only doc_id, text and item_id, text are read, so other columns can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.shared import plain_columns

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def benchmark_words(text: Column) -> Column:
    """Runs of ASCII letters and digits and of all that is not ASCII, with A-Z folded."""
    parts = F.array_remove(F.split(F.translate(text, UPPER, LOWER), NOT_WORD), "")
    return F.coalesce(parts, F.array().cast("array<string>"))


def item_windows(benchmark: DataFrame, width: int) -> DataFrame:
    """Distinct windows: win (words), len, items (ids that have it)."""
    w = plain_columns(benchmark, "item_id", "text").select("item_id", benchmark_words(F.col("text")).alias("words"))
    w = w.where(F.size("words") > 0).withColumn("start", F.explode(F.sequence(F.lit(1), F.greatest(F.size("words") - (width - 1), F.lit(1)))))
    w = w.select(F.col("item_id").cast("string").alias("item"), F.slice("words", F.col("start"), F.lit(width)).alias("win"))
    return w.groupBy("win").agg(F.collect_set("item").alias("items")).withColumn("len", F.size("win"))


def rare_prefixes(docs: DataFrame, windows: DataFrame, small: bool) -> DataFrame:
    """Each window with its rarest word (token) and that word's offset."""
    hint = F.broadcast if small else (lambda x: x)
    parts = windows.select("win", "items", "len", F.posexplode("win").alias("offset", "token"))
    vocabulary = parts.select("token").distinct()
    counts = docs.select(F.explode("words").alias("token")).join(hint(vocabulary), "token").groupBy("token").agg(F.count("*").alias("seen"))
    ranked = parts.join(hint(counts), "token", "left").withColumn("rank", F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "token", "offset"))
    best = ranked.groupBy("win").agg(F.min("rank").alias("rank"), F.first("items").alias("items"), F.first("len").alias("len"))
    return best.select("win", "items", "len", F.col("rank.token").alias("token"), F.col("rank.offset").alias("offset"))


def window_hits(docs: DataFrame, benchmark: DataFrame, width: int, broadcast_rows: int) -> DataFrame:
    """Verified occurrences (doc_id, text_hash, n_words, start, len, items), and for each document a row whose start is null."""
    d = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), benchmark_words(F.col("text")).alias("words"))
    windows = item_windows(benchmark, width)
    small = windows.limit(broadcast_rows + 1).count() <= broadcast_rows
    prefixes = rare_prefixes(d, windows, small)
    n_words = F.size("words").alias("n_words")
    start = F.col("pos") - F.col("offset")
    in_bounds = (start >= 0) & (start + F.col("len") <= F.size("words"))
    same = F.slice("words", start + 1, F.col("len")) == F.col("win")
    if small:
        own_row = prefixes.sparkSession.range(1).select(*(F.lit("" if f.name == "token" else None).cast(f.dataType).alias(f.name) for f in prefixes.schema))
        each = d.select("doc_id", "text_hash", "words", F.posexplode(F.concat("words", F.array(F.lit("")))).alias("pos", "token"))
        found = each.join(F.broadcast(prefixes.unionByName(own_row)), "token").where(F.col("win").isNull() | (in_bounds & same))
        return found.select("doc_id", "text_hash", n_words, F.when(F.col("win").isNotNull(), start).alias("start"), "len", "items")
    # A benchmark too large to broadcast: words meet prefixes without their document, which comes back for candidates only.
    pairs = d.select("doc_id", "text_hash", F.posexplode("words").alias("pos", "token")).join(prefixes, "token").where(start >= 0)
    pairs = pairs.select(F.col("doc_id").alias("c_doc"), F.col("text_hash").alias("c_hash"), "pos", "offset", "len", "win", "items").distinct()
    once = d.dropDuplicates(["doc_id", "text_hash"])
    found = pairs.join(once, F.col("c_doc").eqNullSafe(F.col("doc_id")) & F.col("c_hash").eqNullSafe(F.col("text_hash"))).where(in_bounds & same)
    found = found.select("doc_id", "text_hash", n_words, start.alias("start"), "len", "items")
    own = d.select("doc_id", "text_hash", n_words, F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("len"), F.lit(None).cast("array<string>").alias("items"))
    return found.unionByName(own)


def contamination(docs: DataFrame, benchmark: DataFrame, *, width: int = 13, share: int = 20, broadcast_rows: int = 200_000) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated (a hit, and one word in `share` or more), text_hash.

    Up to `broadcast_rows` windows are broadcast; beyond that the join shuffles, with the same result.
    """
    hits = window_hits(plain_columns(docs, "doc_id", "text"), benchmark, width, broadcast_rows)
    end = F.col("start") + F.col("len")
    before = Window.partitionBy("doc_id", "text_hash").orderBy("start", "len").rowsBetween(Window.unboundedPreceding, -1)
    new = F.greatest(F.lit(0), end - F.greatest("start", F.coalesce(F.max(end).over(before), F.lit(0))))
    marked = hits.withColumn("new", new)
    ids = F.array_sort(F.array_distinct(F.flatten(F.collect_list("items"))))
    total = marked.groupBy("doc_id", "text_hash").agg(
        F.max("n_words").cast("long").alias("n_words"),
        F.coalesce(F.sum("new"), F.lit(0)).cast("long").alias("n_hit"),
        ids.alias("ids"),
        F.count(F.when(F.col("start").isNull(), 1)).cast("int").alias("rows"),
    )
    flag = (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))
    return total.select(
        "doc_id", "n_words", "n_hit", F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"), flag.alias("contaminated"), "text_hash",
        F.explode(F.array_repeat(F.lit(0), F.col("rows"))).alias("row"),
    ).drop("row")


def decontaminate(docs: DataFrame, benchmark: DataFrame, **params) -> DataFrame:
    """The documents, all columns, without the contaminated ones."""
    bad = contamination(docs, benchmark, **params).where("contaminated").select(F.col("doc_id").alias("__bad_id"), F.col("text_hash").alias("__bad_hash")).distinct()
    on = docs["doc_id"].eqNullSafe(bad["__bad_id"]) & F.xxhash64(docs["text"]).eqNullSafe(bad["__bad_hash"])
    return docs.join(bad, on, "left_anti")
