"""Ranked search: BM25 over weighted columns, bonuses and a deterministic top k.

Every function takes search documents, which it reads in one pass, or an `Index` of them. An index is written once and holds
postings in order of their terms, so a query reads the row groups of its words and the documents that hold them all.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.paths import basename
from factloom.functions.text import json_text, searchable
from factloom.plans.durable import written

#: Column weights, kind bonuses and text bonuses: fixed values.
WEIGHTS = {"name": 10.0, "qualified_name": 6.0, "file_path": 3.0, "signature": 1.0}
KIND_BONUS = {"Class": 320, "Function": 280, "Type": 240, "Test": -400, "File": -500}
EQUAL, TOKEN, SUBSTRING, LEADING, CONTEXT = 160, 120, 80, 90, 1000
K1, B = 1.2, 0.75
#: Hits up to which they go to all tasks that read documents; beyond it both sides are shuffled.
FEW_HITS = 100_000


class Index(NamedTuple):
    """Written tables of search documents with unique ids."""

    docs: DataFrame
    postings: DataFrame  # (term, node_id, tf, length): a term's weighted count in a document, and the document's length
    totals: DataFrame  # one row (n, mean)


def build_index(docs: DataFrame) -> Index:
    """An index of `docs`, in the shared folder. Documents with one term are dealt by their ids, so no task holds a hot term."""
    docs = written(docs, "search")
    weighted = F.concat(*(F.transform(_tokens(c), _weighted(w)) for c, w in WEIGHTS.items()))
    each = docs.select("node_id", _length().alias("length"), F.inline(weighted))
    postings = each.groupBy("term", "node_id", "length").agg(F.sum("w").alias("tf")).select("term", "node_id", "tf", "length").sortWithinPartitions("term")
    return Index(docs, written(postings, "postings"), written(docs.agg(F.count("*").alias("n"), F.avg(_length()).alias("mean")), "totals"))


def _name() -> Column:
    return F.coalesce("name", basename(F.col("path")), F.lit(""))


def candidates(nodes: DataFrame, query: str) -> DataFrame:
    """Nodes whose texts as written hold all the query's words somewhere: those that may match, for one pass without an index.

    Splitting a text only puts spaces in or in place of characters, so a word of a column is a part of it in either case; the
    signature has all that the other columns have. One short condition: the JVM doesn't compile what gets long by unrolling.
    """
    attributes = F.col("attributes")
    given = F.when(F.contains(attributes, F.lit("signature")) | F.contains(attributes, F.lit("\\")), F.get_json_object(attributes, "$.signature"))  # a key may be escaped
    return nodes.where(F.concat_ws(" ", "kind", _name(), "path", "id", given).rlike("(?is)^" + "".join(f"(?=.*{w})" for w in query_tokens(query))))


def search_documents(nodes: DataFrame) -> DataFrame:
    """(node_id, kind, path, raw_name and the four indexed columns, each as searchable text)."""
    name = _name()
    signature = F.concat_ws(" ", "kind", name, "path", "id", json_text(F.col("attributes"), "signature"))
    return nodes.select(
        F.col("id").alias("node_id"), "kind", "path", F.col("name").alias("raw_name"), searchable(name).alias("name"),
        searchable(F.col("id")).alias("qualified_name"), searchable(F.coalesce("path", F.lit(""))).alias("file_path"), searchable(signature).alias("signature"),
    )


def query_tokens(query: str) -> list[str]:
    """The query's words, split as the columns are, in lower case and once each."""
    import re

    split = re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", query)
    return list(dict.fromkeys(re.sub(r"[^A-Za-z0-9]+", " ", split).lower().split()))


def _tokens(column: str) -> Column:
    return F.array_remove(F.split(F.lower(column), " "), "")


def _weighted(weight: float):
    return lambda x: F.struct(x.alias("term"), F.lit(weight).alias("w"))


def _is(word: str):
    return lambda x: x == F.lit(word)


def _rows(docs: DataFrame | Index) -> DataFrame:
    return docs.docs if isinstance(docs, Index) else docs


def _hits(index: Index, words: list[str]) -> tuple[DataFrame, DataFrame]:
    """(node_id, length, tf0, ...) of documents with all words, written; and one row n, mean, df0, ..."""
    found = index.postings.where(F.col("term").isin(words))
    tf = [F.max(F.when(F.col("term") == w, F.col("tf"))).alias(f"tf{i}") for i, w in enumerate(words)]
    hits = found.groupBy("node_id").agg(F.max("length").alias("length"), *tf).dropna()
    df = found.agg(*(F.count(F.when(F.col("term") == w, 1)).alias(f"df{i}") for i, w in enumerate(words)))
    hits = written(hits, "hits")
    return F.broadcast(hits) if hits.count() <= FEW_HITS else hits, index.totals.join(F.broadcast(df))


def matches(docs: DataFrame | Index, query: str) -> DataFrame:
    """Documents that hold all the query's words, in any column. A query without words matches nothing."""
    words = query_tokens(query)
    if not words:
        return _rows(docs).limit(0)
    if isinstance(docs, Index):
        return docs.docs.join(_hits(docs, words)[0].select("node_id"), "node_id", "left_semi")
    every = F.array_distinct(F.concat(*(_tokens(c) for c in WEIGHTS)))
    return docs.where(F.size(F.array_except(F.array(*map(F.lit, words)), every)) == 0)


def _measured(docs: DataFrame | Index, words: list[str]) -> DataFrame:
    """Matching documents with length, tf0, ..., and n, mean, df0, ... of all documents; one row reaches the join."""
    if isinstance(docs, Index) and words:
        hits, totals = _hits(docs, words)
        return docs.docs.join(hits, "node_id").join(F.broadcast(totals))
    docs = _rows(docs)
    found = matches(docs, " ".join(words)).select("*", _length().alias("length"), *(_tf(w).alias(f"tf{i}") for i, w in enumerate(words)))
    has = [F.arrays_overlap(F.concat(*(_tokens(c) for c in WEIGHTS)), F.array(F.lit(w))).cast("long") for w in words]
    totals = docs.agg(F.count("*").alias("n"), F.avg(_length()).alias("mean"), *(F.sum(h).alias(f"df{i}") for i, h in enumerate(has)))
    return found.join(F.broadcast(totals))


def _length() -> Column:
    return sum((F.size(_tokens(c)) for c in WEIGHTS), F.lit(0))


def _tf(word: str) -> Column:
    return sum((F.size(F.filter(_tokens(c), _is(word))) * F.lit(weight) for c, weight in WEIGHTS.items()), F.lit(0.0))


def _bm25(words: list[str]) -> Column:
    """The score of a document, by the columns of `_measured`."""
    score = F.lit(0.0)
    for i in range(len(words)):
        tf = F.col(f"tf{i}")
        idf = F.greatest(F.log((F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5)), F.lit(1e-6))
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    return score


def bm25(docs: DataFrame | Index, query: str) -> DataFrame:
    """(node_id, bm25) of matching documents: weighted term counts over all columns, higher is better.

    Document counts and the mean length are of all documents, matching or not.
    """
    words = query_tokens(query)
    return _measured(docs, words).select("node_id", _bm25(words).alias("bm25"))


def _text_bonus(column: Column, query: str) -> Column:
    text = F.lower(F.coalesce(column, F.lit("")))
    joined = " ".join(query_tokens(query))
    return F.when(text == joined, EQUAL).when(F.array_contains(F.split(text, " "), joined), TOKEN).when(text.contains(joined), SUBSTRING).otherwise(0)


def _bonus(query: str, context_files: list[str] | None) -> Column:
    raw, words = searchable(F.coalesce("raw_name", F.lit(""))), query_tokens(query)
    kind = F.lit(0)
    for name, value in KIND_BONUS.items():
        kind = kind + F.when(F.col("kind") == name, value).otherwise(0)
    leading = F.when((F.col("kind") == "Function") & (F.element_at(F.split(F.lower(raw), " "), 1) == (words[0] if words else "")), LEADING).otherwise(0)
    near = F.when(F.coalesce(F.col("path").isin(context_files or [""]), F.lit(False)) & ~F.col("kind").isin("File", "Test"), CONTEXT).otherwise(0)
    text = _text_bonus(raw, query) * 2 + _text_bonus(F.col("qualified_name"), query) + _text_bonus(F.col("signature"), query) * 0.25
    return (kind + text + leading + near).cast("double")


def bonuses(docs: DataFrame | Index, query: str, context_files: list[str] | None = None) -> DataFrame:
    """(node_id, bonus): by kind, by how the query sits in the columns, and for files in context."""
    return matches(docs, query).select("node_id", _bonus(query, context_files).alias("bonus"))


def match_columns(docs: DataFrame | Index, query: str) -> DataFrame:
    """(node_id, columns): names of the columns that hold the query, comma-joined."""
    joined = " ".join(query_tokens(query))
    return matches(docs, query).select("node_id", F.concat_ws(",", *(F.when(F.lower(c).contains(joined), F.lit(c)) for c in WEIGHTS)).alias("columns"))


def search(docs: DataFrame | Index, query: str, *, limit: int = 20, context_files: list[str] | None = None) -> DataFrame:
    """(rank, node_id, kind, path, score): by score, then path (null first), kind, qualified name and id; ranks are 1..limit."""
    words = query_tokens(query)
    scored = _measured(docs, words).select("node_id", "kind", "path", "qualified_name", F.round(_bm25(words) + _bonus(query, context_files), 6).alias("score"))
    order = [F.desc("score"), F.asc_nulls_first("path"), "kind", "qualified_name", "node_id"]
    top = scored.orderBy(*order).limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order))).select("rank", "node_id", "kind", "path", "score")


def search_summary(docs: DataFrame | Index, query: str, limit: int = 20) -> DataFrame:
    """One row: total matches, returned, distinct kinds of the index, comma-joined."""
    total = matches(docs, query).agg(F.count("*").alias("total"))
    kinds = _rows(docs).agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))
    return total.join(F.broadcast(kinds)).select("total", F.least("total", F.lit(limit)).cast("long").alias("returned"), "kinds")


def refresh(index: DataFrame, new_docs: DataFrame, touched_paths: DataFrame) -> DataFrame:
    """The index with the rows of touched paths (path) replaced by the current ones."""
    kept = index.join(touched_paths, index["path"].eqNullSafe(touched_paths["path"]), "left_anti")
    again = new_docs.join(touched_paths, new_docs["path"].eqNullSafe(touched_paths["path"]), "left_semi")
    return kept.unionByName(again)
