"""Suffix-array dedup: bytes covered by a string of `size` bytes that starts anywhere else, by a difference cover.

Only whether suffixes agree in their first `size` bytes matters, so a name stands for a class of equal prefixes. With a
difference cover D modulo v, any two starts have a shift k < v that takes both into the sample {p : p mod v in D}. So:

1. Sampled suffixes are named by their first size - v + 1 bytes and grouped by name over the cluster.
2. The names decide which suffixes can agree further: a start can repeat only if a sampled suffix within v after it
   shares its name. Those remaining starts, sampled or not, get the name of their first `size` bytes (their own bytes up
   to the sample, then the sample's), are grouped again, and adjacent equal names mark the starts that repeat.

Names are 64-bit fingerprints by a rolling hash instead of ranks by recursion: equality is all that is asked of them.

Before that, a lossless filter bounds what is sampled. Anchors (the least 64-byte hash of each window of `size` bytes,
as in winnowing) lie inside every repeated string at the same place, so bytes away from repeated anchors are left out.
Where a stretch from one repeated anchor past the next repeats as a whole, its starts are settled at once; a place where
all occurrences of an anchor are settled is left out, too. Anchors and stretches meet in ranges of their names, and what is
found goes back to the texts by joins: no task and no driver holds the names of all. Texts that are wholly equal are one text here; each copy of a
text of `size` bytes or more is removed as a whole.

Groups of any size: two different places with a name settle it, so each task sends at most two entries for a name to be
found repeated; entries that must be answered for themselves are answered within the task where two of them meet.

Defined results. A null or empty text, or one shorter than `size`, loses nothing and keeps the digest of its bytes. Rows
that repeat are copies of each other, also under one doc_id. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import kernel as K
from factloom.llm.shared import plain_columns, released, small_arrow_batches, written

GRAM = 64
FLUSH = 300_000
FLAG_BYTES = 32 << 20
RANGE_ENTRIES = 600_000
#: Bytes looked at together: each needs about a hundred bytes of a worker.
SLICE_BYTES = 1 << 19
BASE = np.uint64(0x9E3779B97F4A7C15)
U64 = np.uint64
PLACE = np.dtype([("a", "<i8"), ("b", "<i4")])
ENTRY = np.dtype([("h", "<u8"), ("a", "<i8"), ("b", "<i4")])


def difference_cover(v: int) -> list[int]:
    """A smallest-first difference cover modulo v: every residue is a difference of two members."""
    for n in range(2, v):
        for rest in combinations(range(2, v), n - 2):
            d = (0, 1, *rest)
            if len({(a - b) % v for a in d for b in d}) == v:
                return list(d)
    return list(range(v))


COVER_MODULO = 31
COVER = difference_cover(COVER_MODULO)


class Rolling:
    """Fingerprints of any substrings of one slice."""

    power = inverse = np.ones(1, U64)

    def __init__(self, buf: np.ndarray):
        n = len(buf)
        if len(Rolling.power) <= n:
            back = U64(pow(int(BASE), -1, 1 << 64))
            with np.errstate(over="ignore"):
                Rolling.power = np.multiply.accumulate(np.concatenate([[U64(1)], np.full(n, BASE)]))
                Rolling.inverse = np.multiply.accumulate(np.concatenate([[U64(1)], np.full(n, back)]))
        self.sums = np.zeros(n + 1, U64)
        with np.errstate(over="ignore"):
            np.cumsum(K.BYTE[buf] * Rolling.power[:n], out=self.sums[1:])

    def at(self, start: np.ndarray, size) -> np.ndarray:
        with np.errstate(over="ignore"):
            return K.mix((self.sums[start + size] - self.sums[start]) * Rolling.inverse[start] + np.asarray(size, U64))

    def grams(self, size: int) -> np.ndarray:
        n = max(len(self.sums) - size, 0)
        with np.errstate(over="ignore"):
            return K.mix((self.sums[size:] - self.sums[:n]) * Rolling.inverse[:n] + U64(size))


def slide(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Minimum or maximum of each window of `width`."""
    f, n = (np.minimum if least else np.maximum), len(x)
    if n < width:
        return np.zeros(0, U64)
    pad = np.full(-(-n // width) * width, np.iinfo(U64).max if least else 0, U64)
    pad[:n] = x
    blocks = pad.reshape(-1, width)
    ahead = f.accumulate(blocks, axis=1).ravel()
    behind = f.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return f(behind[: n - width + 1], ahead[width - 1 : n])


def anchors_of(s: K.Slice, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of a slice's anchors."""
    width, n = size - GRAM + 1, len(s.buf) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    grams = Rolling(s.buf).grams(GRAM)
    doc_of = np.repeat(np.arange(len(s.offsets) - 1), np.diff(s.offsets))
    inside = doc_of[:n] == doc_of[size - 1 :]
    low = np.where(inside, slide(grams, width, True), U64(0))
    edge = np.zeros(width - 1, U64)
    high = slide(np.concatenate([edge, low, edge]), width, False)
    at = np.flatnonzero((high == grams) & (high > 0))
    return at, grams[at]


class Repeated:
    """A slice with the places of its repeated anchors, in order."""

    def __init__(self, s: K.Slice, size: int, at: np.ndarray):
        self.s, self.size, self.at = s, size, at
        self.doc = np.searchsorted(s.offsets, at, "right") - 1
        self.first = np.maximum(at + GRAM - size, s.offsets[self.doc])  # the first start whose string holds the anchor

    def blocks(self) -> tuple[np.ndarray, np.ndarray]:
        """First and last start from each anchor to the next one of its document, if near."""
        a, b, doc = self.at[:-1], self.at[1:], self.doc
        ok = (doc[:-1] == doc[1:]) & (b - a <= self.size) & (b + self.size <= self.s.offsets[doc[1:] + 1])
        return a[ok], b[ok]

    def starts(self, chosen: np.ndarray) -> np.ndarray:
        """Marks the starts whose string holds one of the chosen anchors."""
        lo, hi = self.first[chosen], np.minimum(self.at[chosen], self.s.offsets[self.doc[chosen] + 1] - self.size)
        return filled(lo[hi >= lo], hi[hi >= lo], len(self.s.buf))

    def state(self, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Marks of the starts that blocks (`whole`: first starts of those that repeat) settle, and of those still open."""
        a, b = self.blocks()
        on = np.isin(a, whole)
        settled = filled(a[on], b[on], len(self.s.buf))
        return settled, self.starts(np.ones(len(self.at), bool)) & ~settled


def filled(lo: np.ndarray, hi: np.ndarray, n: int) -> np.ndarray:
    """Marks lo..hi, both included."""
    mark = np.zeros(n + 1, np.int32)
    np.add.at(mark, lo, 1)
    np.add.at(mark, hi + 1, -1)
    return np.cumsum(mark[:-1]) > 0


def runs(mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of each run of marks."""
    edge = np.diff(np.concatenate([[0], mark.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


def dealt(entries: np.ndarray, ranges: int) -> tuple[np.ndarray, list[bytes]]:
    """Entries packed by the range of their name."""
    where = ((entries["h"] >> U64(32)) * U64(ranges) >> U64(32)).astype(np.int64)
    order = np.argsort(where, kind="stable")
    edge = np.searchsorted(where[order], np.arange(ranges + 1))
    entries = entries[order]
    full = np.flatnonzero(np.diff(edge))
    return full, [entries[edge[r] : edge[r + 1]].tobytes() for r in full]


def by_name(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct entries in order of their names, and whether each one's name is at two places."""
    entries = entries[np.lexsort((entries["b"], entries["a"], entries["h"]))]
    new = np.ones(len(entries), bool)
    new[1:] = entries[1:] != entries[:-1]
    entries = entries[new]
    same = entries["h"][1:] == entries["h"][:-1]
    twice = np.zeros(len(entries), bool)
    twice[1:] |= same
    twice[:-1] |= same
    return entries, twice


def entries_of(h: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.empty(len(h), ENTRY)
    out["h"], out["a"], out["b"] = h, a, b
    return out


def each_text(batches: Iterator[pa.RecordBatch], places: int = 0) -> Iterator[tuple[K.Slice, np.ndarray, list[np.ndarray]]]:
    """Slices of rows (key, text, then columns of places packed as bytes): the slice, its keys, and each column's places in it.

    A text seen before in this task is made empty, and has no places.
    """
    seen: set[int] = set()
    for batch in batches:
        keys = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        known = [k in seen or seen.add(k) is not None for k in keys.tolist()]
        texts = pa.compute.if_else(pa.array(known), pa.scalar(None, batch.column(1).type), batch.column(1))
        columns = [batch.column(2 + k).to_pylist() for k in range(places)]
        if len(seen) > 1_000_000:
            seen = set()
        for s in K.slices(texts, SLICE_BYTES):
            n = len(s.offsets) - 1
            at = [np.unique(np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(c[s.first + i], "<i4") + s.offsets[i] for i in range(n) if c[s.first + i] and not known[s.first + i])])) for c in columns]
            yield s, keys[s.first : s.first + n], at


def held_by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    held: dict[int, list[bytes]] = {}
    for batch in batches:
        for r, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            held.setdefault(r, []).append(x)
    while held:
        yield held.popitem()


def packed_pairs(a: np.ndarray, b: np.ndarray, buckets: int) -> tuple[pa.Array, pa.Array]:
    """Places of keys by a bucket of the key, one row for each bucket: how many keys, the keys, their numbers, the places."""
    bucket = (K.mix(a.view(U64)) % U64(buckets)).astype(np.int32)
    order = np.lexsort((b, a, bucket))
    a, b, bucket = a[order], b[order].astype("<i4"), bucket[order]
    edge = np.searchsorted(bucket, np.arange(buckets + 1))
    full, rows = np.flatnonzero(np.diff(edge)), []
    for k in full:
        keys, counts = np.unique(a[edge[k] : edge[k + 1]], return_counts=True)
        rows.append(np.int64(len(keys)).tobytes() + keys.astype("<i8").tobytes() + counts.astype("<i4").tobytes() + b[edge[k] : edge[k + 1]].tobytes())
    return pa.array(full.astype(np.int32)), pa.array(rows, pa.binary())


def unpacked(row: bytes) -> np.ndarray:
    n = int(np.frombuffer(row, "<i8", 1)[0])
    keys, counts = np.frombuffer(row, "<i8", n, 8), np.frombuffer(row, "<i4", n, 8 + 8 * n)
    out = np.empty(int(counts.sum()), PLACE)
    out["a"], out["b"] = np.repeat(keys, counts), np.frombuffer(row, "<i4", offset=8 + 12 * n)
    return out


def by_key(as_runs: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (bucket, pairs) to a row (key, places) for each key; as runs, first and last of places in a row."""

    @released
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in held_by_range(batches):
            pairs = np.concatenate([unpacked(x) for x in rows])
            pairs = pairs[np.lexsort((pairs["b"], pairs["a"]))]
            a, b = np.ascontiguousarray(pairs["a"]), np.ascontiguousarray(pairs["b"])
            if as_runs:
                cut = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] > b[:-1] + 1), [True]]))
                a, b = a[cut[:-1]], np.stack([b[cut[:-1]], b[cut[1:] - 1]], 1)
            edge = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1], [True]]))
            yield pa.record_batch([pa.array(np.ascontiguousarray(a[edge[:-1]])), pa.array([b[i:j].tobytes() for i, j in zip(edge[:-1], edge[1:])], pa.binary())], names=["key", "places"])

    return part


def answered(source: DataFrame, entries: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], ranges: int, askers_as_runs: bool = False) -> DataFrame:
    """(key, places), a row for each key: entries whose name is at two places, and of whose name some entry asks (b's lowest bit).

    With `askers_as_runs`, only the entries that ask themselves, as runs of places.

    A place is b >> 1. Entries of one name that meet within a task are answered there, and one of them speaks for all.
    """
    names = ["range", "entries", "bucket", "pairs"]

    @released
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> Iterator[pa.RecordBatch]:
            e, twice = by_name(np.concatenate(held))
            first = np.ones(len(e), bool)
            first[1:] = e["h"][1:] != e["h"][:-1]
            group = np.cumsum(first) - 1
            asks = np.zeros(first.sum(), bool)
            np.logical_or.at(asks, group, e["b"] & 1 == 1)
            settled = twice & asks[group]
            # A name that meets here and asks is answered; others may yet meet or be asked for elsewhere.
            own = settled & (e["b"] & 1 == 1) if askers_as_runs else settled
            bucket, pairs = packed_pairs(np.ascontiguousarray(e["a"][own]), e["b"][own] >> 1, ranges)
            yield pa.record_batch([pa.nulls(len(bucket), pa.int32()), pa.nulls(len(bucket), pa.binary()), bucket, pairs], names=names)
            speaker = e[settled & first].copy()
            speaker["b"] = -1  # lowest bit set: it asks, and stands for two places
            full, blobs = dealt(np.concatenate([e[~settled], speaker]), ranges)
            k = len(blobs)
            yield pa.record_batch([pa.array(full.astype(np.int32)), pa.array(blobs, pa.binary()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names=names)

        held, size = [], 0
        for e in entries(batches):
            held.append(e)
            size += len(e)
            if size > FLUSH:
                yield from flush()
                held, size = [], 0
        if size:
            yield from flush()

    @released
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rest() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                done = pa.compute.is_valid(batch.column(2))
                if pa.compute.any(done).as_py():
                    through.append(pa.record_batch(batch.filter(done).columns[2:], names=names[2:]))
                yield batch.filter(pa.compute.invert(done)).select([0, 1])

        through: list[pa.RecordBatch] = []
        for _, blobs in held_by_range(rest()):
            e, twice = by_name(np.frombuffer(b"".join(blobs), ENTRY))
            first = np.ones(len(e), bool)
            first[1:] = e["h"][1:] != e["h"][:-1]
            group = np.cumsum(first) - 1
            asks, stands = np.zeros(first.sum(), bool), np.zeros(first.sum(), bool)
            np.logical_or.at(asks, group, e["b"] & 1 == 1)
            np.logical_or.at(stands, group, e["b"] == -1)
            on = (twice | stands[group]) & asks[group] & (e["b"] != -1)
            if askers_as_runs:
                on &= e["b"] & 1 == 1
            if on.any():
                yield pa.record_batch(list(packed_pairs(np.ascontiguousarray(e["a"][on]), e["b"][on] >> 1, ranges)), names=names[2:])
        yield from through

    met = source.mapInArrow(send, "range int, entries binary, bucket int, pairs binary").repartition(ranges, F.coalesce("range", "bucket"))
    return met.mapInArrow(meet, "bucket int, pairs binary").repartition(ranges, "bucket").mapInArrow(by_key(askers_as_runs), "key long, places binary")


def sampled(n: int) -> np.ndarray:
    """Places below n that the difference cover samples."""
    at = (np.arange(-(-n // COVER_MODULO))[:, None] * COVER_MODULO + np.array(COVER)).ravel()
    return at[at < n]


def repeated_starts(docs: DataFrame, size: int) -> DataFrame:
    """(key, settled, places): of each text with repeats, runs of starts, as first and last; places has them as bytes."""
    spark = docs.sparkSession
    texts = docs.where(F.octet_length("text") >= size).select("key", "text")
    total = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    ranges = max(12, int(total * 2 / (size - GRAM + 2)) // RANGE_ENTRIES + 1)

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for s, keys, _ in each_text(batches):
            at, h = anchors_of(s, size)
            doc = np.searchsorted(s.offsets, at, "right") - 1
            yield entries_of(h, keys[doc], ((at - s.offsets[doc]) << 1) | 1)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for s, keys, (near,) in each_text(batches, 1):
            x = Repeated(s, size, near)
            a, b = x.blocks()
            doc = np.searchsorted(s.offsets, a, "right") - 1
            yield entries_of(Rolling(s.buf).at(a, b - a + size) if len(a) else np.zeros(0, U64), keys[doc], ((a - s.offsets[doc]) << 1) | 1)

    def asking(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for s, keys, (near, whole) in each_text(batches, 2):
            x = Repeated(s, size, near)
            if len(near):
                count = np.concatenate([[0], np.cumsum(x.state(whole)[1])])
                asks = count[near + 1] > count[x.first]
                yield entries_of(Rolling(s.buf).at(near, GRAM), keys[x.doc], ((near - s.offsets[x.doc]) << 1) | asks)

    def joined(rows: DataFrame, found: DataFrame, name: str, how: str) -> DataFrame:
        """`rows` with the places found for their keys; these go to all tasks if they are few enough."""
        found = written(found, name)
        weight = found.agg(F.coalesce(F.sum(F.octet_length("places") + 16), F.lit(0))).first()[0]
        found = found.select(F.col("key").alias("f_key"), F.col("places").alias(name))
        if weight <= FLAG_BYTES:
            return rows.join(F.broadcast(found), F.col("key") == F.col("f_key"), how).drop("f_key")
        return written(rows.join(found, F.col("key") == F.col("f_key"), how).drop("f_key"), "texts")  # shuffled once

    # Texts with repeated anchors are all that is looked at from here on.
    texts = joined(texts, answered(texts, anchors, ranges), "near", "inner")
    with_whole = joined(texts, answered(texts, blocks, ranges), "whole", "left")
    with_active = joined(with_whole, answered(with_whole, asking, ranges), "active", "left")

    @released
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, keys, (near, whole, active) in each_text(batches, 3):
            x = Repeated(s, size, near)
            settled, unsettled = x.state(whole)
            wanted = x.starts(np.isin(near, active))
            rows = []
            for mark, piece in ((settled, False), (wanted, True)):
                for i, j in zip(*runs(mark)):
                    # Runs of neighbouring documents can touch: cut them there.
                    while i <= j:
                        d = int(np.searchsorted(s.offsets, i, "right")) - 1
                        end = min(j, s.offsets[d + 1] - size)
                        first = int(i - s.offsets[d])
                        if piece:
                            rows.append((int(keys[d]), first, s.buf[i : end + size].tobytes(), np.packbits(unsettled[i : end + 1]).tobytes(), None))
                        else:
                            rows.append((int(keys[d]), first, None, None, int(end - s.offsets[d])))
                        i = max(end + 1, s.offsets[d + 1]) if end < j else j + 1
            kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int32())
            if rows:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["key", "first", "piece", "unsettled", "last"])

    cuts = with_active.mapInArrow(cut, "key long, first int, piece binary, unsettled binary, last int")
    cuts = written(cuts.dropDuplicates(["key", "first", "last"]), "pieces")
    settled = cuts.where("piece IS NULL").select("key", "first", "last")
    pieces = cuts.where("piece IS NOT NULL").select(F.monotonically_increasing_id().alias("id"), "key", "first", "piece", "unsettled")
    pieces = written(pieces, "numbered")
    amount = pieces.agg(F.coalesce(F.sum(F.octet_length("piece") - size), F.lit(0))).first()[0]
    v = COVER_MODULO
    name = size - v + 1
    ranges = max(12, amount * len(COVER) // v // RANGE_ENTRIES + 1)

    def questions(batch: pa.RecordBatch, column: int, n: int, i: int) -> np.ndarray:
        return np.unpackbits(np.frombuffer(batch.column(column)[i].as_buffer(), np.uint8), count=n).astype(bool)

    def samples(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for i, piece in enumerate(batch.column(1)):
                buf = np.frombuffer(piece.as_buffer(), np.uint8)
                n = len(buf) - size + 1
                p = sampled(len(buf) - name + 1)
                count = np.concatenate([[0], np.cumsum(questions(batch, 2, n, i))])
                ask = count[np.minimum(p + 1, n)] > count[np.minimum(np.maximum(p - v + 1, 0), n)]
                yield entries_of(Rolling(buf).at(p, name), np.full(len(p), ids[i]), (p << 1) | ask)

    named = answered(pieces.select("id", "piece", "unsettled"), samples, ranges)
    open_pieces = pieces.join(named.withColumnRenamed("key", "id"), "id").select("id", "key", "first", "piece", "unsettled", "places")

    def remaining(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            keys, first, places = (batch.column(k).to_pylist() for k in (1, 2, 5))
            for i, piece in enumerate(batch.column(3)):
                buf = np.frombuffer(piece.as_buffer(), np.uint8)
                n = len(buf) - size + 1
                p = np.frombuffer(places[i], "<i4").astype(np.int64)
                p = p[p - v + 1 < n]
                at = np.flatnonzero(filled(np.maximum(p - v + 1, 0), np.minimum(p, n - 1), n))
                ask = questions(batch, 4, n, i)[at]
                yield entries_of(Rolling(buf).at(at, size), np.full(len(at), keys[i]), ((at + first[i]) << 1) | ask)

    starts = answered(open_pieces, remaining, ranges, askers_as_runs=True)
    one = starts.select("key", F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"), "places")
    both = settled.select("key", "first", "last", F.lit(None).cast("binary").alias("places")).unionByName(one)
    return both.groupBy("key").agg(F.collect_list(F.when(F.col("first").isNotNull(), F.struct("first", "last"))).alias("settled"), F.collect_list("places").alias("places"))


def remove_repeats(docs: DataFrame, *, size: int = 400) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    docs = plain_columns(docs, "doc_id", "text")
    small_arrow_batches(docs.sparkSession)
    keyed = docs.select("doc_id", F.xxhash64("text").alias("key"), "text")
    starts = repeated_starts(keyed, size)
    copies = keyed.where(F.octet_length("text") >= size).groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select(F.col("key").alias("c_key"), F.lit(True).alias("copied"))
    flags = written(starts.join(copies, F.col("key") == F.col("c_key"), "full").select(F.coalesce("key", "c_key").alias("f_key"), "settled", "places", "copied"), "repeats")
    weight = flags.agg(F.coalesce(F.sum(F.coalesce(F.size("settled"), F.lit(0)) * 8 + F.aggregate("places", F.lit(0), lambda a, x: a + F.octet_length(x)) + 32), F.lit(0))).first()[0]
    hint = F.broadcast if weight <= FLAG_BYTES else (lambda x: x)
    rows = keyed.join(hint(flags), F.col("key") == F.col("f_key"), "left").select("doc_id", "text", "settled", "places", "copied")

    @released
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            settled, places, copied = (batch.column(k).to_pylist() for k in (2, 3, 4))
            for i, text in enumerate(batch.column(1)):
                raw = np.frombuffer(text.as_buffer(), np.uint8) if text.is_valid and text.as_buffer() is not None else np.zeros(0, np.uint8)
                n = len(raw)
                if copied[i]:
                    gone = np.ones(n, bool)
                else:
                    lo = np.array([x["first"] for x in settled[i] or []], np.int64)
                    hi = np.array([x["last"] for x in settled[i] or []], np.int64)
                    more = np.frombuffer(b"".join(places[i] or []), "<i4").astype(np.int64).reshape(-1, 2)
                    gone = filled(np.concatenate([lo, more[:, 0]]), np.concatenate([hi, more[:, 1]]) + size - 1, n)
                out.append((n, int(gone.sum()), len(runs(gone)[0]), hashlib.sha256(raw[~gone].tobytes()).hexdigest()))
            a, b, c, d = zip(*out) if out else ([], [], [], [])
            yield pa.record_batch([batch.column(0), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64()), pa.array(d, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(part, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
