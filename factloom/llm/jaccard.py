"""N-gram Jaccard join: a grouped prefix join of the documents' sets of word shingles, and its components.

Two sets link when threshold_percent * |union| <= 100 * |intersection|. Shingles are put in one order for all documents:
those that occur often come last, otherwise by their hash. A set of n that links shares one of its first
n - ceil(t * n) + 1 shingles, its prefix, with its partner. Documents with the same prefix and size form a group;
prefixes meet as groups, in ranges of the hash, so that a shingle of one group alone goes no further; group pairs are
filtered by size, then expanded to members and verified exactly on whole sets.

Links between documents that are already connected aren't needed for components. So each shingle first links its
groups to two of them, and each group its members to one of them, which is linear; then members outside a shingle's
largest component probe some of its members, for a few turns, which is linear, too. What is left is every pair of
members with a common shingle and different components. Nothing is capped: a pair that could link two components is
verified, first by sketches that never lose a link, then on whole sets.

Shingle and set hashes have 64 bits; two of a million different texts meet by chance about once in 40 million corpora.

Defined results. A null text, or one without words, has an empty set, links with nothing and is its own component. Fewer
words than the width make one shingle of the whole sequence. Identical sets always link. A repeated doc_id stands for
all its rows; where doc_id is null in a whole component, so is its component_id. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm import kernel as K
from factloom.llm.components import components, joined
from factloom.llm.shared import plain_columns, released, small_arrow_batches, written

#: Shingles that come last in the order: found as repeated within a task, and then this often overall.
OFTEN, OFTEN_IN_TASK, OFTEN_MOST = 32, 2, 400_000
#: Shingles looked at together for that; bounds a worker's memory.
TASK_SHINGLES = 1_000_000
#: Prefix entries in a range of the hash; one task works on a few ranges.
RANGE_ENTRIES = 300_000
BROADCAST_IDS = 1_000_000
PARITY_LONGS = 32
PARITY = [f"parity{i}" for i in range(PARITY_LONGS)]
ENTRY = np.dtype([("token", "<u8"), ("grp", "<u8"), ("pos", "<u4")])
#: Turns of probing before all that is left is compared.
PROBES = 2
#: Members of a shingle that are compared within one task.
BLOCK = 2_000


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    return np.where(n > 0, n - -(-percent * n // 100) + 1, 0)


def set_ids(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A hash of each set: a sum, so the order is no matter, mixed with its size."""
    n = np.diff(offsets)
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(K.mix(h ^ np.uint64(0x5851F42D4C957F2D)))])
        return K.mix((total[offsets[1:]] - total[offsets[:-1]]) ^ n.astype(np.uint64))


def document_sets(docs: DataFrame, width: int) -> DataFrame:
    """Rows (doc_id, text_hash, sid, n, sketch) of documents, and rows (token, times) of shingles that repeat within a task.

    Only the first copy of a set in a task has its sketch.
    """

    @released
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, seen = [], 0, set()
        null = lambda n, kind: pa.nulls(n, kind)

        def often() -> pa.RecordBatch:
            token, times = np.unique(np.concatenate(held), return_counts=True)
            on = times >= OFTEN_IN_TASK
            n = int(on.sum())
            return pa.record_batch([null(n, id_type), null(n, pa.int64()), null(n, pa.int64()), null(n, pa.int64()), null(n, pa.binary()), *[null(n, pa.int64())] * PARITY_LONGS, pa.array(token[on].view(np.int64)), pa.array(times[on].astype(np.int64))], names=names)

        names = ["doc_id", "text_hash", "sid", "n", "sketch", *PARITY, "token", "times"]
        for batch in batches:
            id_type = batch.column(0).type
            for s in K.slices(batch.column(2)):
                h, offsets = K.shingle_sets(s, width)
                sid, n = set_ids(h, offsets), np.diff(offsets)
                rows = slice(s.first, s.first + len(n))
                # Copies of one set count once here: they are one document of the join.
                new = np.array([x not in seen and seen.add(x) is None for x in sid.tolist()], bool)
                sketches = pa.array([sketch(h[a:b]) if x and b > a else None for x, a, b in zip(new, offsets[:-1], offsets[1:])], pa.binary())
                yield pa.record_batch([batch.column(0)[rows], batch.column(1)[rows], pa.array(sid.view(np.int64)), pa.array(n), sketches, *map(pa.array, parity(h, offsets).T), null(len(n), pa.int64()), null(len(n), pa.int64())], names=names)
                held.append(h[np.repeat(new, n)])
                size += len(held[-1])
                if size > TASK_SHINGLES:
                    yield often()
                    held, size, seen = [], 0, set()
        if held:
            yield often()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(part, f"doc_id {kind}, text_hash long, sid long, n long, sketch binary, {', '.join(f'{p} long' for p in PARITY)}, token long, times long")


def parity(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per set, 2,048 bits as longs: whether the number of its hashes in each of 2,048 classes is odd.

    Each hash that only one of two sets has turns one bit, so the bits that differ are never more than those hashes.
    """
    n, bits = len(offsets) - 1, 64 * PARITY_LONGS
    out = np.zeros((n, PARITY_LONGS), np.int64)
    doc = np.repeat(np.arange(n), np.diff(offsets))
    for lo in range(0, n, 64):  # some documents at a time, to bound the counts
        a, b = offsets[lo], offsets[min(lo + 64, n)]
        place = (doc[a:b] - lo) * bits + ((h[a:b] >> np.uint64(20)) % np.uint64(bits)).astype(np.int64)
        odd = np.bincount(place, minlength=(min(lo + 64, n) - lo) * bits) & 1
        out[lo : lo + 64] = np.packbits(odd.astype(np.uint8).reshape(-1, bits), axis=1).view(np.int64)
    return out


def often_tokens(sets: DataFrame) -> np.ndarray:
    """Sorted hashes of the shingles to put last: at most OFTEN_MOST of them, 3 MB, whatever the corpus."""
    totals = written(sets.where("token IS NOT NULL").groupBy("token").agg(F.sum("times").alias("times")).where(F.col("times") >= OFTEN), "often")
    least = OFTEN
    while totals.where(F.col("times") >= least).count() > OFTEN_MOST:
        least *= 2
    found = totals.where(F.col("times") >= least).select("token").toPandas()["token"].to_numpy(np.int64)
    return np.sort(found.view(np.uint64))


def prefix_parts(docs: DataFrame, width: int, percent: int, last: np.ndarray, ranges: int) -> DataFrame:
    """Rows (range, entries): prefix entries (token, group, place in the order) packed as bytes; and rows (group, sid, n) with range -1."""
    spread = docs.sparkSession.sparkContext.broadcast(last)

    @released
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen, groups = spread.value, set(), set()
        names = ["range", "entries", "grp", "sid", "n"]
        for batch in batches:
            found, members = [np.zeros(0, ENTRY)], []
            for s in K.slices(batch.column(0)):
                h, offsets = K.shingle_sets(s, width)
                n = np.diff(offsets)
                sid = set_ids(h, offsets)
                if len(last):
                    at = np.minimum(np.searchsorted(last, h), len(last) - 1)
                    late = last[at] == h
                    doc = np.repeat(np.arange(len(n)), n)
                    h = h[np.lexsort((h, late, doc))]
                p = prefix_length(n, percent)
                place = np.arange(len(h)) - np.repeat(offsets[:-1], n)
                first = place < np.repeat(p, n)
                with np.errstate(over="ignore"):
                    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(np.where(first, K.mix(h ^ np.uint64(0x14057B7EF767814F)), np.uint64(0)))])
                    group = K.mix((total[offsets[1:]] - total[offsets[:-1]]) ^ K.mix(n.astype(np.uint64)))
                keep = np.zeros(len(n), bool)
                for i, (x, g) in enumerate(zip(sid.tolist(), group.tolist())):
                    if n[i] and x not in seen:
                        seen.add(x)
                        members.append((g, x, n[i]))
                        if g not in groups:
                            groups.add(g)
                            keep[i] = True
                if len(seen) > 1_000_000:
                    seen, groups = set(), set()
                on = first & np.repeat(keep, n)
                e = np.empty(int(on.sum()), ENTRY)
                e["token"], e["grp"], e["pos"] = h[on], np.repeat(group, n)[on], place[on]
                found.append(e)
            both = np.concatenate(found)
            where = ((both["token"] >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(where, kind="stable")
            edge = np.searchsorted(where[order], np.arange(ranges + 1))
            both = both[order]
            full = np.flatnonzero(np.diff(edge))
            blobs = [both[edge[r] : edge[r + 1]].tobytes() for r in full]
            k, m = len(blobs), len(members)
            if k:
                yield pa.record_batch([pa.array(full.astype(np.int32)), pa.array(blobs, pa.binary()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64())], names=names)
            if m:
                g, x, n = (np.array(v, np.uint64).view(np.int64) for v in zip(*members))
                yield pa.record_batch([pa.array(np.full(m, -1, np.int32)), pa.nulls(m, pa.binary()), pa.array(g), pa.array(x), pa.array(n)], names=names)

    return docs.select("text").mapInArrow(part, "range int, entries binary, grp long, sid long, n long")


def shared_tokens(parts: DataFrame) -> DataFrame:
    """Entries (token, grp, pos) whose token is in the prefix of two groups or more; rows (grp, sid, n) of members go through."""

    @released
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["token", "grp", "pos", "sid", "n"]
        held: dict[int, list[bytes]] = {}
        for batch in batches:
            member = pa.compute.is_valid(batch.column(3))
            if pa.compute.any(member).as_py():
                rows = batch.filter(member)
                yield pa.record_batch([pa.nulls(rows.num_rows, pa.int64()), rows.column(2), pa.nulls(rows.num_rows, pa.int64()), *rows.columns[3:]], names=names)
            rows = batch.filter(pa.compute.invert(member))
            for r, x in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
                held.setdefault(r, []).append(x)
        while held:
            e = np.frombuffer(b"".join(held.popitem()[1]), ENTRY)
            e = e[np.lexsort((e["grp"], e["token"]))]
            new = np.ones(len(e), bool)
            new[1:] = e[1:] != e[:-1]
            e = e[new]
            same = e["token"][1:] == e["token"][:-1]
            on = np.zeros(len(e), bool)
            on[1:] |= same
            on[:-1] |= same
            out = [pa.array(np.ascontiguousarray(e[k][on]).astype(np.uint64).view(np.int64)) for k in ("token", "grp", "pos")]
            null = pa.nulls(int(on.sum()), pa.int64())
            yield pa.record_batch([*out, null, null], names=names)

    return parts.mapInArrow(part, "token long, grp long, pos long, sid long, n long")


def sketch(h: np.ndarray) -> bytes:
    """Counts of a set's hashes by their leading bits, up to 3 in 2 bits each, and how many more there are.

    A byte says how many bits lead (2 ** bits is the set's size or a bit more), four bytes hold the excess.
    """
    bits = max(3, int(len(h) - 1).bit_length())
    count = np.bincount((h >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    low = np.minimum(count, 3)
    packed = (low.reshape(-1, 4) << np.array([0, 2, 4, 6])).sum(1).astype(np.uint8)
    return bytes([bits]) + int((count - low).sum()).to_bytes(4, "little") + packed.tobytes()


def most_common(x: bytes, y: bytes) -> int:
    """At least as many as two sets share, from their sketches."""
    counts = []
    for z in (x, y):
        counts.append(((np.frombuffer(z, np.uint8, offset=5)[:, None] >> np.array([0, 2, 4, 6])) & 3).ravel())
    a, b = counts
    n = min(len(a), len(b))
    a, b = a.reshape(n, -1).sum(1), b.reshape(n, -1).sum(1)
    return int(np.minimum(a, b).sum()) + int.from_bytes(x[1:5], "little") + int.from_bytes(y[1:5], "little")


def whole_sets(docs: DataFrame, width: int, wanted: DataFrame) -> DataFrame:
    """(sid, members): hashes as bytes of wanted sets. wanted: doc_id, text_hash, sid, a row for each set."""
    few = wanted.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    hint = F.broadcast if few else (lambda x: x)
    d = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    w = wanted.select(F.col("doc_id").alias("w_id"), F.col("text_hash").alias("w_hash"), "sid")
    chosen = d.join(hint(w), d["doc_id"].eqNullSafe(w["w_id"]) & (d["text_hash"] == w["w_hash"])).select("sid", "text")

    @released
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in K.slices(batch.column(1)):
                h, offsets = K.shingle_sets(s, width)
                sets = [h[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])]
                yield pa.record_batch([batch.column(0)[s.first : s.first + len(sets)], pa.array(sets, pa.binary())], names=["sid", "members"])

    return chosen.mapInArrow(part, "sid long, members binary")


def _paired(pairs: DataFrame, sets: DataFrame, *values: str) -> DataFrame:
    left = sets.select(F.col("sid").alias("a"), *(F.col(v).alias(f"{v}_a") for v in values))
    right = sets.select(F.col("sid").alias("b"), *(F.col(v).alias(f"{v}_b") for v in values))
    return pairs.join(left, "a").join(right, "b").select("a", "b", *(f"{v}_{k}" for v in values for k in "ab"))


class Verifier:
    """Tells which pairs of sets link: by what sketches leave possible, then on the whole sets of those that are left."""

    def __init__(self, docs: DataFrame, own: DataFrame, width: int, percent: int):
        self.docs, self.width, self.percent = docs, width, percent
        self.rows = own.groupBy("sid").agg(F.min(F.struct("doc_id", "text_hash")).alias("row"), F.first("n").alias("n"), F.first("sketch", ignorenulls=True).alias("sketch"), *(F.first(p).alias(p) for p in PARITY))
        self.rows = written(self.rows.select("sid", "row.doc_id", "row.text_hash", "n", "sketch", *PARITY), "sketches")

    def links(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) whose similarity is high enough."""
        percent = self.percent

        @released
        def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                on = []
                for m, n, x, y in zip(*(batch.column(k).to_pylist() for k in range(2, 6))):
                    common = min(most_common(x, y), m, n)
                    on.append(100 * common >= percent * (m + n - common))
                yield pa.record_batch(batch.columns[:2], names=["a", "b"]).filter(pa.array(on, pa.bool_()))

        @released
        def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                on = []
                for x, y in zip(batch.column(2), batch.column(3)):
                    x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                    both = np.concatenate([x, y])
                    both.sort(kind="stable")
                    common = int((both[1:] == both[:-1]).sum())
                    on.append(100 * common >= percent * (len(x) + len(y) - common))
                yield pa.record_batch(batch.columns[:2], names=["a", "b"]).filter(pa.array(on, pa.bool_()))

        left = written(_paired(pairs, self.rows, "n", "sketch").mapInArrow(possible, "a long, b long"), "possible")
        ids = left.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
        sets = whole_sets(self.docs, self.width, self.rows.join(ids, "sid").select("doc_id", "text_hash", "sid"))
        # Rows that repeat a document repeat its set, so its pairs, too.
        return written(_paired(left, written(sets, "sets"), "members").mapInArrow(exact, "a long, b long").distinct(), "links")


def _fits(x: str, y: str, percent: int) -> Column:
    """Bounds by size and place: `x` and `y` prefix columns n and pos, where `{}` stands for the name.

    A pair of sizes m and n shares at least percent / (100 + percent) of m + n, so its first common shingle comes early in
    both sets; that holds for one of the shingles that bring the pair here, if it links.
    """
    (m, i), (n, j) = ((F.col(c.format("n")), F.col(c.format("pos"))) for c in (x, y))
    need = F.ceil(percent * (m + n) / (100 + percent))
    return (100 * F.least(m, n) >= percent * F.greatest(m, n)) & (i + need <= m) & (j + need <= n)


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def set_links(docs: DataFrame, sets: DataFrame, width: int, percent: int) -> DataFrame:
    """(node, label): the component of each set that links with another set."""
    own = sets.where("sid IS NOT NULL AND n > 0")
    last = often_tokens(sets)
    total = own.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    ranges = max(12, int(total * (1 - percent / 100)) // RANGE_ENTRIES + 1)
    packed = prefix_parts(docs, width, percent, last, ranges)
    dealt = packed.repartition(ranges, F.when(F.col("range") >= 0, F.col("range")).otherwise(F.pmod("grp", F.lit(ranges))))
    prefixes = written(shared_tokens(dealt), "prefixes")
    members = written(prefixes.where("sid IS NOT NULL").select("grp", "sid", "n").distinct(), "members")
    groups = members.groupBy("grp").agg(F.min("sid").alias("head"), F.first("n").alias("n"), F.count("*").alias("size"))
    entries = prefixes.where("token IS NOT NULL").select("token", "grp", "pos").join(groups, "grp")

    verify = Verifier(docs, own, width, percent)
    # One group for each shingle, and one member for each group: linear in the entries.
    ends = entries.groupBy("token").agg(F.min(F.struct("head", "n", "pos")).alias("lo"), F.max(F.struct("head", "n", "pos")).alias("hi"))
    near = entries.join(ends, "token").select("head", "n", "pos", F.explode(F.array("lo", "hi")).alias("to")).where(_fits("{}", "to.{}", percent))
    star = near.select(F.col("head").alias("a"), F.col("to.head").alias("b"))
    star = star.unionByName(members.join(groups.where("size > 1").select("grp", "head"), "grp").select(F.col("sid").alias("a"), F.col("head").alias("b")))
    tried = written(_ordered(star), "star")
    labels = written(components(verify.links(tried)), "labels")

    # What may still join two components: members that share a shingle of their prefixes, or all of them.
    each = entries.select("token", "grp", "pos").unionByName(groups.where("size > 1").select(F.col("grp").alias("token"), "grp", F.lit(0).cast("long").alias("pos")))
    left = each.join(members, "grp").select("token", "sid", "n", "pos").distinct()
    for turn in range(PROBES):
        left = _open(left, labels)
        probes = written(_ordered(_probes(left, turn, percent)).join(tried, ["a", "b"], "left_anti"), "probes")
        more = verify.links(probes)
        if more.isEmpty():
            break
        tried = tried.unionByName(probes)
        labels = joined(labels, more)
    # Never null, as far as Spark can tell: else the code for the condition is too long for the JVM to compile.
    bits = verify.rows.select("sid", *(F.coalesce(p, F.lit(0).cast("long")).alias(p) for p in PARITY))
    left = _open(left, labels).join(bits, "sid")
    x, y = _blocks(left)
    differ = lambda names: sum((F.bit_count(F.col(f"{p}_x").bitwiseXOR(F.col(f"{p}_y"))) for p in names), F.lit(0))
    sizes = F.col("n_x") + F.col("n_y")
    most = sizes - 2 * F.ceil(percent * sizes / (100 + percent))
    near_enough = (differ(PARITY[:6]) <= most) & (differ(PARITY) <= most)  # a few bits tell most pairs apart
    apart = (F.col("label_x") < F.col("label_y")) | (F.col("one") < F.col("two")) & (F.col("label_x") != F.col("label_y"))
    pairs = x.join(y, ["token", "one", "two"]).where(apart & _fits("{}_x", "{}_y", percent) & near_enough)
    rest = written(_ordered(pairs.select(F.col("sid_x").alias("a"), F.col("sid_y").alias("b"))).join(tried, ["a", "b"], "left_anti"), "rest")
    more = verify.links(rest)
    return labels if more.isEmpty() else joined(labels, more)


def _open(entries: DataFrame, labels: DataFrame) -> DataFrame:
    """Entries (token, sid, n, pos, label, members) of shingles whose members aren't all in one component yet; members: how many."""
    e = entries.select("token", "sid", "n", "pos").join(labels, F.col("sid") == F.col("node"), "left").select("token", "sid", "n", "pos", F.coalesce("label", "sid").alias("label"))
    ends = e.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("members")).where("lo < hi").select("token", "members")
    return written(e.join(ends, "token"), "open")


def _blocks(left: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two sides whose join on (token, one, two) has every pair of a token's members once, in any order where one < two, in both if they are equal.

    Members are cut into blocks by a hash, and a pair meets under the numbers of its blocks: many tasks share a hot token.
    """
    names = ("sid", "n", "pos", "label", *PARITY)
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    own = left.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))
    few, many = own.where("blocks = 1"), own.where("blocks > 1")
    sides = []
    for k, one, two in (("x", F.col("own"), F.explode(F.expr("sequence(own, blocks - 1)"))), ("y", F.explode(F.expr("sequence(0, own)")), F.col("own"))):
        values = [F.col(c).alias(f"{c}_{k}") for c in names]
        alone = few.select("token", F.lit(0).alias("one"), F.lit(0).alias("two"), *values)
        sides.append(alone.unionByName(many.select("token", one.alias("one"), two.alias("two"), *values)))
    return sides[0], sides[1]


def _probes(left: DataFrame, turn: int, percent: int) -> DataFrame:
    """Pairs (a, b): members with members of the component that most of their shingle's members have.

    Each shingle names one of those, another one each turn; a member tries two shingles for each such component.
    """
    sizes = left.groupBy("token", "label").agg(F.count("*").alias("size"), F.min_by(F.struct("sid", "n", "pos"), F.xxhash64("sid", "token", F.lit(turn))).alias("one"))
    hub = sizes.groupBy("token").agg(F.max(F.struct("size", "label", "one")).alias("hub")).select("token", F.col("hub.label").alias("to"), F.col("hub.one").alias("one"))
    asks = left.join(hub, "token").where((F.col("label") != F.col("to")) & _fits("{}", "one.{}", percent))
    by = F.xxhash64("token", "sid", F.lit(turn))
    two = asks.groupBy("sid", "to").agg(F.min_by("one.sid", by).alias("first"), F.max_by("one.sid", by).alias("last"))
    return two.select(F.col("sid").alias("a"), F.explode(F.array("first", "last")).alias("b"))


def jaccard_components(docs: DataFrame, *, width: int = 5, percent: int = 80) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, text_hash, label (of the component; null for an empty set)."""
    docs = plain_columns(docs, "doc_id", "text")
    small_arrow_batches(docs.sparkSession)
    sets = written(document_sets(docs, width), "documents")
    labels = set_links(docs, sets, width, percent)
    rows = sets.where("sid IS NOT NULL").select("doc_id", "text_hash", "sid", "n")
    full = rows.where("n > 0").join(labels, F.col("sid") == F.col("node"), "left").withColumn("label", F.coalesce("label", "sid")).drop("node", "sid")
    # A component may hold most rows: minima are combined before the shuffle, and written, so that its rows needn't meet in one task.
    least = written(full.groupBy("label").agg(F.min("doc_id").alias("component_id")), "least")
    full = full.join(F.broadcast(least) if least.count() <= BROADCAST_IDS else least, "label")
    empty = rows.where("n = 0").select("doc_id", "text_hash", "n", F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("label"))
    return full.unionByName(empty, allowMissingColumns=True).select("doc_id", F.col("n").alias("n_shingles"), "component_id", "text_hash", "label")


def keep_one(docs: DataFrame, *, width: int = 5, percent: int = 80) -> DataFrame:
    """The documents, all columns, with one of each component: the smallest doc_id, then the smallest text hash.

    Documents with an empty set all stay.
    """
    found = written(jaccard_components(docs, width=width, percent=percent), "components")
    kept = found.where("label IS NOT NULL").groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("row"), F.count("*").alias("size"))
    kept = kept.select(F.col("row.doc_id").alias("k_id"), F.col("row.text_hash").alias("k_hash"))
    stay = kept.unionByName(found.where("label IS NULL").select(F.col("doc_id").alias("k_id"), F.col("text_hash").alias("k_hash")).distinct())
    # Rows equal in doc_id and text are one document here; they are rare, and numbered only if there are any.
    repeated = found.where("label IS NOT NULL").groupBy("doc_id", "text_hash").count().where("count > 1")
    text_hash = F.xxhash64(docs["text"])
    if repeated.limit(1).count():
        from pyspark.sql import Window

        same = Window.partitionBy("doc_id", "__hash").orderBy(*(c for c in docs.columns if c != "doc_id"))
        docs = docs.withColumn("__hash", F.xxhash64("text")).withColumn("__nth", F.row_number().over(same))
        docs = docs.join(found.where("label IS NULL").select(F.col("doc_id").alias("e_id"), F.col("text_hash").alias("e_hash"), F.lit(True).alias("__empty")).distinct(), docs["doc_id"].eqNullSafe(F.col("e_id")) & docs["__hash"].eqNullSafe(F.col("e_hash")), "left")
        docs = docs.where("__nth = 1 OR __empty").drop("__nth", "__empty", "e_id", "e_hash")
        text_hash = docs["__hash"]
    return docs.join(stay, docs["doc_id"].eqNullSafe(stay["k_id"]) & text_hash.eqNullSafe(stay["k_hash"]), "left_semi").drop("__hash")
