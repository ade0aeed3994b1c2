"""Token ids in a content-addressed store.

Texts are encoded with a public tokenizer and an end id each. A rolling hash over the ids cuts a document's stream where
its content says so, so equal passages give equal chunks; a chunk is stored once, under its SHA-256. A document's recipe
lists its chunks; recipes are written in ascending doc_id order, in shards; a Merkle manifest has a root for each block
of recipes, each shard and the whole. Reading checks every chunk against its digest and every root against the manifest
before it answers from the chunks: a document's checksum is combined from those of its chunks, so ids never travel.

The format, as Parquet tables in one folder: chunks (digest, ids: little-endian 16-bit ids, n), recipes (shard, doc_id,
root, digests), manifest (level 0 = block, 1 = shard, 2 = all; shard, block, root). Ids must be below 65,536.

Defined results. A null or empty text has only the end id. Rows that repeat a doc_id stay, ordered by their digest; a null
doc_id comes first. An empty table gives an empty store, whose root is the digest of nothing. Damage raises an error.
"""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.llm import kernel as K
from factloom.llm.shared import arrow_batches, delete, new_path, plain_columns, small_arrow_batches

END_ID = 1
CHUNK = {"least": 64, "mask_bits": 9, "most": 4096}
BLOCK = 1024
#: White space, to some tokenizers, besides the six ASCII kinds at which a text may be cut into independent pieces.
ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")
CACHE_PIECES = 800_000
GEAR = K.stream(21, 1 << 16)


#: Text of plain letters, digits, signs and space: ASCII and the precomposed Latin letters, all their own NFC. There, a
#: byte from 0x80 is always of a letter. An apostrophe may begin a contraction, so text with one isn't plain.
PLAIN = re.compile("[\t-\r -&(-~À-ÖØ-öø-įı-ſ]*")
SPACES = re.compile("[ \t-\r]+")
SPACE, LETTER, DIGIT, SIGN = 0, 1, 2, 3
KIND = np.full(256, SIGN, np.uint8)
KIND[K.SPACE] = SPACE
KIND[ord("a") : ord("z") + 1] = LETTER
KIND[0x80:] = LETTER
KIND[ord("0") : ord("9") + 1] = DIGIT


class PieceEncoder:
    """Encodes texts by the vocabulary's pieces, each distinct piece once; `word_bpe_49k` never merges across pieces.

    Plain text is folded and cut here: letters in a row, single digits, other signs in a row; pieces not seen before are
    encoded in one call. Other text is cut at white space into words, or, with odd white space or special tokens, not at
    all, and encoded as it is. About CACHE_PIECES pieces are kept, by 64-bit hash, as bytes of 16-bit ids.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        #: The same vocabulary for pieces that are already folded and cut.
        self.cut_tokenizer = Tokenizer.from_file(path)
        self.cut_tokenizer.normalizer = None
        self.cut_tokenizer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        #: Ids that end a piece: the vocabulary marks them.
        self.ends_piece = np.zeros(1 << 16, bool)
        self.ends_piece[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]] = True
        self.known: dict[int, bytes] = {}
        self.words: dict[str, bytes] = {}

    def as_it_is(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u2").tobytes()

    def other(self, text: str) -> bytes:
        """Ids of a text that isn't plain."""
        if "<|" in text or ODD_SPACE.search(text):
            return self.as_it_is(text)
        words = SPACES.split(text)
        if len(self.words) > CACHE_PIECES // 4:
            self.words.clear()
        for w in set(words) - self.words.keys():
            self.words[w] = self.as_it_is(w) if w else b""
        return b"".join(map(self.words.__getitem__, words))

    def learn(self, keys: list[int], pieces: list[str]) -> None:
        for i in range(0, len(pieces), 2000):
            part = pieces[i : i + 2000]
            e = self.cut_tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0]
            ids = np.array(e.ids, "<u2")
            edge = [0, *(np.flatnonzero(self.ends_piece[ids]) + 1).tolist()]
            if len(edge) != len(part) + 1:
                raise ValueError("a piece was cut again")
            raw = ids.tobytes()
            self.known.update((k, raw[2 * a : 2 * b]) for k, a, b in zip(keys[i : i + 2000], edge, edge[1:]))

    def plain(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of plain texts in lower case."""
        for s in K.slices(pa.array(texts, pa.string()), 2 << 20):
            kind = KIND[s.buf]
            n = len(s.offsets) - 1
            edge = np.zeros(len(kind) + 1, bool)
            edge[s.offsets] = True
            inside = kind != SPACE
            turn = np.concatenate([[True], kind[1:] != kind[:-1]]) | edge[:-1] | (kind == DIGIT) if len(kind) else np.zeros(0, bool)
            start = np.flatnonzero(turn & inside)
            stop = np.concatenate([turn[1:], [True]]) | ~inside if len(kind) else turn
            end = np.flatnonzero(stop & inside) + 1
            if not len(start):
                yield from [b""] * n
                continue
            h, first, inverse = np.unique(K.span_hash(s.buf, inside, start, end, False), return_index=True, return_inverse=True)
            keys = h.tolist()
            ids = list(map(self.known.get, keys))
            new = [i for i, x in enumerate(ids) if x is None]
            if new:
                if len(self.known) + len(new) > CACHE_PIECES:
                    self.known = {k: x for k, x in zip(keys, ids) if x is not None}
                raw = s.buf.tobytes()
                at, to = start[first].tolist(), end[first].tolist()
                self.learn([keys[i] for i in new], [raw[at[i] : to[i]].decode() for i in new])
                for i in new:
                    ids[i] = self.known[keys[i]]
            size = np.fromiter(map(len, ids), np.int64, len(ids)) // 2
            begin = np.cumsum(size) - size
            each = size[inverse]
            ahead = np.cumsum(each) - each
            flat = np.frombuffer(b"".join(ids), "<u2")[np.repeat(begin[inverse] - ahead, each) + np.arange(int(each.sum()))].tobytes()
            total = np.concatenate([[0], np.cumsum(each)])
            cut = 2 * total[np.searchsorted(start, s.offsets)]
            yield from (flat[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()))

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, each with the end id, and the number of each."""
        plain = [text is None or "<|" not in text and PLAIN.fullmatch(text) is not None for text in texts]
        done = self.plain([text.lower() if text else "" for text, p in zip(texts, plain) if p])
        end = np.array([END_ID], "<u2").tobytes()
        out = [(next(done) if p else self.other(text)) + end for text, p in zip(texts, plain)]
        return np.frombuffer(b"".join(out), "<u2"), np.array([len(x) // 2 for x in out], np.int64)


@lru_cache(maxsize=1)
def encoder(path: str) -> PieceEncoder:
    """One for each worker, kept from task to task."""
    return PieceEncoder(path)


def cuts(ids: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """Ends of the chunks of each document, within the document: a gear hash of the last 16 ids picks them."""
    with np.errstate(over="ignore"):
        h = np.zeros(len(ids), np.uint64)
        g = GEAR[ids]
        for k in range(16):
            h[k:] += g[: max(len(g) - k, 0)] << np.uint64(4 * k)
    likely = np.flatnonzero((K.mix(h) >> np.uint64(64 - CHUNK["mask_bits"])) == 0) + 1
    out, begin = [], 0
    for size in sizes.tolist():
        a, b = np.searchsorted(likely, [begin + 16, begin + size])
        ends, last = [], 0
        for e in (*(likely[a:b] - begin).tolist(), size):
            while e - last > CHUNK["most"]:
                last += CHUNK["most"]
                ends.append(last)
            if e == size or e - last >= CHUNK["least"]:
                last = e
                ends.append(e)
        out.append(ends)
        begin += size
    return out


def encoded(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Per document: doc_id, n_tokens, digests, chunks (the ids as bytes)."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for batch in batches:
            ids, sizes = encode(batch.column(1).to_pylist())
            digests, chunks, begin = [], [], 0
            for size, ends in zip(sizes.tolist(), cuts(ids, sizes)):
                parts = [ids[begin + a : begin + b].astype("<u2").tobytes() for a, b in zip([0, *ends], ends)]
                chunks.append(parts)
                digests.append([hashlib.sha256(p).digest() for p in parts])
                begin += size
            kind = pa.list_(pa.binary())
            yield pa.record_batch([batch.column(0), pa.array(sizes), pa.array(digests, kind), pa.array(chunks, kind)], names=["doc_id", "n_tokens", "digests", "chunks"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(part, f"doc_id {kind}, n_tokens long, digests array<binary>, chunks array<binary>")


def merkle(recipes: DataFrame) -> DataFrame:
    """level, shard, block, root: for blocks of recipes, for shards and for all. Groups are blocks, so of bounded size."""
    ordered = Window.partitionBy("shard").orderBy("doc_id", "root")
    leaf = recipes.select("shard", (F.row_number().over(ordered) - 1).alias("i"), "root")

    def up(level: DataFrame) -> DataFrame:
        nodes = F.array_sort(F.collect_list(F.struct("i", "root")))
        return level.groupBy("shard", F.floor(F.col("i") / BLOCK).alias("j")).agg(F.sha2(F.array_join(F.transform(nodes, lambda x: x["root"]), ""), 256).alias("root")).select("shard", F.col("j").alias("i"), "root")

    blocks = up(leaf)
    shards = up(up(blocks)).select("shard", "root")
    tops = F.transform(F.array_sort(F.collect_list(F.struct("shard", "root"))), lambda x: x["root"])
    null = F.lit(None).cast("int")
    out = blocks.select(F.lit(0).alias("level"), "shard", F.col("i").cast("long").alias("block"), "root")
    out = out.unionByName(shards.select(F.lit(1).alias("level"), "shard", null.cast("long").alias("block"), "root"))
    return out.unionByName(shards.agg(F.sha2(F.array_join(tops, ""), 256).alias("root")).select(F.lit(2).alias("level"), null.alias("shard"), null.cast("long").alias("block"), "root"))


def write_store(docs: DataFrame, vocabulary: str, path: str) -> None:
    """Encode all documents into the store at `path`."""
    spark = docs.sparkSession
    zipped = {"compression": "zstd"}
    with arrow_batches(spark, 1000, 8 << 20):  # a batch's pieces are encoded once
        encoded(plain_columns(docs, "doc_id", "text"), vocabulary).write.options(**zipped).parquet(f"{path}/encoded")
    staged = spark.read.parquet(f"{path}/encoded")
    chunks = staged.select(F.explode(F.arrays_zip("digests", "chunks")).alias("c")).select(F.col("c.digests").alias("digest"), F.col("c.chunks").alias("ids"))
    once = chunks.dropDuplicates(["digest"]).withColumn("n", (F.octet_length("ids") / 2).cast("int"))
    once.write.options(**zipped).parquet(f"{path}/chunks")
    root = F.sha2(F.array_join(F.transform("digests", F.hex), ""), 256)
    recipes = staged.select("doc_id", root.alias("root"), "digests").repartitionByRange("doc_id").withColumn("shard", F.spark_partition_id())
    recipes.sortWithinPartitions("doc_id", "root").write.options(**zipped).parquet(f"{path}/recipes")
    merkle(spark.read.parquet(f"{path}/recipes")).write.options(**zipped).parquet(f"{path}/manifest")
    delete(spark, f"{path}/encoded")  # a second copy of all ids


def _checked_chunks(store: DataFrame) -> DataFrame:
    """digest, n, crc of each chunk's ids as little-endian 32-bit integers; a chunk that isn't what its digest says raises."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digest, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            if any(hashlib.sha256(x).digest() != d for d, x in zip(digest, ids)):
                raise ValueError("a chunk doesn't match its digest")
            crc = [zlib.crc32(np.frombuffer(x, "<u2").astype("<u4").tobytes()) for x in ids]
            yield pa.record_batch([batch.column(0), pa.array([len(x) // 2 for x in ids], pa.int64()), pa.array(crc, pa.int64())], names=["digest", "n", "crc"])

    return store.select("digest", "ids").mapInArrow(part, "digest binary, n long, crc long")


def _doubling() -> list[np.ndarray]:
    """For each k, what 2 ** k zero bytes do to each bit of a CRC-32 register."""
    step = np.array([0xEDB88320, *(1 << b for b in range(31))], np.uint32)  # one zero bit
    apply = lambda m, x: np.bitwise_xor.reduce(np.where((x[:, None] >> np.arange(32, dtype=np.uint32)) & 1, m, np.uint32(0)), axis=1)
    for _ in range(3):
        step = apply(step, step)
    out = [step]
    for _ in range(47):
        out.append(apply(out[-1], out[-1]))
    return out


ZEROS = _doubling()


def crc_join(a: np.ndarray, b: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """CRC-32 of two strings end to end, from theirs and the bytes of the second."""
    a, left, k = a.astype(np.uint32).copy(), size_b.copy(), 0
    bits = np.arange(32, dtype=np.uint32)
    while left.any():
        odd = np.flatnonzero(left & 1)
        if len(odd):
            a[odd] = np.bitwise_xor.reduce(np.where((a[odd][:, None] >> bits) & 1, ZEROS[k], np.uint32(0)), axis=1)
        left, k = left >> 1, k + 1
    return a ^ b.astype(np.uint32)


def _joined(parts: DataFrame) -> DataFrame:
    """doc columns and `parts` (array of n, crc in order) to n_tokens and ids_crc32."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("parts"))
            size = np.diff(lists.offsets.to_numpy())
            at, flat = np.cumsum(size) - size, lists.flatten()
            n, crc = (flat.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            total, count = np.zeros(len(size), np.uint32), np.zeros(len(size), np.int64)
            for k in range(size.max(initial=0)):
                on = np.flatnonzero(size > k)
                total[on] = crc_join(total[on], crc[at[on] + k], 4 * n[at[on] + k])
                count[on] += n[at[on] + k]
            keep = [batch.column(x) for x in ("shard", "doc_id", "root")]
            yield pa.record_batch([*keep, pa.array(count), pa.array(total.astype(np.int64))], names=["shard", "doc_id", "root", "n_tokens", "ids_crc32"])

    kind = parts.schema["doc_id"].dataType.simpleString()
    return parts.mapInArrow(part, f"shard int, doc_id {kind}, root string, n_tokens long, ids_crc32 long")


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the store's files: doc_id, start, n_tokens, ids_crc32."""
    small_arrow_batches(spark)
    recipes = spark.read.parquet(f"{path}/recipes")
    again = merkle(recipes.withColumn("root", F.sha2(F.array_join(F.transform("digests", F.hex), ""), 256)))
    stored = spark.read.parquet(f"{path}/manifest")
    both = again.withColumn("of", F.lit(1)).unionByName(stored.withColumn("of", F.lit(-1)))
    if not both.groupBy("level", "shard", "block", "root").agg(F.sum("of").alias("of")).where("of <> 0").isEmpty():
        raise ValueError("recipes don't match the manifest")
    lines = recipes.withColumn("row", F.monotonically_increasing_id()).select("shard", "doc_id", "root", "row", F.posexplode("digests").alias("pos", "digest"))
    found = lines.join(_checked_chunks(spark.read.parquet(f"{path}/chunks")), "digest", "left")
    found = found.withColumn("n", F.when(F.col("n").isNull(), F.raise_error(F.lit("a recipe names a chunk that isn't stored")).cast("long")).otherwise(F.col("n")))
    grouped = found.groupBy("shard", "doc_id", "root", "row").agg(F.array_sort(F.collect_list(F.struct("pos", "n", "crc"))).alias("p"))
    docs = _joined(grouped.select("shard", "doc_id", "root", F.transform("p", lambda x: F.struct(x["n"].alias("n"), x["crc"].alias("crc"))).alias("parts")))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row for each shard
    starts = docs.groupBy("shard").agg(F.sum("n_tokens").alias("total")).select("shard", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("shard").orderBy("doc_id", "root").rowsBetween(Window.unboundedPreceding, -1)
    out = docs.join(starts, "shard").withColumn("start", F.col("ahead") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    return out.select("doc_id", "start", "n_tokens", "ids_crc32")


def token_store(docs: DataFrame, vocabulary: str, path: str | None = None) -> DataFrame:
    """Write the store, then answer from its files."""
    path = path or new_path(docs.sparkSession, "tokens")
    write_store(docs, vocabulary, path)
    return read_store(docs.sparkSession, path)
