"""LM scoring: a gated recurrent language model in numpy with a class-factored softmax.

Tokens are the words of a text, A-Z folded, and one end. Counts of all training tokens give the base score and, in the
model, the distribution inside tail classes. The `head` most frequent words and the end have classes of about equal size
by rank; every other word has one of TAIL classes by its spelling. The model gives P(class | state) and, in a head
class, P(word | class, state); in a tail class P(word | class) is by counts, smoothed as in the base. The state runs
through a whole document, carried from window to window, and starts anew with each document.

The weights are fitted by truncated back-propagation on all training documents. They are dealt by hash to shards, more
of them as the corpus grows; each shard goes on from the same first weights over all its tokens, and the weights of the
shards are averaged, by tokens. The first weights come from a bounded sample. Long documents train in pieces of at most
`piece` tokens, each from a new state. Words counted often enough to be among the `frequent` ones are sent to every task;
counts of rarer ones meet their tokens in a shuffle.

Defined results. A null or empty text is the end alone. A null doc_id is the text '' (held out). Without training rows N
and V are 0 and scores come from an untrained model over tail classes. Rows that repeat are scored each. Words and ends
are told apart by 64-bit hashes. Rows of an empty table: none.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import kernel as K
from factloom.llm.shared import plain_columns, small_arrow_batches, written

U64 = np.uint64
END = U64(0xE4D0F7EC7)
TAIL = 24
LANES = 512
FLUSH_TOKENS = 3_000_000
RANGE_WORDS = 800_000
COUNT = np.dtype([("h", "<u8"), ("c", "<u8"), ("k", "u1")])
ASK = np.dtype([("h", "<u8"), ("ref", "<i8")])
SMOOTH = 0.1
#: Counts are below 2 ** COUNT_BITS.
COUNT_BITS = 62
#: Weights that one task adds up.
NETS_IN_TASK = 64


class Settings(NamedTuple):
    """The model's parameters."""

    head: int = 1000
    head_classes: int = 32
    hidden: int = 16
    embed: int = 16
    window: int = 24
    batch: int = 64
    rate: float = 0.01
    epochs: int = 2
    sample_docs: int = 2000
    sample_bytes: int = 32_768
    sample_tokens: int = 800_000
    piece: int = 2048
    shard_bytes: int = 8 << 20
    shard_batch: int = 256
    shard_rate: float = 0.003
    block_tokens: int = 1_500_000
    frequent: int = 1_000_000
    seed: int = 5


#: What a last byte says about a word: 0 other letter or sign, 1 vowel, 2 n r s t d, 3 sentence end, 4 other punctuation.
LAST = np.zeros(256, np.int64)
LAST[list(b"aeiou")] = 1
LAST[list(b"nrstd")] = 2
LAST[list(b".!?")] = 3
LAST[list(b",;:)|\"'")] = 4


class Tokens(NamedTuple):
    hash: np.ndarray
    tail: np.ndarray  # tail class by spelling
    size: np.ndarray  # of each document


def tokens(s: K.Slice) -> Tokens:
    """All tokens of a slice, each document's words and its end."""
    w = K.words(s, True)
    n = len(s.offsets) - 1
    high = np.concatenate([[0], np.cumsum(s.buf >= 0x80)])
    accented = (high[w.end] > high[w.start]).astype(np.int64)
    last = LAST[K.LOWER[s.buf[w.end - 1]]] if len(w.end) else np.zeros(0, np.int64)
    kind = last + 5 * accented + 10 * ((w.end - w.start) > 6)
    size = np.bincount(w.doc, minlength=n) + 1
    ends = np.cumsum(size) - 1
    at = np.arange(len(w.doc)) + w.doc
    h, k = np.full(len(w.doc) + n, END, U64), np.full(len(w.doc) + n, TAIL - 1, np.int64)
    h[at], k[at] = w.hash, kind
    assert n == 0 or ends[-1] == len(h) - 1
    return Tokens(h, k, size)


def packed(entries: np.ndarray, ranges: int) -> pa.RecordBatch:
    where = ((entries["h"] >> U64(32)) * U64(ranges) >> U64(32)).astype(np.int64)
    order = np.argsort(where, kind="stable")
    edge = np.searchsorted(where[order], np.arange(ranges + 1))
    entries = entries[order]
    full = np.flatnonzero(np.diff(edge))
    return pa.record_batch([pa.array(full.astype(np.int32)), pa.array([entries[edge[r] : edge[r + 1]].tobytes() for r in full], pa.binary())], names=["range", "entries"])


def summed(entries: np.ndarray) -> np.ndarray:
    """Counts of equal words added, in order of hash."""
    entries = entries[np.argsort(entries["h"], kind="stable")]
    first = np.flatnonzero(np.concatenate([[True], entries["h"][1:] != entries["h"][:-1]])) if len(entries) else np.zeros(0, np.int64)
    out = entries[first].copy()
    if len(first):
        out["c"] = np.add.reduceat(entries["c"], first)
    return out


def word_counts(docs: DataFrame, ranges: int) -> DataFrame:
    """Rows (range, words): the training words whose hash lies in a range, with count and tail class, packed."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            h, first, c = np.unique(np.concatenate([t.hash for t in held]), return_index=True, return_counts=True)
            e = np.empty(len(h), COUNT)
            e["h"], e["c"], e["k"] = h, c, np.concatenate([t.tail for t in held])[first]
            return packed(e, ranges)

        held, size = [], 0
        for batch in batches:
            for s in K.slices(batch.column(0)):
                held.append(tokens(s))
                size += len(held[-1].hash)
            if size > FLUSH_TOKENS:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        waiting: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for r, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                waiting.setdefault(r, []).append(np.frombuffer(x, COUNT))
                if sum(map(len, waiting[r])) > RANGE_WORDS:
                    held[r] = summed(np.concatenate([held.get(r, np.zeros(0, COUNT)), *waiting.pop(r)]))
        for r in sorted({*held, *waiting}):
            e = summed(np.concatenate([held.get(r, np.zeros(0, COUNT)), *waiting.get(r, [])]))
            yield pa.record_batch([pa.array([r], pa.int32()), pa.array([e.tobytes()], pa.binary())], names=["range", "words"])

    train = docs.where("NOT held_out").select("text")
    return train.mapInArrow(send, "range int, entries binary").repartition(ranges, "range").mapInArrow(meet, "range int, words binary")


class Counts(NamedTuple):
    total: int  # N
    kinds: int  # V
    tail_total: np.ndarray  # of each tail class, head words left out
    tail_kinds: np.ndarray
    words: np.ndarray  # frequent words, in order of hash
    all_words: bool  # whether these are all
    head: np.ndarray  # hashes of the head in order of rank, the end first


def gathered(table: DataFrame, settings: Settings) -> Counts:
    """Totals, and the words counted at least 2 ** k times for the least k that gives at most `frequent` of them."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0).to_pylist():
                e = np.frombuffer(x, COUNT)
                c = e["c"].astype(np.int64)
                above = [int((c >= 1 << k).sum()) for k in range(COUNT_BITS)]
                by_class = [np.bincount(e["k"], minlength=TAIL).tolist(), np.bincount(e["k"], weights=c, minlength=TAIL).astype(np.int64).tolist()]
                yield pa.record_batch([pa.array([v], pa.list_(pa.int64())) for v in ([int(c.sum()), len(c)], above, *by_class)], names=["n", "above", "kinds", "total"])

    looked = table.select("words").mapInArrow(look, "n array<long>, above array<long>, kinds array<long>, total array<long>").toPandas()
    add = lambda name, n: np.sum(np.array(looked[name].tolist(), np.int64).reshape(-1, n), axis=0)
    (total, kinds), above = add("n", 2), add("above", COUNT_BITS)
    k = int(np.flatnonzero(above <= settings.frequent)[0])

    def often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0).to_pylist():
                e = np.frombuffer(x, COUNT)
                e = e[e["c"] >= 1 << k]
                yield pa.record_batch([pa.array([e.tobytes()], pa.binary())], names=["words"])

    found = table.select("words").mapInArrow(often, "words binary").toPandas()["words"]
    words = np.frombuffer(b"".join(bytes(x) for x in found), COUNT)
    words = words[np.argsort(words["h"])]
    ranked = words[words["h"] != END]
    ranked = ranked[np.lexsort((ranked["h"], -ranked["c"].astype(np.int64)))][: settings.head]
    head = np.concatenate([np.array([END], U64), ranked["h"]])
    own = words[np.isin(words["h"], head)]
    less = lambda values: np.bincount(own["k"], weights=values, minlength=TAIL).astype(np.int64)
    return Counts(int(total), int(kinds), add("total", TAIL) - less(own["c"].astype(np.int64)), add("kinds", TAIL) - less(np.ones(len(own))), words, k == 0, head)


class Net(NamedTuple):
    embed: np.ndarray  # inputs x embed: head words, tail classes, the start
    wx: np.ndarray
    wh: np.ndarray
    b: np.ndarray
    bn: np.ndarray  # of the candidate's recurrent part
    wc: np.ndarray  # hidden x classes
    bc: np.ndarray
    wo: np.ndarray  # head words x hidden
    bo: np.ndarray


class Layout(NamedTuple):
    """How ids are laid out: a head word's id is its rank; a tail class k is n_head + k; the start is the last."""

    n_head: int
    edge: np.ndarray  # of the head classes, by rank

    @property
    def n_classes(self) -> int:
        return len(self.edge) - 1 + TAIL

    def classes(self, ids: np.ndarray) -> np.ndarray:
        head = np.searchsorted(self.edge, ids, "right") - 1
        return np.where(ids < self.n_head, head, ids - self.n_head + len(self.edge) - 1)


def layout(n_head: int, settings: Settings) -> Layout:
    n = max(1, min(settings.head_classes, n_head))
    return Layout(n_head, np.unique(np.linspace(0, n_head, n + 1).astype(np.int64)))


def new_net(lay: Layout, settings: Settings) -> Net:
    rng = np.random.default_rng(settings.seed)
    e, h = settings.embed, settings.hidden
    make = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
    zero = lambda n: np.zeros(n, np.float32)
    return Net(make(lay.n_head + TAIL + 1, e), make(e, 3 * h), make(h, 3 * h), zero(3 * h), zero(h), make(h, lay.n_classes), zero(lay.n_classes), make(lay.n_head, h), zero(lay.n_head))


def softmax(x: np.ndarray) -> np.ndarray:
    """Of each column, in place: numpy reduces long rows much faster than many short ones."""
    x -= x.max(0)
    np.exp(x, out=x)
    x /= x.sum(0)
    return x


def log_softmax_at(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Logarithm of each column's softmax at one row; overwrites `x`."""
    out = x[at, np.arange(len(at))]
    top = x.max(0)
    x -= top
    np.exp(x, out=x)
    return out - top - np.log(x.sum(0))


def lanes(sizes: np.ndarray, width: int) -> list[list[int]]:
    """Documents dealt to lanes, the longest first to the shortest lane; a lane holds whole documents."""
    import heapq

    heap = [(0, i) for i in range(min(width, max(len(sizes), 1)))]
    out: list[list[int]] = [[] for _ in heap]
    for d in np.argsort(-sizes, kind="stable").tolist():
        load, i = heapq.heappop(heap)
        out[i].append(d)
        heapq.heappush(heap, (load + int(sizes[d]), i))
    return out


def in_lanes(ids: np.ndarray, sizes: np.ndarray, width: int, start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(steps x lanes): inputs, places of the tokens in `ids` (-1: none), and whether a document begins."""
    dealt = lanes(sizes, width)
    at = np.cumsum(sizes) - sizes
    steps = max((int(sizes[d].sum()) for d in dealt), default=0)
    x, place, fresh = np.full((steps, len(dealt)), start, np.int32), np.full((steps, len(dealt)), -1, np.int64), np.zeros((steps, len(dealt)), bool)
    for lane, own in enumerate(dealt):
        if own:
            places = np.concatenate([np.arange(at[d], at[d] + sizes[d]) for d in own])
            first = np.cumsum(sizes[own]) - sizes[own]
            before = np.concatenate([[start], ids[places[:-1]]])
            before[first] = start
            x[: len(places), lane], place[: len(places), lane], fresh[first, lane] = before, places, True
    return x, place, fresh


class Steps(NamedTuple):
    """What back-propagation needs of each step of a window."""

    before: np.ndarray  # the state it began with
    reset: np.ndarray
    update: np.ndarray
    inner: np.ndarray  # the candidate's recurrent part
    cand: np.ndarray


def steps(window: int, lanes: int, n: int) -> Steps:
    return Steps(*(np.empty((window, lanes, n), np.float32) for _ in Steps._fields))


def gate(x: np.ndarray) -> np.ndarray:
    """Sigmoid of twice `x`, in place."""
    np.tanh(x, out=x)
    x *= np.float32(0.5)
    x += np.float32(0.5)
    return x


def thirds(x: np.ndarray, n: int) -> list[np.ndarray]:
    return [np.ascontiguousarray(x[:, k * n : (k + 1) * n]) for k in range(3)]


def forward(net: Net, table: np.ndarray, x: np.ndarray, fresh: np.ndarray, h: np.ndarray, saved: Steps | None = None) -> np.ndarray:
    """States after each step of a window; `table` is the inputs' part of the gates. Fills `saved`, if given."""
    n, out, any_fresh = net.wh.shape[0], np.empty((len(x), len(h), net.wh.shape[0]), np.float32), fresh.any(1)
    half = np.float32(0.5)
    (in_reset, in_update, in_cand), (reset_h, update_h, cand_h) = thirds(table, n), thirds(net.wh, n)
    for w in (in_reset, in_update, reset_h, update_h):
        w *= half
    for t in range(len(x)):
        if any_fresh[t]:
            h = np.where(fresh[t][:, None], np.float32(0), h)
        reset, update, inner = h @ reset_h, h @ update_h, h @ cand_h
        reset += in_reset.take(x[t], 0)
        update += in_update.take(x[t], 0)
        inner += net.bn
        gate(reset)
        gate(update)
        cand = reset * inner
        cand += in_cand.take(x[t], 0)
        np.tanh(cand, out=cand)
        if saved:
            saved.before[t], saved.reset[t], saved.update[t], saved.inner[t], saved.cand[t] = h, reset, update, inner, cand
        new = out[t]
        np.subtract(h, cand, out=new)
        new *= update
        new += cand
        h = new
    return out


def token_logs(net: Net, lay: Layout, states: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """log P(class) + log P(word | class), natural, of flat states and ids; of a tail id the class alone."""
    cls = lay.classes(ids)
    x = net.wc.T @ states.T
    x += net.bc[:, None]
    out = log_softmax_at(x, cls)
    order = np.argsort(cls.astype(np.int16), kind="stable")
    edge = np.searchsorted(cls[order], np.arange(len(lay.edge)))
    for c in range(len(lay.edge) - 1):
        rows = order[edge[c] : edge[c + 1]]
        if len(rows):
            lo, hi = lay.edge[c], lay.edge[c + 1]
            x = net.wo[lo:hi] @ states[rows].T
            x += net.bo[lo:hi, None]
            out[rows] += log_softmax_at(x, ids[rows] - lo)
    return out


def fit(ids: np.ndarray, sizes: np.ndarray, lay: Layout, settings: Settings, net: Net | None = None) -> Net:
    """Truncated back-propagation through time with Adam; windows follow each other, so the state is carried, not the gradient.

    Goes on from `net`, if given, and leaves that as it is.
    """
    net = new_net(lay, settings) if net is None else Net(*(p.copy() for p in net))
    if not len(ids):
        return net
    start, n = lay.n_head + TAIL, settings.hidden
    x, place, fresh = in_lanes(ids, sizes, settings.batch, start)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net]
    step, windows = 0, -(-len(x) // settings.window) * settings.epochs
    saved, back = steps(settings.window, x.shape[1], n), steps(settings.window, x.shape[1], n)
    for _ in range(settings.epochs):
        h = np.zeros((x.shape[1], n), np.float32)
        for w in range(0, len(x), settings.window):
            xs, fs, ps = x[w : w + settings.window], fresh[w : w + settings.window], place[w : w + settings.window]
            table = net.embed @ net.wx + net.b
            now = Steps(*(s[: len(xs)] for s in saved))
            states = forward(net, table, xs, fs, h, now)
            h = states[-1]
            live = ps.ravel() >= 0
            if not live.any():
                continue
            y, flat = ids[ps.ravel()[live]], states.reshape(-1, n)[live]
            grads = [np.zeros_like(p) for p in net]
            scale = np.float32(1 / live.sum())
            cls = lay.classes(y)
            dc = net.wc.T @ flat.T
            dc += net.bc[:, None]
            softmax(dc)
            dc[cls, np.arange(len(y))] -= 1
            dc *= scale
            grads[5], grads[6] = (dc @ flat).T, dc.sum(1)
            dflat = dc.T @ net.wc.T
            order = np.argsort(cls.astype(np.int16), kind="stable")
            edge = np.searchsorted(cls[order], np.arange(len(lay.edge)))
            head = order[: edge[-1]]
            by_class, own, dhead = flat[head], y[head], np.empty((len(head), n), np.float32)
            for c in range(len(lay.edge) - 1):
                i, j = edge[c], edge[c + 1]
                if j > i:
                    lo, hi = lay.edge[c], lay.edge[c + 1]
                    dw = net.wo[lo:hi] @ by_class[i:j].T
                    dw += net.bo[lo:hi, None]
                    softmax(dw)
                    dw[own[i:j] - lo, np.arange(j - i)] -= 1
                    dw *= scale
                    grads[7][lo:hi], grads[8][lo:hi] = dw @ by_class[i:j], dw.sum(1)
                    dhead[i:j] = dw.T @ net.wo[lo:hi]
            dflat[head] += dhead
            dstates = np.zeros((states.size // n, n), np.float32)
            dstates[live] = dflat
            dstates = dstates.reshape(states.shape)
            d_reset, d_update, d_cand, d_inner = (s[: len(xs)] for s in back[:4])
            keep = 1 - now.update
            by_cand, by_update, by_reset = keep * (1 - now.cand * now.cand), (now.before - now.cand) * now.update * keep, now.inner * now.reset * (1 - now.reset)
            dh, any_fresh = np.zeros_like(h), fs.any(1)
            to_reset, to_update, to_inner = (np.ascontiguousarray(w.T) for w in thirds(net.wh, n))
            for t in range(len(xs) - 1, -1, -1):
                dh = dh + dstates[t]
                np.multiply(dh, by_cand[t], out=d_cand[t])
                np.multiply(dh, by_update[t], out=d_update[t])
                np.multiply(d_cand[t], by_reset[t], out=d_reset[t])
                np.multiply(d_cand[t], now.reset[t], out=d_inner[t])
                dh *= now.update[t]
                dh += d_reset[t] @ to_reset
                dh += d_update[t] @ to_update
                dh += d_inner[t] @ to_inner
                if any_fresh[t]:
                    dh = np.where(fs[t][:, None], np.float32(0), dh)
            first_h = now.before.reshape(-1, n).T
            grads[2] = np.concatenate([first_h @ d.reshape(-1, n) for d in (d_reset, d_update, d_inner)], 1)
            grads[4] = d_inner.sum((0, 1))
            order = np.argsort(xs.ravel().astype(np.int16) if start < 1 << 15 else xs.ravel(), kind="stable")
            seen, first = np.unique(xs.ravel()[order], return_index=True)
            dtable = np.zeros_like(table)
            for k, d in enumerate((d_reset, d_update, d_cand)):
                dtable[seen, k * n : (k + 1) * n] = np.add.reduceat(d.reshape(-1, n)[order], first)
            grads[0], grads[1], grads[3] = dtable @ net.wx.T, net.embed.T @ dtable, dtable.sum(0)
            step += 1
            rate = settings.rate * (1 - 0.9 * step / windows)
            clip = min(1.0, 5.0 / (1e-9 + float(np.sqrt(sum(float((g * g).sum()) for g in grads)))))
            for p, g, (m, v) in zip(net, grads, moments):
                g = g * np.float32(clip)
                m += np.float32(0.1) * (g - m)
                v += np.float32(0.001) * (g * g - v)
                p -= np.float32(rate) * (m / np.float32(1 - 0.9**step)) / (np.sqrt(v / np.float32(1 - 0.999**step)) + np.float32(1e-8))
    return net


def ids_of(t: Tokens, counts: Counts, rank: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Model ids of tokens; rank: the head's hashes in order, and their ranks."""
    at = np.minimum(np.searchsorted(rank[0], t.hash), len(rank[0]) - 1)
    return np.where(rank[0][at] == t.hash, rank[1][at], len(counts.head) + t.tail)


def head_rank(counts: Counts) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(counts.head)
    return counts.head[order], order


def sample_texts(docs: DataFrame, settings: Settings) -> pa.Array:
    """Texts for the first weights, in hash order: at most `sample_docs` rows of at most `sample_bytes`, so the driver holds 64 MB of them.

    Rows whose hash is low enough are asked for, not the lowest of all: each task would send as many as that to the driver.
    """
    own = docs.where("NOT held_out").where(F.octet_length("text") <= settings.sample_bytes)
    n = own.count()
    if not n or not settings.sample_docs:
        return pa.array([], pa.string())
    rows = own.select("text", F.xxhash64("doc_id").alias("h"), F.xxhash64("text").alias("g"))
    low = int(min(1.0, 0.9 * settings.sample_docs / n) * 10**12)
    rows = rows.where(F.pmod(F.xxhash64("h", "g"), F.lit(10**12)) < low).limit(settings.sample_docs).collect()
    return pa.array([r["text"] for r in sorted(rows, key=lambda r: (r["h"], r["g"]))], pa.string())


def pieces(sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents cut into pieces of at most `most` tokens: the size of each piece, and its place in its document."""
    n = -(-sizes // most)
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.minimum(np.repeat(sizes, n) - place * most, most), place


def sample_pieces(ids: np.ndarray, sizes: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """At most `sample_tokens` of a sample: the first piece of each document, then the second of each, and so on."""
    sizes, place = pieces(sizes, settings.piece)
    order = np.argsort(place, kind="stable")
    kept = np.zeros(len(sizes), bool)
    kept[order[np.cumsum(sizes[order]) <= settings.sample_tokens]] = True
    return ids[np.repeat(kept, sizes)], sizes[kept]


def first_net(docs: DataFrame, counts: Counts, settings: Settings) -> tuple[Net, Layout]:
    """The weights that all shards go on from."""
    lay, rank = layout(len(counts.head), settings), head_rank(counts)
    ids, sizes = [], []
    for s in K.slices(sample_texts(docs, settings)):
        t = tokens(s)
        ids.append(ids_of(t, counts, rank))
        sizes.append(t.size)
    ids, sizes = np.concatenate([np.zeros(0, np.int64), *ids]), np.concatenate([np.zeros(0, np.int64), *sizes])
    return fit(*sample_pieces(ids, sizes, settings), lay, settings), lay


def shard_nets(docs: DataFrame, net: Net, lay: Layout, counts: Counts, shards: int, settings: Settings) -> DataFrame:
    """Rows (shard, n, weights): how many tokens a shard has, and the weights after all of them, times that number."""
    own = settings._replace(epochs=1, batch=settings.shard_batch, rate=settings.shard_rate)
    start = docs.sparkSession.sparkContext.broadcast((net, counts._replace(words=np.zeros(0, COUNT))))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, counts = start.value
        rank, n, ids, sizes, waiting = head_rank(counts), 0, [], [], 0

        def block() -> Net:
            return fit(np.concatenate(ids), np.concatenate(sizes), lay, own, net)

        for batch in batches:
            for s in K.slices(batch.column(0)):
                t = tokens(s)
                at, size = ids_of(t, counts, rank), pieces(t.size, own.piece)[0]
                edge = np.concatenate([[0], np.cumsum(size)])
                i = 0
                while i < len(size):
                    j = max(i + 1, int(np.searchsorted(edge, edge[i] + own.block_tokens - waiting, "right")) - 1)
                    ids.append(at[edge[i] : edge[j]])
                    sizes.append(size[i:j])
                    waiting += int(edge[j] - edge[i])
                    i = j
                    if waiting >= own.block_tokens - own.piece:
                        net, n, ids, sizes, waiting = block(), n + waiting, [], [], 0
        if ids:
            net, n = block(), n + waiting
        if n:
            weights = np.concatenate([p.ravel() for p in net]).astype(np.float64) * n
            yield pa.record_batch([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([n], pa.int64()), pa.array([weights.tobytes()], pa.binary())], names=["shard", "n", "weights"])

    rows = docs.where("NOT held_out").select("text", F.xxhash64("doc_id").alias("h"), F.xxhash64("text").alias("g"))
    return rows.repartition(shards, "h", "g").sortWithinPartitions("h", "g").select("text").mapInArrow(learn, "shard int, n long, weights binary")


def averaged(nets: DataFrame, net: Net, shards: int) -> Net:
    """The mean of the shards' weights, by tokens, added in order of shards, NETS_IN_TASK in a task, level by level; `net` if there are none."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for shard, n, x in zip(*(batch.column(k).to_pylist() for k in range(3))):
                total = held.setdefault(shard // NETS_IN_TASK, [0, 0.0])
                total[0] += n
                total[1] = total[1] + np.frombuffer(x, np.float64)
        for group in sorted(held):
            n, x = held[group]
            yield pa.record_batch([pa.array([group], pa.int32()), pa.array([n], pa.int64()), pa.array([x.tobytes()], pa.binary())], names=["shard", "n", "weights"])

    while True:
        groups = (shards - 1) // NETS_IN_TASK + 1
        dealt = nets.repartition(groups, F.floor(F.col("shard") / NETS_IN_TASK)).sortWithinPartitions("shard")
        sums = dealt.mapInArrow(add, "shard int, n long, weights binary")
        if groups <= NETS_IN_TASK:
            break
        nets, shards = written(sums, "weights"), groups
    rows = sorted(sums.collect(), key=lambda r: r["shard"])
    if not rows:
        return net
    mean = sum(np.frombuffer(r["weights"], np.float64) for r in rows) / sum(r["n"] for r in rows)
    parts = np.split(mean.astype(np.float32), np.cumsum([p.size for p in net])[:-1])
    return Net(*(x.reshape(p.shape) for x, p in zip(parts, net)))


def train(docs: DataFrame, counts: Counts, shards: int, settings: Settings) -> tuple[Net, Layout]:
    net, lay = first_net(docs, counts, settings)
    return averaged(shard_nets(docs, net, lay, counts, shards, settings), net, shards), lay


class Scorer:
    """Scores many documents at once, in lanes."""

    def __init__(self, net: Net, lay: Layout, counts: Counts):
        self.net, self.lay, self.counts, self.rank = net, lay, counts, head_rank(counts)
        self.table = net.embed @ net.wx + net.b
        kinds = counts.tail_total + SMOOTH * (counts.tail_kinds + 1)
        self.tail_norm = np.log10(kinds)

    def base(self, t: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """log10(c + 0.1) and whether c > 0 of each token; NaN where the count isn't known here."""
        w = self.counts.words
        if not len(w):
            return np.full(len(t.hash), np.log10(SMOOTH)), np.zeros(len(t.hash), bool)
        at = np.minimum(np.searchsorted(w["h"], t.hash), len(w) - 1)
        found = w["h"][at] == t.hash
        logs = np.where(found, np.log10(w["c"][at] + SMOOTH), np.log10(SMOOTH) if self.counts.all_words else np.nan)
        return logs, found

    def model(self, t: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """log10 by the model of each token without a tail word's own log10(c + 0.1), and whether it is of the tail."""
        ids = ids_of(t, self.counts, self.rank)
        out = np.zeros(len(ids))
        x, place, fresh = in_lanes(ids, t.size, LANES, self.lay.n_head + TAIL)
        h = np.zeros((x.shape[1], self.net.wh.shape[0]), np.float32)
        for w in range(0, len(x), 32):
            states = forward(self.net, self.table, x[w : w + 32], fresh[w : w + 32], h)
            h = states[-1]
            p = place[w : w + 32].ravel()
            live = p >= 0
            out[p[live]] = token_logs(self.net, self.lay, states.reshape(len(p), -1)[live], ids[p[live]]) / np.log(10)
        tail = ids >= self.lay.n_head
        out[tail] -= self.tail_norm[ids[tail] - self.lay.n_head]
        return out, tail


def joined_tokens(parts: list[Tokens]) -> Tokens:
    return Tokens(*(np.concatenate([p[k] for p in parts]) for k in range(3)))


def score_documents(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    small_arrow_batches(spark)
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 == 0
    docs = plain_columns(docs, "doc_id", "text").select("doc_id", held_out.alias("held_out"), "text")
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    ranges = max(12, int(size / 12) // RANGE_WORDS + 1)
    table = written(word_counts(docs, ranges), "words")
    counts = gathered(table, settings)
    model = spark.sparkContext.broadcast((*train(docs, counts, size // settings.shard_bytes + 1, settings), counts))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*model.value)
        ref = TaskContext.get().partitionId() << 40
        names = ["ref", "doc_id", "held_out", "n_tokens", "n_known", "base", "model", "range", "entries"]

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal ref
            t = joined_tokens(parts)
            n, first = len(t.size), np.cumsum(t.size) - t.size
            logs, found = scorer.base(t)
            own, tail = scorer.model(t)
            unknown = np.isnan(logs)
            doc = np.repeat(np.arange(n), t.size)
            e = np.empty(int(unknown.sum()), ASK)
            e["h"], e["ref"] = t.hash[unknown], ref + doc[unknown]
            logs[unknown] = 0
            add = lambda v: np.add.reduceat(v, first)
            columns = [pa.array(np.arange(ref, ref + n)), pa.concat_arrays(ids), pa.concat_arrays(held), pa.array(t.size), pa.array(add(found.astype(np.int64))), pa.array(add(logs)), pa.array(add(own + np.where(tail, logs, 0)))]
            yield pa.record_batch([*columns, pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=names)
            asks = packed(e, ranges)
            k = asks.num_rows
            yield pa.record_batch([*(pa.nulls(k, c.type) for c in columns), *asks.columns], names=names)
            ref += n

        parts, ids, held, waiting = [], [], [], 0
        for batch in batches:
            for s in K.slices(batch.column(2)):
                rows = slice(s.first, s.first + len(s.offsets) - 1)
                parts.append(tokens(s))
                ids.append(batch.column(0)[rows])
                held.append(batch.column(1)[rows])
                waiting += len(parts[-1].hash)
            if waiting > FLUSH_TOKENS:
                yield from flush()
                parts, ids, held, waiting = [], [], [], 0
        if parts:
            yield from flush()

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, asks = {}, {}
        for batch in batches:
            for r, w, e in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if w is not None:
                    words[r] = np.frombuffer(w, COUNT)
                else:
                    asks.setdefault(r, []).append(np.frombuffer(e, ASK))
        while asks:
            r, e = asks.popitem()
            e, w = np.concatenate(e), words.pop(r, np.zeros(1, COUNT))
            at = np.minimum(np.searchsorted(w["h"], e["h"]), len(w) - 1)
            c = np.where(w["h"][at] == e["h"], w["c"][at], 0)
            order = np.argsort(e["ref"], kind="stable")
            refs, first = np.unique(e["ref"][order], return_index=True)
            add = lambda v: np.add.reduceat(v[order], first)
            yield pa.record_batch([pa.array(refs), pa.array(add(np.log10(c + SMOOTH))), pa.array(add((c > 0).astype(np.int64)))], names=["a_ref", "a_log", "a_known"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"ref long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, model double, range int, entries binary"
    scored = written(docs.mapInArrow(score, schema), "scored")
    rows = scored.where("ref IS NOT NULL").drop("range", "entries")
    none = F.lit(None).cast("binary")
    both = table.select("range", "words", none.alias("entries")).unionByName(scored.where("ref IS NULL").select("range", none.alias("words"), "entries"))
    rare = both.repartition(ranges, "range").mapInArrow(answer, "a_ref long, a_log double, a_known long")
    rare = rare.groupBy("a_ref").agg(F.sum("a_log").alias("a_log"), F.sum("a_known").alias("a_known"))
    rows = rows.join(rare, F.col("ref") == F.col("a_ref"), "left")
    norm = float(np.log10(counts.total + SMOOTH * (counts.kinds + 1)))
    more = F.coalesce("a_log", F.lit(0.0))
    return rows.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("a_known", F.lit(0))).alias("n_known"), F.lit(counts.total).cast("long").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * norm).alias("base_score"), (F.col("model") + more).alias("score"),
    )
