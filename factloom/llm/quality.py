"""Quality rules: base counts, and divergence of a document from the reference of its language.

For each language with a list of common words, the reference holds two histograms over all documents of that language
that pass the base rules: classes of characters, and the listed words against all others. A document is rejected if the
Jensen-Shannon distance (base 2, so 0..1) of its characters from its language's reference is above a limit, or that of
its words is, and that of its characters above a lower one. The limits were set on the quality labels. The guards: a
document with too few words or characters, without a language in the lists, or whose language has too few reference
words, gets no such verdict.

Defined results. A null or empty text has no words, so it fails the base rules. A null or unknown language is judged by
the base rules alone. Rows that repeat are judged alike. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import kernel as K
from factloom.llm.shared import plain_columns, released, small_arrow_batches

#: Common words of each language that has a reference.
COMMON = {
    "en": "the of and to in that is was for it as with on be at by he or an are this from not have".split(),
    "de": "der die das und ist in den von zu mit sich des auf für im dem nicht ein eine als auch es an er".split(),
    "fr": "le la les de des et un une est en que qui dans pour par sur au du il ne pas plus ce se".split(),
    "es": "el la los las de y en que un una es por con no se del al lo para su como más o pero".split(),
}
LANGS = sorted(COMMON)

#: Character classes by a byte that starts a character: lower, upper, digit, white space, other ASCII, 2-, 3-, 4-byte.
CLASS = np.full(256, 8, np.uint8)
CLASS[:128] = 4
CLASS[ord("a") : ord("z") + 1] = 0
CLASS[ord("A") : ord("Z") + 1] = 1
CLASS[ord("0") : ord("9") + 1] = 2
CLASS[K.SPACE] = 3
CLASS[0xC0:0xE0] = 5
CLASS[0xE0:0xF0] = 6
CLASS[0xF0:] = 7
N_CLASS = 8
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
STARTS = (np.arange(256) & 0xC0) != 0x80
PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[list(b".,;:!?")] = True


class Limits(NamedTuple):
    """The rules' parameters."""

    min_words: int = 50
    repeat_percent: int = 50
    char_distance: float = 0.28
    word_distance: float = 0.32
    both_char_distance: float = 0.09
    guard_words: int = 50
    guard_chars: int = 200
    reference_words: int = 500


class Measures(NamedTuple):
    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    chars: np.ndarray  # documents x classes
    common: np.ndarray  # documents x (listed words of the language, others)


def word_hashes(lang: str) -> np.ndarray:
    """Hashes of a language's list, in its order."""
    out = []
    for w in COMMON[lang]:
        out.append(K.words(next(K.slices(pa.array([w]))), True).hash[0])
    return np.array(out, np.uint64)


def duplicate_lines(raw: bytes) -> int:
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def repeated_words(w: K.Words, n: int) -> np.ndarray:
    """Per document: words inside 3-word windows that occur twice or more in it."""
    h, at = K.windows(w.hash, w.doc, 3)
    if not len(h):
        return np.zeros(n, np.int64)
    key = K.mix(h ^ K.mix(w.doc[at].astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(h), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    hit = np.zeros(len(w.doc), bool)
    for k in range(3):
        hit[at[twice] + k] = True
    return np.bincount(w.doc[hit], minlength=n)


def measure(s: K.Slice, langs: np.ndarray, tables: dict[str, tuple[np.ndarray, np.ndarray]]) -> Measures:
    """All counts of a slice; `tables` has each language's sorted word hashes and their places in its list."""
    n = len(s.offsets) - 1
    raw = K.words(s, False)
    n_words = np.bincount(raw.doc, minlength=n)
    starts = STARTS[s.buf]
    lines = [duplicate_lines(s.buf[a:b].tobytes()) for a, b in zip(s.offsets[:-1], s.offsets[1:])]
    doc = np.repeat(np.arange(n), np.diff(s.offsets))
    chars = np.bincount(doc * 9 + CLASS[s.buf], minlength=n * 9).reshape(n, 9)[:, :N_CLASS]
    # Common words: lower case, without punctuation at the end.
    end = raw.end - PUNCTUATION[s.buf[raw.end - 1]]
    keep = end > raw.start
    inside = np.zeros(len(s.buf) + 1, np.int8)
    np.add.at(inside, raw.start[keep], 1)
    np.add.at(inside, end[keep], -1)
    inside = np.cumsum(inside[:-1]).astype(bool)
    folded = K.span_hash(s.buf, inside, raw.start[keep], end[keep], True)
    bins = len(COMMON["en"]) + 1
    common = np.zeros((n, bins), np.int64)
    word_lang = langs[raw.doc[keep]]
    for i, lang in enumerate(LANGS):
        mine = np.flatnonzero(word_lang == i)
        if len(mine):
            known, place = tables[lang]
            j = np.minimum(np.searchsorted(known, folded[mine]), len(known) - 1)
            which = np.where(known[j] == folded[mine], place[j], bins - 1)
            common += np.bincount(raw.doc[keep][mine] * bins + which, minlength=n * bins).reshape(n, bins)
    return Measures(n_words, K.per_doc(starts & ~K.SPACE[s.buf], s.offsets), K.per_doc(SYMBOL[s.buf], s.offsets), np.array(lines, np.int64), repeated_words(raw, n), chars, common)


def base_failed(m: Measures, limits: Limits) -> np.ndarray:
    return (m.n_words < limits.min_words) | (100 * m.n_repeat_words > limits.repeat_percent * m.n_words)


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance, base 2, of each row of counts p from the counts q."""
    p = p / np.maximum(p.sum(1, keepdims=True), 1)
    q = np.broadcast_to(q / max(q.sum(), 1), p.shape)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / m), 0).sum(1)
        b = np.where(q > 0, q * np.log2(q / m), 0).sum(1)
    return np.sqrt(np.maximum((a + b) / 2, 0))


def tables() -> dict[str, tuple[np.ndarray, np.ndarray]]:
    out = {}
    for lang in LANGS:
        h = word_hashes(lang)
        order = np.argsort(h)
        out[lang] = (h[order], order)
    return out


def lang_codes(column: pa.Array) -> np.ndarray:
    at = {lang: i for i, lang in enumerate(LANGS)}
    return np.array([at.get(x, -1) for x in column.to_pylist()], np.int64)


def references(docs: DataFrame, limits: Limits) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Histograms of each listed language over all its documents that pass the base rules.

    At most 4 languages times 33 sums reach the driver, whatever the corpus.
    """
    bins = len(COMMON["en"]) + 1

    @released
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, chars, common = tables(), np.zeros((len(LANGS), N_CLASS), np.int64), np.zeros((len(LANGS), bins), np.int64)
        for batch in batches:
            langs = lang_codes(batch.column(0))
            for s in K.slices(batch.column(1)):
                own = langs[s.first : s.first + len(s.offsets) - 1]
                m = measure(s, own, known)
                fit = ~base_failed(m, limits)
                for i in range(len(LANGS)):
                    chars[i] += m.chars[fit & (own == i)].sum(0)
                    common[i] += m.common[fit & (own == i)].sum(0)
        both = np.concatenate([chars, common], 1)
        lang, place = np.nonzero(both)
        yield pa.record_batch([pa.array(lang, pa.int32()), pa.array(place, pa.int32()), pa.array(both[lang, place], pa.int64())], names=["lang", "place", "n"])

    sums = docs.select("lang", "text").mapInArrow(part, "lang int, place int, n long").groupBy("lang", "place").agg(F.sum("n").alias("n"))
    out = {lang: (np.zeros(N_CLASS), np.zeros(bins)) for lang in LANGS}
    for r in sums.collect():
        chars, common = out[LANGS[r["lang"]]]
        if r["place"] < N_CLASS:
            chars[r["place"]] = r["n"]
        else:
            common[r["place"] - N_CLASS] = r["n"]
    return out


class Verdict(NamedTuple):
    measures: Measures
    failed: np.ndarray
    kept: np.ndarray
    distances: np.ndarray  # characters, words; NaN without a verdict


def verdicts(langs: pa.Array, texts: pa.Array, refs: dict, known: dict, limits: Limits) -> Iterator[tuple[slice, Verdict]]:
    """The judgement of a batch, slice by slice."""
    codes = lang_codes(langs)
    for s in K.slices(texts):
        n = len(s.offsets) - 1
        rows = slice(s.first, s.first + n)
        own = codes[rows]
        m = measure(s, own, known)
        failed = base_failed(m, limits)
        distance = np.full((2, n), np.nan)
        for i, lang in enumerate(LANGS):
            chars, common = refs[lang]
            fit = (own == i) & (m.n_words >= limits.guard_words) & (m.chars.sum(1) >= limits.guard_chars) & (common.sum() >= limits.reference_words)
            if fit.any():
                distance[0, fit] = js_distance(m.chars[fit], chars)
                distance[1, fit] = js_distance(m.common[fit], common)
        with np.errstate(invalid="ignore"):
            far = (distance[0] > limits.char_distance) | ((distance[1] > limits.word_distance) & (distance[0] > limits.both_char_distance))
        yield rows, Verdict(m, failed, ~failed & ~far, distance)


def quality(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, char_distance, word_distance.

    A distance is null where a guard leaves it without a verdict.
    """
    docs = plain_columns(docs, "doc_id", "lang", "text")
    small_arrow_batches(docs.sparkSession)
    refs = references(docs, limits)

    @released
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = tables()
        for batch in batches:
            for rows, v in verdicts(batch.column(1), batch.column(2), refs, known, limits):
                longs = [pa.array(x, pa.int64()) for x in v.measures[:5]]
                floats = [pa.array(x, pa.float64(), mask=np.isnan(x)) for x in v.distances]
                yield pa.record_batch(
                    [batch.column(0)[rows], *longs, pa.array(v.failed), pa.array(v.kept), *floats],
                    names=["doc_id", *Measures._fields[:5], "base_failed", "kept", "char_distance", "word_distance"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    longs = ", ".join(f"{x} long" for x in Measures._fields[:5])
    return docs.mapInArrow(judge, f"doc_id {kind}, {longs}, base_failed boolean, kept boolean, char_distance double, word_distance double")


def keep_good(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The documents, all columns, that the rules keep."""
    small_arrow_batches(docs.sparkSession)
    refs = references(plain_columns(docs, "doc_id", "lang", "text"), limits)
    lang, text = docs.columns.index("lang"), docs.columns.index("text")

    @released
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = tables()
        for batch in batches:
            for rows, v in verdicts(batch.column(lang), batch.column(text), refs, known, limits):
                yield batch[rows].filter(pa.array(v.kept))

    return docs.mapInArrow(judge, docs.schema)
