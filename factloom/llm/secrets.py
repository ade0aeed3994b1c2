"""Secret scans: fixed patterns, and the guess cost of values in a credential context.

The patterns give the base spans. The method then takes the values that follow a credential key and are no base span
yet, and finds the cheapest way to guess each one: dynamic programming over its segments, where a segment is a listed
word, a date, a repeat, a walk on the keyboard or brute force. A value at or above the limit, in powers of ten, is a
secret and adds a span of kind `guess`.

Defined results. A null or empty text has no spans. Offsets count code points; ends are exclusive. Rows that repeat are
scanned each. Values of any length are scanned whole: the cost needs time in proportion to the length.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from factloom.llm.shared import plain_columns, small_arrow_batches

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|(?:access|private|client|auth|encryption|signing)[_-]?(?:key|secret|token)|credentials?|bearer)["']?[ \t]*(?::=|=>|[:=])[ \t]*(?:"([^"\n]{6,})"|'([^'\n]{6,})'|([^\s"'<>,;]{6,}))""",
    re.IGNORECASE | re.ASCII,
)
#: What a cheap look finds in every text that CONTEXT can match.
CONTEXT_HINT = re.compile(r"pass|pwd|secret|token|key|credential|bearer", re.IGNORECASE | re.ASCII)

#: Words that guessers try first, most common first.
COMMON_WORDS = (
    "password admin login welcome letmein master dragon monkey shadow sunshine princess football baseball superman batman trustno secret "
    "hello freedom whatever qazwsx michael jordan hunter summer winter spring autumn charlie thomas george computer internet default "
    "changeme example sample test demo user guest root placeholder your here none null true false value token key dummy public private "
    "love happy money orange banana apple cookie pepper ginger flower silver golden purple yellow green black white blue house horse "
    "the and that with this from have not you are for was but all can had her his one our out day get has him how man new now old see two way who "
    # Words of prose, so that a plain word after a credential's name is cheap.
    "something nothing everything anything someone everyone required optional missing invalid expired disabled enabled unknown undefined changed protected "
    "encrypted encryption authentication authorization configuration application information description management development environment production "
    "generated provided returned received rejected accepted response request service session account address document parameter argument variable function "
    "variables parameters requirements settings security identity identifier username passphrase passwords reminder recovery recommended strength strongly "
    "characters character alphabet numbers letters special minimum maximum between another because before after through without within should would could "
    "important different available following necessary possible impossible sometimes always usually probably certainly together yesterday tomorrow morning "
    "evening question answer problem solution reading writing keeping sharing storage database connection connected transport protocol platform provider "
    "customer employee company business government university president community education research technology experience knowledge understanding "
    "confidential restricted personal individual standard previous original temporary permanent automatic automatically manually separately immediately "
    "repository operating system network website software hardware password1 reference documentation specification implementation"
).split()
WORD_RANK = {w: i + 1 for i, w in enumerate(dict.fromkeys(COMMON_WORDS))}
LONGEST_WORD = max(map(len, WORD_RANK))
LEET = str.maketrans("@4301!5$7", "aaeoiisst")
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
#: Keys beside each key, on its row.
BESIDE = {a: {b for j, b in enumerate(row) if abs(i - j) == 1} for row in ROWS for i, a in enumerate(row)}
DATE = re.compile(r"(?:(?:19|20)\d\d[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)\d\d|(?:19|20)\d\d)")
BRUTE = 1.0  # a power of ten for each character
SEGMENT = 0.3  # and for each further segment


class Run:
    """The cheapest segment of a run that ends at each place: `cost`, and log10 of how many units of `unit` characters.

    Of two starts in a run, the later one is dropped once it is dearer, since it stays so, and the earlier one if it is
    never cheaper. Few stay, so that the time is in proportion to the length.
    """

    def __init__(self, unit: int, least: int, cost: float, n: int, alike: Callable[[int, int], bool]):
        self.unit, self.least, self.cost = unit, least * unit, cost
        self.reach = [min(i + unit, n) for i in range(n + 1)]  # the end of the longest run from each place
        for i in range(n - unit - 1, -1, -1):
            if alike(i, i + unit):
                self.reach[i] = self.reach[i + 1]
        self.live: list[list[tuple[float, int]]] = [[] for _ in range(unit)]  # cost up to the segment's units, start

    def cheapest(self, end: int, best: list[float]) -> float:
        live, i = self.live[end % self.unit], end - self.least
        if i >= 0 and self.reach[i] >= end:
            c = best[i] + (SEGMENT if i else 0.0) + self.cost
            while live and live[-1][0] >= c:
                live.pop()
            live.append((c, i))
        if not live:
            return math.inf
        kept, lowest = [], math.inf
        for c, i in live:
            if self.reach[i] >= end:
                f = c + math.log10((end - i) // self.unit)
                older = kept and self.reach[kept[-1][1]] == self.reach[i]
                if not older or f < lowest:
                    kept.append((c, i))
                    lowest = f
        out = min((c + math.log10((end - i) // self.unit) for c, i in kept), default=math.inf)
        self.live[end % self.unit] = kept
        return out


def guess_cost(value: str) -> float:
    """log10 of the guesses that the cheapest segmentation of `value` needs."""
    n = len(value)
    low = value.lower()
    plain = low.translate(LEET)
    best = [0.0] + [math.inf] * n
    # Runs: repeats of a character, walks on the keyboard, and blocks said again; a segment may be any length of a run, from `least` units on.
    same = lambda a, b: value[a] == value[b]
    steps = lambda a, b: low[b] in BESIDE.get(low[a], ()) or abs(ord(low[b]) - ord(low[a])) == 1 and low[a].isalnum() and low[b].isalnum()
    runs = [Run(1, 3, BRUTE, n, same), Run(1, 3, 2.0, n, steps), *(Run(size, 2, size * BRUTE, n, same) for size in range(2, 9))]
    for i in range(n + 1):
        for run in runs:
            best[i] = min(best[i], run.cheapest(i, best))
        if i == n:
            break
        here = best[i] + (SEGMENT if i else 0.0)
        best[i + 1] = min(best[i + 1], best[i] + BRUTE)
        for size in range(3, min(LONGEST_WORD, n - i) + 1):
            rank = WORD_RANK.get(plain[i : i + size])
            if rank:
                twist = (low[i : i + size] != value[i : i + size]) + (plain[i : i + size] != low[i : i + size])
                best[i + size] = min(best[i + size], here + math.log10(rank + 1) + 0.5 * twist)
        m = DATE.match(value, i)
        if m:
            best[m.end()] = min(best[m.end()], here + (4.0 if m.end() - i > 4 else 2.0))
    return best[n]


def is_secret_value(value: str, limit: float) -> bool:
    """Guess cost at or above the limit; plain words are cheap by their ranks."""
    return guess_cost(value) >= limit


class Found(NamedTuple):
    spans: list[tuple[int, int, int]]  # start, kind's place, end
    counts: list[int]  # of the base kinds
    base: str


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def scan_text(text: str, limit: float) -> Found:
    """All spans of one text."""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    counts = [len(spans)]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    counts.append(len(spans) - counts[0])
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    counts.append(len(spans) - sum(counts))
    base = joined(spans)
    covered = sorted((a, b) for a, _, b in spans)
    begins, ends = [a for a, _ in covered], list(accumulate((b for _, b in covered), max))
    for m in CONTEXT.finditer(text):
        g = next(i for i in (1, 2, 3) if m[i] is not None)
        a, b = m.span(g)
        before = bisect_left(begins, b)  # base spans that begin before the value ends
        if (not before or ends[before - 1] <= a) and is_secret_value(m[g], limit):
            spans.append((a, 3, b))
    return Found(spans, counts, base)


NOTHING = Found([], [0, 0, 0], "")
HINT = re.compile(r"AKIA|[0-9a-f]{32}")


def scan_secrets(docs: DataFrame, *, limit: float = 8.0) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans. `limit` is log10 of the guesses."""
    docs = plain_columns(docs, "doc_id", "text")
    small_arrow_batches(docs.sparkSession)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column(1).to_pylist():
                found.append(scan_text(text, limit) if text and (CONTEXT_HINT.search(text) or HINT.search(text)) else NOTHING)
            counts = [pa.array([f.counts[k] for f in found], pa.int64()) for k in range(3)]
            digests = pa.array([hashlib.sha256(f.base.encode()).hexdigest() for f in found], pa.string())
            spans = pa.array([joined(f.spans) for f in found], pa.string())
            yield pa.record_batch([batch.column(0), *counts, digests, spans], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(part, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
