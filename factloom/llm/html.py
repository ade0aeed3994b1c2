"""HTML extraction: the best contiguous content region as a maximum-scoring subsequence.

A page becomes a line of events: words and tags. Words score positive and tags negative, each class by a weight learnt
from labelled pages: how much more often it comes inside the main text than outside, in logarithms. One linear scan
finds the contiguous run of events with the highest sum. The run then grows to the elements that hold it (all article or
main elements that it meets, else the closest one below the body), so that a short first or last paragraph stays; elements
that are no article text (menus, notices, forms, comments and so on) count as one tag and give no text. In an article or
main element, those whose class or id may as well name a part of the article stay, unless their scores are against them.

Defined results. A null or empty page, or one without words outside such elements, gives an empty string. White space
inside a block, line breaks included, turns into one space; blocks come in page order. Broken markup is read leniently:
unclosed elements end with their parent, unknown references stay as they are. Rows that repeat are extracted each.
"""

from __future__ import annotations

import html
import math
import random
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from factloom.llm.shared import plain_columns, small_arrow_batches

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|textarea|title|iframe|object|canvas|math)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z](?:[^>\"']|\"[^\"]*\"|'[^']*')*>|</?[a-zA-Z][^>]*(?:>|\Z)|[^<]+|<",
    re.DOTALL | re.IGNORECASE,
)
NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.IGNORECASE)

#: Fixed sets of element names and of words in class and id.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
NOT_TEXT = frozenset("aside button dialog footer form head input menu nav select option label fieldset header".split())
NOT_ROLE = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
NOT_CLASS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs "
    "footer header masthead topbar cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe subscription signup login "
    "comment comments commentlist respond reply replies disqus discussion share sharing social related recommended recommendations widget toolbar pagination "
    "pager skip banner copyright disclaimer".split()
)
#: Of these words, those that an article's own parts have too: in an article or main element the scores decide.
IN_DOUBT = frozenset("header footer masthead banner notice notification alert discussion share sharing social related recommended recommendations widget overlay copyright disclaimer".split())
HOLDERS = frozenset(("article", "main"))
INLINE_LINK, LIST, SECTION, TEXT_BLOCK, OTHER, LEFT_OUT = "link", "list", "section", "text", "other", "left out"
CLASS_OF = (
    dict.fromkeys("a button input select img".split(), INLINE_LINK)
    | dict.fromkeys("ul ol li dl dt dd table tr td th option".split(), LIST)
    | dict.fromkeys("div section article main body aside header footer nav form".split(), SECTION)
    | dict.fromkeys("p h1 h2 h3 h4 h5 h6 blockquote pre b i em strong span br".split(), TEXT_BLOCK)
)


class Element(NamedTuple):
    name: str
    first: int  # event of its open tag
    last: int  # event after its close tag
    parent: int


class Page(NamedTuple):
    kinds: list[str]  # of each event: "words", or a tag's class
    texts: list[str]  # of a words event
    names: list[str]  # of a tag event, with / for a close tag
    elements: list[Element]
    skipped: list[bool]  # inside an element that gives no text
    doubtful: list[Element]  # in an article or main element, and named by a word in doubt


def attributes_say_no(tag: str, words: frozenset[str] = NOT_CLASS) -> bool:
    for key, value in ATTRIBUTE.findall(tag[len(NAME.match(tag)[0]) :]):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "role" and value in NOT_ROLE:
            return True
        if key in ("class", "id") and any(w in words for w in re.split(r"[\s_-]+|(?<=[a-z])(?=\d)", value)):
            return True
    return False


def parse(page: str) -> Page:
    """Events, elements with their extent, and which events lie in elements that give no text."""
    kinds, texts, names = [], [], []
    elements: list[list] = []
    out: list[int] = []  # elements that may give no text
    doubt: list[int] = []
    stack: list[int] = []
    open_at: dict[str, list[int]] = {}  # places in the stack by name
    blocks: list[int] = []  # and of all block elements
    holders_open = 0

    def close(upto: int) -> None:
        nonlocal holders_open
        while len(stack) > upto:
            e = elements[stack.pop()]
            e[2] = len(kinds)
            open_at[e[0]].pop()
            if e[0] in BLOCK:
                blocks.pop()
            holders_open -= e[0] in HOLDERS

    def last_open(*names: str) -> int:
        return max((open_at[x][-1] for x in names if open_at.get(x)), default=-1)

    for m in TOKEN.finditer(page):
        token = m[0]
        if token[0] != "<" or len(token) == 1:
            kinds.append("words")
            texts.append(token)
            names.append("")
            continue
        if m[1] or token[1] in "!?":
            continue
        name = NAME.match(token)[1].lower()
        if token[1] == "/":
            at = last_open(name)
            # An inline tag can't close a block, nor a block inside a holder close the holder.
            if at >= 0 and (name in BLOCK or not blocks or blocks[-1] <= at):
                kinds.append(CLASS_OF.get(name, OTHER))
                texts.append("")
                names.append("/" + name)
                close(at)
            continue
        if name in ("p", "li", "dt", "dd", "tr", "td", "th", "option") or name in BLOCK:
            # An open paragraph ends where a block begins; list and table parts end where their next begins.
            same = {"p"} if name in BLOCK else set()
            same |= {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}.get(name, set())
            at = last_open(*same)
            if at >= 0 and at >= (blocks[-1] if blocks else -1):
                close(at)
        kinds.append(CLASS_OF.get(name, OTHER))
        texts.append("")
        names.append(name)
        if name in VOID or token.endswith("/>"):
            continue
        index = len(elements)
        elements.append([name, len(kinds) - 1, -1, stack[-1] if stack else -1])
        if name in NOT_TEXT and not (name == "header" and holders_open) or name not in ("html", "body", *HOLDERS) and attributes_say_no(token):
            sure = name in NOT_TEXT and name != "header" or not holders_open or attributes_say_no(token, NOT_CLASS - IN_DOUBT)
            (out if sure else doubt).append(index)
        open_at.setdefault(name, []).append(len(stack))
        if name in BLOCK:
            blocks.append(len(stack))
        holders_open += name in HOLDERS
        stack.append(index)
    close(0)
    holders = sorted(e[1] for e in elements if e[0] in HOLDERS)
    left_out = []
    for e in out:
        name, first, last, _ = elements[e]
        if name not in ("nav", "footer", "form", "head") and bisect_right(holders, first) < bisect_left(holders, last):
            continue  # a wrapper of the article, whatever it is called
        left_out.append((first, last))
    skipped = marked(left_out, len(kinds))
    return Page(kinds, texts, names, [Element(*e) for e in elements], skipped, [Element(*elements[e]) for e in doubt])


def marked(ranges: list[tuple[int, int]], n: int) -> list[bool]:
    """Which of n places lie in a range (first, end)."""
    step = [0] * (n + 1)
    for first, end in ranges:
        step[first] += 1
        step[end] -= 1
    return [x > 0 for x in accumulate(step[:n])]


def scores(page: Page, weights: dict[str, float], first: int, last: int) -> Iterator[float]:
    """The score of each event; of events left out in a row, the first has that of one tag."""
    left_out = False
    for k in range(first, last):
        if page.skipped[k]:
            yield 0.0 if left_out else weights[LEFT_OUT]
            left_out = True
        else:
            left_out = False
            yield weights["words"] * len(page.texts[k].split()) if page.kinds[k] == "words" else weights[page.kinds[k]]


def judged(page: Page, weights: dict[str, float]) -> Page:
    """The page without the elements in doubt whose scores speak against them too, inner ones first.

    An element that is judged is one step for those around it, so each event is looked at once.
    """
    steps: dict[int, tuple[int, float, bool, bool]] = {}  # by first event: the end, the score, whether it is left out, and its end
    gone = []
    for e in reversed(page.doubtful):
        closed = page.names[e.last - 1] == "/" + e.name
        total, left_out, k, end = 0.0, False, e.first + 1, e.last - closed
        while k < end:
            if k in steps:
                k, score, out, out_at_end = steps[k]
                total += (0.0 if left_out else weights[LEFT_OUT]) if out else score
                left_out = out_at_end
                continue
            if page.skipped[k]:
                total += 0.0 if left_out else weights[LEFT_OUT]
            else:
                total += weights["words"] * len(page.texts[k].split()) if page.kinds[k] == "words" else weights[page.kinds[k]]
            left_out = page.skipped[k]
            k += 1
        against = total <= 0  # of what it holds
        own = weights[page.kinds[e.first]] + (weights[page.kinds[e.last - 1]] if closed else 0.0)
        steps[e.first] = (e.last, total + own, against, against or left_out and not closed)
        if against:
            gone.append((e.first, e.last))
    return page._replace(skipped=[a or b for a, b in zip(page.skipped, marked(gone, len(page.kinds)))]) if gone else page


def best_run(page: Page, weights: dict[str, float]) -> tuple[int, int] | None:
    """First and last event (exclusive) of the run with the highest sum; None if no words score."""
    best, found, total, begin = 0.0, None, 0.0, 0
    for k, score in enumerate(scores(page, weights, 0, len(page.kinds))):
        total += score
        if total > best:
            best, found = total, (begin, k + 1)
        elif total <= 0:
            total, begin = 0.0, k + 1
    return found


def grown(page: Page, run: tuple[int, int]) -> tuple[int, int]:
    """The run, as far as the article or main elements that it meets, else the closest element around it below the body."""
    around = [e for e in page.elements if e.first <= run[0] and e.last >= run[1] or e.first < run[1] and e.last > run[0] and e.name in HOLDERS]
    holders = [e for e in around if e.name in HOLDERS]
    if holders:
        e = max(holders, key=lambda e: (min(e.last, run[1]) - max(e.first, run[0]), e.first))
        apart = [h for h in holders if h.last <= e.first or h.first >= e.last]
        return min(h.first for h in (e, *apart)), max(h.last for h in (e, *apart))
    inner = [e for e in around if e.name not in ("html", "body")]
    if inner:
        e = max(inner, key=lambda e: e.first)
        return e.first, e.last
    return run


def block_texts(page: Page, run: tuple[int, int]) -> list[str]:
    out, now = [], []
    for k in range(*run):
        if page.names[k].lstrip("/") in BLOCK or page.skipped[k]:
            out.append("".join(now))
            now = []
        if page.skipped[k]:
            continue
        if page.names[k] == "br":
            now.append(" ")
        elif page.kinds[k] == "words":
            now.append(page.texts[k])
    out.append("".join(now))
    return [t for t in (" ".join(html.unescape(x).split()) for x in out) if t]


def main_text(source: str | None, weights: dict[str, float]) -> str:
    """The main text of one page."""
    if not source:
        return ""
    page = judged(parse(source), weights)
    run = best_run(page, weights)
    return "\n\n".join(block_texts(page, grown(page, run))) if run else ""


def labelled_pages(n: int = 60, seed: int = 7) -> list[tuple[str, str]]:
    """Made pages with a mark around the main text: (before + main + after as html, main as html)."""
    rng = random.Random(seed)

    def prose(lo: int, hi: int) -> str:
        return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(lo, hi)))

    def links(lo: int, hi: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{i}">{prose(1, 3)}</a></li>' for i in range(rng.randint(lo, hi))) + "</ul>"

    out = []
    for i in range(n):
        paragraphs = "".join(f"<p>{prose(8, 90)}{rng.choice(['', ' <b>' + prose(2, 5) + '</b>', ' <a href=x>' + prose(1, 3) + '</a>'])}.</p>" for _ in range(rng.randint(2, 9)))
        main = f"<h1>{prose(3, 9)}</h1>{paragraphs}" + rng.choice(["", f"<ul><li>{prose(5, 20)}</li><li>{prose(5, 20)}</li></ul>", f"<blockquote>{prose(10, 40)}</blockquote>"])
        holder = rng.choice(["article", "main", "div class=post", "section", "div id=content"])
        main = f"<{holder}>{main}</{holder.split()[0]}>"
        top = rng.choice(["<div class=menu>", "<nav>", "<div>", "<table><tr><td>"]) + links(3, 12) + rng.choice(["</div>", ""])
        rest = rng.choice([f"<div><h4>{prose(1, 3)}</h4>{links(3, 9)}</div>", f"<div class=ad>{prose(3, 15)}</div>", "<div><a href=z><img src=y></a></div>"])
        end = f"<div>{rng.choice([links(2, 6), ''])}<span>&copy; {prose(2, 8)}</span></div>"
        out.append((f"<html><head><title>{prose(2, 6)}</title></head><body>{top}{rest}{main}{rest}{end}</body></html>", main))
    return out


def learnt_weights(labelled: list[tuple[str, str]]) -> dict[str, float]:
    """Of each class: log of its share of events inside the main text over that outside; words kept positive, tags negative."""
    inside, whole = Counter(), Counter()
    for source, main in labelled:
        for counts, text in ((whole, source), (inside, main)):
            page = parse(text)
            for kind, words in zip(page.kinds, page.texts):
                counts[kind] += len(words.split()) if kind == "words" else 1
    outside = whole - inside
    a, b = sum(inside.values()), sum(outside.values())
    ratio = {k: math.log((inside[k] + 1) / a) - math.log((outside[k] + 1) / b) for k in ("words", INLINE_LINK, LIST, SECTION, TEXT_BLOCK, OTHER)}
    weights = {k: min(v - ratio["words"], -0.2) for k, v in ratio.items() if k != "words"}
    return weights | {"words": max(ratio["words"], 0.1), LEFT_OUT: min(weights.values())}


def extract_text(pages: DataFrame, labelled: list[tuple[str, str]] | None = None) -> DataFrame:
    """Per page: page_id, url, text, n_chars (code points)."""
    pages = plain_columns(pages, "page_id", "url", "html")
    small_arrow_batches(pages.sparkSession)
    weights = learnt_weights(labelled or labelled_pages())

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x, weights) for x in batch.column(2).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = [pages.schema[c].dataType.simpleString() for c in ("page_id", "url")]
    return pages.mapInArrow(part, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
