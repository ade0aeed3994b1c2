"""License scans: entire texts against the digests of known licences and licence notices, in canonical form.

Canonical form: A-Z folded; lines that only claim copyright or reserve all rights dropped; equivalent spellings made
one; all that is not a letter or digit turned to single spaces. A digest of the canonical text is hash-joined with a
table of known digests. The unit is an entire text: the document, and each entire line of it, so that a notice on a line
of its own is found too. Substrings are never matched.

Defined results. A null or empty text, or one whose canonical form is empty, matches nothing: licence null, no lines.
Rows that repeat are scanned each. An empty table gives no rows. A document with lines of several licences lists them
sorted. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import pkgutil
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.shared import plain_columns

#: Equivalent spellings, applied to folded words in this order.
SPELLINGS = (
    ("licence", "license"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("organisation", "organization"), ("merchantibility", "merchantability"),
    ("favour", "favor"), ("behaviour", "behavior"), ("authorised", "authorized"), ("recognised", "recognized"), ("whilst", "while"), ("per cent", "percent"),
    ("non commercial", "noncommercial"), ("copyright owner", "copyright holder"), ("v2", "version 2"), ("v3", "version 3"),
)
COPYRIGHT_LINE = r"(?m)^[^a-z0-9\n]*(?:copyright|\(c\)|©|all rights reserved)[^\n]*$"

#: Known notices and short licence texts, as published.
SHORT = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\")."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n"
     "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\n"
     "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n"
     "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)

#: Files of full texts, as published: names, and how many spellings or layouts of each.
FILES = {"Apache-2.0": 2, "GPL-2.0": 3, "GPL-3.0": 3, "MPL-2.0": 2, "BSD-2-Clause": 3, "BSD-3-Clause": 2, "Unlicense": 1}
#: Title lines of texts that are published with and without one.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)", "The ISC License (ISC)"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", "The 2-Clause BSD License", "BSD License", "The BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", "The 3-Clause BSD License", "BSD License", "The BSD License"),
    "Unlicense": ("The Unlicense", "Unlicense"),
}


def full_texts() -> list[tuple[str, str]]:
    """Each known full text with and without its title, in its lines and with each paragraph as one line."""
    texts = [(name, pkgutil.get_data(__package__, f"license_texts/{name}.{i}.txt").decode()) for name, n in FILES.items() for i in range(1, n + 1)]
    texts += [x for x in SHORT if len(x[1]) > 400]
    out = []
    for name, text in texts:
        forms = [text] + [f"{title}\n\n{text}" for title in TITLES.get(name, ())]
        if name not in TITLES:
            forms.append(text.split("\n\n", 1)[1])  # the first paragraph is the title
        out += [(name, x) for form in forms for x in (form, re.sub(r"(?<!\n)\n(?!\n)[ \t]*", " ", form))]
    return out


def canonical(text: str) -> str:
    """The canonical form, in Python: the same steps as `canonical_column`."""
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    t = re.sub(COPYRIGHT_LINE, " ", t)
    t = f" {re.sub('[^a-z0-9\u0080-\U0010ffff]+', ' ', t).strip(' ')} "
    for old, new in SPELLINGS:
        t = t.replace(f" {old} ", f" {new} ")
    return t.strip(" ")


#: All that is known, each canonical form once.
NOTICES = tuple({(name, canonical(text)): (name, text) for name, text in (*SHORT, *full_texts())}.values())
#: So many characters begin a known text, and so many of a text, before spellings, settle them.
HEAD, SETTLES = 12, 80


def canonical_column(text: Column, longest: int | None = None) -> Column:
    """The canonical form; null where it must be longer than `longest`, if given.

    Of the spellings only a few shorten a text, each by one of six characters or more, which bounds the form's length
    before they are applied.
    """
    base = unspelled(text)
    out = spelled(base)
    return out if longest is None else F.when(5 * F.length(base) <= 6 * (longest + 2), out)


def unspelled(text: Column) -> Column:
    """The canonical form before spellings are made one, with a space at both ends."""
    t = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    t = F.regexp_replace(t, "(?d)" + COPYRIGHT_LINE, " ")
    return F.concat(F.lit(" "), F.btrim(F.regexp_replace(t, r"[^a-z0-9\x{80}-\x{10FFFF}]+", " "), F.lit(" ")), F.lit(" "))


def spelled(t: Column) -> Column:
    for old, new in SPELLINGS:
        t = F.replace(t, F.lit(f" {old} "), F.lit(f" {new} "))
    return F.btrim(t, F.lit(" "))


def known_digests(spark: SparkSession) -> DataFrame:
    """digest, licence: one row for each known text; a fixed, small table."""
    rows = sorted({(hashlib.sha256(canonical(text).encode()).hexdigest(), name) for name, text in NOTICES})
    return spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{d}', '{n}')" for d, n in rows) + " AS t(digest, licence)")


def scan_licenses(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Per document: doc_id, license (of the entire text), n_license_lines, licenses (of lines, sorted, comma-joined).

    `known` (digest, licence) is joined by hash; it is broadcast only as far as the session's own size threshold allows.
    """
    docs = plain_columns(docs, "doc_id", "text")
    own = known is None
    known = known_digests(docs.sparkSession) if own else known.select("digest", "licence")
    hint = F.broadcast if own else (lambda x: x)
    longest = max(len(canonical(text)) for _, text in NOTICES) if own else None
    units = docs.select(F.struct("doc_id", F.xxhash64("text").alias("h")).alias("key"), "text")
    lines = units.select("key", F.posexplode(F.concat(F.array("text"), F.split("text", "\n"))).alias("pos", "unit"))
    if own:  # a spelling changes a text in place, so that a text's first characters settle those of its canonical form
        heads = sorted({canonical(text)[:HEAD] for _, text in NOTICES})
        lines = lines.where(F.left(spelled(F.left(unspelled(F.col("unit")), F.lit(SETTLES))), F.lit(HEAD)).isin(heads))
    blank = lines.select("key", "pos", F.sha2(canonical_column(F.col("unit"), longest), 256).alias("digest"))
    found = blank.join(hint(known), "digest")
    marks = found.select("key", "pos", "licence")
    # A row of each document, so that those without a match stay.
    rows = units.select("key", F.lit(-1).alias("pos"), F.lit(None).cast("string").alias("licence"))
    whole = F.when(F.col("pos") == 0, F.col("licence"))
    line = F.when(F.col("pos") > 0, F.struct("pos", "licence"))
    out = rows.unionByName(marks).groupBy("key").agg(
        F.min(whole).alias("license"),
        F.collect_set(line).alias("lines"),
        F.count(F.when(F.col("pos") == -1, 1)).cast("int").alias("rows"),
    )
    names = F.array_join(F.array_sort(F.array_distinct(F.transform("lines", lambda x: x["licence"]))), ",")
    return out.select(F.col("key.doc_id").alias("doc_id"), "license", F.size("lines").cast("long").alias("n_license_lines"), names.alias("licenses"), F.explode(F.array_repeat(F.lit(0), F.col("rows"))).alias("row")).drop("row")
