"""The queries against plain versions on the smallest tables."""

import hashlib
import math
import os
import re
import zlib
from collections import Counter

import pytest

from factloom.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows_as_sql(spark, name):
    from factloom.verify import compare, oracle_connection

    assert compare(spark, oracle_connection(SF), queries.QUERIES[name], queries.ORACLES[name], SF) == ""


def test_language_model_base(spark, texts):
    tokens = {k: [*WORD.findall(t.translate(FOLD)), None] for k, t in texts.items()}
    held = {k: zlib.crc32(str(k).encode()) % 10 == 0 for k in texts}
    count = Counter(w for k, t in tokens.items() if not held[k] for w in t)
    total, norm = sum(count.values()), math.log10(sum(count.values()) + 0.1 * (len(count) + 1))
    base = score = 0.0
    for r in queries.op5_language_model(spark, SF).collect():
        t = tokens[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(t), sum(count[w] > 0 for w in t), total)
        assert r["base_score"] == pytest.approx(sum(math.log10(count[w] + 0.1) - norm for w in t))
        if r["held_out"]:
            base, score = base + r["base_score"], score + r["score"]
    assert score > base


def test_quality_base(spark, texts):
    for r in queries.op6_quality_rules(spark, SF).collect():
        t = texts[r["doc_id"]]
        w = WORD.findall(t)
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        seen = Counter(grams)
        repeated = len({i + k for i, g in enumerate(grams) if seen[g] > 1 for k in range(3)})
        lines = [x for x in t.split("\n") if WORD.search(x)]
        failed = len(w) < 50 or 100 * repeated > 50 * len(w)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == (
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), repeated, failed,
        )
        assert not (failed and r["kept"])


def test_quality_keeps_good_labels(spark):
    from factloom.llm.quality import quality

    d = "/root/testdata/sf0.01"
    found = quality(spark.read.parquet(f"{d}/documents.parquet")).where("NOT base_failed")
    both = found.join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").groupBy("quality").agg({"kept": "count"}).collect()
    good = found.join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("quality = 1 AND NOT kept").count()
    bad = found.join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("quality = 0 AND kept").count()
    n = {r["quality"]: r[1] for r in both}
    assert good <= 0.01 * n[1] and bad <= 0.4 * n.get(0, 1)


def test_suffixes(spark, texts):
    raw = {k: t.encode() for k, t in texts.items()}
    seen = Counter(b[i : i + 400] for b in raw.values() for i in range(len(b) - 399))
    for r in queries.op7_suffix_dedup(spark, SF).collect():
        b = raw[r["doc_id"]]
        gone, end = [False] * len(b), 0
        for i in range(len(b) - 399):
            if seen[b[i : i + 400]] > 1:
                gone[max(i, end) : i + 400] = [True] * (i + 400 - max(i, end))
                end = i + 400
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(c for c, g in zip(b, gone) if not g)
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())


def test_secrets_base(spark, texts):
    for r in queries.op9_secrets(spark, SF).collect():
        t = texts[r["doc_id"]]
        assign = [m for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""", t) if len(m[2]) >= 8]
        access = [m for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        hexes = [m for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 32]
        spans = sorted((m.start(), k, m.end()) for k, found in enumerate((assign, access, hexes)) for m in found)
        line = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in spans)
        assert (r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) == (len(assign), len(access), len(hexes), hashlib.sha256(line.encode()).hexdigest())


def test_html_articles(spark):
    import html

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in queries.op4_extract_html(spark, SF).collect():
        body = re.search(r"(?s)<article>(.*?)</article>", pages[r["page_id"]])[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", lambda m: " " if m[0] == "<br>" else "", x)).split()) for x in re.split(r"</?(?:p|h1)>", body))
        assert r["text"] == "\n\n".join(x for x in blocks if x)


def test_pipeline_stages(spark):
    import corpus_pipeline
    from factloom.llm.decontaminate import contamination
    from factloom.llm.jaccard import jaccard_components
    from factloom.llm.quality import quality

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, stage = docs.columns, dict(corpus_pipeline.STAGES)
    good = stage["quality rules"](spark, docs, SF)
    assert {r["doc_id"] for r in good.collect()} == {r["doc_id"] for r in quality(docs).where("kept").collect()}
    one = stage["n-gram Jaccard join"](spark, good, SF)
    assert {r["doc_id"] for r in one.collect()} == {r["doc_id"] for r in jaccard_components(good).where("doc_id = component_id").collect()}
    clean = stage["benchmark decontamination"](spark, one, SF)
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in contamination(one, bench).where("NOT contaminated").collect()}
    mixed = stage["mixing sources to target weights"](spark, clean, SF)
    assert good.columns == one.columns == clean.columns == mixed.columns == columns
    assert stage["token-ID / binary output"](spark, mixed, SF).count() == mixed.count()
    assert corpus_pipeline.run(spark, SF).count() == mixed.count()
