"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import hashlib
import zlib

import numpy as np
import pytest

from factloom.llm.decontaminate import contamination, decontaminate
from factloom.llm.html import extract_text
from factloom.llm.jaccard import jaccard_components, keep_one
from factloom.llm.language_model import score_documents
from factloom.llm.licenses import scan_licenses
from factloom.llm.mixing import mix, mix_sizes
from factloom.llm.quality import keep_good, quality
from factloom.llm.queries import vocabulary_path
from factloom.llm.secrets import scan_secrets
from factloom.llm.suffixes import remove_repeats
from factloom.llm.tokenstore import read_store, token_store, write_store

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, size long, words string, key long, sid long, label string"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(20_000))
TEXTS = [(1, "the quick brown fox jumps over it"), (2, "the quick brown fox jumps over it"), (2, "the quick brown fox jumps over it"), (3, None), (4, ""), (5, " \n\t "), (None, "no id here at all"), (6, LONG), (7, "É ß 中文 \U0001f600 naïve")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i and i % 2 else None, None if i == 4 else f"s{(i or 0) % 3}", 0, -1, "x", 7, 8, "y") for i, t in TEXTS]
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(10, "Quick BROWN fox"), (9, None), (8, ""), (7, "quick brown fox"), (None, "over it"), (6, "never there at all")], "item_id long, text string")


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_contamination(docs, benchmark):
    found = rows(contamination(docs, benchmark))
    assert len(found) == len(TEXTS)
    for r in found:
        if r["doc_id"] in (1, 2):
            assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (7, 5, 2, True)
            assert r["items_sha256"] == hashlib.sha256(b"10,7").hexdigest()
        elif r["doc_id"] in (3, 4, 5):
            assert (r["n_words"], r["n_hit"], r["contaminated"]) == (0, 0, False)
    key = lambda r: (r["doc_id"] is None, r["doc_id"], r["n_words"])
    assert sorted(found, key=key) == sorted(rows(contamination(docs, benchmark, broadcast_rows=0)), key=key)
    assert decontaminate(docs, benchmark).count() == len(TEXTS) - 3
    assert contamination(docs.limit(0), benchmark).count() == 0
    assert sum(r["n_hit"] for r in rows(contamination(docs, benchmark.limit(0)))) == 0


def test_mixing(docs):
    found = rows(mix_sizes(docs))
    assert len(found) == len(TEXTS)
    assert all(r["taken"] <= 3 * r["size"] for r in found)
    by_source = {}
    for r in found:
        by_source.setdefault(r["source_size"], [r["target"], 0])[1] += r["taken"]
    assert all(abs(t - n) <= 1 for t, n in by_source.values())
    assert mix_sizes(docs.limit(0)).count() == 0
    mixed = mix(docs)
    assert mixed.columns == docs.columns and {(r["size"], r["key"]) for r in rows(mixed)} == {(-1, 7)}
    words = lambda t: len((t or "").split())
    assert sum(words(r["text"]) for r in rows(mixed)) == sum(r["taken"] for r in found)


def test_jaccard(docs):
    found = rows(jaccard_components(docs))
    assert sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0) for r in found)[1:4] == [(1, 3, 1), (2, 3, 1), (2, 3, 1)]
    assert {r["doc_id"]: r["component_id"] for r in found if r["n_shingles"] == 0} == {3: 3, 4: 4, 5: 5}
    kept = rows(keep_one(docs))
    assert len(kept) == len(TEXTS) - 2 and docs.columns == keep_one(docs).columns
    assert jaccard_components(docs.limit(0)).count() == 0


def test_language_model(docs):
    found = rows(score_documents(docs))
    assert len(found) == len(TEXTS)
    assert all(r["score"] < 0 and r["base_score"] < 0 for r in found)
    assert {r["n_tokens"] for r in found if r["doc_id"] in (3, 4, 5)} == {1}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0) for r in found if r["doc_id"] is not None)
    assert score_documents(docs.limit(0)).count() == 0


def test_quality(docs):
    found = rows(quality(docs))
    assert len(found) == len(TEXTS) and all(r["base_failed"] for r in found if r["doc_id"] != 6)
    assert [r["word_chars"] for r in found if r["doc_id"] == 7] == [10]
    assert {r["n_words"] for r in found if r["doc_id"] in (3, 4, 5)} == {0}
    assert keep_good(docs).columns == docs.columns
    assert quality(docs.limit(0)).count() == 0


def test_suffixes(docs, spark):
    found = rows(remove_repeats(docs))
    assert {r["n_removed"] for r in found if r["doc_id"] != 6} == {0}
    twice = spark.createDataFrame([(1, "ab" * 300), (2, "x" * 399), (3, "y" * 400), (3, "y" * 400)], "doc_id long, text string")
    got = {(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"]) for r in rows(remove_repeats(twice))}
    assert got == {(1, 600, 600, 1), (2, 399, 0, 0), (3, 400, 400, 1)}
    assert remove_repeats(docs.limit(0)).count() == 0


def test_suffixes_keep_passages_below_the_size(spark):
    def text(k, shared):
        return " ".join(f"d{k}a{i}" for i in range(90)) + f"{k}{shared}{k}" + " ".join(f"d{k}b{i}" for i in range(90))

    # 57 words with the blanks around them; the passages of documents 1 and 2 are a byte short.
    short, whole = (" " + " ".join(f"{p}{i:05d}" for i in range(56)) + f" {last} " for p, last in (("s", "s5600"), ("w", "w5600x")))
    assert (len(short), len(whole), len(short.split())) == (399, 400, 57)
    docs = spark.createDataFrame([(1, text(1, short)), (2, text(2, short)), (3, text(3, whole)), (4, text(4, whole)), (5, text(5, ""))], "doc_id long, text string")
    for size, gone in ((400, {3: whole, 4: whole}), (399, {1: short, 2: short, 3: whole, 4: whole})):
        got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows(remove_repeats(docs, size=size))}
        for r in rows(docs):
            k, t, cut = r["doc_id"], r["text"], gone.get(r["doc_id"], "")
            assert got[k] == (len(t), len(cut), int(k in gone), hashlib.sha256((t.replace(cut, "") if cut else t).encode()).hexdigest())


def test_token_store(docs, spark, tmp_path):
    from tokenizers import Tokenizer

    found = sorted(rows(token_store(docs, vocabulary_path())), key=lambda r: r["start"])
    assert [r["doc_id"] for r in found] == [None, 1, 2, 2, 3, 4, 5, 6, 7]
    tokenizer, at = Tokenizer.from_file(vocabulary_path()), 0
    texts = dict((i, t) for i, t in TEXTS)
    for r in found:
        ids = tokenizer.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids + [1]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert token_store(docs.limit(0), vocabulary_path()).count() == 0
    path = str(tmp_path / "store")
    write_store(docs, vocabulary_path(), path)
    chunks = spark.read.parquet(f"{path}/chunks")
    chunks.withColumn("ids", chunks["ids"].substr(1, 2)).write.mode("overwrite").parquet(f"{path}/broken")
    import shutil

    shutil.rmtree(f"{path}/chunks")
    shutil.move(f"{path}/broken", f"{path}/chunks")
    with pytest.raises(Exception, match="digest"):
        read_store(spark, path).collect()


def test_secrets(spark):
    text = 'é password=abcdefgh1 "api_key": "short" pwd: Xk9$mQ2!vT token = "' + "0a" * 20 + '" AKIA' + "A1" * 8 + " secret=bad"
    found = rows(scan_secrets(spark.createDataFrame([(1, text), (2, None), (2, "my password is strong, token: reading")], "doc_id long, text string")))
    spans = {x.split(":")[0]: text[int(x.split(":")[1]) : int(x.split(":")[2])] for x in found[0]["spans"].split(",")}
    assert (found[0]["n_assign"], found[0]["n_access"], found[0]["n_hex"]) == (2, 1, 1)
    assert spans["access"] == "AKIA" + "A1" * 8 and spans["guess"] == "Xk9$mQ2!vT"
    assert found[1]["spans"] == found[2]["spans"] == ""
    assert found[1]["base_sha256"] == hashlib.sha256(b"").hexdigest()


def test_licenses(spark):
    texts = [(1, "Copyright 2020 Someone\nLICENCED under the MIT licence!"), (2, None), (3, "x\nLicensed under CC BY-NC 4.0.\ny"), (3, "x\nLicensed under CC BY-NC 4.0.\ny"), (4, "")]
    found = sorted(rows(scan_licenses(spark.createDataFrame(texts, "doc_id long, text string"))), key=lambda r: r["doc_id"])
    assert [(r["doc_id"], r["license"], r["n_license_lines"], r["licenses"]) for r in found] == [
        (1, "MIT", 1, "MIT"), (2, None, 0, ""), (3, None, 1, "CC-BY-NC-4.0"), (3, None, 1, "CC-BY-NC-4.0"), (4, None, 0, ""),
    ]


def test_html(spark):
    page = "<html><body><nav><a>menu</a></nav><article><h1>A &amp; B</h1><p>One  two\nthree <b>four</b><p>five<aside>no</aside><form>no</form></article><div class='comments'><p>me too</p></div></body>"
    found = rows(extract_text(spark.createDataFrame([(1, "u", page), (2, None, None), (3, "v", ""), (4, "w", "<p>")], "page_id long, url string, html string")))
    assert [r["text"] for r in found] == ["A & B\n\nOne two three four\n\nfive", "", "", ""]
    assert found[0]["n_chars"] == len(found[0]["text"])
