"""Operators do the whole job: nothing is left out by a sample, a gate or a short list."""

import math
import pkgutil
import random
import re
import time

import numpy as np

from factloom.llm import language_model as lm
from factloom.llm import html, licenses, secrets


def test_all_training_rows_train(spark):
    docs = spark.createDataFrame([(i, "one two three four " * (2000 if i == 3 else 40)) for i in range(60)], "doc_id long, text string")
    few = lm.Settings(sample_docs=0, shard_bytes=60_000, shard_batch=4, piece=64, block_tokens=5000, shard_rate=0.03)
    rows = lm.score_documents(docs, few).orderBy("doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert held and sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert [r["score"] for r in held] == [r["score"] for r in lm.score_documents(docs.repartition(7), few).orderBy("doc_id").collect() if r["held_out"]]


def test_a_long_document_does_not_end_the_sample():
    settings = lm.Settings(sample_tokens=100, piece=10)
    ids = np.concatenate([np.zeros(1000, np.int64), np.ones(5, np.int64), np.full(25, 2)])
    got, sizes = lm.sample_pieces(ids, np.array([1000, 5, 25]), settings)
    assert (got == 1).sum() == 5 and (got == 2).sum() == 25 and 60 <= (got == 0).sum() <= 70
    assert sizes.sum() == len(got) <= 100 and sizes.max() <= 10


def test_full_licence_texts(spark):
    texts = {}
    for name in licenses.FILES:
        texts[name] = pkgutil.get_data("factloom.llm", f"license_texts/{name}.1.txt").decode()
    mit = next(text for name, text in licenses.SHORT if name == "MIT" and len(text) > 400)
    texts["MIT"] = "MIT License\n\nCopyright (c) 2020 Someone\n\n" + mit.replace("software and", "software\nand")
    texts["ISC"] = "ISC License\n\nCopyright 2020, Someone\n\n" + next(text for name, text in licenses.SHORT if name == "ISC")
    docs = spark.createDataFrame(list(texts.items()) + [("none", "x" + texts["MIT"])], "doc_id string, text string")
    found = {r["doc_id"]: r["license"] for r in licenses.scan_licenses(docs).collect()}
    assert found == {**{name: name for name in texts}, "none": None}


def test_first_characters_settle_the_first_of_the_canonical_form():
    for _, text in licenses.NOTICES:
        for text in (text, "Licence v2 v2 per cent whilst favour non commercial " * 5 + text):
            base = f" {re.sub('[^a-z0-9\u0080-\U0010ffff]+', ' ', re.sub(licenses.COPYRIGHT_LINE, ' ', text.lower())).strip()} "
            short = base[: licenses.SETTLES]
            for old, new in licenses.SPELLINGS:
                short = short.replace(f" {old} ", f" {new} ")
            assert short.strip(" ")[: licenses.HEAD] == licenses.canonical(text)[: licenses.HEAD]
    assert min(len(licenses.canonical(text)) for _, text in licenses.NOTICES) >= licenses.HEAD


def test_guess_cost_decides():
    for text, value in (
        ("pwd: QxZvTkLmWpRnBsHcJd", "QxZvTkLmWpRnBsHcJd"),
        ("passphrase = correct-horse-battery-staple", "correct-horse-battery-staple"),
        ("client_key: 8391027465019283", "8391027465019283"),
    ):
        a = text.index(value)
        assert f"guess:{a}:{len(text)}" in secrets.joined(secrets.scan_text(text, 8.0).spans)
    for text in ("pwd: aaaaaaaaaaaaaaaa", "passphrase: authentication", "credentials: something", "pwd: 12345678901234"):
        assert "guess" not in secrets.joined(secrets.scan_text(text, 8.0).spans)


def least_cost(value: str) -> float:
    """guess_cost over all segments, each taken from the definition."""
    n, low, plain = len(value), value.lower(), value.lower().translate(secrets.LEET)
    best = [0.0] + [math.inf] * n
    for i in range(n):
        here = best[i] + (secrets.SEGMENT if i else 0.0)
        for j in range(i + 1, n + 1):
            v, size = value[i:j], j - i
            costs = [here + math.log10(size) + 2.0] if size > 2 and all(low[k + 1] in secrets.BESIDE.get(low[k], ()) or abs(ord(low[k + 1]) - ord(low[k])) == 1 and low[k : k + 2].isalnum() and low[k].isalnum() for k in range(i, j - 1)) else []
            costs += [best[i] + 1.0] if size == 1 else []
            costs += [here + 1 + math.log10(size)] if size > 2 and v == v[0] * size else []
            costs += [here + p + math.log10(size // p) for p in range(2, 9) if size % p == 0 and size >= 2 * p and v == v[:p] * (size // p)]
            if plain[i:j] in secrets.WORD_RANK and size > 2:
                costs.append(here + math.log10(secrets.WORD_RANK[plain[i:j]] + 1) + 0.5 * ((low[i:j] != v) + (plain[i:j] != low[i:j])))
            m = secrets.DATE.match(value, i)
            if m and m.end() == j:
                costs.append(here + (4.0 if size > 4 else 2.0))
            best[j] = min([best[j], *costs])
    return best[n]


def test_every_length_of_a_run():
    rng = random.Random(3)
    values = ["asdfghunter", "aaaapple", "ababababc", "1234567dragon", "aabaabaabaab"]
    values += ["".join(rng.choice(["a", "b", "s", "d", "1", "2", "3", "the", "summer", "qwerty", "ab", "aaa", "2020"]) for _ in range(rng.randint(1, 14))) for _ in range(300)]
    for v in values:
        assert abs(secrets.guess_cost(v) - least_cost(v)) < 1e-9, v


def test_long_values_take_time_in_proportion():
    for v in ("a", "ab", "qwerty", "abcabd", "asdfghunter"):
        began = time.process_time()
        secrets.guess_cost(v * (60_000 // len(v)))
        assert time.process_time() - began < 20


def test_all_articles_of_a_run_and_parts_of_an_article():
    weights = html.learnt_weights(html.labelled_pages())
    prose = lambda w, n: f"<p>{' '.join(f'{w}{i}' for i in range(n))}</p>"
    links = "<ul>" + "<li><a href=x>link</a></li>" * 8 + "</ul>"
    two = f"<body><nav>{links}</nav><article>{prose('first', 80)}</article><article>{prose('second', 60)}<p>last</p></article><div>{links}</div></body>"
    found = html.main_text(two, weights)
    assert "first0" in found and "second59" in found and found.endswith("last") and "link" not in found
    page = f"<body><article><div class=post-header><h1>A title of seven words for this</h1></div>{prose('body', 80)}<section id=discussion>{prose('discussed', 40)}</section><div class=related>{links}</div><div class=ad>{prose('advert', 9)}</div></article></body>"
    found = html.main_text(page, weights)
    assert found.startswith("A title of seven") and "body79" in found and "discussed39" in found
    assert "link" not in found and "advert" not in found
