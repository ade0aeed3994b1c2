"""What only shows with many partitions, hot keys, large counts and long or broken inputs."""

import math
import random
import time
from collections import Counter

import numpy as np
import pytest

from factloom.llm import html, jaccard, queries, secrets, suffixes
from factloom.llm import language_model as lm
from factloom.llm.html import extract_text
from factloom.llm.licenses import scan_licenses
from factloom.llm.mixing import demand_inverse, mix_sizes
from factloom.llm.secrets import scan_secrets

SF = "/root/testdata/sf0.001"
LONG = "lorem ipsum dolor sit amet " * 40_000


def test_suffixes_over_many_partitions_and_shuffled_joins(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    raw = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    seen = Counter(b[i : i + 400] for b in raw.values() for i in range(len(b) - 399))
    want = {}
    for k, b in raw.items():
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 399):
            if seen[b[i : i + 400]] > 1:
                gone[i : i + 400] = True
        want[k] = int(gone.sum())
    for most in (suffixes.FLAG_BYTES, 0):
        monkeypatch.setattr(suffixes, "FLAG_BYTES", most)
        assert {r["doc_id"]: r["n_removed"] for r in suffixes.remove_repeats(docs.repartition(24)).collect()} == want


def test_jaccard_in_small_blocks(spark, monkeypatch):
    words = [f"w{i}" for i in range(60)]
    rows = [(k, " ".join(words[:50] + [f"x{k}_{j}" for j in range(k % 3 * 2)])) for k in range(40)] + [(100, " ".join(words[::-1]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {k: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for k, t in rows}
    near = lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    want, todo = {}, sorted(sets)
    while todo:
        group, front = {todo[0]}, [todo[0]]
        while front:
            a = front.pop()
            new = [b for b in todo if b not in group and near(a, b)]
            group.update(new)
            front += new
        want |= dict.fromkeys(group, min(group))
        todo = [k for k in todo if k not in group]
    for block in (jaccard.BLOCK, 2):
        monkeypatch.setattr(jaccard, "BLOCK", block)
        monkeypatch.setattr(jaccard, "PROBES", 0 if block == 2 else 2)
        assert {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(docs).collect()} == want


def test_counts_above_32_bits():
    e = np.zeros(3, lm.COUNT)
    e["h"], e["c"] = [7, 7, 9], [1 << 33, 5, 1]
    assert lm.summed(e)["c"].tolist() == [(1 << 33) + 5, 1]


def test_weights_are_added_level_by_level(spark, monkeypatch):
    net = lm.new_net(lm.layout(3, lm.Settings()), lm.Settings())
    flat = np.concatenate([p.ravel() for p in net]).astype(np.float64)
    rows = [(i, i + 1, (flat * (i + 1) * i).tobytes()) for i in range(40)]
    nets = spark.createDataFrame(rows, "shard int, n long, weights binary")
    monkeypatch.setattr(lm, "NETS_IN_TASK", 3)
    got = np.concatenate([p.ravel() for p in lm.averaged(nets, net, 40)])
    mean = sum((i + 1) * i for i in range(40)) / sum(i + 1 for i in range(40))
    assert np.allclose(got, flat * mean, rtol=1e-4)


def test_gradient_of_the_network():
    """One step's direction against differences of the loss."""
    settings = lm.Settings(head=6, head_classes=2, hidden=4, embed=3, window=5, batch=2, epochs=1)
    lay = lm.layout(6, settings)
    ids, sizes = np.array([0, 3, 6, 2, 29, 1, 5, 4, 0, 2]), np.array([6, 4])
    net = lm.Net(*(p + 0.3 * np.sin(np.arange(p.size)).reshape(p.shape).astype(np.float32) for p in lm.new_net(lay, settings)))

    def loss(net: lm.Net) -> float:
        x, place, fresh = lm.in_lanes(ids, sizes, 2, lay.n_head + lm.TAIL)
        states = lm.forward(net, net.embed @ net.wx + net.b, x[:5], fresh[:5], np.zeros((2, 4), np.float32))
        live = place[:5].ravel() >= 0
        return -float(lm.token_logs(net, lay, states.reshape(-1, 4)[live], ids[place[:5].ravel()[live]]).mean())

    # Adam's first step goes against the sign of each gradient.
    moved = lm.fit(np.concatenate([ids[:5], ids[6:]]), np.array([5, 4]), lay, settings, net)
    assert loss(moved) < loss(net)
    for k in (1, 2, 4, 5, 7):
        flat = net[k].ravel()
        for at in range(0, flat.size, max(1, flat.size // 5)):
            up, down = ([p.copy() for p in net] for _ in range(2))
            up[k].ravel()[at] += 1e-2
            down[k].ravel()[at] -= 1e-2
            slope = (loss(lm.Net(*up)) - loss(lm.Net(*down))) / 2e-2
            if abs(slope) > 5e-3:
                assert np.sign(moved[k].ravel()[at] - flat[at]) == -np.sign(slope), (k, at)


def test_positions_follow_the_ramps(spark):
    docs = spark.createDataFrame([(i, f"s{i % 3}", "a b c " * (i % 7 + 1)) for i in range(90)], "doc_id long, source string, text string")
    rows = mix_sizes(docs).collect()
    assert all(r["first_position"] is None or 0 <= r["first_position"] <= 1 for r in rows)
    assert [r["first_position"] for r in rows if r["first_position"] is not None] == sorted(r["first_position"] for r in rows if r["first_position"] is not None)
    for ramp in (-0.5, 0.0, 0.5):
        for u in (0.0, 0.1, 0.5, 0.9, 1.0):
            t = spark.range(1).select(demand_inverse(*(__import__("pyspark.sql.functions", fromlist=["lit"]).lit(x) for x in (u, ramp))).alias("t")).first()["t"]
            assert math.isclose(t * (1 - ramp) + ramp * t * t, u, abs_tol=1e-9)  # the integral of 1 + ramp * (2t - 1)


def test_long_values_and_pages():
    began = time.process_time()
    assert secrets.guess_cost("ab" * 100_000) < 10
    weights = html.learnt_weights(html.labelled_pages())
    for page in ("<div class=comment>" * 8000 + "x", "<b>" * 20_000 + "<hr>" * 20_000, "<article>" + "<section class=related><p>a b c</p>" * 8000, "<div>" * 20_000 + "</b>" * 20_000):
        html.main_text(page, weights)
    assert time.process_time() - began < 30


def test_pages_without_an_article():
    weights = html.learnt_weights(html.labelled_pages())
    prose = "<p>" + "plain words of a story told at length " * 12 + "</p>"
    links = "<ul>" + "<li><a href=x>more</a></li>" * 9 + "</ul>"
    page = f"<html><body><div id=top>{links}</div><div class=post><h2>A heading of the story</h2>{prose}{prose}</div><div class=comments>{prose}</div><div>{links}</div></body></html>"
    found = html.main_text(page, weights)
    assert found.startswith("A heading of the story") and found.count("plain words") == 24 and "more" not in found


CLASH = "doc_id long, text string, spans string, license string, n_assign long, units string"


def test_defined_results_of_scans_and_pages(spark):
    docs = spark.createDataFrame([(1, None, "x", "y", 3, "z"), (2, "", "x", "y", 3, "z"), (3, LONG, "x", "y", 3, "z"), (3, LONG, "x", "y", 3, "z"), (None, "pwd: Xk9$mQ2!vT", "x", "y", 3, "z")], CLASH)
    found = scan_secrets(docs).collect()
    assert len(found) == 5 and sorted(r["spans"] for r in found)[:4] == [""] * 4 and max(r["spans"] for r in found) == "guess:5:15"
    found = scan_licenses(docs).collect()
    assert len(found) == 5 and all(r["license"] is None and r["n_license_lines"] == 0 for r in found)
    assert scan_secrets(docs.limit(0)).count() == scan_licenses(docs.limit(0)).count() == 0
    page = "<article><p>" + LONG + "</p></article>"
    pages = spark.createDataFrame([(1, "u", page, "t", 1), (1, "u", page, "t", 1), (None, None, None, "t", 1)], "page_id long, url string, html string, text string, n_chars long")
    found = sorted(extract_text(pages).collect(), key=lambda r: r["n_chars"])
    assert [r["n_chars"] for r in found] == [0, len(LONG) - 1, len(LONG) - 1] and found[1]["text"] == LONG.strip()
    assert extract_text(pages.limit(0)).count() == 0


def test_pipeline_stages_take_any_rows(spark, tmp_path):
    import corpus_pipeline

    from factloom.llm.quality import quality

    every = spark.read.parquet(f"{SF}/documents.parquet")
    good = every.join(quality(every).where("kept"), "doc_id", "left_semi").orderBy("doc_id").first()["text"]
    rows = [(1, good, "en", "a", 5, 1), (1, good, "en", "a", 5, 1), (2, None, None, None, None, 2), (3, "", "en", None, 0, 3), (None, good + " more", "en", "b", 7, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size long")
    for some in (docs, docs.limit(0)):
        now = some
        for _, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, SF)
            assert now.columns == docs.columns
        last = corpus_pipeline.STAGES[-1][1](spark, now, SF)
        assert last.count() == now.count() and (some is docs) == (now.count() > 0)


@pytest.mark.parametrize("name", ["op4_extract_html", "op9_secrets"])
def test_session_bounds_only_shrink(spark, name):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "40")
    queries.QUERIES[name](spark, SF).count()
    assert spark.conf.get(key) == "40"
    spark.conf.set(key, before)


def test_secrets_among_many_base_spans():
    words = ["secret=abcd1234", "pwd: Xk9$mQ2!vT", "passphrase=" + "f" * 40, "AKIA" + "B7" * 10, "token: 'QxZ vTk LmW pRn'", "plain"]
    rng = random.Random(3)
    text = " ".join(rng.choice(words) for _ in range(400))
    found = secrets.scan_text(text, 8.0)
    base = [(a, b) for a, k, b in found.spans if k < 3]
    want = []
    for m in secrets.CONTEXT.finditer(text):
        a, b = m.span(next(i for i in (1, 2, 3) if m[i] is not None))
        if not any(x < b and a < y for x, y in base) and secrets.guess_cost(text[a:b]) >= 8.0:
            want.append((a, b))
    assert [(a, b) for a, k, b in sorted(found.spans) if k == 3] == want and want
    assert len(secrets.scan_text("secret=abcd1234 pwd: banana1 " * 50_000, 8.0).spans) == 50_000
