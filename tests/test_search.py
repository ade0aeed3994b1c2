"""An index gives what one pass over the documents gives."""

import pytest

from factloom.operators import search

NODES = [
    ("file:a/x.py", "File", "a/x.py", None, None),
    ("function:a/x.py#readAll", "Function", "a/x.py", "readAll", '{"signature":"def read all all"}'),
    ("function:b/y.py#read", "Function", "b/y.py", "read", None),
    ("class:b/y.py#Reader", "Class", "b/y.py", "Reader", None),
    ("module:m", "Module", None, "read read", None),
    ("test:b/y.py#t", "Test", "b/y.py", "", None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return search.search_documents(spark.createDataFrame(NODES, "id string, kind string, path string, name string, attributes string"))


@pytest.mark.parametrize("query", ["read", "readAll", "read all all", "b y", "none such", "", "READ"])
@pytest.mark.parametrize("few", [0, 100_000])
def test_index_equals_documents(spark, docs, query, few, monkeypatch):
    monkeypatch.setattr(search, "FEW_HITS", few)
    index = search.build_index(docs)
    for f in (search.matches, search.bonuses, search.match_columns, search.search, search.search_summary):
        a, b = f(docs, query), f(index, query)
        assert sorted(map(str, a.select(*sorted(a.columns)).collect())) == sorted(map(str, b.select(*sorted(b.columns)).collect())), f.__name__
    a, b = ({r["node_id"]: round(r["bm25"], 9) for r in search.bm25(x, query).collect()} for x in (docs, index))
    assert a == b


def test_empty_index(spark, docs):
    index = search.build_index(docs.limit(0))
    assert search.search(index, "read").count() == 0
    assert search.search_summary(index, "read").first()["total"] == 0


def test_candidates_hold_every_match(spark, docs):
    """What one pass leaves out by texts as written never matches."""
    rows = [*NODES, ("function:c/z.py#RéadAll", "Function", "c/Über/İz.py", "HTTPRead", '{"signature":"\\u0072ead 13"}'), ("a:readX", "Type", None, None, None), ("b:re-ad", "Type", "q", "reAd", None)]
    nodes = spark.createDataFrame(rows, "id string, kind string, path string, name string, attributes string")
    for query in ("read", "readAll", "read 13", "x py", "re ad", "Type", "none such", ""):
        few = search.search_documents(search.candidates(nodes, query))
        a, b = (sorted(map(tuple, search.match_columns(x, query).collect())) for x in (search.search_documents(nodes), few))
        assert a == b and (a or query in ("none such", "")), query
    assert search.candidates(nodes, "read 13").count() == 1


def test_a_search_for_matches_builds_no_index(spark):
    from factloom.plans import catalog
    from factloom.sources import star

    sf = "/root/testdata/sf0.001/../sf0.001"  # a folder of its own for what is built once
    assert catalog.QUERIES["q_search_columns"](spark, sf).count() == catalog.QUERIES["q_search_match"](spark, sf).count()
    assert not star.made(spark, sf, "search") and not star.made(spark, sf, "nodes")
