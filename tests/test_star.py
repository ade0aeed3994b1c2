"""The fact graph is over all orders and line items."""

from factloom.plans import catalog
from factloom.sources.star import view
from factloom.verify import compare, oracle_connection


def tables(spark, folder: str) -> str:
    """Orders 1 to 5, each of the same three parts in a row: part o, o + 1, o + 2."""
    lines = [(o, n, o + n, 1, "R" if o == 3 else "N") for o in range(1, 6) for n in range(3)]
    for name, rows, schema in (
        ("lineitem", lines, "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long, l_returnflag string"),
        ("orders", [(o, 1) for o in range(1, 6)], "o_orderkey long, o_custkey long"),
        ("customer", [(1, "c", 1)], "c_custkey long, c_name string, c_nationkey long"),
        ("nation", [(1, "n", 1)], "n_nationkey long, n_name string, n_regionkey long"),
        ("region", [(1, "r")], "r_regionkey long, r_name string"),
        ("part", [(p, "p", "b", "t", 1) for p in range(1, 8)], "p_partkey long, p_name string, p_brand string, p_type string, p_size long"),
    ):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return folder


def test_no_order_is_left_out(spark, tmp_path):
    sf = tables(spark, str(tmp_path))
    edges = {(r["src"], r["dst"]) for r in view(spark, sf, "edges").where("kind = 'IMPORTS_FROM'").collect()}
    assert edges == {(f"file:part/{p}", f"file:part/{p + 1}") for p in range(1, 7)}
    nodes = {r["id"] for r in view(spark, sf, "nodes").collect()}
    assert {f"file:order/{o}" for o in range(1, 6)} <= nodes and "test:order/3#returns" in nodes
    path = catalog.QUERIES["q_shortest_path"](spark, sf).orderBy("step").collect()
    assert path[-1]["id"] == "file:order/1"
    for name in ("q_imports", "q_strong_components", "q_tests_for"):
        assert compare(spark, oracle_connection(sf), catalog.QUERIES[name], catalog.ORACLES[name], sf) == ""
