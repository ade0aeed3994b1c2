"""A query of each family against DuckDB on the smallest tables."""

import os

import pytest

SF = "/root/testdata/sf0.001"
NAMES = [
    "q_nodes", "q_edges_by_ids", "q_neighbors", "q_direct_edge_counts", "q_importers", "q_inheritors", "q_impact_files", "q_impact_tests", "q_changed", "q_renamed", "q_search_rank", "q_search_summary",
    "q_clone_findings", "q_clone_partitioned", "q_dead_exports", "q_layer_rules", "q_docs_length", "q_hub_coverage", "q_introduced", "q_run_status", "q_signal_delta", "q_latency_findings", "q_telemetry_ring", "q_coverage",
    "q_extract_nodes", "q_extract_edges", "q_extract_imports", "q_import_aliases", "q_reexports", "q_rust_methods", "q_store_refuses", "q_request_answers", "q_impact_limited", "q_ring_cycles", "q_check_loop", "q_search_rank_many",
]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, name):
    from factloom.plans import catalog, catalog_code, catalog_store  # noqa: F401
    from factloom.verify import compare, oracle_connection

    assert compare(spark, oracle_connection(SF), catalog.QUERIES[name], catalog.ORACLES[name], SF) == ""
