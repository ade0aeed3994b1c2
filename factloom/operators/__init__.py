"""Operators on the generic tables: nodes, edges, files, hashes, diagnostics and records."""
