"""Streams: latency records by window, and snapshots kept up to date."""
