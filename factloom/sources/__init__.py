"""Sources: repositories, driver tables as facts, and JSON lines."""
