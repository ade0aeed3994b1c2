"""Plans: durable intermediate tables, the query catalogue and its SQL."""
