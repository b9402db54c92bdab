"""Plans: the timed pipeline, report queries, and the query catalogue."""
