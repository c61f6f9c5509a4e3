"""Plans: the registry of queries."""
