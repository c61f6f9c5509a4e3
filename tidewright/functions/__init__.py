"""Window functions over (symbol, ts)."""
