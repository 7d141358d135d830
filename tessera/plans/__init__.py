"""Sessions, durable cuts and the registry of queries."""
