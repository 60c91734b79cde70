"""Entity operators: each takes and returns DataFrames keyed by entity_id."""
