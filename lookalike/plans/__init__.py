"""Compositions: the registered query catalog, the oracle SQL and the pipelines (L1, L2)."""
