"""Sources (S1–S6) and sinks (K1–K5)."""
