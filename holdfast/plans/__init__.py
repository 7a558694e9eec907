"""The analyses: compositions of sources, operators and per-method facts."""
