"""Column expressions for source sites, names and locks."""
