"""Where observations, site tables and method facts come from, and where results go."""
