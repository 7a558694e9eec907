"""Relational and graph operators that the analyses are made of, by column names."""
