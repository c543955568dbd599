"""Operators on texts, pages, names, vectors and events beyond the catalog."""
