"""Inputs derived from the driver tables, and the queries checked on them."""
