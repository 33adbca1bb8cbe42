"""Palimpsest: a Spark engine for versioned keyed tables and texts."""
