"""Training-data operators: scoring, deduplication, decontamination, formatting and packing.

Nothing outside this subpackage imports it. ``queries`` has the registered queries, ``sql`` the
DuckDB statements for those that SQL can express.
"""
