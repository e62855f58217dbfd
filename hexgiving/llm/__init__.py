"""Training-data operators: counting, filtering, deduplicating, packing and searching text at corpus scale.

Nothing outside this package imports it. Each operator has a general interface
(column names, thresholds) and ``queries.py`` holds the thin registered queries.
"""
