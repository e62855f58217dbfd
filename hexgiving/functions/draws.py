"""Repeatable pseudo-random order derived from a row key.

``rand(seed)`` depends on how rows are split into partitions, so a re-run
after an executor loss, or on another cluster, could draw differently. Here
the order is a hash of ``key || '|' || seed``: the same row always gets the
same place, whatever the partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def order_key(key: Column, seed: str | int) -> Column:
    """Sort key for a repeatable random order (full md5 text)."""
    return F.md5(F.concat(key.cast("string"), F.lit(f"|{seed}")))
