"""Equality joins that stay even when a key has a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if it has a thousandth of all rows; tables up to this size are joined plainly.
MANY_ROWS = 100_000
HOT_KEYS = 1000


def join_with_hot_keys(rows: DataFrame, table: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``table``, which has one row per key.

    ``weight`` is a column of ``table``: at least how many of the ``total`` rows have its
    key; it is left out of the result.  Keys with a thousandth of all rows or more are
    a thousand at most, so they are broadcast and their rows stay where they are; the
    rest is joined by shuffle.  ``table`` is read three times and should be a written one.
    """
    if total <= MANY_ROWS:
        return rows.join(table.drop(weight), keys)
    hot = F.col(weight) >= F.lit(max(1, total // HOT_KEYS))
    few, rest = F.broadcast(table.filter(hot).drop(weight)), table.filter(~hot).drop(weight)
    others = rows.join(F.broadcast(table.filter(hot).select(*keys)), keys, "left_anti")
    return rows.join(few, keys).unionByName(others.join(rest, keys))
