"""Joins of many rows with one row for each key, where a key may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: a key is hot if it holds more than one in so many of the rows, so at most this many keys are hot
HOT_SHARE = 512


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, how: str = "inner") -> DataFrame:
    """`rows` with the columns of `groups`, which has one row for each key and the key's row count in `size`.

    Rows of hot keys meet a broadcast table of at most HOT_SHARE rows and are not shuffled; the rest go through a merge
    join, as exploded rows look small to the planner and must not be broadcast. Both inputs are evaluated more than once: pass stored tables. Rows with a null key count as unmatched.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    is_hot = F.col(size) * HOT_SHARE > F.lit(total)
    hot, cold = F.broadcast(groups.filter(is_hot)), groups.filter(~is_hot)
    return rows.join(hot, keys).unionByName(
        rows.join(F.broadcast(groups.filter(is_hot).select(*keys)), keys, "left_anti").join(cold.hint("merge"), keys, how)
    )
