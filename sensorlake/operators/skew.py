"""Joins of rows with one row per key, where a few keys may hold most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: At most so many keys hold more than one in so many of the rows; they are broadcast.
HOT_KEYS = 20_000


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, how: str = "inner", hot: int = HOT_KEYS) -> DataFrame:
    """rows joined with groups, which has one row per key and, in `size`, the rows of that key; size is not in the result.

    Keys with more than one in `hot` of all these rows are at most `hot` keys, whatever the data, so they are broadcast and
    their rows stay where they are.  The rest is shuffled by key, and no key brings a task more than that share.  Both inputs
    are read twice and should be written tables.  how: inner or left.  Rows with a null key match nothing.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    bound = total // hot
    large = F.broadcast(groups.where(F.col(size) > bound).drop(size))
    small = groups.where(F.col(size) <= bound).drop(size)
    in_place = rows.join(large, keys)
    dealt = rows.join(F.broadcast(groups.where(F.col(size) > bound).select(keys)), keys, "left_anti").join(small, keys, how)
    return in_place.unionByName(dealt)
