"""Top N items within every group: row_number with a rank filter.

The rank filter on ``row_number`` lets the optimiser put its group-limit operator before and after the shuffle:
each task keeps at most N rows per group before anything moves, so a group of millions of items costs N rows per
task. The tie rule is part of the sort order, so every run gives the same rows.

Edge cases: rows of a null or blank group, and rows without a score (null, NaN), are never chosen; of the rows
with one identifier only the latest counts, also if that one has no score; rows without an identifier can't be
told apart and take no part; equal scores are decided by the smaller identifier; an empty table gives an empty
result; extra columns are carried only if named in ``keep``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(rows: DataFrame, key: str, time: str, ties: Sequence[Column | str] = ()) -> DataFrame:
    """The latest row of every key, by the same group-limit as :func:`top_n`."""
    w = Window.partitionBy(key).orderBy(F.col(time).desc_nulls_last(), *ties)
    return rows.where(F.col(key).isNotNull()).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def top_n(rows: DataFrame, group: str, score: str, identifier: str, n: int = 5, keep: Sequence[str] = ()) -> DataFrame:
    """The ``n`` rows of highest score of every group, ties by smaller identifier, with their ``rank``."""
    rows = rows.where(F.col(group).isNotNull() & F.col(identifier).isNotNull() & F.col(score).isNotNull() & ~F.isnan(score)).select(group, score, identifier, *keep)
    w = Window.partitionBy(group).orderBy(F.col(score).desc(), F.col(identifier))
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
