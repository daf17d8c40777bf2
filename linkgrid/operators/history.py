"""Keeping one row per key, and merging a new pull into kept history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def keep_best(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in ``order``. Spark limits each group before the shuffle."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).where(F.col("__rank") == 1).drop("__rank")


def merge_hourly(
    existing: DataFrame,
    new: DataFrame,
    keep_days: int = 90,
    keys: Sequence[str] = ("h3_cell", "hour_utc"),
) -> DataFrame:
    """History with a new pull: new rows win their key, old hours fall off (strictly).

    The newest merged hour is one number, taken first, so that the bound is a plain filter
    that reaches the scans and hours past it are never shuffled.
    """
    both = existing.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    newest = both.agg(F.max(F.unix_seconds("hour_utc"))).first()[0]
    if newest is not None:
        both = both.where(F.col("hour_utc") > F.timestamp_seconds(F.lit(newest - keep_days * 86_400)))
    return keep_best(both, keys, [F.desc("__new"), F.desc("samples")]).drop("__new")
