"""Time splits that hold out each group's own newest quarter."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkgrid.functions.times import utc_literal

TEST_FRACTION = 0.25
STRATA = ("target", "source")


def split_cutoffs(
    rows: DataFrame, keys: Sequence[str] = STRATA, test_fraction: float = TEST_FRACTION
) -> DataFrame:
    """Cutoff hour per group; NULL where fewer than two distinct hours exist.

    Distinct hours are few (hours of history), so the window over them is bounded.
    """
    keys = list(keys)
    hours = rows.select(*keys, "hour_utc").distinct()
    group = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(1))
    ranked = hours.withColumns(
        {
            "__at": F.row_number().over(group.orderBy("hour_utc")) - 1,
            "__n": F.count(F.lit(1)).over(group),
        }
    )
    wanted = F.bround(F.col("__n") * (1.0 - test_fraction)).cast("bigint")
    index = F.greatest(F.lit(1).cast("bigint"), F.least(F.col("__n") - 1, wanted))
    pick = F.when((F.col("__n") >= 2) & (F.col("__at") == index), F.col("hour_utc"))
    return ranked.groupBy(*keys).agg(
        F.max(pick).alias("cutoff"), F.max("__n").cast("bigint").alias("distinct_hours")
    )


def stratified_split(
    rows: DataFrame, keys: Sequence[str] = STRATA, test_fraction: float = TEST_FRACTION
) -> DataFrame:
    """Rows with ``is_test``; a group that cannot be split is all train.

    The cutoff table has one row per (target, source): two targets times the source names.
    """
    keys = list(keys)
    cutoffs = split_cutoffs(rows, keys, test_fraction)
    renamed = cutoffs.select(*[F.col(k).alias(f"__c_{k}") for k in keys], "cutoff")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__c_{k}"))
    late = F.coalesce(F.col("hour_utc") >= F.col("cutoff"), F.lit(False))
    return (
        rows.join(F.broadcast(renamed), same, "left")
        .withColumn("is_test", late)
        .drop("cutoff", *[f"__c_{k}" for k in keys])
    )


def time_split(rows: DataFrame, cutoff: datetime) -> DataFrame:
    """Rows with ``is_test``: train strictly before the cutoff, test from it on."""
    return rows.withColumn("is_test", F.col("hour_utc") >= utc_literal(cutoff))
