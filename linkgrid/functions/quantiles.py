"""Exact interpolated quantiles per group that never bring one group into one task.

``percentile`` keeps every distinct value of a group in one aggregation buffer, which is fine
for groups with a known bound (a cell's last 168 hours) and not for raw readings, where a
third of all rows may share one group. Here equal values are counted first (with map-side
combine), values fall into narrow order-preserving buckets, the bucket that holds the wanted
rank is found from the few bucket totals of the group. A wanted bucket is cut again, into
1024 equal parts between its own least and greatest value, and only the wanted part is ranked.
NaN counts as missing.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

Level = float | Callable[[Column], Column]
PARTS = 1024


def _bucket(value: Column, per_unit: int) -> Column:
    """Order-preserving bucket, about ``1 / per_unit`` wide relative to the value."""
    bucket = (F.signum(value) * F.floor(F.log1p(F.abs(value)) * per_unit)).cast("bigint")
    return F.coalesce(bucket, F.lit(0).cast("bigint"))


def _part(value: Column, low: Column, high: Column) -> Column:
    """Which of PARTS equal parts of [low, high] a value falls into; order-preserving."""
    share = F.when(high > low, (value - low) / (high - low)).otherwise(F.lit(0.0))
    return F.least(F.floor(share * PARTS), F.lit(PARTS - 1)).cast("int")


def _between(position: Column, start: Column, stop: Column) -> Column:
    return (start <= position) & (position < stop)


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    levels: dict[str, Level],
    weight: str | None = None,
    count: str = "samples",
    buckets_per_unit: int = 1024,
) -> DataFrame:
    """One row per group: ``keys``, one column per level, and the (weighted) count.

    A level is a number, or a function of the group's count (as the conformal offset needs).
    ``weight`` is a whole-number frequency column. NULL values are left out, and a group
    without any value gives no row. Groups are matched NULL-safely.
    """
    keys = list(keys)
    # One non-null struct per group: NULL keys match, and equality infers no extra filter, so
    # both uses of the counts below share one exchange and one scan.
    parts = [F.col(k).alias(f"k{i}") for i, k in enumerate(keys)] or [F.lit(1).alias("k0")]
    times = F.lit(1).cast("bigint") if weight is None else F.col(weight).cast("bigint")
    number = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))

    counted = (
        df.where(number.isNotNull())
        .select(F.struct(*parts).alias("__k"), number.alias("__v"), times.alias("__w"))
        .withColumn("__b", _bucket(F.col("__v"), buckets_per_unit))
        .groupBy("__k", "__b", "__v")
        .agg(F.sum("__w").alias("__c"))
    )

    group = W.partitionBy("__k")
    running = group.orderBy("__b").rowsBetween(W.unboundedPreceding, W.currentRow)
    totals = (
        counted.groupBy("__k", "__b")
        .agg(F.sum("__c").alias("__bc"), F.min("__v").alias("__low"), F.max("__v").alias("__high"))
        .withColumn("__stop", F.sum("__bc").over(running))
        .withColumn("__n", F.sum("__bc").over(group))
    )
    spots = {}
    for i, level in enumerate(levels.values()):
        at = level(F.col("__n")) if callable(level) else F.lit(float(level))
        spots[f"__p{i}"] = at * (F.col("__n") - 1)
    totals = totals.withColumns(spots)
    start = F.col("__stop") - F.col("__bc")
    ranks = [rank for spot in spots for rank in (F.floor(spot), F.ceil(spot))]
    wanted = reduce(or_, [_between(rank, start, F.col("__stop")) for rank in ranks])
    chosen = totals.where(wanted).select(
        F.col("__k").alias("__kr"),
        F.col("__b").alias("__br"),
        start.alias("__start"),
        "__low",
        "__high",
        "__n",
        *spots,
    )

    same = (F.col("__k") == F.col("__kr")) & (F.col("__b") == F.col("__br"))
    held = counted.join(chosen, same).withColumn(
        "__p", _part(F.col("__v"), F.col("__low"), F.col("__high"))
    )
    # Totals of the parts say which of them hold a rank, and where each begins.
    upto = W.partitionBy("__k", "__b").orderBy("__p").rowsBetween(
        W.unboundedPreceding, W.currentRow
    )
    parts = (
        held.groupBy("__k", "__b", "__p")
        .agg(F.sum("__c").alias("__pc"), F.first("__start").alias("__start"),
             *[F.first(s).alias(s) for s in spots])
        .withColumn("__stop", F.col("__start") + F.sum("__pc").over(upto))
    )
    first = F.col("__stop") - F.col("__pc")
    wanted = reduce(or_, [_between(rank, first, F.col("__stop")) for rank in ranks])
    parts = parts.where(wanted).select(
        F.col("__k").alias("__kp"), F.col("__b").alias("__bp"), F.col("__p").alias("__pp"),
        first.alias("__first"),
    )
    here = (
        (F.col("__k") == F.col("__kp")) & (F.col("__b") == F.col("__bp"))
        & (F.col("__p") == F.col("__pp"))
    )
    inside = W.partitionBy("__k", "__b", "__p").orderBy("__v").rowsBetween(
        W.unboundedPreceding, W.currentRow
    )
    ranked = (
        held.join(parts, here)
        .withColumn("__upto", F.col("__first") + F.sum("__c").over(inside))
        .withColumn("__from", F.col("__upto") - F.col("__c"))
    )
    picks = []
    for spot in spots:
        for side, rank in (("lo", F.floor(spot)), ("hi", F.ceil(spot))):
            hit = _between(rank, F.col("__from"), F.col("__upto"))
            picks.append(F.max(F.when(hit, F.col("__v"))).alias(f"{spot}{side}"))
    found = ranked.groupBy("__k").agg(
        F.max("__n").alias("__n"), *[F.max(s).alias(s) for s in spots], *picks
    )
    answers = []
    for name, spot in zip(levels, spots):
        low, high = F.col(f"{spot}lo"), F.col(f"{spot}hi")
        share = F.col(spot) - F.floor(spot)
        answers.append((low + (high - low) * share).alias(name))
    return found.select(
        *[F.col(f"__k.k{i}").alias(k) for i, k in enumerate(keys)],
        *answers,
        F.col("__n").alias(count),
    )


def exact_median(df: DataFrame, keys: Sequence[str], value: str, name: str = "median",
                 count: str = "samples") -> DataFrame:
    return exact_quantiles(df, keys, value, {name: 0.5}, count=count)
