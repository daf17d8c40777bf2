"""Precipitation at label pairs, with exact one-hour-back and three-hours-ahead lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkgrid.functions.times import HOUR_SECONDS

# Hour offset of each feature; the look-ahead is the value at that hour.
OFFSETS = {"precip_mm_h": 0, "precip_lag_1h": -1, "precip_forecast_3h": 3}


def precip_features(pairs: DataFrame, series: DataFrame) -> DataFrame:
    """One row per (cell, hour) pair; hours the series lacks read as dry.

    Every series row is sent to the three pairs it can serve and the offsets are folded
    back by one aggregate, so the series and the pairs are shuffled once each.
    """
    serve = F.explode(
        F.array(
            *[
                F.struct(F.lit(name).alias("feature"), F.lit(-hours * HOUR_SECONDS).alias("by"))
                for name, hours in OFFSETS.items()
            ]
        )
    )
    served = (
        series.select("h3_cell", "hour_utc", "precip_mm_h", serve.alias("s"))
        .select(
            "h3_cell",
            F.timestamp_seconds(F.unix_seconds("hour_utc") + F.col("s.by")).alias("hour_utc"),
            *[
                F.when(F.col("s.feature") == name, F.col("precip_mm_h")).alias(name)
                for name in OFFSETS
            ],
        )
        .groupBy("h3_cell", "hour_utc")
        .agg(*[F.max(name).alias(name) for name in OFFSETS])
    )
    joined = pairs.select("h3_cell", "hour_utc").join(served, ["h3_cell", "hour_utc"], "left")
    return joined.select(
        "h3_cell",
        "hour_utc",
        *[F.coalesce(F.col(name), F.lit(0.0)).alias(name) for name in OFFSETS],
    )


def label_spans(pairs: DataFrame) -> DataFrame:
    """First and last date of weather each cell needs, padded by a day both ways."""
    return pairs.groupBy("h3_cell").agg(
        F.date_sub(F.to_date(F.min("hour_utc")), 1).alias("start_date"),
        F.date_add(F.to_date(F.max("hour_utc")), 1).alias("end_date"),
    )
