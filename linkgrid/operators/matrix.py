"""The training matrix: one row per label with its features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkgrid.functions.cells import cell_lat, cell_lon
from linkgrid.functions.times import time_features
from linkgrid.functions.units import source_quality

# The feature vector, in order.
FEATURE_COLUMNS = [
    "hour_sin",
    "hour_cos",
    "day_of_week",
    "local_solar_offset_h",
    "precip_mm_h",
    "precip_lag_1h",
    "precip_forecast_3h",
    "sats_visible",
    "max_elevation_deg",
    "cell_lat",
    "terrestrial_baseline_mbps",
    "devices",
    "cell_median_7d",
    "source_quality",
]

# The trailing window, both ends included.
TRAIL_FROM_S = 604_800
TRAIL_TO_S = 3_600


def trailing_median(labels: DataFrame, name: str = "cell_median_7d") -> DataFrame:
    """Median of the same cell and target from seven days to one hour earlier.

    Labels are hourly per source, so a window partition holds at most the hours of history
    times the sources, and a frame at most 168 of those hours. Never run on raw readings.
    """
    frame = (
        W.partitionBy("h3_cell", "target")
        .orderBy(F.unix_seconds("hour_utc"))
        .rangeBetween(-TRAIL_FROM_S, -TRAIL_TO_S)
    )
    return labels.withColumn(name, F.percentile("value", 0.5).over(frame))


def training_matrix(
    labels: DataFrame, orbital: DataFrame, weather: DataFrame, tiles: DataFrame
) -> DataFrame:
    """Labels with every feature; absent context stays NULL.

    One shuffle on (cell, target) for the trailing median and one on (cell, hour) shared by
    both mart joins. Tile context is joined on the cell alone.
    """
    cell = F.col("h3_cell")
    hour = F.col("hour_utc")
    lon = cell_lon(cell)
    pair = ["h3_cell", "hour_utc"]
    return (
        trailing_median(labels)
        .join(orbital.select(*pair, "sats_visible", "max_elevation_deg"), pair, "left")
        .join(
            weather.select(*pair, "precip_mm_h", "precip_lag_1h", "precip_forecast_3h"),
            pair,
            "left",
        )
        .join(tiles.select("h3_cell", "terrestrial_baseline_mbps", "devices"), "h3_cell", "left")
        .withColumns(
            {
                **time_features(hour, lon),
                "cell_lat": cell_lat(cell),
                "source_quality": source_quality(F.col("source")),
            }
        )
        .select(
            "h3_cell",
            "hour_utc",
            "target",
            "source",
            F.col("value").alias("label"),
            *[F.col(c).cast("double").alias(c) for c in FEATURE_COLUMNS],
        )
    )
