"""Serving features for cells and hours, payload shaping, and the map roll-up."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkgrid.functions.cells import cell_lat, cell_lon, cell_parent, cell_resolution
from linkgrid.functions.times import HORIZON_HOURS, horizon_hours, time_features, utc_literal
from linkgrid.functions.units import (
    BAND_FIELDS,
    PAYLOAD_TARGETS,
    SOURCE_QUALITY,
    TARGETS,
    basis_rank,
    metric_parts,
)
from linkgrid.operators.matrix import FEATURE_COLUMNS
from linkgrid.operators.weather import precip_features

SERVE_SOURCE_QUALITY = SOURCE_QUALITY["user"]


def horizon_pairs(cells: DataFrame, now: datetime, hours: int = HORIZON_HOURS) -> DataFrame:
    """(cell, hour) for every cell and every hour from the current one on."""
    steps = horizon_hours(utc_literal(now), hours)
    return cells.select("h3_cell").distinct().select(
        "h3_cell", F.explode(steps).alias("hour_utc")
    )


def serving_features(
    pairs: DataFrame,
    precip: DataFrame,
    orbital: DataFrame,
    tiles: DataFrame,
    medians: DataFrame,
) -> DataFrame:
    """The training feature vector for (cell, hour) pairs to be forecast.

    Same column functions as the training matrix, so the two cannot drift apart. Weather
    gaps read as dry, all other gaps as missing. ``medians`` has cell_median and basis.
    """
    pair = ["h3_cell", "hour_utc"]
    cell = F.col("h3_cell")
    return (
        precip_features(pairs, precip)
        .join(orbital.select(*pair, "sats_visible", "max_elevation_deg"), pair, "left")
        .join(tiles.select("h3_cell", "terrestrial_baseline_mbps", "devices"), "h3_cell", "left")
        .join(
            medians.select("h3_cell", F.col("cell_median").alias("cell_median_7d"), "basis"),
            "h3_cell",
            "left",
        )
        .withColumns(
            {
                **time_features(F.col("hour_utc"), cell_lon(cell)),
                "cell_lat": cell_lat(cell),
                "source_quality": F.lit(SERVE_SOURCE_QUALITY),
            }
        )
        .select(*pair, "basis", *[F.col(c).cast("double").alias(c) for c in FEATURE_COLUMNS])
    )


def assemble_payload(predicted: DataFrame) -> DataFrame:
    """Predicted bands to payload rows: basis, a nullable struct per target, weather.

    ``predicted`` has columns ``<target>_q10`` and so on; an untrained target has none.
    """
    bands = []
    for target, name in zip(TARGETS, PAYLOAD_TARGETS):
        empty = F.lit(None).cast("struct<q10: double, q50: double, q90: double>")
        if f"{target}_q50" in predicted.columns:
            parts = [F.col(f"{target}_{b}").alias(b) for b in BAND_FIELDS]
            band = F.when(F.col(f"{target}_q50").isNotNull(), F.struct(*parts)).otherwise(empty)
        else:
            band = empty
        bands.append(band.alias(name))
    return predicted.select(
        "h3_cell", "hour_utc", "basis", *bands, F.struct("precip_mm_h").alias("weather")
    )


def payload_horizon(payload: DataFrame, medians: DataFrame) -> DataFrame:
    """Payload rows in the shape the takeaways take.

    The resolved median is a latency one; there is no download median, so that trigger is off.
    """
    none = F.lit(None).cast("double")
    median = medians.select("h3_cell", F.col("cell_median").alias("latency_median"))
    return payload.join(median, "h3_cell", "left").select(
        "h3_cell",
        "hour_utc",
        *[F.col(f"latency.{b}").alias(f"latency_{b}") for b in BAND_FIELDS],
        F.col("dl.q50").alias("dl_q50"),
        F.col("weather.precip_mm_h").alias("precip_mm_h"),
        "basis",
        cell_lon(F.col("h3_cell")).alias("lon"),
        "latency_median",
        none.alias("dl_median"),
    )


def map_rollup(entries: DataFrame, metric: str, res: int = 4) -> DataFrame:
    """Payload entries of one hour to parent cells: mean, best basis, number of children."""
    if not 0 <= res <= 5:
        raise ValueError("res must be within 0..5")
    target, quantile = metric_parts(metric)
    cell = F.col("h3_cell")
    parent = F.when(cell_resolution(cell) <= res, cell).otherwise(cell_parent(cell, res))
    return (
        entries.where(F.col(target).isNotNull())
        .select(parent.alias("cell"), F.col(f"{target}.{quantile}").alias("value"), "basis")
        .groupBy("cell")
        .agg(
            F.avg("value").alias("value"),
            F.max_by("basis", basis_rank(F.col("basis"))).alias("basis"),
            F.count(F.lit(1)).alias("n"),
        )
    )
