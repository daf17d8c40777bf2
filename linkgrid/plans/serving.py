"""Forecasts, takeaways, map and dish verdicts for all cells or users in one plan."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkgrid.functions.times import hour_of
from linkgrid.operators import bandcache, dish, forecast, takeaways
from linkgrid.operators.forest import QuantileForest
from linkgrid.session import shared_dir


def forecast_pairs(model: QuantileForest, pairs: DataFrame, precip: DataFrame, orbital: DataFrame,
                   tiles: DataFrame, medians: DataFrame) -> DataFrame:
    """Payload rows for any (cell, hour) pairs."""
    features = forecast.serving_features(pairs, precip, orbital, tiles, medians)
    return forecast.assemble_payload(model.predict(features))


def forecast_cells(model: QuantileForest, cells: DataFrame, now: datetime, precip: DataFrame,
                   orbital: DataFrame, tiles: DataFrame, medians: DataFrame,
                   cache: DataFrame | None = None, version: str = "") -> DataFrame:
    """The 48-hour payload of every cell; hours in the cache are not computed again."""
    pairs = forecast.horizon_pairs(cells, now)
    if cache is None:
        return forecast_pairs(model, pairs, precip, orbital, tiles, medians)
    gap = bandcache.missing_pairs(cache, pairs, version)
    computed = forecast_pairs(model, gap, precip, orbital, tiles, medians)
    return _cached(cache, pairs, precip, version).unionByName(computed)


def _cached(cache: DataFrame, pairs: DataFrame, precip: DataFrame, version: str) -> DataFrame:
    """Payload rows of the pairs that the cache has; weather is not cached and joins again."""
    cached = bandcache.cached_payload(cache, pairs, version)
    rain = precip.select("h3_cell", "hour_utc", "precip_mm_h")
    return cached.join(rain, ["h3_cell", "hour_utc"], "left").select(
        "h3_cell",
        "hour_utc",
        "basis",
        "latency",
        "dl",
        F.struct(F.coalesce("precip_mm_h", F.lit(0.0)).alias("precip_mm_h")).alias("weather"),
    )


def serve_cells(model: QuantileForest, cells: DataFrame, now: datetime, precip: DataFrame,
                orbital: DataFrame, tiles: DataFrame, medians: DataFrame, cache: str,
                version: str) -> DataFrame:
    """The payload through the stored cache at ``cache``: what was missing is written back.

    What the cache lacks is predicted once, stored as bands, and then the whole payload is read
    from the cache; only pairs without any band (no model) are taken from the prediction.
    """
    spark = cells.sparkSession
    pairs = forecast.horizon_pairs(cells, now)
    # Only the days that the horizon reaches into; the rest of the cache is not touched.
    hours = range(0, forecast.HORIZON_HOURS + 24, 24)
    days = sorted({(now + timedelta(hours=h)).date().isoformat() for h in hours})
    gap = bandcache.missing_pairs(bandcache.stored_bands(spark, cache, days), pairs, version)
    wanted = shared_dir(spark, "forecast-wanted")
    gap.write.parquet(wanted)
    gap = spark.read.schema(gap.schema).parquet(wanted)
    if gap.isEmpty():
        return _cached(bandcache.stored_bands(spark, cache, days), pairs, precip, version)
    path = shared_dir(spark, "forecast-gap")
    computed = forecast_pairs(model, gap, precip, orbital, tiles, medians)
    computed.write.parquet(path)
    computed = spark.read.schema(computed.schema).parquet(path)
    bandcache.store_bands(bandcache.payload_bands(computed, version), cache)
    served = _cached(bandcache.stored_bands(spark, cache, days), pairs, precip, version)
    bare = computed.where(F.col("latency").isNull() & F.col("dl").isNull())
    return served.unionByName(bare)


def cell_takeaways(payload: DataFrame, medians: DataFrame) -> DataFrame:
    return takeaways.takeaways(forecast.payload_horizon(payload, medians))


def score_dishes(model: QuantileForest, measurements: DataFrame, orbital: DataFrame,
                 tiles: DataFrame, medians: DataFrame) -> DataFrame:
    """Verdicts for all users: recent downloads against the dry-weather band of their hour.

    Time features come from the reading's own instant; sky features from its hour. The recent
    rows are written once; what a verdict needs is carried through prediction as columns.
    """
    spark = measurements.sparkSession
    path = shared_dir(spark, "recent-downloads")
    dish.recent_downloads(measurements).write.parquet(path)
    recent = spark.read.parquet(path)
    pairs = recent.select("h3_cell", hour_of(F.col("ts")).alias("hour_utc")).distinct()
    dry = pairs.select("h3_cell", "hour_utc", F.lit(0.0).alias("precip_mm_h"))
    features = forecast.serving_features(pairs, dry, orbital, tiles, medians).drop("basis")
    needed = ["user_id", "h3_cell", "ts", "dl_mbps", "obstruction_pct"]
    at = recent.select(*needed, hour_of(F.col("ts")).alias("hour_utc"))
    rows = at.join(features, ["h3_cell", "hour_utc"]).withColumns(
        {
            k: v
            for k, v in forecast.time_features(
                F.col("ts"), F.col("local_solar_offset_h") * 15.0
            ).items()
            if k in ("hour_sin", "hour_cos", "day_of_week")
        }
    )
    predicted = model.predict(rows, targets=["dl_throughput"])
    scored = predicted.select(
        *needed,
        F.col("dl_throughput_q10").alias("q10"),
        F.col("dl_throughput_q50").alias("q50"),
    )
    return dish.verdicts_of(scored, recent, medians, measurements)
