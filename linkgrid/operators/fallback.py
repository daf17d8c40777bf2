"""Recent cell medians over three levels, latitude priors, and the fallback between them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkgrid.functions.cells import (
    REGION_RESOLUTION,
    WIDE_RESOLUTION,
    ancestors,
    cell_lat,
    cell_parent,
)
from linkgrid.functions.quantiles import exact_median
from linkgrid.functions.units import latitude_band

STATS_DAYS = 7
MIN_HOURS = 168


def cell_label_stats(latency: DataFrame, days: int = STATS_DAYS) -> DataFrame:
    """Median and distinct hours of each cell's and parent's own last ``days`` days.

    The newest hour of each cell is a partial aggregate; that of a parent follows from those
    few rows. A parent's newest hour is no older than its child's, so history older than the
    cell's own bound is dropped before anything is fanned out. A group is bounded by the hours
    of the window times sources times child cells, so the plain exact percentile is safe here.
    """
    newest = latency.groupBy("h3_cell").agg(F.max("hour_utc").alias("__last"))
    above = newest.select("h3_cell", "__last", F.explode(ancestors(F.col("h3_cell"))).alias("__at"))
    last_of = above.groupBy("__at").agg(F.max("__last").alias("__newest"))
    bound = F.unix_seconds("__newest") - days * 86_400
    bounds = (
        above.join(last_of, "__at")
        .groupBy(F.col("h3_cell").alias("__cell"))
        .agg(F.collect_list(F.struct(F.col("__at").alias("at"), bound.alias("bound")))
             .alias("__levels"), F.min(bound).alias("__oldest"))
    )
    hour = F.unix_seconds("hour_utc")
    kept = latency.join(bounds, F.col("h3_cell") == F.col("__cell")).where(hour > F.col("__oldest"))
    levels = F.filter("__levels", lambda level: F.unix_seconds("hour_utc") > level["bound"])
    recent = kept.select(F.explode(levels).alias("__l"), "hour_utc", "value").select(
        F.col("__l.at").alias("h3_cell"), "hour_utc", "value")
    return recent.groupBy("h3_cell").agg(
        F.percentile("value", 0.5).alias("median"),
        F.count_distinct("hour_utc").cast("int").alias("hours"),
    )


def latitude_priors(latency: DataFrame) -> DataFrame:
    """Median per latitude band over all history: few, huge groups, so ranked in buckets."""
    rows = latency.select(latitude_band(cell_lat(F.col("h3_cell"))).alias("band"), "value")
    return exact_median(rows, ["band"], "value", "median").select("band", "median")


def resolve_medians(
    cells: DataFrame, stats: DataFrame, priors: DataFrame, min_hours: int = MIN_HOURS
) -> DataFrame:
    """``cells`` plus ``cell_median`` and ``basis``, from the first level with enough hours.

    Each distinct cell looks its levels up in one join and keeps the finest hit; the bands
    (at most 19 rows) are broadcast. No hit and no band leaves NULL on 'latitude_prior'.
    """
    levels = F.array(
        F.col("h3_cell"),
        cell_parent(F.col("h3_cell"), REGION_RESOLUTION),
        cell_parent(F.col("h3_cell"), WIDE_RESOLUTION),
    )
    asked = cells.select("h3_cell").distinct().select(
        "h3_cell", F.posexplode(levels).alias("__level", "__at")
    )
    enough = stats.where(F.col("hours") >= min_hours).select(
        F.col("h3_cell").alias("__at"), F.col("median").alias("__median")
    )
    hits = asked.join(enough, "__at", "left")
    hit_level = F.when(F.col("__median").isNotNull(), F.col("__level"))
    best = hits.groupBy("h3_cell").agg(
        F.min(hit_level).alias("__hit"), F.min_by("__median", hit_level).alias("__median")
    )
    bands = priors.select(F.col("band").alias("__band"), F.col("median").alias("__prior"))
    resolved = (
        best.withColumn("__band", latitude_band(cell_lat(F.col("h3_cell"))))
        .join(F.broadcast(bands), "__band", "left")
        .select(
            "h3_cell",
            F.coalesce("__median", "__prior").alias("cell_median"),
            F.when(F.col("__hit") == 0, "cell")
            .when(F.col("__hit").isNotNull(), "region")
            .otherwise("latitude_prior")
            .alias("basis"),
        )
    )
    return resolved if cells.columns == ["h3_cell"] else cells.join(resolved, "h3_cell", "left")
