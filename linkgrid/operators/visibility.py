"""Satellites in view of a cell at an hour.

Positions come as a table, one row per object and hour, in earth-fixed kilometres (see
POSITION_SCHEMA). Each position is sent to the coarse tiles its footprint can touch, and cells
meet it there by an equality join on (hour, tile). Tiles without cells, and hours outside those
asked of a tile, are dropped before the shuffle: a broadcast of at most one row per tile of the
globe tells them. Exact elevation is a column expression.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkgrid.functions.cells import cell_lat, cell_lon
from linkgrid.functions.times import next_reconfig, seconds_to_reconfig

MASK_DEG = 25.0
TILE_DEG = 10.0
# WGS84 equatorial radius (km) and flattening.
WGS84_A = 6378.137
WGS84_F = 1.0 / 298.257223563
# The footprint is derived on a sphere; the pad covers the ellipsoid (0.2 degree of vertical
# deflection and 22 km of radius change the reach by less than half a degree).
_PAD_DEG = 1.0
_MIN_RADIUS_KM = 6356.7

POSITION_SCHEMA = "sat_id bigint, hour_utc timestamp, x double, y double, z double"


def footprint_deg(radius_km: Column, mask_deg: float = MASK_DEG) -> Column:
    """Largest central angle (degrees) at which an object at this radius can be in view."""
    mask = math.radians(mask_deg)
    reach = F.acos(F.lit(_MIN_RADIUS_KM * math.cos(mask)) / radius_km) - mask
    return F.degrees(reach) + _PAD_DEG


def _tile(degrees: Column) -> Column:
    return F.floor(degrees / TILE_DEG).cast("int")


def _with_tiles(sats: DataFrame) -> DataFrame:
    """One row per coarse tile the footprint (lat, lon + 180, reach) of a position can touch."""
    lat, lon, reach = F.col("__lat"), F.col("__lon"), F.col("__reach")
    # Past a pole the cap holds every longitude; below it the widest point is known.
    ratio = F.sin(F.radians(reach)) / F.cos(F.radians(lat))
    polar = (F.abs(lat) + reach >= 90.0) | (ratio >= 1.0)
    half = F.when(polar, F.lit(180.0)).otherwise(F.degrees(F.asin(F.least(ratio, F.lit(1.0)))))
    count = int(360 / TILE_DEG)
    corners = sats.withColumns(
        {
            "__row": _tile(F.greatest(lat - reach, F.lit(-90.0))),
            "__rows": _tile(F.least(lat + reach, F.lit(90.0))),
            "__half": half,
        }
    ).select(
        "hour_utc",
        "x",
        "y",
        "z",
        "__row",
        (F.col("__rows") - F.col("__row") + 1).alias("__rows"),
        _tile(lon - F.col("__half")).alias("__col"),
        _tile(lon + F.col("__half")).alias("__last"),
    )
    columns = F.least(F.col("__last") - F.col("__col") + 1, F.lit(count))
    # One generator over the block of tiles, numbered row by row.
    numbered = corners.withColumn("__cols", columns).withColumn(
        "__i", F.explode(F.sequence(F.lit(0), F.col("__rows") * F.col("__cols") - 1))
    )
    return numbered.select(
        "hour_utc",
        (F.col("__row") + F.floor(F.col("__i") / F.col("__cols")).cast("int")).alias("tile_lat"),
        F.pmod(F.col("__col") + F.col("__i") % F.col("__cols"), F.lit(count)).alias("tile_lon"),
        "x",
        "y",
        "z",
    )


def observer(lat: Column, lon: Column) -> dict[str, Column]:
    """Earth-fixed coordinates and unit vertical of a point on the ellipsoid."""
    e2 = WGS84_F * (2.0 - WGS84_F)
    la, lo = F.radians(lat), F.radians(lon)
    n = F.lit(WGS84_A) / F.sqrt(1.0 - F.lit(e2) * F.sin(la) * F.sin(la))
    return {
        "ox": n * F.cos(la) * F.cos(lo),
        "oy": n * F.cos(la) * F.sin(lo),
        "oz": n * (1.0 - e2) * F.sin(la),
        "ux": F.cos(la) * F.cos(lo),
        "uy": F.cos(la) * F.sin(lo),
        "uz": F.sin(la),
    }


def asked_tiles(placed: DataFrame) -> DataFrame:
    """Tiles that hold cells with the first and last hour asked there: 36 x 18 rows at most."""
    return placed.where(F.col("tile_lat").isNotNull()).groupBy("tile_lat", "tile_lon").agg(
        F.min("hour_utc").alias("__first"), F.max("hour_utc").alias("__final")
    )


def in_asked_tiles(reaching: DataFrame, placed: DataFrame) -> DataFrame:
    """Those (position, tile) rows that can meet a pair at all."""
    return (
        reaching.join(F.broadcast(asked_tiles(placed)), ["tile_lat", "tile_lon"])
        .where(F.col("hour_utc").between(F.col("__first"), F.col("__final")))
        .drop("__first", "__final")
    )


def sky_view(sats: DataFrame, pairs: DataFrame, mask_deg: float = MASK_DEG) -> DataFrame:
    """Per (cell, hour) pair: satellites at or above the mask, best elevation, least range.

    Every pair keeps a row: none in view gives 0 and NULLs.
    """
    radius = F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)
    reaching = _with_tiles(
        sats.withColumn("__r", radius)
        .where(F.col("__r") > _MIN_RADIUS_KM)
        .withColumns(
            {
                "__lat": F.degrees(F.asin(F.col("z") / F.col("__r"))),
                "__lon": F.degrees(F.atan2("y", "x")) + 180.0,
                "__reach": footprint_deg(F.col("__r"), mask_deg),
            }
        )
    )
    asked = pairs.select("h3_cell", "hour_utc").distinct()
    lat, lon = cell_lat(F.col("h3_cell")), cell_lon(F.col("h3_cell"))
    placed = asked.withColumns({"__clat": lat, "__clon": lon}).withColumns(
        {
            **observer(F.col("__clat"), F.col("__clon")),
            "tile_lat": _tile(F.col("__clat")),
            "tile_lon": F.pmod(_tile(F.col("__clon") + 180.0), F.lit(int(360 / TILE_DEG))),
        }
    )
    dx, dy, dz = F.col("x") - F.col("ox"), F.col("y") - F.col("oy"), F.col("z") - F.col("oz")
    distance = F.sqrt(dx * dx + dy * dy + dz * dz)
    up = dx * F.col("ux") + dy * F.col("uy") + dz * F.col("uz")
    elevation = F.degrees(F.asin(F.greatest(F.least(up / F.col("__d"), F.lit(1.0)), F.lit(-1.0))))
    # The planner takes the fanned-out positions for as small as the elements they come from
    # and would broadcast them; a hash of the pairs per partition holds at most the cells of
    # one tile per key, and the positions stream past it.
    seen = (
        placed.hint("shuffle_hash")
        .join(in_asked_tiles(reaching, placed), ["hour_utc", "tile_lat", "tile_lon"])
        .withColumn("__d", distance)
        .withColumn("__el", elevation)
        .where(F.col("__el") >= mask_deg)
        .groupBy("h3_cell", "hour_utc")
        .agg(
            F.count(F.lit(1)).cast("int").alias("sats_visible"),
            F.max("__el").alias("max_elevation_deg"),
            F.min("__d").alias("min_range_km"),
        )
    )
    return asked.join(seen, ["h3_cell", "hour_utc"], "left").withColumn(
        "sats_visible", F.coalesce("sats_visible", F.lit(0))
    )


def orbital_features(positions: DataFrame, pairs: DataFrame) -> DataFrame:
    """The orbital mart: sky features at the label pairs only."""
    view = sky_view(positions, pairs)
    return view.select("h3_cell", "hour_utc", "sats_visible", "max_elevation_deg")


def sky_report(view: DataFrame, now: Column, weather: DataFrame) -> DataFrame:
    """Sky view per cell with its centre, the schedule clock and current weather if known."""
    return view.join(weather, "h3_cell", "left").withColumns(
        {
            "lat": cell_lat(F.col("h3_cell")),
            "lon": cell_lon(F.col("h3_cell")),
            "next_reconfig": next_reconfig(now),
            "seconds_to_reconfig": seconds_to_reconfig(now),
        }
    )
