"""Centres of cells, our own computed and foreign (H3) ones looked up in a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkgrid.functions.cells import cell_lat, cell_lon, is_h3

CENTRES = "h3_cell bigint, lat double, lon double"


def with_centres(rows: DataFrame, centres: DataFrame) -> DataFrame:
    """``rows`` with lat and lon of their h3_cell.

    ``centres`` (h3_cell, lat, lon; one row per id) holds foreign ids. A foreign id that it
    lacks keeps NULL for both, so that it can be set aside (see :func:`unplaced`). Only rows
    with foreign ids are joined.
    """
    cell = F.col("h3_cell")
    foreign = F.coalesce(is_h3(cell), F.lit(False))
    own = rows.where(~foreign).withColumns({"lat": cell_lat(cell), "lon": cell_lon(cell)})
    looked_up = rows.where(foreign).join(centres.select("h3_cell", "lat", "lon"), "h3_cell", "left")
    return own.unionByName(looked_up.select(own.columns))


def unplaced(rows: DataFrame) -> DataFrame:
    """One row per cell id without a centre: how many rows it has, and why."""
    reason = F.when(F.col("h3_cell").isNull(), "no cell").otherwise("no centre")
    return rows.where(F.col("lat").isNull() | F.col("lon").isNull()).groupBy(
        "h3_cell", reason.alias("reason")).agg(F.count(F.lit(1)).alias("rows"))
