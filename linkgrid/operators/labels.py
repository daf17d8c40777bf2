"""Label marts to the long-form label set, and the key sets that drive sparse features."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkgrid.functions.cells import RESOLUTION, cell_resolution

_KEYS = ("h3_cell", "hour_utc")


def _union(parts: list[DataFrame]) -> DataFrame:
    if not parts:
        raise ValueError("at least one source is needed")
    return reduce(DataFrame.unionByName, parts)


def _labels(mart: DataFrame, target, value: str, source: str) -> DataFrame:
    return mart.where(F.col(value).isNotNull()).select(
        F.col("h3_cell").cast("bigint").alias("h3_cell"),
        F.col("hour_utc").cast("timestamp").alias("hour_utc"),
        target.alias("target"),
        F.col(value).cast("double").alias("value"),
        F.lit(source).alias("source"),
        F.col("samples").cast("bigint").alias("samples"),
    )


def assemble_labels(
    probe: DataFrame | None = None, test: DataFrame | None = None, user: DataFrame | None = None
) -> DataFrame:
    """UNION ALL of the label marts that are given; NULL metrics make no label."""
    parts = []
    if probe is not None:
        parts.append(_labels(probe, F.lit("latency"), "rtt_ms_median", "atlas"))
    if test is not None:
        parts.append(_labels(test, F.lit("dl_throughput"), "dl_mbps_median", "mlab"))
        parts.append(_labels(test, F.lit("latency"), "rtt_ms_median", "mlab"))
    if user is not None:
        parts.append(_labels(user, F.col("target"), "value_median", "user"))
    return _union(parts)


def latency_labels(labels: DataFrame) -> DataFrame:
    return labels.where(F.col("target") == "latency").select(*_KEYS, "value")


def active_cells(*sources: DataFrame) -> DataFrame:
    """Distinct cells over any number of marts."""
    return _union([s.select("h3_cell") for s in sources]).distinct()


def active_map_cells(*marts: DataFrame) -> DataFrame:
    """The map's canvas: distinct cells of the fine resolution only."""
    cell = F.col("h3_cell")
    return active_cells(
        *[m.where(cell.isNotNull() & (cell_resolution(cell) == RESOLUTION)) for m in marts]
    )


def label_cell_hours(*marts: DataFrame) -> DataFrame:
    """Distinct (cell, hour) pairs for which features are worth computing."""
    return _union([m.select(*_KEYS) for m in marts]).distinct()
