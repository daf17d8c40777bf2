"""Small fixed mappings and the device-status row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Label weight by source; anything else weighs 1.
SOURCE_QUALITY = {"user": 4.0, "atlas": 2.0, "mlab": 1.0}
# Latitude band width, basis order, the targets and their payload names.
BAND_WIDTH_DEG = 10.0
BASIS_RANK = {"cell": 2, "region": 1, "latitude_prior": 0}
TARGETS = ("latency", "dl_throughput")
PAYLOAD_TARGETS = ("latency", "dl")
QUANTILES = (0.1, 0.5, 0.9)
BAND_FIELDS = ("q10", "q50", "q90")


def source_quality(source: Column) -> Column:
    chain = F
    for name, weight in SOURCE_QUALITY.items():
        chain = chain.when(source == name, F.lit(weight))
    return chain.otherwise(F.lit(1.0))


def latitude_band(lat: Column, width: float = BAND_WIDTH_DEG) -> Column:
    return F.floor(lat / width).cast("int")


def basis_rank(basis: Column) -> Column:
    chain = F
    for name, rank in BASIS_RANK.items():
        chain = chain.when(basis == name, F.lit(rank))
    return chain.otherwise(F.lit(-1))


METRICS = {f"{t}_{b}": (t, b) for t in PAYLOAD_TARGETS for b in BAND_FIELDS}


def metric_parts(name: str) -> tuple[str, str]:
    """Target and quantile of a map metric such as 'dl_q50'."""
    if name not in METRICS:
        raise ValueError(f"{name!r} is not one of {', '.join(METRICS)}")
    return METRICS[name]


def device_measurements(status: DataFrame) -> DataFrame:
    """Raw device status to measurement columns; other columns pass through."""
    latency = F.col("pop_ping_latency_ms")
    share = F.least(F.greatest(F.col("fraction_obstructed") * 100.0, F.lit(0.0)), F.lit(100.0))
    raw = {
        "pop_ping_latency_ms",
        "downlink_throughput_bps",
        "uplink_throughput_bps",
        "fraction_obstructed",
        "hardware_version",
    }
    kept = [c for c in status.columns if c not in raw]
    return status.select(
        *kept,
        F.lit("reporter").alias("source"),
        F.when(latency > 0, latency).alias("latency_ms"),
        (F.col("downlink_throughput_bps") / 1e6).alias("dl_mbps"),
        (F.col("uplink_throughput_bps") / 1e6).alias("ul_mbps"),
        # greatest/least skip NULLs, so a missing share has to be kept missing here.
        F.when(F.col("fraction_obstructed").isNotNull(), F.bround(share, 4)).alias(
            "obstruction_pct"
        ),
        F.col("hardware_version").alias("hw_version"),
    )
