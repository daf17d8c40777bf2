"""Quantile-band scores, calibration offset, persistence skill and the promotion gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkgrid.functions.quantiles import exact_quantiles
from linkgrid.functions.units import source_quality
from linkgrid.operators.history import keep_best

# Coverage bounds (both included), calibration goal, persistence lag.
COVERAGE_BOUNDS = (0.78, 0.82)
CALIBRATION_COVERAGE = 0.8
PERSISTENCE_LAG_S = 7 * 86_400


def pinball(y: Column, predicted: Column, q: float) -> Column:
    residual = y - predicted
    return F.avg(F.greatest(residual * q, residual * (q - 1.0)))


def coverage(y: Column, low: Column, high: Column) -> Column:
    return F.avg(F.when(y.isNotNull(), ((y >= low) & (y <= high)).cast("double")))


def mae(y: Column, predicted: Column) -> Column:
    return F.avg(F.abs(y - predicted))


def conformal_offsets(
    scored: DataFrame, keys: list[str] | None = None, target_coverage: float = CALIBRATION_COVERAGE
) -> DataFrame:
    """Amount to widen each band edge by, per group, from held-out ``label``, ``q10``, ``q90``.

    The level depends on the group's size; ranking in buckets takes it as a column, so two
    targets with billions of rows each still spread over the cluster.
    """
    outside = F.greatest(F.col("q10") - F.col("label"), F.col("label") - F.col("q90"))
    keys = ["target"] if keys is None else keys

    def level(n: Column) -> Column:
        return F.least(F.lit(1.0), F.lit(target_coverage) * (F.lit(1.0) + F.lit(1.0) / n))

    return exact_quantiles(
        scored.withColumn("__out", outside), keys, "__out", {"conformal_offset": level}, count="n"
    )


def persistence_history(labels: DataFrame, value: str = "label") -> DataFrame:
    """One value per (cell, target, hour): best source quality, then source name."""
    best = keep_best(
        labels,
        ["h3_cell", "target", "hour_utc"],
        [F.desc(source_quality(F.col("source"))), F.asc("source")],
    )
    return best.select("h3_cell", "target", "hour_utc", F.col(value).alias("persistence"))


def with_persistence(
    rows: DataFrame, history: DataFrame, lag_seconds: int = PERSISTENCE_LAG_S
) -> DataFrame:
    """Rows with the value of the same cell and target one lag earlier, or NULL."""
    later = history.withColumn(
        "hour_utc", F.timestamp_seconds(F.unix_seconds("hour_utc") + lag_seconds)
    )
    return rows.join(later, ["h3_cell", "target", "hour_utc"], "left")


def band_report(scored: DataFrame) -> DataFrame:
    """One row per target: losses, coverage, skill on rows with a past value, and the gate.

    ``scored`` has target, label, q10, q50, q90 and persistence (NULL where there is none).
    Everything is one aggregate with partial sums. Without any fair row the two errors are
    NULL and the median counts as not better.
    """
    y, q10, q50, q90 = (F.col(c) for c in ("label", "q10", "q50", "q90"))
    fair = F.col("persistence").isNotNull()
    low, high = COVERAGE_BOUNDS
    scores = scored.groupBy("target").agg(
        F.count(F.lit(1)).alias("rows"),
        pinball(y, q10, 0.1).alias("pinball_q10"),
        pinball(y, q50, 0.5).alias("pinball_q50"),
        pinball(y, q90, 0.9).alias("pinball_q90"),
        coverage(y, q10, q90).alias("coverage"),
        F.count(F.when(fair, F.lit(1))).alias("fair_rows"),
        F.avg(F.when(fair, F.abs(y - q50))).alias("q50_mae"),
        F.avg(F.when(fair, F.abs(y - F.col("persistence")))).alias("persistence_mae"),
    )
    beats = F.coalesce(F.col("q50_mae") < F.col("persistence_mae"), F.lit(False))
    calibrated = F.coalesce(F.col("coverage").between(low, high), F.lit(False))
    return scores.withColumns(
        {
            "beats_persistence": beats,
            "calibrated": calibrated,
            "promote": beats & calibrated,
        }
    )


def promotion(report: DataFrame) -> DataFrame:
    """One row: promoted only when there is a target and every target passes."""
    return report.agg(F.coalesce(F.bool_and("promote"), F.lit(False)).alias("promoted"))
