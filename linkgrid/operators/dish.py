"""Per-user underperformance verdict against the expected band."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkgrid.functions.stats import binomial_tail

# Sample floor, window, null probability, rejection level, hours of day.
MIN_MEASUREMENTS = 20
WINDOW = 50
NULL_BELOW_Q10_PROB = 0.1
ALPHA = 0.01
MIN_DISTINCT_HOURS = 3


def recent_downloads(measurements: DataFrame, window: int = WINDOW) -> DataFrame:
    """Newest ``window`` download readings per user (ties on id).

    The rank filter makes Spark keep at most ``window`` rows per user in every input
    partition before the shuffle, so one very busy user does not fill a task.
    """
    order = W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("measurement_id"))
    return (
        measurements.where(F.col("dl_mbps").isNotNull())
        .withColumn("__rank", F.row_number().over(order))
        .where(F.col("__rank") <= window)
        .drop("__rank")
    )


def modal_cells(recent: DataFrame) -> DataFrame:
    """The cell a user reports from most often; ties go to the most recent one."""
    counts = recent.groupBy("user_id", "h3_cell").agg(
        F.count(F.lit(1)).alias("n"), F.max("ts").alias("latest")
    )
    return counts.groupBy("user_id").agg(
        F.max_by("h3_cell", F.struct("n", "latest", "h3_cell")).alias("h3_cell")
    )


def evaluate_dishes(scored: DataFrame) -> DataFrame:
    """One verdict per user from rows with dl_mbps, q10, q50, ts and obstruction_pct.

    Groups hold at most the recent window, so the plain exact percentile is bounded.
    """
    below = F.col("dl_mbps") < F.col("q10")
    stats = scored.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_evaluated"),
        F.count_if(below).alias("__below"),
        F.count_distinct(F.when(below, F.hour("ts"))).alias("__hours"),
        F.percentile("dl_mbps", 0.5).alias("__observed"),
        F.percentile("q50", 0.5).alias("__expected"),
        F.percentile("obstruction_pct", 0.5).alias("median_obstruction_pct"),
    )
    enough = F.col("n_evaluated") >= MIN_MEASUREMENTS
    p_value = binomial_tail(F.col("__below"), F.col("n_evaluated"), NULL_BELOW_Q10_PROB)
    flagged = enough & (p_value < ALPHA) & (F.col("__hours") >= MIN_DISTINCT_HOURS)
    effect = (F.col("__expected") - F.col("__observed")) / F.col("__expected") * 100.0
    zero = F.lit(0).cast("bigint")
    return stats.select(
        "user_id",
        F.when(~enough, "insufficient_data")
        .when(flagged, "underperforming")
        .otherwise("healthy")
        .alias("verdict"),
        "n_evaluated",
        F.when(enough, F.col("__below")).otherwise(zero).alias("below_q10_count"),
        F.when(enough, F.col("__hours")).otherwise(zero).alias("distinct_hours_below"),
        F.when(enough, p_value).alias("p_value"),
        F.when(flagged & (F.col("__expected") > 0), effect).alias("effect_size_pct"),
        "median_obstruction_pct",
    )


def dish_verdicts(
    recent: DataFrame, bands: DataFrame, medians: DataFrame, users: DataFrame | None = None
) -> DataFrame:
    """Verdict and basis for every user.

    ``recent`` comes from :func:`recent_downloads`, ``bands`` has measurement_id, q10 and q50,
    ``medians`` has h3_cell and basis. With ``users``, those without readings are listed too.
    """
    scored = recent.join(bands.select("measurement_id", "q10", "q50"), "measurement_id")
    return verdicts_of(scored, recent, medians, users)


def verdicts_of(
    scored: DataFrame, recent: DataFrame, medians: DataFrame, users: DataFrame | None = None
) -> DataFrame:
    """As :func:`dish_verdicts`, from recent rows that carry their q10 and q50."""
    basis = modal_cells(recent).join(medians.select("h3_cell", "basis"), "h3_cell", "left")
    verdicts = evaluate_dishes(scored).join(basis.select("user_id", "basis"), "user_id", "left")
    if users is not None:
        verdicts = users.select("user_id").distinct().join(verdicts, "user_id", "left")
    zero = F.lit(0).cast("bigint")
    fill = {
        "verdict": F.coalesce("verdict", F.lit("insufficient_data")),
        "n_evaluated": F.coalesce("n_evaluated", zero),
        "below_q10_count": F.coalesce("below_q10_count", zero),
        "distinct_hours_below": F.coalesce("distinct_hours_below", zero),
        "basis": F.coalesce("basis", F.lit("latitude_prior")),
    }
    return verdicts.withColumns(fill)
