"""48-hour horizons to congestion, rain and best-time windows, verdict and headline.

All cells are done in one plan with one shuffle on the cell: every window function and both
aggregates below partition by the cell, and a cell holds one row per horizon hour.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkgrid.functions.times import shift_hours, solar_phrase

# Thresholds relative to the cell's own median, run lengths in hours.
CONGESTION_DL_RATIO = 0.80
CONGESTION_LAT_RATIO = 1.25
NOTABLE_DL_RATIO = 0.65
NOTABLE_LAT_RATIO = 1.50
MIN_CONGESTION_RUN_H = 2
ROUGH_NOTABLE_RUN_H = 3
PRECIP_MEANINGFUL_MM_H = 0.5
BEST_WINDOW_H = 3
WIDE_BAND_RELATIVE = 0.8

# Wording of the payload.
CONFIDENCE = {"cell": "high", "region": "medium", "latitude_prior": "low"}
LOWER = {"high": "medium", "medium": "low", "low": "low"}
SMOOTH_HEADLINE = "Smooth sailing — no rough patches expected in the next 48 hours"
ROUGH_HEADLINE = "Rough patch ahead — expect a slowdown "
MIXED_HEADLINE = "Mostly smooth — one rough stretch "
MORE_WINDOWS = " (+%d more)"
BEST_DETAIL = f"calmest {BEST_WINDOW_H}-hour stretch — "
DL_DETAIL = "downloads ~%d%% below your area's normal"
LATENCY_DETAIL = "latency ~%d%% above your area's normal"
RAIN_DETAIL = "rain overlaps this dip — weather is the likely cause"


def _choose(column: Column, mapping: dict[str, str], default: str) -> Column:
    chain = F
    for key, value in mapping.items():
        chain = chain.when(column == key, F.lit(value))
    return chain.otherwise(F.lit(default))


def hour_flags(horizon: DataFrame) -> DataFrame:
    """Adds mild, notable, worst (share worse than normal), driver and wet to each hour.

    Expects latency_q50, dl_q50, latency_median, dl_median and precip_mm_h; any may be NULL,
    and a NULL or non-positive median switches its trigger off.
    """
    dl = F.when(F.col("dl_median") > 0, F.col("dl_q50") / F.col("dl_median"))
    lat = F.when(F.col("latency_median") > 0, F.col("latency_q50") / F.col("latency_median"))
    no = F.lit(False)
    dl_mild = F.coalesce(dl < CONGESTION_DL_RATIO, no)
    lat_mild = F.coalesce(lat > CONGESTION_LAT_RATIO, no)
    dl_worse = F.when(dl_mild, 1.0 - dl).otherwise(0.0)
    lat_worse = F.when(lat_mild, lat - 1.0).otherwise(0.0)
    return horizon.withColumns(
        {
            "mild": dl_mild | lat_mild,
            "notable": F.coalesce(dl < NOTABLE_DL_RATIO, no)
            | F.coalesce(lat > NOTABLE_LAT_RATIO, no),
            "worst": F.greatest(dl_worse, lat_worse),
            "driver": F.when(lat_worse > dl_worse, "latency").when(dl_worse > 0, "dl"),
            "wet": F.coalesce(F.col("precip_mm_h") > PRECIP_MEANINGFUL_MM_H, no),
        }
    )


def _runs(horizon: DataFrame) -> DataFrame:
    """Numbers hours per cell and names the run (island) each flagged hour belongs to."""
    by_hour = W.partitionBy("h3_cell").orderBy("hour_utc")
    same = lambda flag: W.partitionBy("h3_cell", flag).orderBy("hour_utc")
    run_size = F.count(F.lit(1)).over(W.partitionBy("h3_cell", "mild", "mild_run"))
    return (
        hour_flags(horizon)
        .withColumns(
            {
                "idx": F.row_number().over(by_hour),
                "next_hour": F.coalesce(
                    F.lead("hour_utc").over(by_hour), shift_hours(F.col("hour_utc"), 1)
                ),
            }
        )
        .withColumns(
            {
                "mild_run": F.col("idx") - F.row_number().over(same("mild")),
                "wet_run": F.col("idx") - F.row_number().over(same("wet")),
            }
        )
        .withColumn("congested", F.col("mild") & (run_size >= MIN_CONGESTION_RUN_H))
    )


def _best_start(hours: DataFrame) -> DataFrame:
    """Adds the summed latency of the stretch starting at each hour, NULL past the edge."""
    by_hour = W.partitionBy("h3_cell").orderBy("hour_utc")
    total = F.col("latency_q50")
    for ahead in range(1, BEST_WINDOW_H):
        total = total + F.lead("latency_q50", ahead).over(by_hour)
    return hours.withColumns(
        {
            "calm_sum": total,
            "calm_end": F.lead("next_hour", BEST_WINDOW_H - 1).over(by_hour),
        }
    )


def takeaway_windows(horizon: DataFrame) -> DataFrame:
    """One row per cell and window, plus one row of kind 'cell' with the cell's own summary."""
    hours = _best_start(_runs(horizon))
    member = lambda kind, run: F.struct(
        F.lit(kind).alias("kind"), run.cast("bigint").alias("run")
    )
    groups = F.array_compact(
        F.array(
            member("cell", F.lit(0)),
            F.when(F.col("congested"), member("congestion", F.col("mild_run"))),
            F.when(F.col("wet"), member("rain", F.col("wet_run"))),
        )
    )
    width = F.when(
        F.col("latency_q50") > 0,
        (F.col("latency_q90") - F.col("latency_q10")) / F.col("latency_q50"),
    )
    calm = F.when(F.col("calm_sum").isNotNull(), F.struct("calm_sum", "idx"))
    return (
        hours.withColumn("__g", F.explode(groups))
        .groupBy("h3_cell", F.col("__g.kind").alias("kind"), F.col("__g.run").alias("run"))
        .agg(
            F.min("hour_utc").alias("start"),
            F.max("next_hour").alias("end"),
            F.count(F.lit(1)).alias("hours"),
            F.max("worst").alias("worst"),
            F.max_by("driver", F.struct(F.col("worst"), -F.col("idx"))).alias("driver"),
            F.bool_or("notable").alias("any_notable"),
            F.bool_or("congested").alias("any_congested"),
            F.count("latency_q50").alias("latency_hours"),
            F.avg(width).alias("mean_width"),
            F.min_by("hour_utc", calm).alias("best_start"),
            F.min_by("calm_end", calm).alias("best_end"),
            F.first("lon").alias("lon"),
            F.first("basis").alias("basis"),
            F.bool_or(
                F.col("latency_median").isNotNull() | F.col("dl_median").isNotNull()
            ).alias("has_median"),
        )
        .where((F.col("kind") != "rain") | F.col("any_congested"))
        .withColumn("severity", _severity())
    )


def _severity() -> Column:
    notable = (F.col("kind") == "congestion") & F.col("any_notable")
    return F.when(F.col("kind") != "cell", F.when(notable, "notable").otherwise("mild"))


def _detail() -> Column:
    percent = F.bround(F.col("worst") * 100).cast("int")
    dl = F.when(percent.isNotNull(), F.format_string(DL_DETAIL, percent))
    latency = F.when(percent.isNotNull(), F.format_string(LATENCY_DETAIL, percent))
    return F.when(F.col("kind") == "rain", F.lit(RAIN_DETAIL)).otherwise(
        F.when(F.col("driver") == "dl", dl).otherwise(latency)
    )


def takeaways(horizon: DataFrame) -> DataFrame:
    """One row per cell: verdict, headline, confidence and the windows in payload order.

    ``horizon`` has h3_cell, hour_utc, latency_q10/q50/q90, dl_q50, precip_mm_h, basis, lon,
    latency_median and dl_median.
    """
    rows = takeaway_windows(horizon)
    is_cell = F.col("kind") == "cell"
    problem = ~is_cell
    long_enough = (
        F.unix_seconds("end") - F.unix_seconds("start") >= ROUGH_NOTABLE_RUN_H * 3600
    )
    order = F.when(F.col("kind") == "congestion", 0).otherwise(1)
    window = F.struct(
        order.alias("order"),
        F.col("start"),
        F.col("kind"),
        F.col("end"),
        F.col("severity"),
        _detail().alias("detail"),
    )
    # The most severe window, then the earliest, then congestion before rain.
    rank = F.struct(
        (F.col("severity") == "notable").cast("int"), -F.unix_seconds("start"), -order
    )
    of_cell = lambda column: F.max(F.when(is_cell, column))
    full = (F.col("hours") >= BEST_WINDOW_H) & (F.col("latency_hours") == F.col("hours"))
    cells = rows.groupBy("h3_cell").agg(
        of_cell(F.col("basis")).alias("basis"),
        of_cell(F.col("lon")).alias("lon"),
        of_cell(F.col("has_median")).alias("has_median"),
        of_cell(F.col("mean_width")).alias("mean_width"),
        of_cell(F.when(full, F.col("best_start"))).alias("best_start"),
        of_cell(F.when(full, F.col("best_end"))).alias("best_end"),
        F.count_if(problem).alias("problems"),
        F.coalesce(
            F.bool_or(problem & (F.col("severity") == "notable") & long_enough), F.lit(False)
        ).alias("rough"),
        F.max_by(F.when(problem, F.col("start")), F.when(problem, rank)).alias("worst_start"),
        F.array_sort(F.collect_list(F.when(problem, window))).alias("found"),
    )
    level = _choose(F.col("basis"), CONFIDENCE, "low")
    wide = F.coalesce(F.col("mean_width") > WIDE_BAND_RELATIVE, F.lit(False))
    phrase = solar_phrase(F.col("worst_start"), F.col("lon"))
    more = F.when(
        F.col("problems") > 1,
        F.format_string(MORE_WINDOWS, F.col("problems") - 1),
    ).otherwise("")
    best_detail = F.concat(
        F.lit(BEST_DETAIL),
        solar_phrase(F.col("best_start"), F.col("lon")),
    )
    best = F.when(
        F.col("best_start").isNotNull(),
        F.array(
            F.struct(
                F.lit("best").alias("kind"),
                F.col("best_start").alias("start"),
                F.col("best_end").alias("end"),
                F.lit(None).cast("string").alias("severity"),
                best_detail.alias("detail"),
            )
        ),
    )
    listed = F.transform(
        "found",
        lambda w: F.struct(
            w["kind"].alias("kind"),
            w["start"].alias("start"),
            w["end"].alias("end"),
            w["severity"].alias("severity"),
            w["detail"].alias("detail"),
        ),
    )
    verdict = (
        F.when(F.col("problems") == 0, "smooth").when(F.col("rough"), "rough").otherwise("mixed")
    )
    headline = (
        F.when(F.col("problems") == 0, F.lit(SMOOTH_HEADLINE))
        .when(F.col("rough"), F.concat(F.lit(ROUGH_HEADLINE), phrase))
        .otherwise(F.concat(F.lit(MIXED_HEADLINE), phrase, more))
    )
    confidence = (
        F.when(~F.col("has_median"), F.lit("low"))
        .when(wide, _choose(level, LOWER, "low"))
        .otherwise(level)
    )
    return cells.select(
        "h3_cell",
        verdict.alias("verdict"),
        headline.alias("headline"),
        confidence.alias("confidence"),
        F.when(F.col("best_start").isNotNull(), F.concat(listed, best))
        .otherwise(listed)
        .alias("windows"),
    )
