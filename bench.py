"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from linkgrid.checks import inputs, queries  # noqa: E402
from linkgrid.checks.queries import QUERIES  # noqa: E402
from linkgrid.session import build_session  # noqa: E402

HEADLINE = [
    "hourly_latency_median",
    "user_hourly_long",
    "raw_test_rollup",
    "weighted_cell_labels",
    "tile_context",
    "trailing_median_7d",
    "training_matrix",
    "cell_label_stats",
    "latitude_priors",
    "fallback_resolve",
    "map_rollup",
    "history_merge",
    "conformal_offset",
    "persistence_skill",
    "cache_gap",
    "takeaway_verdicts",
    "dish_verdicts",
    "arrival_flood",
    "admitted_arrivals",
    "mart_upsert",
    "boosted_tree",
    "stream_hourly_median",
    "stream_arrivals",
    "sky_view",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.driver.memory": "16g",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="spark-", dir="/tmp"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).groupBy("id").count().write.format("noop").mode("overwrite").save()

    seconds: dict[str, float] = {}
    for name in inputs.MARTS:
        start = time.time()
        inputs.mart(spark, sf_dir, name)
        seconds[f"mart_{name}"] = round(time.time() - start, 3)
    for name in HEADLINE:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    # Fitting and serving apart: a fitted model serves many forecasts.
    start = time.time()
    model = queries.fitted_forests(spark, sf_dir)
    seconds["fit_forests"] = round(time.time() - start, 3)
    start = time.time()
    payload = queries.forecast_of(model, spark, sf_dir)
    payload.write.format("noop").mode("overwrite").save()
    seconds["serve_forecast"] = round(time.time() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
