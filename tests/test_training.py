import json
import math
import os
import random

import pytest
from helpers import at, own_cell
from pyspark.sql import functions as F

from linkgrid import schemas
from linkgrid.operators import forecast, forest
from linkgrid.operators.matrix import FEATURE_COLUMNS
from linkgrid.plans import daily, serving, training
from linkgrid.sources import marts

SMALL = forest.ForestParams(trees=6, depth=4, min_leaf=10)


def matrix_rows(spark, n=1200, targets=("latency", "dl_throughput")):
    rng = random.Random(1)
    rows = []
    for i in range(n):
        hour = rng.randrange(24 * 40)
        sin = math.sin(2 * math.pi * (hour % 24) / 24)
        for target in targets:
            label = 40 + 15 * sin + rng.gauss(0, 3) + (100 if target != "latency" else 0)
            feats = {c: rng.gauss(0, 1) for c in FEATURE_COLUMNS}
            feats.update(hour_sin=sin, source_quality=rng.choice([1.0, 2.0, 4.0]), precip_mm_h=None)
            rows.append((own_cell(rng.randrange(4), 0), at(hour), target, rng.choice(["user", "atlas"]), label,
                         *[feats[c] for c in FEATURE_COLUMNS]))
    fields = ", ".join(f"{c} double" for c in FEATURE_COLUMNS)
    return spark.createDataFrame(
        rows, f"h3_cell bigint, hour_utc timestamp, target string, source string, label double, {fields}"
    )


def test_training_end_to_end(spark, folder):
    rows = matrix_rows(spark)
    report = training.run_training(rows, f"{folder}/models", f"{folder}/evals", params=SMALL, now=at())
    assert report["version"] == "v20260706T000000Z" and set(report["targets"]) == {"latency", "dl_throughput"}
    assert report["n_train"] + report["n_test"] == rows.count()
    for t in report["targets"].values():
        assert 0.6 < t["coverage"] <= 1.0 and t["q50_mae"] < t["persistence_mae"]
        assert t["promote"] == (t["beats_persistence"] and 0.78 <= t["coverage"] <= 0.82)
    saved = json.loads(open(f"{folder}/evals/{report['version']}.json").read())
    assert saved["promoted"] == report["promoted"]
    assert os.path.exists(f"{folder}/models/PROMOTED") == report["promoted"]


def test_model_round_trip_and_bands(spark, folder):
    rows = matrix_rows(spark, 600, ("latency",))
    model = forest.fit_forests(rows, params=SMALL)
    raw = model.predict(rows).agg(
        F.avg("latency_q10").alias("a"), F.avg("latency_q50").alias("b"), F.avg("latency_q90").alias("c"),
        F.count("latency_q50").alias("n"),
    ).first()
    assert raw["a"] < raw["b"] < raw["c"] and raw["n"] == 600
    model.calibration = {"latency": 2.0}
    wide = model.predict(rows).agg(F.avg("latency_q10"), F.avg("latency_q50"), F.avg("latency_q90")).first()
    assert wide[0] == pytest.approx(raw["a"] - 2.0) and wide[1] == pytest.approx(raw["b"])
    assert wide[2] == pytest.approx(raw["c"] + 2.0)
    training.save_model(spark, model, f"{folder}/m/v1")
    marts.write_text(spark, f"{folder}/m/PROMOTED", "v1")
    again = training.load_promoted(spark, f"{folder}/m")
    assert again.calibration == model.calibration and again.trained_targets == ["latency"]
    both = again.predict(rows).agg(F.avg("latency_q10"), F.avg("latency_q50"), F.avg("latency_q90")).first()
    assert tuple(both) == pytest.approx(tuple(wide))
    assert training.load_promoted(spark, f"{folder}/nothing") is None
    plan = again.predict(rows)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_prediction_is_the_mean_of_leaf_quantiles(spark):
    rows = matrix_rows(spark, 300, ("latency",))
    model = forest.fit_forests(rows, params=SMALL)
    from pyspark.ml.functions import vector_to_array

    wide = forest.assemble(rows)
    leaves = model.forests["latency"].setLeafCol("leaf").transform(wide).select(
        vector_to_array("leaf").alias("l")).collect()
    got = model.predict(rows).select("latency_q50").collect()
    table = model.leaves["latency"]["q50"]
    for a, b in list(zip(leaves, got))[:50]:
        hits = [table[t][int(leaf)] for t, leaf in enumerate(a["l"])]
        assert b[0] == pytest.approx(sum(hits) / len(hits))


def test_sketched_leaves_are_close_to_exact_ones(spark):
    rows = matrix_rows(spark, 400, ("latency",))
    exact = forest.fit_forests(rows, params=SMALL).leaves["latency"]
    sketch = forest.fit_forests(
        rows, params=forest.ForestParams(trees=6, depth=4, min_leaf=10, leaf_accuracy=10_000)
    ).leaves["latency"]
    for name in ("q10", "q50", "q90"):
        flat = [(a, b) for t, u in zip(exact[name], sketch[name]) for a, b in zip(t, u)]
        assert len(flat) > 20 and all(abs(a - b) < 6.0 for a, b in flat)
        assert sum(abs(a - b) for a, b in flat) / len(flat) < 0.8


def test_short_history_is_skipped(spark, folder):
    one_hour = matrix_rows(spark, 5).withColumn("hour_utc", F.lit(at()))
    assert "skipped" in training.run_training(one_hour, folder, folder)
    assert "skipped" in training.run_training(one_hour.limit(0), folder, folder)


def test_daily_to_serving(spark, folder):
    """Raw inputs to marts, matrix, model, 48-hour payload, cache and takeaways."""
    root = f"{folder}/marts"
    cell = own_cell(52.0, 8.0)
    probes = spark.createDataFrame([(1, ("Point", [8.0, 52.0]))], schemas.PROBES)
    start = int(at().timestamp())
    pings = spark.range(24 * 12).select(
        F.lit(1).cast("bigint").alias("prb_id"), (F.col("id") * 3600 + start).alias("timestamp"),
        (F.lit(40.0) + F.col("id") % 24).alias("min"))
    daily.ingest_pings(spark, pings, probes, root)
    daily.ingest_pings(spark, pings.where("prb_id = 0"), probes, root)
    users = spark.range(24 * 12).select(
        F.lit("u").alias("user_id"), F.timestamp_seconds(F.col("id") * 3600 + start).alias("ts"), F.lit(cell).alias("h3_cell"),
        F.lit("reporter").alias("source"), F.lit(None).cast("double").alias("latency_ms"),
        (F.lit(90.0) + F.col("id") % 24).alias("dl_mbps"), F.lit(None).cast("double").alias("ul_mbps"),
        F.lit(1.0).alias("obstruction_pct"), F.lit(None).cast("string").alias("hw_version"))
    daily.ingest_users(spark, users, root)
    daily.build_fallback_marts(spark, root)
    precip = spark.createDataFrame([(cell, at(5), 2.0)], "h3_cell bigint, hour_utc timestamp, precip_mm_h double")
    from linkgrid.operators import quality
    from linkgrid.operators.visibility import POSITION_SCHEMA

    nowhere = spark.createDataFrame([], POSITION_SCHEMA)
    daily.build_feature_marts(spark, root, nowhere, precip)
    # A mart that fails the gate leaves the old one.
    before = marts.read_mart(spark, f"{root}/{daily.ACTIVE}", schemas.ACTIVE_CELLS).count()
    with pytest.raises(quality.MartRejected):
        daily.ingest_tiles(spark, spark.createDataFrame(
            [], "quadkey string, tile string, avg_d_kbps long, avg_u_kbps long, avg_lat_ms long, tests long, devices long"), root)
    assert before == marts.read_mart(spark, f"{root}/{daily.ACTIVE}", schemas.ACTIVE_CELLS).count()
    daily.build_active_cells(spark, root, users)
    stats = marts.read_mart(spark, f"{root}/{daily.STATS}", schemas.CELL_STATS)
    assert {r["hours"] for r in stats.collect()} == {168}
    labels, orbital, rain, tiles = training.training_inputs(spark, root)
    assert labels.count() == 2 * 24 * 12 and tiles.count() == 0
    assert orbital.where("sats_visible = 0 and max_elevation_deg is null").count() == 24 * 12
    assert rain.agg(F.sum("precip_lag_1h")).first()[0] == 2.0
    report = training.run_train_job(spark, root, f"{folder}/models", f"{folder}/evals", SMALL)
    assert set(report["targets"]) == {"latency", "dl_throughput"}

    from linkgrid.operators.fallback import resolve_medians

    model = forest.fit_forests(training.training_matrix(labels, orbital, rain, tiles), params=SMALL)
    cells = marts.read_mart(spark, f"{root}/{daily.ACTIVE}", schemas.ACTIVE_CELLS)
    priors = marts.read_mart(spark, f"{root}/{daily.PRIORS}", schemas.LATITUDE_PRIORS)
    medians = resolve_medians(cells, stats, priors)
    assert medians.first()["basis"] == "cell"
    now = at(24 * 12)
    args = (precip, orbital, tiles, medians)
    payload = serving.forecast_cells(model, cells, now, *args)
    assert payload.count() == 48 and payload.where("latency is null or dl is null").count() == 0

    from linkgrid.operators.bandcache import payload_bands

    cache = payload_bands(payload.limit(20), "v9").withColumn("q50", F.lit(-1.0))
    mixed = serving.forecast_cells(model, cells, now, *args, cache=cache, version="v9")
    assert mixed.count() == 48 and mixed.where("latency.q50 = -1 and dl.q50 = -1").count() == 20
    # Served through the stored cache: written back once, then read without a model.
    stored = f"{folder}/bands"
    first = serving.serve_cells(model, cells, now, *args, cache=stored, version="v9")
    assert first.count() == 48
    mine = lambda df: {(r["s"], r["latency"]["q50"], r["dl"]["q50"]) for r in df.withColumn(
        "s", F.unix_seconds("hour_utc")).collect()}
    assert mine(first) == mine(payload)
    again = serving.serve_cells(None, cells, now, *args, cache=stored, version="v9")
    assert mine(again) == mine(payload)
    out = serving.cell_takeaways(payload, medians).first()
    assert out["verdict"] in ("smooth", "mixed", "rough") and out["windows"][-1]["kind"] == "best"
    verdict = serving.score_dishes(model, users.withColumn("measurement_id", F.xxhash64("ts")), orbital, tiles, medians).first()
    assert verdict["n_evaluated"] == 50 and verdict["basis"] == "cell"


def test_untrained_target_is_null(spark):
    rows = spark.createDataFrame([(1, at(), "cell", 0.0, 1.0, 2.0, 3.0)],
                                 "h3_cell bigint, hour_utc timestamp, basis string, precip_mm_h double, latency_q10 double, latency_q50 double, latency_q90 double")
    row = forecast.assemble_payload(rows).first()
    assert row["dl"] is None and row["latency"]["q50"] == 2.0 and row["weather"]["precip_mm_h"] == 0.0
