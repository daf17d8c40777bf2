import random
import statistics

import numpy as np
import pytest
from helpers import at, epoch, hours_of, own_cell
from pyspark.sql import functions as F

from linkgrid import schemas
from linkgrid.operators import matrix, metrics, split, weather

CELL = own_cell(52.0, 8.0)


def label_rows(spark, rows):
    return spark.createDataFrame(rows, schemas.LABELS)


def test_matrix_joins_and_trailing_median(spark):
    labels = label_rows(
        spark,
        [
            (CELL, at(), "latency", 30.0, "atlas", 1),
            (CELL, at(days=1), "latency", 40.0, "user", 1),
            (CELL, at(days=2), "latency", 50.0, "other", 1),
            (CELL, at(), "dl_throughput", 99.0, "mlab", 1),
        ],
    )
    orbital = spark.createDataFrame([(CELL, at(), 7, 61.0)], schemas.ORBITAL_FEATURES)
    rain = spark.createDataFrame([(CELL, at(), 0.5, 0.1, 2.0)], schemas.WEATHER_FEATURES)
    tiles = spark.createDataFrame([(CELL, 10, 4, 180.0, 20.0)], schemas.TILE_CONTEXT)
    rows = matrix.training_matrix(labels, orbital, rain, tiles)
    assert rows.columns[5:] == matrix.FEATURE_COLUMNS
    got = {(r["target"], r["hour_utc"].day): r for r in rows.collect()}
    monday = got[("latency", at().day)]
    assert monday["cell_median_7d"] is None and monday["sats_visible"] == 7.0
    assert monday["precip_forecast_3h"] == 2.0 and monday["source_quality"] == 2.0
    wednesday = got[("latency", at(days=2).day)]
    assert wednesday["cell_median_7d"] == 35.0 and wednesday["precip_mm_h"] is None
    assert wednesday["terrestrial_baseline_mbps"] == 180.0 and wednesday["source_quality"] == 1.0
    assert wednesday["day_of_week"] == 2.0
    assert got[("dl_throughput", at().day)]["cell_median_7d"] is None


def test_trailing_window_ends_are_included(spark):
    rows = [(CELL, at(days=-7), 10.0), (CELL, at(days=-7, hours=-1), 500.0), (CELL, at(-1), 20.0), (CELL, at(), 900.0)]
    labels = label_rows(spark, [(c, t, "latency", v, "atlas", 1) for c, t, v in rows])
    last = matrix.trailing_median(labels).where(F.col("value") == 900.0).first()
    assert last["cell_median_7d"] == 15.0


def test_trailing_median_random(spark):
    rng = random.Random(5)
    rows = [
        (rng.choice([1, 2]), at(rng.randrange(400)), rng.choice(["latency", "dl_throughput"]), rng.uniform(0, 9), "user", 1)
        for _ in range(600)
    ]
    got = matrix.trailing_median(label_rows(spark, rows)).collect()
    for r in got:
        when = r["hour_utc"].timestamp()
        past = [
            v for c, t, target, v, _, _ in rows
            if c == r["h3_cell"] and target == r["target"]
            and -604800 <= t.timestamp() - epoch_local(r["hour_utc"]) <= -3600
        ]
        want = statistics.median(past) if past else None
        assert r["cell_median_7d"] == (pytest.approx(want) if want is not None else None), when


def epoch_local(naive):
    """Collected timestamps are naive local times."""
    return naive.astimezone().timestamp()


def test_precip_offsets(spark):
    series = spark.createDataFrame(
        [(CELL, at(11), 1.0), (CELL, at(12), 0.0), (CELL, at(15), 4.0)],
        "h3_cell bigint, hour_utc timestamp, precip_mm_h double",
    )
    pairs = spark.createDataFrame([(CELL, at(12)), (CELL, at(20)), (7, at(12))], "h3_cell bigint, hour_utc timestamp")
    assert hours_of(weather.precip_features(pairs, series)) == sorted(
        [(CELL, epoch(at(12)), 0.0, 1.0, 4.0), (CELL, epoch(at(20)), 0.0, 0.0, 0.0), (7, epoch(at(12)), 0.0, 0.0, 0.0)],
        key=repr,
    )
    spans = weather.label_spans(pairs).where(F.col("h3_cell") == CELL).first()
    assert (str(spans["start_date"]), str(spans["end_date"])) == ("2026-07-05", "2026-07-07")


@pytest.mark.parametrize("n, index", [(2, 1), (3, 2), (4, 3), (6, 4), (10, 8), (14, 10), (1, None)])
def test_cutoffs(spark, n, index):
    rows = [(CELL, at(h), "latency", 1.0, None, 1) for h in range(n) for _ in (0, 1)]
    row = split.split_cutoffs(label_rows(spark, rows)).select(F.unix_seconds("cutoff"), "distinct_hours").first()
    assert row[0] == (None if index is None else epoch(at(index))) and row[1] == n


def test_split_is_by_group(spark):
    rows = [(CELL, at(h), "latency", 1.0, "atlas", 1) for h in range(8)]
    rows += [(CELL, at(h + 500), "latency", 1.0, None, 1) for h in range(4)]
    rows += [(CELL, at(3), "dl_throughput", 1.0, "mlab", 1)]
    got = {
        (r["target"], r["source"]): (r["train"], r["test"])
        for r in split.stratified_split(label_rows(spark, rows)).groupBy("target", "source").agg(
            F.count_if(~F.col("is_test")).alias("train"), F.count_if("is_test").alias("test")
        ).collect()
    }
    assert got == {("latency", "atlas"): (6, 2), ("latency", None): (3, 1), ("dl_throughput", "mlab"): (1, 0)}


def test_global_split(spark):
    rows = label_rows(spark, [(CELL, at(days=d), "latency", 1.0, "atlas", 1) for d in range(10)])
    parts = split.time_split(rows, at(days=5)).groupBy("is_test").count().collect()
    assert {r["is_test"]: r["count"] for r in parts} == {False: 5, True: 5}


def conformal_reference(y, lo, hi, cover=0.8):
    scores = np.maximum(lo - y, y - hi)
    return float(np.quantile(scores, min(1.0, cover * (1 + 1 / len(y)))))


def test_conformal_offset_random(spark):
    rng = np.random.default_rng(2)
    rows = []
    for target, n, spread in (("a", 3, 1.0), ("b", 501, 3.0), ("c", 1, 1.0), ("d", 40, 0.1)):
        y = rng.normal(50, 10, n)
        rows += [(target, float(v), float(50 - 8 * spread), float(50 + 8 * spread)) for v in y]
    df = spark.createDataFrame(rows, "target string, label double, q10 double, q90 double")
    for r in metrics.conformal_offsets(df).collect():
        part = np.array([x[1:] for x in rows if x[0] == r["target"]])
        assert r["conformal_offset"] == pytest.approx(conformal_reference(*part.T))
        widened = (part[:, 0] >= part[:, 1] - r["conformal_offset"] - 1e-9) & (
            part[:, 0] <= part[:, 2] + r["conformal_offset"] + 1e-9
        )
        assert widened.mean() >= 0.8


def scored(spark, rows):
    return spark.createDataFrame(
        rows, "target string, label double, q10 double, q50 double, q90 double, persistence double"
    )


def test_gate(spark):
    good = [("latency", 10.0, 5.0, 10.0, 15.0, 20.0)] * 4 + [("latency", 30.0, 5.0, 29.0, 15.0, 40.0)]
    row = metrics.band_report(scored(spark, good)).first()
    assert row["coverage"] == 0.8 and row["promote"] and row["persistence_mae"] == 10.0
    assert metrics.promotion(metrics.band_report(scored(spark, good))).first()["promoted"]
    over = [("latency", 10.0, 5.0, 10.0, 15.0, 20.0)]
    assert not metrics.band_report(scored(spark, over)).first()["promote"]
    unfair = [(*r[:5], None) for r in good]
    row = metrics.band_report(scored(spark, unfair)).first()
    assert row["q50_mae"] is None and not row["beats_persistence"] and row["calibrated"]
    tie = [(*r[:3], r[1] + 10.0, r[4], r[1] - 10.0) for r in good]
    assert not metrics.band_report(scored(spark, tie)).first()["beats_persistence"]
    both = good + [("dl_throughput", *r[1:]) for r in over]
    assert not metrics.promotion(metrics.band_report(scored(spark, both))).first()["promoted"]
    assert not metrics.promotion(metrics.band_report(scored(spark, []))).first()["promoted"]


def test_persistence_prefers_the_better_source(spark):
    rows = label_rows(
        spark,
        [
            (CELL, at(), "latency", 1.0, "mlab", 1),
            (CELL, at(), "latency", 2.0, "user", 1),
            (CELL, at(days=7), "latency", 3.0, "atlas", 1),
        ],
    ).withColumnRenamed("value", "label")
    past = metrics.persistence_history(rows)
    assert past.count() == 2
    got = {r["label"]: r["persistence"] for r in metrics.with_persistence(rows, past).collect()}
    assert got == {1.0: None, 2.0: None, 3.0: 2.0}
