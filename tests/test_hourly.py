from datetime import date

import pytest
from helpers import at, epoch, hours_of, own_cell
from pyspark.sql import functions as F

from linkgrid import schemas
from linkgrid.functions.geo import polygon_centroid
from linkgrid.functions.units import device_measurements
from linkgrid.operators import hourly, labels, quality


def test_probe_pings(spark):
    probes = spark.createDataFrame(
        [(1, ("Point", [8.0, 52.0])), (2, None), (3, ("Point", None))], schemas.PROBES
    )
    cells = hourly.probe_cells(probes)
    assert [tuple(r) for r in cells.collect()] == [(1, own_cell(52.0, 8.0))]
    t = epoch(at(13.5))
    pings = spark.createDataFrame(
        [(1, t, 20.0), (1, t + 60, 30.0), (1, t, -1.0), (1, t, None), (9, t, 5.0)], schemas.PINGS
    )
    got = hours_of(hourly.probe_hourly(pings, cells), "h3_cell", "hour_utc", "rtt_ms_median", "samples")
    assert got == [(own_cell(52.0, 8.0), epoch(at(13)), 25.0, 2)]


def test_weighted_test_hours(spark):
    lat, lon = 52.0, 8.0
    rows = [
        (at(1), lat, lon, 100.0, 30.0, 3),
        (at(1.5), lat, lon, 200.0, 50.0, 1),
        (at(2), lat, lon, None, 40.0, 2),
        (at(2), lat, lon, 80.0, None, 6),
        (at(3), None, lon, 80.0, 20.0, 6),
        (at(3), lat, lon, 80.0, 20.0, 0),
        (at(4), lat, lon, None, 20.0, 2),
    ]
    df = spark.createDataFrame(
        rows,
        "hour_utc timestamp, lat double, lon double, dl_mbps_median double, min_rtt_median double, samples int",
    )
    cell = own_cell(lat, lon, 4)
    assert hours_of(hourly.test_hourly(df)) == [
        (cell, epoch(at(1)), 125.0, 35.0, 4),
        (cell, epoch(at(2)), 80.0, 40.0, 8),
        (cell, epoch(at(4)), None, 20.0, 2),
    ]


def test_user_hours(spark):
    cell = own_cell(1.0, 2.0)
    rows = [
        (at(5.1), cell, 40.0, 100.0),
        (at(5.2), cell, 50.0, None),
        (at(5.3), cell, None, 120.0),
        (at(6.3), cell, 70.0, None),
    ]
    df = spark.createDataFrame(rows, "ts timestamp, h3_cell bigint, latency_ms double, dl_mbps double")
    assert hours_of(hourly.user_hourly(df)) == sorted(
        [
            (cell, epoch(at(5)), "latency", 45.0, 2),
            (cell, epoch(at(5)), "dl_throughput", 110.0, 2),
            (cell, epoch(at(6)), "latency", 70.0, 1),
        ],
        key=repr,
    )


def test_test_selection_and_days(spark):
    assert hourly.month_days(2024, 2) == (date(2024, 2, 1), date(2024, 2, 29))
    assert hourly.month_days(2024, 2, 3, 5) == (date(2024, 2, 3), date(2024, 2, 5))
    for bad in ((0, 5), (5, 3), (1, 30)):
        with pytest.raises(ValueError):
            hourly.month_days(2024, 2, *bad)
    rows = [(1, date(2024, 2, 3), 1.0), (1, date(2024, 2, 6), 1.0), (2, date(2024, 2, 4), 1.0), (1, date(2024, 2, 4), None)]
    df = spark.createDataFrame(rows, "asn int, date date, lat double")
    assert hourly.select_tests(df, 1, date(2024, 2, 3), date(2024, 2, 5)).count() == 1


def test_point_rollups_agree_on_odd_groups(spark):
    rows = [(at(1, base=at()), 1.0, 2.0, float(v), float(v) / 2) for v in (9, 1, 5)]
    df = spark.createDataFrame(rows, "ts timestamp, lat double, lon double, dl_mbps double, rtt_ms double")
    want = [(epoch(at(1)), 1.0, 2.0, 5.0, 2.5, 3)]
    assert hours_of(hourly.point_rollup(df)) == want
    assert hours_of(hourly.point_rollup(df, exact=True)) == want


def square(lon, lat, h=0.002):
    pts = [(lon - h, lat - h), (lon + h, lat - h), (lon + h, lat + h), (lon - h, lat + h), (lon - h, lat - h)]
    return "POLYGON((" + ", ".join(f"{x} {y}" for x, y in pts) + "))"


def test_centroids(spark):
    texts = [
        square(-150.25, 61.5),
        "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (2 2, 4 2, 4 4, 2 4, 2 2))",
        "POLYGON((1 1, 3 3, 1 1))",
        "POINT(1 2)",
    ]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(polygon_centroid(F.col("t"))).collect()]
    assert got[0]["lon"] == pytest.approx(-150.25, abs=1e-9) and got[0]["lat"] == pytest.approx(61.5, abs=1e-9)
    # A square with its upper right quarter cut out.
    assert got[1]["lon"] == pytest.approx(5 / 3) and got[1]["lat"] == pytest.approx(5 / 3)
    assert got[2]["lon"] == pytest.approx(5 / 3)
    assert got[3] is None or got[3]["lon"] is None


def test_tiles(spark):
    rows = [
        (square(8.0, 52.0), 100_000, 20, 10, 4),
        (square(8.01, 52.01), 200_000, 40, 30, 6),
        (square(-70.0, 40.0), 50_000, 10, 5, 1),
        (square(30.0, 10.0), 50_000, 10, 0, 1),
    ]
    df = spark.createDataFrame(rows, "tile string, avg_d_kbps bigint, avg_lat_ms bigint, tests bigint, devices bigint")
    got = {r["h3_cell"]: tuple(r)[1:] for r in hourly.tile_context(df).collect()}
    assert got[own_cell(52.0, 8.0)] == (40, 10, pytest.approx(175.0, abs=1e-6), pytest.approx(35.0))
    assert got[own_cell(40.0, -70.0)] == (5, 1, pytest.approx(50.0), pytest.approx(10.0))
    assert got[own_cell(10.0, 30.0)] == (0, 1, None, None)


def test_device_rows(spark):
    rows = [
        (0.0, 0.0, None, 1.7, "rev3"),
        (41.5, 120e6, 5e6, 0.123456789, None),
        (None, None, None, None, None),
        (-3.0, 1e6, 1e6, -0.2, None),
    ]
    df = spark.createDataFrame(
        [(at(), *r) for r in rows], schemas.DEVICE_STATUS
    )
    got = [tuple(r)[2:] for r in device_measurements(df).collect()]
    assert got == [
        (None, 0.0, None, 100.0, "rev3"),
        (41.5, 120.0, 5.0, 12.3457, None),
        (None, None, None, None, None),
        (None, 1.0, 1.0, 0.0, None),
    ]


def test_measurement_rules(spark):
    base = ("u", at(), 5, "browser", 1.0, 1.0, 1.0, 50.0, None)
    bad = [
        {"source": "robot"}, {"latency_ms": -0.1}, {"dl_mbps": -1.0}, {"obstruction_pct": 100.5},
        {"ts": None}, {"h3_cell": None}, {"source": None}, {"ul_mbps": float("nan")},
    ]
    names = ["user_id", "ts", "h3_cell", "source", "latency_ms", "dl_mbps", "ul_mbps", "obstruction_pct", "hw_version"]
    rows = [base] + [tuple(b.get(n, v) for n, v in zip(names, base)) for b in bad]
    df = spark.createDataFrame(rows, schemas.MEASUREMENTS)
    errors = [r["errors"] for r in quality.check_measurements(df).collect()]
    assert errors == [[]] + [[next(iter(b))] for b in bad]
    assert quality.valid_measurements(df).count() == 1
    assert quality.rejected_measurements(df).count() == len(bad)
    batches = df.withColumn("batch_id", F.when(F.size(F.lit([1])) > 0, F.col("source")))
    got = {r["batch_id"]: r["accepted"] for r in quality.check_batches(batches).collect()}
    assert got["browser"] is False and got["robot"] is False


def test_gates(spark):
    df = spark.createDataFrame([(1, None), (2, 3.0)], "a int, b double")
    quality.pass_gate(df, ["a"], 2)
    quality.pass_gate(df, ["a", "b"], 2, max_null_rate=0.5)
    with pytest.raises(ValueError, match="rows"):
        quality.pass_gate(df, ["a"], 3)
    with pytest.raises(ValueError, match="nulls in b"):
        quality.pass_gate(df, ["a", "b"], 1)
    assert quality.null_rates(df.limit(0), ["a"]).first()["a_null_rate"] == 0.0


def test_label_union_and_keys(spark):
    probe = spark.createDataFrame([(1, at(), 20.0, 2)], schemas.PROBE_HOURLY)
    test = spark.createDataFrame([(2, at(), None, 30.0, 4), (3, at(), 90.0, None, 1)], schemas.TEST_HOURLY)
    user = spark.createDataFrame([(1, at(), "latency", 25.0, 1), (1, at(), "dl_throughput", 99.0, 1)], schemas.USER_HOURLY)
    rows = labels.assemble_labels(probe, test, user)
    assert rows.count() == 5 and rows.where("source = 'mlab'").count() == 2
    assert labels.latency_labels(rows).count() == 3
    assert labels.label_cell_hours(probe, user).count() == 1
    assert labels.active_cells(probe, test).count() == 3
    fine = spark.createDataFrame([(own_cell(1, 1),), (own_cell(1, 1, 4),), (None,)], "h3_cell bigint")
    assert [r[0] for r in labels.active_map_cells(fine, fine).collect()] == [own_cell(1, 1)]
    with pytest.raises(ValueError):
        labels.active_cells()
