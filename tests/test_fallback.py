import pytest
from helpers import at, epoch, hours_of, own_cell
from pyspark.sql import functions as F

from linkgrid import schemas
from linkgrid.operators import fallback, forecast, history

CELL = own_cell(52.0, 8.0)


def latency(spark, rows):
    return spark.createDataFrame(rows, "h3_cell bigint, hour_utc timestamp, value double")


def test_stats_roll_up_and_forget(spark):
    rows = [(CELL, at(h), 30.0 + h) for h in range(10)]
    rows += [(CELL, at(days=-30), 999.0)]
    coarse = own_cell(-20.0, 100.0, 4)
    rows += [(coarse, at(1), 70.0)]
    got = {r["h3_cell"]: (r["median"], r["hours"]) for r in fallback.cell_label_stats(latency(spark, rows)).collect()}
    assert got == {
        CELL: (34.5, 10),
        own_cell(52.0, 8.0, 4): (34.5, 10),
        own_cell(52.0, 8.0, 3): (34.5, 10),
        coarse: (70.0, 1),
        own_cell(-20.0, 100.0, 3): (70.0, 1),
    }


def test_window_is_open_at_its_old_end(spark):
    rows = [(CELL, at(days=7), 10.0), (CELL, at(), 99.0), (CELL, at(1), 20.0)]
    row = fallback.cell_label_stats(latency(spark, rows)).where(F.col("h3_cell") == CELL).first()
    assert (row["median"], row["hours"]) == (15.0, 2)


def test_priors_use_all_history(spark):
    rows = [(CELL, at(days=-400), 10.0), (CELL, at(), 30.0), (own_cell(-33.0, 8.0), at(), 5.0)]
    got = sorted(tuple(r) for r in fallback.latitude_priors(latency(spark, rows)).collect())
    assert got == [(-4, 5.0), (5, 20.0)]


@pytest.mark.parametrize(
    "stats, expected",
    [
        ([(5, 40.0, 200), (4, 50.0, 300)], (40.0, "cell")),
        ([(5, 40.0, 10), (4, 50.0, 300)], (50.0, "region")),
        ([(5, 40.0, 10), (4, 50.0, 100), (3, 60.0, 168)], (60.0, "region")),
        ([(5, 40.0, 167)], (77.0, "latitude_prior")),
        ([], (77.0, "latitude_prior")),
    ],
)
def test_resolution_order(spark, stats, expected):
    rows = [(own_cell(52.0, 8.0, res), median, hours) for res, median, hours in stats]
    table = spark.createDataFrame(rows, schemas.CELL_STATS)
    priors = spark.createDataFrame([(5, 77.0), (0, 1.0)], schemas.LATITUDE_PRIORS)
    cells = spark.createDataFrame([(CELL,)], "h3_cell bigint")
    row = fallback.resolve_medians(cells, table, priors).first()
    assert (row["cell_median"], row["basis"]) == expected


def test_no_band_leaves_null(spark):
    cells = spark.createDataFrame([(CELL, "x"), (CELL, "y")], "h3_cell bigint, tag string")
    rows = fallback.resolve_medians(
        cells, spark.createDataFrame([], schemas.CELL_STATS), spark.createDataFrame([], schemas.LATITUDE_PRIORS)
    ).collect()
    assert len(rows) == 2
    assert all((r["cell_median"], r["basis"]) == (None, "latitude_prior") for r in rows)


def test_history_merge(spark):
    old = spark.createDataFrame(
        [(1, at(days=-120), 9.0, 1), (1, at(0), 20.0, 1), (1, at(1), 21.0, 1)], schemas.PROBE_HOURLY
    )
    new = spark.createDataFrame([(1, at(1), 30.0, 5), (2, at(2), 40.0, 1)], schemas.PROBE_HOURLY)
    assert hours_of(history.merge_hourly(old, new)) == [
        (1, epoch(at(0)), 20.0, 1), (1, epoch(at(1)), 30.0, 5), (2, epoch(at(2)), 40.0, 1),
    ]
    none = spark.createDataFrame([], schemas.PROBE_HOURLY)
    assert history.merge_hourly(none, none).count() == 0


def test_retention_is_strict(spark):
    rows = spark.createDataFrame([(1, at(), 1.0, 1), (1, at(days=90), 2.0, 1)], schemas.PROBE_HOURLY)
    none = spark.createDataFrame([], schemas.PROBE_HOURLY)
    assert [r["rtt_ms_median"] for r in history.merge_hourly(none, rows).collect()] == [2.0]


def test_map_rollup(spark):
    pair = [own_cell(52.0, 8.0), own_cell(51.8, 8.0), own_cell(-10.0, 8.0)]
    rows = [(pair[0], "latitude_prior", 10.0), (pair[1], "cell", 30.0), (pair[2], "region", 5.0)]
    df = spark.createDataFrame(rows, "h3_cell bigint, basis string, v double").select(
        "h3_cell", "basis", F.struct(F.col("v").alias("q10"), F.col("v").alias("q50"), F.col("v").alias("q90")).alias("dl")
    )
    got = {r["cell"]: (r["value"], r["basis"], r["n"]) for r in forecast.map_rollup(df, "dl_q50", 3).collect()}
    assert got == {own_cell(52.0, 8.0, 3): (20.0, "cell", 2), own_cell(-10.0, 8.0, 3): (5.0, "region", 1)}
    assert forecast.map_rollup(df, "dl_q50", 5).count() == 3
    for bad in ("dl_q55", "q50", "up_q50", "dl"):
        with pytest.raises(ValueError):
            forecast.map_rollup(df, bad, 4)
