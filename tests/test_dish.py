import math
import random

import pytest
from helpers import at
from pyspark.sql import functions as F

from linkgrid.functions.stats import binomial_tail
from linkgrid.operators import dish, floods

COLUMNS = "user_id string, measurement_id bigint, h3_cell bigint, ts timestamp, dl_mbps double, obstruction_pct double"


def test_binomial_tail(spark):
    pairs = [(k, n) for n in (1, 3, 20, 50) for k in range(0, n + 2)]
    df = spark.createDataFrame(pairs, "k bigint, n bigint")
    for p in (0.1, 0.5):
        got = df.select("k", "n", binomial_tail(F.col("k"), F.col("n"), p).alias("t")).collect()
        for r in got:
            exact = sum(math.comb(r["n"], i) * p**i * (1 - p) ** (r["n"] - i) for i in range(r["k"], r["n"] + 1))
            assert r["t"] == pytest.approx(exact, abs=1e-12)


def user(name, n, values, hours, obstruction=None):
    return [
        (name, i, 1, at(hours[i % len(hours)], days=-i), values[i % len(values)], obstruction)
        for i in range(n)
    ]


def verdicts(spark, rows, **kw):
    df = spark.createDataFrame(rows, COLUMNS)
    df = df.withColumn("measurement_id", F.xxhash64("user_id", "measurement_id"))
    recent = dish.recent_downloads(df)
    bands = recent.select("measurement_id", F.lit(50.0).alias("q10"), F.lit(100.0).alias("q50"))
    medians = spark.createDataFrame([(1, "region")], "h3_cell bigint, basis string")
    return {r["user_id"]: r for r in dish.dish_verdicts(recent, bands, medians, **kw).collect()}


def test_verdicts(spark):
    rows = (
        user("few", 19, [10.0], [1, 5, 9])
        + user("healthy", 30, [90.0, 110.0], [1, 5, 9], 2.0)
        + user("slow", 30, [40.0], [1, 5, 9], 12.0)
        + user("one_hour", 30, [40.0], [20])
        + user("edge", 40, [50.0], [1, 5, 9])
        + user("long", 80, [40.0], [1, 5, 9])
    )
    rows += [("none", 0, 1, at(), None, 5.0)]
    users = spark.createDataFrame([(u,) for u in ("few", "slow", "none", "ghost")], "user_id string")
    got = verdicts(spark, rows)
    assert got["few"]["verdict"] == "insufficient_data" and got["few"]["p_value"] is None
    assert got["few"]["below_q10_count"] == 0
    assert got["healthy"]["verdict"] == "healthy" and got["healthy"]["p_value"] == 1.0
    assert got["healthy"]["effect_size_pct"] is None
    slow = got["slow"]
    assert slow["verdict"] == "underperforming" and slow["effect_size_pct"] == pytest.approx(60.0)
    assert slow["distinct_hours_below"] == 3 and slow["median_obstruction_pct"] == 12.0
    assert slow["basis"] == "region"
    assert got["one_hour"]["verdict"] == "healthy" and got["one_hour"]["distinct_hours_below"] == 1
    assert got["edge"]["below_q10_count"] == 0
    assert got["long"]["n_evaluated"] == 50
    listed = verdicts(spark, rows, users=users)
    assert set(listed) == {"few", "slow", "none", "ghost"}
    assert listed["ghost"]["verdict"] == "insufficient_data" and listed["ghost"]["basis"] == "latitude_prior"


def test_top_n_is_limited_before_the_shuffle(spark):
    df = spark.createDataFrame(user("u", 80, [1.0], [1]), COLUMNS)
    plan = dish.recent_downloads(df)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_modal_cell_ties_go_to_the_newest(spark):
    rows = [("u", 1, 7, at(1), 1.0, None), ("u", 2, 8, at(2), 1.0, None), ("v", 3, 7, at(1), 1.0, None),
            ("v", 4, 7, at(0), 1.0, None), ("v", 5, 8, at(9), 1.0, None)]
    got = {r["user_id"]: r["h3_cell"] for r in dish.modal_cells(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert got == {"u": 8, "v": 7}


def test_trailing_arrivals_against_brute_force(spark):
    rng = random.Random(7)
    rows = [(rng.choice(["hot", "hot", "b"]), at(rng.randrange(0, 40_000) / 3600)) for _ in range(1500)]
    df = spark.createDataFrame(rows, "k string, ts timestamp")
    out = floods.trailing_arrivals(df, "k", "ts", 600, 5)
    got = {(r["k"], r["t"]): (r["arrivals"], r["in_window"], r["over_cap"])
           for r in out.select("k", F.unix_seconds("ts").alias("t"), "arrivals", "in_window", "over_cap").collect()}
    assert len(got) == len({(k, t) for k, t in rows})
    for (k, t), (n, total, over) in got.items():
        times = [int(x.timestamp()) for key, x in rows if key == k]
        want = sum(t - 600 < x <= t for x in times)
        assert total == want and n == times.count(t) and over == (want > 5)
