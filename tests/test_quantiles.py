import random

import numpy as np
from pyspark.sql import functions as F

from linkgrid.functions.quantiles import exact_median, exact_quantiles


def test_matches_numpy_on_random_groups(spark):
    rng = random.Random(3)
    rows = []
    for key in ["a", "b", None, "solo", "hot"]:
        size = {"solo": 1, "hot": 20_000}.get(key, rng.randint(2, 60))
        for _ in range(size):
            kind = rng.random()
            value = 0.0 if kind < 0.3 else rng.uniform(-300, 300) if kind < 0.6 else rng.gauss(50, 1)
            rows.append((key, value))
    rows.append(("nothing", None))
    df = spark.createDataFrame(rows, "k string, v double")
    got = {
        r["k"]: r
        for r in exact_quantiles(df, ["k"], "v", {"a": 0.1, "b": 0.5, "c": 0.9, "d": 1.0}).collect()
    }
    assert set(got) == {"a", "b", None, "solo", "hot"}
    for key, row in got.items():
        values = [v for k, v in rows if k == key]
        want = np.quantile(values, [0.1, 0.5, 0.9, 1.0])
        assert np.allclose([row["a"], row["b"], row["c"], row["d"]], want, atol=1e-9)
        assert row["samples"] == len(values)


def test_weights_are_frequencies(spark):
    df = spark.createDataFrame([(1, 10.0, 1.0), (1, 20.0, 4.0), (1, 90.0, 2.0)], "k int, v double, w double")
    row = exact_quantiles(df, ["k"], "v", {"q": 0.5, "hi": 0.9}, weight="w").first()
    plain = [10.0] + [20.0] * 4 + [90.0] * 2
    assert np.allclose([row["q"], row["hi"]], np.quantile(plain, [0.5, 0.9])) and row["samples"] == 7


def test_level_may_depend_on_the_count(spark):
    df = spark.range(10).select(F.col("id").cast("double").alias("v"))
    level = lambda n: F.least(F.lit(1.0), 0.8 * (1 + 1 / n))
    row = exact_quantiles(df, [], "v", {"q": level}).first()
    assert np.isclose(row["q"], np.quantile(np.arange(10.0), 0.88))


def test_even_and_odd_medians(spark):
    df = spark.createDataFrame([("e", 20.0), ("e", 30.0), ("o", 1.0), ("o", 5.0), ("o", 9.0)], "k string, v double")
    got = {r["k"]: (r["median"], r["samples"]) for r in exact_median(df, ["k"], "v").collect()}
    assert got == {"e": (25.0, 2), "o": (5.0, 3)}


def test_heavy_values_are_counted_before_the_shuffle(spark):
    df = spark.createDataFrame([(1, 2.0)] * 10, "k int, v double")
    plan = exact_median(df, ["k"], "v")._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan and "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_narrow_values_are_split_and_nan_is_missing(spark):
    from pyspark.sql import functions as F

    from linkgrid.functions import quantiles

    n = 200_001
    rows = spark.range(n).select(
        F.lit(1).alias("g"), (25 + F.col("id") / F.lit(100.0 * n)).alias("v"))
    parts = rows.withColumn("p", quantiles._part(F.col("v"), F.lit(25.0), F.lit(25.01)))
    assert parts.groupBy("p").count().agg(F.max("count")).first()[0] < 300
    rows = rows.union(spark.sql("SELECT 1, double('NaN')"))
    got = quantiles.exact_quantiles(rows, ["g"], "v", {"a": 0.1, "m": 0.5, "z": 1.0}).first()
    assert got.samples == n
    assert abs(got.m - (25 + (n // 2) / (100.0 * n))) < 1e-12
    assert abs(got.z - (25 + (n - 1) / (100.0 * n))) < 1e-12
