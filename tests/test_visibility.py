import math
import random

import numpy as np
import pytest
from helpers import at, own_cell
from pyspark.sql import functions as F

from linkgrid.operators import visibility as V

def fix(lat, lon, alt):
    """A point straight above a place (geodetic), in km."""
    e2 = V.WGS84_F * (2 - V.WGS84_F)
    la, lo = math.radians(lat), math.radians(lon)
    n = V.WGS84_A / math.sqrt(1 - e2 * math.sin(la) ** 2)
    return (
        (n + alt) * math.cos(la) * math.cos(lo),
        (n + alt) * math.cos(la) * math.sin(lo),
        (n * (1 - e2) + alt) * math.sin(la),
    )


def brute(lat, lon, sats, mask):
    o = np.array(fix(lat, lon, 0.0))
    la, lo = math.radians(lat), math.radians(lon)
    up = np.array([math.cos(la) * math.cos(lo), math.cos(la) * math.sin(lo), math.sin(la)])
    looks = []
    for s in sats:
        d = np.array(s) - o
        r = np.linalg.norm(d)
        looks.append((math.degrees(math.asin(np.clip(d @ up / r, -1, 1))), r))
    seen = [x for x in looks if x[0] >= mask]
    if not seen:
        return 0, None, None
    return len(seen), max(e for e, _ in seen), min(r for _, r in seen)


@pytest.mark.parametrize("mask", [25.0, 5.0])
def test_tiled_join_equals_brute_force(spark, mask):
    """Random satellites, with cells at the poles and both sides of the date line."""
    rng = random.Random(9)
    places = [(89.9, 10.0), (-89.9, -100.0), (0.0, 179.95), (0.0, -179.95), (60.0, -179.9), (-45.0, 0.1)]
    places += [(rng.uniform(-89, 89), rng.uniform(-180, 180)) for _ in range(40)]
    cells = sorted({own_cell(*p) for p in places})
    hours = [at(0), at(1)]
    sats = {h: [fix(math.degrees(math.asin(rng.uniform(-1, 1))), rng.uniform(-180, 180),
                    rng.choice([340.0, 550.0, 1200.0])) for _ in range(250)] for h in hours}
    table = spark.createDataFrame(
        [(i, h, *p) for h in hours for i, p in enumerate(sats[h])], V.POSITION_SCHEMA
    )
    pairs = spark.createDataFrame([(c, h) for c in cells for h in hours], "h3_cell bigint, hour_utc timestamp")
    view = V.sky_view(table, pairs, mask)
    got = {(r["h3_cell"], r["s"]): r for r in view.withColumn("s", F.unix_seconds("hour_utc")).collect()}
    assert len(got) == len(cells) * 2
    step = 180.0 / 1024
    for (cell, s), r in got.items():
        lat = -90 + (((cell >> 26) & 0x3FFFFFF) + 0.5) * step
        lon = -180 + ((cell & 0x3FFFFFF) + 0.5) * step
        hour = hours[0] if s == int(hours[0].timestamp()) else hours[1]
        n, el, rng_km = brute(lat, lon, sats[hour], mask)
        assert r["sats_visible"] == n
        if n:
            assert r["max_elevation_deg"] == pytest.approx(el) and r["min_range_km"] == pytest.approx(rng_km)
        else:
            assert r["max_elevation_deg"] is None and r["min_range_km"] is None


def test_overhead_object_and_plan(spark):
    cell = own_cell(40.0, -75.0)
    lat = -90 + (((cell >> 26) & 0x3FFFFFF) + 0.5) * 180 / 1024
    lon = -180 + ((cell & 0x3FFFFFF) + 0.5) * 180 / 1024
    sats = spark.createDataFrame([(1, at(), *fix(lat, lon, 550.0))], V.POSITION_SCHEMA)
    pairs = spark.createDataFrame([(cell, at())], "h3_cell bigint, hour_utc timestamp")
    view = V.sky_view(sats, pairs)
    row = view.first()
    assert row["sats_visible"] == 1 and row["max_elevation_deg"] > 89.9
    assert row["min_range_km"] == pytest.approx(550.0, abs=0.01)
    plan = view._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_features_of_pairs_without_positions(spark):
    pairs = spark.createDataFrame([(1, at(0)), (2, at(0)), (1, at(5))], "h3_cell bigint, hour_utc timestamp")
    features = V.orbital_features(spark.createDataFrame([], V.POSITION_SCHEMA), pairs)
    assert [r["sats_visible"] for r in features.collect()] == [0, 0, 0]
