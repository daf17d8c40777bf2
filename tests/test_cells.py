import pytest
from helpers import own_cell
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from linkgrid.functions import cells as C
from linkgrid.operators import centres


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_ids_match_the_plain_rule(spark):
    points = [(lat / 7.0, lon / 3.0) for lat in range(-630, 631, 35) for lon in range(-1100, 1100, 91)]
    df = spark.createDataFrame(points, "lat double, lon double")
    for res in (3, 4, 5):
        got = df.select("lat", "lon", C.cell_of(F.col("lat"), F.col("lon"), res).alias("c")).collect()
        assert all(r["c"] == own_cell(r["lat"], r["lon"], res) for r in got)


def test_poles_clamp_and_longitude_wraps(spark):
    lat, lon = F.lit(90.0), F.lit(540.0)
    assert one(spark, C.cell_of(lat, lon)) == own_cell(90.0, 180.0)
    assert one(spark, C.cell_of(F.lit(None).cast("double"), lon)) is None


def test_parent_is_the_cell_of_the_same_point(spark):
    df = spark.range(500).select(
        (F.rand(1) * 178 - 89).alias("lat"), (F.rand(2) * 358 - 179).alias("lon")
    )
    cell = C.cell_of(F.col("lat"), F.col("lon"))
    wrong = df.where(
        (C.cell_parent(cell, 4) != C.cell_of(F.col("lat"), F.col("lon"), 4))
        | (C.cell_parent(cell, 3) != C.cell_of(F.col("lat"), F.col("lon"), 3))
        | (C.cell_of(C.cell_lat(cell), C.cell_lon(cell)) != cell)
        | (C.cell_resolution(cell) != 5)
    )
    assert wrong.count() == 0


def test_parent_of_coarser_or_equal(spark):
    cell = F.lit(own_cell(10.0, 20.0, 4))
    assert one(spark, C.cell_parent(cell, 4)) == own_cell(10.0, 20.0, 4)
    assert one(spark, C.cell_parent(cell, 5)) is None
    assert len(one(spark, C.ancestors(cell))) == 2


def test_public_h3_ids(spark):
    cell = F.lit(int("851f8d37fffffff", 16))
    assert one(spark, C.cell_resolution(cell)) == 5
    assert one(spark, C.cell_parent(cell, 4)) == int("841f8d3ffffffff", 16)
    assert one(spark, C.cell_lat(cell)) is None and one(spark, C.cell_lon(cell)) is None


def test_centres_of_foreign_ids_come_from_a_table(spark):
    known, unknown = int("851f8d37fffffff", 16), int("851f8d33fffffff", 16)
    own = own_cell(52.0, 8.0)
    rows = spark.createDataFrame(
        [(own, 1), (known, 2), (unknown, 3), (unknown, 4), (None, 5)], "h3_cell bigint, n int")
    table = spark.createDataFrame([(known, 1.5, 2.5)], centres.CENTRES)
    placed = centres.with_centres(rows, table)
    got = {r["n"]: (r["lat"], r["lon"]) for r in placed.collect()}
    assert got[2] == (1.5, 2.5) and got[3] == got[4] == got[5] == (None, None)
    assert abs(got[1][0] - 52.0) < 0.2
    left = {(r["h3_cell"], r["reason"], r["rows"]) for r in centres.unplaced(placed).collect()}
    assert left == {(unknown, "no centre", 2), (None, "no cell", 1)}


@pytest.mark.parametrize(
    "text, value",
    [
        ("851f8d37fffffff", int("851f8d37fffffff", 16)),
        (" 851F8D37FFFFFFF ", int("851f8d37fffffff", 16)),
        ("0x1f", 31),
        ("123", 123),
        ("0", None),
        ("-5", None),
        ("hello", None),
        ("", None),
        ("99999999999999999999", None),
        ("fffffffffffffffff", None),
    ],
)
def test_parse_cell(spark, text, value):
    assert one(spark, C.parse_cell(F.lit(text))) == value


@settings(max_examples=50, deadline=None)
@given(st.floats(-90, 90), st.floats(-720, 720))
def test_plain_rule_is_total(lat, lon):
    assert own_cell(lat, lon) >> 52 == 5
