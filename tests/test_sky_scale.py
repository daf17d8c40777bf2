"""Positions are spread before they multiply, and only those that can meet a pair are shuffled."""

from helpers import at, own_cell
from pyspark.sql import functions as F

from linkgrid.checks import inputs as I
from linkgrid.operators import visibility as V


def test_suppliers_are_dealt_out_before_their_hours(spark, folder):
    spark.range(1, 41).withColumnRenamed("id", "s_suppkey").coalesce(1).write.parquet(
        f"{folder}/supplier.parquet")
    rows = I.positions(spark, folder)
    used = rows.groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in used) == 40 * 720
    assert len(used) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_only_asked_tiles_and_hours_are_kept(spark):
    here, there = own_cell(3.0, 3.0), own_cell(3.0, 103.0)
    placed = spark.createDataFrame(
        [(here, at(1), 0, 18), (here, at(3), 0, 18), (there, at(2), 0, 28), (7, at(0), None, None)],
        "h3_cell bigint, hour_utc timestamp, tile_lat int, tile_lon int")
    reaching = spark.createDataFrame(
        [(at(h), la, lo, 1.0) for h in range(5) for la in (-1, 0) for lo in (18, 28, 30)],
        "hour_utc timestamp, tile_lat int, tile_lon int, x double")
    kept = {(r["hour_utc"].hour, r["tile_lat"], r["tile_lon"])
            for r in V.in_asked_tiles(reaching, placed).collect()}
    first = at(0).hour
    assert kept == {(first + 1, 0, 18), (first + 2, 0, 18), (first + 3, 0, 18), (first + 2, 0, 28)}


def test_positions_elsewhere_are_not_shuffled(spark, folder):
    """The join's exchange of positions stands above the filter by asked tiles."""
    spark.range(1, 41).withColumnRenamed("id", "s_suppkey").write.parquet(f"{folder}/supplier.parquet")
    pairs = spark.createDataFrame([(own_cell(3.0, 3.0), at(0, base=I.NOW))], "h3_cell bigint, hour_utc timestamp")
    view = V.sky_view(I.positions(spark, folder), pairs)
    plan = view._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [tile_lat" in plan
    assert view.count() == 1
