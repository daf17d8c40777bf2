"""Tiles of the known sites are constants of the plan; all others are still put together by row."""

from pyspark.sql import functions as F

from linkgrid.checks import inputs as I


def test_tile_texts_are_folded_and_the_same(spark, folder):
    keys = spark.range(-30, 40).select(F.col("id").alias("l_suppkey")).union(
        spark.range(1).select(F.lit(None).cast("bigint")))
    keys.select(
        "l_suppkey", F.lit(1.0).alias("l_extendedprice"), F.lit(2).alias("l_linenumber"),
        F.lit(3.0).alias("l_quantity")).coalesce(1).write.parquet(f"{folder}/lineitem.parquet")
    texts = I.tiles(spark, folder).select("tile")
    plan = texts._jdf.queryExecution().optimizedPlan().toString()
    assert "[POLYGON((-150.001 -50.001" in plan
    wanted = keys.select(I.tile_of(I.site_of(F.col("l_suppkey"))).alias("tile"))
    assert texts.exceptAll(wanted).isEmpty() and wanted.exceptAll(texts).isEmpty()
