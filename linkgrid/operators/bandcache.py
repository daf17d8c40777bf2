"""The forecast band table: upsert, gap detection and reads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkgrid.functions.units import PAYLOAD_TARGETS
from linkgrid.operators.history import keep_best
from linkgrid.schemas import BAND_CACHE
from linkgrid.sources import versions
from linkgrid.sources.marts import upsert_mart

KEYS = ("h3_cell", "hour_utc", "metric")
_BAND = ("q10", "q50", "q90")


def payload_bands(payload: DataFrame, model_version: str) -> DataFrame:
    """Payload rows (struct per target) to one row per metric; NULL bands write nothing."""
    metrics = F.array(
        *[F.struct(F.lit(t).alias("metric"), F.col(t).alias("band")) for t in PAYLOAD_TARGETS]
    )
    return (
        payload.select("h3_cell", "hour_utc", "basis", F.explode(metrics).alias("m"))
        .where(F.col("m.band").isNotNull())
        .select(
            "h3_cell",
            "hour_utc",
            "m.metric",
            *[F.col(f"m.band.{b}").alias(b) for b in _BAND],
            "basis",
            F.lit(model_version).alias("model_version"),
        )
    )


def upsert_bands(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """The cache with fresh rows winning their (cell, hour, metric)."""
    both = cache.withColumn("__new", F.lit(0)).unionByName(fresh.withColumn("__new", F.lit(1)))
    order = [F.desc("__new"), F.desc("model_version"), F.desc("q50")]
    return keep_best(both, KEYS, order).drop("__new")


def store_bands(fresh: DataFrame, path: str, keep_days: int | None = None) -> None:
    """Fresh bands into the stored cache: they win their (cell, hour, metric).

    Only the days they touch are read and written; one commit, whoever reads meanwhile.
    """
    order = [F.desc("model_version"), F.desc("q50")]
    upsert_mart(fresh, path, KEYS, order, keep_days=keep_days, schema=BAND_CACHE)


def stored_bands(spark: SparkSession, path: str, days: Sequence[str] | None = None) -> DataFrame:
    """The stored cache; with ``days`` (ISO dates) no folder of another day is listed or read."""
    return versions.read(spark, path, BAND_CACHE, days=days)


def cached_payload(cache: DataFrame, wanted: DataFrame, model_version: str) -> DataFrame:
    """Cached entries for the wanted (cell, hour) pairs under one version, a struct per metric.

    A metric without a row is NULL, a pair without any row is absent.
    """
    band = F.struct(*_BAND)
    rows = cache.where(F.col("model_version") == model_version).join(
        wanted.select("h3_cell", "hour_utc"), ["h3_cell", "hour_utc"], "left_semi"
    )
    return rows.groupBy("h3_cell", "hour_utc").agg(
        F.max("basis").alias("basis"),
        *[F.max(F.when(F.col("metric") == t, band)).alias(t) for t in PAYLOAD_TARGETS],
    )


def missing_pairs(cache: DataFrame, wanted: DataFrame, model_version: str) -> DataFrame:
    """The wanted (cell, hour) pairs that still have to be computed."""
    present = cache.where(F.col("model_version") == model_version).select("h3_cell", "hour_utc")
    return wanted.join(present, ["h3_cell", "hour_utc"], "left_anti")
