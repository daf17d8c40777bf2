"""Daily batch: raw inputs to marts, and the marts derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkgrid import schemas
from linkgrid.operators import fallback, hourly, labels, quality, visibility, weather
from linkgrid.plans.training import ORBITAL, PROBE, TEST, TILES, USER, WEATHER
from linkgrid.sources.marts import read_mart, upsert_mart, write_mart
from linkgrid.sources.versions import Gate

#: A mart of fewer rows does not replace the one before it.
MIN_ROWS = 1
STATS, PRIORS, ACTIVE = "cell_label_stats", "latitude_priors", "active_cells"


def _replace(df: DataFrame, path: str, required: tuple[str, ...], schema: str,
             sort: tuple[str, ...] = ("h3_cell", "hour_utc")) -> None:
    """Write a mart once; its gate counts while it is written and decides on the commit."""
    write_mart(df, path, sort, schema, Gate(MIN_ROWS, required))


def _upsert(new: DataFrame, path: str, required: tuple[str, ...], schema: str, keep_days: int,
            keys: tuple[str, ...] = ("h3_cell", "hour_utc")) -> None:
    """A pull into an hourly mart: only the days it touches are read and written."""
    upsert_mart(new, path, keys, [F.desc("samples")], keep_days=keep_days,
                gate=Gate(MIN_ROWS, required), schema=schema)


def ingest_pings(spark: SparkSession, pings: DataFrame, probes: DataFrame, marts: str,
                 keep_days: int = 90) -> None:
    """A day's pings into the hourly probe mart, with history kept and trimmed."""
    new = hourly.probe_hourly(pings, hourly.probe_cells(probes))
    _upsert(new, f"{marts}/{PROBE}", ("h3_cell", "hour_utc", "rtt_ms_median"),
            schemas.PROBE_HOURLY, keep_days)


def ingest_tests(spark: SparkSession, points: DataFrame, marts: str,
                 keep_days: int = 90) -> None:
    """Speed tests of any days into their mart; other days stay."""
    _upsert(hourly.test_hourly(points), f"{marts}/{TEST}", ("h3_cell", "hour_utc"),
            schemas.TEST_HOURLY, keep_days)


def ingest_users(spark: SparkSession, measurements: DataFrame, marts: str,
                 keep_days: int = 90) -> None:
    """Users' readings of whole hours into their mart; other hours stay."""
    new = hourly.user_hourly(quality.valid_measurements(measurements))
    _upsert(new, f"{marts}/{USER}", ("h3_cell", "hour_utc", "value_median"),
            schemas.USER_HOURLY, keep_days, ("h3_cell", "hour_utc", "target"))


def ingest_tiles(spark: SparkSession, tiles: DataFrame, marts: str) -> None:
    _replace(hourly.tile_context(tiles), f"{marts}/{TILES}", ("h3_cell",), schemas.TILE_CONTEXT)


def _label_marts(spark: SparkSession, marts: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return (
        read_mart(spark, f"{marts}/{PROBE}", schemas.PROBE_HOURLY),
        read_mart(spark, f"{marts}/{TEST}", schemas.TEST_HOURLY),
        read_mart(spark, f"{marts}/{USER}", schemas.USER_HOURLY),
    )


def build_fallback_marts(spark: SparkSession, marts: str) -> None:
    """Recent medians per cell and parent, and the latitude priors."""
    latency = labels.latency_labels(labels.assemble_labels(*_label_marts(spark, marts)))
    _replace(fallback.cell_label_stats(latency), f"{marts}/{STATS}", ("h3_cell", "median"),
             schemas.CELL_STATS)
    _replace(fallback.latitude_priors(latency), f"{marts}/{PRIORS}", ("median",),
             schemas.LATITUDE_PRIORS, ("band",))


def build_feature_marts(spark: SparkSession, marts: str, positions: DataFrame,
                        precip: DataFrame) -> None:
    """Sky and weather features at the label pairs only; ``positions`` as in visibility.py."""
    probe, _, user = _label_marts(spark, marts)
    pairs = labels.label_cell_hours(probe, user)
    _replace(visibility.orbital_features(positions, pairs), f"{marts}/{ORBITAL}",
             ("h3_cell", "hour_utc", "sats_visible"), schemas.ORBITAL_FEATURES)
    _replace(weather.precip_features(pairs, precip), f"{marts}/{WEATHER}",
             ("h3_cell", "hour_utc"), schemas.WEATHER_FEATURES)


def build_active_cells(spark: SparkSession, marts: str, *extra: DataFrame) -> None:
    """The active set: tile context and probe cells, plus any further sources given."""
    tiles = read_mart(spark, f"{marts}/{TILES}", schemas.TILE_CONTEXT)
    probe = read_mart(spark, f"{marts}/{PROBE}", schemas.PROBE_HOURLY)
    _replace(labels.active_cells(tiles, probe, *extra), f"{marts}/{ACTIVE}", ("h3_cell",),
             schemas.ACTIVE_CELLS, ("h3_cell",))
