"""Views that read the shared test tables as this domain's inputs.

Every event is one reading: its user's site gives the place, its type the source, its value
the latency and (doubled) the download rate. ``oracle.py`` states the same views in SQL.
"""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkgrid.functions.cells import cell_lon, cell_of
from linkgrid.functions.quantiles import exact_median
from linkgrid.functions.times import hour_of, utc_literal
from linkgrid.operators import hourly, labels
from linkgrid.operators.fallback import cell_label_stats, latitude_priors, resolve_medians
from linkgrid.operators.forecast import horizon_pairs
from linkgrid.operators.quality import valid_measurements
from linkgrid import schemas
from linkgrid.session import shared_dir, use_utc
from linkgrid.sources.marts import read_mart, write_mart

NOW = datetime(2024, 1, 29, tzinfo=UTC)
MIN_HOURS = 120
SITES = 12


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return use_utc(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def site_of(key: Column) -> Column:
    return key % SITES


def site_lat(site: Column) -> Column:
    return F.lit(-50.0) + F.lit(18.0) * F.floor(site / 2) + F.lit(0.2) * (site % 2)


def site_lon(site: Column) -> Column:
    return F.lit(-150.0) + F.lit(55.0) * F.floor(site / 2)


def as_readings(events: DataFrame) -> DataFrame:
    """Event rows (batch or stream) as readings."""
    kind = F.col("event_type")
    source = (
        F.when(kind.isin("view", "click"), "atlas").when(kind == "error", "mlab").otherwise("user")
    )
    lost = F.col("event_id") % 50 == 0
    site = site_of(F.col("user_id"))
    return (
        events.select("event_id", "ts", "user_id", "event_type", "value", "props")
        .withColumns({"ts": F.col("ts").cast("timestamp"), "site": site, "source": source})
        .withColumns({"lat": site_lat(F.col("site")), "lon": site_lon(F.col("site"))})
        .withColumns(
            {
                "h3_cell": cell_of(F.col("lat"), F.col("lon")),
                "hour_utc": hour_of(F.col("ts")),
                "lost": lost,
                "latency_ms": F.when(lost, F.lit(-1.0)).otherwise(F.col("value")),
                "dl_mbps": F.when(F.col("source") != "atlas", F.col("value") * 2.0),
                "k": F.get_json_object("props", "$.k").cast("double"),
            }
        )
    )


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_readings(table(spark, sf_dir, "events"))


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One probe per customer; some have no point."""
    key = F.col("c_custkey")
    site = site_of(key)
    point = F.when(key % 17 != 0, F.array(site_lon(site), site_lat(site)))
    return table(spark, sf_dir, "customer").select(
        key.alias("id"),
        F.struct(F.lit("Point").alias("type"), point.alias("coordinates")).alias("geometry"),
    )


def pings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        readings(spark, sf_dir)
        .where(F.col("source") == "atlas")
        .select(
            F.col("user_id").alias("prb_id"),
            F.unix_seconds("ts").alias("timestamp"),
            F.col("latency_ms").alias("min"),
        )
    )


def raw_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single tests: some without a point, a round trip or a rate."""
    event = F.col("event_id")
    return (
        readings(spark, sf_dir)
        .where(F.col("source") == "mlab")
        .select(
            "event_id",
            "ts",
            F.to_date("ts").alias("date"),
            F.lit(64500).alias("asn"),
            F.when(event % 23 != 0, F.col("lat")).alias("lat"),
            "lon",
            F.when(event % 41 != 0, F.col("dl_mbps")).alias("dl_mbps"),
            F.when(~F.col("lost"), F.col("value")).alias("rtt_ms"),
        )
    )


def raw_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same tests as if already grouped, with sample counts (0 for some)."""
    event = F.col("event_id")
    return raw_tests(spark, sf_dir).select(
        F.col("ts").alias("hour_utc"),
        "lat",
        "lon",
        F.col("dl_mbps").alias("dl_mbps_median"),
        F.col("rtt_ms").alias("min_rtt_median"),
        F.when(event % 29 == 0, F.lit(0)).otherwise(1 + event % 4).cast("bigint").alias("samples"),
    )


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_measurements(readings(spark, sf_dir))


def as_measurements(rows: DataFrame) -> DataFrame:
    """Users' own readings; lost ones carry an invalid latency."""
    return rows.where(F.col("source") == "user").select(
        F.col("event_id").alias("measurement_id"),
        F.col("user_id").cast("string").alias("user_id"),
        "ts",
        "h3_cell",
        F.when(F.col("event_type") == "purchase", "reporter").otherwise("browser").alias("source"),
        "latency_ms",
        "dl_mbps",
        F.lit(None).cast("double").alias("ul_mbps"),
        F.col("k").alias("obstruction_pct"),
        F.lit(None).cast("string").alias("hw_version"),
    )


def tile_of(site: Column) -> Column:
    """The text of a small square around a site."""
    lat, lon = site_lat(site), site_lon(site)
    corner = lambda dx, dy: F.concat_ws(
        " ", (lon + dx).cast("string"), (lat + dy).cast("string")
    )
    h = 0.001
    ring = F.concat_ws(
        ", ", corner(-h, -h), corner(h, -h), corner(h, h), corner(-h, h), corner(-h, -h)
    )
    return F.concat(F.lit("POLYGON(("), ring, F.lit("))"))


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tile per order line: a small square around its supplier's site."""
    site = site_of(F.col("l_suppkey"))
    # The squares of the known sites are constants that Spark folds, not ten casts a row.
    known = F.array(*[tile_of(F.lit(s).cast("bigint")) for s in range(SITES)])
    tile = F.when(site.between(0, SITES - 1), F.get(known, site.cast("int")))
    return table(spark, sf_dir, "lineitem").select(
        tile.otherwise(tile_of(site)).alias("tile"),
        F.col("l_extendedprice").alias("avg_d_kbps"),
        (F.col("l_linenumber") + 10.0).alias("avg_lat_ms"),
        F.col("l_quantity").cast("bigint").alias("tests"),
        F.col("l_linenumber").cast("bigint").alias("devices"),
    )


def probe_mart(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hourly.probe_hourly(pings(spark, sf_dir), hourly.probe_cells(probes(spark, sf_dir)))


def test_mart(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hourly.test_hourly(raw_points(spark, sf_dir))


def user_mart(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hourly.user_hourly(valid_measurements(measurements(spark, sf_dir)))


def tile_mart(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hourly.tile_context(tiles(spark, sf_dir))


def all_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.assemble_labels(*(mart(spark, sf_dir, m) for m in ("probe", "test", "user")))


def label_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.label_cell_hours(*(mart(spark, sf_dir, m) for m in ("probe", "user")))


def precip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly rain per cell, absent where no error event fell in the hour."""
    return (
        readings(spark, sf_dir)
        .where(F.col("source") == "mlab")
        .groupBy("h3_cell", "hour_utc")
        .agg(F.greatest(F.avg("value") / 20.0 - 2.0, F.lit(0.0)).alias("precip_mm_h"))
    )


def sparse_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly latency of all sites, with gaps at the two northern ones."""
    odd = (F.unix_seconds("hour_utc") / 3600).cast("bigint") % 2 == 1
    kept = readings(spark, sf_dir).where(
        ~F.col("lost") & ~((F.col("site") >= 10) & odd)
    )
    return exact_median(kept, ["h3_cell", "hour_utc"], "latency_ms", "value").select(
        "h3_cell", "hour_utc", "value"
    )


def site_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.active_cells(readings(spark, sf_dir))


def medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    latency = mart(spark, sf_dir, "sparse")
    return resolve_medians(
        site_cells(spark, sf_dir), cell_label_stats(latency), latitude_priors(latency), MIN_HOURS
    )


def horizon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """48 hours per cell: observed hourly medians as q50, cell medians in the gaps."""
    good = readings(spark, sf_dir).where(~F.col("lost"))
    by_hour = hourly.long_targets(good, ["h3_cell", "hour_utc"])
    pick = lambda t, c, n: F.max(F.when(F.col("target") == t, F.col(c))).alias(n)
    hours = (
        exact_median(by_hour, ["h3_cell", "hour_utc", "target"], "value", "m")
        .where(F.col("hour_utc") >= utc_literal(NOW))
        .groupBy("h3_cell", "hour_utc")
        .agg(pick("latency", "m", "lat_m"), pick("dl_throughput", "m", "dl_m"))
    )
    cells = (
        exact_median(by_hour, ["h3_cell", "target"], "value", "m")
        .groupBy("h3_cell")
        .agg(pick("latency", "m", "latency_median"), pick("dl_throughput", "m", "dl_median"))
    )
    pair = ["h3_cell", "hour_utc"]
    q50 = F.coalesce("lat_m", "latency_median")
    return (
        horizon_pairs(site_cells(spark, sf_dir), NOW)
        .join(hours, pair, "left")
        .join(cells, "h3_cell")
        .join(mart(spark, sf_dir, "precip"), pair, "left")
        .join(medians(spark, sf_dir), "h3_cell")
        .select(
            *pair,
            (q50 * 0.8).alias("latency_q10"),
            q50.alias("latency_q50"),
            (q50 * 1.2).alias("latency_q90"),
            F.coalesce("dl_m", "dl_median").alias("dl_q50"),
            F.coalesce("precip_mm_h", F.lit(0.0)).alias("precip_mm_h"),
            "basis",
            cell_lon(F.col("h3_cell")).alias("lon"),
            "latency_median",
            "dl_median",
        )
    )


MARTS = {
    "probe": probe_mart,
    "test": test_mart,
    "user": user_mart,
    "tile": tile_mart,
    "precip": precip,
    "sparse": sparse_latency,
    "horizon": horizon,
}
HORIZON = (
    "h3_cell bigint, hour_utc timestamp, latency_q10 double, latency_q50 double, "
    "latency_q90 double, dl_q50 double, precip_mm_h double, basis string, lon double, "
    "latency_median double, dl_median double"
)
_written: dict[tuple[str, str, str], str] = {}


def mart(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A mart as later jobs see it: written to the shared folder once per application."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _written:
        path = shared_dir(spark, f"mart-{name}")
        write_mart(MARTS[name](spark, sf_dir), path)
        _written[key] = path
    return read_mart(spark, _written[key], schema_of(name))


def schema_of(name: str) -> str:
    return {
        "probe": schemas.PROBE_HOURLY,
        "test": schemas.TEST_HOURLY,
        "user": schemas.USER_HOURLY,
        "tile": schemas.TILE_CONTEXT,
        "precip": "h3_cell bigint, hour_utc timestamp, precip_mm_h double",
        "sparse": "h3_cell bigint, hour_utc timestamp, value double",
        "horizon": HORIZON,
    }[name]


def fixed_bands(rows: DataFrame) -> DataFrame:
    """Bands that need no model: near the true quantiles, off by the cell's parity."""
    shift = F.col("h3_cell") % 2
    scale = F.when(F.col("target") == "latency", 1.0).otherwise(2.0)
    return rows.withColumns(
        {
            "q10": scale * (6.0 + shift),
            "q50": scale * (36.0 + 3.0 * shift),
            "q90": scale * (112.0 + 5.0 * shift),
        }
    )


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Earth-fixed positions, hourly: a circular orbit per supplier over the 30 days.

    Suppliers are few bytes that become 720 rows each, so they are dealt out before that; the
    number is given, or adaptive execution would merge so small a shuffle into one task.
    """
    key, hour = F.col("s_suppkey"), F.col("hour")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = table(spark, sf_dir, "supplier").select(key).repartition(tasks, key).select(
        key, F.explode(F.sequence(F.lit(0), F.lit(719))).alias("hour"))
    radius = F.lit(6921.0) + (key % 5) * 20.0
    along = F.radians((key * 137 % 3600) / 10.0 + hour * 226.1)
    tilt = F.radians(F.lit(53.0) + (key % 3) * 8.5)
    node = F.radians((key % 8) * 45.0 + (key % 11) * 1.5 - hour * 15.04)
    rows = rows.withColumns({"r": radius, "u": along, "i": tilt, "n": node})
    u, i, n = F.col("u"), F.col("i"), F.col("n")
    return rows.select(
        key.alias("sat_id"),
        F.timestamp_seconds(F.lit(1_704_067_200) + hour * 3600).alias("hour_utc"),
        (F.col("r") * (F.cos(u) * F.cos(n) - F.sin(u) * F.cos(i) * F.sin(n))).alias("x"),
        (F.col("r") * (F.cos(u) * F.sin(n) + F.sin(u) * F.cos(i) * F.cos(n))).alias("y"),
        (F.col("r") * F.sin(u) * F.sin(i)).alias("z"),
    )
