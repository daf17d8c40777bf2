"""Readers for the raw inputs: JSON payloads, CSV folders, element sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkgrid import schemas

# Element-set snapshots carry their UTC time in the file name.
SNAPSHOT_NAME = r"gp_(\d{8}T\d{6}Z)\.json$"
SNAPSHOT_FORMAT = "yyyyMMdd'T'HHmmss'Z'"
#: Where Spark puts the text of a file that it can't parse.
BROKEN = "_broken"


def read_probes(spark: SparkSession, path: str, rejected: str | None = None) -> DataFrame:
    """Probe registry: a JSON array per file, or a page with the array in ``results``."""
    return _read_listed(spark, path, schemas.PROBES, "id", rejected)


def read_pings(spark: SparkSession, path: str, rejected: str | None = None) -> DataFrame:
    """Ping results: a JSON array per file, or a page with the array in ``results``."""
    return _read_listed(spark, path, schemas.PINGS, "prb_id", rejected)


def _read_listed(spark: SparkSession, path: str, item: str, key: str,
                 rejected: str | None) -> DataFrame:
    """Items of an array or of a ``{"results": [...]}`` page, both read with one schema.

    Nothing is lost without a word: without ``rejected`` a file that can't be parsed, or an item
    without ``key``, ends the job with the name of the file. With it, what can't be used is
    appended there (see ``rejects_of``), and all else is read.
    """
    parsed = parse_listed(spark, path, item, key)
    if rejected is not None:
        rejects_of(parsed).write.mode("append").parquet(rejected)
        usable = F.col("reason").isNull()
    else:
        lost = F.concat(F.col("file"), F.lit(": "), "reason")
        usable = F.when(F.col("reason").isNull(), F.lit(True)).otherwise(
            F.raise_error(lost).cast("boolean"))
    return parsed.where(usable).select("item.*")


def parse_listed(spark: SparkSession, path: str, item: str, key: str) -> DataFrame:
    """(file, item, reason, text): every item of every file, and the files that have none.

    ``reason`` says why a row can't be used, NULL if it can: the file is no JSON of the schema
    (then ``text`` is all of it), or the item lacks ``key`` (then it is the item).
    """
    names = [f.name for f in spark.createDataFrame([], item).schema.fields]
    rows = (
        spark.read.schema(f"{item}, results array<struct<{item}>>, {BROKEN} string")
        .option("multiLine", True).option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", BROKEN)
        .json(path)
    )
    own = F.struct(*names)
    items = rows.select(
        F.col("_metadata.file_path").alias("file"), F.col(BROKEN).alias("broken"),
        F.explode(F.when(F.col(BROKEN).isNotNull(), F.array(F.lit(None).cast(f"struct<{item}>")))
                  .otherwise(F.coalesce("results", F.array(own)))).alias("item"))
    reason = F.when(F.col("broken").isNotNull(), "not parsed").when(
        F.col(f"item.{key}").isNull(), f"no {key}")
    return items.select(
        "file", "item", reason.alias("reason"),
        F.when(F.col("broken").isNotNull(), F.col("broken")).when(
            reason.isNotNull(), F.to_json("item")).alias("text"))


def rejects_of(parsed: DataFrame) -> DataFrame:
    """One row for each file or item that can't be used: file, reason, text."""
    return parsed.where(F.col("reason").isNotNull()).select("file", "reason", "text")


def read_rain_fade(spark: SparkSession, folder: str, schema: str | None = None) -> DataFrame:
    """All CSV files of a folder with a header; no file at all is an error."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/*.csv")
    found = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop)
    if found is None or len(found) == 0:
        raise FileNotFoundError(f"no CSV files in {folder}")
    reader = spark.read.option("header", True)
    reader = reader.option("inferSchema", True) if schema is None else reader.schema(schema)
    return reader.csv(f"{folder}/*.csv")


def quarter_path(root: str, year: int, quarter: int) -> str:
    """Hive-style folder of one quarter of tiles; other quarters are never listed."""
    if quarter not in (1, 2, 3, 4):
        raise ValueError("quarter must be within 1..4")
    return f"{root}/year={year}/quarter={quarter}"


def read_tiles(spark: SparkSession, root: str, year: int, quarter: int) -> DataFrame:
    return spark.read.option("basePath", root).parquet(quarter_path(root, year, quarter))


def parse_weather(df: DataFrame, body: str, reason: str | None = None) -> DataFrame:
    """JSON text column to the hourly struct, other columns kept.

    A text that can't be parsed gives a NULL struct; with ``reason``, a column of that name says
    so, for a rejects table.
    """
    kept = [c for c in df.columns if c != body]
    parsed = F.from_json(body, f"{schemas.WEATHER_SERIES}, {BROKEN} string",
                         {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BROKEN})
    rows = df.select(*kept, parsed.alias("__w"))
    broken = F.col(f"__w.{BROKEN}").isNotNull()
    why = [] if reason is None else [F.when(broken, "not parsed").when(
        F.col("__w.hourly").isNull(), "no hourly block").alias(reason)]
    return rows.select(*kept, F.when(~broken, F.col("__w.hourly")).alias("hourly"), *why)


def hourly_weather(df: DataFrame) -> DataFrame:
    """Parallel arrays to one row per hour, cut to the shorter one; a NULL amount reads 0.

    A repeated hour keeps its last amount.
    """
    kept = [c for c in df.columns if c != "hourly"]
    times, amounts = F.col("hourly.time"), F.col("hourly.precipitation")
    size = F.least(F.size(times), F.size(amounts))
    pairs = F.arrays_zip(
        F.slice(times, 1, size).alias("time"), F.slice(amounts, 1, size).alias("mm")
    )
    rows = df.where(size > 0).select(*kept, F.posexplode(pairs).alias("__pos", "__p"))
    return (
        rows.select(
            *kept,
            "__pos",
            F.to_timestamp("__p.time").alias("hour_utc"),
            F.coalesce("__p.mm", F.lit(0.0)).alias("precip_mm_h"),
        )
        .groupBy(*kept, "hour_utc")
        .agg(F.max_by("precip_mm_h", "__pos").alias("precip_mm_h"))
    )


def read_weather(spark: SparkSession, path: str) -> DataFrame:
    """Archive responses, one per file and cell; the cell is in the path (``h3_cell=...``)."""
    return spark.read.schema(schemas.WEATHER_SERIES).option("multiLine", True).json(path)


def current_weather(body: Column) -> Column:
    """Current-conditions text to a struct; absent amounts read 0, an absent block is NULL."""
    now = F.from_json(body, schemas.WEATHER_NOW)["current"]
    zero = F.lit(0.0)
    return F.when(
        now.isNotNull(),
        F.struct(
            F.coalesce(now["precipitation"], zero).alias("precip_mm_h"),
            F.coalesce(now["cloud_cover"], zero).alias("cloud_cover_pct"),
            F.coalesce(now["snowfall"], zero).alias("snow_mm_h"),
        ),
    )


def stamp_of(file_name: Column) -> Column:
    """UTC time in a snapshot's file name, or NULL."""
    text = F.regexp_extract(file_name, SNAPSHOT_NAME, 1)
    return F.try_to_timestamp(F.nullif(text, F.lit("")), F.lit(SNAPSHOT_FORMAT))


def latest_snapshot(spark: SparkSession, folder: str) -> tuple[str, DataFrame] | None:
    """Path of the newest snapshot by name with its rows, or None. Only that one is read.

    A snapshot is one file, or a folder of that name with a JSON record per line, as a Spark job
    writes it; a folder without _SUCCESS is not finished and does not count.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    glob = hadoop(f"{folder}/*gp_*.json")
    fs = glob.getFileSystem(spark._jsc.hadoopConfiguration())
    listed = fs.globStatus(glob) or []
    found = sorted((str(s.getPath()), s.isDirectory()) for s in listed)
    for path, parts in reversed(found):
        if not parts or fs.exists(hadoop(f"{path}/_SUCCESS")):
            return path, read_elements(spark, path, parts)
    return None


def read_elements(spark: SparkSession, path: str, parts: bool = False) -> DataFrame:
    """Element records as typed columns with the time they were fetched.

    With ``parts``, ``path`` is a folder of lines, named as a snapshot.
    """
    name = F.lit(path.rstrip("/").rsplit("/", 1)[-1]) if parts else F.col("_metadata.file_name")
    raw = (
        spark.read.schema(schemas.ELEMENTS)
        .option("multiLine", not parts)
        .option("primitivesAsString", True)
        .json(path)
        .withColumn("fetched_at", stamp_of(name))
    )
    return typed_elements(raw)


def typed_elements(raw: DataFrame) -> DataFrame:
    """Text fields to numbers; records that cannot be initialised drop out."""
    number = lambda name: F.col(name).try_cast("double")
    epoch = F.try_to_timestamp(F.regexp_replace("EPOCH", "Z$", ""))
    extra = [c for c in ("fetched_at",) if c in raw.columns]
    typed = raw.select(
        "OBJECT_NAME",
        F.col("NORAD_CAT_ID").try_cast("bigint").alias("sat_id"),
        (F.unix_micros(epoch) / 60e6).alias("epoch_minute"),
        number("MEAN_MOTION").alias("mean_motion"),
        number("ECCENTRICITY").alias("ecc"),
        number("INCLINATION").alias("incl"),
        number("RA_OF_ASC_NODE").alias("node"),
        number("ARG_OF_PERICENTER").alias("argp"),
        number("MEAN_ANOMALY").alias("anomaly"),
        number("BSTAR").alias("bstar"),
        *extra,
    )
    usable = F.col("mean_motion") > 0
    needed = ["sat_id", "epoch_minute", "mean_motion", "ecc", "incl", "node", "argp", "anomaly"]
    return typed.where(usable).dropna(subset=[*needed, "bstar"])


def read_measurements(spark: SparkSession, path: str) -> DataFrame:
    """Stored measurements that carry at least one reading; the filter reaches the scan."""
    return spark.read.schema(schemas.MEASUREMENTS).parquet(path).where(
        F.col("latency_ms").isNotNull() | F.col("dl_mbps").isNotNull()
    )
