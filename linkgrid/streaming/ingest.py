"""The measurement feed as a stream: validation, duplicates, hourly marts, live flags.

The feed delivers at least once and in any order: devices keep readings through outages and
send them later. So no lateness bound is set. Every batch is written to a raw table that is
partitioned by hour and batch, over what an earlier run of the same batch left; the keys it
touches are then computed anew from the raw hours they need, where repeats are dropped, and
replace their rows in the mart by one commit. A row of any lateness counts, a batch that runs
twice changes nothing, and the state is the raw table itself.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from linkgrid import schemas
from linkgrid.operators.history import keep_best
from linkgrid.operators.hourly import user_hourly
from linkgrid.session import shared_dir
from linkgrid.sources.marts import empty, path_exists, upsert_mart


def file_stream(
    spark: SparkSession, path: str, schema: str = schemas.MEASUREMENTS, fmt: str = "parquet",
    glob: str | None = None, files_per_trigger: int | None = None,
) -> DataFrame:
    """Files that arrive in a folder."""
    reader = spark.readStream.format(fmt).schema(schema)
    if glob is not None:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def kafka_stream(spark: SparkSession, servers: str, topic: str,
                 schema: str = schemas.MEASUREMENTS) -> DataFrame:
    """JSON measurements from a topic (needs the Kafka connector on the class path)."""
    raw = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .load()
    )
    return raw.select(F.from_json(F.col("value").cast("string"), schema).alias("m")).select("m.*")


def without_repeats(rows: DataFrame) -> DataFrame:
    """One row per (user, ts, source), the first by all its values."""
    keys = ["user_id", "ts", "source"]
    rest = [F.col(c) for c in rows.columns if c not in keys and c != "date"]
    return keep_best(rows, keys, rest)


def start_append(stream: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append sink: exactly once per batch through the sink's own log."""
    writer = stream.writeStream.format("parquet").outputMode("append")
    return (
        writer.option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start(path)
    )


def write_batch(batch: DataFrame, batch_id: int, raw: str) -> None:
    """A batch into the raw table, in partitions of its own.

    A batch that runs again has the same rows and writes the same partitions over its own, so
    it counts once however often it runs. Rows are rebalanced by hour, so that an hour has few
    files; a heavy one is split.
    """
    (
        batch.withColumns({
            "date": F.to_date("ts"), "hour": F.hour("ts"),
            "batch": F.lit(batch_id).cast("bigint")})
        .hint("rebalance", "date", "hour")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("date", "hour", "batch").parquet(raw)
    )


def read_hours(spark: SparkSession, raw: str, schema: T.StructType,
               hours: Sequence[tuple[date, int]]) -> DataFrame:
    """The raw rows of some hours, given as (date, hour); no other folder is listed."""
    folders = [f for d, h in sorted(set(hours))
               if path_exists(spark, f := f"{raw}/date={d.isoformat()}/hour={h}")]
    if not folders:
        return spark.createDataFrame([], schema)
    names = [f.name for f in schema.fields]
    parts = "date date, hour int, batch bigint"
    own = T.StructType([*schema.fields, *empty(spark, parts).schema.fields])
    return spark.read.schema(own).option("basePath", raw).parquet(*folders).select(*names)


def _start_recomputed(
    stream: DataFrame, raw: str, checkpoint: str, touched, refresh, trigger: dict
) -> StreamingQuery:
    """Write each batch to ``raw``, then ``refresh`` the keys that ``touched`` finds in it.

    ``touched`` gives the keys of a batch with ``at``, an instant in each raw hour they need.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        write_batch(batch, batch_id, raw)
        staged = shared_dir(spark, "touched")
        touched(batch).write.parquet(staged)
        keys = spark.read.parquet(staged)
        hours = keys.select(F.to_date("at").alias("d"), F.hour("at").alias("h")).distinct()
        hours = [(r["d"], r["h"]) for r in hours.collect() if r["d"] is not None]
        if hours:
            rows = read_hours(spark, raw, batch.schema, hours)
            refresh(rows, keys.drop("at").distinct())

    return (
        stream.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def start_hourly_upsert(
    stream: DataFrame, raw: str, mart: str, checkpoint: str, keep_days: int | None = None,
    **trigger,
) -> StreamingQuery:
    """Keeps an hourly mart (partitioned by date) up to date with a feed of valid readings."""
    hour = F.date_trunc("hour", "ts").alias("hour_utc")

    def touched(batch: DataFrame) -> DataFrame:
        return batch.select("h3_cell", hour, F.date_trunc("hour", "ts").alias("at")).distinct()

    def refresh(rows: DataFrame, keys: DataFrame) -> None:
        wanted = rows.withColumn("hour_utc", F.date_trunc("hour", "ts")).join(
            keys, ["h3_cell", "hour_utc"], "left_semi")
        upsert_mart(user_hourly(without_repeats(wanted.drop("hour_utc"))), mart,
                    ("h3_cell", "hour_utc", "target"), keep_days=keep_days)

    return _start_recomputed(stream, raw, checkpoint, touched, refresh, trigger)


def start_arrival_upsert(
    stream: DataFrame, key: str, window: str, slide: str, cap: int, raw: str, mart: str,
    checkpoint: str, **trigger,
) -> StreamingQuery:
    """Keeps the counts of sliding windows up to date with a feed of (key, ts) arrivals.

    Arrivals are counted as they come, so a feed that resends must be cleaned before.
    """
    spans = F.window("ts", window, slide).alias("w")

    def touched(batch: DataFrame) -> DataFrame:
        # Every hour that a touched window reaches into is read again.
        rows = batch.select(key, spans).distinct()
        hours = F.sequence(F.date_trunc("hour", "w.start"), F.col("w.end"), F.expr("INTERVAL 1 HOUR"))
        return rows.select(
            key, F.col("w.start").alias("window_start"), F.explode(hours).alias("at"))

    def refresh(rows: DataFrame, keys: DataFrame) -> None:
        counted = arrival_counts(rows, key, window, slide, cap)
        counted = counted.join(keys, [key, "window_start"], "left_semi")
        upsert_mart(counted, mart, [key, "window_start"], time="window_start")

    return _start_recomputed(stream, raw, checkpoint, touched, refresh, trigger)


def arrival_counts(stream: DataFrame, key: str, window: str, slide: str, cap: int) -> DataFrame:
    """Arrivals per key in sliding windows, flagged when over the cap."""
    return (
        stream.groupBy(F.window("ts", window, slide).alias("w"), key)
        .agg(F.count(F.lit(1)).alias("arrivals"))
        .select(
            key,
            F.col("w.start").alias("window_start"),
            F.col("w.end").alias("window_end"),
            "arrivals",
            (F.col("arrivals") > cap).alias("over_cap"),
        )
    )


def flag_below_q10(stream: DataFrame, bands: DataFrame, salts: int = 16) -> DataFrame:
    """Live download readings with the band of their (cell, hour) and a flag.

    ``bands`` is a static table with h3_cell, hour_utc and q10; readings without a band keep
    a NULL flag. A busy cell-hour is spread over ``salts`` keys; each band is sent to all.
    """
    hour = F.date_trunc("hour", "ts")
    salted = bands.select("h3_cell", "hour_utc", "q10", F.explode(
        F.sequence(F.lit(0), F.lit(salts - 1))).alias("__salt"))
    spread = F.pmod(F.xxhash64("ts", "dl_mbps"), F.lit(salts)).cast("int")
    return (
        stream.where(F.col("dl_mbps").isNotNull())
        .withColumns({"hour_utc": hour, "__salt": spread})
        .join(salted, ["h3_cell", "hour_utc", "__salt"], "left")
        .drop("__salt")
        .withColumn("below_q10", F.col("dl_mbps") < F.col("q10"))
    )
