import random

from helpers import at, epoch, hours_of
from pyspark.sql import functions as F

from linkgrid import schemas
from linkgrid.checks.queries import forget_last_batch
from linkgrid.operators import hourly, quality
from linkgrid.sources import marts, versions
from linkgrid.streaming import ingest


def feed(spark, folder):
    """Files in time order with repeats in the next file, one too-late row, and a closing row."""
    rng = random.Random(4)
    rows = []
    for i in range(400):
        t = at(i * 0.05)
        rows.append((f"u{i % 7}", t, i % 3, rng.choice(["reporter", "browser"]), float(rng.randrange(50)),
                     rng.choice([None, float(rng.randrange(9))]), None, None, None))
    bad = [("u0", at(1), 0, "robot", 1.0, None, None, None, None)]
    parts = [rows[:150] + bad, rows[140:300], rows[290:]]
    late = [("late", at(0.2), 0, "browser", 999.0, None, None, None, None)]
    closing = [("end", at(100), 0, "browser", 1.0, None, None, None, None)]
    for i, part in enumerate([*parts, late, closing]):
        spark.createDataFrame(part, schemas.MEASUREMENTS).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return rows


def hourly_mart(spark, folder, **options):
    stream = quality.valid_measurements(
        ingest.file_stream(spark, f"{folder}/in", files_per_trigger=1))
    ingest.start_hourly_upsert(
        stream, f"{folder}/raw", f"{folder}/mart", f"{folder}/cp", **options).awaitTermination()
    return marts.read_mart(spark, f"{folder}/mart", schemas.USER_HOURLY)


def test_stream_equals_batch_whatever_is_late_or_repeated(spark, folder):
    feed(spark, folder)
    every = spark.read.parquet(f"{folder}/in").distinct()
    want = hours_of(hourly.user_hourly(quality.valid_measurements(every)))
    assert hours_of(hourly_mart(spark, folder)) == want
    assert any(v == 999.0 for v in every.select("latency_ms").toPandas()["latency_ms"])


def test_upsert_and_retention(spark, folder):
    feed(spark, folder)
    mart = hourly_mart(spark, folder)
    want = hours_of(mart)
    path, keys = f"{folder}/mart", ("h3_cell", "hour_utc", "target")
    marts.upsert_mart(mart, path, keys)
    assert hours_of(marts.read_mart(spark, path, schemas.USER_HOURLY)) == want
    newer = spark.createDataFrame([(0, at(24 * 95), "latency", 5.0, 1)], schemas.USER_HOURLY)
    marts.upsert_mart(newer, path, keys, keep_days=90)
    left = marts.read_mart(spark, path, schemas.USER_HOURLY)
    bound = epoch(at(24 * 95)) - 90 * 86_400
    whole = [*want, *hours_of(newer)]
    hour = left.columns.index("hour_utc")
    assert hours_of(left) == sorted((r for r in whole if r[hour] > bound), key=repr)


def test_a_batch_that_runs_again_changes_nothing(spark, folder):
    """The stream dies after its last batch was written, and before that was noted."""
    feed(spark, folder)
    stream = ingest.file_stream(spark, f"{folder}/in", files_per_trigger=2).select("user_id", "ts")

    def run():
        ingest.start_arrival_upsert(
            stream, "user_id", "2 hours", "1 hour", 6, f"{folder}/raw", f"{folder}/mart",
            f"{folder}/cp").awaitTermination()
        return hours_of(versions.read(spark, f"{folder}/mart").drop("window_end", "date"))

    first = run()
    assert sum(r[2] for r in first) == 2 * spark.read.parquet(f"{folder}/in").count()
    for _ in range(2):
        forget_last_batch(spark, f"{folder}/cp")
        assert run() == first
    batches = {r["batch"] for r in spark.read.parquet(f"{folder}/raw").select("batch").distinct().collect()}
    assert len(batches) == 3


def test_only_touched_hours_are_read(spark, folder):
    rows = [("a", at(h), h) for h in range(48)]
    frame = spark.createDataFrame(rows, "user_id string, ts timestamp, n int")
    ingest.write_batch(frame, 3, f"{folder}/raw")
    wanted = [(at(5).date(), 5), (at(30).date(), 6), (at(99).date(), 7)]
    read = ingest.read_hours(spark, f"{folder}/raw", frame.schema, wanted)
    assert sorted(r["n"] for r in read.collect()) == [5, 30] and read.columns == frame.columns
    assert len(read.inputFiles()) == 2
    assert ingest.read_hours(spark, f"{folder}/raw", frame.schema, wanted[2:]).count() == 0


def test_rejects_and_flags(spark, folder):
    feed(spark, folder)
    stream = ingest.file_stream(spark, f"{folder}/in")
    bad = quality.rejected_measurements(stream)
    ingest.start_append(bad, f"{folder}/bad", f"{folder}/cp1").awaitTermination()
    assert [r["errors"] for r in spark.read.parquet(f"{folder}/bad").collect()] == [["source"]]
    bands = spark.createDataFrame([(0, at(0), 5.0), (1, at(0), 5.0)], "h3_cell bigint, hour_utc timestamp, q10 double")
    flagged = ingest.flag_below_q10(stream, bands)
    ingest.start_append(flagged, f"{folder}/flag", f"{folder}/cp2").awaitTermination()
    got = spark.read.parquet(f"{folder}/flag")
    assert got.where("below_q10 is not null and below_q10 <> (dl_mbps < 5)").count() == 0
    assert got.where("below_q10 is not null").count() > 0
    assert got.where(F.col("hour_utc") > F.lit(at(1))).where("below_q10 is not null").count() == 0


def test_sliding_arrivals(spark, folder):
    feed(spark, folder)
    stream = ingest.file_stream(spark, f"{folder}/in", files_per_trigger=1).select("user_id", "ts")
    ingest.start_arrival_upsert(
        stream, "user_id", "2 hours", "1 hour", 6, f"{folder}/araw", f"{folder}/amart",
        f"{folder}/cp").awaitTermination()
    got = versions.read(spark, f"{folder}/amart").where("user_id = 'u1'")
    total = spark.read.parquet(f"{folder}/in").where("user_id = 'u1'").count()
    assert got.agg(F.sum("arrivals")).first()[0] == 2 * total
    assert got.where("over_cap <> (arrivals > 6)").count() == 0
