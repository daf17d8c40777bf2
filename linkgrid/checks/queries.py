"""Named queries over the shared tables, one per operator or job."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkgrid import schemas
from linkgrid.checks import inputs as I
from linkgrid.functions import cells as C
from linkgrid.functions.quantiles import exact_quantiles
from linkgrid.functions.times import (
    next_reconfig,
    seconds_to_reconfig,
    shift_hours,
    solar_phrase,
    time_features,
    utc_literal,
)
from linkgrid.functions.units import BAND_FIELDS, device_measurements, source_quality
from linkgrid.operators import (
    bandcache,
    boosting,
    centres,
    dish,
    fallback,
    floods,
    forecast,
    forest,
    history,
    hourly,
    labels,
    matrix,
    metrics,
    quality,
    split,
    takeaways,
    visibility,
    weather,
)
from linkgrid.plans import serving, training
from linkgrid.session import shared_dir
from linkgrid.sources import files, marts, versions
from linkgrid.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def publish(df: DataFrame, digits: int = 6) -> DataFrame:
    """Times as epoch seconds, doubles rounded, so that two engines can be compared."""
    columns = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.TimestampType):
            c = F.unix_seconds(c)
        elif isinstance(f.dataType, T.DoubleType):
            c = F.round(c, digits) + 0.0
        elif isinstance(f.dataType, T.DateType):
            c = c.cast("string")
        columns.append(c.alias(f.name))
    return df.select(*columns)


# --- cells, times, rows -----------------------------------------------------------


@query
def cell_hierarchy(spark, sf):
    key = F.col("c_custkey")
    lat = F.pmod(key * 3701, F.lit(18001)) / 100.0 - 90.0
    lon = F.pmod(key * 9103, F.lit(72000)) / 100.0 - 360.0
    rows = I.table(spark, sf, "customer").select(key, lat.alias("lat"), lon.alias("lon"))
    rows = rows.withColumn("cell", C.cell_of(F.col("lat"), F.col("lon")))
    cell = F.col("cell")
    return publish(
        rows.select(
            "c_custkey",
            "cell",
            C.cell_parent(cell, 4).alias("parent4"),
            C.cell_parent(cell, 3).alias("parent3"),
            C.cell_resolution(C.cell_parent(cell, 4)).alias("parent4_res"),
            C.cell_lat(cell).alias("cell_lat"),
            C.cell_lon(cell).alias("cell_lon"),
            C.parse_cell(F.concat(F.lit(" 0x"), F.hex(cell))).alias("from_hex"),
            C.parse_cell(cell.cast("string")).alias("from_decimal"),
        )
    )


def _foreign(spark, sf):
    """Readings whose cell is, at every fifth site, an id in the foreign mode, or missing."""
    foreign = F.col("h3_cell").bitwiseOR(F.lit(1 << 59))
    cell = F.when(F.col("site") % 5 == 0, foreign).when(
        F.col("event_id") % 211 != 0, F.col("h3_cell"))
    rows = I.readings(spark, sf)
    known = rows.where("site % 10 = 0").select(foreign.alias("h3_cell"), "lat", "lon").distinct()
    return rows.select("event_id", cell.alias("h3_cell")), known


@query
def foreign_centres(spark, sf):
    """Centres of own and of foreign cells, by cell."""
    placed = centres.with_centres(*_foreign(spark, sf))
    return publish(placed.groupBy("h3_cell", "lat", "lon").agg(F.count("*").alias("rows")))


@query
def unplaced_cells(spark, sf):
    """What has no centre is listed, with its number of rows."""
    return centres.unplaced(centres.with_centres(*_foreign(spark, sf)))


@query
def time_feature_rows(spark, sf):
    rows = I.readings(spark, sf)
    features = time_features(F.col("ts"), F.col("lon"))
    return publish(
        rows.select(
            "event_id",
            *[c.alias(n) for n, c in features.items()],
            source_quality(F.col("source")).alias("source_quality"),
        )
    )


@query
def solar_dayparts(spark, sf):
    rows = I.readings(spark, sf)
    return (
        rows.withColumn("phrase", solar_phrase(F.col("ts"), F.col("lon")))
        .groupBy("site", "phrase")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query
def schedule_phase(spark, sf):
    ts = F.col("ts")
    return publish(
        I.readings(spark, sf).select(
            "event_id",
            next_reconfig(ts).alias("next_reconfig"),
            seconds_to_reconfig(ts).alias("seconds_to_reconfig"),
        )
    )


@query
def device_status(spark, sf):
    status = I.readings(spark, sf).select(
        F.col("event_id"),
        F.col("user_id").cast("string").alias("user_id"),
        "ts",
        "h3_cell",
        F.when(F.col("event_id") % 40 == 0, 0.0)
        .otherwise(F.col("value"))
        .alias("pop_ping_latency_ms"),
        (F.col("value") * 1e6).alias("downlink_throughput_bps"),
        F.lit(None).cast("double").alias("uplink_throughput_bps"),
        (F.col("k") / 90.0).alias("fraction_obstructed"),
        F.col("event_type").alias("hardware_version"),
    )
    return publish(
        device_measurements(status).select(
            "event_id", "h3_cell", "source", "latency_ms", "dl_mbps", "ul_mbps",
            "obstruction_pct", "hw_version",
        )
    )


@query
def measurement_checks(spark, sf):
    rows = quality.check_measurements(
        I.measurements(spark, sf).withColumn(
            "source", F.when(F.col("measurement_id") % 37 == 0, "robot").otherwise(F.col("source"))
        )
    )
    return rows.select("measurement_id", F.concat_ws(",", "errors").alias("errors"))


@query
def batch_checks(spark, sf):
    rows = I.measurements(spark, sf).withColumn("batch_id", F.to_date("ts").cast("string"))
    return quality.check_batches(rows)


@query
def weather_json(spark, sf):
    """Builds the hourly payload per cell and day, then reads it back."""
    filled = I.precip(spark, sf).withColumn(
        "mm", F.when(F.col("precip_mm_h") > 0, F.col("precip_mm_h"))
    )
    hours = F.sort_array(F.collect_list(F.struct("hour_utc", "mm")))
    payload = (
        filled.groupBy("h3_cell", F.to_date("hour_utc").alias("day"))
        .agg(hours.alias("h"))
        .select(
            "h3_cell",
            F.struct(
                F.transform("h", lambda x: F.date_format(x["hour_utc"], "yyyy-MM-dd'T'HH:mm")).alias("time"),
                F.transform("h", lambda x: x["mm"]).alias("precipitation"),
            ).alias("hourly"),
        )
        .select("h3_cell", F.to_json(F.struct("hourly"), {"ignoreNullFields": "false"}).alias("body"))
    )
    return publish(files.hourly_weather(files.parse_weather(payload, "body")))


# --- hourly marts -----------------------------------------------------------------


@query
def hourly_latency_median(spark, sf):
    return publish(I.probe_mart(spark, sf))


@query
def user_hourly_long(spark, sf):
    return publish(I.user_mart(spark, sf))


def _located(spark, sf):
    first, last = hourly.month_days(2024, 1)
    return hourly.select_tests(I.raw_tests(spark, sf), 64500, first, last)


@query
def raw_test_rollup(spark, sf):
    return publish(hourly.point_rollup(_located(spark, sf), exact=True))


@query
def raw_test_rollup_sketch(spark, sf):
    return publish(hourly.point_rollup(_located(spark, sf)))


@query
def weighted_cell_labels(spark, sf):
    return publish(I.test_mart(spark, sf))


@query
def tile_context(spark, sf):
    return publish(I.tile_mart(spark, sf))


@query
def null_gate(spark, sf):
    return publish(
        quality.null_rates(I.mart(spark, sf, "test"), ["h3_cell", "dl_mbps_median", "rtt_ms_median"])
    )


def _probe_pulls(spark, sf):
    """The probe mart as an older pull and a newer one that overlaps it by two days."""
    mart = I.mart(spark, sf, "probe")
    split_at = F.unix_seconds("hour_utc") - 1_704_067_200
    old = mart.where(split_at < 20 * 86_400)
    new = mart.where(split_at >= 18 * 86_400).withColumns(
        {"rtt_ms_median": F.col("rtt_ms_median") + 1.0, "samples": F.col("samples") + 1}
    )
    return old, new


@query
def history_merge(spark, sf):
    return publish(history.merge_hourly(*_probe_pulls(spark, sf), keep_days=21))


@query
def mart_upsert(spark, sf):
    """The same pulls into a stored mart with retention, the newer one twice; read from storage."""
    path = shared_dir(spark, "mart-upsert")
    old, new = _probe_pulls(spark, sf)
    gate = versions.Gate(1, ("h3_cell", "hour_utc", "rtt_ms_median"))
    for pull in (old, new, new):
        marts.upsert_mart(pull, path, order=[F.desc("samples")], keep_days=21, gate=gate,
                          schema=schemas.PROBE_HOURLY)
    return publish(marts.read_mart(spark, path, schemas.PROBE_HOURLY))


@query
def mart_versions(spark, sf):
    """What each version of that mart held, day by day, after later commits."""
    path = shared_dir(spark, "mart-versions")
    for pull in _probe_pulls(spark, sf):
        marts.upsert_mart(pull, path, order=[F.desc("samples")])
    found = [
        versions.read(spark, path, number=n).groupBy("date").agg(
            F.count("*").alias("hours"), F.sum("samples").alias("samples"))
        .select(F.lit(n).alias("version"), "*") for n in versions.numbers(spark, path)]
    return publish(functools.reduce(DataFrame.unionByName, found))


# --- keys and features ------------------------------------------------------------


@query
def active_cells(spark, sf):
    return labels.active_cells(I.mart(spark, sf, "tile"), I.mart(spark, sf, "probe"))


@query
def active_map_cells(spark, sf):
    stats = fallback.cell_label_stats(I.mart(spark, sf, "sparse"))
    return labels.active_map_cells(stats, I.mart(spark, sf, "tile"))


@query
def label_pairs(spark, sf):
    return publish(I.label_pairs(spark, sf))


@query
def label_spans(spark, sf):
    return publish(weather.label_spans(I.label_pairs(spark, sf)))


@query
def precip_offsets(spark, sf):
    return publish(weather.precip_features(I.label_pairs(spark, sf), I.mart(spark, sf, "precip")))


@query
def label_rows(spark, sf):
    return publish(I.all_labels(spark, sf))


@query
def trailing_median_7d(spark, sf):
    rows = matrix.trailing_median(I.all_labels(spark, sf))
    return publish(rows.select("h3_cell", "hour_utc", "target", "source", "cell_median_7d"))


def _orbital_stub(spark, sf):
    """Sky features without propagation, so that SQL can state them."""
    seconds = F.unix_seconds("hour_utc")
    count = F.pmod(F.floor(seconds / 3600) + F.floor(seconds / 86_400), F.lit(9)).cast("int")
    return I.label_pairs(spark, sf).select(
        "h3_cell",
        "hour_utc",
        count.alias("sats_visible"),
        F.when(count > 0, count * 5.0 + 30.0).alias("max_elevation_deg"),
    )


def _matrix(spark, sf):
    return matrix.training_matrix(
        I.all_labels(spark, sf),
        _orbital_stub(spark, sf),
        weather.precip_features(I.label_pairs(spark, sf), I.mart(spark, sf, "precip")),
        I.mart(spark, sf, "tile"),
    )


@query
def training_matrix(spark, sf):
    return publish(_matrix(spark, sf))


# --- fallback ---------------------------------------------------------------------


@query
def cell_label_stats(spark, sf):
    return publish(fallback.cell_label_stats(I.mart(spark, sf, "sparse")))


@query
def latitude_priors(spark, sf):
    return publish(fallback.latitude_priors(I.mart(spark, sf, "sparse")))


@query
def fallback_resolve(spark, sf):
    return publish(I.medians(spark, sf))


@query
def map_rollup(spark, sf):
    q50 = F.col("cell_median")
    entries = I.medians(spark, sf).select(
        "h3_cell",
        "basis",
        F.struct(
            (q50 * 0.8).alias("q10"), q50.alias("q50"), (q50 * 1.2).alias("q90")
        ).alias("latency"),
    )
    return publish(forecast.map_rollup(entries, "latency_q90", 3))


# --- split, scores, calibration ---------------------------------------------------


@query
def split_cutoffs(spark, sf):
    return publish(split.split_cutoffs(I.all_labels(spark, sf)))


@query
def split_counts(spark, sf):
    rows = split.stratified_split(I.all_labels(spark, sf))
    return rows.groupBy("target", "source", "is_test").agg(F.count(F.lit(1)).alias("n"))


def _scored(spark, sf):
    rows = I.all_labels(spark, sf).withColumnRenamed("value", "label")
    return I.fixed_bands(rows)


@query
def band_metrics(spark, sf):
    y, q10, q50, q90 = (F.col(c) for c in ("label", "q10", "q50", "q90"))
    return publish(
        _scored(spark, sf).groupBy("target", "source").agg(
            metrics.pinball(y, q10, 0.1).alias("pinball_q10"),
            metrics.pinball(y, q50, 0.5).alias("pinball_q50"),
            metrics.pinball(y, q90, 0.9).alias("pinball_q90"),
            metrics.coverage(y, q10, q90).alias("coverage"),
            metrics.mae(y, q50).alias("mae"),
        )
    )


@query
def persistence_skill(spark, sf):
    scored = _scored(spark, sf)
    past = metrics.persistence_history(scored)
    return publish(metrics.band_report(metrics.with_persistence(scored, past)))


@query
def promotion_gate(spark, sf):
    scored = _scored(spark, sf)
    past = metrics.persistence_history(scored)
    return metrics.promotion(metrics.band_report(metrics.with_persistence(scored, past)))


@query
def conformal_offset(spark, sf):
    return publish(metrics.conformal_offsets(_scored(spark, sf), ["target", "source"]))


# --- bands and cache --------------------------------------------------------------


def _cache(spark, sf):
    """Bands of the last hours under two versions."""
    even = F.pmod(F.floor(F.unix_seconds("hour_utc") / 3600), F.lit(2)) == 0
    return (
        I.all_labels(spark, sf)
        .where((F.col("source") == "user") & (F.col("hour_utc") >= utc_literal(I.NOW)))
        .select(
            "h3_cell",
            "hour_utc",
            F.when(F.col("target") == "latency", "latency").otherwise("dl").alias("metric"),
            (F.col("value") * 0.5).alias("q10"),
            F.col("value").alias("q50"),
            (F.col("value") * 2.0).alias("q90"),
            F.lit("region").alias("basis"),
            F.when(even, "v2").otherwise("v1").alias("model_version"),
        )
    )


def _fresh(spark, sf):
    """Payload rows: bands for both targets, the download one missing on some hours."""
    rows = I.mart(spark, sf, "horizon")
    third = F.pmod(F.floor(F.unix_seconds("hour_utc") / 3600), F.lit(3)) == 0
    band = lambda c: F.struct(
        (c * 0.8).alias("q10"), c.alias("q50"), (c * 1.2).alias("q90")
    )
    return rows.select(
        "h3_cell",
        "hour_utc",
        "basis",
        band(F.col("latency_q50")).alias("latency"),
        F.when(~third, band(F.col("dl_q50"))).alias("dl"),
    )


@query
def cache_gap(spark, sf):
    """Cached hours of one version plus the computed rest, as one horizon."""
    cache, fresh = _cache(spark, sf), _fresh(spark, sf)
    wanted = fresh.select("h3_cell", "hour_utc")
    cached = bandcache.cached_payload(cache, wanted, "v2")
    gap = bandcache.missing_pairs(cache, wanted, "v2")
    computed = fresh.join(gap, ["h3_cell", "hour_utc"], "left_semi")
    both = cached.withColumn("origin", F.lit("cached")).unionByName(
        computed.withColumn("origin", F.lit("computed"))
    )
    return publish(
        both.select(
            "h3_cell", "hour_utc", "basis", "origin",
            F.col("latency.q50").alias("latency_q50"), F.col("dl.q50").alias("dl_q50"),
        )
    )


@query
def cache_upsert(spark, sf):
    """Bands into the stored cache, and the cache as it is read back."""
    path = shared_dir(spark, "band-cache")
    bandcache.store_bands(_cache(spark, sf), path)
    bandcache.store_bands(bandcache.payload_bands(_fresh(spark, sf), "v3"), path)
    return publish(bandcache.stored_bands(spark, path))


# --- takeaways --------------------------------------------------------------------


def _windows(spark, sf, kind):
    return takeaways.takeaway_windows(I.mart(spark, sf, "horizon")).where(F.col("kind") == kind)


@query
def congestion_runs(spark, sf):
    return publish(
        _windows(spark, sf, "congestion").select(
            "h3_cell", "start", "end", "hours", "severity", "worst", "driver"
        )
    )


@query
def rain_runs(spark, sf):
    return publish(_windows(spark, sf, "rain").select("h3_cell", "start", "end", "hours"))


@query
def best_window(spark, sf):
    rows = _windows(spark, sf, "cell").where(F.col("latency_hours") == F.col("hours"))
    return publish(rows.select("h3_cell", F.col("best_start").alias("start"), F.col("best_end").alias("end")))


@query
def takeaway_verdicts(spark, sf):
    rows = takeaways.takeaways(I.mart(spark, sf, "horizon"))
    last = F.element_at("windows", -1)
    return publish(
        rows.select(
            "h3_cell",
            "verdict",
            "headline",
            "confidence",
            F.size("windows").alias("windows"),
            F.get("windows", F.lit(0))["detail"].alias("first_detail"),
            last["detail"].alias("last_detail"),
        )
    )


# --- dishes -----------------------------------------------------------------------


@query
def recent_downloads(spark, sf):
    return publish(
        dish.recent_downloads(I.measurements(spark, sf), 10).select(
            "user_id", "measurement_id", "dl_mbps"
        )
    )


def _with_dish_bands(rows):
    """Bands for downloads: demanding in every fourth site."""
    row = F.shiftright("h3_cell", 26).bitwiseAND(F.lit(3))
    hard = row == 1
    return rows.withColumns({
        "q10": F.when(hard, 60.0).otherwise(6.0), "q50": F.when(hard, 120.0).otherwise(70.0)})


@query
def dish_verdicts(spark, sf):
    """The recent readings are written once; bands stand in their rows, so nothing is joined back."""
    rows = I.measurements(spark, sf)
    path = shared_dir(spark, "recent-downloads")
    dish.recent_downloads(rows).write.parquet(path)
    recent = spark.read.parquet(path)
    return publish(
        dish.verdicts_of(_with_dish_bands(recent), recent, I.medians(spark, sf), rows))


@query
def arrival_flood(spark, sf):
    arrivals = I.readings(spark, sf).select("user_id", "ts")
    return floods.trailing_arrivals(arrivals, "user_id", "ts", 6 * 3600, 3).select(
        "user_id", F.unix_micros("ts").alias("ts_us"), "arrivals", "in_window", "over_cap"
    )


@query
def admitted_arrivals(spark, sf):
    """Arrivals under a cap where those turned away do not count."""
    arrivals = I.readings(spark, sf).select("user_id", "ts")
    found = floods.admitted_arrivals(arrivals, "user_id", "ts", 6 * 3600, 3)
    return found.select("user_id", F.unix_micros("ts").alias("ts_us"), "arrivals", "admitted")


# --- sky --------------------------------------------------------------------------


@query
def sky_view(spark, sf):
    pairs = I.label_pairs(spark, sf)
    return publish(visibility.sky_view(I.positions(spark, sf), pairs), 4)


# --- streams ----------------------------------------------------------------------


def _event_stream(spark, sf):
    I.use_utc(spark)
    schema = I.table(spark, sf, "events").schema
    return I.as_readings(ingest.file_stream(spark, sf, schema, glob="events.parquet"))


def _run(stream, spark, name):
    """Drives a stream over everything there is into a written table, and reads that."""
    out = shared_dir(spark, name)
    ingest.start_append(stream, out, f"{out}-checkpoint").awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@query
def stream_hourly_median(spark, sf):
    """The feed, driven to its end; every hour counts, the last one too."""
    return _hourly(spark, quality.valid_measurements(I.as_measurements(_event_stream(spark, sf))))


def _hourly(spark, live, again=False):
    out = shared_dir(spark, "stream-hourly")

    def run():
        ingest.start_hourly_upsert(
            live, f"{out}/raw", f"{out}/mart", f"{out}/log").awaitTermination()

    run()
    if again:
        forget_last_batch(spark, f"{out}/log")
        run()
    rows = marts.read_mart(spark, f"{out}/mart", schemas.USER_HOURLY)
    return publish(rows)


def forget_last_batch(spark, checkpoint):
    """Leaves a stream as if it had died before its last batch was noted as done."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/commits")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    last = max(int(n) for n in names if n.isdigit())
    fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/commits/{last}"), False)


@query
def stream_late_rows(spark, sf):
    """The same feed in many files: every fourth row comes twice, some come six days late.

    The last batch runs twice.
    """
    rows = quality.valid_measurements(I.as_measurements(I.readings(spark, sf)))
    folder = shared_dir(spark, "stream-files")
    number = F.col("measurement_id")
    day = F.floor(F.unix_seconds("ts") / (6 * 86_400))
    sent = F.when(number % 10 == 0, day + 1).otherwise(day)
    again = F.when(number % 4 == 0, F.array(sent, sent + 1)).otherwise(F.array(sent))
    split = shared_dir(spark, "stream-parts")
    rows.withColumn("part", F.explode(again)).write.partitionBy("part").parquet(split)
    parts = spark.read.parquet(split)
    names = sorted(r["part"] for r in parts.select("part").distinct().collect())
    for part in names:
        parts.where(F.col("part") == part).drop("part").write.mode("append").parquet(folder)
    listed = len(spark.read.schema(rows.schema).parquet(folder).inputFiles())
    feed = ingest.file_stream(
        spark, folder, rows.schema, files_per_trigger=-(-listed // len(names)))
    return _hourly(spark, feed, again=True)


@query
def stream_quarantine(spark, sf):
    rows = quality.rejected_measurements(I.as_measurements(_event_stream(spark, sf)))
    found = _run(rows.withColumn("errors", F.concat_ws(",", "errors")), spark, "stream-rejected")
    return found.select("measurement_id", "errors")


@query
def stream_below_q10(spark, sf):
    bands = I.mart(spark, sf, "user").where(F.col("target") == "dl_throughput").select(
        "h3_cell", "hour_utc", (F.col("value_median") * 0.5).alias("q10")
    )
    flagged = ingest.flag_below_q10(I.as_measurements(_event_stream(spark, sf)), bands)
    found = _run(flagged.select("measurement_id", "q10", "below_q10"), spark, "stream-below")
    return publish(found)


@query
def stream_arrivals(spark, sf):
    """Sliding counts of a feed whose last batch runs twice."""
    live = _event_stream(spark, sf).select("user_id", "ts")
    out = shared_dir(spark, "stream-arrivals")
    for turn in range(2):
        if turn:
            forget_last_batch(spark, f"{out}/log")
        ingest.start_arrival_upsert(
            live, "user_id", "6 hours", "3 hours", 2, f"{out}/raw", f"{out}/mart", f"{out}/log"
        ).awaitTermination()
    found = versions.read(spark, f"{out}/mart")
    return publish(found.select("user_id", "window_start", "arrivals", "over_cap"))


# --- model ------------------------------------------------------------------------


@query
def model_report(spark, sf):
    """Trains on each group's older hours and scores the held-out ones."""
    rows = split.stratified_split(_matrix(spark, sf))
    table = shared_dir(spark, "matrix")
    rows.write.parquet(table)
    _, report = training.train_and_evaluate(spark.read.parquet(table))
    return publish(report)


#: A small tree whose cuts are given, so that SQL can state it.
STUMP = boosting.BoostParams(
    rounds=1, depth=2, learning_rate=1.0, min_leaf=20, leaf_accuracy=None,
    features=("day_of_week", "cell_lat", "sats_visible", "cell_median_7d"),
    edges={"day_of_week": (0, 1, 2, 3, 4, 5), "cell_lat": (-40, -20, 0, 20),
           "sats_visible": (1, 3, 5, 7), "cell_median_7d": (20, 30, 40, 50, 60)})


@query
def boosted_tree(spark, sf):
    """The first boosted tree of each quantile: splits, missing directions, leaf values."""
    rows = publish(_matrix(spark, sf)).where(F.col("target") == "latency")
    booster = boosting.fit_booster(rows, STUMP)
    found = []
    for q, trees in enumerate(booster.trees):
        tree = trees[0]
        for node, feature in enumerate(tree.feature):
            parent = (node - 1) // 2
            if node and tree.feature[parent] < 0:
                continue
            inner = feature >= 0
            found.append((
                q, node, STUMP.features[feature] if inner else None,
                tree.cut[node] if inner else None, bool(tree.missing_left[node]) if inner else None,
                None if inner else float(tree.value[node]), float(booster.base[q])))
    return publish(spark.createDataFrame(
        found, "q int, node int, feature string, cut int, missing_left boolean,"
               " value double, base double"))


@query
def boosted_report(spark, sf):
    """Boosted quantiles on held-out rows, in what holds of any good model: see model_checks."""
    params = boosting.BoostParams(rounds=12, depth=3, bins=16, learning_rate=0.3)
    return _model_facts(spark, sf, params)


@query
def model_checks(spark, sf):
    """Forests on held-out rows: how many there are, bands in order, coverage near its aim."""
    return _model_facts(spark, sf, forest.ForestParams(trees=8, depth=5))


def _model_facts(spark, sf, params):
    table = shared_dir(spark, "matrix")
    split.stratified_split(_matrix(spark, sf)).write.parquet(table)
    rows = spark.read.parquet(table)
    model, report = training.train_and_evaluate(rows, params)
    test = rows.where(F.col("is_test"))
    scored = forest.score_rows(model, test).groupBy("target").agg(
        F.bool_and((F.col("q10") <= F.col("q50")) & (F.col("q50") <= F.col("q90"))).alias("in_order"))
    return report.join(scored, "target").select(
        "target", "rows", "fair_rows", "in_order",
        F.col("coverage").between(0.6, 0.95).alias("covers"),
        (F.col("q50_mae") < F.col("persistence_mae")).alias("beats_persistence"))


@query
def forecast_shape(spark, sf):
    """What the 48-hour forecast of the forests always is: whole, in order, by cell."""
    payload = quantile_forecast(spark, sf)

    def ordered(target):
        low, mid, high = (F.col(f"{target}_{b}") for b in BAND_FIELDS)
        return F.bool_and((low <= mid) & (mid <= high)).alias(f"{target}_in_order")

    return payload.groupBy("h3_cell").agg(
        F.count("*").alias("hours"), F.min("hour_utc").alias("first"),
        F.max("hour_utc").alias("last"), ordered("latency"), ordered("dl"))


@query
def quantile_forecast(spark, sf):
    """48 hours for all cells from a model trained on the marts, with takeaways' inputs."""
    return forecast_of(fitted_forests(spark, sf), spark, sf)


def fitted_forests(spark, sf, targets=None):
    table = shared_dir(spark, "matrix")
    _matrix(spark, sf).write.parquet(table)
    return forest.fit_forests(spark.read.parquet(table), targets)


def forecast_of(model, spark, sf):
    payload = serving.forecast_cells(
        model,
        I.site_cells(spark, sf),
        I.NOW,
        I.mart(spark, sf, "precip"),
        _orbital_stub(spark, sf),
        I.mart(spark, sf, "tile"),
        I.medians(spark, sf),
    )
    bands = [F.col(f"{t}.{b}").alias(f"{t}_{b}") for t in ("latency", "dl") for b in BAND_FIELDS]
    return publish(
        payload.select("h3_cell", "hour_utc", "basis", *bands, "weather.precip_mm_h")
    )


# --- readers: a table written in its raw format, then read as the jobs read it ----------


PAGE_ROWS = 500


def _pages(rows, key, item, name):
    """JSON arrays of ``PAGE_ROWS`` items at most, packed by consecutive keys."""
    page = F.floor(F.col(key) / PAGE_ROWS).alias("page")
    return rows.groupBy(page).agg(F.collect_list(item).alias(name))


@query
def probe_registry(spark, sf):
    """Pages of a probe registry as JSON, one page per file."""
    key = F.col("c_custkey")
    point = F.when(key % 17 != 0, F.array(key % 360 - 180.0, key % 170 - 85.0))
    item = F.struct(key.alias("id"), F.struct(
        F.lit("Point").alias("type"), point.alias("coordinates")).alias("geometry"))
    pages = _pages(I.table(spark, sf, "customer"), "c_custkey", item, "results")
    folder = shared_dir(spark, "raw-probes")
    pages.select("page", F.to_json(F.struct("results")).alias("value")).write.partitionBy(
        "page").text(folder)
    found = files.read_probes(spark, folder)
    return publish(found.select(
        "id", F.col("geometry.coordinates")[0].alias("lon"),
        F.col("geometry.coordinates")[1].alias("lat")))


def _ping_pages(spark, sf, value):
    event = F.col("event_id")
    item = F.struct(
        F.when(event % 101 != 0, F.col("user_id")).alias("prb_id"),
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("timestamp"),
        F.when(event % 5 != 0, F.col("value")).alias("min"))
    arrays = _pages(I.table(spark, sf, "events"), "event_id", item, "items")
    folder = shared_dir(spark, "raw-pings")
    arrays.select("page", value.alias("value")).write.partitionBy("page").text(folder)
    return folder


@query
def ping_results(spark, sf):
    """Ping results as JSON text, an array per file; items without a probe are set aside."""
    folder = _ping_pages(spark, sf, F.to_json("items"))
    rows = files.read_pings(spark, folder, shared_dir(spark, "rejected-items"))
    return publish(rows.groupBy("prb_id").agg(
        F.count("*").alias("rows"), F.count("min").alias("known"),
        F.min("timestamp").alias("first"), F.max("min").alias("worst")))


@query
def broken_files(spark, sf):
    """The same files, every third cut off in the middle: what is read and what is rejected."""
    text = F.to_json("items")
    cut = F.substring(text, F.lit(1), F.floor(F.length(text) / 2).cast("int"))
    folder = _ping_pages(spark, sf, F.when(F.col("page") % 3 == 0, cut).otherwise(text))
    rejected = shared_dir(spark, "rejected-files")
    read = files.read_pings(spark, folder, rejected).agg(F.count("*").alias("rows")).select(
        F.lit("read").alias("reason"), F.lit(None).cast("bigint").alias("page"), "rows")
    page = F.regexp_extract("file", "page=([0-9]+)", 1).cast("bigint")
    lost = spark.read.parquet(rejected).groupBy("reason", page.alias("page")).agg(
        F.count("*").alias("rows"))
    return read.unionByName(lost)


@query
def rain_fade_csv(spark, sf):
    """Rain fade measurements as CSV files with a header."""
    folder = shared_dir(spark, "raw-fade")
    rows = I.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_tax").alias("fade"), F.col("l_linestatus").alias("sky"))
    rows.write.option("header", True).csv(folder)
    schema = "l_orderkey bigint, l_linenumber int, fade double, sky string"
    return publish(files.read_rain_fade(spark, folder, schema))


@query
def tile_quarter(spark, sf):
    """One quarter of hive-style tile folders; the others are not listed."""
    folder = shared_dir(spark, "raw-tiles")
    rows = I.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.year("l_shipdate").alias("year"),
        F.quarter("l_shipdate").alias("quarter"))
    rows.repartition("year", "quarter").write.partitionBy("year", "quarter").parquet(folder)
    return publish(files.read_tiles(spark, folder, 1995, 2).select(
        "l_orderkey", "l_linenumber", "year", "quarter"))


@query
def newest_snapshot(spark, sf):
    """Two snapshots of element records; only the newer is read."""
    folder = shared_dir(spark, "raw-elements")
    key = F.col("s_suppkey")
    for stamp, step in (("20240101T000000Z", 1), ("20240102T060000Z", 2)):
        item = [
            F.col("s_name").alias("OBJECT_NAME"), (key * step).alias("NORAD_CAT_ID"),
            F.lit("2024-01-01T12:00:00.000000").alias("EPOCH"), F.lit(15.5).alias("MEAN_MOTION"),
            *[F.lit(0.5).alias(c) for c in ("ECCENTRICITY", "INCLINATION", "RA_OF_ASC_NODE",
                                            "ARG_OF_PERICENTER", "MEAN_ANOMALY", "BSTAR")]]
        records = I.table(spark, sf, "supplier").select(*item)
        records.write.json(f"{folder}/sat_gp_{stamp}.json")
    _, rows = files.latest_snapshot(spark, folder)
    return publish(rows.select("sat_id", "mean_motion", "fetched_at"))


@query
def stored_measurements(spark, sf):
    """Measurements as stored; rows without any reading are left out by the scan."""
    folder = shared_dir(spark, "raw-measurements")
    rows = I.as_measurements(I.readings(spark, sf))
    event = F.col("measurement_id")
    rows = rows.withColumns({
        "latency_ms": F.when(event % 3 != 0, F.col("latency_ms")),
        "dl_mbps": F.when(event % 4 != 0, F.col("dl_mbps"))})
    rows.write.parquet(folder)
    found = files.read_measurements(spark, folder)
    return publish(found.select("user_id", "ts", "latency_ms", "dl_mbps"))


@query
def leaf_quantiles(spark, sf):
    """Weighted leaf quantiles for a given leaf assignment: two trees over hourly latency."""
    rows = I.mart(spark, sf, "user").where(F.col("target") == "latency").select(
        F.posexplode(F.array(
            F.col("h3_cell") % 3, F.hour("hour_utc").cast("bigint") % 4)).alias("tree", "leaf"),
        "value_median", (F.col("samples") % 3 + 1).alias("w"))
    levels = dict(zip(BAND_FIELDS, (0.1, 0.5, 0.9)))
    return publish(exact_quantiles(rows, ["tree", "leaf"], "value_median", levels, weight="w"))


# --- serving ----------------------------------------------------------------------


def _horizon_features(spark, sf):
    return forecast.serving_features(
        forecast.horizon_pairs(I.site_cells(spark, sf), I.NOW),
        I.mart(spark, sf, "precip"),
        _orbital_stub(spark, sf),
        I.mart(spark, sf, "tile"),
        I.medians(spark, sf),
    )


@query
def serving_features(spark, sf):
    return publish(_horizon_features(spark, sf))


@query
def forecast_payload(spark, sf):
    """Payload rows from fixed bands, the download target untrained."""
    low = F.col("cell_median_7d")
    bands = {
        "latency_q10": low * 0.5,
        "latency_q50": low,
        "latency_q90": low * 2.0,
    }
    rows = forecast.assemble_payload(_horizon_features(spark, sf).withColumns(bands))
    return publish(
        rows.select(
            "h3_cell", "hour_utc", "basis", "latency.q10", "latency.q50", "latency.q90",
            F.col("dl").isNull().alias("no_dl"), "weather.precip_mm_h",
        )
    )


@query
def current_weather(spark, sf):
    """Now-cast payload per reading: some without the block, some without a field."""
    event = F.col("event_id")
    block = F.struct(
        F.when(event % 3 != 0, F.col("value") / 100.0).alias("precipitation"),
        F.col("k").alias("cloud_cover"),
    )
    body = F.to_json(F.struct(F.when(event % 7 != 0, block).alias("current")))
    rows = I.readings(spark, sf).select("event_id", files.current_weather(body).alias("w"))
    return publish(rows.select("event_id", "w.precip_mm_h", "w.cloud_cover_pct", "w.snow_mm_h"))


@query
def element_records(spark, sf):
    """Element text records per supplier; those that cannot be initialised drop out."""
    key = F.col("s_suppkey")
    text = lambda c: c.cast("string")
    raw = I.table(spark, sf, "supplier").select(
        F.col("s_name").alias("OBJECT_NAME"),
        F.when(key % 13 == 0, text(key + 400_000)).otherwise(text(key + 1)).alias("NORAD_CAT_ID"),
        F.lit("2024-01-01T12:00:00.000000").alias("EPOCH"),
        F.when(key % 11 == 0, "n/a").otherwise(text(F.lit(15.0) + key / 1000.0)).alias("MEAN_MOTION"),
        *[F.lit("0.5").alias(c) for c in ("ECCENTRICITY", "INCLINATION", "RA_OF_ASC_NODE",
                                          "ARG_OF_PERICENTER", "MEAN_ANOMALY", "BSTAR")],
    )
    return publish(
        files.typed_elements(raw).select("sat_id", "epoch_minute", "mean_motion", "ecc", "bstar")
    )


@query
def sky_report(spark, sf):
    """Sky, clock and weather per cell at its last label hour."""
    pairs = I.label_pairs(spark, sf).groupBy("h3_cell").agg(F.max("hour_utc").alias("hour_utc"))
    view = visibility.sky_view(I.positions(spark, sf), pairs)
    rain = I.mart(spark, sf, "precip").groupBy("h3_cell").agg(
        F.max_by("precip_mm_h", "hour_utc").alias("precip_mm_h")
    )
    return publish(visibility.sky_report(view, F.col("hour_utc"), rain), 4)


@query
def model_dish_verdicts(spark, sf):
    """All users scored against a download model trained on the marts."""
    model = fitted_forests(spark, sf, ["dl_throughput"])
    return publish(
        serving.score_dishes(
            model, I.measurements(spark, sf), _orbital_stub(spark, sf),
            I.mart(spark, sf, "tile"), I.medians(spark, sf),
        )
    )
