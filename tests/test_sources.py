import json
import os

import pytest
from helpers import at, epoch, hours_of
from pyspark.sql import functions as F

from linkgrid import schemas
from linkgrid.operators import bandcache
from linkgrid.sources import files, marts


def put(folder, name, content):
    path = os.path.join(folder, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(content if isinstance(content, str) else json.dumps(content))
    return path


def test_pings_as_list_or_page(spark, folder):
    a = [{"prb_id": 1, "timestamp": 5, "min": 2.5}, {"prb_id": 2, "timestamp": 6}]
    put(folder, "a.json", a)
    put(folder, "b.json", {"results": a[:1], "next": None})
    rows = sorted(tuple(r) for r in files.read_pings(spark, folder).fillna(-9.0).collect())
    assert rows == [(1, 5, 2.5), (1, 5, 2.5), (2, 6, -9.0)]


def test_probes(spark, folder):
    put(folder, "p.json", {"results": [{"id": 1, "geometry": {"type": "Point", "coordinates": [8, 52.5]}}, {"id": 2, "geometry": None}]})
    rows = files.read_probes(spark, folder).orderBy("id").collect()
    assert rows[0]["geometry"]["coordinates"] == [8.0, 52.5] and rows[1]["geometry"] is None


def test_weather_arrays(spark, folder):
    body = {"hourly": {"time": ["2026-07-06T00:00", "2026-07-06T01:00", "2026-07-06T02:00"], "precipitation": [0.5, None]}}
    put(folder, "h3_cell=7/w.json", body)
    rows = files.hourly_weather(files.read_weather(spark, folder))
    assert hours_of(rows) == sorted([(7, epoch(at(0)), 0.5), (7, epoch(at(1)), 0.0)])
    texts = spark.createDataFrame([(1, json.dumps(body)), (2, "{}"), (3, "broken")], "h3_cell bigint, body string")
    assert files.hourly_weather(files.parse_weather(texts, "body")).count() == 2


def test_current_weather(spark):
    rows = ['{"current": {"precipitation": 1.5, "cloud_cover": 40}}', "{}"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in rows], "b string").select(files.current_weather(F.col("b"))).collect()]
    assert tuple(got[0]) == (1.5, 40.0, 0.0) and got[1] is None


def record(number, **kw):
    base = {"OBJECT_NAME": f"S{number}", "NORAD_CAT_ID": number, "EPOCH": "2026-07-06T01:30:00.000000", "MEAN_MOTION": 15.06,
            "ECCENTRICITY": 0.0001, "INCLINATION": 53.0, "RA_OF_ASC_NODE": 10.0, "ARG_OF_PERICENTER": 20.0,
            "MEAN_ANOMALY": 30.0, "BSTAR": 1e-4}
    return {**base, **kw}


def test_newest_snapshot_and_bad_records(spark, folder):
    assert files.latest_snapshot(spark, folder) is None
    put(folder, "sat_gp_20260705T000000Z.json", [record(1)])
    put(folder, "sat_gp_20260706T020000Z.json",
        [record(44), record(400000), record("x1"), record(45, MEAN_MOTION="oops"), record(46, BSTAR="2e-5")])
    path, rows = files.latest_snapshot(spark, folder)
    assert path.endswith("20260706T020000Z.json")
    got = {r["sat_id"]: r for r in rows.withColumn("f", F.unix_seconds("fetched_at")).collect()}
    assert set(got) == {44, 46, 400000}
    assert got[44]["f"] == epoch(at(2)) and got[44]["epoch_minute"] == epoch(at(1.5)) / 60
    assert got[46]["bstar"] == 2e-5


def test_rain_fade_csv(spark, folder):
    with pytest.raises(FileNotFoundError):
        files.read_rain_fade(spark, folder)
    put(folder, "a.csv", "t,rtt,rain\n1,20.5,0\n2,30.5,1\n")
    put(folder, "b.csv", "t,rtt,rain\n3,40.5,2\n")
    assert files.read_rain_fade(spark, folder).agg(F.sum("rtt")).first()[0] == 91.5
    assert files.read_rain_fade(spark, folder, "t int, rtt double, rain double").count() == 3


def test_quarter_partitions(spark, folder):
    df = spark.createDataFrame([("a", 2024, 1), ("b", 2024, 2)], "tile string, year int, quarter int")
    df.write.partitionBy("year", "quarter").parquet(f"{folder}/tiles")
    assert [r["tile"] for r in files.read_tiles(spark, f"{folder}/tiles", 2024, 2).collect()] == ["b"]
    with pytest.raises(ValueError):
        files.quarter_path("x", 2024, 5)


def test_marts(spark, folder):
    path = f"{folder}/mart"
    assert marts.read_mart(spark, path, schemas.PROBE_HOURLY).count() == 0
    rows = spark.createDataFrame([(1, at(), 20.0, 2)], schemas.PROBE_HOURLY)
    marts.write_mart(rows, path, schema=schemas.PROBE_HOURLY)
    again = marts.read_mart(spark, path, schemas.PROBE_HOURLY)
    # A job may read the mart it replaces.
    marts.write_mart(again.unionByName(rows.withColumn("h3_cell", F.lit(2).cast("bigint"))), path)
    assert marts.read_mart(spark, path, schemas.PROBE_HOURLY).count() == 2
    marts.write_mart(rows.limit(0), path)
    assert marts.read_mart(spark, path, schemas.PROBE_HOURLY).count() == 0
    assert os.listdir(folder) == ["mart"]


def test_text_files(spark, folder):
    assert marts.read_text(spark, f"{folder}/x/P") is None
    marts.write_text(spark, f"{folder}/x/P", "v1")
    marts.write_text(spark, f"{folder}/x/P", "v2")
    assert marts.read_text(spark, f"{folder}/x/P") == "v2"


def test_measurements_read(spark, folder):
    rows = [("u", at(), 1, "browser", lat, dl, None, None, None) for lat, dl in ((1.0, None), (None, 2.0), (None, None))]
    spark.createDataFrame(rows, schemas.MEASUREMENTS).write.parquet(f"{folder}/m")
    df = files.read_measurements(spark, f"{folder}/m")
    assert df.count() == 2
    assert "PushedFilters: [Or(" in df._jdf.queryExecution().executedPlan().toString()


def test_band_cache(spark):
    cache = spark.createDataFrame(
        [
            (1, at(0), "latency", 1.0, 2.0, 3.0, "cell", "v2"),
            (1, at(1), "latency", 1.0, 2.0, 3.0, "cell", "v1"),
            (1, at(2), "dl", 5.0, 6.0, 7.0, "region", "v2"),
            (9, at(0), "dl", 5.0, 6.0, 7.0, "region", "v2"),
        ],
        schemas.BAND_CACHE,
    )
    wanted = spark.createDataFrame([(1, at(h)) for h in range(3)], "h3_cell bigint, hour_utc timestamp")
    got = {r["s"]: r for r in bandcache.cached_payload(cache, wanted, "v2").withColumn("s", F.unix_seconds("hour_utc")).collect()}
    assert set(got) == {epoch(at(0)), epoch(at(2))}
    assert got[epoch(at(0))]["dl"] is None and got[epoch(at(2))]["dl"]["q50"] == 6.0
    assert hours_of(bandcache.missing_pairs(cache, wanted, "v2")) == [(1, epoch(at(1)))]
    payload = spark.createDataFrame(
        [(1, at(0), "prior", (10.0, 20.0, 30.0), None)],
        "h3_cell bigint, hour_utc timestamp, basis string, latency struct<q10:double,q50:double,q90:double>, dl struct<q10:double,q50:double,q90:double>",
    )
    fresh = bandcache.payload_bands(payload, "v3")
    assert fresh.count() == 1
    merged = bandcache.upsert_bands(cache, fresh)
    assert merged.count() == 4 and merged.where("model_version = 'v3'").first()["q50"] == 20.0


def test_broken_files_are_named(spark, folder):
    """One whole file, one cut off, one page, and an item without its key."""
    import json

    texts = {
        "a.json": json.dumps([{"prb_id": 1, "timestamp": 5, "min": 2.0}, {"timestamp": 6, "min": 1.0}]),
        "b.json": json.dumps([{"prb_id": 2, "timestamp": 5, "min": 2.0}] * 3)[:-20],
        "c.json": json.dumps({"results": [{"prb_id": 3, "timestamp": 7, "min": None}]}),
    }
    for name, text in texts.items():
        marts.write_text(spark, f"{folder}/in/{name}", text)
    rows = files.read_pings(spark, f"{folder}/in", f"{folder}/rejected")
    assert sorted(r["prb_id"] for r in rows.collect()) == [1, 3]
    lost = {(os.path.basename(r["file"]), r["reason"]): r["text"]
            for r in spark.read.parquet(f"{folder}/rejected").collect()}
    assert set(lost) == {("a.json", "no prb_id"), ("b.json", "not parsed")}
    assert lost["b.json", "not parsed"] == texts["b.json"]
    with pytest.raises(Exception, match="b.json: not parsed|a.json: no prb_id"):
        files.read_pings(spark, f"{folder}/in").collect()


def test_weather_that_cannot_be_parsed_says_so(spark):
    bodies = [(1, '{"hourly": {"time": ["2024-01-01T00:00"], "precipitation": [1.0]}}'),
              (2, '{"hourly": {"time": ["2024'), (3, "{}")]
    parsed = files.parse_weather(spark.createDataFrame(bodies, "id int, body string"), "body", "reason")
    assert {r["id"]: r["reason"] for r in parsed.collect()} == {
        1: None, 2: "not parsed", 3: "no hourly block"}
    assert files.hourly_weather(parsed.drop("reason")).count() == 1


def test_stored_band_cache(spark, folder):
    row = lambda h, v, q: (1, at(h), "latency", 1.0, q, 3.0, "cell", v)
    frame = lambda rows: spark.createDataFrame(rows, schemas.BAND_CACHE)
    bandcache.store_bands(frame([row(0, "v1", 2.0), row(1, "v1", 2.0), row(50, "v1", 2.0)]), folder)
    bandcache.store_bands(frame([row(1, "v2", 9.0), row(2, "v2", 9.0)]), folder)
    got = {r["s"]: (r["model_version"], r["q50"]) for r in bandcache.stored_bands(
        spark, folder).withColumn("s", F.unix_seconds("hour_utc")).collect()}
    assert got == {epoch(at(0)): ("v1", 2.0), epoch(at(1)): ("v2", 9.0), epoch(at(2)): ("v2", 9.0),
                   epoch(at(50)): ("v1", 2.0)}
