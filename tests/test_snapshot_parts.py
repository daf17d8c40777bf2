import os

from helpers import at, epoch
from pyspark.sql import functions as F

from linkgrid.sources import files


def test_newest_snapshot_in_several_files(spark, folder):
    record = ["'S' AS OBJECT_NAME", "'2026-07-06T01:30:00' AS EPOCH", "15.5 AS MEAN_MOTION",
              *[f"0.5 AS {c}" for c in ("ECCENTRICITY", "INCLINATION", "RA_OF_ASC_NODE",
                                        "ARG_OF_PERICENTER", "MEAN_ANOMALY", "BSTAR")]]
    for stamp, n in (("20260705T000000Z", 3), ("20260706T020000Z", 40)):
        rows = spark.range(n).repartition(4).selectExpr("id AS NORAD_CAT_ID", *record)
        rows.write.json(f"{folder}/sat_gp_{stamp}.json")
    os.mkdir(f"{folder}/sat_gp_20260707T000000Z.json")  # still being written
    path, found = files.latest_snapshot(spark, folder)
    assert path.endswith("20260706T020000Z.json")
    got = found.select("sat_id", F.unix_seconds("fetched_at").alias("f")).collect()
    assert sorted(r.sat_id for r in got) == list(range(40))
    assert {r.f for r in got} == {epoch(at(2))}
