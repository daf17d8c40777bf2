"""Versioned tables: commits, conflicts, readers during a commit, gates, retention, clean-up."""

import glob
import os
import threading

import pytest
from helpers import at, epoch, hours_of
from pyspark.sql import functions as F

from linkgrid import schemas
from linkgrid.sources import marts, versions

KEYS = ("h3_cell", "hour_utc")


def probes(spark, rows):
    return spark.createDataFrame(rows, schemas.PROBE_HOURLY)


def test_commit_is_refused_if_another_came_first(spark, folder):
    df = probes(spark, [(1, at(), 1.0, 1)])
    parts = versions.stage(df, folder)
    first = versions.commit(spark, folder, None, df.schema, parts)
    with pytest.raises(versions.Conflict):
        versions.commit(spark, folder, None, df.schema, parts)
    assert versions.commit(spark, folder, first, df.schema, parts).number == 2
    assert versions.numbers(spark, folder) == [1, 2]
    assert not [n for n in os.listdir(f"{folder}/manifests") if n.startswith("_")]


def test_reader_sees_old_or_new(spark, folder):
    """What was read before a commit stays readable after it; a staged write is not seen."""
    versions.replace(probes(spark, [(1, at(), 1.0, 1)]), folder)
    old = versions.read(spark, folder)
    versions.stage(probes(spark, [(2, at(), 2.0, 1), (3, at(), 2.0, 1)]), folder)
    assert versions.read(spark, folder).count() == 1
    versions.replace(probes(spark, [(2, at(), 2.0, 1), (3, at(), 2.0, 1)]), folder)
    assert versions.read(spark, folder).count() == 2 and old.count() == 1
    assert versions.read(spark, folder, number=1).first()["h3_cell"] == 1


def test_upserts_at_the_same_time_lose_nothing(spark, folder):
    failed = []

    def write(cell):
        try:
            marts.upsert_mart(probes(spark, [(cell, at(h), 1.0, 1) for h in (0, 30)]), folder)
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=write, args=(c,)) for c in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed
    rows = marts.read_mart(spark, folder, schemas.PROBE_HOURLY).collect()
    assert sorted((r["h3_cell"], r["hour_utc"].day) for r in rows) == [
        (c, d) for c in range(4) for d in (at(0).day, at(30).day)]


def test_upsert_writes_touched_days_only(spark, folder):
    marts.upsert_mart(probes(spark, [(1, at(d * 24), 1.0, 1) for d in range(5)]), folder)
    before = versions.manifest(spark, folder).parts
    marts.upsert_mart(probes(spark, [(1, at(48), 9.0, 2), (2, at(49), 3.0, 1)]), folder)
    after = versions.manifest(spark, folder).parts
    changed = {d for d in after if after[d] != before.get(d)}
    assert changed == {at(48).date().isoformat()} and len(after) == 5
    got = hours_of(marts.read_mart(spark, folder, schemas.PROBE_HOURLY))
    assert (1, epoch(at(48)), 9.0, 2) in got and (2, epoch(at(49)), 3.0, 1) in got and len(got) == 6


def test_retention_is_part_of_the_commit(spark, folder):
    rows = [(1, at(h), 1.0, 1) for h in range(0, 24 * 6, 6)]
    marts.upsert_mart(probes(spark, rows), folder)
    newest = probes(spark, [(1, at(24 * 6 + 9), 1.0, 1)])
    marts.upsert_mart(newest, folder, keep_days=3)
    bound = epoch(at(24 * 6 + 9)) - 3 * 86_400
    left = sorted(r[1] for r in hours_of(marts.read_mart(spark, folder, schemas.PROBE_HOURLY)))
    assert left == [t for t in [*(epoch(r[1]) for r in rows), epoch(at(24 * 6 + 9))] if t > bound]
    assert versions.numbers(spark, folder) == [1, 2]
    late = probes(spark, [(1, at(1), 5.0, 1)])
    marts.upsert_mart(late, folder, keep_days=3)
    assert sorted(r[1] for r in hours_of(marts.read_mart(spark, folder, schemas.PROBE_HOURLY))) == left


def test_gate_counts_during_the_write(spark, folder):
    good = probes(spark, [(1, at(), 1.0, 1)])
    gate = versions.Gate(1, ("rtt_ms_median",))
    marts.write_mart(good, folder, gate=gate)
    scans = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            scans.add(b.num_rows)
            yield b

    watched = probes(spark, [(1, at(), None, 1), (2, at(), 3.0, 1)]).mapInArrow(
        counted, schemas.PROBE_HOURLY)
    with pytest.raises(versions.Rejected, match="nulls in rtt_ms_median: 0.5 against 0"):
        marts.write_mart(watched, folder, sort=(), gate=gate)
    assert scans.value == 2  # one scan for the data and the gate
    with pytest.raises(versions.Rejected, match="rows: 0 against 1"):
        marts.write_mart(good.where("h3_cell = 5"), folder, gate=gate)
    with pytest.raises(versions.Rejected, match="rows: 0 against 1"):
        marts.upsert_mart(good.limit(0), f"{folder}/new", gate=gate)
    assert hours_of(marts.read_mart(spark, folder, schemas.PROBE_HOURLY)) == [(1, epoch(at()), 1.0, 1)]
    assert len(glob.glob(f"{folder}/data/*")) == 1


def test_vacuum_keeps_what_new_versions_name(spark, folder):
    for i in range(6):
        marts.upsert_mart(probes(spark, [(i, at(24 * i), 1.0, 1)]), folder)
    assert versions.numbers(spark, folder) == [4, 5, 6]
    assert marts.read_mart(spark, folder, schemas.PROBE_HOURLY).count() == 6
    uncommitted = versions.stage(probes(spark, [(9, at(), 1.0, 1)]), folder)
    versions.vacuum(spark, folder, keep=1)
    assert os.path.isdir(f"{folder}/{uncommitted['']}")
    assert versions.read(spark, folder, days=[at(24).date().isoformat()]).count() == 1


def test_days_prune_the_scan(spark, folder):
    marts.upsert_mart(probes(spark, [(1, at(d * 24), 1.0, 1) for d in range(9)]), folder)
    rows = marts.read_mart(spark, folder, schemas.PROBE_HOURLY)
    assert len(rows.inputFiles()) == 9
    few = versions.read(spark, folder, days=[at(24).date().isoformat()])
    assert len(few.inputFiles()) == 1 and few.columns[-1] == "date"
    plan = versions.read(spark, folder).where(F.col("date") == at(24).date())
    assert "PartitionFilters: [isnotnull(date" in plan._jdf.queryExecution().executedPlan().toString()


def test_no_version_yet(spark, folder):
    assert marts.read_mart(spark, f"{folder}/none", schemas.ACTIVE_CELLS).count() == 0
    with pytest.raises(FileNotFoundError):
        versions.read(spark, f"{folder}/none")
    without_time = probes(spark, [(1, None, 1.0, 1)])
    marts.upsert_mart(without_time, f"{folder}/none")
    assert versions.numbers(spark, f"{folder}/none") == []
