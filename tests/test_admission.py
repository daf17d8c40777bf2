"""Admission under a cap against the plain walk, whatever the chunks."""

import random
from collections import Counter, deque

import pytest
from helpers import at
from pyspark.sql import functions as F

from linkgrid.operators import floods


def walk(rows, span, cap):
    """(key, seconds) arrivals in order; what is turned away does not count."""
    held, taken = {}, Counter()
    for key, t in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        own = held.setdefault(key, deque())
        while own and own[0] <= t - span:
            own.popleft()
        taken[key, t] += 0
        if len(own) < cap:
            own.append(t)
            taken[key, t] += 1
    counts = Counter(rows)
    return {(k, t): (counts[k, t], n) for (k, t), n in taken.items()}


@pytest.mark.parametrize("chunk_rows", [30, 150, 1 << 20])
def test_admission_matches_the_walk(spark, chunk_rows):
    rng = random.Random(6)
    rows = [("hot", rng.randrange(2000)) for _ in range(500)]
    rows += [(f"k{rng.randrange(5)}", rng.randrange(4000)) for _ in range(150)]
    rows += [("burst", 7)] * 9 + [("edge", t) for t in (0, 60, 61, 119, 120, 121)] + [(None, 5), (None, 6)]
    frame = spark.createDataFrame(
        [(k, at(t / 3600)) for k, t in rows], "k string, ts timestamp")
    base = int(at().timestamp())
    got = floods.admitted_arrivals(frame.union(
        spark.createDataFrame([("hot", None)], frame.schema)), "k", "ts", 60, 4, chunk_rows)
    found = {(r["k"], r["t"] - base): (r["arrivals"], r["admitted"])
             for r in got.withColumn("t", F.unix_seconds("ts")).collect()}
    assert found == walk(rows, 60, 4)


def test_no_arrivals(spark):
    none = spark.createDataFrame([], "k string, ts timestamp")
    assert floods.admitted_arrivals(none, "k", "ts", 60, 4).collect() == []


def test_turned_away_arrivals_do_not_prolong_a_block(spark):
    """A steady flood is admitted cap by cap; counted by all arrivals it would be blocked for good."""
    frame = spark.createDataFrame([("a", at(i / 3600)) for i in range(300)], "k string, ts timestamp")
    got = floods.admitted_arrivals(frame, "k", "ts", 60, 5).agg(F.sum("admitted")).first()[0]
    assert got == 25
