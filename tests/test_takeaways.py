"""Cases with known answers, and random horizons against a plain rule written here."""

import random

import pytest
from helpers import at, epoch
from pyspark.sql import functions as F

from linkgrid.operators.takeaways import takeaways

SCHEMA = (
    "h3_cell bigint, hour_utc timestamp, latency_q10 double, latency_q50 double, latency_q90 double,"
    "dl_q50 double, precip_mm_h double, basis string, lon double, latency_median double, dl_median double"
)


def horizon(cell=1, lat=None, dl=None, rain=None, width=0.4, basis="cell", lon=0.0,
            lat_median=30.0, dl_median=100.0, n=48):
    rows = []
    for i in range(n):
        q = 30.0 if lat is None else lat.get(i, 30.0)
        d = 100.0 if dl is None else dl.get(i, 100.0)
        p = 0.0 if rain is None else rain.get(i, 0.0)
        low, high = (None, None) if q is None else (q * (1 - width / 2), q * (1 + width / 2))
        rows.append((cell, at(i), low, q, high, d, p, basis, lon, lat_median, dl_median))
    return rows


def run(spark, rows):
    df = takeaways(spark.createDataFrame(rows, SCHEMA))
    wins = F.transform("windows", lambda w: F.struct(
        w["kind"], F.unix_seconds(w["start"]), F.unix_seconds(w["end"]), w["severity"], w["detail"]))
    got = {}
    for r in df.select("h3_cell", "verdict", "headline", "confidence", wins.alias("w")).collect():
        got[r["h3_cell"]] = (r["verdict"], r["headline"], r["confidence"], [tuple(w) for w in r["w"]])
    return got


def test_known_horizons(spark):
    nan = None
    cases = {
        1: horizon(1),
        2: horizon(2, dl={20: 70.0, 21: 60.0, 22: 70.0}),
        3: horizon(3, dl={20: 50.0}),
        4: horizon(4, dl={46: 70.0, 47: 75.0}),
        5: horizon(5, dl={20: 70.0, 21: 75.0}, rain={19: 1.0, 20: 1.0}),
        6: horizon(6, rain={19: 1.0, 20: 1.0}),
        7: horizon(7, width=1.0),
        8: horizon(8, lat_median=nan, dl_median=nan, dl={20: 10.0, 21: 10.0}),
        9: horizon(9, dl={20: 80.0, 21: 80.0}, lat={5: 37.5, 6: 37.5}),
        10: horizon(10, lat={7: None}),
        11: horizon(11, lat={i: 10.0 for i in (30, 31, 32)}),
        12: horizon(12, lat={3: 40.0, 4: 60.0}, dl={3: 70.0, 4: 79.0}, basis="region"),
        13: horizon(13, n=2, lat={0: 60.0, 1: 60.0}),
        14: horizon(14, dl={20: 70.0, 21: 70.0}, rain={19: 0.5, 20: 0.5}),
    }
    got = run(spark, [r for rows in cases.values() for r in rows])
    kinds = {c: [w[0] for w in v[3]] for c, v in got.items()}
    assert got[1][0] == "smooth" and got[1][2] == "high" and kinds[1] == ["best"]
    assert got[1][3][0][1:3] == (epoch(at(0)), epoch(at(3)))
    assert got[2][0] == "rough" and got[2][1].endswith("Monday evening")
    assert got[2][3][0][1:] == (epoch(at(20)), epoch(at(23)), "notable", "downloads ~40% below your area's normal")
    assert got[3][0] == "smooth"
    assert got[4][3][0][1:3] == (epoch(at(46)), epoch(at(48))) and got[4][0] == "mixed"
    assert kinds[5] == ["congestion", "rain", "best"] and got[5][1].endswith("(+1 more)")
    # Both are mild, so the earlier one (the rain) is named.
    assert got[5][3][1][1:3] == (epoch(at(19)), epoch(at(21)))
    assert kinds[6] == ["best"]
    assert got[7][2] == "medium"
    assert got[8][0] == "smooth" and got[8][2] == "low"
    assert kinds[9] == ["best"]
    assert kinds[10] == []
    assert got[11][3][-1][1] == epoch(at(30))
    assert got[12][3][0][3:] == ("notable", "latency ~100% above your area's normal")
    assert got[12][2] == "medium" and got[12][0] == "mixed"
    assert kinds[13] == ["congestion"]
    assert kinds[14] == ["congestion", "best"]


def plain_windows(rows):
    """Runs by walking the hours one by one."""
    flags = []
    for r in rows:
        lat, dl, lat_m, dl_m = r[3], r[5], r[9], r[10]
        bad = 0.0
        if dl_m and dl / dl_m < 0.8:
            bad = max(bad, 1 - dl / dl_m)
        if lat_m and lat / lat_m > 1.25:
            bad = max(bad, lat / lat_m - 1)
        notable = bool(dl_m and dl / dl_m < 0.65) or bool(lat_m and lat / lat_m > 1.5)
        flags.append((bad > 0, notable, r[6] > 0.5))
    def runs(k):
        out, start = [], None
        for i, f in enumerate(flags + [(False, False, False)]):
            if f[k] and start is None:
                start = i
            if not f[k] and start is not None:
                out.append((start, i))
                start = None
        return out
    jams = [(a, b) for a, b in runs(0) if b - a >= 2]
    wet = [(a, b) for a, b in runs(2) if any(a < d and c < b for c, d in jams)]
    problems = [("congestion", a, b, any(f[1] for f in flags[a:b])) for a, b in jams]
    problems += [("rain", a, b, False) for a, b in wet]
    sums = [sum(r[3] for r in rows[i:i + 3]) for i in range(46)]
    verdict = "smooth" if not problems else (
        "rough" if any(s and b - a >= 3 for _, a, b, s in problems) else "mixed")
    return verdict, problems, sums.index(min(sums))


def test_random_horizons(spark):
    rng = random.Random(11)
    cells = {}
    for cell in range(40):
        pick = lambda *v: {i: float(rng.choice(v)) for i in range(48)}
        cells[cell] = horizon(
            cell, pick(30, 31, 36, 39, 50), pick(100, 90, 81, 79, 60), pick(0, 0, 0.4, 2),
            lat_median=rng.choice([30.0, None]), dl_median=rng.choice([100.0, None, 0.0]),
        )
    got = run(spark, [r for rows in cells.values() for r in rows])
    for cell, rows in cells.items():
        verdict, problems, best = plain_windows(rows)
        want = [(k, epoch(at(a)), epoch(at(b)), "notable" if s else "mild") for k, a, b, s in problems]
        assert got[cell][0] == verdict
        assert [w[:4] for w in got[cell][3][:-1]] == want
        assert got[cell][3][-1][1] == epoch(at(best))


@pytest.mark.parametrize("basis, level", [("cell", "high"), ("region", "medium"), ("latitude_prior", "low"), ("?", "low")])
def test_confidence_by_basis(spark, basis, level):
    assert run(spark, horizon(basis=basis))[1][2] == level


def test_arrivals_of_a_busy_key_match_a_plain_count(spark):
    import random

    from pyspark.sql import functions as F

    from linkgrid.operators.floods import trailing_arrivals

    rng = random.Random(3)
    times = [rng.randrange(0, 4 * 3600) * 1_000_000 for _ in range(600)]
    times += [t + 3_600_000_000 for t in times[:100]]  # exactly one window later
    rows = spark.createDataFrame([(1, t) for t in times] + [(2, 5), (None, 7)], "k long, t long")
    out = trailing_arrivals(
        rows.select("k", F.timestamp_micros("t").alias("ts")), "k", "ts", 3600, 3)
    got = {r.t: (r.arrivals, r.in_window) for r in out.where("k = 1").select(
        F.unix_micros("ts").alias("t"), "arrivals", "in_window").collect()}
    for t in set(times):
        inside = sum(t - 3_600_000_000 < x <= t for x in times)
        assert got[t] == (times.count(t), inside)
    assert out.where("k is null").count() == 1
