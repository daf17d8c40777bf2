"""Polygon text to centroid, in columns.

Arrays are walked by folds whose lambdas only look at bound variables: a lambda that names the
array expression itself would rebuild it for every element.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _named(**fields: Column) -> Column:
    return F.struct(*[c.alias(n) for n, c in fields.items()])


def _rings(wkt: Column) -> Column:
    """Polygon text as arrays of [x, y] points, rewritten as JSON and parsed in one go."""
    pairs = F.regexp_replace(wkt, r"([-+.0-9eE]+)\s+([-+.0-9eE]+)", r"[$1,$2]")
    body = F.translate(F.regexp_replace(pairs, r"^\s*(?i:polygon)\s*", ""), "()", "[]")
    return F.from_json(body, "array<array<array<double>>>")


def _ring_moments(ring: Column) -> Column:
    """Area, centroid and vertex mean of one ring (a bound lambda variable) of points.

    Coordinates are taken relative to the first vertex, so tiny far-away squares keep their
    precision.
    """
    zero = F.lit(0.0)
    ox, oy = ring[0][0], ring[0][1]
    local = F.transform(ring, lambda p: _named(x=p[0] - ox, y=p[1] - oy))

    def step(s: Column, p: Column) -> Column:
        cross = s["x"] * p["y"] - p["x"] * s["y"]
        return _named(
            x=p["x"],
            y=p["y"],
            a=s["a"] + cross,
            mx=s["mx"] + cross * (s["x"] + p["x"]),
            my=s["my"] + cross * (s["y"] + p["y"]),
        )

    def finish(s: Column) -> Column:
        return _named(
            area=F.abs(s["a"]) / 2.0,
            cx=ox + F.try_divide(s["mx"], s["a"] * 3.0),
            cy=oy + F.try_divide(s["my"], s["a"] * 3.0),
            vx=F.when(s["a"] == 0, _mean(ring, 0)),
            vy=F.when(s["a"] == 0, _mean(ring, 1)),
        )

    return F.aggregate(local, _named(x=zero, y=zero, a=zero, mx=zero, my=zero), step, finish)


def _mean(ring: Column, axis: int) -> Column:
    total = F.aggregate(ring, F.lit(0.0), lambda t, p: t + p[axis])
    return F.try_divide(total, F.size(ring).cast("double"))


def polygon_centroid(wkt: Column) -> Column:
    """Area-weighted centroid ``struct<lon, lat>`` of a POLYGON text, NULL for other text.

    Rings after the first are holes. A ring without area answers with its vertex mean.
    """
    rings = F.transform(_rings(wkt), _ring_moments)
    none, zero = F.lit(None).cast("double"), F.lit(0.0)
    start = _named(first=F.lit(True), a=zero, x=zero, y=zero, vx=none, vy=none)

    def step(s: Column, r: Column) -> Column:
        signed = F.when(s["first"], r["area"]).otherwise(-r["area"])
        return _named(
            first=F.lit(False),
            a=s["a"] + signed,
            x=s["x"] + signed * F.coalesce(r["cx"], F.lit(0.0)),
            y=s["y"] + signed * F.coalesce(r["cy"], F.lit(0.0)),
            vx=F.coalesce(s["vx"], r["vx"]),
            vy=F.coalesce(s["vy"], r["vy"]),
        )

    def finish(s: Column) -> Column:
        return _named(
            lon=F.coalesce(F.try_divide(s["x"], s["a"]), s["vx"]),
            lat=F.coalesce(F.try_divide(s["y"], s["a"]), s["vy"]),
        )

    return F.aggregate(rings, start, step, finish)
