"""Exact binomial tail as a column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P[X >= k] for X ~ Binomial(n, p), from the recurrence between neighbouring terms."""
    odds = p / (1.0 - p)
    start = F.struct(
        F.pow(F.lit(1.0 - p), n.cast("double")).alias("term"), F.lit(0.0).alias("tail")
    )

    def step(acc: Column, i: Column) -> Column:
        term = acc["term"] * (n - i + 1) / i * odds
        tail = acc["tail"] + F.when(i >= k, term).otherwise(0.0)
        return F.struct(term.alias("term"), tail.alias("tail"))

    tail = F.aggregate(F.sequence(F.lit(1).cast("bigint"), n.cast("bigint")), start, step)["tail"]
    return F.when(k <= 0, 1.0).when(k > n, 0.0).otherwise(tail)
