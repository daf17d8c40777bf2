"""Gates on marts, and row-level validation of measurements."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkgrid.sources.versions import Rejected

# Measurement sources that are accepted, and the size of one batch.
MEASUREMENT_SOURCES = ("reporter", "browser")
BATCH_ROWS = (1, 1000)


def null_rates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: row count and the share of NULLs per column (0 for an empty mart)."""
    rate = lambda c: F.coalesce(F.avg(F.col(c).isNull().cast("double")), F.lit(0.0))
    return df.agg(
        F.count(F.lit(1)).alias("rows"), *[rate(c).alias(f"{c}_null_rate") for c in columns]
    )


def broken_rules(
    df: DataFrame, required: Sequence[str], min_rows: int, max_null_rate: float = 0.0
) -> DataFrame:
    """One row per gate that ``df`` fails: rule, the measure found, and its limit."""
    measured = null_rates(df, required)
    gates = [F.struct(
        F.lit("rows").alias("rule"), F.col("rows").cast("double").alias("found"),
        F.lit(float(min_rows)).alias("allowed"), (F.col("rows") < min_rows).alias("broken"))]
    for column in required:
        rate = F.col(f"{column}_null_rate")
        gates.append(F.struct(
            F.lit(f"nulls in {column}").alias("rule"), rate.alias("found"),
            F.lit(float(max_null_rate)).alias("allowed"), (rate > max_null_rate).alias("broken")))
    listed = measured.select(F.explode(F.array(*gates)).alias("g")).where("g.broken")
    return listed.select("g.rule", "g.found", "g.allowed")


#: A mart that may not replace the one before it.
MartRejected = Rejected


def pass_gate(
    df: DataFrame, required: Sequence[str], min_rows: int, max_null_rate: float = 0.0
) -> None:
    """Raise with all broken rules at once; no rule broken, no word."""
    broken = broken_rules(df, required, min_rows, max_null_rate).collect()
    if broken:
        raise MartRejected("; ".join(f"{r.rule}: {r.found:g} against {r.allowed:g}" for r in broken))


def _bad(column: str, low: float, high: float | None = None) -> Column:
    c = F.col(column)
    wrong = (c < low) if high is None else (c < low) | (c > high)
    return F.when(c.isNotNull() & (wrong | F.isnan(c)), F.lit(column))


def check_measurements(df: DataFrame) -> DataFrame:
    """Rows with ``errors``: names of the fields that break a rule (empty when valid)."""
    missing = [F.when(F.col(c).isNull(), F.lit(c)) for c in ("ts", "h3_cell")]
    source_ok = F.col("source").isin(*MEASUREMENT_SOURCES)
    source = F.when(~F.coalesce(source_ok, F.lit(False)), F.lit("source"))
    rules = [
        *missing,
        source,
        _bad("latency_ms", 0.0),
        _bad("dl_mbps", 0.0),
        _bad("ul_mbps", 0.0),
        _bad("obstruction_pct", 0.0, 100.0),
    ]
    return df.withColumn("errors", F.array_compact(F.array(*rules)))


def valid_measurements(df: DataFrame) -> DataFrame:
    return check_measurements(df).where(F.size("errors") == 0).drop("errors")


def rejected_measurements(df: DataFrame) -> DataFrame:
    return check_measurements(df).where(F.size("errors") > 0)


def check_batches(df: DataFrame, batch: str = "batch_id") -> DataFrame:
    """One row per batch: size, bad rows, and whether the whole batch is accepted."""
    low, high = BATCH_ROWS
    sizes = check_measurements(df).groupBy(batch).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.size("errors") > 0).alias("bad_rows"),
    )
    return sizes.withColumn(
        "accepted", F.col("rows").between(low, high) & (F.col("bad_rows") == 0)
    )
