"""Keys whose arrivals in a trailing window exceed a cap."""

from __future__ import annotations

from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkgrid.session import shared_dir

#: Instants of one session that a task walks through at a time.
CHUNK_ROWS = 1 << 20
#: Divides a million, so that a window of whole seconds is a whole number of slices.
SLICES = 320


def trailing_arrivals(
    arrivals: DataFrame, key: str, ts: str, window_seconds: int, cap: int
) -> DataFrame:
    """One row per (key, instant): arrivals at it, in the window ending with it, and a flag.

    The window is open at its old end. Time is cut into slices, SLICES to a window. Whole
    slices inside a window are summed from slice totals (combined before the shuffle); only
    the two slices at its ends are counted row by row. There each instant meets its own slice
    and, moved forward by one window, the slice in which it leaves. So a window function sees
    one slice of a key, or the slice totals of two windows, however busy the key is.
    """
    span = window_seconds * 1_000_000
    width = span // SLICES
    counted = arrivals.groupBy(F.col(key).alias("__k"), F.unix_micros(ts).alias("__t")).agg(
        F.count(F.lit(1)).alias("arrivals")
    )
    slice_of = lambda t: F.floor(t / F.lit(width)).cast("bigint")
    group = F.struct("__k").alias("__g")
    totals = counted.groupBy(group, slice_of(F.col("__t")).alias("__s")).agg(
        F.sum("arrivals").alias("__n")
    )
    # Each slice total is sent to its own block of slices and to the next one.
    block = F.floor(F.col("__s") / SLICES).cast("bigint")
    near = W.partitionBy("__g", "__block").orderBy("__s").rangeBetween(1 - SLICES, -1)
    inner = (
        totals.withColumn("__own", block)
        .withColumn("__block", F.explode(F.array(F.col("__own"), F.col("__own") + 1)))
        .withColumn("__inner", F.coalesce(F.sum("__n").over(near), F.lit(0)))
        .where(F.col("__own") == F.col("__block"))
        .select("__g", "__s", "__inner")
    )
    moves = counted.select(
        group,
        "__t",
        "arrivals",
        F.explode(F.array(
            F.struct(F.col("__t").alias("at"), F.lit(True).alias("comes")),
            F.struct((F.col("__t") + span).alias("at"), F.lit(False).alias("comes")),
        )).alias("__m"),
    ).withColumn("__s", slice_of(F.col("__m.at")))
    # Leaving happens before coming at the same instant: the window is open at its old end.
    edge = W.partitionBy("__g", "__s")
    upto = edge.orderBy("__m").rowsBetween(W.unboundedPreceding, W.currentRow)
    comes = F.when(F.col("__m.comes"), F.col("arrivals")).otherwise(F.lit(0))
    leaves = F.when(~F.col("__m.comes"), F.col("arrivals")).otherwise(F.lit(0))
    ends = (
        moves.withColumns({
            "__edge": F.sum(comes - leaves).over(upto) + F.sum(leaves).over(edge),
        })
        .where("__m.comes")
        .select("__g", "__s", "__t", "arrivals", "__edge")
    )
    return (
        ends.join(inner, ["__g", "__s"])
        .withColumn("in_window", F.col("__edge") + F.col("__inner"))
        .withColumn(key, F.col("__g.__k"))
        .select(
            key,
            F.timestamp_micros("__t").alias(ts),
            "arrivals",
            "in_window",
            (F.col("in_window") > cap).alias("over_cap"),
        )
    )


def _chunked(arrivals: DataFrame, key: str, ts: str, span: int, chunk_rows: int) -> DataFrame:
    """(k, t, arrivals, session, chunk): instants of a key, cut into sessions and chunks.

    A session begins after a gap of a whole window, when nothing admitted before counts any
    more. Gaps are found within slices of time, and between slices on one row for each; so no
    window function sees more than a slice of a key, or its slices.
    """
    counted = arrivals.groupBy(F.col(key).alias("k"), F.unix_micros(ts).alias("t")).agg(
        F.count(F.lit(1)).alias("arrivals")).withColumn("s", F.floor(F.col("t") / F.lit(span)))
    group = F.struct("k").alias("g")  # a null key is a key as well
    counted = counted.select(group, "t", "arrivals", "s")
    slices = counted.groupBy("g", "s").agg(
        F.min("t").alias("first"), F.max("t").alias("last"), F.count("*").alias("n"))
    along = W.partitionBy("g").orderBy("s")
    slices = slices.withColumns({
        "before": F.lag("last").over(along), "rows": F.sum("n").over(along) - F.col("n")})
    own = W.partitionBy("g", "s").orderBy("t")
    rows = counted.join(slices.select("g", "s", "before", "rows"), ["g", "s"])
    gap = F.col("t") - F.coalesce(F.lag("t").over(own), F.col("before"))
    place = F.col("rows") + F.row_number().over(own)
    starts = rows.withColumns({"starts": F.coalesce(gap >= span, F.lit(True)), "place": place})
    # The session of a row: the start of the newest session up to it, in its slice or before.
    begun = F.max(F.when(F.col("starts"), F.struct("t", "place")))
    newest = starts.groupBy("g", "s").agg(begun.alias("begun")).select(
        "g", "s", F.max("begun").over(
            along.rowsBetween(W.unboundedPreceding, -1)).alias("earlier"))
    upto = own.rowsBetween(W.unboundedPreceding, W.currentRow)
    return starts.withColumn("begun", begun.over(upto)).join(newest, ["g", "s"]).withColumn(
        "begun", F.coalesce("begun", "earlier")).select(
        F.col("g.k").alias("k"), "t", "arrivals", F.col("begun.t").alias("session"),
        F.floor((F.col("place") - F.col("begun.place")) / F.lit(chunk_rows)).alias("chunk"))


def admitted_arrivals(
    arrivals: DataFrame, key: str, ts: str, window_seconds: int, cap: int,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """One row per (key, instant): arrivals at it, and how many of them are admitted.

    An arrival is admitted while fewer than ``cap`` admitted ones of its key lie in the window
    that ends with it (open at its old end); turned away, it does not count for later ones. So
    each decision needs those before it, in order. Sessions of a key are independent of each
    other and are walked in parallel; a session longer than ``chunk_rows`` instants is walked
    in rounds, one chunk after the other, and all that a round hands on is the last admitted
    instants, ``cap`` at most. Null keys count as one key; rows without a time are left out.
    """
    spark = arrivals.sparkSession
    span = window_seconds * 1_000_000
    path = shared_dir(spark, "arrival-chunks")
    chunked = _chunked(arrivals.where(F.col(ts).isNotNull()), key, ts, span, chunk_rows)
    chunked.write.partitionBy("chunk").parquet(path)
    rows = spark.read.schema(chunked.schema).parquet(path)
    kind = dict(chunked.dtypes)["k"]
    chunks = sorted(r["chunk"] for r in rows.select("chunk").distinct().collect())
    decided = f"k {kind}, session bigint, t bigint, arrivals bigint, admitted bigint"

    def walk(batches):
        """Rows by session and time; those with ``admitted`` were decided in an earlier round."""
        session, held, inside = object(), deque(), 0
        for batch in batches:
            use, out = [], []
            columns = (batch[n].to_pylist() for n in ("k", "session", "t", "arrivals", "admitted"))
            for k, begun, t, n, known in zip(*columns):
                if (k, begun) != session:
                    session, held, inside = (k, begun), deque(), 0
                while held and held[0][0] <= t - span:
                    inside -= held.popleft()[1]
                taken = known if known is not None else max(min(n, cap - inside), 0)
                if taken:
                    held.append((t, taken))
                    inside += taken
                use.append(known is None)
                out.append(taken)
            decided_now = batch.set_column(
                batch.schema.get_field_index("admitted"), "admitted", pa.array(out, pa.int64()))
            yield decided_now.filter(pa.array(use, pa.bool_()))

    parts, state = [], spark.createDataFrame([], decided)
    for chunk in chunks:
        now = rows.where(F.col("chunk") == chunk).select("k", "session", "t", "arrivals")
        # A task streams through its sessions; none is held in memory.
        done = (
            state.unionByName(now.withColumn("admitted", F.lit(None).cast("bigint")))
            .repartition("k", "session").sortWithinPartitions("k", "session", "t")
            .mapInArrow(walk, decided)
        )
        out = shared_dir(spark, "arrival-walked")
        done.write.parquet(out)
        done = spark.read.schema(decided).parquet(out)
        parts.append(out)
        # What still counts: the admitted of the last window of each session, ``cap`` at most.
        if chunk == chunks[-1]:
            break
        ends = now.groupBy("k", "session").agg(F.max("t").alias("end"))
        both = state.union(done.where("admitted > 0"))
        left = both.join(
            ends, both["k"].eqNullSafe(ends["k"]) & (both["session"] == ends["session"])
        ).where(F.col("t") > F.col("end") - span).select(
            both["k"], both["session"], "t", "arrivals", "admitted")
        kept = shared_dir(spark, "arrival-state")
        left.write.parquet(kept)
        state = spark.read.schema(decided).parquet(kept)
    result = spark.read.schema(decided).parquet(*parts) if parts else state
    return result.select(
        F.col("k").alias(key), F.timestamp_micros("t").alias(ts), "arrivals", "admitted")
