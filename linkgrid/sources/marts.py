"""Marts with fixed schemas as versioned tables, on any file system Hadoop can reach."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkgrid.operators.history import keep_best
from linkgrid.session import shared_dir
from linkgrid.sources import versions

#: The column that marts kept by days are partitioned by.
DAY = "date"


def _path(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, hadoop = _path(spark, path)
    return fs.exists(hadoop)


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def read_mart(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The mart with its fixed schema; a mart that does not exist yet reads as empty."""
    return versions.read(spark, path, schema)


def write_mart(
    df: DataFrame,
    path: str,
    sort: Sequence[str] = ("h3_cell", "hour_utc"),
    schema: str | None = None,
    gate: versions.Gate | None = None,
) -> None:
    """Replace a mart by one commit, if it passes ``gate``. Zero rows make an empty mart.

    Rows are sorted within each file, for row-group skipping by cell and hour. A job may read
    the mart it replaces; readers see the old or the new one.
    """
    if schema is not None:
        df = _in_schema(df, schema)
    versions.replace(df, path, sort, gate=gate)


def _in_schema(df: DataFrame, schema: str) -> DataFrame:
    wanted = empty(df.sparkSession, schema).schema
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in wanted])


def upsert_mart(
    fresh: DataFrame,
    path: str,
    keys: Sequence[str] = ("h3_cell", "hour_utc"),
    order: Sequence[Column] = (),
    time: str = "hour_utc",
    keep_days: int | None = None,
    gate: versions.Gate | None = None,
    schema: str | None = None,
) -> None:
    """Fresh rows win their key; only the days they touch are read and written.

    Of fresh rows with one key the first by ``order`` counts; a row without a time has no place
    in a mart kept by days, and is left out. With ``keep_days``, hours that lie so many days or
    more before the newest one go: whole days leave the manifest, the day of the bound is
    written anew. All of it is one commit, repeated from the newest version if another writer
    came first; running it again changes nothing. ``gate`` looks at the days that are written.
    """
    spark = fresh.sparkSession
    if schema is not None:
        fresh = _in_schema(fresh, schema)
    staged = shared_dir(spark, "upsert")
    dated = fresh.where(F.col(time).isNotNull()).withColumn(DAY, F.to_date(time))
    dated.write.parquet(staged)
    new = spark.read.schema(dated.schema).parquet(staged)
    pulled = new.groupBy(DAY).agg(F.max(F.unix_seconds(time)).alias("newest")).collect()
    days = {str(r[DAY]) for r in pulled}
    if not days:
        if gate is not None and not versions.numbers(spark, path):
            raise versions.Rejected(f"rows: 0 against {gate.min_rows}")
        return
    newest = max(r["newest"] for r in pulled)

    def change(base: versions.Manifest | None):
        parts = dict(base.parts) if base is not None else {}
        bound, touched = None, set(days)
        if keep_days is not None:
            last = max([newest, *_newest(spark, path, base, time)])
            bound = last - keep_days * 86_400
            edge = datetime.fromtimestamp(bound, UTC).date().isoformat()
            parts = {d: f for d, f in parts.items() if d >= edge}
            touched = {d for d in touched | ({edge} & set(parts)) if d >= edge}
        merged = new.withColumn("__new", F.lit(1))
        if touched & set(parts):
            old = versions.read(spark, path, number=base.number, days=sorted(touched & set(parts)))
            merged = merged.unionByName(old.withColumn("__new", F.lit(0)))
        if bound is not None:
            merged = merged.where(F.unix_seconds(time) > bound)
        merged = keep_best(merged, keys, [F.desc("__new"), *order]).drop("__new")
        made = versions.stage(merged, path, keys, DAY, gate)
        left = {d: f for d, f in parts.items() if d not in touched}
        return merged.schema, {**left, **made}

    versions.update(spark, path, change)


def _newest(spark: SparkSession, path: str, base: versions.Manifest | None,
            time: str) -> list[int]:
    """The newest instant of a table, from its last day only."""
    if base is None or not base.parts:
        return []
    last = versions.read(spark, path, number=base.number, days=[max(base.parts)])
    found = last.agg(F.max(F.unix_seconds(time))).first()[0]
    return [found] if found is not None else []


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file (a pointer or a manifest), replaced whole."""
    fs, hadoop = _path(spark, path)
    fs.mkdirs(hadoop.getParent())
    out = fs.create(hadoop, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str | None:
    if not path_exists(spark, path):
        return None
    rows = spark.read.text(path, wholetext=True).collect()
    return rows[0]["value"] if rows else ""
