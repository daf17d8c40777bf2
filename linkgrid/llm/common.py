"""What the training-data operators share: reading tables, cutting lineage, columns."""

from __future__ import annotations

import dataclasses

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkgrid.session import shared_dir

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Spark then deletes the shuffle files of a query once it has ended, not when memory runs low.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Rows that go to a Python worker at once.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def kept(df: DataFrame, name: str, batch: int | None = None) -> DataFrame:
    """Write to the cluster's shared folder and read back: cuts lineage, survives executors.

    ``batch`` bounds the rows of an Arrow batch, for rows that hold whole texts or sets.
    """
    spark = df.sparkSession
    path = shared_dir(spark, name)
    wanted = {CLEANUP: "true"}
    if batch:
        wanted[BATCH] = str(min(batch, int(spark.conf.get(BATCH)) or batch))
    before = {key: spark.conf.get(key, None) for key in wanted}
    try:
        for key, value in wanted.items():
            spark.conf.set(key, value)
        df.write.parquet(path)
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)
    found = spark.read.schema(df.schema).parquet(path)
    found.kept_at = path
    return found


def release(*tables: DataFrame) -> None:
    """Delete tables that ``kept`` wrote, once nothing that is still to run reads them."""
    for df in tables:
        hadoop = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.kept_at)
        hadoop.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(hadoop, True)


def text_of(column: str | Column = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def utf8(column: str | Column = "text") -> Column:
    return text_of(column).cast("binary")


def fold_of(column: str | Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as empty text."""
    doc = F.col(column) if isinstance(column, str) else column
    return F.pmod(F.crc32(F.coalesce(doc.cast("string"), F.lit(""))), F.lit(parts))


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not use, in either case."""
    used = {c.lower() for c in df.columns}
    while base.lower() in used:
        base += "_"
    return base


def struct_array(columns: dict[str, pa.Array]) -> pa.StructArray:
    return pa.StructArray.from_arrays(list(columns.values()), names=list(columns))


def fields(column: Column, names: list[str]) -> list[Column]:
    return [column[n].alias(n) for n in names]


def values(parameters) -> dict:
    return dataclasses.asdict(parameters)
