"""Tables as immutable data folders and numbered manifests.

    table/data/version=<id>/[date=<day>/]part files    written once, never changed
    table/manifests/<number>.json                      which folder holds each day

A commit is one small file: the manifest after the one that was read, moved into place only if
no such file exists. Whoever comes second gets ``Conflict``, reads again and merges again. A
reader takes the newest manifest and the folders it names, so it sees the table before or after
a commit, never between, and a job that dies leaves folders that no manifest names. A commit of
some days writes these days only; the manifest carries the folders of all others on.

A gate looks at counts that Spark observes while the data is written; data that breaks a rule
is never committed, and is not written twice.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The one part of a table that is not kept by days.
WHOLE = ""
RETRIES = 10
#: Rows of one file; a heavy day makes several.
ROWS_PER_FILE = 5_000_000


class Conflict(RuntimeError):
    """Another writer committed first."""


@dataclass(frozen=True)
class Manifest:
    number: int
    schema: str
    #: Day (ISO) to the folder that holds it, relative to the table.
    parts: Mapping[str, str] = field(default_factory=dict)


def _fs(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, hadoop = _fs(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(hadoop)] if fs.exists(hadoop) else []


def _text(spark: SparkSession, path: str) -> str:
    fs, hadoop = _fs(spark, path)
    stream = fs.open(hadoop)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def numbers(spark: SparkSession, path: str) -> list[int]:
    """The committed versions, oldest first."""
    names = _names(spark, f"{path}/manifests")
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def manifest(spark: SparkSession, path: str, number: int | None = None) -> Manifest | None:
    """The newest manifest, or that of a number; None if the table has none."""
    if number is None:
        known = numbers(spark, path)
        if not known:
            return None
        number = known[-1]
    found = json.loads(_text(spark, f"{path}/manifests/{number:012d}.json"))
    return Manifest(number, found["schema"], found["parts"])


def commit(spark: SparkSession, path: str, base: Manifest | None, schema: T.StructType,
           parts: Mapping[str, str]) -> Manifest:
    """The manifest after ``base``, or ``Conflict`` if there is one already."""
    made = Manifest(base.number + 1 if base else 1, schema.json(), dict(parts))
    fs, temporary = _fs(spark, f"{path}/manifests/_{uuid.uuid4().hex}")
    _, target = _fs(spark, f"{path}/manifests/{made.number:012d}.json")
    fs.mkdirs(target.getParent())
    out = fs.create(temporary, False)
    try:
        out.write(bytearray(json.dumps({"schema": made.schema, "parts": made.parts}).encode()))
    finally:
        out.close()
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = gateway.new_array(rename, 1)
    options[0] = rename.NONE  # never over a file that is there
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        temporary.toUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(fs.makeQualified(temporary), fs.makeQualified(target), options)
    except Exception as e:
        there = fs.exists(target)
        fs.delete(temporary, False)
        if there:
            raise Conflict(f"version {made.number} of {path} was committed by another writer") from e
        raise
    return made


def read(spark: SparkSession, path: str, schema: str | T.StructType | None = None,
         number: int | None = None, days: Sequence[str] | None = None) -> DataFrame:
    """The table at its newest version, or at ``number``; only ``days`` if they are given.

    A table without a version reads as empty in ``schema``. The day column is left out unless
    ``schema`` (or, without one, the table's own) has it.
    """
    found = manifest(spark, path, number)
    wanted = spark.createDataFrame([], schema).schema if schema is not None else None
    if found is None:
        if wanted is None:
            raise FileNotFoundError(f"no version of {path}")
        return spark.createDataFrame([], wanted)
    own = T.StructType.fromJson(json.loads(found.schema))
    folders = {f for d, f in found.parts.items() if days is None or d in set(days)}
    names = [f.name for f in (wanted or own).fields]
    if not folders:
        return spark.createDataFrame([], wanted or own)
    rows = (
        spark.read.schema(own).option("basePath", f"{path}/data")
        .parquet(*sorted(f"{path}/{f}" for f in folders))
    )
    return rows.select(*names)


@dataclass(frozen=True)
class Gate:
    """Least number of rows, and columns with at most so large a share of nulls."""

    min_rows: int
    required: tuple[str, ...] = ()
    max_null_rate: float = 0.0

    def observed(self) -> list[Column]:
        return [F.count(F.lit(1)).alias("rows"),
                *[F.count_if(F.col(c).isNull()).alias(f"null {c}") for c in self.required]]

    def broken(self, counts: Mapping[str, int]) -> list[str]:
        rows = counts.get("rows", 0)
        out = [f"rows: {rows} against {self.min_rows}"] if rows < self.min_rows else []
        for c in self.required:
            rate = counts.get(f"null {c}", 0) / rows if rows else 0.0
            if rate > self.max_null_rate:
                out.append(f"nulls in {c}: {rate:g} against {self.max_null_rate:g}")
        return out


class Rejected(ValueError):
    """Data that its gate keeps out of the table; names every broken rule."""


def stage(df: DataFrame, path: str, sort: Sequence[str] = (), day: str | None = None,
          gate: Gate | None = None) -> dict[str, str]:
    """Write ``df`` once into a folder of its own; the parts it makes. Nothing is committed.

    With ``day`` (a date column) rows are rebalanced by day, which splits a heavy day over
    tasks of the advised size. Rows are sorted within files, for row-group skipping.
    """
    spark = df.sparkSession
    folder = f"data/version=v{uuid.uuid4().hex}"
    seen = Observation() if gate is not None else None
    if seen is not None:
        df = df.observe(seen, *gate.observed())
    keys = [c for c in sort if c in df.columns]
    if day is not None:
        df = df.hint("rebalance", day)
        keys = [day, *keys]
    writer = (df.sortWithinPartitions(*keys) if keys else df).write
    if day is not None:
        writer = writer.partitionBy(day).option("maxRecordsPerFile", ROWS_PER_FILE)
    writer.parquet(f"{path}/{folder}")
    if seen is not None and (broken := gate.broken(seen.get)):
        fs, hadoop = _fs(spark, f"{path}/{folder}")
        fs.delete(hadoop, True)
        raise Rejected("; ".join(broken))
    if day is None:
        return {WHOLE: folder}
    made = [n for n in _names(spark, f"{path}/{folder}") if n.startswith(f"{day}=")]
    return {n.split("=", 1)[1]: f"{folder}/{n}" for n in made}


def replace(df: DataFrame, path: str, sort: Sequence[str] = (), day: str | None = None,
            gate: Gate | None = None) -> Manifest:
    """The whole table anew. ``df`` may read the table it replaces."""
    spark = df.sparkSession
    base = manifest(spark, path)
    made = commit(spark, path, base, df.schema, stage(df, path, sort, day, gate))
    vacuum(spark, path)
    return made


def update(spark: SparkSession, path: str,
           change: Callable[[Manifest | None], tuple[T.StructType, Mapping[str, str]]]) -> Manifest:
    """Commits what ``change`` makes of the newest version; anew if another writer was first."""
    for _ in range(RETRIES):
        base = manifest(spark, path)
        schema, parts = change(base)
        try:
            made = commit(spark, path, base, schema, parts)
        except Conflict:
            continue
        vacuum(spark, path)
        return made
    raise Conflict(f"{path}: {RETRIES} commits in a row came second")


def vacuum(spark: SparkSession, path: str, keep: int = 3) -> None:
    """Delete what only versions before the newest ``keep`` name, and their manifests.

    Folders that no manifest names may belong to a writer that has not committed; they stay.
    """
    known = numbers(spark, path)
    old, new = known[:-keep], known[-keep:]
    live = {f for n in new for f in manifest(spark, path, n).parts.values()}
    for n in old:
        for folder in set(manifest(spark, path, n).parts.values()) - live:
            fs, hadoop = _fs(spark, f"{path}/{folder}")
            fs.delete(hadoop, True)
        fs, hadoop = _fs(spark, f"{path}/manifests/{n:012d}.json")
        fs.delete(hadoop, False)
