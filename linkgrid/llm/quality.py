"""Quality classifier: random Fourier features, ridge, isotonic calibration.

1. Document statistics of every whole text (one Arrow UDF; numpy over the bytes) are written
   once to the shared folder: a few hundred bytes per document.
2. Random Fourier features of the standardised statistics approximate a Gaussian kernel. Each
   partition sums its part of the normal equations; Spark adds the parts cell by cell, and
   only the summed system, (features + 1)^2 numbers whatever the input, reaches the driver.
3. Ridge scores of training rows that took no part in the fit are rounded to thousandths,
   counted by Spark (a bounded table), and pooled into a monotone calibration curve.

Labels come only from rows outside the held-out fold; labels, lang, source and doc_id are
never inputs of a score. ``max_rows`` bounds the labelled rows that are fitted on (a seeded
hash of the id chooses them); everything else covers all rows.

Edge cases: null and empty texts have all statistics 0 and a score like any other; null labels
are left out; a document with several labels counts with each; without labels every score is
0.5, with labels of one class that class's share; repeated rows score alike; an empty table
gives an empty table; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from linkgrid.llm.common import fold_of, free_name, kept, utf8

STATISTICS = [
    "log_words", "log_lines", "mean_word", "spread_word", "upper", "digit", "symbol", "mark",
    "other_ascii", "high", "space", "shouted", "marked_words", "distinct_words", "top_word",
    "repeated_lines", "short_lines", "ended_lines", "entropy", "repeated_triples",
]


@dataclass(frozen=True)
class Settings:
    features: int = 256
    width: float = 1.0  # of the Gaussian kernel, times the root of the number of statistics
    ridge: float = 1e-3  # times the number of rows
    max_rows: int = 100_000
    folds: int = 5
    held_out: int = 0
    calibrate: int = 1  # fold of the training rows that the calibration is fitted on
    threshold: float = 0.3
    seed: int = 20


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    waves: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        return _fourier(x, self) @ self.weights[:-1] + self.weights[-1]

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.knots, self.levels), 0.0, 1.0)


_KIND = np.full(256, 7, np.uint8)
_KIND[65:91] = 0
_KIND[97:123] = 1
_KIND[48:58] = 2
_KIND[np.frombuffer(b"#*$%&|<>", np.uint8)] = 3
_KIND[np.frombuffer(b".,;:!?'\"()-", np.uint8)] = 4
_KIND[0x80:] = 5
_KIND[[0x20, 9, 10, 11, 12, 13]] = 6
_ENDS = b".!?:;\"')"


def statistics(data: bytes) -> np.ndarray:
    """The document statistics of one text, in the order of STATISTICS."""
    out = np.zeros(len(STATISTICS), np.float32)
    words = data.split()
    if not words:
        return out
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    kinds = np.bincount(_KIND, weights=counts, minlength=8) / len(data)
    n = len(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    marks = np.fromiter(map(hash, words), np.int64, n)
    ordered = np.sort(marks)
    runs = np.diff(np.flatnonzero(np.concatenate(
        [[True], ordered[1:] != ordered[:-1], [True]])))
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    share = counts[counts > 0] / len(data)
    shouted = sum(map(bytes.isupper, words))
    marked = n - sum(map(bytes.isalnum, words))
    triples = 0.0
    if n > 3:
        rolled = marks[2:] * 31 + marks[1:-1] * 1_000_003 + marks[:-2]
        triples = 1 - len(np.unique(rolled)) / len(rolled)
    out[:] = [
        np.log1p(n), np.log1p(len(lines)), lengths.mean(), lengths.std(),
        kinds[0], kinds[2], kinds[3], kinds[4], kinds[7], kinds[5], kinds[6],
        shouted / n, marked / n, len(runs) / n, runs.max() / n,
        1 - len(set(lines)) / len(lines),
        sum(len(x) < 30 for x in lines) / len(lines),
        sum(x.rstrip()[-1] in _ENDS for x in lines) / len(lines),
        -(share * np.log2(share)).sum(), triples,
    ]
    return out


def document_statistics(text: Column) -> Column:
    @arrow_udf("array<float>")
    def measured(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            rows = [statistics(x) for x in batch.to_pylist()]
            flat = np.concatenate(rows) if rows else np.zeros(0, np.float32)
            ends = np.arange(len(rows) + 1, dtype=np.int32) * len(STATISTICS)
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.float32()))

    return measured(text)


def _matrix(batch: pa.Array, width: int) -> np.ndarray:
    return batch.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.float64)


def _fourier(x: np.ndarray, model: Model) -> np.ndarray:
    z = np.clip((x - model.mean) / model.scale, -6, 6)
    return np.cos(z @ model.waves + model.phase) * np.sqrt(2.0 / model.waves.shape[1])


def _pooled(raw: np.ndarray, rows: np.ndarray, hits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: block centres and non-decreasing levels."""
    blocks: list[list[float]] = []
    for x, n, h in zip(raw, rows, hits):
        blocks.append([x * n, float(n), float(h)])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    sums = np.array(blocks)
    return sums[:, 0] / sums[:, 1], sums[:, 2] / sums[:, 1]


def fit(labelled: DataFrame, settings: Settings = Settings()) -> Model:
    """A model from rows of (doc_id, x array<float>, y int), none of them held out."""
    d, size = len(STATISTICS), settings.features
    rng = np.random.default_rng(settings.seed)
    waves = rng.normal(0, 1 / (settings.width * np.sqrt(d)), (d, size))
    phase = rng.uniform(0, 2 * np.pi, size)
    rows = labelled.where("y is not null").count()
    if rows > settings.max_rows:
        part = F.pmod(F.xxhash64("doc_id", F.lit(settings.seed)), F.lit(rows))
        labelled = labelled.where(part < settings.max_rows)
    labelled = labelled.where("y is not null").select(
        "x", F.col("y").cast("double").alias("y"),
        (fold_of("doc_id", settings.folds) == settings.calibrate).alias("later"),
    )
    x = [F.col("x")[i].cast("double") for i in range(d)]
    first = labelled.agg(
        F.count("*").alias("n"), F.avg("y").alias("share"),
        F.sum((~F.col("later")).cast("int")).alias("fitted"),
        F.array(*[F.coalesce(F.avg(c), F.lit(0.0)) for c in x]).alias("mean"),
        F.array(*[F.coalesce(F.stddev_pop(c), F.lit(0.0)) for c in x]).alias("scale"),
    ).first()
    share = 0.5 if first["share"] is None else first["share"]
    scale = np.array(first["scale"])
    model = Model(
        np.array(first["mean"]), np.where(scale > 1e-9, scale, 1.0), waves, phase,
        np.zeros(size + 1), np.array([0.0]), np.array([share]),
    )
    if not first["fitted"] or share in (0.0, 1.0):
        return model
    side = size + 2

    def sums(batches):
        total = np.zeros((side, side))
        for batch in batches:
            z = _fourier(_matrix(batch["x"], d), model)
            y = batch["y"].to_numpy(zero_copy_only=False)
            full = np.column_stack([z, np.ones(len(z)), y])
            total += full.T @ full
        yield pa.RecordBatch.from_pydict({
            "i": np.repeat(np.arange(side, dtype=np.int32), side),
            "j": np.tile(np.arange(side, dtype=np.int32), side),
            "v": total.ravel(),
        })

    cells = (
        labelled.where(~F.col("later")).select("x", "y")
        .mapInArrow(sums, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    ).toArrow()
    full = np.zeros((side, side))
    full[cells["i"].to_numpy(), cells["j"].to_numpy()] = cells["v"].to_numpy()
    gram, target = full[:-1, :-1], full[:-1, -1]
    penalty = np.full(size + 1, settings.ridge * gram[-1, -1])
    penalty[-1] = 0.0
    weights = np.linalg.solve(gram + np.diag(penalty + 1e-9), target)
    model = Model(model.mean, model.scale, waves, phase, weights, model.knots, model.levels)

    later = labelled.where("later")
    later = later if not later.isEmpty() else labelled
    curve = (
        later.select(F.round(raw_score("x", model), 3).alias("raw"), "y")
        .groupBy("raw").agg(F.count("*").alias("n"), F.sum("y").alias("hits"))
        .toArrow().sort_by("raw")
    )
    knots, levels = _pooled(*[curve[c].to_numpy() for c in ("raw", "n", "hits")])
    return Model(model.mean, model.scale, waves, phase, weights, knots, levels)


def _applied(column: str | Column, model: Model, calibrated: bool) -> Column:
    @arrow_udf("double")
    def scores(xs: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in xs:
            x = _matrix(batch, len(STATISTICS))
            out = model.score(x) if calibrated else np.clip(model.raw(x), -2, 3)
            yield pa.array(out, pa.float64())

    return scores(F.col(column) if isinstance(column, str) else column)


def raw_score(column: str | Column, model: Model) -> Column:
    return _applied(column, model, calibrated=False)


def score(column: str | Column, model: Model) -> Column:
    return _applied(column, model, calibrated=True)


def statistics_table(docs: DataFrame) -> DataFrame:
    """(doc_id, x), written once to the shared folder."""
    return kept(docs.select("doc_id", document_statistics(utf8()).alias("x")), "statistics")


def fit_on(stats: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """A model from the labels outside the held-out fold."""
    training = fold_of("doc_id", settings.folds) != settings.held_out
    marks = labels.where(training & F.col("doc_id").isNotNull()).select(
        "doc_id", F.col("quality").alias("y"))
    return fit(kept(stats.join(marks, "doc_id"), "labelled"), settings)


def quality_report(docs: DataFrame, labels: DataFrame,
                   settings: Settings = Settings()) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    stats = statistics_table(docs)
    model = fit_on(stats, labels, settings)
    held = fold_of("doc_id", settings.folds) == settings.held_out
    scored = stats.select("doc_id", held.alias("held_out"), score("x", model).alias("score"))
    return scored.withColumn(
        "predicted", (F.col("score") >= settings.threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, columns as they were."""
    model = fit_on(statistics_table(docs), labels, settings)
    name = free_name(docs, "quality_score")
    scored = docs.withColumn(name, score(document_statistics(utf8(docs["text"])), model))
    return scored.where(F.col(name) >= settings.threshold).drop(name)
