"""Gradient boosting of quantiles: pinball loss, histogram splits, leaves refitted by quantile.

Features are cut into bins once, by edges from one sketch per feature; a missing value has a bin
of its own, and each split learns on which side it goes. Trees grow level by level for all
quantiles together. One scan a level: every task adds up, for each (quantile, leaf, feature,
bin), the weight of rows at or under the present prediction and of rows over it, which is all
that the gradient of the pinball loss needs; Spark sums these cells, and at most quantiles x
leaves x features x bins of them reach the driver, whatever the number of rows. When a tree is
grown, each leaf takes the weighted quantile of its rows' residuals (ranked over Spark, a group
is never in one task), and a share of it is added.

Rows carry no state between scans: a prediction is computed again from the trees, which are
small, so a lost executor costs its tasks of one scan. A split needs ``min_leaf`` rows on both
sides; of equal gains the first feature, the lowest cut, and missing on the left win.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkgrid.functions.quantiles import exact_quantiles
from linkgrid.functions.units import BAND_FIELDS, QUANTILES
from linkgrid.operators.matrix import FEATURE_COLUMNS
from linkgrid.session import shared_dir

#: Gains that differ by less are equal, so that rounding errors decide no split.
GAIN_DIGITS = 6
BINNED = "label double, weight double, bins binary"


@dataclass(frozen=True)
class BoostParams:
    """``edges`` fixes the cuts of each feature; without it they come from sketches with
    ``bins`` parts. ``leaf_accuracy`` None ranks residuals exactly, a number sketches them."""

    rounds: int = 40
    depth: int = 4
    bins: int = 32
    learning_rate: float = 0.15
    min_leaf: int = 20
    leaf_accuracy: int | None = 1000
    features: tuple[str, ...] = tuple(FEATURE_COLUMNS)
    edges: Mapping[str, Sequence[float]] | None = None


@dataclass(frozen=True)
class Tree:
    """Node i has the children 2i + 1 and 2i + 2; a node without a feature (-1) is a leaf.

    Bins up to ``cut`` go left, and so does the bin of missing values (0) if ``missing_left``.
    """

    feature: list[int]
    cut: list[int]
    missing_left: list[bool]
    value: list[float]

    def leaf_of(self, bins: np.ndarray) -> np.ndarray:
        node = np.zeros(len(bins), np.int64)
        feature, cut = np.array(self.feature), np.array(self.cut)
        missing_left = np.array(self.missing_left)
        while True:
            inner = feature[node] >= 0
            if not inner.any():
                return node
            at = node[inner]
            b = bins[inner, feature[at]]
            left = np.where(b == 0, missing_left[at], b <= cut[at])
            node[inner] = 2 * at + np.where(left, 1, 2)

    @staticmethod
    def root() -> Tree:
        return Tree([-1], [0], [False], [0.0])

    def grown(self, splits: Mapping[int, tuple[int, int, bool]]) -> Tree:
        size = 2 * max(splits) + 3
        pad = lambda x, v: list(x) + [v] * (size - len(x))
        feature, cut = pad(self.feature, -1), pad(self.cut, 0)
        missing_left, value = pad(self.missing_left, False), pad(self.value, 0.0)
        for node, (f, c, m) in splits.items():
            feature[node], cut[node], missing_left[node] = f, c, m
        return Tree(feature, cut, missing_left, value)


@dataclass
class Booster:
    """Trees of one target, by quantile, on top of a base value each."""

    base: list[float]
    trees: list[list[Tree]]
    edges: list[list[float]]
    learning_rate: float

    def raw(self, bins: np.ndarray) -> np.ndarray:
        """Predictions, a column per quantile."""
        out = np.tile(np.array(self.base), (len(bins), 1))
        for q, trees in enumerate(self.trees):
            for tree in trees:
                out[:, q] += self.learning_rate * np.array(tree.value)[tree.leaf_of(bins)]
        return out

    def bins_of(self, x: np.ndarray) -> np.ndarray:
        """Bin of each value: 0 is missing, then one more for each edge that lies below it."""
        out = np.zeros(x.shape, np.uint8)
        for j, edges in enumerate(self.edges):
            known = ~np.isnan(x[:, j])
            out[known, j] = np.searchsorted(edges, x[known, j], side="left") + 1
        return out


def _matrix_of(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)


def _bytes_of(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def feature_edges(rows: DataFrame, params: BoostParams) -> list[list[float]]:
    """The cuts of each feature: given ones, or distinct quantiles from one sketch each."""
    if params.edges is not None:
        return [sorted(params.edges.get(f, ())) for f in params.features]
    levels = [i / params.bins for i in range(1, params.bins)]
    found = rows.agg(*[
        F.percentile_approx(F.nanvl(F.col(f).cast("double"), F.lit(None)), levels, 10_000).alias(f)
        for f in params.features]).first()
    return [sorted(set(found[f] or [])) for f in params.features]


def _features(params: BoostParams):
    return F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(float("nan")))
                     for f in params.features]).alias("x")


def _sums(booster: Booster, growing: list[Tree], width: int):
    """Per task: (cell, under, over, rows) of every (quantile, node, feature, bin) it has rows in."""
    parts = max(len(e) for e in booster.edges) + 2
    size = max(len(t.feature) for t in growing) * width * parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((3, len(growing) * size))
        for batch in batches:
            if not len(batch):
                continue
            bins, y = _bytes_of(batch["bins"], width), batch["label"].to_numpy()
            weight = batch["weight"].to_numpy()
            now = booster.raw(bins)
            for q, tree in enumerate(growing):
                over = y > now[:, q]
                cells = (tree.leaf_of(bins)[:, None] * width + np.arange(width)) * parts + bins
                for j in range(width):
                    at = q * size + cells[:, j]
                    for k, w in enumerate((weight * ~over, weight * over, None)):
                        totals[k] += np.bincount(at, w, minlength=totals.shape[1])
        held = np.flatnonzero(totals[2])
        yield pa.RecordBatch.from_pydict({
            "cell": held, "under": totals[0, held], "over": totals[1, held],
            "rows": totals[2, held].astype(np.int64)})

    return run, size, parts


def best_split(under: np.ndarray, over: np.ndarray, rows: np.ndarray, level: float,
               min_leaf: int) -> tuple[int, int, bool] | None:
    """(feature, cut, missing left) of a node's sums by (feature, bin); None if nothing gains.

    A side's score is its squared gradient over its weight; bin 0 holds what is missing. The
    last cut of a feature sets what is missing apart from all else.
    """

    def score(u, o):
        g = (1.0 - level) * u - level * o
        return np.divide(g * g, u + o, out=np.zeros_like(g), where=u + o > 0)

    best, found = 1e-9, None
    for f in range(len(rows)):
        whole = [x[f].sum() for x in (under, over, rows)]
        base = score(*(np.array([w]) for w in whole[:2]))[0]
        for missing_left in (True, False):
            left = [np.cumsum(x[f, 1:]) + (x[f, 0] if missing_left else 0)
                    for x in (under, over, rows)]
            right = [w - x for w, x in zip(whole, left)]
            gain = np.round(score(*left[:2]) + score(*right[:2]) - base, GAIN_DIGITS)
            gain[(left[2] < min_leaf) | (right[2] < min_leaf)] = -1.0
            at = int(gain.argmax()) if len(gain) else 0
            better = len(gain) and (gain[at] > best or (
                found is not None and found[0] == f and gain[at] == best and at + 1 < found[1]))
            if better:
                best, found = gain[at], (f, at + 1, missing_left)
    return found


def _grow(binned: DataFrame, booster: Booster, params: BoostParams) -> list[Tree]:
    width = len(params.features)
    growing = [Tree.root() for _ in QUANTILES]
    for depth in range(params.depth):
        run, size, parts = _sums(booster, growing, width)
        cells = binned.mapInArrow(run, "cell bigint, under double, over double, rows bigint")
        sums = cells.groupBy("cell").agg(
            F.sum("under").alias("under"), F.sum("over").alias("over"),
            F.sum("rows").alias("rows")).toArrow()
        totals = np.zeros((3, len(growing) * size))
        for k, name in enumerate(("under", "over", "rows")):
            totals[k, sums["cell"].to_numpy()] = sums[name].to_numpy()
        totals = totals.reshape(3, len(growing), -1, width, parts)
        first = 2**depth - 1  # nodes of this level
        for q, level in enumerate(QUANTILES):
            splits = {}
            for node in range(first, min(2 * first + 1, totals.shape[2])):
                if totals[2, q, node].any():
                    split = best_split(*totals[:, q, node], level, params.min_leaf)
                    if split is not None:
                        splits[node] = split
            if splits:
                growing[q] = growing[q].grown(splits)
    return growing


def _leaf_values(binned: DataFrame, booster: Booster, growing: list[Tree],
                 params: BoostParams) -> list[Tree]:
    """The grown trees with the quantile of the residuals in each leaf."""
    width = len(params.features)

    def residuals(batches):
        for batch in batches:
            if not len(batch):
                continue
            bins, y = _bytes_of(batch["bins"], width), batch["label"].to_numpy()
            now = booster.raw(bins)
            for q, tree in enumerate(growing):
                yield pa.RecordBatch.from_pydict({
                    "q": pa.array(np.full(len(y), q), pa.int32()),
                    "leaf": pa.array(tree.leaf_of(bins), pa.int32()),
                    "residual": y - now[:, q], "weight": batch["weight"]})

    rows = binned.mapInArrow(residuals, "q int, leaf int, residual double, weight double")
    levels = dict(zip(BAND_FIELDS, QUANTILES))
    if params.leaf_accuracy is None:
        ranked = exact_quantiles(rows, ["q", "leaf"], "residual", levels, weight="weight")
    else:
        times = F.array_repeat("residual", F.col("weight").cast("int"))
        sketch = F.percentile_approx("residual", list(QUANTILES), params.leaf_accuracy)
        ranked = (
            rows.select("q", "leaf", F.explode(times).alias("residual"))
            .groupBy("q", "leaf").agg(sketch.alias("s"))
            .select("q", "leaf", *[F.col("s")[i].alias(n) for i, n in enumerate(BAND_FIELDS)]))
    values = [list(t.value) for t in growing]
    for r in ranked.collect():  # quantiles x leaves rows
        values[r["q"]][r["leaf"]] = r[BAND_FIELDS[r["q"]]]
    return [Tree(t.feature, t.cut, t.missing_left, v) for t, v in zip(growing, values)]


def fit_booster(rows: DataFrame, params: BoostParams = BoostParams()) -> Booster:
    """Boosts all quantiles of one target; ``rows`` has the features, label and source_quality.

    Rows without a label take no part. The weight is source_quality, a small whole number.
    """
    known = rows.where(F.col("label").isNotNull() & ~F.isnan("label"))
    booster = Booster([], [[] for _ in QUANTILES], feature_edges(known, params),
                      params.learning_rate)

    def bins(batches):
        for batch in batches:
            if not len(batch):
                continue
            made = booster.bins_of(_matrix_of(batch["x"], len(params.features)))
            yield pa.RecordBatch.from_pydict({
                "label": batch["label"], "weight": batch["weight"],
                "bins": pa.array([r.tobytes() for r in made], pa.binary())})

    path = shared_dir(rows.sparkSession, "binned")
    weight = F.coalesce(F.col("source_quality").cast("double"), F.lit(1.0)).alias("weight")
    known.select(F.col("label").cast("double").alias("label"), weight, _features(params)).mapInArrow(
        bins, BINNED).write.parquet(path)
    binned = rows.sparkSession.read.schema(BINNED).parquet(path)
    base = exact_quantiles(
        binned.withColumn("all", F.lit(1)), ["all"], "label", dict(zip(BAND_FIELDS, QUANTILES)),
        weight="weight").first()
    if base is None:
        raise ValueError("the training rows hold no label")
    booster.base = [base[n] for n in BAND_FIELDS]
    for _ in range(params.rounds):
        grown = _grow(binned, booster, params)
        if all(t.feature[0] < 0 for t in grown):
            break  # nothing gains any more
        for trees, tree in zip(booster.trees, _leaf_values(binned, booster, grown, params)):
            trees.append(tree)
    return booster


def _bands(booster: Booster, width: int):
    @F.arrow_udf(", ".join(f"{n} double" for n in BAND_FIELDS))
    def bands(x: pa.Array) -> pa.Array:
        found = np.sort(booster.raw(booster.bins_of(_matrix_of(x, width))), axis=1)
        return pa.StructArray.from_arrays(
            [pa.array(found[:, i]) for i in range(len(BAND_FIELDS))], list(BAND_FIELDS))

    return bands


@dataclass
class BoostedQuantiles:
    """A booster per target, with the interface of the forests."""

    boosters: dict[str, Booster]
    params: BoostParams
    calibration: dict[str, float] = field(default_factory=dict)

    @property
    def feature_names(self) -> Sequence[str]:
        return self.params.features

    @property
    def trained_targets(self) -> list[str]:
        return sorted(self.boosters)

    def predict(self, rows: DataFrame, calibrated: bool = True,
                targets: Sequence[str] | None = None) -> DataFrame:
        """``rows`` with ``<target>_q10/_q50/_q90``; a projection, without any shuffle.

        Quantiles are fitted apart, so a row's three are put in order.
        """
        width, wide = len(self.params.features), rows
        for target in targets or self.trained_targets:
            bands = _bands(self.boosters[target], width)
            offset = self.calibration.get(target, 0.0) if calibrated else 0.0
            wide = wide.withColumn("__bands", bands(_features(self.params)))
            wide = wide.withColumns({
                f"{target}_{n}": F.col(f"__bands.{n}") + shift
                for n, shift in zip(BAND_FIELDS, (-offset, 0.0, offset))}).drop("__bands")
        return wide

    def as_json(self) -> str:
        return json.dumps({
            "boosters": {t: asdict(b) for t, b in self.boosters.items()},
            "params": asdict(self.params), "calibration": self.calibration})

    @staticmethod
    def from_json(text: str) -> BoostedQuantiles:
        found = json.loads(text)
        params = found["params"] | {"features": tuple(found["params"]["features"])}
        boosters = {
            t: Booster(b["base"], [[Tree(**x) for x in q] for q in b["trees"]], b["edges"],
                       b["learning_rate"]) for t, b in found["boosters"].items()}
        return BoostedQuantiles(boosters, BoostParams(**params), found["calibration"])


def fit_boosters(rows: DataFrame, targets: Sequence[str],
                 params: BoostParams = BoostParams()) -> BoostedQuantiles:
    return BoostedQuantiles(
        {t: fit_booster(rows.where(F.col("target") == t), params) for t in targets}, params)
