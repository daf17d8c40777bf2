"""Quantile forest on Spark ML: one weighted forest per target, leaf quantiles, calibration.

A regression forest is grown on executors; every leaf then answers with the weighted
quantiles of the training labels that fall into it (Meinshausen 2006), and a row with the mean
over its trees. Edges are widened by a held-out conformal offset (Romano et al. 2019).
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkgrid.functions.quantiles import exact_quantiles
from linkgrid.functions.units import BAND_FIELDS, QUANTILES, TARGETS
from linkgrid.operators.boosting import BoostedQuantiles, BoostParams, fit_boosters
from linkgrid.operators.matrix import FEATURE_COLUMNS
from linkgrid.operators.metrics import conformal_offsets
from linkgrid.operators.split import stratified_split
from linkgrid.session import shared_dir

# Trees have no missing direction: a gap becomes this value plus an indicator column.
MISSING = -1000.0
ALWAYS_PRESENT = {
    "hour_sin",
    "hour_cos",
    "day_of_week",
    "local_solar_offset_h",
    "cell_lat",
    "source_quality",
}


@dataclass(frozen=True)
class ForestParams:
    """``leaf_accuracy`` None ranks leaf labels exactly; a number keeps a bounded sketch per
    leaf instead, so that only sketches are shuffled however many rows there are."""

    trees: int = 20
    depth: int = 6
    min_leaf: int = 20
    bagging: float = 0.9
    seed: int = 0
    leaf_accuracy: int | None = None


@dataclass
class QuantileForest:
    """Forests, their leaf quantiles and offsets.

    ``leaves[target]`` has a table per quantile, indexed by tree and leaf: at most
    ``trees * 2**depth`` numbers each, whatever the data size, so it travels as a literal.
    """

    forests: dict[str, RandomForestRegressionModel]
    leaves: dict[str, dict[str, list[list[float | None]]]]
    calibration: dict[str, float] = field(default_factory=dict)
    feature_names: Sequence[str] = tuple(FEATURE_COLUMNS)

    @property
    def trained_targets(self) -> list[str]:
        return sorted(self.forests)

    def predict(self, rows: DataFrame, calibrated: bool = True,
                targets: Sequence[str] | None = None) -> DataFrame:
        """``rows`` with ``<target>_q10/_q50/_q90``; a projection, without any shuffle."""
        wide = assemble(rows)
        for target in targets or self.trained_targets:
            forest = self.forests[target].setLeafCol("__leaf").setPredictionCol("__point")
            offset = self.calibration.get(target, 0.0) if calibrated else 0.0
            reached = forest.transform(wide)
            bands = {}
            for name, shift in zip(BAND_FIELDS, (-offset, 0.0, offset)):
                bands[f"{target}_{name}"] = _leaf_mean(self.leaves[target][name]) + shift
            wide = reached.withColumns(bands).drop("__leaf", "__point")
        return wide.drop("__features")


def _leaf_mean(table: list[list[float | None]]) -> Column:
    # One constant per table: Spark folds the parse away when it optimises the plan.
    trees = F.from_json(F.lit(json.dumps(table)), "array<array<double>>")
    hits = F.array_compact(
        F.zip_with(trees, vector_to_array(F.col("__leaf")), lambda t, i: F.get(t, i.cast("int")))
    )
    return F.try_divide(
        F.aggregate(hits, F.lit(0.0), lambda a, v: a + v), F.size(hits).cast("double")
    )


def assemble(rows: DataFrame) -> DataFrame:
    """Adds the ML vector: filled features, then indicators for those that can be missing."""
    filled = {f"__f_{c}": F.coalesce(F.col(c).cast("double"), F.lit(MISSING))
              for c in FEATURE_COLUMNS}
    gaps = {f"__m_{c}": F.col(c).isNull().cast("double")
            for c in FEATURE_COLUMNS if c not in ALWAYS_PRESENT}
    columns = [*filled, *gaps]
    wide = rows.withColumns({**filled, **gaps})
    return VectorAssembler(inputCols=columns, outputCol="__features").transform(wide).drop(*columns)


def _fit_target(rows: DataFrame, params: ForestParams):
    wide = assemble(rows).select("__features", "label", "source_quality")
    forest = RandomForestRegressor(
        featuresCol="__features",
        labelCol="label",
        weightCol="source_quality",
        leafCol="__leaf",
        predictionCol="__point",
        numTrees=params.trees,
        maxDepth=params.depth,
        minInstancesPerNode=params.min_leaf,
        subsamplingRate=params.bagging,
        featureSubsetStrategy="0.9",
        seed=params.seed,
    ).fit(wide)
    reached = forest.transform(wide).select(
        F.posexplode(vector_to_array("__leaf")).alias("tree", "leaf"), "label", "source_quality"
    )
    leaves = reached.withColumn("leaf", F.col("leaf").cast("int"))
    levels = dict(zip(BAND_FIELDS, QUANTILES))
    if params.leaf_accuracy is None:
        # Labels are counted per (tree, leaf, value) before anything is ranked.
        ranked = exact_quantiles(leaves, ["tree", "leaf"], "label", levels, weight="source_quality")
    else:
        # Weights are small whole numbers; a row is repeated inside its own task only.
        times = F.array_repeat("label", F.col("source_quality").cast("int"))
        sketch = F.percentile_approx("label", list(QUANTILES), params.leaf_accuracy)
        ranked = (
            leaves.select("tree", "leaf", F.explode(times).alias("label"))
            .groupBy("tree", "leaf")
            .agg(sketch.alias("q"))
            .select("tree", "leaf", *[F.col("q")[i].alias(n) for i, n in enumerate(BAND_FIELDS)])
        )
    return forest, leaf_tables(ranked, params.trees)


def leaf_tables(ranked: DataFrame, trees: int) -> dict[str, list[list[float | None]]]:
    """Leaf rows (at most trees * 2**depth of them) as nested lists per quantile."""
    rows = ranked.collect()
    tables: dict[str, list[list[float | None]]] = {}
    for name in BAND_FIELDS:
        table: list[list[float | None]] = [[] for _ in range(trees)]
        for r in rows:
            column = table[r["tree"]]
            column.extend([None] * (r["leaf"] + 1 - len(column)))
            column[r["leaf"]] = r[name]
        tables[name] = [t or [None] for t in table]
    return tables


def available_targets(rows: DataFrame) -> list[str]:
    found = {r["target"] for r in rows.select("target").distinct().collect()}
    return [t for t in TARGETS if t in found]


def fit_forests(
    rows: DataFrame, targets: Sequence[str] | None = None, params: ForestParams = ForestParams()
) -> QuantileForest:
    """One forest per target that has labels."""
    targets = available_targets(rows) if targets is None else list(targets)
    if not targets:
        raise ValueError("the training rows hold no known target")
    forests, leaves = {}, {}
    for target in targets:
        forests[target], leaves[target] = _fit_target(rows.where(F.col("target") == target), params)
    return QuantileForest(forests, leaves)


def fit_model(rows: DataFrame, targets: Sequence[str] | None = None,
              params: ForestParams | BoostParams = ForestParams()) -> QuantileForest | BoostedQuantiles:
    """Forests or boosted trees, as the parameters say."""
    if isinstance(params, BoostParams):
        targets = available_targets(rows) if targets is None else list(targets)
        if not targets:
            raise ValueError("the training rows hold no known target")
        return fit_boosters(rows, targets, params)
    return fit_forests(rows, targets, params)


def score_rows(model: QuantileForest | BoostedQuantiles, rows: DataFrame, calibrated: bool = True) -> DataFrame:
    """Labelled rows of the trained targets with q10, q50 and q90 of their own target.

    Each row passes only its own target's trees.
    """
    parts = []
    for target in model.trained_targets:
        own = model.predict(rows.where(F.col("target") == target), calibrated, [target])
        parts.append(own.withColumnsRenamed({f"{target}_{b}": b for b in BAND_FIELDS}))
    return reduce(DataFrame.unionByName, parts)


def fit_calibration(train: DataFrame,
                    params: ForestParams | BoostParams = ForestParams()) -> dict[str, float]:
    """Offset per target from a proxy fit on the older part of each group's training rows.

    Empty when the rows cannot be split. At most one number per target reaches the driver.
    """
    table = shared_dir(train.sparkSession, "calibration")
    stratified_split(train).write.parquet(table)
    halves = train.sparkSession.read.parquet(table)
    held = halves.where("is_test")
    older = halves.where(~F.col("is_test"))
    targets = [t for t in available_targets(older) if t in available_targets(held)]
    if not targets:
        return {}
    proxy = fit_model(older, targets, params)
    scored = score_rows(proxy, held.where(F.col("target").isin(targets)), calibrated=False)
    found = conformal_offsets(scored).select("target", "conformal_offset").collect()
    return {r["target"]: r["conformal_offset"] for r in found}
