"""Hard-negative mining by slot-decomposed selection; exact.

For an anchor, each positive asks for the best negatives with a score in its own window, up to
a share of the positive's score. The windows overlap. Their upper limits, falling with the
positives, cut the scores into disjoint slots: slot j lies between the limits of positives j
and j + 1. A negative falls into one slot. The first k of a window are among the first k of
each slot from its own downwards, so it suffices to keep k per slot: a task keeps them over all
of its rows (the combiner), Spark merges the tasks, and since slots follow each other downwards
the suffix of the merged list from slot j on, cut after k and at the lower limit, answers
window j. Within a slot only scores from its positive's lower limit on are kept; no window
above asks for less.

Scale: anchors are the stated query set; they meet all rows in blocks of a bounded number of
anchors (``anchors_per_pass``; a block is what a task is sent, some 10 MB), each block with two
scans of the integer vectors, one for positives and one for negatives. Scores are matrix
products in tasks. What is shuffled are at most k rows per task, anchor and slot; no row is
dropped, no label or vector makes a hot key. Each block is written to the shared folder.

Edge cases: rows with a null label, vector, component or vec_id, or a non-finite component,
take no part; vectors of different lengths are compared as if filled with zeros; integer
components are held within +-2^22; a positive with a score below zero has an empty window
(its limits cross), but keeps its place among the positives; other rows are those with another
vec_id; repeated rows count as often as they come, as candidates and as anchors; ties go to
the smaller vec_id; anchors without positives or negatives have no rows; an empty table gives
an empty table. Columns other than those named are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkgrid.llm.common import kept
from linkgrid.llm.vectors import integers, is_finite, lists, rows_of

LOWEST = np.iinfo(np.int64).min
#: Anchors scored at a time in a task.
CHUNK = 256
RESULT = ("anchor_id bigint, positive_id bigint, rank int, negative_id bigint,"
          " positive_score bigint, negative_score bigint")


@dataclass(frozen=True)
class Mining:
    positives: int = 5
    negatives: int = 10
    least_percent: int = 30
    most_percent: int = 90
    scale: int = 256
    anchors_per_pass: int = 1 << 15


@dataclass(frozen=True)
class Block:
    """Anchors of one pass: number, vec_id, label and vector of each."""

    number: np.ndarray
    vec_id: np.ndarray
    label: np.ndarray
    v: np.ndarray

    def chunks(self) -> list[slice]:
        return [slice(i, i + CHUNK) for i in range(0, len(self.number), CHUNK)]


class Best:
    """The first k rows of each group, by falling score and rising id."""

    def __init__(self, groups: int, k: int):
        self.k = k
        self.group = self.score = self.id = np.zeros(0, np.int64)
        #: Scores below this can't come in any more.
        self.floor = np.full(groups, LOWEST)

    def add(self, group: np.ndarray, score: np.ndarray, id_: np.ndarray) -> None:
        if not len(group):
            return
        group = np.concatenate([self.group, group])
        score, id_ = np.concatenate([self.score, score]), np.concatenate([self.id, id_])
        order = np.lexsort((id_, -score, group))
        group, score, id_ = group[order], score[order], id_[order]
        starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        rank = np.arange(len(group)) - np.repeat(starts, np.diff(np.append(starts, len(group))))
        use = rank < self.k
        self.group, self.score, self.id = group[use], score[use], id_[use]
        last = rank == self.k - 1
        self.floor[group[last]] = score[last]


def scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact integer inner products of each anchor with each row."""
    largest = np.abs(anchors).max(initial=0).astype(float) * np.abs(rows).max(initial=0)
    if largest * anchors.shape[1] < 2**53:  # every partial sum is exact in a double
        return (anchors.astype(np.float64) @ rows.T.astype(np.float64)).astype(np.int64)
    return anchors.astype(np.int64) @ rows.T.astype(np.int64)


def limits(positive: np.ndarray, settings: Mining) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper limits of the windows of positive scores; none of both below zero."""
    lower = -(-settings.least_percent * positive // 100)
    upper = settings.most_percent * positive // 100
    empty = positive < 0
    return np.where(empty, np.iinfo(np.int64).max, lower), np.where(empty, LOWEST, upper)


def slot_of(score: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """The last positive of each anchor whose upper limit is not passed; -1 if there is none."""
    slot = np.full(score.shape, -1, np.int8)
    for j in range(upper.shape[1]):
        slot += (score <= upper[:, j, None]) & (upper[:, j, None] != LOWEST)
    return slot


def _merged(batches, block: Block, groups: int, k: int, entries):
    """Runs ``entries`` on every chunk of anchors and batch; yields (number, slot, id, score)."""
    best = [Best((s.stop - s.start) * groups, k) for s in block.chunks()]
    for batch in batches:
        for at in range(0, len(batch), 4096):
            part = batch.slice(at, 4096)
            rows = rows_of(part["v"], block.v.shape[1])
            label, vec_id = part["label"].to_numpy(), part["vec_id"].to_numpy()
            for chunk, top in zip(block.chunks(), best):
                group, score, row = entries(chunk, rows, label, vec_id, top)
                top.add(group, score, vec_id[row])
    for chunk, top in zip(block.chunks(), best):
        yield pa.RecordBatch.from_pydict({
            "number": block.number[chunk][top.group // groups],
            "slot": pa.array(top.group % groups, pa.int32()),
            "id": top.id, "score": top.score})


def _positives(block: Block, settings: Mining):
    def run(batches):
        def entries(chunk, rows, label, vec_id, top):
            score = scores(block.v[chunk], rows)
            use = (block.label[chunk, None] == label) & (block.vec_id[chunk, None] != vec_id)
            anchor, row = np.nonzero(use & (score >= top.floor[: len(score), None]))
            return anchor, score[anchor, row], row

        yield from _merged(batches, block, 1, settings.positives, entries)

    return run


def _negatives(block: Block, lower: np.ndarray, upper: np.ndarray, settings: Mining):
    slots = lower.shape[1]

    def run(batches):
        def entries(chunk, rows, label, vec_id, top):
            score = scores(block.v[chunk], rows)
            slot = slot_of(score, upper[chunk])
            floor = np.maximum(lower[chunk], top.floor.reshape(-1, slots)[: len(score)])
            # A slot of -1 reads the last one's floor, and is left out.
            use = (slot >= 0) & (block.label[chunk, None] != label)
            use &= score >= np.take_along_axis(floor, slot.astype(np.int64), axis=1)
            anchor, row = np.nonzero(use)
            return anchor * slots + slot[anchor, row], score[anchor, row], row

        yield from _merged(batches, block, slots, settings.negatives, entries)

    return run


def _first(found: DataFrame, groups: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*groups).orderBy(F.desc("score"), "id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def _mine(ready: DataFrame, block: Block, settings: Mining) -> DataFrame:
    """Rows of RESULT for the anchors of one block."""
    spark, schema = ready.sparkSession, "number bigint, slot int, id bigint, score bigint"
    sent = spark.sparkContext.broadcast(block)
    positives = kept(
        _first(ready.mapInArrow(lambda b: _positives(sent.value, settings)(b), schema),
               ["number"], settings.positives)
        .select("number", (F.col("place") - 1).alias("slot"), "id", "score"), "mining-positives")
    # At most anchors_per_pass x positives rows.
    known = positives.select("number", "slot", "score").toArrow()
    positive = np.full((len(block.number), settings.positives), -1)
    order = np.argsort(block.number)
    at = order[np.searchsorted(block.number[order], known["number"].to_numpy())]
    positive[at, known["slot"].to_numpy()] = known["score"].to_numpy()
    bounds = spark.sparkContext.broadcast(limits(positive, settings))
    found = ready.mapInArrow(lambda b: _negatives(sent.value, *bounds.value, settings)(b), schema)
    runs = _first(found, ["number", "slot"], settings.negatives).groupBy("number").agg(
        F.sort_array(F.collect_list(F.struct("slot", (-F.col("score")).alias("less"), "id")))
        .alias("run"))  # at most positives x negatives entries, from the highest score down
    suffix = F.slice(F.filter("run", lambda x: x["slot"] >= F.col("slot")), 1, settings.negatives)
    inside = F.filter(suffix, lambda x: -x["less"] * 100 >= settings.least_percent * F.col("score"))
    ids = spark.createDataFrame(pa.table(
        {"number": block.number, "anchor_id": block.vec_id}))
    return kept(
        positives.where("score >= 0").join(runs, "number").join(ids, "number")
        .select("anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"),
                F.posexplode(inside).alias("place", "negative"))
        .select("anchor_id", "positive_id", (F.col("place") + 1).cast("int").alias("rank"),
                F.col("negative.id").alias("negative_id"), "positive_score",
                (-F.col("negative.less")).alias("negative_score")),
        "mining-block")


def _ready(settings: Mining):
    def run(batches):
        for batch in batches:
            if len(batch):
                lengths = np.diff(batch["embedding"].offsets.to_numpy())
                v = integers(rows_of(batch["embedding"], int(lengths.max())), settings.scale)
                yield pa.RecordBatch.from_pydict({
                    "vec_id": batch["vec_id"], "label": batch["label"],
                    "anchor": batch["anchor"], "v": lists(v, pa.int32())})

    return run


def hard_negatives(vectors: DataFrame, is_anchor: Column, label: Column | None = None,
                   settings: Mining = Mining()) -> DataFrame:
    """Rows of RESULT: for each anchor and positive the first negatives within its window.

    ``vectors`` has vec_id and embedding; ``label`` (a long, the column of that name if not
    given) says which rows are alike; ``is_anchor`` picks the queries.
    """
    spark = vectors.sparkSession
    label = (F.col("label") if label is None else label).cast("bigint")
    ready = kept(
        vectors.where(F.col("vec_id").isNotNull() & label.isNotNull() & is_finite("embedding"))
        .select(F.col("vec_id").cast("bigint").alias("vec_id"), label.alias("label"),
                F.coalesce(is_anchor, F.lit(False)).alias("anchor"), "embedding")
        .mapInArrow(_ready(settings), "vec_id bigint, label bigint, anchor boolean, v array<int>"),
        "mining-vectors")
    anchors = ready.where("anchor")
    passes = -(-anchors.count() // settings.anchors_per_pass)
    if not passes:
        return spark.createDataFrame([], RESULT)
    dealt = kept(anchors.repartition(passes).select(
        F.spark_partition_id().alias("pass"), F.monotonically_increasing_id().alias("number"),
        "vec_id", "label", "v"), "mining-anchors")
    results, rows = [], ready.select("vec_id", "label", "v")
    for i in range(passes):
        part = dealt.where(F.col("pass") == i).toArrow().combine_chunks()
        for at in range(0, len(part), settings.anchors_per_pass):
            some = part.slice(at, settings.anchors_per_pass).combine_chunks()
            v = some["v"].combine_chunks()
            width = int(np.diff(v.offsets.to_numpy()).max())
            results.append(_mine(rows, Block(
                some["number"].to_numpy(), some["vec_id"].to_numpy(), some["label"].to_numpy(),
                rows_of(v, width)), settings))
    return reduce(DataFrame.unionAll, results)
