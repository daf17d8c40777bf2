"""Centroid clustering and hard negatives against brute force, and their edge cases."""

import hashlib
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from linkgrid.llm import centroids, negatives
from linkgrid.llm.queries import QUERIES
from linkgrid.llm.vectors import LARGEST, integers, rows_of

SF = "/root/testdata/sf0.01"


def vectors_of(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    return {r.vec_id: (r.label, [math.floor(256 * float(x)) for x in r.embedding]) for r in rows}


def brute_clusters(vectors, k=40, rounds=5):
    ids = sorted(vectors, key=lambda i: hashlib.sha256(f"2:{i}".encode()).hexdigest())
    means = [vectors[i][1] for i in ids[:k]]
    everyone = {i: np.array(v) for i, (_, v) in vectors.items()}
    for step in range(rounds + 1):
        near = {}
        for i, v in everyone.items():
            apart = [int(((v - np.array(m)) ** 2).sum()) for m in means]
            near[i] = (apart.index(min(apart)), min(apart))
        if step < rounds:
            for c in range(k):
                own = [everyone[i] for i, (x, _) in near.items() if x == c]
                if own:
                    means[c] = [int(s) // len(own) for s in np.sum(own, axis=0)]
    return near, means


def test_clusters_match_brute_force(spark):
    near, means = brute_clusters(vectors_of(spark))
    rows = QUERIES["op12_centroids"](spark, SF).collect()
    assert {r.vec_id: (r.cluster, r.distance) for r in rows} == near
    for r in rows:
        assert r.inertia == sum(d for _, d in near.values())
        assert r.cluster_inertia == sum(d for c, d in near.values() if c == r.cluster)
        text = ",".join(map(str, means[r.cluster]))
        assert r.centroid_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(3)
    middles = rng.integers(-3000, 3000, (12, 16))
    v = middles[rng.integers(0, 12, 2000)] + rng.integers(-20, 20, (2000, 16))
    pivots = centroids.choose_pivots(middles, 8)
    to_pivots = centroids.distances(v, pivots.points)
    low = centroids.least_squares(to_pivots, centroids.distances(middles, pivots.points), pivots)
    exact = ((v[:, None, :] - middles[None]) ** 2).sum(-1)
    assert (low <= exact).all()
    cluster, square, computed = centroids.nearest(v, to_pivots, middles, pivots)
    assert (cluster == exact.argmin(1)).all() and (square == exact.min(1)).all()
    assert computed < 0.5 * exact.size


def test_ties_go_to_the_smaller_number():
    middles = np.array([[4, 0], [-4, 0], [4, 0]])
    pivots = centroids.choose_pivots(middles, 8)
    v = np.array([[0, 0], [4, 0], [-4, 0], [0, 9]])
    cluster, _, _ = centroids.nearest(v, centroids.distances(v, pivots.points), middles, pivots)
    assert cluster.tolist() == [0, 0, 1, 0]


ODD = [
    (1, [1.0, 0.5], 1), (2, None, 1), (3, [1.0, None], 1), (4, [float("nan"), 1.0], 1),
    (5, [float("inf"), 1.0], 1), (6, [1.0], 1), (7, [], 1), (8, [1e30, -1e30], 1),
    (9, [-0.25, 0.75], None), (10, [-0.25, 0.75], 2), (10, [-0.25, 0.75], 2),
    (None, [0.5, 0.5], 2),
]


@pytest.fixture
def odd(spark):
    rows = spark.createDataFrame(ODD, "vec_id long, embedding array<float>, label int")
    extra = ["v", "cluster", "number", "slot", "anchor", "score", "distance", "pass", "run"]
    return rows.withColumns({c: F.lit(c) for c in extra})


def test_clusters_of_odd_rows(odd):
    settings = centroids.Clustering(clusters=3, components=2)
    rows = centroids.cluster_vectors(odd, settings).collect()
    assert sorted(str(r.vec_id) for r in rows) == ["1", "10", "10", "8", "9", "None"]
    assert len({(r.cluster, r.distance) for r in rows if r.vec_id == 10}) == 1
    assert centroids.cluster_vectors(odd.where("false"), settings).collect() == []
    none = centroids.cluster_vectors(odd.where("vec_id = 2"), settings)
    assert none.collect() == [] and none.columns[0] == "vec_id"


def test_integers_are_floored_and_bounded():
    column = pa.array([[0.5, -0.001], [1e30, -1e30], [0.25]], pa.list_(pa.float32()))
    got = integers(rows_of(column, 2), 256)
    assert got.tolist() == [[128, -1], [LARGEST, -LARGEST], [64, 0]]
    assert rows_of(column.slice(1), 1).tolist() == [[np.float32(1e30)], [0.25]]


def brute_negatives(vectors, anchors, k=5, m=10):
    out = set()
    for a in anchors:
        label, v = vectors[a]
        score = {i: sum(x * y for x, y in zip(v, w)) for i, (_, w) in vectors.items() if i != a}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if vectors[i][0] == label][:k]:
            s = score[p]
            inside = [i for i in order if vectors[i][0] != label
                      and 30 * s <= 100 * score[i] <= 90 * s][:m]
            out |= {(a, p, r + 1, i, s, score[i]) for r, i in enumerate(inside)}
    return out


def moved(vectors):
    return {i: ((label + 1) % 10 if i % 7 == 0 else label, v) for i, (label, v) in vectors.items()}


def test_negatives_match_brute_force(spark):
    vectors = moved(vectors_of(spark))
    rows = [tuple(r) for r in QUERIES["op13_hard_negatives"](spark, SF).collect()]
    assert len(rows) == len(set(rows))
    assert set(rows) == brute_negatives(vectors, [i for i in vectors if i % 100 == 0])


def test_blocks_of_anchors_do_not_change_the_result(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id < 200")
    settings = negatives.Mining(positives=3, negatives=4, anchors_per_pass=7)
    got = negatives.hard_negatives(table, F.col("vec_id") % 10 == 0, settings=settings)
    vectors = {i: v for i, v in vectors_of(spark).items() if i < 200}
    want = brute_negatives(vectors, range(0, 200, 10), 3, 4)
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want) > 20


def test_slots_answer_overlapping_windows():
    upper = np.array([[90, 45, 45, negatives.LOWEST]])
    score = np.array([[91, 90, 46, 45, 0, -5]])
    assert negatives.slot_of(score, upper).tolist() == [[-1, 0, 0, 2, 2, 2]]
    lower, top = negatives.limits(np.array([101, 7, 0, -1]), negatives.Mining())
    assert lower.tolist()[:3] == [31, 3, 0] and top.tolist()[:3] == [90, 6, 0]
    assert top[3] == negatives.LOWEST


def test_combiner_keeps_the_first_by_score_then_id():
    best = negatives.Best(2, 2)
    best.add(np.array([0, 0, 1]), np.array([5, 5, 1]), np.array([9, 3, 7]))
    best.add(np.array([0, 1]), np.array([5, 2]), np.array([1, 8]))
    assert list(zip(best.group, best.score, best.id)) == [(0, 5, 1), (0, 5, 3), (1, 2, 8), (1, 1, 7)]
    assert best.floor.tolist() == [5, 1]


def test_exact_scores_beyond_doubles():
    big = np.full((1, 64), LARGEST, np.int32)
    assert negatives.scores(big, big)[0, 0] == 64 * LARGEST**2
    assert negatives.scores(big - 1, big)[0, 0] == 64 * LARGEST * (LARGEST - 1)


def test_negatives_of_odd_rows(spark, odd):
    every = negatives.hard_negatives(odd, F.lit(True)).collect()
    ids = {r.anchor_id for r in every} | {r.negative_id for r in every}
    assert ids <= {1, 6, 7, 8, 10} and all(r.rank >= 1 for r in every)
    assert negatives.hard_negatives(odd.where("false"), F.lit(True)).collect() == []
    assert negatives.hard_negatives(odd, F.lit(False)).collect() == []
    same = [(100, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.5, 0.0], 2), (2, [0.5, 0.0], 2)]
    rows = spark.createDataFrame(same, "vec_id long, embedding array<float>, label int")
    got = negatives.hard_negatives(rows, F.col("vec_id") == 100).collect()
    assert [(r.rank, r.negative_id, r.negative_score) for r in got] == [(1, 2, 32768), (2, 2, 32768)]
