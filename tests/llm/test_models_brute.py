"""The fitted models against plain versions: one table, dictionaries, loops."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkgrid.llm import language, quality

SF = "/root/testdata/sf0.001"


def fold(doc_id, parts):
    return zlib.crc32(str(doc_id).encode()) % parts


def isotonic(x, y):
    """The non-decreasing fit of least squares at each x, by the max-min formula."""
    order = sorted(set(x))
    groups = [[b for a, b in zip(x, y) if a == v] for v in order]
    sums = np.cumsum([0.0, *[sum(g) for g in groups]])
    sizes = np.cumsum([0, *[len(g) for g in groups]])
    mean = lambda i, j: (sums[j + 1] - sums[i]) / (sizes[j + 1] - sizes[i])
    n = len(order)
    return order, [max(min(mean(i, j) for j in range(k, n)) for i in range(k + 1)) for k in range(n)]


def test_quality_fit_is_the_ridge_solution_of_one_table(spark):
    settings = quality.Settings(features=40)
    stats = quality.statistics_table(spark.read.parquet(f"{SF}/documents.parquet"))
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", F.col("quality").alias("y"))
    rows = stats.join(labels, "doc_id").where("y is not null")
    model = quality.fit(rows.repartition(5), settings)
    table = rows.collect()
    x, y = np.array([r.x for r in table], float), np.array([r.y for r in table], float)
    later = np.array([fold(r.doc_id, settings.folds) == settings.calibrate for r in table])
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale <= 1e-9] = 1.0
    assert np.allclose(model.mean, mean) and np.allclose(model.scale, scale)
    z = np.clip((x - mean) / scale, -6, 6)
    design = np.cos(z @ model.waves + model.phase) * math.sqrt(2 / settings.features)
    design = np.column_stack([design, np.ones(len(x))])
    fitted, target = design[~later], y[~later]
    # Ridge as least squares on rows that stand for the penalty; the constant has none.
    root = math.sqrt(settings.ridge * len(fitted) + 1e-9)
    extra = np.eye(settings.features + 1) * root
    extra[-1, -1] = math.sqrt(1e-9)
    want, *_ = np.linalg.lstsq(
        np.vstack([fitted, extra]), np.append(target, np.zeros(settings.features + 1)), rcond=None)
    assert np.allclose(model.weights, want, atol=1e-6)
    raw = np.round(np.clip(design[later] @ model.weights, -2, 3), 3)
    knots, levels = isotonic(raw.tolist(), y[later].tolist())
    # Blocks are known by their centres; at each knot within a block the level is the block's.
    for knot, level in zip(knots, levels):
        near = int(np.abs(model.levels - level).argmin())
        assert model.levels[near] == pytest.approx(level)
    assert len(model.levels) == len(set(np.round(levels, 9)))


def grams_of(text):
    """Dictionary of the n-grams of one to four bytes of a text; None without a letter."""
    out = []
    for b in text.encode():
        c = chr(b).lower()
        out.append(ord(c) if b < 128 and "a" <= c <= "z" else b if b >= 128 else 32)
    if not any(97 <= b <= 122 for b in out) and not (
            any(b != 32 for b in out) and any(map(str.isalpha, text))):
        return None
    squeezed = [b for i, b in enumerate(out) if b != 32 or i == 0 or out[i - 1] != 32]
    data = bytes([32, *squeezed, 32])
    return Counter(data[i : i + n] for n in range(1, 5) for i in range(len(data) - n + 1))


def plain_language(docs, settings):
    """Predictions by dictionary counts and a loop over codewords and bits."""
    bits_left = 32 - (settings.buckets.bit_length() - 1)

    def bucketed(text):
        grams = grams_of(text)
        if grams is None:
            return None
        total = Counter()
        for gram, n in grams.items():
            key = (int.from_bytes(gram, "big") + len(gram)) % 2**32
            total[key * 0x9E3779B1 % 2**32 >> bits_left] += n
        return total

    counts = {d: bucketed(t) if t else None for d, t, _ in docs}
    by_language = {}
    for doc, _, lang in docs:
        if fold(doc, settings.folds) != settings.held_out and lang is not None and counts[doc]:
            by_language.setdefault(lang, Counter()).update(counts[doc])
    names = sorted(by_language)
    codes = language.codewords(len(names), settings.seed)
    shares = []
    for name in names:
        size = sum(by_language[name].values()) + settings.smoothing * settings.buckets
        shares.append([(by_language[name][b] + settings.smoothing) / size
                       for b in range(settings.buckets)])
    ratios, weights = [], []
    for bit in range(codes.shape[1]):
        sides = [[s for s, c in zip(shares, codes[:, bit]) if c == sign] for sign in (1, -1)]
        a, b = ([sum(v) / len(side) for v in zip(*side)] for side in sides)
        ratios.append([math.log(p / q) for p, q in zip(a, b)])
        weights.append(sum((p - q) * math.log(p / q) for p, q in zip(a, b)))
    found = {}
    for doc, own in counts.items():
        if own is None:
            found[doc] = ("und", 0.0)
            continue
        root = math.sqrt(sum(own.values()))
        margins = [sum(n * r[b] for b, n in own.items()) / root for r in ratios]
        loss = [sum(w * math.log1p(math.exp(-abs(c * m))) + w * max(0.0, -c * m)
                    for w, c, m in zip(weights, code, margins)) / sum(weights) for code in codes]
        best = min(range(len(names)), key=lambda i: (loss[i], i))
        odds = sum(math.exp(-(x - loss[best]) * codes.shape[1]) for x in loss)
        found[doc] = (names[best], 1 / odds)
    return found


def test_language_matches_dictionaries_and_loops(spark):
    settings = language.Settings()
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(150)
    odd = spark.createDataFrame(
        [(-1, "123 !", "en", "s", 5), (-2, "", None, "s", 0), (-3, "日本語", None, "s", 3)], docs.schema)
    docs = docs.unionByName(odd)
    want = plain_language([(r.doc_id, r.text, r.lang) for r in docs.collect()], settings)
    got = language.language_report(docs, settings).collect()
    assert len(got) == len(want)
    for r in got:
        lang, score = want[r.doc_id]
        assert r.lang_pred == lang and r.score == pytest.approx(score, abs=1e-9)
        assert r.held_out == (fold(r.doc_id, settings.folds) == settings.held_out)
