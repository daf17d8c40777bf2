"""Language ID by error-correcting output codes over binary n-gram classifiers.

Each learned language has a codeword of plus and minus ones: all non-trivial splits of the
languages where these are few, else seeded random columns. One binary classifier per bit
compares the n-gram frequencies of the languages on its two sides (smoothed log ratios of
hashed letter n-grams of one to four bytes). A text's margins are decoded by logistic loss,
weighted by how far apart the two sides of a bit are: the codeword with the least loss wins,
and a text whose two best codewords are close is flagged.

Training is one scan: a task adds up the n-gram counts per language of its rows, Spark sums
them per (language, bucket). What reaches the driver is languages x buckets numbers, whatever
the input. All training rows count; there is no sample. Prediction is one scalar Arrow UDF.

Edge cases: `und` with score 0 if the text is null, empty or without a letter, or if no
language was learned; with one language, that one with score 1; ties go to the language that
sorts first; repeated rows alike; an empty table gives an empty table.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from linkgrid.llm.common import fold_of, free_name, struct_array, utf8

UNKNOWN = "und"
PREDICTED = "lang_pred string, score double, margin double, ambiguous boolean"


@dataclass(frozen=True)
class Settings:
    folds: int = 3
    held_out: int = 1
    buckets: int = 1 << 13
    orders: int = 4
    smoothing: float = 1.0
    ambiguous: float = 0.2  # least share of loss by which the best codeword must lead
    seed: int = 9


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    codes: np.ndarray  # languages x bits, +1 or -1
    ratios: np.ndarray  # buckets x bits
    bit_weights: np.ndarray
    settings: Settings


# Letters in lower case, bytes of other scripts as they are, all else a blank.
_FOLD = np.full(256, 32, np.uint8)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[0x80:] = np.arange(0x80, 256)
_PRIME = np.uint32(0x9E3779B1)


def ngram_counts(data: bytes, settings: Settings) -> np.ndarray | None:
    """Counts by bucket of one text, or None if it has no letter."""
    folded = _FOLD[np.frombuffer(data, np.uint8)]
    if not (folded[:] != 32).any():
        return None
    if not ((folded >= 97) & (folded <= 122)).any():
        if not any(map(str.isalpha, data.decode("utf-8", "replace"))):
            return None
    folded = folded[np.concatenate([[True], (folded[1:] != 32) | (folded[:-1] != 32)])]
    folded = np.concatenate([[np.uint8(32)], folded, [np.uint8(32)]]).astype(np.uint32)
    shift = np.uint32(32 - settings.buckets.bit_length() + 1)
    total = np.zeros(settings.buckets, np.int64)
    rolled = np.zeros(len(folded), np.uint32)
    for n in range(1, settings.orders + 1):
        if len(folded) < n:
            break
        rolled = (rolled[: len(folded) - n + 1] << np.uint32(8)) | folded[n - 1 :]
        bucket = ((rolled + np.uint32(n)) * _PRIME) >> shift
        total += np.bincount(bucket, minlength=settings.buckets)
    return total


def codewords(languages: int, seed: int) -> np.ndarray:
    """Distinct rows of +1 and -1; no column is constant."""
    if languages < 2:
        return np.ones((languages, 1))
    if languages <= 5:
        columns = [
            (1, *rest) for rest in itertools.product((1, -1), repeat=languages - 1)
            if -1 in rest
        ]
        return np.array(columns, float).T
    rng = np.random.default_rng(seed)
    bits = int(np.ceil(10 * np.log2(languages)))
    while True:
        codes = rng.choice([-1.0, 1.0], (languages, bits))
        mixed = (np.abs(codes.sum(axis=0)) < languages).all()
        if mixed and len(np.unique(codes, axis=0)) == languages:
            return codes


def train(docs: DataFrame, settings: Settings = Settings()) -> Model:
    """A model from text and non-null lang of the rows outside the held-out fold."""
    training = fold_of("doc_id", settings.folds) != settings.held_out
    rows = docs.where(training & F.col("lang").isNotNull() & F.col("text").isNotNull())

    def sums(batches):
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, data in zip(batch["lang"].to_pylist(), batch["data"].to_pylist()):
                counts = ngram_counts(data, settings)
                if counts is None:
                    continue
                if lang in totals:
                    totals[lang] += counts
                else:
                    totals[lang] = counts
        for lang, counts in totals.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array([lang] * len(at), pa.string()),
                "bucket": pa.array(at.astype(np.int32)),
                "n": pa.array(counts[at]),
            })

    counted = (
        rows.select("lang", utf8().alias("data"))
        .mapInArrow(sums, "lang string, bucket int, n bigint")
        .groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    ).toArrow()
    languages = tuple(sorted(set(counted["lang"].to_pylist())))
    place = {name: i for i, name in enumerate(languages)}
    counts = np.zeros((len(languages), settings.buckets))
    at = np.array([place[x] for x in counted["lang"].to_pylist()], np.int64)
    if len(at):
        counts[at, counted["bucket"].to_numpy()] = counted["n"].to_numpy()
    return _model(languages, counts, settings)


def _model(languages: tuple[str, ...], counts: np.ndarray, settings: Settings) -> Model:
    codes = codewords(len(languages), settings.seed)
    bits = codes.shape[1] if len(languages) else 0
    # Every language counts alike, however much text it has.
    shares = counts + settings.smoothing
    shares = shares / shares.sum(axis=1, keepdims=True) if len(languages) else shares
    ratios = np.zeros((settings.buckets, bits))
    weights = np.ones(bits)
    for bit in range(bits):
        plus, minus = codes[:, bit] > 0, codes[:, bit] < 0
        if not plus.any() or not minus.any():
            continue
        a, b = shares[plus].mean(axis=0), shares[minus].mean(axis=0)
        ratios[:, bit] = np.log(a / b)
        weights[bit] = ((a - b) * ratios[:, bit]).sum()  # symmetric divergence of the sides
    weights = weights / weights.sum() if bits and weights.sum() else weights
    return Model(languages, codes, ratios, weights, settings)


def predict(data: bytes | None, model: Model) -> tuple[str, float, float, bool]:
    """(language, score, margin, ambiguous) of one text."""
    if not data or not model.languages:
        return UNKNOWN, 0.0, 0.0, False
    counts = ngram_counts(data, model.settings)
    if counts is None:
        return UNKNOWN, 0.0, 0.0, False
    if len(model.languages) == 1:
        return model.languages[0], 1.0, 1.0, False
    total = counts.sum()
    margins = (counts @ model.ratios) / np.sqrt(total)
    loss = np.logaddexp(0.0, -model.codes * margins) @ model.bit_weights
    order = np.argsort(loss, kind="stable")
    best, second = loss[order[0]], loss[order[1]]
    odds = np.exp(-(loss - best) * model.codes.shape[1])
    margin = float((second - best) / second) if second > 0 else 0.0
    score = float(1.0 / odds.sum())
    return model.languages[order[0]], score, margin, margin < model.settings.ambiguous


def with_language(docs: DataFrame, model: Model, text: str = "text",
                  name: str = "language") -> DataFrame:
    """``docs`` with a struct column as in PREDICTED."""

    @arrow_udf(PREDICTED)
    def language(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            rows = [predict(x, model) for x in batch.to_pylist()]
            columns = list(zip(*rows)) if rows else [(), (), (), ()]
            yield struct_array({
                "lang_pred": pa.array(columns[0], pa.string()),
                "score": pa.array(columns[1], pa.float64()),
                "margin": pa.array(columns[2], pa.float64()),
                "ambiguous": pa.array(columns[3], pa.bool_()),
            })

    return docs.withColumn(free_name(docs, name), language(utf8(docs[text])))


def language_report(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score, margin, ambiguous."""
    model = train(docs, settings)
    held = fold_of("doc_id", settings.folds) == settings.held_out
    rows = with_language(docs.select("doc_id", "text"), model)
    names = ["lang_pred", "score", "margin", "ambiguous"]
    return rows.select("doc_id", held.alias("held_out"), *[
        F.col("language")[n].alias(n) for n in names])
