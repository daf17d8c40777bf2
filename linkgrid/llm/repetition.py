"""Quality rules by repetition coverage: rolling hashes of several n-gram lengths in numpy.

Every text is one row of a scalar Arrow UDF, so the work is a projection: no shuffle, no state
between rows, and a lost task is simply run again. Words are the maximal runs of bytes other
than space and 0x09-0x0D of the whole text, which are word runs of code points too.

Edge cases: a null or empty text has zero counts and fails the base rule; a text of white
space only has no words and no duplicate lines; repeated rows are measured alike; an empty
table gives an empty table; all other columns pass through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from linkgrid.llm.common import free_name, struct_array, utf8

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
RATIOS = ["dup_line_chars", "top_2", "top_3", "top_4", *[f"dup_{n}" for n in range(5, 11)]]
SCHEMA = ", ".join(
    [f"{c} bigint" for c in BASE] + ["base_failed boolean"]
    + [f"{c} double" for c in RATIOS] + ["kept boolean"]
)


@dataclass(frozen=True)
class Limits:
    """Largest shares of word characters that a kept text may have.

    Looser than common published limits, so that one sentence said twice does not condemn a
    short text.
    """

    min_words: int = 50
    dup_line_chars: float = 0.30
    top_2: float = 0.30
    top_3: float = 0.28
    top_4: float = 0.26
    dup_5: float = 0.30
    dup_6: float = 0.28
    dup_7: float = 0.26
    dup_8: float = 0.24
    dup_9: float = 0.22
    dup_10: float = 0.20


# Classes of bytes: continuation, white space, counted symbol, any other first byte.
_CLASS = np.full(256, 3, np.uint8)
_CLASS[0x80:0xC0] = 0
_CLASS[[0x20, 9, 10, 11, 12, 13]] = 1
_CLASS[np.frombuffer(b"#*$%&|<>", np.uint8)] = 2
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def _chars(data: bytes) -> int:
    return len(data.decode("utf-8", "replace"))


def _spread(ids: np.ndarray) -> np.ndarray:
    x = (ids.view(np.uint64) + np.uint64(1)) * _BASE
    x ^= x >> np.uint64(29)
    x *= _MIX
    return x ^ (x >> np.uint64(32))


def _lengths(classes: np.ndarray) -> np.ndarray:
    """Code points of each word, from the classes of the bytes."""
    inside = np.concatenate([[False], classes != 1, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    upto = np.concatenate([[0], np.cumsum(classes >= 2)])[edges]
    return upto[1::2] - upto[::2]


def _repeats(keys: np.ndarray) -> np.ndarray | None:
    """How often each window's key occurs, or None where all differ."""
    ordered = np.sort(keys)
    if not (ordered[1:] == ordered[:-1]).any():
        return None
    _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
    return counts[inverse]


def _covered(starts: np.ndarray, n: int, words: int) -> np.ndarray:
    steps = np.zeros(words + 1, np.int32)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + n, -1)
    return np.cumsum(steps[:-1]) > 0


def measure(data: bytes) -> list:
    """The five counts and the shares of one text, in the order of BASE and RATIOS."""
    classes = _CLASS[np.frombuffer(data, np.uint8)]
    sizes = np.bincount(classes, minlength=4)
    words = data.split()
    total = int(sizes[2] + sizes[3])
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    repeated = len(lines) - len(set(lines))
    counts = [len(words), total, int(sizes[2]), repeated, 0]
    shares = dict.fromkeys(RATIOS, 0.0)
    if repeated:
        seen: set[bytes] = set()
        inside = 0
        for line in lines:
            if line in seen:
                inside += sum(map(_chars, line.split()))
            seen.add(line)
        shares["dup_line_chars"] = inside / total
    if len(words) < 2:
        return counts + list(shares.values())
    marks = _spread(np.fromiter(map(hash, words), np.int64, len(words)))
    rolled, lengths = marks, None
    for n in range(2, 11):
        if len(words) < n:
            break
        rolled = rolled[:-1] * _BASE + marks[n - 1 :]
        times = _repeats(rolled)
        if times is None:
            break  # a longer repeat would hold a repeat of this length
        if lengths is None:
            lengths = _lengths(classes)
            ends = np.concatenate([[0], np.cumsum(lengths)])
        if n == 3:
            counts[4] = int(_covered(np.flatnonzero(times > 1), n, len(words)).sum())
        if n <= 4:
            spans = (ends[n:] - ends[:-n]) * times
            shares[f"top_{n}"] = int(spans[times > 1].max()) / total
        else:
            # Windows after the first of their kind; their characters count once.
            first = np.zeros(len(rolled), bool)
            first[np.unique(rolled, return_index=True)[1]] = True
            inside = _covered(np.flatnonzero(~first), n, len(words))
            shares[f"dup_{n}"] = int(lengths[inside].sum()) / total
    return counts + list(shares.values())


def with_repetition(docs: DataFrame, limits: Limits = Limits(), text: str = "text",
                    name: str = "rules") -> DataFrame:
    """``docs`` with one struct column: the counts, the shares and the verdicts."""

    @arrow_udf(SCHEMA)
    def rules(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            rows = [measure(x) for x in batch.to_pylist()]
            columns = list(zip(*rows)) if rows else [()] * (len(BASE) + len(RATIOS))
            out = dict(zip(BASE + RATIOS, columns))
            base = [
                w < limits.min_words or 100 * r > 50 * w
                for w, r in zip(out["n_words"], out["n_repeat_words"])
            ]
            kept = [
                not failed and all(v <= getattr(limits, c) for c, v in zip(RATIOS, row[len(BASE):]))
                for failed, row in zip(base, rows)
            ]
            yield struct_array(
                {c: pa.array(out[c], pa.int64()) for c in BASE}
                | {"base_failed": pa.array(base, pa.bool_())}
                | {c: pa.array(out[c], pa.float64()) for c in RATIOS}
                | {"kept": pa.array(kept, pa.bool_())}
            )

    return docs.withColumn(free_name(docs, name), rules(utf8(docs[text])))


def repetition_report(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Per document: doc_id, the counts, base_failed, the verdict and the shares behind it."""
    measured = with_repetition(docs.select("doc_id", "text"), limits)
    rules = F.col("rules")
    names = [*BASE, "base_failed", "kept", *RATIOS]
    return measured.select("doc_id", *[rules[n].alias(n) for n in names])
