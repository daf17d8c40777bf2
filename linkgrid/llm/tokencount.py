"""Token counts by a count-only Viterbi over a unigram piece vocabulary.

Aho-Corasick enumerates the pieces that end at each character; dynamic programming carries the
best score and its piece count, nothing else. Tie rules are the tokenizer's: of equal scores
at a position the piece that starts first stays; a character without a piece of its own is
unknown, scores the least piece minus ten, and counts as its UTF-8 bytes where the vocabulary
has byte pieces (else as one).

One scalar Arrow UDF over whole texts: a projection without shuffle. Segments (see pieces.py)
are solved once and kept in a bounded memo, so the cost follows the distinct words of a task.

Edge cases: null and empty text count 0 with score 0; ties as above; repeated rows alike; an
empty table gives an empty table; other columns pass through.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.functions import arrow_udf

from linkgrid.llm.common import free_name, struct_array, text_of
from linkgrid.llm.pieces import Memo, Vocabulary

_LOW = float("-inf")


class CountViterbi:
    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.trie = vocabulary.automaton()
        self.singles = vocabulary.singles()
        self.unknown = vocabulary.unknown_score
        self.bytes = bool(vocabulary.byte_ids)
        self.memo = Memo(self.solve)

    def solve(self, segment: str) -> tuple[int, float]:
        """(pieces, score) of the best path through one segment, its first space put back."""
        segment = " " + segment
        size = len(segment)
        best = [_LOW] * (size + 1)
        count = [0] * (size + 1)
        best[0] = 0.0
        singles = self.singles
        done = 0  # positions up to here are final
        for last, (length, score, _) in self.trie.iter(segment):
            end = last + 1
            while done < last:
                done += 1
                if segment[done - 1] not in singles:
                    self._unknown(segment, done, best, count)
            start = end - length
            value = best[start] + score
            if value > best[end]:
                best[end] = value
                count[end] = count[start] + 1
        while done < size:
            done += 1
            if segment[done - 1] not in singles:
                self._unknown(segment, done, best, count)
        return count[size], best[size]

    def _unknown(self, segment: str, end: int, best: list, count: list) -> None:
        value = best[end - 1] + self.unknown
        if value > best[end]:
            best[end] = value
            width = len(segment[end - 1].encode()) if self.bytes else 1
            count[end] = count[end - 1] + width

    def count(self, text: str) -> tuple[int, float]:
        pieces, score = 0, 0.0
        times_of = Counter(self.vocabulary.segments(text))
        for segment, (n, s) in self.memo.find_all(times_of).items():
            times = times_of[segment]
            pieces += n * times
            score += s * times
        return pieces, score


def with_token_counts(docs: DataFrame, vocabulary: Vocabulary, text: str = "text",
                      name: str = "tokens") -> DataFrame:
    """``docs`` with a struct column: n_tokens and the score of the best segmentation."""

    @arrow_udf("n_tokens bigint, score double")
    def tokens(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = CountViterbi(vocabulary)  # its memo goes with the task
        for batch in texts:
            rows = [counter.count(x) for x in batch.to_pylist()]
            yield struct_array({
                "n_tokens": pa.array([r[0] for r in rows], pa.int64()),
                "score": pa.array([r[1] for r in rows], pa.float64()),
            })

    return docs.withColumn(free_name(docs, name), tokens(text_of(docs[text])))


def token_counts(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Per document: doc_id, n_tokens, score."""
    counted = with_token_counts(docs.select("doc_id", "text"), vocabulary)
    return counted.select("doc_id", "tokens.n_tokens", "tokens.score")
