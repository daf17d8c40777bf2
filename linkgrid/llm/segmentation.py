"""SentencePiece encoding and decoding with n-best segmentations.

A segment's piece lattice is solved by a forward Viterbi pass; its scores are the exact
heuristic of a backward A-star search, which therefore takes paths off its agenda best first.
Segments are independent (see pieces.py), so the n best segmentations of a text are merged
from those of its segments: only the n-1 occurrences with the least gap between best and
second best can differ from the best path, and only for those is the search run. The gap is
exact: the second best path holds an edge off the best one, so it is the best over such edges
of forward score + edge + backward score.

Best paths follow the tokenizer's tie rule (of equal scores the piece that starts first stays).
Alternatives of equal total score are ordered by the place of their first change, and within a
segment as the search meets them.

Encoding is one scalar Arrow UDF over whole texts, decoding another; no shuffle. Memory per
task is one Arrow batch and a bounded memo, which the tasks of a Python worker share.

Edge cases: null and empty text give no pieces, score 0 and no alternatives, and decode to an
empty text; U+2581 in a text is read as a space, as the tokenizer does; unknown characters
become byte pieces (or the unknown id where the vocabulary has none, which decodes to U+2047);
an unknown id in decoding counts as nothing; repeated rows alike; an empty table gives an empty
table; other columns pass through.
"""

from __future__ import annotations

import gc
import heapq
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from linkgrid.llm.common import free_name, struct_array, text_of
from linkgrid.llm.pieces import SPACE, Memo, Vocabulary

ENCODED = (
    "ids array<int>, n_pieces bigint, score double, restored boolean, "
    "alternatives array<struct<score: double, n_pieces: bigint, "
    "changes: array<struct<start: int, removed: int, ids: array<int>>>>>"
)
_CHANGES = pa.list_(pa.struct([
    ("start", pa.int32()), ("removed", pa.int32()), ("ids", pa.list_(pa.int32())),
]))
_ALTERNATIVES = pa.list_(pa.struct([
    ("score", pa.float64()), ("n_pieces", pa.int64()), ("changes", _CHANGES),
]))
_LOW = float("-inf")
#: Segments in a generation of a memo; with some 400 bytes each, two of them take 50 MB at most.
#: Idle workers keep theirs while other stages run.
SEGMENTS_KEPT = 60_000
#: Objects made between two looks for cycles while texts are encoded. Results of segments hold no
#: cycles, so that going through the memo for some finds nothing.
COLLECT_EVERY = 100_000

#: The segmenter of this Python worker, which the tasks it runs share one after the other.
_own: dict = {}


def segmenter(vocabulary: Vocabulary, n_best: int) -> Segmenter:
    """The worker's segmenter with what it has solved, or a new one for another vocabulary."""
    key = hash(vocabulary.pieces), hash(vocabulary.scores), hash(vocabulary.ids), n_best
    if key not in _own:
        _own.clear()
        _own[key] = Segmenter(vocabulary, n_best)
    return _own[key]


@contextmanager
def rare_collection():
    before = gc.get_threshold()
    gc.set_threshold(COLLECT_EVERY, *before[1:])
    try:
        yield
    finally:
        gc.set_threshold(*before)


class Segmenter:
    def __init__(self, vocabulary: Vocabulary, n_best: int = 1) -> None:
        self.vocabulary, self.n_best = vocabulary, n_best
        self.trie = vocabulary.automaton()
        self.singles = vocabulary.singles()
        self.unknown = vocabulary.unknown_score
        self.memo = Memo(self._best, size=SEGMENTS_KEPT)
        self.others = Memo(self._alternatives, size=SEGMENTS_KEPT // 10)
        size = max([*vocabulary.ids, *vocabulary.byte_ids, vocabulary.unknown_id]) + 1
        self.bytes_of = [b""] * size
        for number, piece in zip(vocabulary.ids, vocabulary.pieces):
            self.bytes_of[number] = piece.replace(SPACE, " ").encode()
        for value, number in enumerate(vocabulary.byte_ids):
            self.bytes_of[number] = bytes([value])
        self.bytes_of[vocabulary.unknown_id] = " ⁇ ".encode()

    def _fallback(self, character: str) -> tuple[int, ...]:
        table = self.vocabulary.byte_ids
        if not table:
            return (self.vocabulary.unknown_id,)
        return tuple(table[b] for b in character.encode())

    def lattice(self, segment: str) -> tuple[list, list]:
        """Edges by their end, and the forward scores.

        An edge is (start, score, id); id -1 is an unknown character.
        """
        size = len(segment)
        into: list = [[] for _ in range(size + 1)]
        for last, (length, score, number) in self.trie.iter(segment):
            into[last + 1].append((last + 1 - length, score, number))
        forward = [0.0] + [_LOW] * size
        for end in range(1, size + 1):
            if segment[end - 1] not in self.singles:
                into[end].append((end - 1, self.unknown, -1))
            forward[end] = max(forward[start] + score for start, score, _ in into[end])
        return into, forward

    def _ids(self, segment: str, path: Sequence[tuple]) -> tuple[int, ...]:
        out: list[int] = []
        for start, _, number in path:
            if number < 0:
                out.extend(self._fallback(segment[start]))
            else:
                out.append(number)
        return tuple(out)

    def _best(self, key: str) -> tuple[tuple[int, ...], float, float, bool]:
        """(ids, score, gap to the second best path, restored) of a segment: forward Viterbi."""
        segment = " " + key
        size = len(segment)
        best = [_LOW] * (size + 1)
        second = [_LOW] * (size + 1)
        came: list = [None] * (size + 1)  # None: an unknown character
        best[0] = 0.0
        singles = self.singles
        done = 0
        for last, edge in self.trie.iter(segment):
            while done < last:
                done += 1
                if segment[done - 1] not in singles:
                    self._unknown_edge(done, best, second, came)
            end = last + 1
            length, score, _ = edge
            value = best[end - length] + score
            if value > best[end]:
                second[end] = max(best[end], second[end - length] + score)
                best[end] = value
                came[end] = edge
            elif value > second[end]:
                second[end] = value
        while done < size:
            done += 1
            if segment[done - 1] not in singles:
                self._unknown_edge(done, best, second, came)
        ids: list[int] = []
        end, strange = size, False
        while end:
            edge = came[end]
            if edge is None:
                ids.extend(reversed(self._fallback(segment[end - 1])))
                end, strange = end - 1, True
            else:
                ids.append(edge[2])
                end -= edge[0]
        ids.reverse()
        # Pieces spell the segment; only what stands for unknown characters may not.
        restored = not strange or b"".join([self.bytes_of[i] for i in ids]) == segment.encode()
        return tuple(ids), best[size], best[size] - second[size], restored

    def _unknown_edge(self, end: int, best: list, second: list, came: list) -> None:
        value = best[end - 1] + self.unknown
        if value > best[end]:
            second[end] = max(best[end], second[end - 1] + self.unknown)
            best[end], came[end] = value, None
        else:
            second[end] = max(second[end], value)

    def paths(self, segment: str, n: int) -> list[tuple[float, tuple[tuple, ...]]]:
        """The n best paths of one segment, best first: backward A-star."""
        into, forward = self.lattice(segment)
        size = len(segment)
        # Of equal totals the path nearest to its end goes first, so ties do not pile up.
        agenda: list = [(-forward[size], size, 0, 0.0, None)]
        found: list = []
        pushed = 0
        while agenda and len(found) < n:
            _, at, _, done, path = heapq.heappop(agenda)
            if at == 0:
                edges = []
                while path is not None:
                    edge, path = path
                    edges.append(edge)
                found.append((done, tuple(edges)))
                continue
            for edge in into[at]:
                so_far = edge[1] + done
                pushed += 1
                heapq.heappush(
                    agenda, (-(forward[edge[0]] + so_far), edge[0], pushed, so_far, (edge, path)))
        return found

    def _alternatives(self, key: str) -> list[tuple[float, tuple[int, ...]]]:
        """(loss against the best, ids) of the next n-1 paths of a segment."""
        ids, best, *_ = self.memo.find(key)
        segment = " " + key
        found = [(best - s, self._ids(segment, p)) for s, p in self.paths(segment, self.n_best)]
        for i, (_, other) in enumerate(found):
            if other == ids:
                del found[i]  # the search may order ties of the best path differently
                break
        return found[: self.n_best - 1]

    def encode(self, text: str) -> tuple[np.ndarray, float, list]:
        """(ids, score, alternatives as ENCODED states them) of a text."""
        return self.encode_checked(text)[:3]

    def encode_checked(self, text: str) -> tuple[np.ndarray, float, list, bool]:
        """As encode, and whether the ids decode to the text.

        Bytes of pieces are simply joined, so a text is restored if each segment is, as solved
        (a U+2581 of the text itself comes back as a space).
        """
        segments = self.vocabulary.segments(text)
        known = self.memo.find_all(set(segments))
        if not segments:
            return np.zeros(0, np.int32), 0.0, [], True
        parts, scores, gaps, restored = zip(*map(known.__getitem__, segments))
        whole = all(restored) and SPACE not in text
        ids = np.array(list(chain.from_iterable(parts)), np.int32)
        score = sum(scores)
        if self.n_best < 2:
            return ids, score, [], whole
        others = self._merge(segments, parts, np.array(gaps), len(ids), score)
        return ids, score, others, whole

    def _merge(self, segments: list, parts: tuple, gaps: np.ndarray, size: int,
               score: float) -> list:
        n = self.n_best
        if len(gaps) > n:
            least = np.partition(gaps, n - 2)[n - 2]
            near = np.flatnonzero(gaps <= least)
        else:
            near = np.arange(len(gaps))
        near = [int(i) for i in near if gaps[i] < float("inf")]
        near = sorted(near, key=lambda i: (gaps[i], i))[: n - 1]
        plans: list = [(0.0, ())]
        for i in near:
            options = self.others.find(segments[i])
            plans += [
                (loss + more, tuple(sorted((*changes, (i, k)))))
                for loss, changes in plans
                for k, (more, _) in enumerate(options)
            ]
            plans = heapq.nsmallest(n, plans)
        if not near:
            return []
        out = []
        for loss, changes in plans[1:]:
            edits, length = [], size
            for i, k in changes:
                new = self.others.find(segments[i])[k][1]
                removed = len(parts[i])
                start = sum(map(len, parts[:i]))
                edits.append({"start": start, "removed": removed, "ids": list(new)})
                length += len(new) - removed
            out.append({"score": score - loss, "n_pieces": length, "changes": edits})
        return out

    def decode(self, ids: Sequence[int]) -> str:
        table, size = self.bytes_of, len(self.bytes_of)
        try:
            data = b"".join([table[i] for i in ids])
        except IndexError:
            data = b"".join([table[i] for i in ids if i < size])
        return data[1:].decode("utf-8", "replace") if data[:1] == b" " else data.decode(
            "utf-8", "replace")


def apply_changes(ids: Sequence[int], changes: Sequence) -> list[int]:
    """The ids of an alternative, from those of the best path and its changes."""
    out, at = [], 0
    for change in changes:
        out += [*ids[at : change["start"]], *change["ids"]]
        at = change["start"] + change["removed"]
    return [*out, *ids[at:]]


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
    flat = np.concatenate(rows) if rows else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()))


def with_pieces(docs: DataFrame, vocabulary: Vocabulary, n_best: int = 1, text: str = "text",
                name: str = "encoded") -> DataFrame:
    """``docs`` with a struct column as in ENCODED.

    ``restored`` says whether the ids decode to the text again. The alternatives are the next
    ``n_best - 1`` segmentations, each as its changes against the best (see apply_changes).
    """

    @arrow_udf(ENCODED)
    def encoded(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tool = segmenter(vocabulary, n_best)
        for batch in texts:
            ids, scores, others, same = [], [], [], []
            with rare_collection():
                for text in batch.to_pylist():
                    row, score, more, whole = tool.encode_checked(text)
                    ids.append(row)
                    scores.append(score)
                    others.append(more)
                    same.append(whole)
            yield struct_array({
                "ids": _lists(ids),
                "n_pieces": pa.array([len(x) for x in ids], pa.int64()),
                "score": pa.array(scores, pa.float64()),
                "restored": pa.array(same, pa.bool_()),
                "alternatives": pa.array(others, _ALTERNATIVES),
            })

    return docs.withColumn(free_name(docs, name), encoded(text_of(docs[text])))


def with_decoded(rows: DataFrame, vocabulary: Vocabulary, ids: str = "ids",
                 name: str = "decoded") -> DataFrame:
    """``rows`` with the text that the ids stand for; null ids give an empty text."""

    @arrow_udf("string")
    def decoded(lists: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tool = Segmenter(vocabulary)
        for batch in lists:
            yield pa.array(
                [tool.decode([i for i in x if i is not None and i >= 0]) for x in batch.to_pylist()],
                pa.string(),
            )

    given = F.coalesce(rows[ids].cast("array<int>"), F.array().cast("array<int>"))
    return rows.withColumn(free_name(rows, name), decoded(given))


def encoded_documents(docs: DataFrame, vocabulary: Vocabulary, n_best: int = 3) -> DataFrame:
    """Per document: doc_id and all that ENCODED lists."""
    rows = with_pieces(docs.select("doc_id", "text"), vocabulary, n_best)
    names = ["ids", "n_pieces", "score", "restored", "alternatives"]
    return rows.select("doc_id", *[F.col("encoded")[n].alias(n) for n in names])
