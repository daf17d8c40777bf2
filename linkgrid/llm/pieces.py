"""A piece vocabulary with scores, and where its lattice falls apart.

The vocabulary is read from a public model file on the driver (its size is that of the file)
and sent with the task. Text is prepared as the tokenizer does: a space is put in front, and
spaces become U+2581. Where no piece holds U+2581 after another character, no piece crosses
the border before a run of spaces, and each segment between borders can be solved by itself;
otherwise the whole text is one segment.
"""

from __future__ import annotations

from dataclasses import dataclass

import ahocorasick
import sentencepiece

SPACE = "▁"
UNKNOWN_PENALTY = 10.0


@dataclass(frozen=True)
class Vocabulary:
    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    ids: tuple[int, ...]
    byte_ids: tuple[int, ...]  # ids of the 256 byte pieces, or empty
    unknown_id: int
    splits: bool = True

    @property
    def unknown_score(self) -> float:
        return min(self.scores) - UNKNOWN_PENALTY

    def segments(self, text: str) -> list[str]:
        """The independent parts of a prepared text, each without its first space."""
        if not text:
            return []
        text = text.replace(SPACE, " ")
        parts = text.split(" ") if self.splits else [text]
        if "" not in parts:
            return parts
        out, spaces = [], 0
        for part in parts:
            if part:
                out.append(" " * spaces + part)
                spaces = 0
            else:
                spaces += 1
        if spaces:
            out.append(" " * (spaces - 1))
        return out

    def automaton(self) -> ahocorasick.Automaton:
        """Aho-Corasick over the pieces; values are (length, score, id)."""
        trie = ahocorasick.Automaton()
        for piece, score, number in zip(self.pieces, self.scores, self.ids):
            piece = piece.replace(SPACE, " ")
            trie.add_word(piece, (len(piece), score, number))
        trie.make_automaton()
        return trie

    def singles(self) -> frozenset[str]:
        return frozenset(p.replace(SPACE, " ") for p in self.pieces if len(p) == 1)


def load(path: str) -> Vocabulary:
    """Normal pieces and byte pieces of a SentencePiece model file."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.vocab_size()
    special = [
        model.is_control(i) or model.is_unknown(i) or model.is_byte(i) for i in range(size)
    ]
    normal = [i for i in range(size) if not special[i]]
    pieces = tuple(model.id_to_piece(i) for i in normal)
    byte_ids = tuple(i for i in range(size) if model.is_byte(i))
    splits = not any(SPACE in p.lstrip(SPACE) for p in pieces)
    return Vocabulary(
        pieces, tuple(model.get_score(i) for i in normal), tuple(normal),
        byte_ids if len(byte_ids) == 256 else (), model.unk_id(), splits,
    )


class Memo:
    """Results by segment in two generations, so that memory is bounded and common segments stay.

    Segments longer than ``longest`` characters are never kept. Results are truthy.
    """

    def __init__(self, solve, size: int = 200_000, longest: int = 32) -> None:
        self.solve, self.size, self.longest = solve, size, longest
        self.young: dict = {}
        self.old: dict = {}

    def find(self, segment: str):
        return self.young.get(segment) or self._slow(segment)

    def _slow(self, segment: str):
        found = self.old.get(segment)
        if found is None:
            found = self.solve(segment)
            if len(segment) > self.longest:
                return found
        self.young[segment] = found
        if len(self.young) >= self.size:
            self.old, self.young = self.young, {}
        return found

    def find_all(self, segments) -> dict:
        """The results of distinct segments."""
        young, slow = self.young, self._slow
        out = {}
        for segment in segments:
            found = young.get(segment)
            if found is None:
                found = slow(segment)
                young = self.young
            out[segment] = found
        return out
