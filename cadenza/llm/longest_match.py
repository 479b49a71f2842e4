"""Word-piece counts by a linear longest-match automaton.

A trie holds the vocabulary: word-initial pieces below one root, inner pieces below another.
Where no edge fits, a failure link leads to the node of what is left after the pieces that
greedy longest match would cut off, and only the number of those pieces is kept at the node.
So a word is counted in one pass, without backing up and without building pieces. The trie is
over UTF-8 bytes, which split at the same places as characters do.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from cadenza.llm import arrow_text as at

#: Distinct words whose counts a task remembers between batches.
KNOWN_WORDS = 1 << 19
INITIAL, INNER = 0, 1


class LongestMatch:
    """Counts the greedy longest-match pieces of a word; 0 where the vocabulary cannot spell it."""

    def __init__(self, initial: Iterable[bytes], inner: Iterable[bytes]) -> None:
        self.edges: dict[int, int] = {}
        nodes = [(-1, 0), (-1, 0)]  # (parent, byte)
        is_piece = [False, False]
        lone_mark = False
        for root, pieces in ((INITIAL, initial), (INNER, inner)):
            for piece in pieces:
                node = root
                for byte in piece:
                    follower = self.edges.get(node << 8 | byte)
                    if follower is None:
                        follower = len(nodes)
                        self.edges[node << 8 | byte] = follower
                        nodes.append((node, byte))
                        is_piece.append(False)
                    node = follower
                if piece:
                    is_piece[node] = True
                elif root == INITIAL:
                    lone_mark = True
        self.fail = [-1] * len(nodes)
        self.popped = [0] * len(nodes)
        if lone_mark:  # the empty word-initial piece: one token, and the word goes on inside
            self.fail[INITIAL], self.popped[INITIAL] = INNER, 1
        depth = [0] * len(nodes)
        for node in range(2, len(nodes)):
            depth[node] = depth[nodes[node][0]] + 1
        for node in sorted(range(2, len(nodes)), key=depth.__getitem__):
            self._link(node, *nodes[node], is_piece[node])

    def _link(self, node: int, parent: int, byte: int, is_piece: bool) -> None:
        if is_piece:
            self.fail[node], self.popped[node] = INNER, 1
            return
        count, back = self.popped[parent], self.fail[parent]
        while back >= 0 and (back << 8 | byte) not in self.edges:
            count += self.popped[back]
            back = self.fail[back]
        if back >= 0:
            self.fail[node], self.popped[node] = self.edges[back << 8 | byte], count

    def count(self, word: bytes) -> int:
        edges, fail, popped = self.edges, self.fail, self.popped
        node, pieces = INITIAL, 0
        for byte in word:
            follower = edges.get(node << 8 | byte)
            while follower is None:
                if fail[node] < 0:
                    return 0
                pieces += popped[node]
                node = fail[node]
                follower = edges.get(node << 8 | byte)
            node = follower
        while node != INNER:  # the end of the word fits no edge
            if fail[node] < 0:
                return 0
            pieces += popped[node]
            node = fail[node]
        return pieces


def vocabulary(path: str) -> tuple[list[bytes], list[bytes]]:
    """(word-initial, inner) pieces of a public model: those with and without the word mark.

    Byte tokens, control tokens and pieces with a mark elsewhere spell no part of a word.
    """
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    initial, inner = [], []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or "▁" in piece[1:]:
            continue
        if piece.startswith("▁"):
            initial.append(piece[1:].encode())
        else:
            inner.append(piece.encode())
    return [p for p in initial if p], inner


def spelling(path: str) -> tuple[list[bytes], list[bytes]]:
    """``vocabulary`` with all that spells a word: the lone mark as an empty initial piece, and byte tokens.

    A byte token goes on inside a word, so a character without a piece counts its bytes.
    """
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    initial, inner = vocabulary(path)
    names = [(model.id_to_piece(i), model.is_byte(i)) for i in range(model.get_piece_size())]
    lone = [b"" for piece, _ in names if piece == "▁"]
    return initial + lone, inner + [bytes([int(piece[1:-1], 16)]) for piece, is_byte in names if is_byte]


@lru_cache(maxsize=2)
def automaton(path: str, spell: bool = False) -> LongestMatch:
    return LongestMatch(*(spelling(path) if spell else vocabulary(path)))


class KnownCounts:
    """Counts of words by hash, up to a bound; words beyond it are counted anew each time."""

    def __init__(self, bound: int) -> None:
        self.bound = bound
        self.names = np.zeros(0, at.U64)
        self.counts = np.zeros(0, np.int64)

    def look_up(self, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(known, counts) of sorted names."""
        if not len(self.names):
            return np.zeros(len(names), bool), np.zeros(len(names), np.int64)
        place = np.minimum(np.searchsorted(self.names, names), len(self.names) - 1)
        return self.names[place] == names, self.counts[place]

    def add(self, names: np.ndarray, counts: np.ndarray) -> None:
        room = max(0, self.bound - len(self.names))
        joined = np.concatenate([self.names, names[:room]])
        order = joined.argsort()
        self.names, self.counts = joined[order], np.concatenate([self.counts, counts[:room]])[order]


def count_tokens(
    docs: DataFrame, pieces_path: str, key: str = "doc_id", text: str = "text", known_words: int = KNOWN_WORDS, spell: bool = False
) -> DataFrame:
    """One row per document: key, n_words, n_tokens, n_unknown.

    Words are split at white space; a word that the vocabulary cannot spell is one unknown
    token. With ``spell`` a word may begin with the lone mark and characters without a piece
    count their byte tokens; without it, only a marked piece begins a word. A null or empty text has none. Null and repeated keys are rows like any other; an
    empty table gives no rows; extra columns are ignored.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, known = automaton(pieces_path, spell), KnownCounts(known_words)
        for batch in batches:
            for start, end, raw, offsets in at.slices(batch, text):
                words = at.words_of(raw, offsets, lower=False)
                names, first, inverse = np.unique(words.hashes, return_index=True, return_inverse=True)
                met, counts = known.look_up(names)
                new = np.flatnonzero(~met)
                counts[new] = [machine.count(words.text(i)) for i in first[new]]
                known.add(names[new], counts[new])
                each = counts[inverse]
                rows = end - start
                tokens = np.bincount(words.rows, np.maximum(each, 1), rows).astype(np.int64)
                unknown = np.bincount(words.rows[each == 0], minlength=rows)
                keys = at.column(batch, key).slice(start, rows)
                arrays = [keys, *(pa.array(c, pa.int64()) for c in (words.per_row, tokens, unknown))]
                yield pa.RecordBatch.from_arrays(arrays, [key, "n_words", "n_tokens", "n_unknown"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_words long, n_tokens long, n_unknown long")
