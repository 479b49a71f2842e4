"""Sentence-piece encoding and decoding by an Aho-Corasick automaton and a single Viterbi pass.

The automaton reports, character by character, every piece that ends there (its output
links); each report relaxes the best score of that position from the score where the piece
began. Characters that no piece spells fall back to byte tokens, so decoding gives back the
exact text.

Spaces are written as the mark U+2581, after one mark in front. No piece has a mark after
another character, so the best path is the chain of the best paths of the stretches that
begin with marks; repeated stretches are encoded once per task, up to a bound. A mark that is
in the text itself is written in bytes.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from cadenza.llm import arrow_text as at

MARK = "▁"
#: Stretches remembered per generation, their bytes, and characters of one; two generations are kept.
REMEMBERED = 1 << 19
REMEMBERED_BYTES = 1 << 26
LONGEST_REMEMBERED = 64
#: What Python keeps besides the characters and ids of a stretch, about.
ENTRY_BYTES = 160
#: Scores are whole numbers, so that sums are exact and ties are ties wherever they occur.
SCALE = 1 << 20
#: Score of a byte-fallback character, below every piece.
FALLBACK = -30 * SCALE

# One character in bytes, in place of a piece (length, number, score).
_FALLEN = (1, -1, FALLBACK)
_NEVER = -(1 << 62)
# A written mark among stretches: spaces are marks there, so no stretch is one.
_WRITTEN = " "
_STRETCHES = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


class _Numbers(dict):
    """Numbers new keys in the order in which they come."""

    def __missing__(self, key: str) -> int:
        self[key] = number = len(self)
        return number


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions of consecutive spans, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


class PieceCoder:
    """Encodes and decodes with pieces (text, id, whole score) and 256 byte ids."""

    def __init__(self, pieces: list[tuple[str, int, int]], byte_ids: list[int], remembered: int = REMEMBERED) -> None:
        if any(MARK in p.lstrip(MARK) for p, _, _ in pieces):
            raise ValueError("a piece has a mark after another character")
        if all(p != MARK for p, _, _ in pieces):
            raise ValueError("the mark must be a piece")
        self.byte_ids = byte_ids
        spelling = {i: p.replace(MARK, " ").encode() for p, i, _ in pieces} | {i: bytes([b]) for b, i in enumerate(byte_ids)}
        self.sizes = np.zeros(max(spelling) + 1, np.int64)
        self.sizes[list(spelling)] = [len(b) for b in spelling.values()]
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.letters = np.frombuffer(b"".join(spelling[i] for i in sorted(spelling)), np.uint8)
        self.single = {p for p, _, _ in pieces if len(p) == 1}
        self.machine = ahocorasick.Automaton()
        for piece, number, score in pieces:
            self.machine.add_word(piece, (len(piece), number, score))
        self.machine.make_automaton()
        self.remembered = remembered
        written = np.array([byte_ids[b] for b in MARK.encode()], "<u4").tobytes()
        self.written = {_WRITTEN: written}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.young_bytes = 0

    def best_path(self, text: str) -> list[int]:
        """Ids of the best segmentation; of equal scores the longest last piece wins."""
        return self._walk(text)[0]

    def _walk(self, text: str) -> tuple[list[int], list[int]]:
        """Ids of the best segmentation of a text with marks, and the character where each begins."""
        size = len(text)
        best = [0] + [_NEVER] * size
        back: list[tuple[int, int, int]] = [_FALLEN] * (size + 1)
        spelt = self.single.issuperset(text)
        done = 0  # characters before this one had their fallback
        for last, piece in self.machine.iter(text):
            if not spelt and done <= last:
                done = self._fall_back(text, best, back, done, last + 1)
            length, _, score = piece
            end = last + 1
            gained = best[end - length] + score
            known = best[end]
            if gained > known or gained == known and length > back[end][0]:
                best[end] = gained
                back[end] = piece
        if not spelt:
            self._fall_back(text, best, back, done, size)
        ids: list[int] = []
        places: list[int] = []
        place = size
        while place:
            length, number, _ = back[place]
            place -= length
            if number < 0:
                spelling = [self.byte_ids[b] for b in reversed(text[place].encode())]
                ids += spelling
                places += [place] * len(spelling)
            else:
                ids.append(number)
                places.append(place)
        ids.reverse()
        places.reverse()
        return ids, places

    def _best_paths(self, stretches: list[str]) -> list[bytes]:
        """The packed ids of each stretch.

        Stretches that begin with a mark and end without one can follow each other in one
        pass: every path goes through their borders, which no piece crosses.
        """
        out = [b""] * len(stretches)
        chained = [i for i, s in enumerate(stretches) if s[0] == MARK and s[-1] != MARK]
        ids, places = self._walk("".join(stretches[i] for i in chained))
        bounds = np.cumsum([0, *(len(stretches[i]) for i in chained)])
        cuts = np.searchsorted(np.array(places, np.int64), bounds).tolist()
        packed = np.array(ids, "<u4")
        for i, start, end in zip(chained, cuts[:-1], cuts[1:]):
            out[i] = packed[start:end].tobytes()
        for i in set(range(len(stretches))) - set(chained):
            out[i] = np.array(self.best_path(stretches[i]), "<u4").tobytes()
        return out

    def _fall_back(self, stretch: str, best: list[int], back: list, start: int, end: int) -> int:
        """Byte-fallback steps over the characters that no piece spells alone."""
        for i in range(start, end):
            if stretch[i] not in self.single and best[i] + FALLBACK > best[i + 1]:
                best[i + 1], back[i + 1] = best[i] + FALLBACK, _FALLEN
        return end

    def _packed(self, stretches: list[str]) -> list[bytes]:
        """The ids of distinct stretches as little-endian 32-bit numbers."""
        out: list[bytes] = []
        new: list[int] = []
        for i, stretch in enumerate(stretches):
            packed = self.young.get(stretch)
            if packed is None:
                packed = self.old.get(stretch) or self.written.get(stretch)
                if packed is None:
                    new.append(i)
                else:
                    self._remember(stretch, packed)
            out.append(packed or b"")
        for i, packed in zip(new, self._best_paths([stretches[i] for i in new])):
            out[i] = packed
            self._remember(stretches[i], packed)
        return out

    def _remember(self, stretch: str, packed: bytes) -> None:
        """Texts without spaces are single long stretches that hardly come again: those are not kept."""
        if len(stretch) > LONGEST_REMEMBERED:
            return
        self.young[stretch] = packed
        self.young_bytes += 4 * len(stretch) + len(packed) + ENTRY_BYTES
        if len(self.young) >= self.remembered or self.young_bytes >= REMEMBERED_BYTES:
            self.old, self.young, self.young_bytes = self.young, {}, 0

    def _stretches(self, text: str) -> list[str]:
        if MARK not in text:
            return _STRETCHES.findall(MARK + text.replace(" ", MARK)) if text else []
        out: list[str] = []
        for i, part in enumerate(text.split(MARK)):
            body = part.replace(" ", MARK)
            out += [_WRITTEN, *_STRETCHES.findall(body)] if i else _STRETCHES.findall(MARK + body)
        return out

    def encode_texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and their n + 1 bounds. Empty texts have none."""
        numbers, codes, counts = _Numbers(), [], [0]
        for text in texts:
            codes += map(numbers.__getitem__, self._stretches(text))
            counts.append(len(codes))
        packed = self._packed(list(numbers))
        sizes = np.array([len(p) // 4 for p in packed], np.int64)
        flat = np.frombuffer(b"".join(packed), "<u4")
        code = np.array(codes, np.int64)
        ids = flat[_spans((np.cumsum(sizes) - sizes)[code], sizes[code])]
        ends = np.concatenate([[0], np.cumsum(sizes[code])])
        return ids, ends[counts]

    def encode(self, text: str) -> list[int]:
        """Ids of a text; none for an empty one."""
        return self.encode_texts([text])[0].tolist()

    def decode_texts(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all texts, one after the other, and their n + 1 bounds.

        Pieces and bytes are joined and marks of pieces are spaces; every text but an empty one
        still has the space in front that encoding put there.
        """
        sizes = self.sizes[ids]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return self.letters[_spans(self.starts[ids], sizes)], ends[bounds]

    def decode(self, ids: list[int]) -> str:
        """The text that was encoded."""
        letters, _ = self.decode_texts(np.array(ids, np.int64), np.array([0, len(ids)]))
        return letters[1:].tobytes().decode()


def vocabulary(path: str) -> tuple[list[tuple[str, int, int]], list[int]]:
    """Pieces with scores and the byte ids of a public model.

    The model's own scores are merge ranks, not log-probabilities; a piece of rank r gets the
    log-probability of Zipf's law, 1 / (r * H), as a whole number of 2 ** -20.
    """
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    plain = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
    harmonic = sum(1 / r for r in range(1, len(plain) + 1))
    pieces = [(model.id_to_piece(i), i, round(-math.log(r * harmonic) * SCALE)) for r, i in enumerate(plain, 1)]
    return pieces, [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]


@lru_cache(maxsize=2)
def coder(path: str) -> PieceCoder:
    return PieceCoder(*vocabulary(path))


def encode_documents(docs: DataFrame, pieces_path: str, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per document: key, n_pieces, n_bytes, ids_crc32, exact and, if asked for, ids.

    ``n_bytes`` counts byte-fallback ids, ``ids_crc32`` is over the ids as little-endian
    unsigned 32-bit numbers, ``exact`` says that decoding them gives the text back. A null or
    empty text has no ids and is exact. Null and repeated keys are rows like any other; an
    empty table gives no rows; extra columns are ignored.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = coder(pieces_path)
        is_byte = np.zeros(len(machine.sizes), bool)
        is_byte[machine.byte_ids] = True
        names = [key, "n_pieces", "n_bytes", "ids_crc32", "exact"] + ["ids"] * with_ids
        for batch in batches:
            texts = at.column(batch, text)
            for start, end, raw, offsets in at.slices(batch, text):
                ids, bounds = machine.encode_texts([body.as_py() or "" for body in texts[start:end]])
                letters, ends = machine.decode_texts(ids, bounds)
                fallen = np.concatenate([[0], np.cumsum(is_byte[ids])])
                spans = list(zip(bounds[:-1].tolist(), bounds[1:].tolist()))
                # A space stands in front of every decoded text but an empty one.
                firsts = np.minimum(ends[:-1] + 1, ends[1:]).tolist()
                same = [
                    np.array_equal(letters[f:e], raw[x:y])
                    for f, e, x, y in zip(firsts, ends[1:].tolist(), offsets[:-1].tolist(), offsets[1:].tolist())
                ]
                arrays = [
                    at.column(batch, key).slice(start, end - start), pa.array(np.diff(bounds)), pa.array(np.diff(fallen[bounds])),
                    pa.array([zlib.crc32(ids[x:y].tobytes()) for x, y in spans], pa.int64()), pa.array(same, pa.bool_()),
                ]
                if with_ids:
                    arrays.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(arrays, names)

    schema = f"`{key}` {kind}, n_pieces long, n_bytes long, ids_crc32 long, exact boolean" + ", ids array<int>" * with_ids
    return docs.select(key, text).mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, pieces_path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, text) from ids; null ids count as none."""
    kind = encoded.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = coder(pieces_path)
        for batch in batches:
            texts = [machine.decode(row.as_py() or []) for row in at.column(batch, ids)]
            yield pa.RecordBatch.from_arrays([at.column(batch, key), pa.array(texts, pa.string())], [key, "text"])

    return encoded.select(key, ids).mapInArrow(run, f"`{key}` {kind}, text string")
