"""Words of whole texts as arrays, for Arrow batches inside tasks.

A word is a maximal run of bytes other than space, tab, line feed, vertical tab, form feed
and carriage return; every such byte is a whole ASCII character, so byte runs and character
runs agree. All per-byte work is vectorised over a slice of a batch. Words, shingles and
windows are named by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Text bytes handled at once; one longer text makes a slice of its own.
SLICE_BYTES = 1 << 21

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the splitmix64 finaliser)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def mix_int(x: int) -> int:
    return int(mix(np.array([x], U64))[0])


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, for ``size`` positions."""
    inverse = pow(_BASE, -1, 1 << 64)
    out = []
    for base in (_BASE, inverse):
        steps = np.full(size, base, U64)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    return out[0], out[1]


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Tables of at least ``size`` powers; only the usual slice size stays cached."""
    if size <= SLICE_BYTES + 1:
        return _powers(SLICE_BYTES + 1)
    return _powers.__wrapped__(size)


def run_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte runs ``codes[start:end]``, empty runs included."""
    up, down = powers(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, U64)
    terms = codes.astype(U64)
    terms += U64(1)
    terms *= up[: len(codes)]
    np.cumsum(terms, out=sums[1:])
    value = (sums[ends] - sums[starts]) * down[starts]
    return mix(value + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def as_binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the n + 1 offsets of a string column; a null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    first, last = (int(offsets[0]), int(offsets[-1])) if len(column) else (0, 0)
    raw = np.frombuffer(data, np.uint8)[first:last] if data is not None and last > first else np.zeros(0, np.uint8)
    return raw, offsets - first if len(column) else np.zeros(1, np.int64)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of stretches of rows with a bounded text size."""
    raw, offsets = as_binary(batch.column(batch.schema.get_field_index(column)))
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        end = min(max(end, row + 1), rows)
        yield row, end, raw[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


@dataclass
class Words:
    """The words of a slice in order: byte spans, the row of each, and its hash."""

    codes: np.ndarray
    space: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray
    hashes: np.ndarray

    @property
    def per_row(self) -> np.ndarray:
        return np.bincount(self.rows, minlength=len(self.offsets) - 1)

    def bounds(self) -> np.ndarray:
        """Word positions where rows begin, n + 1 values."""
        return np.concatenate([[0], np.cumsum(self.per_row)]).astype(np.int64)

    def text(self, i: int) -> bytes:
        return self.codes[self.starts[i] : self.ends[i]].tobytes()


def words_of(raw: np.ndarray, offsets: np.ndarray, lower: bool) -> Words:
    codes = LOWER[raw] if lower else raw
    space = SPACE[raw]
    apart = np.ones(len(raw) + 1, bool)  # apart[i]: no word reaches from byte i - 1 to byte i
    apart[1:-1] = space[1:] | space[:-1]
    apart[offsets] = True
    starts = np.flatnonzero(~space & apart[:-1])
    ends = np.flatnonzero(~space & apart[1:]) + 1
    rows = np.searchsorted(offsets, starts, "right") - 1
    return Words(codes, space, offsets, starts, ends, rows, run_hashes(codes, starts, ends))


def renamed(words: Words, codes: np.ndarray) -> Words:
    """The same words with the hashes of other bytes at their places, such as the lower-cased ones."""
    return replace(words, codes=codes, hashes=run_hashes(codes, words.starts, words.ends))


def repeats(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: how often its row has it, and whether this is the first time."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, bool)
    own = mix(keys ^ mix(rows.astype(U64) + U64(1)))
    order = np.argsort(own)
    ranked = own[order]
    starts = np.concatenate([[0], np.flatnonzero(ranked[1:] != ranked[:-1]) + 1])
    sizes = np.diff(np.append(starts, len(own)))
    often = np.empty(len(own), np.int64)
    often[order] = np.repeat(sizes, sizes)
    is_first = np.zeros(len(own), bool)
    is_first[np.minimum.reduceat(order, starts)] = True
    return often, is_first


def among(values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Whether each value is one of the sorted ``wanted``."""
    if not len(wanted):
        return np.zeros(len(values), bool)
    return wanted[np.minimum(np.searchsorted(wanted, values), len(wanted) - 1)] == values


def window_hashes(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first word) of every run of ``width`` words inside one row."""
    n = len(words.hashes)
    if n < width:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    total = np.zeros(n - width + 1, U64)
    factor = 1
    for k in range(width):
        total += words.hashes[k : n - width + 1 + k] * U64(factor)
        factor = factor * 0xC2B2AE3D27D4EB4F % (1 << 64)
    inside = np.flatnonzero(words.rows[: n - width + 1] == words.rows[width - 1 :])
    return mix(total[inside]), inside


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
