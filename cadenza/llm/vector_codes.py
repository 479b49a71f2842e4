"""Vector code compression: one codebook per part of the vector, fitted in integers.

A vector's components become integers and are cut into consecutive parts. Each part position
has a codebook; a round assigns every part to its nearest entry and moves the entries to the
floor of their parts' means. All distances that decide are exact integers.

LAESA pivots spare most of them. Pivots are fixed parts, chosen once among the first entries
of a codebook. Each part's distances to them are computed once and written beside it. In a
round only the entries' distances to the pivots are new; the triangle inequality makes the
largest difference of the two a lower bound of a part's distance to an entry. Entries are
evaluated in the order of that bound, first a few with the least, then all others that it does
not exclude, so no entry that could win, or tie with a lower index, is left out.

Tasks hand on one sum and count per entry they used; what reaches the driver has the size of
the codebooks. Every round reads the written parts, so a lost executor repeats its tasks only.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.llm import arrow_text as at
from cadenza.llm.tables import gathered, settle

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
PIVOTS = 8
#: Parts whose bounds are held at once.
BATCH = 2048
#: Entries that every part is compared with first: those with the least bounds.
HEAD = 8
#: Share of the entries from which a block is evaluated as a whole.
DENSE = 0.1
#: More than the share by which rounding to single precision may lift a bound.
SLACK = 1e-6


def whole_components(column: pa.Array, scale: int = SCALE) -> list[np.ndarray | None]:
    """floor(scale * x) of every vector; None for a null one and for null or non-finite components."""
    column = column.cast(pa.large_list(pa.float64()))
    values = column.flatten()
    flat = values.fill_null(np.nan).to_numpy(zero_copy_only=False) if len(values) else np.zeros(0)
    lengths = pc.list_value_length(column).to_pylist()
    out: list[np.ndarray | None] = []
    start = 0
    for length in lengths:
        vector = flat[start : start + (length or 0)]
        start += length or 0
        if length is None or not np.isfinite(vector).all():
            out.append(None)
            continue
        # A part's squared distances must stay within 64-bit integers, even summed over the parts.
        most = 2.0 ** ((58 - max(0, math.ceil(math.log2(max(1, length))))) // 2)
        out.append(np.clip(np.floor(np.clip(vector, -most, most) * scale), -most, most).astype(np.int32))
    return out


def part_bounds(length: int, parts: int) -> list[tuple[int, int]]:
    """The consecutive stretches of the parts: equal where ``parts`` divides the length."""
    ends = [length * i // parts for i in range(parts + 1)]
    return list(zip(ends[:-1], ends[1:]))


def whole_vectors(rows: DataFrame, key: str, vector: str, label: str, scale: int = SCALE) -> DataFrame:
    """(key, label, length, ints): the kept vectors as little-endian 32-bit integers."""
    kinds = {c: rows.schema[c].dataType.simpleString() for c in (key, label)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = whole_components(at.column(batch, "vector"), scale)
            kept = pa.array([b is not None for b in bodies], pa.bool_())
            columns = [
                at.column(batch, "key"), at.column(batch, "label"),
                pa.array([0 if b is None else len(b) for b in bodies], pa.int32()),
                pa.array([None if b is None else b.astype("<i4").tobytes() for b in bodies], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["key", "label", "length", "ints"]).filter(kept)

    chosen = rows.select(F.col(key).alias("key"), F.col(vector).alias("vector"), F.col(label).alias("label"))
    return chosen.mapInArrow(run, f"key {kinds[key]}, label {kinds[label]}, length int, ints binary")


@dataclass
class Books:
    """Codebooks and pivots of one vector length, by part position."""

    entries: list[np.ndarray]  # (entries, components), 64-bit integers
    pivots: list[np.ndarray]  # (pivots, components)


def squared(points: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Exact squared distances of every row of one table to every row of the other."""
    out = np.zeros((len(points), len(others)), np.int64)
    for i in range(points.shape[1]):
        apart = points[:, i][:, None] - others[:, i][None, :]
        out += apart * apart
    return out


def choose_pivots(entries: np.ndarray, count: int) -> np.ndarray:
    """``count`` entries far from each other: the first, then each time the one farthest from those chosen."""
    chosen = [0]
    near = squared(entries, entries[:1])[:, 0]
    while len(chosen) < min(count, len(entries)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, squared(entries, entries[chosen[-1:]])[:, 0])
    return entries[chosen]


def first_books(vectors: DataFrame, parts: int, entries: int, pivots: int) -> dict[int, Books]:
    """Codebooks of the vectors with the least keys (null keys last, then the least components).

    At most ``entries`` vectors of every length are gathered.
    """
    order = W.partitionBy("length").orderBy(F.asc_nulls_last("key"), F.asc("ints"))
    least = vectors.select("length", "key", "ints", F.row_number().over(order).alias("place")).where(F.col("place") <= entries)
    books: dict[int, Books] = {}
    got = gathered(least.select("length", "place", "ints"))
    for length in np.unique(got["length"]).tolist():
        own = got["length"] == length
        ranked = got["ints"][own][np.argsort(got["place"][own])]
        table = np.frombuffer(b"".join(ranked), "<i4").reshape(len(ranked), length).astype(np.int64)
        cut = [np.ascontiguousarray(table[:, a:b]) for a, b in part_bounds(length, parts)]
        books[length] = Books(cut, [choose_pivots(part, pivots) for part in cut])
    return books


def _tables(batch: pa.RecordBatch, parts: int) -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
    """(length, rows, parts) for each vector length in a batch."""
    lengths = at.column(batch, "length").to_numpy()
    bodies = at.column(batch, "ints")
    for length in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == length)
        joined = b"".join(bodies.take(pa.array(rows)).to_pylist())
        table = np.frombuffer(joined, "<i4").reshape(len(rows), length).astype(np.int64)
        yield length, rows, [np.ascontiguousarray(table[:, a:b]) for a, b in part_bounds(length, parts)]


def with_pivot_distances(vectors: DataFrame, books: dict[int, Books], parts: int) -> DataFrame:
    """Adds ``to_pivots``: the distances of every part to its position's pivots, in single precision, one after the other."""
    shared = vectors.sparkSession.sparkContext.broadcast(books)  # entries and pivots of each length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[bytes] = [b""] * batch.num_rows
            for length, rows, cut in _tables(batch, parts):
                far = [np.sqrt(squared(part, p)).astype(np.float32) for part, p in zip(cut, shared.value[length].pivots)]
                for row, body in zip(rows.tolist(), np.concatenate(far, 1)):
                    out[row] = body.tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, "to_pivots"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vectors.schema.fields)
    return vectors.mapInArrow(run, f"{kinds}, to_pivots binary")


def exact_squares(points: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Exact squared distances; as one matrix product of doubles where all its sums stay below 2 ** 53."""
    most = max(np.abs(points).max(initial=0), np.abs(others).max(initial=0))
    if 4 * int(most) ** 2 * max(1, points.shape[1]) >= 1 << 53:
        return squared(points, others)
    a, b = points.astype(np.float64), others.astype(np.float64)
    out = a @ (-2 * b.T)
    out += np.einsum("ij,ij->i", a, a)[:, None]
    out += np.einsum("ij,ij->i", b, b)[None, :]
    return out


def nearest_entries(
    points: np.ndarray, to_pivots: np.ndarray, entries: np.ndarray, entry_pivots: np.ndarray
) -> tuple[np.ndarray, np.ndarray, int]:
    """(index, squared distance) of each part's nearest entry, ties to the lower index, and the evaluations needed.

    ``to_pivots`` and ``entry_pivots`` are the distances of parts and entries to the same pivots.
    The entries with the least bounds are evaluated first; of the others only those whose
    bound does not exceed the best distance found. Where these are still many, a block is
    evaluated by one matrix product, which costs less than picking them.
    """
    n, m = len(points), len(entries)
    index, best = np.zeros(n, np.int64), np.zeros(n, np.int64)
    needed = 0
    head = min(HEAD, m)
    others = entry_pivots.astype(np.float32)
    for start in range(0, n, BATCH):
        rows = slice(start, min(n, start + BATCH))
        own, known = points[rows], to_pivots[rows].astype(np.float32)
        bound = np.zeros((len(own), m), np.float32)
        apart = np.empty_like(bound)
        for i in range(known.shape[1]):
            np.subtract(known[:, i][:, None], others[:, i][None, :], out=apart)
            np.maximum(bound, np.abs(apart, out=apart), out=bound)
        slack = SLACK * (known.max(initial=0) + others.max(initial=0))
        first = np.argpartition(bound, head - 1, axis=1)[:, :head]
        steps = own[:, None, :] - entries[first]
        reach = np.sqrt(np.einsum("ijk,ijk->ij", steps, steps).min(1).astype(np.float64)) * (1 + SLACK) + slack
        open_ = bound <= reach[:, None]
        count = int(np.count_nonzero(open_))
        needed += count
        if count > DENSE * open_.size:
            far = exact_squares(own, entries)
            far[~open_] = np.iinfo(np.int64).max if far.dtype == np.int64 else np.inf
            index[rows] = far.argmin(1)
            best[rows] = far[np.arange(len(own)), index[rows]]
        else:
            some, asked = np.nonzero(open_)  # by row, then by index; every row has its best so far
            steps = own[some] - entries[asked]
            far = np.einsum("ij,ij->i", steps, steps)
            begins = np.flatnonzero(np.concatenate([[True], some[1:] != some[:-1]]))
            best[rows] = np.minimum.reduceat(far, begins)
            index[rows] = np.minimum.reduceat(np.where(far == best[rows][some], asked, m), begins)
    return index, best, needed


def _assigned(batch: pa.RecordBatch, books: dict[int, Books], parts: int):
    """(length, rows, parts, indexes, distances) for each vector length in a batch."""
    known = at.column(batch, "to_pivots")
    for length, rows, cut in _tables(batch, parts):
        book = books[length]
        joined = b"".join(known.take(pa.array(rows)).to_pylist())
        wide = np.frombuffer(joined, np.float32).reshape(len(rows), sum(map(len, book.pivots)))
        indexes, distances, start = [], [], 0
        for part, entries, pivots in zip(cut, book.entries, book.pivots):
            own = wide[:, start : start + len(pivots)]
            start += len(pivots)
            index, far, _ = nearest_entries(part, own, entries, np.sqrt(squared(entries, pivots)))
            indexes.append(index)
            distances.append(far)
        yield length, rows, cut, indexes, distances


def moved_books(vectors: DataFrame, books: dict[int, Books], parts: int) -> dict[int, Books]:
    """Codebooks after one round: each entry the floor of its parts' mean, unused entries as they were."""
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        counts: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for length, _, cut, indexes, _ in _assigned(batch, shared.value, parts):
                for position, (part, index) in enumerate(zip(cut, indexes)):
                    size = len(shared.value[length].entries[position])
                    place = (length, position)
                    if place not in sums:
                        sums[place] = np.zeros((size, part.shape[1]), np.int64)
                        counts[place] = np.zeros(size, np.int64)
                    order = np.argsort(index, kind="stable")
                    used, starts = np.unique(index[order], return_index=True)
                    if part.shape[1]:
                        sums[place][used] += np.add.reduceat(part[order], starts, axis=0)
                    counts[place] += np.bincount(index, minlength=size)
        for (length, position), total in sums.items():
            used = np.flatnonzero(counts[length, position])
            wide = total.shape[1]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(used) * (wide + 1), length, np.int32)),
                    pa.array(np.full(len(used) * (wide + 1), position, np.int32)),
                    pa.array(np.repeat(used, wide + 1).astype(np.int32)),
                    pa.array(np.tile(np.arange(-1, wide), len(used)).astype(np.int32)),
                    pa.array(np.column_stack([counts[length, position][used], total[used]]).ravel()),
                ],
                ["length", "position", "entry", "component", "total"],
            )

    told = vectors.select("length", "ints", "to_pivots").mapInArrow(
        run, "length int, position int, entry int, component int, total long"
    )
    # One row per entry and component (component -1 is the count): the size of the codebooks.
    got = gathered(told.groupBy("length", "position", "entry", "component").agg(F.sum("total").alias("total")))
    moved = {n: Books([e.copy() for e in b.entries], b.pivots) for n, b in books.items()}
    for length, book in moved.items():
        for position, entries in enumerate(book.entries):
            own = (got["length"] == length) & (got["position"] == position)
            table = np.zeros((len(entries), entries.shape[1] + 1), np.int64)
            table[got["entry"][own], got["component"][own] + 1] = got["total"][own]
            used = table[:, 0] > 0
            entries[used] = table[used, 1:] // table[used, :1]
    return moved


def fit_books(vectors: DataFrame, books: dict[int, Books], parts: int, rounds: int) -> dict[int, Books]:
    for _ in range(rounds if books else 0):
        books = moved_books(vectors, books, parts)
    return books


def books_digest(book: Books) -> str:
    """sha256 of all components as decimals, by part, entry and place, joined by commas."""
    numbers = (str(x) for entries in book.entries for x in entries.ravel().tolist())
    return hashlib.sha256(",".join(numbers).encode()).hexdigest()


def compress_vectors(
    rows: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    pivots: int = PIVOTS,
    scale: int = SCALE,
) -> DataFrame:
    """One row per kept vector: key, code, error, label_error, codebooks_sha256.

    Rows whose vector is null or holds null or non-finite components are left out. Components
    become floor(``scale`` * x). Codebooks start from the ``entries`` kept vectors with the
    least keys (null keys last, repeated keys by their components) and take ``rounds`` rounds.
    ``code`` has two hex digits per part (more where ``entries`` exceeds 256), ``error`` sums
    the squared distances to the entries, ``label_error`` the errors of all rows with the same
    label, nulls together.

    Each vector length is a space of its own, with its own codebooks; a length that the parts
    do not divide has parts that differ by one component, and an empty vector codes as zeros.
    Components of more than 2 ** 29 / sqrt(length), beyond what 64-bit sums of squares hold,
    count as that bound. Repeated rows are rows of their own; with fewer rows than ``entries``
    the codebooks are smaller; an empty table gives no rows; extra columns are ignored.
    """
    vectors = settle(whole_vectors(rows, key, vector, label, scale), "whole-vectors")
    first = first_books(vectors, parts, entries, pivots)
    known = settle(with_pivot_distances(vectors, first, parts), "pivot-distances") if first else vectors.selectExpr("*", "ints AS to_pivots")
    books = fit_books(known, first, parts, rounds)
    digests = {length: books_digest(book) for length, book in books.items()}
    digits = max(2, len(f"{entries - 1:x}"))
    shared = rows.sparkSession.sparkContext.broadcast((books, digests))
    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, digests = shared.value
        for batch in batches:
            codes, errors, names = [""] * batch.num_rows, np.zeros(batch.num_rows, np.int64), [""] * batch.num_rows
            for length, at_rows, _, indexes, distances in _assigned(batch, books, parts):
                errors[at_rows] = np.sum(distances, axis=0)
                for row, code in zip(at_rows.tolist(), zip(*(i.tolist() for i in indexes))):
                    codes[row] = "".join(f"{c:0{digits}x}" for c in code)
                    names[row] = digests[length]
            columns = [at.column(batch, "key"), at.column(batch, "label"), pa.array(codes), pa.array(errors), pa.array(names)]
            yield pa.RecordBatch.from_arrays(columns, ["key", "label", "code", "error", "codebooks_sha256"])

    schema = f"key {kinds['key']}, label {kinds['label']}, code string, error long, codebooks_sha256 string"
    coded = settle(known.mapInArrow(run, schema), "codes")
    # A label's sum may exceed 64 bits where components met their bound; it then stays at the largest long.
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(2**63 - 1).cast("decimal(38,0)")).cast("long")
    sums = settle(coded.groupBy("label").agg(total.alias("label_error")), "label-errors").withColumnRenamed("label", "of")
    joined = coded.join(sums, F.col("label").eqNullSafe(F.col("of")))
    return joined.select(F.col("key").alias(key), "code", "error", "label_error", "codebooks_sha256")
