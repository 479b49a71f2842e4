"""Near-duplicate vectors through an inverted multi-index.

Two codebooks, one per half of the vector, span a product grid of cells. Every distinct
vector is listed in its home cell and visits cells from the nearest on, in the order of the
distance it would take to reach them: for each half, the distance to the plane between the
home centroid and another one is the least that a partner there can be away, and the squares
of both halves add up. Linked vectors of cosine ``c`` are ``sqrt(2 - 2c)`` apart as unit
vectors, so the traversal stops at that distance with every possible partner's cell visited:
the target recall is 1 and the cosines that follow are exact.

Only cells at or after a vector's own are visited, since the partner visits the rest. Cells
are cut into blocks of bounded size on both sides, so a hot cell is many small tasks; a task
returns sums and a spanning forest, never pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm import arrow_text as at
from cadenza.llm.components import components
from cadenza.llm.minhash_join import spanning_forest
from cadenza.llm.tables import settle

COSINE = 0.98
#: Vectors that the codebooks are fitted on, about; every vector is indexed.
SAMPLE = 4096
#: The grid has about one cell for so many vectors; centroids per half stay below MOST_CENTROIDS.
PER_CELL = 2000
MOST_CENTROIDS = 1024
#: Vectors of a cell that meet in one task, on each side.
BLOCK = 512

Codebooks = dict[int, tuple[np.ndarray, np.ndarray]]


def _vectors(column: pa.Array) -> list[np.ndarray | None]:
    """Float64 vectors; None for a null, empty or zero one and for null or non-finite components."""
    column = column.cast(pa.large_list(pa.float64()))
    values = column.flatten()
    holes = values.is_null().to_numpy(zero_copy_only=False)
    flat = values.fill_null(np.nan).to_numpy(zero_copy_only=False) if len(values) else np.zeros(0)
    ends = np.cumsum([0 if n is None else n for n in pa.compute.list_value_length(column).to_pylist()])
    out: list[np.ndarray | None] = []
    start = 0
    for end in ends.tolist():
        vector = flat[start:end]
        good = end > start and not holes[start:end].any() and np.isfinite(vector).all() and vector.any()
        out.append(vector if good else None)
        start = end
    return out


def component_kind(rows: DataFrame, vector: str) -> type:
    """What a component is kept as: single precision where the column has no more, so that nothing is lost."""
    return np.float32 if rows.schema[vector].dataType.simpleString() == "array<float>" else np.float64


def name_vectors(rows: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(key, label, copy, vec): the name of the (label, vector) pair and its components as bytes of ``component_kind``.

    ``copy`` and ``vec`` are null where the row can link with nothing.
    """
    kinds = {c: rows.schema[c].dataType.simpleString() for c in (key, label)}
    component = component_kind(rows, vector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = at.column(batch, label).to_pylist()
            bodies = [
                None if v is None or name is None else (v + 0.0).astype(component).tobytes()
                for v, name in zip(_vectors(at.column(batch, vector)), labels)
            ]
            names = [
                None if b is None else hashlib.blake2b(repr(name).encode() + b"\0" + b, digest_size=16).digest()
                for b, name in zip(bodies, labels)
            ]
            yield pa.RecordBatch.from_arrays(
                [at.column(batch, key), at.column(batch, label), pa.array(names, pa.binary()), pa.array(bodies, pa.binary())],
                [key, "label", "copy", "vec"],
            )

    schema = f"`{key}` {kinds[key]}, label {kinds[label]}, copy binary, vec binary"
    return rows.select(key, vector, label).mapInArrow(run, schema)


def _units(column: pa.Array, component: type) -> np.ndarray:
    """Unit rows, in double precision, of equally long vectors."""
    matrix = np.frombuffer(b"".join(column.to_pylist()), component).reshape(len(column), -1).astype(np.float64)
    scaled = matrix / np.abs(matrix).max(1, keepdims=True)  # squares of huge or tiny values stay finite
    return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


def _halves(units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cut = units.shape[1] // 2
    return units[:, :cut], units[:, cut:]


def _squares(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    far = (points * points).sum(1)[:, None] - 2 * points @ centroids.T + (centroids * centroids).sum(1)[None, :]
    return np.maximum(far, 0)


def fit_codebook(points: np.ndarray, size: int, rounds: int = 10) -> np.ndarray:
    """Lloyd's centroids of a bounded sample, from evenly spread starting rows."""
    distinct = np.unique(points, axis=0)
    centroids = distinct[np.linspace(0, len(distinct) - 1, min(size, len(distinct))).astype(int)]
    for _ in range(rounds):
        near = _squares(points, centroids).argmin(1)
        filled = np.unique(near)
        centroids = np.stack([points[near == i].mean(0) for i in filled])
    return centroids


def fit_codebooks(classes: DataFrame, total: int, component: type, sample: int = SAMPLE) -> Codebooks:
    """Codebooks per vector length, fitted on about ``sample`` vectors chosen by hash."""
    size = 1 << max(0, math.ceil(math.log2(math.sqrt(max(1, total / PER_CELL)))))
    chosen = classes.where(F.pmod(F.xxhash64("copy"), F.lit(max(1, total))) < sample)
    rows = sorted(bytes(r["vec"]) for r in chosen.select("vec").toLocalIterator())
    books: Codebooks = {}
    for length in {len(r) for r in rows}:
        units = _units(pa.array([r for r in rows if len(r) == length], pa.binary()), component)
        books[length] = tuple(fit_codebook(h, min(size, MOST_CENTROIDS)) for h in _halves(units))
    return books


def _gaps(points: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(home centroid, squared least distance to every centroid's region)."""
    far = _squares(points, centroids)
    home = far.argmin(1)
    apart = np.sqrt(_squares(centroids, centroids))[home]
    gap = (far - far[np.arange(len(points)), home][:, None]) / np.maximum(2 * apart, 1e-12)
    gap[np.arange(len(points)), home] = 0
    return home, gap * gap


def visits(units: np.ndarray, books: tuple[np.ndarray, np.ndarray], reach: float) -> tuple[np.ndarray, list[np.ndarray]]:
    """(home cell, cells visited from the nearest on) of each unit vector.

    The multi-sequence traversal: both halves' centroids in the order of their distance are
    two sequences, whose sums are taken in ascending order up to ``reach`` squared.
    """
    parts = [_gaps(h, b) for h, b in zip(_halves(units), books)]
    (home_a, gap_a), (home_b, gap_b) = parts
    width = len(books[1])
    limit = reach * reach * (1 + 1e-9) + 1e-12
    out = []
    for a, b in zip(gap_a, gap_b):
        order_a, order_b = a.argsort(kind="stable"), b.argsort(kind="stable")
        near_a = order_a[: np.searchsorted(a[order_a], limit, "right")]
        ends = np.searchsorted(b[order_b], limit - a[near_a], "right")
        cells = np.concatenate([i * width + order_b[:n] for i, n in zip(near_a, ends)])
        sums = np.concatenate([a[i] + b[order_b[:n]] for i, n in zip(near_a, ends)])
        out.append(cells[sums.argsort(kind="stable")])
    return home_a * width + home_b, out


def assign_cells(classes: DataFrame, books: Codebooks, reach: float, component: type) -> DataFrame:
    """Adds ``space`` (vector length), ``home`` and ``visited``: the cells from the home on, by number."""
    shared = classes.sparkSession.sparkContext.broadcast(books)  # at most 2 * MOST_CENTROIDS rows a length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vecs = at.column(batch, "vec")
            spaces = np.array(pa.compute.binary_length(vecs).to_pylist(), np.int64)
            home, visited = np.zeros(len(vecs), np.int32), [[0]] * len(vecs)
            for length in set(spaces.tolist()) & set(shared.value):
                at_rows = np.flatnonzero(spaces == length)
                cells, seen = visits(_units(vecs.take(pa.array(at_rows)), component), shared.value[length], reach)
                home[at_rows] = cells
                for row, own, near in zip(at_rows.tolist(), cells, seen):
                    visited[row] = near[near >= own].tolist()
            extra = [pa.array(spaces, pa.int32()), pa.array(home), pa.array(visited, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*batch.schema.names, "space", "home", "visited"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in classes.schema.fields)
    return classes.mapInArrow(run, f"{kinds}, space int, home int, visited array<int>")


def _meet(cosine: float, component: type):
    """Counts and forest links of one block of visitors against one block of a cell."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        visitor = table["visitor"].to_numpy(zero_copy_only=False)
        node = table["node"].to_numpy()
        weight = table["copies"].to_numpy()
        empty = pa.table({"node": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "near": pa.array([], pa.int64())})
        if visitor.all() or not visitor.any():
            return empty
        units = _units(table["vec"].combine_chunks(), component)
        p, h = np.flatnonzero(visitor), np.flatnonzero(~visitor)
        own = table["own"].to_numpy(zero_copy_only=False)[p]
        linked = (units[p] @ units[h].T >= cosine) & (node[p][:, None] != node[h][None, :])
        # Vectors of the same cell meet twice, once from either side; others once.
        links = np.concatenate([linked @ weight[h], weight[p][~own] @ linked[~own]])
        nodes = np.concatenate([node[p], node[h]])
        some = links > 0
        one, least = spanning_forest(linked, node[p], node[h])
        return pa.table({
            "node": np.concatenate([nodes[some], one]),
            "links": np.concatenate([links[some].astype(np.int64), np.zeros(len(one), np.int64)]),
            "near": np.concatenate([nodes[some], least]),
        })

    return run


def link_vectors(assigned: DataFrame, cosine: float, component: type, block: int = BLOCK) -> DataFrame:
    """(node, links, near) per meeting of blocks: copies linked with, and a link of the forest."""
    place = ["label", "space", "cell"]
    homes = assigned.select("label", "space", F.col("home").alias("cell"), "node", "copies", "vec")
    seekers = assigned.select(
        "label", "space", F.explode("visited").alias("cell"), "node", "copies", "vec", F.col("home")
    )
    held = homes.groupBy(*place).agg(F.count(F.lit(1)).alias("held"))
    sought = seekers.groupBy(*place).agg(F.count(F.lit(1)).alias("sought"))
    sizes = settle(
        held.join(sought, place).select(
            *place, F.ceil(F.col("held") / block).cast("int").alias("home_blocks"),
            F.ceil(F.col("sought") / block).cast("int").alias("seek_blocks"),
        ),
        "cells",
    )
    block_of = lambda blocks: F.pmod(F.xxhash64("node"), F.col(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))
    listed = homes.join(sizes, place).select(
        *place, block_of("home_blocks").alias("home_block"), every("seek_blocks").alias("seek_block"),
        "node", "copies", "vec", F.lit(False).alias("visitor"), F.lit(False).alias("own"),
    )
    asking = seekers.join(sizes, place).select(
        *place, every("home_blocks").alias("home_block"), block_of("seek_blocks").alias("seek_block"),
        "node", "copies", "vec", F.lit(True).alias("visitor"), (F.col("home") == F.col("cell")).alias("own"),
    )
    meeting = [*place, "home_block", "seek_block"]
    return listed.unionByName(asking).groupBy(*meeting).applyInArrow(_meet(cosine, component), "node long, links long, near long")


def near_vectors(
    rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = COSINE
) -> DataFrame:
    """One row per vector: key, n_links, component_id, kept.

    Vectors link when their labels are equal and not null, their lengths are equal and their
    cosine in double precision is at least ``cosine``. ``n_links`` counts other rows linked
    directly, equal copies included; ``component_id`` is the least key reachable. Null, empty
    and zero vectors and those with null or non-finite components have no links and their own
    key as component. Rows with a null key link like others, never name a component that has
    another key, and repeated keys are rows of their own. An empty table gives no rows; extra
    columns are ignored. Zero components of either sign are equal.
    """
    named = settle(name_vectors(rows, key, vector, label), "vectors")
    grouped = named.where(F.col("copy").isNotNull()).groupBy("copy").agg(
        F.min(key).alias("member"), F.count(F.lit(1)).alias("copies"),
        F.first("label").alias("label"), F.first("vec").alias("vec"),
    )
    classes = settle(settle(grouped, "classes").withColumn("node", F.monotonically_increasing_id()), "nodes")
    component = component_kind(rows, vector)
    books = fit_codebooks(classes, classes.count(), component)
    reach = math.sqrt(max(0.0, 2 - 2 * cosine))
    assigned = settle(assign_cells(classes.select("node", "copies", "label", "vec"), books, reach, component), "cells-of")
    met = settle(link_vectors(assigned, cosine, component), "met")
    counts = met.groupBy("node").agg(F.sum("links").alias("links"))
    found = settle(components(met.where(F.col("near") != F.col("node")), "node", "near"), "vector-components")
    told = classes.select("copy", "node", "member", "copies").join(counts, "node", "left").join(found, "node", "left")
    told = settle(told.select("copy", "member", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"),
                              F.coalesce("component", "node").alias("component")), "told")
    least = settle(told.groupBy("component").agg(F.min("member").alias("least")), "least-vectors")
    final = settle(told.join(least, "component").select("copy", "links", "least"), "final")
    component = F.when(F.col("copy").isNull(), F.col(key)).otherwise(F.col("least")).alias("component_id")
    out = named.select(key, "copy").join(final, "copy", "left").select(
        key, F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component
    )
    return out.withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))
