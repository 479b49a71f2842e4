"""A kept index of vectors for nearest neighbours by angle: an inverted file with quantised residuals.

Every unit vector lies in the cell of its nearest centroid; what it differs from the centroid
is kept as one byte per part of the vector. Cells are partitions of written tables, so a
search reads the cells it probes and no others, ranks them by the bytes, and takes exact
distances for the best of them. New rows join the cells there are; nothing is built again.

Centroids and codebooks are fitted once on a bounded sample. The number of probes is the
least that finds the wanted share of the sample's own neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.functions import arrays
from cadenza.operators.scoring import score_round, top_k
from cadenza.session import work_path, write_and_read

#: Vectors that centroids, codebooks and the number of probes are fitted on.
SAMPLE = 8192
#: A cell for so many vectors, about, and cells at most.
PER_CELL = 1000
MOST_CELLS = 4096
#: Components of one byte of a code, entries of its codebook.
PART = 4
ENTRIES = 256
#: Candidates that get exact distances: per wanted neighbour, and at least.
CANDIDATES = 20
LEAST_CANDIDATES = 256
#: Share of true neighbours that the probes must find in the sample.
TARGET = 0.95


@dataclass(frozen=True)
class NeighbourIndex:
    """Fitted tables of bounded size, and where the cells lie."""

    spark: SparkSession
    path: str
    centroids: np.ndarray
    books: tuple[np.ndarray, ...]
    probes: int

    @property
    def cells(self) -> DataFrame:
        """(song_id, code, v, cell): unit vectors by cell."""
        return self.spark.read.schema("song_id BIGINT, code BINARY, v ARRAY<DOUBLE>, cell INT").parquet(self.path)


def _nearest_rows(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    far = (centroids * centroids).sum(1)[None, :] - 2 * points @ centroids.T
    return far.argmin(1)


def _kmeans(points: np.ndarray, size: int, rounds: int = 12) -> np.ndarray:
    distinct = np.unique(points, axis=0)
    centroids = distinct[np.random.default_rng(1).permutation(len(distinct))[:size]]
    for _ in range(rounds):
        near = _nearest_rows(points, centroids)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, points)
        counts = np.bincount(near, minlength=len(centroids))
        centroids = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centroids)
    return centroids


def _part_slices(width: int) -> list[slice]:
    return [slice(i, min(width, i + PART)) for i in range(0, width, PART)]


def _codes(residuals: np.ndarray, books: tuple[np.ndarray, ...]) -> np.ndarray:
    parts = zip(_part_slices(residuals.shape[1]), books)
    return np.stack([_nearest_rows(residuals[:, s], b) for s, b in parts], 1).astype(np.uint8)


def _decoded(codes: np.ndarray, books: tuple[np.ndarray, ...]) -> np.ndarray:
    return np.concatenate([b[codes[:, i]] for i, b in enumerate(books)], 1)


def _units(space: DataFrame, key: str) -> DataFrame:
    """(key, v) as unit vectors; vectors without a direction are left out."""
    sized = space.select(key, F.transform("v", lambda x: x.cast("double")).alias("v")).withColumn("_norm", arrays.norm(F.col("v")))
    return sized.where("_norm > 0").select(key, F.transform("v", lambda x: x / F.col("_norm")).alias("v"))


def _probes_for(sample: np.ndarray, centroids: np.ndarray, k: int, target: float) -> int:
    """The least number of cells nearest a query that hold ``target`` of its ``k`` nearest, over part of the sample."""
    asked = np.arange(0, len(sample), max(1, len(sample) // 500))
    near = np.argsort(-(sample[asked] @ sample.T), axis=1, kind="stable")[:, 1 : k + 1]
    home = _nearest_rows(sample, centroids)
    far = (centroids * centroids).sum(1)[None, :] - 2 * sample[asked] @ centroids.T
    place = np.empty_like(far, dtype=np.int64)
    np.put_along_axis(place, np.argsort(far, axis=1, kind="stable"), np.arange(len(centroids))[None, :], 1)
    needed = np.take_along_axis(place, home[near], 1).ravel() if near.size else np.zeros(1, np.int64)
    return int(np.sort(needed)[min(len(needed) - 1, int(np.ceil(target * len(needed))) - 1)]) + 1


def build(space: DataFrame, per_cell: int = PER_CELL, k: int = 10, target: float = TARGET, label: str = "neighbours") -> NeighbourIndex:
    """Fits and writes an index of (song_id, v); vectors have one length."""
    spark = space.sparkSession
    units = _units(space, "song_id")
    total = units.count()
    chosen = units.orderBy(F.xxhash64("song_id"), "song_id").limit(SAMPLE).select("v").toPandas()  # at most SAMPLE rows
    sample = np.stack(chosen["v"].to_list()) if len(chosen) else np.zeros((0, 1))
    cells = min(MOST_CELLS, len(sample), max(1, total // per_cell))
    centroids = _kmeans(sample, cells) if cells else np.zeros((1, sample.shape[1]))
    residuals = sample - centroids[_nearest_rows(sample, centroids)]
    books = tuple(_kmeans(residuals[:, s], ENTRIES) if len(sample) else np.zeros((1, s.stop - s.start)) for s in _part_slices(sample.shape[1]))
    probes = _probes_for(sample, centroids, k, target) if len(sample) else 1
    index = NeighbourIndex(spark, work_path(spark, label), centroids, books, probes)
    return extend(index, space)


def extend(index: NeighbourIndex, space: DataFrame) -> NeighbourIndex:
    """Appends (song_id, v) rows to the index's cells."""
    shared = index.spark.sparkContext.broadcast((index.centroids, index.books))  # at most MOST_CELLS rows

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centroids, books = shared.value
        for frame in frames:
            if len(frame):
                points = np.stack(frame["v"].to_list())
                cell = _nearest_rows(points, centroids)
                codes = _codes(points - centroids[cell], books)
                yield pd.DataFrame({"song_id": frame["song_id"], "code": [c.tobytes() for c in codes], "v": frame["v"], "cell": cell.astype(np.int32)})

    units = _units(space, "song_id").withColumn("song_id", F.col("song_id").cast("bigint"))
    placed = units.mapInPandas(place, "song_id BIGINT, code BINARY, v ARRAY<DOUBLE>, cell INT")
    placed.hint("rebalance", "cell").write.mode("append").partitionBy("cell").parquet(index.path)
    return index


@dataclass(frozen=True)
class Neighbours:
    """The nearest rows, and the (seed_id, cell) probes they were sought in."""

    best: DataFrame
    probed: DataFrame


def search(index: NeighbourIndex, seeds: DataFrame, k: int = 10, probes: int | None = None, candidates: int | None = None) -> Neighbours:
    """``k`` nearest by sqrt(2 (1 - cos)) per seed among the probed cells: seed_id, song_id, distance, rank.

    ``seeds`` has seed_id and v; a seed is not its own neighbour. Of the probed rows the
    ``candidates`` best by their codes get exact distances.
    """
    wanted = candidates or max(CANDIDATES * k, LEAST_CANDIDATES)
    probed = min(probes or index.probes, len(index.centroids))
    shared = index.spark.sparkContext.broadcast(index.centroids)

    def choose(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centroids = shared.value
        for frame in frames:
            if len(frame):
                points = np.stack(frame["w"].to_list())
                far = (centroids * centroids).sum(1)[None, :] - 2 * points @ centroids.T
                near = np.argsort(far, axis=1, kind="stable")[:, :probed].astype(np.int32)
                yield pd.DataFrame({"seed_id": frame["seed_id"], "w": frame["w"], "cells": list(near)})

    asked = _units(seeds, "seed_id").select(F.col("seed_id").cast("bigint").alias("seed_id"), F.col("v").alias("w"))
    visits = asked.mapInPandas(choose, "seed_id BIGINT, w ARRAY<DOUBLE>, cells ARRAY<INT>")
    visits = write_and_read(visits.select("seed_id", "w", F.explode("cells").alias("cell")), "probes")
    numbers = sorted(r[0] for r in visits.select("cell").distinct().collect())  # at most all cells
    cells = index.cells.where(F.col("cell").isin(numbers or [-1]))
    tables = index.spark.sparkContext.broadcast((index.centroids, index.books))

    def rank(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centroids, books = tables.value
        for frame in frames:
            if len(frame):
                codes = np.frombuffer(b"".join(frame["code"]), np.uint8).reshape(len(frame), len(books))
                about = centroids[frame["cell"].to_numpy()] + _decoded(codes, books)
                score = np.einsum("ij,ij->i", about, np.stack(frame["w"].to_list()))
                yield pd.DataFrame({"seed_id": frame["seed_id"], "song_id": frame["song_id"], "cell": frame["cell"], "about": score})

    met = cells.select("song_id", "code", "cell").join(visits, "cell").where(F.col("song_id") != F.col("seed_id"))
    about = met.select("seed_id", "song_id", "cell", "code", "w").mapInPandas(rank, "seed_id BIGINT, song_id BIGINT, cell INT, about DOUBLE")
    first = write_and_read(top_k(about, ["seed_id"], [F.desc("about"), F.asc("song_id")], wanted), "by-code").drop("rank", "about")
    exact = cells.select("song_id", "v", "cell").join(first, ["cell", "song_id"]).join(asked, "seed_id")
    scored = exact.select("seed_id", "song_id", score_round(arrays.dot(F.col("w"), F.col("v"))).alias("score")).distinct()
    near = top_k(scored, ["seed_id"], [F.desc("score"), F.asc("song_id")], k)
    best = near.select("seed_id", "song_id", score_round(arrays.angular(F.col("score"))).alias("distance"), "rank")
    return Neighbours(best, visits.select("seed_id", "cell"))

