"""A catalog kept in cells of similar audio features, searched exactly by bounds.

The catalog is written once, partitioned by cell; a small table beside it has every cell's
size and the least and greatest value of each feature. For a seed, these give the most that
any song of a cell can score. A search scores the most promising cells first; cells that
reach neither the floor nor the seed's k-th score so far are never read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cadenza.functions import audio
from cadenza.operators import scoring as sc
from cadenza.session import work_path, write_and_read

#: The features that cells are cut along: those that weigh most in either variant.
CUT_FEATURES = ("tempo", "energy", "loudness", "valence", "danceability")
#: Songs of a cell, about; more songs make more cells, not larger ones.
PER_CELL = 50_000
ACCURACY = 10_000


@dataclass
class CellTable:
    """Songs partitioned by ``cell``, and one row of bounds per cell."""

    spark: SparkSession
    songs_path: str
    bounds_path: str
    schema: StructType

    @property
    def songs(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.songs_path)

    @property
    def bounds(self) -> DataFrame:
        return self.spark.read.parquet(self.bounds_path)


def _cuts(catalog: DataFrame, features: tuple[str, ...], buckets: int) -> dict[str, list[float]]:
    """Inner cut points of each feature, at about equal counts."""
    shares = [i / buckets for i in range(1, buckets)]
    finite = lambda n: F.when(~F.isnan(n), F.col(n))
    found = catalog.agg(*[F.percentile_approx(finite(n), shares, ACCURACY).alias(n) for n in features]).first()
    return {n: sorted(set(found[n] or [])) for n in features}


def build_cells(
    catalog: DataFrame, columns: tuple[str, ...] = (), features: tuple[str, ...] = CUT_FEATURES, per_cell: int = PER_CELL, label: str = "cells"
) -> CellTable:
    """Writes song_id, the scored features and ``columns`` by cell; NULL features count as 0.0."""
    spark = catalog.sparkSession
    names = list(audio.STANDARD_WEIGHTS)
    rows = audio.clean_features(catalog).select("song_id", *names, *columns)
    buckets = max(2, round((rows.count() / per_cell) ** (1 / len(features))))
    cell = F.lit(0)
    for name, cuts in _cuts(rows, features, buckets).items():
        place = sum((F.when(F.col(name) > c, 1).otherwise(0) for c in cuts), F.lit(0))
        cell = cell * (len(cuts) + 1) + place
    path = work_path(spark, label)
    placed = rows.withColumn("cell", cell.cast("int"))
    # One file a cell and task would be many; a cell's songs come together, large ones split by Spark.
    placed.hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{path}/songs")
    table = spark.read.schema(placed.schema).parquet(f"{path}/songs")
    extremes = [a for n in names for a in (F.min(n).alias(f"{n}_lo"), F.max(n).alias(f"{n}_hi"))]
    table.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *extremes).write.parquet(f"{path}/bounds")
    return CellTable(spark, f"{path}/songs", f"{path}/bounds", placed.schema)


def _gap(seed: Column, low: Column, high: Column) -> Column:
    """The least distance of a value to an interval."""
    return F.greatest(F.lit(0.0), low - seed, seed - high)


def _tempo_bound(seed: Column, low: Column, high: Column) -> Column:
    """The most that :func:`audio.tempo_score` gives for a tempo in the interval; it rises again behind 20."""
    gap = F.least(*[_gap(seed, low * f, high * f) for f in (1.0, 2.0, 0.5)])
    later = F.when(gap < 20, F.lit(0.5)).otherwise(F.lit(0.0))
    return F.greatest(audio.tempo_score(gap), later)


def cell_bound(weights: dict[str, float], seed: str = "seed.") -> Column:
    """The greatest score of any song of a cell with a seed.

    A NaN feature scores 0; as the greatest value of a cell it leaves the bound at 1.
    """
    score = F.lit(0.0)
    for name, weight in weights.items():
        own, low, high = F.col(f"{seed}{name}"), F.col(f"{name}_lo"), F.col(f"{name}_hi")
        if name == "tempo":
            part = _tempo_bound(own, low, high)
        else:
            part = 1.0 - F.least(F.lit(1.0), _gap(own, low, high) / (20.0 if name == "loudness" else 1.0))
        score = score + weight * F.when(F.isnan(own) | F.isnan(low) | F.isnan(high), F.lit(1.0)).otherwise(part)
    return score / F.lit(sum(weights.values()))


def _scored(cells: CellTable, wanted: DataFrame, weights: dict[str, float], exclude_self: bool) -> DataFrame:
    """(seed_id, song_id, audio) of the songs of the ``wanted`` (cell, seed) pairs; reads no other cell."""
    asked = write_and_read(wanted.groupBy("cell").agg(F.collect_list("seed").alias("seeds")), "wanted-cells")
    numbers = sorted(r["cell"] for r in asked.select("cell").collect())  # at most all cells
    songs = cells.songs.where(F.col("cell").isin(numbers)) if numbers else cells.songs.limit(0)
    pairs = songs.join(asked, "cell").withColumn("seed", F.explode("seeds"))
    if exclude_self:
        pairs = pairs.where(F.col("song_id") != F.col("seed.seed_id"))
    pairs = pairs.withColumn("tempo_gap", audio.tempo_gap(F.col("seed.tempo"), F.col("tempo")))
    score = audio.complete_similarity(lambda n: F.col(f"seed.{n}"), F.col, F.col("tempo_gap"), weights)
    return pairs.select("seed.seed_id", "song_id", sc.score_round(score).alias("audio"))


@dataclass
class Found:
    """The best songs, and the (seed, cell, n, round) visits that were scored for them."""

    best: DataFrame
    visits: DataFrame


def nearest_by_audio(
    cells: CellTable, seeds: DataFrame, k: int, weights: dict[str, float] = audio.STANDARD_WEIGHTS,
    floor: float = 0.0, exclude_self: bool = True,
) -> Found:
    """Exact top ``k`` per seed by the weighted audio similarity of at least ``floor``: seed_id, song_id, audio, rank.

    ``seeds`` has seed_id and the scored features. First each seed's most promising cells
    are read, as many as hold ``k`` songs besides the seed; then all others whose bound
    reaches the k-th score found there.
    """
    asked = audio.clean_features(seeds.select("seed_id", *audio.STANDARD_WEIGHTS))
    # Bounds stand for the catalog here: one row a cell meets the seeds in blocks.
    bounds = cells.bounds.withColumnRenamed("cell", "song_id")
    met = sc.against_seeds(bounds, asked, exclude_self=False).withColumn("bound", sc.score_round(cell_bound(weights) + 1e-6))
    ranked = met.select(F.col("song_id").alias("cell"), "n", "bound", "seed").where(F.col("bound") >= floor)
    best_first = W.partitionBy("seed.seed_id").orderBy(F.desc("bound"), "cell").rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(best_first), F.lit(0))
    visits = write_and_read(ranked.withColumn("first", before <= (k if exclude_self else k - 1)), "cell-bounds")
    order = [F.desc("audio"), F.asc("song_id")]
    early = sc.top_k(_scored(cells, visits.where("first"), weights, exclude_self).where(F.col("audio") >= floor), ["seed_id"], order, k)
    early = write_and_read(early, "early-best")
    reached = early.where(F.col("rank") == k).select("seed_id", F.col("audio").alias("kth"))
    later = visits.where(~F.col("first")).join(reached, F.col("seed.seed_id") == F.col("seed_id"), "left")
    open_ = write_and_read(later.where(F.col("kth").isNull() | (F.col("bound") >= F.col("kth"))).select("cell", "n", "seed"), "open-cells")
    late = _scored(cells, open_, weights, exclude_self).where(F.col("audio") >= floor)
    best = sc.top_k(early.drop("rank").unionByName(late), ["seed_id"], order, k)
    told = visits.where("first").select("seed.seed_id", "cell", "n", F.lit(1).alias("round")).unionByName(
        open_.select("seed.seed_id", "cell", "n", F.lit(2).alias("round"))
    )
    return Found(best, told)
