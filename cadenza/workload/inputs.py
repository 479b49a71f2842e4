"""Derived inputs that several queries share: the stand-in lexicon, idioms and the feature table."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.functions import text as tx
from cadenza.operators.cells import CellTable, build_cells
from cadenza.plans.features import build_features
from cadenza.session import parts_for, path_exists, spread, work_path, write_and_read
from cadenza.sources.tables import AUDIO_KEYS, songs, table

_BUILT: dict[tuple, Any] = {}

# A term belongs to the stand-in lexicon from one token in so many on.
LEXICON_SHARE = 500
# Bytes of a part of the documents whose words are counted.
LEXICON_BYTES = 64 << 20
# Songs of a cell in the workload, whose catalogs are small.
CELL_SONGS = 50


def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word that makes up one token in 500, with a valence derived from its length.

    Stands in for the lexicon table a user supplies.
    """
    documents = table(spark, sf_dir, "documents")
    if len(documents.inputFiles()) < spark.sparkContext.defaultParallelism:
        # A few files, however large, would keep as few cores busy.
        documents = documents.repartition(parts_for(documents, LEXICON_BYTES))
    words = documents.select(F.explode(tx.words(F.col("text"))).alias("term"))
    # Written: the total reads the counts as well, and texts are cut once for both.
    counted = write_and_read(words.groupBy("term").agg(F.count(F.lit(1)).alias("n")), "word-counts")
    total = counted.agg(F.sum("n").alias("n")).scalar()
    valence = (F.length("term") % 9 - 4).cast("double")
    return counted.where(F.col("n") * LEXICON_SHARE >= total).select(
        "term", valence.alias("valence"), (valence / 4).alias("polarity"), (F.abs(valence) / 4).alias("subjectivity")
    )


def _version(spark: SparkSession, sf_dir: str, names: list[str]) -> tuple:
    """The tables' files with their sizes and times, so that changed input is built anew."""
    files = [f for name in names for f in table(spark, sf_dir, name).inputFiles()]
    out = []
    for name in sorted(files):
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
        out.append((name, status.getLen(), status.getModificationTime()))
    return tuple(out)


def _built_once(spark: SparkSession, sf_dir: str, label: str, names: list[str], build: Callable[[], DataFrame]) -> DataFrame:
    """A derived table of the given data, written on first use in an application."""
    key = (spark.sparkContext.applicationId, label, _version(spark, sf_dir, names))
    if key not in _BUILT:
        path = work_path(spark, label)
        build().write.parquet(path)
        _BUILT[key] = path
    path = _BUILT[key]
    if not path_exists(spark, f"{path}/_SUCCESS"):
        raise FileNotFoundError(f"derived table {label} is gone from {path}")
    return spread(spark.read.parquet(path))


def feature_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lexicon as a table: it is read once per lag of the negation rule."""
    return _built_once(spark, sf_dir, "lexicon", ["documents"], lambda: lexicon(spark, sf_dir))


def song_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature table: numbers, sentiment and term counts of every song."""
    return _built_once(
        spark, sf_dir, "features", ["documents", "embeddings"],
        lambda: build_features(songs(spark, sf_dir), feature_lexicon(spark, sf_dir)),
    )


def song_cells(spark: SparkSession, sf_dir: str) -> CellTable:
    """The catalog in cells, written on first use in an application; small cells for a small catalog."""
    key = (spark.sparkContext.applicationId, "cells", _version(spark, sf_dir, ["documents", "embeddings"]))
    if key not in _BUILT:
        catalog = songs(spark, sf_dir).select("song_id", *AUDIO_KEYS)
        _BUILT[key] = build_cells(catalog, per_cell=CELL_SONGS)
    return _BUILT[key]


def genre_leads(features: DataFrame) -> DataFrame:
    """The alphabetically first song of every genre, as a request's seeds."""
    leads = features.groupBy("playlist_genre").agg(F.min(F.struct("track_name", "song_id")).alias("lead"))
    return features.join(leads.select(F.col("lead.song_id").alias("song_id")), "song_id", "left_semi")
