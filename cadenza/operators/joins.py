"""Hydration, backfill, retention and map joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.functions.arrays import bind

# File endings the storage clean-up looks at.
AUDIO_ENDINGS = [".mp3", ".wav", ".m4a"]
CACHE_ENDINGS = [".pkl", ".npy", ".json"]


def fetch_features(table: DataFrame, ids: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """Rows of the listed ids, only the listed columns: one semi join in place of batches."""
    return table.select(id_col, *columns).join(ids.select(id_col).distinct(), id_col, "left_semi")


def hydrate(results: DataFrame, catalog: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """Results with their catalog row; texts of unknown ids read 'Unknown'."""
    joined = results.join(catalog.select(id_col, *columns), id_col, "left")
    return joined.withColumns({c: F.coalesce(c, F.lit("Unknown")) for c in columns})


def backfill(table: DataFrame, lookup: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """Fill missing or empty values from the lookup; present values stay."""
    found = lookup.select(id_col, *[F.col(c).alias(f"_{c}") for c in columns])
    joined = table.join(found, id_col, "left")
    own = {c: F.coalesce(F.when(F.col(c) != "", F.col(c)), F.col(f"_{c}")) for c in columns}
    return joined.withColumns(own).select(*table.columns)


def keep_recommended(songs: DataFrame, recent: DataFrame, id_col: str, original: Column) -> DataFrame:
    """Songs that are originals or were recommended lately.

    NULL ids are dropped from ``recent``: SQL's NOT IN would otherwise keep every song.
    """
    known = recent.select(id_col).where(F.col(id_col).isNotNull()).distinct().withColumn("_recent", F.lit(True))
    joined = songs.join(known, id_col, "left")
    return joined.where(original | F.col("_recent")).drop("_recent")


def deletable_files(
    files: DataFrame, active: DataFrame, endings: list[str], as_of: Column, max_age: Column
) -> DataFrame:
    """Files of the given endings that nothing uses and that are older than ``max_age``."""
    named = [F.endswith("path", F.lit(e)) for e in endings]
    matches = named[0]
    for test in named[1:]:
        matches = matches | test
    old = files.where(matches & (F.col("modified") < as_of - max_age))
    return old.join(active.select("path").distinct(), "path", "left_anti")


def common_key_products(a: Column, b: Column) -> Column:
    """Map of key to product over the keys both maps have."""
    keys = F.array_intersect(F.map_keys(a), F.map_keys(b))
    return bind(
        keys,
        lambda ks: F.map_from_arrays(ks, F.transform(ks, lambda k: F.try_element_at(a, k) * F.try_element_at(b, k))),
    )
