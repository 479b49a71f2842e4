"""Feature records: key reduction, fixed and variable vectors, defaults, profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.sources.tables import AUDIO_KEYS

# The features of a 0..1 profile.
PROFILE_KEYS = ["danceability", "energy", "acousticness", "instrumentalness", "liveness", "speechiness", "valence"]

# Keys that never enter a variable-length vector.
SKIPPED_KEYS = ["source", "id", "track_name", "track_artist", "lyrics"]

# The sentiment of an empty text.
EMPTY_SENTIMENT = {"compound": 0.0, "pos": 0.0, "neg": 0.0, "neu": 1.0, "polarity": 0.0, "subjectivity": 0.5}


def standard_keys(features: Column) -> Column:
    """Only the twelve known features of a wider map; absent ones stay absent."""
    return F.map_filter(features, lambda k, v: k.isin(AUDIO_KEYS))


def fixed_vector(features: Column) -> Column:
    """Map to the vector of twelve, 0.0 where a feature is missing."""
    return F.array(*[F.coalesce(F.try_element_at(features, F.lit(k)), F.lit(0.0)) for k in AUDIO_KEYS])


def variable_vector(features: Column) -> Column:
    """Map of value lists to one flat vector, keys in order, text-only keys skipped."""
    kept = F.map_filter(features, lambda k, v: ~k.isin(SKIPPED_KEYS))
    ordered = F.array_sort(F.map_entries(kept), lambda a, b: F.when(a["key"] < b["key"], -1).otherwise(1))
    return F.flatten(F.transform(ordered, lambda e: e["value"]))


def same_arity(df: DataFrame, vector: str, size: Column) -> DataFrame:
    """Rows whose vector has the expected length."""
    return df.where(F.size(vector) == size)


def default_sentiment() -> Column:
    parts: list[Column] = []
    for key, value in EMPTY_SENTIMENT.items():
        parts += [F.lit(key), F.lit(value)]
    return F.create_map(*parts)


# The features a failed extraction reports, all zero.
EXTRACTED_KEYS = [
    "duration_ms", "tempo", "energy", "loudness", "acousticness", "danceability", "speechiness",
    "instrumentalness", "liveness", "valence",
]


def default_audio() -> Column:
    return F.create_map(*[c for k in EXTRACTED_KEYS for c in (F.lit(k), F.lit(0.0))])


def with_defaults(record: Column, default: Column) -> Column:
    """The record, or the default where there is none."""
    return F.coalesce(record, default)


def profile(df: DataFrame, id_col: str) -> DataFrame:
    """Long form (id, feature, value) of seven features clamped to 0..1; missing is 0."""
    clamped = df.select(
        id_col,
        *[F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(k).cast("double"))), F.lit(0.0)).alias(k) for k in PROFILE_KEYS],
    )
    return clamped.unpivot(id_col, PROFILE_KEYS, "feature", "value")
