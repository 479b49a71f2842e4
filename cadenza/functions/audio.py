"""Per-feature audio similarity as column arithmetic."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Feature weights of the two similarity variants.
STANDARD_WEIGHTS = {
    "danceability": 0.15, "energy": 0.15, "tempo": 0.15, "valence": 0.10, "acousticness": 0.10,
    "instrumentalness": 0.10, "loudness": 0.10, "speechiness": 0.10, "liveness": 0.05,
}
VIDEO_WEIGHTS = {
    "tempo": 0.25, "energy": 0.20, "loudness": 0.15, "valence": 0.15, "acousticness": 0.10,
    "danceability": 0.05, "speechiness": 0.05, "instrumentalness": 0.03, "liveness": 0.02,
}
STANDARD_MIN_FEATURES = 3
VIDEO_MIN_FEATURES = 2

# Divisors and caps that bring raw extracted features to catalog ranges.
RANGE_RULES = {"danceability": (26.0, 1.0), "speechiness": (30.0, 0.95), "energy": (10.0, 1.0)}
LOUDNESS_FLOOR = -60.0
TEMPO_CAP = 250.0


def tempo_gap(seed: Column, other: Column) -> Column:
    """Closest of same, double and half time; not symmetric, the seed comes first."""
    return F.least(F.abs(seed - other), F.abs(seed - 2 * other), F.abs(seed - 0.5 * other))


def tempo_score(gap: Column) -> Column:
    """1 up to 5 BPM, falling to 20, then a second, gentler fall to 0 at 40; NaN scores 0."""
    return (
        F.when(gap <= 5, F.lit(1.0))
        .when(gap <= 20, 1.0 - (gap - 5) / 15.0)
        .when(gap < 40, 1.0 - gap / 40.0)
        .otherwise(F.lit(0.0))
    )


def tempo_similarity(seed: Column, other: Column) -> Column:
    return tempo_score(tempo_gap(seed, other))


def range_similarity(a: Column, b: Column, span: float) -> Column:
    return 1.0 - F.least(F.lit(1.0), F.abs(a - b) / span)


def feature_similarity(name: str, seed: Column, other: Column) -> Column:
    if name == "tempo":
        return tempo_similarity(seed, other)
    if name == "loudness":
        return range_similarity(seed, other, 20.0)
    return range_similarity(seed, other, 1.0)


Lookup = Callable[[str], Column]


def clean_features(df: DataFrame, names: Iterable[str] = tuple(STANDARD_WEIGHTS)) -> DataFrame:
    """The scored features as doubles, NULL (unparseable) as 0.0.

    Done once per row, below the pairing, which keeps the pair expression small enough
    for the JVM to compile.
    """
    return df.withColumns({n: F.coalesce(F.col(n).cast("double"), F.lit(0.0)) for n in names})


def complete_similarity(seed: Lookup, other: Lookup, gap: Column, weights: dict[str, float]) -> Column:
    """Weighted mean over records that have all features, cleaned by :func:`clean_features`.

    A NaN value adds no score but keeps its weight in the divisor: LEAST ranks NaN above
    every number, so the range similarity becomes 0 by itself.
    """
    score = F.lit(0.0)
    for name, weight in weights.items():
        part = tempo_score(gap) if name == "tempo" else feature_similarity(name, seed(name), other(name))
        score = score + weight * part
    return score / F.lit(sum(weights.values()))


def partial_similarity(
    seed: Lookup,
    other: Lookup,
    present: tuple[Lookup, Lookup],
    weights: dict[str, float] = STANDARD_WEIGHTS,
    min_features: int = STANDARD_MIN_FEATURES,
) -> Column:
    """The same over records that may lack features; only common ones count.

    ``present`` tells, per side, whether a record has a feature. Too few common features
    give 0. A NULL value (unparseable) counts as 0.0.
    """
    score, used, common = F.lit(0.0), F.lit(0.0), F.lit(0)
    for name, weight in weights.items():
        part = weight * feature_similarity(name, F.coalesce(seed(name), F.lit(0.0)), F.coalesce(other(name), F.lit(0.0)))
        both = present[0](name) & present[1](name)
        score = score + F.when(both, part).otherwise(F.lit(0.0))
        used = used + F.when(both, F.lit(weight)).otherwise(F.lit(0.0))
        common = common + both.cast("int")
    return F.when((common < min_features) | (used == 0), F.lit(0.0)).otherwise(score / used)


def normalise_ranges(value: Lookup) -> dict[str, Column]:
    """Bring raw extracted features into catalog ranges; each rule fires only when exceeded."""
    out: dict[str, Column] = {}
    for name, (divisor, cap) in RANGE_RULES.items():
        v = value(name)
        out[name] = F.when(v > 1, F.least(F.lit(cap), F.greatest(F.lit(0.0), v / divisor))).otherwise(v)
    v = value("valence")
    out["valence"] = F.when(v.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), v)))
    v = value("loudness")
    out["loudness"] = F.when(v < LOUDNESS_FLOOR, F.lit(LOUDNESS_FLOOR)).otherwise(v)
    v = value("tempo")
    out["tempo"] = F.when(v > TEMPO_CAP, F.lit(TEMPO_CAP)).otherwise(v)
    return out


def looks_unnormalised(marker: Column, danceability: Column, speechiness: Column) -> Column:
    """Video-derived features: marked as such, or outside the 0..1 range."""
    return F.coalesce(marker == "video", F.lit(False)) | F.coalesce(
        (danceability > 1.0) | (speechiness > 1.0), F.lit(False)
    )
