"""Hybrid similar-song search: audio, lyrics and sentiment legs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.functions import arrays, audio
from cadenza.operators import scoring as sc
from cadenza.session import write_and_read
from cadenza.sources.tables import AUDIO_KEYS

LEGS = ["audio", "lyrics", "sentiment"]
MOOD = ["neg", "neu", "pos", "compound"]
SEED_COLUMNS = [*AUDIO_KEYS, *MOOD, "terms", "terms_sq"]


def sentiment_vector(prefix: str = "") -> Column:
    return F.array(*[F.col(f"{prefix}{m}") for m in MOOD])


def sentiment_cosine() -> Column:
    """Sentiment cosine of a pair, spelled out: four terms compile better than array lambdas."""

    def dot(a: str, b: str) -> Column:
        return sum((F.col(f"{a}{m}") * F.col(f"{b}{m}") for m in MOOD), F.lit(0.0))

    return arrays.cosine_from(dot("seed.", ""), F.sqrt(dot("seed.", "seed.")), F.sqrt(dot("", "")))


def score_pairs(
    catalog: DataFrame,
    seeds: DataFrame,
    weights: dict[str, float] = sc.DEFAULT_WEIGHTS,
    audio_floor: float = sc.MIN_AUDIO * sc.START_FACTOR,
    combined_floor: float = sc.MIN_COMBINED * sc.START_FACTOR,
    feature_weights: dict[str, float] = audio.STANDARD_WEIGHTS,
    exclude_self: bool = True,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """All (seed, song) pairs that pass the floors, with their leg scores.

    Audio and sentiment are scored inside the row that a catalog song and a seed make. The
    lyrics leg is a join on the seeds' terms, whose sums meet the pairs that passed the audio
    floor. Pairs are ids and scores only (plus ``carry``): names are looked up after the top-k.
    """
    numbers = [*audio.STANDARD_WEIGHTS, *MOOD]
    pairs = sc.audio_pairs(catalog.select("song_id", *numbers, *carry), seeds.select("seed_id", *numbers), exclude_self)
    mood = sentiment_cosine()
    scored = pairs.select(
        F.col("seed.seed_id").alias("seed_id"), "song_id", *carry,
        sc.audio_score(feature_weights).alias("audio_raw"),
        (mood if weights["sentiment"] > 0 else F.lit(0.0)).alias("sentiment_raw"),
    )
    if weights["audio"] > 0:
        scored = scored.where(sc.score_round(F.col("audio_raw")) >= audio_floor)
    if weights["sentiment"] > 0.2:
        scored = scored.where(sc.score_round(F.col("sentiment_raw")) >= sc.MIN_SENTIMENT)
    if weights["lyrics"] > 0:
        scored = with_lyrics(scored, catalog, seeds)
        if weights["lyrics"] > 0.3:
            scored = scored.where(sc.score_round(F.col("lyrics_raw")) >= sc.MIN_LYRICS)
    else:
        scored = scored.withColumn("lyrics_raw", F.lit(0.0))
    return combine_legs(scored, weights).where(F.col("combined") >= combined_floor)


def with_lyrics(scored: DataFrame, catalog: DataFrame, seeds: DataFrame) -> DataFrame:
    """Adds ``lyrics_raw`` to (seed_id, song_id) pairs; 0 without a shared term."""
    lyrics = sc.lyrics_by_terms(catalog, seeds)
    return scored.join(lyrics, ["seed_id", "song_id"], "left").withColumn("lyrics_raw", F.coalesce("lyrics_raw", F.lit(0.0)))


def combine_legs(scored: DataFrame, weights: dict[str, float], override: tuple[Column, Column] | None = None) -> DataFrame:
    """Weighted sum of the unrounded legs, then every score cut to six digits.

    ``override`` is (condition, score) for rows that are combined differently.
    """
    combined = sum((F.col(f"{leg}_raw") * weights[leg] for leg in LEGS), F.lit(0.0))
    if override is not None:
        combined = F.when(override[0], override[1]).otherwise(combined)
    done = {leg: sc.score_round(F.col(f"{leg}_raw")) for leg in LEGS}
    return scored.withColumns({**done, "combined": sc.score_round(combined)}).drop(*[f"{leg}_raw" for leg in LEGS])


def result_rows(ranked: DataFrame, catalog: DataFrame) -> DataFrame:
    """Result rows with titles; ``ranked`` has k rows per seed and is written, so that Spark knows its size."""
    names = catalog.select("song_id", "track_name", "track_artist")
    return names.join(write_and_read(ranked, "ranked"), "song_id").select(
        "seed_id", "song_id", "track_name", "track_artist", "combined", "audio", "lyrics", "sentiment", "rank"
    )


def similar_songs(
    catalog: DataFrame, seeds: DataFrame, k: int = 5, weights: dict[str, float] = sc.DEFAULT_WEIGHTS
) -> DataFrame:
    """Top ``k`` songs per seed by the weighted sum of the three legs, after refinement.

    ``catalog`` and ``seeds`` hold the features, the sentiment and the term columns.
    """
    if weights["audio"] == 1.0 and weights["lyrics"] == 0.0 and weights["sentiment"] == 0.0:
        return similar_by_raw_cosine(catalog, seeds, k)
    return result_rows(sc.refine_and_rank(score_pairs(catalog, seeds, weights), ["seed_id"], k), catalog)


def similar_by_raw_cosine(
    catalog: DataFrame, seeds: DataFrame, k: int = 5, floor: float = sc.MIN_AUDIO
) -> DataFrame:
    """Audio only: plain cosine of the twelve features, floor, top ``k``."""
    scored = raw_cosine_pairs(catalog, seeds).where(F.col("combined") >= floor)
    ranked = sc.top_k(scored, ["seed_id"], [F.desc("combined"), F.asc("song_id")], k)
    legs = {"audio": F.col("combined"), "lyrics": F.lit(0.0), "sentiment": F.lit(0.0)}
    return result_rows(ranked.withColumns(legs), catalog)


def raw_cosine_pairs(catalog: DataFrame, seeds: DataFrame, exclude_self: bool = True) -> DataFrame:
    pairs = sc.against_seeds(catalog, seeds, exclude_self)
    # Whole-number features would overflow their own type when multiplied.
    mine, other = ([F.col(f"{p}{n}").cast("double") for n in AUDIO_KEYS] for p in ("", "seed."))
    dot = sum((a * b for a, b in zip(other, mine)), F.lit(0.0))
    norms = [F.sqrt(sum((a * a for a in side), F.lit(0.0))) for side in (other, mine)]
    return pairs.select(
        F.col("seed.seed_id").alias("seed_id"), "song_id", sc.score_round(arrays.cosine_from(dot, *norms)).alias("combined"),
    )

