"""Recommendation products built on the scoring operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.functions import audio, text as tx
from cadenza.operators import scoring as sc, search, spaces as vs
from cadenza.plans import similar
from cadenza.session import write_and_read
from cadenza.sources.tables import AUDIO_KEYS

# Mood prototypes; features not named are 0.
MOODS = {
    "happy": {"valence": 0.8, "energy": 0.7, "danceability": 0.7},
    "sad": {"valence": 0.2, "energy": 0.3, "danceability": 0.3},
    "energetic": {"valence": 0.6, "energy": 0.9, "danceability": 0.8},
    "relaxed": {"valence": 0.5, "energy": 0.2, "danceability": 0.3},
    "angry": {"valence": 0.3, "energy": 0.8, "danceability": 0.4},
    "romantic": {"valence": 0.6, "energy": 0.4, "danceability": 0.5},
    "melancholic": {"valence": 0.3, "energy": 0.4, "danceability": 0.3},
    "party": {"valence": 0.8, "energy": 0.8, "danceability": 0.9},
}

# Sweep of stricter floors.
SWEEP_STEP = 0.05
SWEEP_LEVELS = 4
SWEEP_MIN_SHARE = 0.7


def similar_to_external(
    catalog: DataFrame, queries: DataFrame, k: int = 5, weights: dict[str, float] = sc.DEFAULT_WEIGHTS
) -> DataFrame:
    """Top ``k`` catalog songs for feature records that are not in the catalog.

    ``queries`` has seed_id, the twelve features, the sentiment and term columns, ``worded``
    and ``video``. A query that is not ``worded`` is matched by audio alone. Video-derived
    queries use their own feature weights and a lower audio floor. A catalog song without
    stored sentiment scores 0 there.
    """
    numbers = [*audio.STANDARD_WEIGHTS, *similar.MOOD]
    pairs = sc.audio_pairs(
        catalog.select("song_id", *numbers), queries.select("seed_id", *numbers, "video", "worded"), exclude_self=False
    )
    video, worded = F.col("seed.video"), F.col("seed.worded")
    audio_leg = F.when(video, sc.audio_score(audio.VIDEO_WEIGHTS)).otherwise(sc.audio_score())
    stored = F.col("compound").isNotNull()
    mood = F.when(worded & stored, similar.sentiment_cosine())
    low = F.when(video, F.lit(sc.MIN_VIDEO_AUDIO)).otherwise(F.lit(sc.MIN_AUDIO))
    scored = pairs.select(
        "seed.seed_id", "song_id", worded.alias("worded"), low.alias("audio_floor"),
        audio_leg.alias("audio_raw"), F.coalesce(mood, F.lit(0.0)).alias("sentiment_raw"),
    ).where(sc.score_round(F.col("audio_raw")) >= sc.START_FACTOR * F.col("audio_floor"))
    scored = similar.with_lyrics(scored, catalog, queries)
    kept = similar.combine_legs(scored, weights, (~F.col("worded"), F.col("audio_raw"))).where(
        F.col("combined") >= sc.START_FACTOR * sc.MIN_COMBINED
    )
    return similar.result_rows(sc.refine_and_rank(kept, ["seed_id"], k, F.col("audio_floor")), catalog)


def video_audio_pairs(catalog: DataFrame, queries: DataFrame) -> DataFrame:
    """Audio similarity by the video weights of every query to every song, no floor."""
    pairs = sc.audio_pairs(catalog, queries.select("seed_id", *AUDIO_KEYS), exclude_self=False)
    score = sc.score_round(sc.audio_score(audio.VIDEO_WEIGHTS))
    return pairs.select("seed.seed_id", "song_id", score.alias("audio"))


def similar_by_video_audio(catalog: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """Audio-only search for video-derived features: no early stop, median-based refinement.

    The refinement keeps scores of at least max(floor, 0.85 median) where there are more than
    2 k candidates, unless fewer than ``k`` would remain. The k best of so many lie at or above
    the median, and with fewer than ``k`` above the floor nothing is cut: either way the result
    is the k best candidates, so no median is computed.
    """
    scored = video_audio_pairs(catalog, queries).where(F.col("audio") >= sc.MIN_VIDEO_AUDIO * sc.START_FACTOR)
    return video_results(sc.top_k(scored, ["seed_id"], [F.desc("audio"), F.asc("song_id")], k), catalog)


def video_results(ranked: DataFrame, catalog: DataFrame) -> DataFrame:
    return similar.result_rows(
        ranked.withColumns({"combined": F.col("audio"), "lyrics": F.lit(0.0), "sentiment": F.lit(0.0)}), catalog
    )


def mood_seeds(spark: SparkSession, moods: list[str]) -> DataFrame:
    """Prototype vectors as seeds; an unknown mood is an error."""
    unknown = [m for m in moods if m.lower() not in MOODS]
    if unknown:
        raise ValueError(f"unknown mood: {', '.join(unknown)}")
    rows = [
        (i, m.lower(), [float(MOODS[m.lower()].get(name, 0.0)) for name in AUDIO_KEYS]) for i, m in enumerate(moods)
    ]
    return spark.createDataFrame(rows, "seed_id BIGINT, mood STRING, v ARRAY<DOUBLE>")


def songs_for_moods(catalog: DataFrame, moods: list[str], k: int = 5) -> DataFrame:
    """Top ``k`` songs per mood by standardised cosine; ``catalog`` has (song_id, v)."""
    seeds = mood_seeds(catalog.sparkSession, moods)
    stats = vs.vector_stats(catalog, ["v"])
    near = vs.cosine_neighbours(
        vs.standardised(catalog, ["v"], stats), vs.standardised(seeds, ["v"], stats), k, exclude_self=False
    )
    return near.join(seeds.select("seed_id", "mood"), "seed_id").select("mood", "song_id", "score", "rank")


def predicted_mood(value: dict[str, Column]) -> Column:
    """The mood whose prototype is nearest in valence, energy and danceability."""
    distances = [
        F.struct(
            F.sqrt(sum(((value[n] - w) * (value[n] - w) for n, w in prototype.items()), F.lit(0.0))).alias("distance"),
            F.lit(mood).alias("mood"),
        )
        for mood, prototype in MOODS.items()
    ]
    return F.array_min(F.array(*distances))["mood"]


def mood_list(features: DataFrame, mood: str, k: int = 10) -> DataFrame:
    """Happiest or saddest songs by sentiment."""
    orders = {"happy": F.desc("compound"), "sad": F.asc("compound")}
    if mood not in orders:
        raise ValueError(f"unknown mood: {mood}")
    return features.orderBy(orders[mood], "song_id").limit(k)


def playlist(catalog: DataFrame, seeds: DataFrame, n: int) -> DataFrame:
    """``n`` songs per seed, no (title, artist) twice."""
    order = [F.desc("combined"), F.asc("song_id")]
    scored = similar.score_pairs(catalog, seeds, carry=("track_name", "track_artist"))
    distinct = sc.top_k(scored, ["seed_id", "track_name", "track_artist"], order, 1, "copy").drop("copy")
    return similar.result_rows(sc.top_k(distinct, ["seed_id"], order, n).drop("track_name", "track_artist"), catalog)


def recommend_by_name(catalog: DataFrame, requests: DataFrame, k: int = 5, with_artist: bool = False) -> DataFrame:
    """Recommendations for the first song that bears each requested title (and artist)."""
    artist = "track_artist" if with_artist else None
    found = search.first_matches(catalog, requests, "track_name", "song_id", artist).select("song_id").distinct()
    seeds = sc.as_seeds(catalog.join(found, "song_id", "left_semi"), similar.SEED_COLUMNS)
    return similar.similar_songs(catalog, seeds, k)


def recommend_for_page(
    catalog: DataFrame, chosen: Column, offset: int = 0, limit: int = 10, k: int = 5
) -> DataFrame:
    """Recommendations for every song on one page of a genre, a mood or another choice."""
    page = search.page(catalog.where(chosen), ["track_name", "song_id"], offset, limit)
    return similar.similar_songs(catalog, sc.as_seeds(page, similar.SEED_COLUMNS), k)


def component_split(score: Column, has_lyrics: Column) -> Column:
    """One score split over its components."""
    return F.create_map(F.lit("audio"), score * 0.6, F.lit("lyrics"), F.when(has_lyrics, score * 0.4).otherwise(F.lit(0.0)))


def external_links(url: Column) -> Column:
    return F.when(url.isNotNull(), F.create_map(F.lit("youtube"), url))


def estimated_components(score: Column) -> dict[str, Column]:
    """Component scores where only a total is known."""
    return {"audio": score * 0.8 + 0.1, "lyrics": score * 0.7 + 0.2, "sentiment": score * 0.6 + 0.3}


def threshold_sweep(scored: DataFrame, k: int) -> DataFrame:
    """Per seed the top ``k`` at the level of stricter floors with the best mean score.

    Level 0 always counts; a stricter level only with at least 0.7 k rows. The lowest of
    equally good levels wins, which is what trying them one after the other gives.
    """
    # Scored once; the levels only repeat narrow rows of ids and scores.
    levels = write_and_read(scored, "swept").withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(SWEEP_LEVELS - 1))))
    lift = SWEEP_STEP * F.col("level")
    levels = levels.withColumns({"audio_floor": F.lit(sc.MIN_AUDIO) + lift, "combined_floor": F.lit(sc.MIN_COMBINED) + lift})
    passing = levels.where(
        (F.col("audio") >= sc.START_FACTOR * F.col("audio_floor"))
        & (F.col("combined") >= sc.START_FACTOR * F.col("combined_floor"))
    )
    ranked = sc.refine_and_rank(passing, ["seed_id", "level"], k, F.col("audio_floor"), F.col("combined_floor"), written=True)
    # From here on at most levels * k rows per seed.
    ranked = write_and_read(ranked, "swept-ranks")
    quality = ranked.groupBy("seed_id", "level").agg(F.avg("combined").alias("mean"), F.count(F.lit(1)).alias("n"))
    usable = quality.where((F.col("level") == 0) | (F.col("n") >= SWEEP_MIN_SHARE * k))
    best = usable.groupBy("seed_id").agg(
        F.max_by("level", F.struct(sc.score_round(F.col("mean")), -F.col("level"))).alias("level")
    )
    return ranked.join(best, ["seed_id", "level"])


def explanation_columns() -> dict[str, Column]:
    legs = [F.col(c) for c in ("audio", "lyrics", "sentiment")]
    return {"reason": tx.reason_text(*legs), "band": tx.score_band(F.col("combined"))}
