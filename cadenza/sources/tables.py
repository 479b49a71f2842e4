"""The given Parquet tables, and the song catalog view derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.session import spread

# The twelve audio features, in vector order.
AUDIO_KEYS = [
    "danceability", "energy", "key", "loudness", "mode", "speechiness",
    "acousticness", "instrumentalness", "liveness", "valence", "tempo", "duration_ms",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table for heavy per-row work, also where its file is a single split."""
    return spread(table(spark, sf_dir, name))


def _unit(i: int) -> Column:
    """Embedding component ``i`` (1-based) moved into 0..1."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(0.5) + F.get("embedding", F.lit(i - 1)).cast("double")))


def song_view(documents: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Catalog rows: one per document that has an embedding.

    Audio features stay flat columns so that scoring them is plain generated code.
    """
    # Named below the join: a view without lyrics sends no texts through it.
    named = documents.withColumn("track_name", F.substring_index("text", " ", 3))
    joined = named.join(embeddings, named.doc_id == embeddings.vec_id)
    doubles = F.transform("embedding", lambda v: v.cast("double"))
    raw_topics = F.transform(F.slice(doubles, 55, 10), lambda v: F.lit(1.0) + v)
    topic_sum = F.aggregate(raw_topics, F.lit(0.0), lambda acc, v: acc + v)
    return joined.select(
        F.col("doc_id").alias("song_id"),
        "track_name",
        F.col("source").alias("track_artist"),
        F.col("lang").alias("playlist_genre"),
        F.col("text").alias("lyrics"),
        _unit(1).alias("danceability"),
        _unit(2).alias("energy"),
        F.least(F.lit(11), F.floor(12 * _unit(3)).cast("int")).alias("key"),
        (-60 + 60 * _unit(4)).alias("loudness"),
        (_unit(5) >= 0.5).cast("int").alias("mode"),
        _unit(6).alias("speechiness"),
        _unit(7).alias("acousticness"),
        _unit(8).alias("instrumentalness"),
        _unit(9).alias("liveness"),
        _unit(10).alias("valence"),
        (60 + 140 * _unit(11)).alias("tempo"),
        F.floor(120000 + 180000 * _unit(12)).cast("int").alias("duration_ms"),
        F.slice(doubles, 13, 52).alias("w2v"),
        F.transform(raw_topics, lambda v: v / topic_sum).alias("topics"),
        F.col("label").alias("cluster"),
    )


def songs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return song_view(spread_table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings"))


def text_view(documents: DataFrame) -> DataFrame:
    """Catalog rows of all documents, for what needs names and texts alone."""
    return documents.select(
        F.col("doc_id").alias("song_id"), F.substring_index("text", " ", 3).alias("track_name"),
        F.col("source").alias("track_artist"), F.col("lang").alias("playlist_genre"), F.col("text").alias("lyrics"),
    )


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_view(spread_table(spark, sf_dir, "documents"))


def audio_map(prefix: str = "") -> Column:
    """The flat features as MAP<STRING, DOUBLE>."""
    parts: list[Column] = []
    for name in AUDIO_KEYS:
        parts += [F.lit(name), F.col(f"{prefix}{name}").cast("double")]
    return F.create_map(*parts)


def audio_vector(prefix: str = "") -> Column:
    """The flat features as ARRAY<DOUBLE> of length twelve."""
    return F.array(*[F.col(f"{prefix}{name}").cast("double") for name in AUDIO_KEYS])
