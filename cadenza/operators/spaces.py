"""Vector spaces: column standardisation, neighbours, hybrid vectors."""

from __future__ import annotations

from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.functions import arrays
from cadenza.operators.scoring import against_seeds, score_round, top_k
from cadenza.session import write_and_read

# Weights of the hybrid vector's parts.
HYBRID_WEIGHTS = {"w2v": 0.4, "audio": 0.3, "sentiment": 0.2, "topics": 0.1}
EXPLAIN_EPSILON = 1e-10


def vector_stats(df: DataFrame, vectors: list[str]) -> DataFrame:
    """Mean and population std of every component of several vector columns: one row, one pass.

    The row has one struct (mean, scale) per vector column.
    """
    row = df.agg(
        *[Summarizer.metrics("mean", "variance", "count").summary(array_to_vector(F.col(v))).alias(v) for v in vectors]
    )

    def stats(v: str) -> Column:
        n = F.greatest(F.col(f"{v}.count"), F.lit(1))
        scale = F.transform(vector_to_array(F.col(f"{v}.variance")), lambda x: F.sqrt(x * (n - 1) / n))
        return F.struct(vector_to_array(F.col(f"{v}.mean")).alias("mean"), scale.alias("scale")).alias(v)

    return row.select(*map(stats, vectors))


def standardised(df: DataFrame, vectors: list[str], stats: DataFrame | None = None) -> DataFrame:
    """Replace vector columns by their standardised form, by ``stats`` or their own statistics."""
    fitted = vector_stats(df, vectors) if stats is None else stats
    with_stats = df.withColumn("_stats", fitted.select(F.struct(*vectors)).scalar())
    done = {v: arrays.standardise(F.col(v), F.col(f"_stats.{v}.mean"), F.col(f"_stats.{v}.scale")) for v in vectors}
    return with_stats.withColumns(done).drop("_stats")


def _nearest(scored: DataFrame, k: int) -> DataFrame:
    return top_k(scored, ["seed_id"], [F.desc("score"), F.asc("song_id")], k)


def cosine_neighbours(space: DataFrame, seeds: DataFrame, k: int, exclude_self: bool = True) -> DataFrame:
    """Top ``k`` by cosine; ``space`` has (song_id, v), ``seeds`` (seed_id, v)."""
    pairs = against_seeds(space.select("song_id", "v"), seeds.select("seed_id", "v"), exclude_self)
    scored = pairs.select("seed.seed_id", "song_id", score_round(arrays.cosine(F.col("seed.v"), F.col("v"))).alias("score"))
    return _nearest(scored, k)


def euclid_neighbours(space: DataFrame, seeds: DataFrame, k: int = 10) -> DataFrame:
    """``k`` nearest by distance, scored 1 - d / max(d) among them."""
    pairs = against_seeds(space.select("song_id", "v"), seeds.select("seed_id", "v"))
    distances = pairs.select("seed.seed_id", "song_id", score_round(arrays.euclid(F.col("seed.v"), F.col("v"))).alias("distance"))
    near = top_k(distances, ["seed_id"], [F.asc("distance"), F.asc("song_id")], k)
    furthest = F.max("distance").over(W.partitionBy("seed_id"))
    score = F.when(furthest > 0, 1 - F.col("distance") / furthest).otherwise(F.lit(1.0))
    return near.withColumn("score", score_round(score))


def fused(lists: list[DataFrame], k: int) -> DataFrame:
    """Union of scored lists, best score per song, top ``k``."""
    union = lists[0].select("seed_id", "song_id", "score")
    for other in lists[1:]:
        union = union.unionByName(other.select("seed_id", "song_id", "score"))
    best = union.groupBy("seed_id", "song_id").agg(F.max("score").alias("score"))
    return _nearest(best, k)


def angular_neighbours(space: DataFrame, seeds: DataFrame, k: int = 10) -> DataFrame:
    """``k`` nearest by sqrt(2(1 - cos)), exact."""
    near = cosine_neighbours(space, seeds, k)
    return near.select("seed_id", "song_id", score_round(arrays.angular(F.col("score"))).alias("distance"), "rank")


def approximate_neighbours(
    space: DataFrame, seeds: DataFrame, k: int = 10, tables: int = 12, bits: int = 6, seed: int = 42
) -> DataFrame:
    """``k`` nearest among the rows that share a bucket of random projections with the seed.

    A bucket is a table's number and the sides of ``bits`` random planes. Both sides post
    their ids under their buckets and meet in an equi-join; only rows that met get their
    exact distance.
    """
    unit = F.transform("v", lambda x: x / F.col("_norm"))

    def units(df: DataFrame, key: str) -> DataFrame:
        sized = df.select(key, "v", arrays.norm(F.col("v")).alias("_norm")).where("_norm > 0")
        return sized.select(key, unit.alias("v")).withColumn("features", array_to_vector("v"))

    catalog, asked = units(space, "song_id"), units(seeds, "seed_id")
    # A bucket length of 1 cuts unit vectors at the plane through 0.
    lsh = BucketedRandomProjectionLSH(
        inputCol="features", outputCol="hashes", bucketLength=1.0, numHashTables=tables * bits, seed=seed
    ).fit(catalog)

    def posted(df: DataFrame, key: str) -> DataFrame:
        sides = F.transform("hashes", lambda h: F.get(vector_to_array(h), F.lit(0)).cast("int"))
        grouped = F.transform(F.sequence(F.lit(0), F.lit(tables - 1)), lambda t: F.slice(sides, t * bits + 1, bits))
        return lsh.transform(df).select(key, F.posexplode(grouped).alias("table", "bucket"))

    met = posted(catalog, "song_id").join(posted(asked, "seed_id"), ["table", "bucket"])
    pairs = met.select("seed_id", "song_id").where(F.col("seed_id") != F.col("song_id")).distinct()
    rows = pairs.join(catalog.select("song_id", "v"), "song_id").join(asked.select("seed_id", F.col("v").alias("w")), "seed_id")
    near = _nearest(rows.select("seed_id", "song_id", score_round(arrays.dot(F.col("w"), F.col("v"))).alias("score")), k)
    return near.select("seed_id", "song_id", score_round(arrays.angular(F.col("score"))).alias("distance"), "rank")


def hybrid_space(features: DataFrame, spaces: list[str], weights: dict[str, float] = HYBRID_WEIGHTS) -> DataFrame:
    """(song_id, one standardised vector per space, their weighted concatenation ``unit`` of length 1).

    One pass gathers the statistics of all spaces. A zero concatenation stays zero.
    """
    scaled = standardised(features.select("song_id", *spaces), spaces)
    joined = F.concat(*[arrays.scaled(F.col(name), weights[name]) for name in spaces])
    long = scaled.withColumn("unit", joined).withColumn("_norm", arrays.norm(F.col("unit")))
    size = F.when(F.col("_norm") > 0, F.col("_norm")).otherwise(F.lit(1.0))
    return long.withColumn("unit", F.transform("unit", lambda x: x / size)).drop("_norm")


def hybrid_neighbours(space: DataFrame, seeds: DataFrame, k: int = 5, weights: dict[str, float] = HYBRID_WEIGHTS) -> DataFrame:
    """Cosine of the weighted concatenation, with each recommended song's own per-space scores.

    ``space`` comes from :func:`hybrid_space` and is written; ``seeds`` has its columns. A
    pair costs one dot product; the per-space scores are taken for the ``k`` winners only.
    Sentiment and topics are explained by 1 - distance, min-max scaled within the result.
    """
    pairs = against_seeds(space.select("song_id", "unit"), seeds.select("seed_id", "unit"))
    score = score_round(arrays.dot(F.col("seed.unit"), F.col("unit")))
    near = _nearest(pairs.select("seed.seed_id", "song_id", score.alias("score")), k)
    near = write_and_read(near, "hybrid-ranks")
    mine = space.select("song_id", F.struct(*weights).alias("mine"))
    other = seeds.select("seed_id", F.struct(*weights).alias("other"))
    both = near.join(mine, "song_id").join(other, "seed_id")

    def own_cosine(name: str) -> Column:
        return arrays.cosine(F.col(f"other.{name}"), F.col(f"mine.{name}"))

    def closeness(name: str) -> Column:
        return 1 - arrays.euclid(F.col(f"other.{name}"), F.col(f"mine.{name}"))

    return both.select(
        "seed_id", "song_id", "score", "rank",
        own_cosine("w2v").alias("lyrics_similarity"),
        own_cosine("audio").alias("audio_similarity"),
        closeness("sentiment").alias("sentiment_closeness"),
        closeness("topics").alias("topic_closeness"),
    )


def min_max_within(df: DataFrame, key: str, column: str) -> Column:
    """Min-max scaling inside one key's (small) result set."""
    window = W.partitionBy(key)
    low, high = F.min(column).over(window), F.max(column).over(window)
    return (F.col(column) - low) / (high - low + EXPLAIN_EPSILON)


def explained(neighbours: DataFrame) -> DataFrame:
    return neighbours.withColumns(
        {
            "sentiment_similarity": min_max_within(neighbours, "seed_id", "sentiment_closeness"),
            "topic_similarity": min_max_within(neighbours, "seed_id", "topic_closeness"),
        }
    ).drop("sentiment_closeness", "topic_closeness")


def rank_aligned(hybrid: DataFrame, by_lyrics: DataFrame, by_audio: DataFrame) -> DataFrame:
    """Beside each recommendation the score of the same rank in the single-space lists."""
    left = by_lyrics.select("seed_id", "rank", F.col("score").alias("lyrics_similarity"))
    right = by_audio.select("seed_id", "rank", F.col("score").alias("audio_similarity"))
    return (
        hybrid.select("seed_id", "song_id", "rank", F.col("score").alias("similarity"))
        .join(left, ["seed_id", "rank"], "left")
        .join(right, ["seed_id", "rank"], "left")
        .na.fill(0.0, ["lyrics_similarity", "audio_similarity"])
    )
