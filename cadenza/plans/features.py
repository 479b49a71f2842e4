"""The catalog's derived features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.functions import text as tx
from cadenza.operators.scoring import with_terms
from cadenza.operators.sentiment import lexicon_polarity, lexicon_sentiment
from cadenza.session import parts_for, path_exists, write_and_read

#: Bytes of the catalog's files that one task reads, about.
TEXT_BYTES = 16 << 20
SENTIMENT_KEYS = ["neg", "neu", "pos", "compound"]


def materialise(df: DataFrame, path: str) -> DataFrame:
    """Write once, read from then on: a finished table at ``path`` is reused as it is."""
    spark = df.sparkSession
    if not path_exists(spark, f"{path}/_SUCCESS"):
        df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def build_features(catalog: DataFrame, lexicon: DataFrame, idioms: DataFrame | None = None) -> DataFrame:
    """The catalog's numbers, sentiment and term columns; the texts stay behind.

    A search reads only the columns it scores, so those without a lyrics leg skip the terms.
    """
    # Written once for the three legs, and dealt evenly: which rows a join leaves may lie in a few files.
    catalog = write_and_read(catalog.repartition(parts_for(catalog, TEXT_BYTES)), "feature-texts")
    mood = lexicon_sentiment(catalog, "song_id", "lyrics", lexicon, idioms, in_rows=True)
    tokens = catalog.select("song_id", tx.words(F.col("lyrics")).alias("tokens"))
    tone = lexicon_polarity(tokens, "song_id", "tokens", lexicon)
    return with_terms(catalog, "lyrics").drop("lyrics").join(mood, "song_id").join(tone, "song_id")
