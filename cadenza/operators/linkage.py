"""Record linkage: containment joins, match confidence, survivorship, duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.functions import text as tx
from cadenza.operators.gram_index import containing_texts
from cadenza.operators.scoring import lyrics_cosine, top_k
from cadenza.session import write_and_read

# Confidence steps per source kind (base, exact title, contained title,
# exact artist, contained artist, penalty without artist).
SEARCH_HIT = {"base": 0.5, "title_equal": 0.3, "title_within": 0.2, "artist_equal": 0.2, "artist_within": 0.1, "no_artist": 0.0}
OPEN_DATABASE = {"base": 0.5, "title_equal": 0.3, "title_within": 0.3, "artist_equal": 0.2, "artist_within": 0.2, "no_artist": -0.3}
# A source that corrects spelling itself starts higher; its title and artist are not compared.
AUTOCORRECTED_BASE = 0.6
GOOD_ENOUGH = 0.8
OVERLAY_ABOVE = 0.5
DUPLICATE_AT = 0.8


def containment_join(catalog: DataFrame, requests: DataFrame, column: str, wanted: str) -> DataFrame:
    """Rows whose ``column`` contains a request's ``wanted`` text, ignoring case.

    The distinct texts offer each of their grams once; a wanted text is posted under its
    rarest gram alone, and ``contains`` confirms what meets there. Rows and requests then
    join the few texts that met.
    """
    asked = requests.withColumn("_part", F.lower(wanted))
    named = catalog.withColumn("_whole", F.lower(column))
    wholes = named.select(F.col("_whole").alias("value")).where(F.col("value").isNotNull()).distinct()
    parts = asked.select(F.col("_part").alias("wanted")).where(F.col("wanted").isNotNull()).distinct()
    met = write_and_read(containing_texts(wholes, parts), "contained").withColumnsRenamed({"wanted": "_part", "value": "_whole"})
    return named.join(met, "_whole").join(asked, "_part").drop("_whole", "_part")


def _within(a: Column, b: Column) -> Column:
    return F.contains(a, b) | F.contains(b, a)


def accepted_hits(queries: DataFrame, hits: DataFrame, order: list[Column], tries: int = 3) -> DataFrame:
    """Of the first ``tries`` hits per query, those whose title or artist contains or is contained."""
    first = top_k(hits, ["query_id"], order, tries, "position")
    joined = first.join(queries, "query_id")
    title = _within(F.lower("title"), F.lower("hit_title"))
    artist = _within(F.lower("artist"), F.lower("hit_artist"))
    return joined.where(title | artist)


def match_confidence(
    title: Column, artist: Column, hit_title: Column, hit_artist: Column, steps: dict[str, float],
    autocorrected: Column | None = None,
) -> Column:
    """Confidence that a hit is the song asked for; a source that corrects spelling has a fixed one."""
    t, a, ht, ha = (F.lower(c) for c in (title, artist, hit_title, hit_artist))
    score = (
        F.lit(steps["base"])
        + F.when(t == ht, steps["title_equal"]).when(_within(t, ht), steps["title_within"]).otherwise(0.0)
        + F.when(a == ha, steps["artist_equal"]).when(_within(a, ha), steps["artist_within"]).otherwise(steps["no_artist"])
    )
    bounded = F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))
    return bounded if autocorrected is None else F.when(autocorrected, F.lit(AUTOCORRECTED_BASE)).otherwise(bounded)


def survivorship(sources: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """Merge source records per id, in ``priority`` order.

    A source counts if it is strictly more confident than all before it and none before
    reached 0.8. A counting source overrides exactly the columns in its ``given`` list,
    with NULL too; there is one row per (id, priority), so groups stay tiny.
    """
    earlier = W.partitionBy(id_col).orderBy("priority").rowsBetween(W.unboundedPreceding, -1)
    best = F.coalesce(F.max("confidence").over(earlier), F.lit(0.0))
    marked = sources.withColumn("taken", (F.col("confidence") > best) & (best < GOOD_ENOUGH)).where("taken")

    def last_given(column: str) -> Column:
        return F.max_by(F.struct(column), F.when(F.array_contains("given", column), F.col("priority")))[column].alias(column)

    return marked.groupBy(id_col).agg(
        F.max("confidence").alias("confidence"),
        F.max_by("source", "priority").alias("source"),
        *[last_given(c) for c in columns],
    )


def overlay(base: DataFrame, meta: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """Non-null metadata replaces the base record where its confidence exceeds 0.5."""
    named = meta.select(id_col, F.col("confidence").alias("_conf"), *[F.col(c).alias(f"_{c}") for c in columns])
    joined = base.join(named, id_col, "left")
    trusted = F.coalesce(F.col("_conf") > OVERLAY_ABOVE, F.lit(False))
    merged = {c: F.when(trusted, F.coalesce(f"_{c}", c)).otherwise(F.col(c)) for c in columns}
    return joined.withColumns(merged).select(*base.columns)


def first_answer(sources: DataFrame, id_col: str, value: str) -> DataFrame:
    """The non-null value of the first source that has one, with the source's name."""
    return (
        sources.where(F.col(value).isNotNull())
        .groupBy(id_col)
        .agg(F.min_by(F.struct(value, "source"), "priority").alias("a"))
        .select(id_col, F.col(f"a.{value}").alias(value), "a.source")
    )


def edit_ratio(a: Column, b: Column) -> Column:
    """1 - Levenshtein distance / longer length; two empty texts are equal."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest > 0, 1 - F.levenshtein(a, b) / longest).otherwise(F.lit(1.0))


def duplicate_candidates(catalog: DataFrame, incoming: DataFrame) -> DataFrame:
    """(incoming, catalog) pairs whose catalog artist contains the incoming one: ids and titles."""
    asked = incoming.select("incoming_id", F.col("track_artist").alias("asked_artist"), tx.normalise_title(F.col("track_name")).alias("asked_title"))
    rows = catalog.select("song_id", "track_name", "track_artist", tx.normalise_title(F.col("track_name")).alias("norm_title"))
    return containment_join(rows, asked, "track_artist", "asked_artist")


def with_lyrics_similarity(pairs: DataFrame, catalog: DataFrame, incoming: DataFrame) -> DataFrame:
    """Adds ``lyrics_similarity`` to (incoming_id, song_id) pairs from both sides' term columns.

    A text without words has no cosine at all; two texts without a shared word have 0.
    """
    asked = incoming.select("incoming_id", F.struct("terms", "terms_sq").alias("asked"))
    own = catalog.select("song_id", F.struct("terms", "terms_sq").alias("own"))
    met = pairs.join(own, "song_id").join(asked, "incoming_id")
    known = (F.col("asked.terms_sq") > 0) & (F.col("own.terms_sq") > 0)
    return met.withColumn("lyrics_similarity", F.when(known, lyrics_cosine("asked.", "own."))).drop("asked", "own")


def find_duplicates(
    catalog: DataFrame, incoming: DataFrame, title_at: float = DUPLICATE_AT, lyrics_at: float = DUPLICATE_AT
) -> DataFrame:
    """Catalog songs that may duplicate an incoming one: title ratio or lyrics cosine.

    Both sides carry the term columns of their raw texts. Artists block first; only the
    pairs left fetch their terms and are scored. Ratios and cosines have six digits.
    """
    pairs = write_and_read(duplicate_candidates(catalog, incoming), "candidates")
    ratio = F.round(edit_ratio(F.col("asked_title"), F.col("norm_title")), 6)
    rated = with_lyrics_similarity(pairs.withColumn("title_similarity", ratio), catalog, incoming)
    rated = rated.withColumn("lyrics_similarity", F.round("lyrics_similarity", 6))
    return rated.where((F.col("title_similarity") >= title_at) | (F.col("lyrics_similarity") >= lyrics_at)).select(
        "incoming_id", "song_id", "track_name", "track_artist", "title_similarity", "lyrics_similarity"
    )
