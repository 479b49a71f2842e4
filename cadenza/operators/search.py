"""Filters, lookups and text search over the catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.functions import text as tx
from cadenza.operators.scoring import top_k
from cadenza.session import write_and_read

# Fuzzy-match floor and the relevance steps for title and artist hits.
FUZZY_FLOOR = 0.3
TITLE_STEPS = ((0.8, 3.0), (0.5, 2.0))
ARTIST_STEPS = ((0.8, 2.0), (0.5, 1.5))


def _like(text: str) -> str:
    """An ILIKE pattern for 'contains'; wildcards in the query keep their meaning."""
    return f"%{text}%"


def substring_search(
    catalog: DataFrame, text: str, artist: str | None = None, genre: str | None = None, limit: int = 20
) -> DataFrame:
    """Title or artist contains ``text``, optionally narrowed by artist and genre."""
    hits = catalog.where(F.ilike("track_name", F.lit(_like(text))) | F.ilike("track_artist", F.lit(_like(text))))
    if artist:
        hits = hits.where(F.ilike("track_artist", F.lit(_like(artist))))
    if genre:
        hits = hits.where(F.ilike("playlist_genre", F.lit(_like(genre))))
    return hits.orderBy("track_name", "song_id").limit(limit)


def filtered(
    catalog: DataFrame,
    text: str | None = None,
    artist: str | None = None,
    genre: str | None = None,
    with_sentiment: Column | None = None,
) -> DataFrame:
    """AND of the filters that are given; nothing given is an empty result."""
    conditions = [
        F.ilike(column, F.lit(_like(value)))
        for column, value in (("track_name", text), ("track_artist", artist), ("playlist_genre", genre))
        if value
    ]
    if with_sentiment is not None:
        conditions.append(with_sentiment.isNotNull())
    if not conditions:
        return catalog.limit(0)
    for condition in conditions:
        catalog = catalog.where(condition)
    return catalog


def relevance_steps(similarity: Column, steps: tuple[tuple[float, float], ...]) -> Column:
    (high, top), (mid, second) = steps
    return F.when(similarity >= high, F.lit(top)).when(similarity >= mid, F.lit(second)).otherwise(similarity)


def fuzzy_search(
    catalog: DataFrame, queries: list[dict[str, str]], title_col: str, artist_col: str, genre_col: str
) -> DataFrame:
    """Trigram search of a few requests in one scan.

    Each request may give ``title``, ``artist`` and ``genre``; a row matches when any given
    part does. Title relevance counts where a title was asked for, else artist relevance.
    """
    asked = F.array(
        *[
            F.struct(
                F.lit(i).alias("request"),
                *[F.lit(q.get(part)).cast("string").alias(part) for part in ("title", "artist", "genre")],
            )
            for i, q in enumerate(queries)
        ]
    )
    # A catalog row's trigrams are built once, below the explode over the requests.
    grams = catalog.withColumns({"_title_grams": tx.trigrams(F.col(title_col)), "_artist_grams": tx.trigrams(F.col(artist_col))})
    rows = grams.withColumn(
        "q",
        F.explode(
            F.transform(
                asked,
                lambda q: F.struct(
                    q["request"].alias("request"), q["title"].alias("title"), q["artist"].alias("artist"),
                    q["genre"].alias("genre"), tx.trigrams(q["title"]).alias("title_grams"),
                    tx.trigrams(q["artist"]).alias("artist_grams"),
                ),
            )
        ),
    )
    rows = rows.withColumns(
        {
            "title_sim": F.when(F.col("q.title").isNotNull(), tx.trigram_similarity(F.col("_title_grams"), F.col("q.title_grams"))),
            "artist_sim": F.when(F.col("q.artist").isNotNull(), tx.trigram_similarity(F.col("_artist_grams"), F.col("q.artist_grams"))),
        }
    )
    matches = rows.where(
        (F.col("title_sim") >= FUZZY_FLOOR)
        | (F.col("artist_sim") >= FUZZY_FLOOR)
        | (F.col(genre_col) == F.col("q.genre"))
    )
    relevance = F.when(F.col("q.title").isNotNull(), relevance_steps(F.col("title_sim"), TITLE_STEPS)).otherwise(
        relevance_steps(F.col("artist_sim"), ARTIST_STEPS)
    )
    return matches.select(F.col("q.request").alias("request"), *catalog.columns, relevance.alias("relevance"))


def fuzzy_page(matches: DataFrame, offset: int = 0, limit: int = 50, title_col: str = "track_name", id_col: str = "song_id") -> DataFrame:
    """One page of every request's matches: by relevance, unknown last, then title and id.

    A request by genre alone has no relevance and so comes in title order.
    """
    order = [F.desc_nulls_last("relevance"), F.asc(title_col), F.asc(id_col)]
    return top_k(matches, ["request"], order, offset + limit, "place").where(F.col("place") > offset)


def first_matches(catalog: DataFrame, requests: DataFrame, title_col: str, id_col: str, artist_col: str | None = None) -> DataFrame:
    """Per request the smallest id whose title (and artist) equals it, ignoring case.

    Only rows that bear a requested name take part in the grouping.
    """
    keys = [F.lower(title_col).alias("title_key")]
    if artist_col:
        keys.append(F.lower(artist_col).alias("artist_key"))
    names = ["title_key"] + (["artist_key"] if artist_col else [])
    asked = requests.withColumn("title_key", F.lower("title"))
    if artist_col:
        asked = asked.withColumn("artist_key", F.lower("artist"))
    asked = write_and_read(asked, "asked-names")
    named = catalog.select(*keys, id_col).join(asked.select(*names).distinct(), names, "left_semi")
    first = named.groupBy(*names).agg(F.min(id_col).alias(id_col))
    return asked.join(first, names).drop(*names)


def by_ids(catalog: DataFrame, requests: DataFrame, id_col: str) -> DataFrame:
    """Catalog rows of the requested ids; ids without a row stay away."""
    return catalog.join(requests.select(id_col).distinct(), id_col, "left_semi")


def in_ranges(catalog: DataFrame, **bounds: tuple[float | None, float | None]) -> DataFrame:
    """Rows whose features lie within closed bounds; an inverted range is an error."""
    for feature, (low, high) in bounds.items():
        if low is not None and high is not None and low > high:
            raise ValueError(f"{feature}: minimum {low} exceeds maximum {high}")
        if low is not None:
            catalog = catalog.where(F.col(feature) >= low)
        if high is not None:
            catalog = catalog.where(F.col(feature) <= high)
    return catalog


def excluding(catalog: DataFrame, excluded: DataFrame, id_col: str) -> DataFrame:
    return catalog.join(excluded.select(id_col).distinct(), id_col, "left_anti")


def page(df: DataFrame, order: list[Column | str], offset: int = 0, limit: int = 50) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


# Accepted link prefix, audio qualities and query lengths of a request.
LINK_PATTERN = r"^https?://(www\.)?(youtube\.com|youtu\.be)"
QUALITIES = ["64", "96", "128", "192", "256", "320"]
DEFAULT_QUALITY = "192"
LONGEST_QUERY = 200


def check_requests(
    requests: DataFrame, url: str, text: str, limit: str, quality: str | None = None, link_pattern: str = LINK_PATTERN
) -> DataFrame:
    """Each request with the reason it is refused; NULL where it is accepted.

    A missing quality is the default one.
    """
    size = F.coalesce(F.length(text), F.lit(0))
    reason = (
        F.when(~F.coalesce(F.col(url).rlike(link_pattern), F.lit(False)), "bad url")
        .when(size < 2, "text too short")
        .when(size > LONGEST_QUERY, "text too long")
        .when(~F.coalesce(F.col(limit).between(1, 100), F.lit(False)), "limit out of range")
    )
    if quality is not None:
        reason = reason.when(~F.coalesce(F.col(quality), F.lit(DEFAULT_QUALITY)).isin(QUALITIES), "bad quality")
    return requests.withColumn("refused", reason)
