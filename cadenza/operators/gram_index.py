"""Inverted indexes over character grams: fuzzy and substring search for any number of requests.

An index holds the distinct values of a column once each, a posting per (gram, value) and how
many values have each gram. Requests are a table. A request's values meet the postings of
their rarest grams only, and what the grams leave over is confirmed on the values themselves,
so no request is compared with the whole catalog.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.functions import text as tx
from cadenza.operators.search import ARTIST_STEPS, FUZZY_FLOOR, TITLE_STEPS, relevance_steps
from cadenza.session import work_path, write_and_read

#: Longest raw gram; shorter texts are looked up by grams of their own length.
RAW_GRAM = 3
#: Postings lie in files by hash bucket of their gram.
BUCKETS = 64


def raw_grams(text: Column, size: Column | int) -> Column:
    """The distinct substrings of a text of one length; the empty text for length 0."""
    size = F.lit(size) if isinstance(size, int) else size
    starts = F.sequence(F.lit(1), F.length(text) - size + 1)
    cut = F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, size)))
    empty = F.array().cast("array<string>")
    return F.when(size == 0, F.array(F.lit(""))).when(F.length(text) >= size, cut).otherwise(empty)


def all_raw_grams(text: Column) -> Column:
    """The distinct substrings of lengths 0 to ``RAW_GRAM``: linear in the text's length."""
    return F.concat(*(raw_grams(text, q) for q in range(RAW_GRAM + 1)))


@dataclass
class GramIndex:
    """Written tables: values (value, grams, size), postings (gram, value, place, size), counts (gram, often).

    ``place`` numbers a value's grams from the rarest on.
    """

    spark: SparkSession
    path: str
    raw: bool

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")


def build_index(values: DataFrame, column: str, raw: bool = False, label: str = "grams") -> GramIndex:
    """Indexes the distinct lower-cased values of a column: word trigrams, or raw grams for substrings."""
    spark = values.sparkSession
    path = work_path(spark, label)
    lowered = values.select(F.lower(column).alias("value")).where(F.col("value").isNotNull()).distinct()
    grams = all_raw_grams(F.col("value")) if raw else tx.trigrams(F.col("value"))
    lowered.select("value", grams.alias("grams")).withColumn("size", F.size("grams")).write.parquet(f"{path}/values")
    index = GramIndex(spark, path, raw)
    each = index.table("values").select("value", "size", F.explode("grams").alias("gram"))
    each.groupBy("gram").agg(F.count(F.lit(1)).alias("often")).write.parquet(f"{path}/counts")
    order = W.partitionBy("value").orderBy("often", "gram")  # the grams of one value
    placed = each.join(index.table("counts"), "gram").withColumn("place", F.row_number().over(order) - 1)
    bucket = F.pmod(F.xxhash64("gram"), F.lit(BUCKETS)).cast("int")
    posted = placed.select("gram", "value", "place", "size", bucket.alias("bucket"))
    posted.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{path}/postings")
    return index


def _met(index: GramIndex, asked: DataFrame) -> DataFrame:
    """Postings of the asked grams; ``asked`` has gram, and its buckets are the only ones read."""
    marked = write_and_read(asked.withColumn("bucket", F.pmod(F.xxhash64("gram"), F.lit(BUCKETS)).cast("int")), "asked-grams")
    buckets = sorted(r[0] for r in marked.select("bucket").distinct().collect())  # at most BUCKETS
    postings = index.table("postings").where(F.col("bucket").isin(buckets or [-1]))
    return postings.join(marked, ["bucket", "gram"]).drop("bucket", "gram")


def prefix_size(size: Column, floor: float) -> Column:
    """How many of the rarest grams must be looked at: a partner misses at most the others."""
    return size - F.ceil(size * F.lit(floor) - 1e-9) + 1


def similar_values(index: GramIndex, wanted: DataFrame, floor: float = FUZZY_FLOOR) -> DataFrame:
    """(wanted, value, similarity) with a trigram similarity of at least ``floor``; ``wanted`` is a column of texts.

    Two gram sets that share ``floor`` of their union share one of the rarest grams of both, and
    neither has less than ``floor`` of the other's size. Candidates that pass are compared whole.
    """
    texts = wanted.select(F.lower("wanted").alias("wanted")).where(F.col("wanted").isNotNull()).distinct()
    cut = write_and_read(texts.withColumn("own", tx.trigrams(F.col("wanted"))), "wanted-texts")
    each = cut.select("wanted", F.size("own").alias("own_size"), F.explode("own").alias("gram"))
    known = each.join(index.table("counts"), "gram", "left")
    order = W.partitionBy("wanted").orderBy(F.coalesce("often", F.lit(0)), "gram")
    first = known.withColumn("own_place", F.row_number().over(order) - 1).where(
        (F.col("own_place") < prefix_size(F.col("own_size"), floor)) & F.col("often").isNotNull()
    )
    met = _met(index, first.select("wanted", "own_size", "gram"))
    near = met.where(
        (F.col("place") < prefix_size(F.col("size"), floor))
        & (F.col("size") >= F.floor(floor * F.col("own_size"))) & (floor * F.col("size") <= F.col("own_size") + 1)
    )
    candidates = write_and_read(near.select("wanted", "value").distinct(), "gram-candidates")
    whole = candidates.join(index.table("values"), "value").join(cut, "wanted")
    scored = whole.select("wanted", "value", tx.trigram_similarity(F.col("grams"), F.col("own")).alias("similarity"))
    return scored.where(F.col("similarity") >= floor)


def containing_values(index: GramIndex, wanted: DataFrame) -> DataFrame:
    """(wanted, value): the indexed values that contain a wanted text, case aside; by its rarest gram."""
    if not index.raw:
        raise ValueError("substrings need an index of raw grams")
    texts = wanted.select(F.lower("wanted").alias("wanted")).where(F.col("wanted").isNotNull()).distinct()
    size = F.least(F.lit(RAW_GRAM), F.length("wanted"))
    each = texts.select("wanted", F.explode(raw_grams(F.col("wanted"), size)).alias("gram"))
    # A gram that no value has leaves the text without a hit.
    known = each.join(index.table("counts"), "gram", "left")
    rarest = known.groupBy("wanted").agg(F.min(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "gram")).alias("r"))
    met = _met(index, rarest.where(F.col("r.often") > 0).select("wanted", F.col("r.gram").alias("gram")))
    return met.where(F.contains("value", "wanted")).select("wanted", "value")


def containing_texts(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(wanted, value) as :func:`containing_values` gives it, for texts that are met once and not kept in an index.

    ``texts`` has lower-cased ``value``s and ``wanted`` lower-cased texts, both distinct.
    """
    size = F.least(F.lit(RAW_GRAM), F.length("wanted"))
    each = write_and_read(wanted.select("wanted", F.explode(raw_grams(F.col("wanted"), size)).alias("gram")), "wanted-grams")
    offered = texts.select("value", F.explode(all_raw_grams(F.col("value"))).alias("gram"))
    met = offered.join(each.select("gram").distinct(), "gram", "left_semi")
    often = met.groupBy("gram").agg(F.count(F.lit(1)).alias("often"))
    known = each.join(often, "gram", "left")
    rarest = known.groupBy("wanted").agg(F.min(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "gram")).alias("r"))
    posted = write_and_read(rarest.where(F.col("r.often") > 0).select("wanted", F.col("r.gram").alias("gram")), "posted")
    return offered.join(posted, "gram").where(F.contains("value", "wanted")).select("wanted", "value")


def search_many(
    catalog: DataFrame, requests: DataFrame, titles: GramIndex, artists: GramIndex,
    title_col: str = "track_name", artist_col: str = "track_artist", genre_col: str = "playlist_genre", id_col: str = "song_id",
) -> DataFrame:
    """Fuzzy search of a request table (request, title, artist, genre): request, the catalog's columns, relevance.

    A row matches when any given part does; relevance is the title's similarity in steps
    where a title was asked for, else the artist's. A request of one text takes the
    similarity of the value it met: hits are neither compared again nor shuffled.
    """
    asked = write_and_read(requests.select("request", "title", "artist", "genre").where("request IS NOT NULL"), "requests")
    parts = sum((F.col(c).isNotNull().cast("int") for c in ("title", "artist", "genre")), F.lit(0))
    alone = (parts == 1) & F.col("genre").isNull()

    def named(index: GramIndex, part: str, some: DataFrame) -> DataFrame:
        near = similar_values(index, some.select(F.col(part).alias("wanted")))
        return some.select("request", F.lower(part).alias("wanted")).join(near, "wanted").select("request", "value", "similarity")

    def direct(index: GramIndex, part: str, column: str, steps: tuple[tuple[float, float], ...]) -> DataFrame:
        met = named(index, part, asked.where(alone & F.col(part).isNotNull()))
        step = relevance_steps(F.col("similarity"), steps)
        # A row per value, written so that Spark knows its size; a request's values follow its hits.
        by_value = met.groupBy("value").agg(F.collect_list(F.struct("request", step.alias("relevance"))).alias("_hits"))
        known = write_and_read(by_value, "value-hits").withColumnRenamed("value", "_value")
        rows = catalog.where(F.col(id_col).isNotNull()).withColumn("_value", F.lower(column)).join(known, "_value")
        return rows.select(*catalog.columns, F.inline("_hits")).select("request", *catalog.columns, "relevance")

    out = direct(titles, "title", title_col, TITLE_STEPS).unionByName(direct(artists, "artist", artist_col, ARTIST_STEPS))
    mixed = asked.where((parts > 0) & ~alone)
    if mixed.isEmpty():
        return out

    def hits(index: GramIndex, part: str, column: str) -> DataFrame:
        near = named(index, part, mixed).drop("similarity")
        return catalog.select(id_col, F.lower(column).alias("value")).join(near, "value").select("request", id_col)

    by_genre = catalog.select(id_col, F.col(genre_col).alias("genre")).join(mixed.select("request", "genre"), "genre")
    met = hits(titles, "title", title_col).unionByName(hits(artists, "artist", artist_col)).unionByName(
        by_genre.select("request", id_col)
    )
    pairs = write_and_read(met.distinct(), "request-hits")
    rows = catalog.join(pairs, id_col).join(mixed.select("request", "title", "artist"), "request")
    similarity = lambda column, part: tx.trigram_similarity(tx.trigrams(F.col(column)), tx.trigrams(F.col(part)))
    relevance = F.when(F.col("title").isNotNull(), relevance_steps(similarity(title_col, "title"), TITLE_STEPS)).when(
        F.col("artist").isNotNull(), relevance_steps(similarity(artist_col, "artist"), ARTIST_STEPS)
    )
    return out.unionByName(rows.select("request", *catalog.columns, relevance.alias("relevance")))


def substring_many(catalog: DataFrame, requests: DataFrame, index: GramIndex, column: str) -> DataFrame:
    """The catalog rows whose ``column`` contains a request's ``text``, case aside, with the request."""
    asked = write_and_read(requests.select("request", F.lower("text").alias("wanted")), "requests")
    found = write_and_read(containing_values(index, asked), "containing-values")
    named = catalog.withColumn("_value", F.lower(column)).join(found.withColumnRenamed("value", "_value"), "_value")
    return named.join(asked, "wanted").drop("_value", "wanted")
