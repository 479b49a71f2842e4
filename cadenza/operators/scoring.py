"""Seeds against the catalog: scoring, thresholds, refinement, top-k.

A request may hold any number of seed songs. They are written once as blocks of rows; every
catalog row meets every block by an equi-join on the block's number. A small request's blocks
are broadcast by Spark's own size threshold, so the catalog is scanned in place; a large
request is shuffled by block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.functions import audio, text as tx
from cadenza.functions.arrays import bind
from cadenza.session import write_and_read

# Seeds that travel in one row.
SEED_BLOCK = 64
SCORE_DIGITS = 6

# Similarity floors, early-scan factor and default leg weights.
MIN_AUDIO = 0.15
MIN_VIDEO_AUDIO = 0.12
MIN_LYRICS = 0.1
MIN_SENTIMENT = 0.1
MIN_COMBINED = 0.15
START_FACTOR = 0.8
DEFAULT_WEIGHTS = {"audio": 0.7, "lyrics": 0.2, "sentiment": 0.1}

# Fixed value: idf of a term that only one of two documents has, ln(3/2) + 1.
UNSHARED_IDF = 1.4054651081081644


def score_round(value: Column) -> Column:
    """Scores are kept to six digits, so at most 1e6 + 1 values exist in 0..1."""
    return F.round(value, SCORE_DIGITS)


def seed_blocks(seeds: DataFrame, size: int = SEED_BLOCK) -> tuple[DataFrame, int]:
    """The request as (block, seeds) rows of about ``size`` seeds, and the number of blocks."""
    written = write_and_read(seeds, "request")
    blocks = max(1, -(-written.count() // size))
    dealt = written.withColumn("block", F.pmod(F.xxhash64("seed_id"), F.lit(blocks)).cast("int"))
    gathered = dealt.groupBy("block").agg(F.collect_list(F.struct(*seeds.columns)).alias("seeds"))
    return write_and_read(gathered, "seed-blocks"), blocks


def against_seeds(catalog: DataFrame, seeds: DataFrame, exclude_self: bool = True) -> DataFrame:
    """Every catalog row beside every seed of the request, as column ``seed``."""
    gathered, blocks = seed_blocks(seeds)
    numbers = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    met = catalog.withColumn("block", numbers).join(gathered, "block").drop("block")
    pairs = met.withColumn("seed", F.explode("seeds")).drop("seeds")
    return pairs.where(F.col("song_id") != F.col("seed.seed_id")) if exclude_self else pairs


def as_seeds(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(F.col("song_id").alias("seed_id"), *columns)


def audio_pairs(catalog: DataFrame, seeds: DataFrame, exclude_self: bool = True) -> DataFrame:
    """Pairs ready for :func:`audio_score`: features cleaned, tempo gap at hand."""
    pairs = against_seeds(audio.clean_features(catalog), audio.clean_features(seeds), exclude_self)
    return pairs.withColumn("tempo_gap", audio.tempo_gap(F.col("seed.tempo"), F.col("tempo")))


def audio_score(weights: dict[str, float] = audio.STANDARD_WEIGHTS) -> Column:
    return audio.complete_similarity(lambda n: F.col(f"seed.{n}"), F.col, F.col("tempo_gap"), weights)


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per key; Spark limits every partition before the shuffle."""
    window = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def term_counts_of(text: Column, cleaned: bool = True) -> Column:
    """STRUCT<terms, terms_sq>: a map from a term's 64-bit hash to its count, and the sum of the squared counts.

    Counted inside each row, so no text is shuffled; the tokens are cut once for both.
    """
    hashes = F.transform(tx.similarity_tokens(text, cleaned), lambda t: F.xxhash64(t))

    def both(counted: Column) -> Column:
        total = F.aggregate(counted, F.lit(0).cast("bigint"), lambda acc, t: acc + t["tf"] * t["tf"])
        return F.struct(F.map_from_entries(counted).alias("terms"), total.alias("terms_sq"))

    return bind(tx.run_lengths(hashes), both)


def with_terms(docs: DataFrame, text_col: str, cleaned: bool = True) -> DataFrame:
    """The rows with their term counts, as columns ``terms`` and ``terms_sq``."""
    counted = docs.withColumn("_counts", term_counts_of(F.col(text_col), cleaned))
    return counted.withColumns({"terms": F.col("_counts.terms"), "terms_sq": F.col("_counts.terms_sq")}).drop("_counts")


def lyrics_cosine(a: str = "seed.", b: str = "") -> Column:
    """TF-IDF cosine of a pair of term columns, corpus = the pair; 0 without a shared term.

    The two maps are merged by hash inside the row, one step a term; the unshared part
    follows from the totals.
    """
    zero = F.lit(0).cast("bigint")
    merged = F.map_zip_with(
        f"{a}terms", f"{b}terms",
        lambda _, x, y: F.when(x.isNotNull() & y.isNotNull(), F.struct((x * y).alias("d"), (x * x).alias("p"), (y * y).alias("q"))),
    )
    cosine = F.aggregate(
        F.filter(F.map_values(merged), lambda v: v.isNotNull()),
        F.struct(zero.alias("d"), zero.alias("p"), zero.alias("q")),
        lambda acc, v: F.struct((acc["d"] + v["d"]).alias("d"), (acc["p"] + v["p"]).alias("p"), (acc["q"] + v["q"]).alias("q")),
        lambda acc: F.when(
            acc["d"] > 0, pair_cosine(acc["d"], acc["p"], F.col(f"{a}terms_sq"), acc["q"], F.col(f"{b}terms_sq"))
        ).otherwise(F.lit(0.0)),
    )
    return F.coalesce(cosine, F.lit(0.0))


def exploded_terms(value: str) -> list[Column]:
    """One row per term: its hash as ``term`` and its count under the given name."""
    # Not the bare column: Spark would compute it once more to test it for emptiness.
    return [F.inline(F.transform(F.map_entries("terms"), lambda e: F.struct(e["key"].alias("term"), e["value"].alias(value))))]


def lyrics_by_terms(catalog: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed_id, song_id, lyrics_raw) of every pair that shares a term, by a join on the term.

    For requests that score by lyrics alone: only the seeds' terms of the catalog meet
    anything, and the sums of a pair combine before their shuffle.
    """
    asked = seeds.select("seed_id", F.col("terms_sq").alias("seed_sq"), *exploded_terms("x"))
    postings = write_and_read(
        asked.groupBy("term").agg(F.collect_list(F.struct("seed_id", "seed_sq", "x")).alias("asked")), "seed-postings"
    )
    own = catalog.select("song_id", "terms_sq", *exploded_terms("y"))
    met = own.join(postings, "term").select("song_id", "terms_sq", "y", F.explode("asked").alias("seed"))
    x, y = F.col("seed.x"), F.col("y")
    sums = met.groupBy("seed.seed_id", "song_id").agg(
        F.sum(x * y).alias("d"), F.sum(x * x).alias("p"), F.sum(y * y).alias("q"),
        F.max("seed.seed_sq").alias("seed_sq"), F.max("terms_sq").alias("terms_sq"),
    )
    return sums.select(
        "seed_id", "song_id",
        pair_cosine(F.col("d"), F.col("p"), F.col("seed_sq"), F.col("q"), F.col("terms_sq")).alias("lyrics_raw"),
    )


def pair_cosine(dot: Column, s11: Column, t11: Column, s22: Column, t22: Column) -> Column:
    """Two-document TF-IDF cosine from shared and total squared counts."""
    c2 = F.lit(UNSHARED_IDF * UNSHARED_IDF)
    return dot / (F.sqrt(s11 + c2 * (t11 - s11)) * F.sqrt(s22 + c2 * (t22 - s22)))


def score_profile(scored: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Exact n, median and population std of score columns, one row per key.

    Equal scores are counted first. Scores have six digits, so a key keeps at most
    about a million distinct values however many rows it has.
    """
    stacked = scored.select(
        *keys, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("score")) for m in metrics])).alias("m")
    ).select(*keys, "m.metric", "m.score")
    counted = stacked.groupBy(*keys, "metric", "score").agg(F.count(F.lit(1)).alias("n"))
    weight, value = F.col("n"), F.col("score")
    mean = F.sum(weight * value) / F.sum(weight)
    per_metric = counted.groupBy(*keys, "metric").agg(
        F.sum("n").alias("n"),
        F.percentile("score", 0.5, F.col("n")).alias("median"),
        F.sqrt(F.greatest(F.lit(0.0), F.sum(weight * value * value) / F.sum(weight) - mean * mean)).alias("std"),
        mean.alias("mean"),
    )
    aggs = [F.max("n").alias("n")]
    for m in metrics:
        for what in ("median", "std", "mean"):
            aggs.append(F.max(F.when(F.col("metric") == m, F.col(what))).alias(f"{m}_{what}"))
    return per_metric.groupBy(*keys).agg(*aggs)


def refine_and_rank(
    scored: DataFrame,
    keys: list[str],
    k: int,
    audio_floor: float | Column = MIN_AUDIO,
    combined_floor: float | Column = MIN_COMBINED,
    candidate_factor: int = 3,
    with_std: bool = True,
    min_kept: int | None = None,
    written: bool = False,
) -> DataFrame:
    """Stricter cut when a key has many candidates, then its top ``k`` by ``combined``.

    The statistics and the ranking both read ``scored``; unless it is ``written`` already,
    it is written first and every pair is scored once.

    With more than ``candidate_factor * k`` candidates only rows at or above
    max(floor, 0.85 median, median - std) stay, unless too few would remain. Whether
    enough remain shows in the best few rows of each kind, so no key is ever counted
    in one task.
    """
    needed = max(k, 3) if min_kept is None else min_kept
    if not written:
        scored = write_and_read(scored, "scored")
    profile = score_profile(scored, keys, ["audio", "combined"])

    def cut(metric: str) -> Column:
        median, std = F.col(f"{metric}_median"), F.col(f"{metric}_std")
        return F.greatest(median * 0.85, median - std) if with_std else median * 0.85

    # One row per seed (and level), written so that Spark knows its size.
    cuts = write_and_read(
        profile.select(
            *keys,
            (F.col("n") > candidate_factor * k).alias("many"),
            cut("audio").alias("audio_cut"),
            cut("combined").alias("combined_cut"),
        ),
        "cuts",
    )
    a_floor = audio_floor if isinstance(audio_floor, Column) else F.lit(audio_floor)
    c_floor = combined_floor if isinstance(combined_floor, Column) else F.lit(combined_floor)
    flagged = scored.join(cuts, keys).withColumn(
        "kept",
        ~F.col("many")
        | (
            (F.col("audio") >= F.greatest(a_floor, F.col("audio_cut")))
            & (F.col("combined") >= F.greatest(c_floor, F.col("combined_cut")))
        ),
    )
    order = [F.desc("combined"), F.asc("song_id")]
    best = top_k(flagged, [*keys, "kept"], order, max(needed, k), "kind_rank")
    # At most 2 * max(needed, k) rows per key are left here.
    kept_count = F.count(F.when(F.col("kept"), 1)).over(W.partitionBy(*keys))
    usable = best.withColumn("n_kept", kept_count).where(
        F.col("kept") | (F.col("many") & (F.col("n_kept") < needed))
    )
    ranked = top_k(usable, keys, order, k)
    return ranked.drop("many", "audio_cut", "combined_cut", "kept", "kind_rank", "n_kept")
