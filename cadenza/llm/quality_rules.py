"""Quality rules: plain text measures and tokeniser fertility with rejection bands.

Fertility looks at a text through a public vocabulary: characters per token, the share of
byte-fallback tokens, and the entropy of the text's tokens. Bands are learnt per language
and length class (powers of two of the token count) from all distinct texts, with a bound on what one
source counts: a measure beyond the quartiles by ``FAR_OUT`` quartile ranges on its bad side
rejects. Classes with few documents take the band of neighbouring lengths, of their language
or of all.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.llm import arrow_text as at
from cadenza.llm.tables import settle

# The contract's base rule.
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW_WORDS = 5
SYMBOLS = b"#*$%&|<>"

#: Quartile ranges beyond a quartile at which a measure rejects.
FAR_OUT = 4.0
#: Documents a band needs, after each source is limited.
BAND_DOCUMENTS = 200
#: A source counts as one of so many parts of a band at most: less than a quarter, so it holds no quartile.
SOURCE_PARTS = 5
#: Length classes on each side that a wider band takes in.
NEIGHBOURS = 2
#: Shares in which a text of a source above its limit is counted.
SHARES = 1 << 16
#: Tokens from which a band has its plain width; the reach of shorter texts grows with their spread, 1 / sqrt(tokens).
PLAIN_TOKENS = 64
#: Byte tokens of two odd characters, which no text is rejected for.
ODD_TOKENS = 8
#: Smallest quartile range taken, so that uniform classes get no zero-width band.
LEAST_RANGE = {"chars_per_token": 0.1, "fallback_share": 0.01, "token_entropy": 0.1}

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
BOUNDS = ["least_chars", "most_chars", "most_fallback", "least_entropy", "most_entropy"]
FERTILITY = ["n_tokens", "chars_per_token", "fallback_share", "token_entropy"]


def per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many bytes of each row are flagged."""
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[offsets[1:]] - total[offsets[:-1]]


def text_counts(raw: np.ndarray, offsets: np.ndarray, words: at.Words | None = None) -> dict[str, np.ndarray]:
    """The five plain measures of each row of a slice; ``words`` are its words as they are."""
    words = at.words_of(raw, offsets, lower=False) if words is None else words
    rows = len(offsets) - 1
    in_word = ~words.space & ((raw & 0xC0) != 0x80)  # the first byte of every character
    hashes, first = at.window_hashes(words, WINDOW_WORDS)
    often, _ = at.repeats(hashes, words.rows[first])
    cover = np.bincount(first[often > 1], minlength=len(words.rows) + 1).astype(np.int64)
    covered = np.cumsum(cover)
    covered[WINDOW_WORDS:] -= np.cumsum(cover)[:-WINDOW_WORDS]
    repeated = covered[: len(words.rows)] > 0
    return {
        "n_words": words.per_row,
        "word_chars": per_row(in_word, offsets),
        "n_symbols": per_row(_SYMBOL[raw], offsets),
        "n_dup_lines": _duplicate_lines(raw, offsets, words, rows),
        "n_repeat_words": np.bincount(words.rows[repeated], minlength=rows),
    }


def _duplicate_lines(raw: np.ndarray, offsets: np.ndarray, words: at.Words, rows: int) -> np.ndarray:
    """Lines with a word that equal an earlier line of their row."""
    if not len(words.starts):
        return np.zeros(rows, np.int64)
    feeds = np.flatnonzero(raw == 10)
    starts = np.union1d(offsets[:-1], feeds + 1)
    starts = starts[starts < len(raw)]
    ends = np.append(starts[1:], len(raw))
    ends = ends - (raw[ends - 1] == 10)  # without its own line feed
    has_word = np.zeros(len(starts), bool)
    has_word[np.searchsorted(starts, words.starts, "right") - 1] = True
    starts, ends = starts[has_word], ends[has_word]
    of = np.searchsorted(offsets, starts, "right") - 1
    _, is_first = at.repeats(at.run_hashes(raw, starts, ends), of)
    return np.bincount(of[~is_first], minlength=rows)


@lru_cache(maxsize=2)
def piece_model(path: str) -> tuple[sentencepiece.SentencePieceProcessor, np.ndarray]:
    """The public vocabulary and a flag per id: is it a byte-fallback token."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return model, np.array([model.is_byte(i) for i in range(model.get_piece_size())])


def fertility(text: str, path: str) -> tuple[int, float | None, float | None, float | None]:
    """(tokens, characters per token, byte-fallback share, entropy in bits) of one text."""
    model, is_byte = piece_model(path)
    ids = np.array(model.encode(text, num_threads=1), np.int64)
    n = len(ids)
    if not n:
        return 0, None, None, None
    counts = np.bincount(ids, minlength=len(is_byte))
    present = counts[counts > 0]
    entropy = float(np.log2(n) - (present * np.log2(present)).sum() / n)
    return n, len(text) / n, float(counts[is_byte].sum() / n), entropy


def measure(docs: DataFrame, pieces_path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of every row, then its counts and fertility; null texts count as empty."""
    keep = docs.columns if keep is None else keep
    measures = [T.StructField(c, T.LongType()) for c in [*COUNTS, "n_tokens"]]
    measures += [T.StructField(c, T.DoubleType()) for c in FERTILITY[1:]]
    schema = T.StructType([*docs.select(*keep).schema.fields, *measures])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = at.column(batch, text)
            for start, end, raw, offsets in at.slices(batch, text):
                counts = text_counts(raw, offsets)
                seen = [fertility(t.as_py() or "", pieces_path) for t in texts[start:end]]
                part = batch.slice(start, end - start)
                arrays = [at.column(part, c) for c in keep]
                arrays += [pa.array(counts[c], pa.int64()) for c in COUNTS]
                kinds = [pa.int64(), pa.float64(), pa.float64(), pa.float64()]
                arrays += [pa.array(c, k) for c, k in zip(zip(*seen), kinds)]
                yield pa.RecordBatch.from_arrays(arrays, [*keep, *COUNTS, *FERTILITY])

    return docs.select(*keep, *([] if text in keep else [text])).mapInArrow(run, schema)


def learn_bands(measured: DataFrame, lang: str = "lang", source: str | None = None, name: str | None = None) -> DataFrame:
    """(band_lang, length_class) -> bounds, for every language and length class that has rows.

    Quartiles count each distinct text (``name`` tells equal ones) of a language once, and no
    source above one ``SOURCE_PARTS``-th of a band where it has that many sources: junk that
    one source or one text sends in masses reaches no quartile. A class with few documents
    or sources takes the band of its neighbours, then of two each side, then of its
    language, then of all.
    """
    told = measured.where(F.col("n_tokens") > 0).select(
        F.coalesce(F.col(lang), F.lit("?")).alias("lang"), _length_class().alias("length_class"),
        (F.coalesce(F.col(source).cast("string"), F.lit("?")) if source else F.lit("?")).alias("source"),
        *([F.col(name).alias("name")] if name else []),
        # Measures of three digits take some thousand values at most, so exact quartiles stay
        # small and come out alike however the rows are dealt.
        *[F.round(c, 3).alias(c) for c in LEAST_RANGE],
    )
    if name:
        same = [F.max(c).alias(c) for c in LEAST_RANGE]
        told = told.groupBy("lang", "length_class", "name").agg(F.min("source").alias("source"), *same)
    group = ["lang", "length_class", "source"]
    values = F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).alias("value")) for c in LEAST_RANGE])
    counted = settle(
        told.select(*group, F.inline(values)).groupBy(*group, "measure", "value").agg(F.count(F.lit(1)).alias("n")), "band-values"
    )
    # Wider bands hold the rows of several classes; the levels are tried in this order.
    near = [(level, step) for level in range(NEIGHBOURS + 1) for step in range(-level, level + 1)]
    wide = [_band(NEIGHBOURS + 1, F.col("lang"), F.lit(-1)), _band(NEIGHBOURS + 2, F.lit("*"), F.lit(-1))]
    bands = [_band(level, F.col("lang"), F.col("length_class") + step) for level, step in near]
    band = ["level", "band_lang", "band_class"]
    dealt = counted.select("source", "measure", "value", "n", F.inline(F.array(*bands, *wide)))
    # Every document has each measure once.
    one = F.col("measure") == next(iter(LEAST_RANGE))
    sources = settle(dealt.where(one).groupBy(*band, "source").agg(F.sum("n").alias("size")), "band-sources")
    limits = settle(_source_limits(sources, band), "band-limits")
    # A source of ``size`` texts counts as ``limit`` at most, in whole shares of a text.
    weight = F.greatest(F.lit(1), F.floor(F.least("size", "limit") * F.lit(SHARES) / F.col("size"))).cast("long")
    weights = settle(sources.join(limits, band).select(*band, "source", weight.alias("weight")), "band-weights")
    weighed = dealt.join(weights, [*band, "source"]).groupBy(*band, "measure", "value").agg(F.sum(F.col("n") * F.col("weight")).alias("weight"))
    quartiles = weighed.groupBy(*band).agg(
        *[F.percentile(F.when(F.col("measure") == c, F.col("value")), [0.25, 0.75], F.col("weight")).alias(c) for c in LEAST_RANGE]
    )

    # The widest band holds every text, so its sources are all there are.
    widest = limits.where(F.col("band_lang") == "*").select(F.least("sources", F.lit(SOURCE_PARTS)).alias("least_sources"))
    enough = (F.col("documents") >= BAND_DOCUMENTS) & (F.col("sources") >= F.col("least_sources")) | (F.col("band_lang") == "*")
    able = limits.crossJoin(F.broadcast(widest)).where(enough).select(*band)
    limited = settle(quartiles.join(able, band), "band-quartiles")
    # A few rows per language and length class from here on.
    classes = counted.select("lang", "length_class").distinct()
    asked = [_band(level, F.col("lang"), F.col("length_class")) for level in range(NEIGHBOURS + 1)]
    met = classes.select(F.col("lang").alias("_lang"), "length_class", F.inline(F.array(*asked, *wide))).join(limited, band)
    best = met.groupBy(F.col("_lang").alias("band_lang"), "length_class").agg(
        F.min_by(F.struct(*LEAST_RANGE), "level").alias("q")
    )
    # The shortest text of a class decides how far its measures may scatter.
    wider = F.greatest(F.lit(1.0), F.sqrt(PLAIN_TOKENS / F.pow(F.lit(2.0), F.col("length_class"))))

    def bound(name: str, side: int):
        low, high = F.col(f"q.{name}")[0], F.col(f"q.{name}")[1]
        reach = F.greatest(high - low, F.lit(LEAST_RANGE[name])) * FAR_OUT * wider
        return low - reach if side < 0 else high + reach

    return best.select(
        "band_lang", "length_class",
        bound("chars_per_token", -1).alias("least_chars"), bound("chars_per_token", 1).alias("most_chars"),
        bound("fallback_share", 1).alias("most_fallback"),
        bound("token_entropy", -1).alias("least_entropy"), bound("token_entropy", 1).alias("most_entropy"),
    )


def _band(level: int, lang: Column, length_class: Column) -> Column:
    return F.struct(F.lit(level).alias("level"), lang.alias("band_lang"), length_class.cast("int").alias("band_class"))


def _source_limits(sources: DataFrame, band: list[str]) -> DataFrame:
    """(band, limit, sources, documents): what one source may count, and what all then count.

    The limit is the largest size of a source at which it is no more than one
    ``SOURCE_PARTS``-th of the whole, or with fewer sources as near to equal parts.
    """
    # Sources of one size are one row, so a band has few rows here, however many its sources.
    sizes = sources.groupBy(*band, "size").agg(F.count(F.lit(1)).alias("k"))
    up_to = Window.partitionBy(*band).orderBy("size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = sizes.withColumns({
        "all": F.sum("k").over(Window.partitionBy(*band)),
        "below": F.sum("k").over(up_to), "inside": F.sum(F.col("k") * F.col("size")).over(up_to),
    })
    whole = summed.withColumn("whole", F.col("inside") + F.col("size") * (F.col("all") - F.col("below")))
    fits = F.col("size") * F.least("all", F.lit(SOURCE_PARTS)) <= F.col("whole")
    return whole.where(fits).groupBy(*band).agg(
        F.max("size").alias("limit"), F.max("all").alias("sources"), F.max("whole").alias("documents")
    )


def _length_class():
    return F.floor(F.log2("n_tokens")).cast("int")


def judge(measured: DataFrame, bands: DataFrame, lang: str = "lang") -> DataFrame:
    """Adds ``base_failed``, ``band_failed`` and ``kept`` to measured rows."""
    base_failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    )
    limits = bands.select(F.col("band_lang").alias("_band_lang"), F.col("length_class").alias("_band_class"), *[F.col(c).alias(f"_{c}") for c in BOUNDS])
    rows = measured.withColumns({"_lang": F.coalesce(F.col(lang), F.lit("?")), "_class": _length_class()})
    # A few rows per language and length class: read from a written table, so Spark knows the size.
    met = rows.join(limits, (F.col("_lang") == F.col("_band_lang")) & (F.col("_class") == F.col("_band_class")), "left")
    limit = {c: F.col(f"_{c}") for c in BOUNDS}
    outside = (
        (F.col("chars_per_token") < limit["least_chars"])
        | (F.col("chars_per_token") > limit["most_chars"])
        | (F.col("fallback_share") > limit["most_fallback"] + ODD_TOKENS / F.col("n_tokens"))
        | (F.col("token_entropy") < limit["least_entropy"])
        | (F.col("token_entropy") > limit["most_entropy"])
    )
    band_failed = F.coalesce((F.col("n_tokens") > 0) & outside, F.lit(False))
    return met.withColumns({"base_failed": base_failed, "band_failed": band_failed}).withColumn(
        "kept", ~F.col("base_failed") & ~F.col("band_failed")
    ).select(*measured.columns, "base_failed", "band_failed", "kept")


def quality_rules(docs: DataFrame, pieces_path: str, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """One row per document: key, lang, the counts, the fertility, base_failed, band_failed, kept.

    A null text counts as empty: no words, no tokens, base_failed. Texts of any length meet
    a band; that of short ones is wider. A null language is a language of its own; without a ``source`` column all texts are of one source. Repeated rows and
    keys are judged alike; an empty table gives no rows; other columns are ignored. Measures
    are written once; bands are learnt from all of them.
    """
    slim = docs.select(
        F.col(key).alias(key), F.col(lang).alias("lang"), F.col(text).alias("text"), _source(docs, source), F.xxhash64(text).alias("_name")
    )
    measured = settle(measure(slim, pieces_path, keep=[key, "lang", "_source", "_name"]), "measures")
    bands = settle(learn_bands(measured, source="_source", name="_name"), "bands")
    return judge(measured, bands).drop("_source", "_name")


def _source(docs: DataFrame, source: str):
    return (F.col(source).cast("string") if source in docs.columns else F.lit(None).cast("string")).alias("_source")


def keep_good(docs: DataFrame, pieces_path: str) -> DataFrame:
    """The documents that the rules keep, with their own columns.

    Verdicts are computed beside each row, so rows with equal or null keys stay apart.
    Input columns named like a measure are kept as they are.
    """
    others = F.struct(F.lit(0), *[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("_row")
    rows = docs.select(
        others, F.col("lang").alias("_in_lang"), F.col("text").alias("_body"), _source(docs, "source"), F.xxhash64("text").alias("_name")
    )
    measured = settle(measure(rows, pieces_path, text="_body", keep=rows.columns), "measured-docs")
    bands = settle(learn_bands(measured, lang="_in_lang", source="_source", name="_name"), "bands")
    judged = judge(measured, bands, lang="_in_lang")
    whole = [F.col("_body").alias(c) if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns]
    return judged.where("kept").select(*whole)
