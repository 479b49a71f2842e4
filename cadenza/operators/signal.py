"""Frame statistics of sampled signals kept as long tables (series, pos, value)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.functions.arrays import bind
from cadenza.functions.audio import normalise_ranges
from cadenza.functions.coerce import epoch_micros

# Frame and step in samples, silence level, roll-off share, smallest power.
FRAME = 2048
HOP = 512
SILENCE_DB = 60.0
ROLL_OFF = 0.85
TINY = 1e-10
BLOCK = 65_536


def positioned(events: DataFrame, key: str, ts: str, id_col: str, value: str) -> DataFrame:
    """(series, pos, value, n): rank in time order, value centred on the series mean.

    Ranks come in two steps, so a series with a third of all rows is never sorted in one
    task: counts and sums per minute give each minute its offset and the series its mean
    and length, and only a minute's rows are ordered together.
    """
    sliced = events.select(
        F.col(key).alias("series"), F.floor(epoch_micros(ts) / 60_000_000).alias("slice"), F.col(ts).alias("_ts"),
        F.col(id_col).alias("_id"), F.col(value).alias("_v"),
    )
    totals = sliced.groupBy("series", "slice").agg(F.count(F.lit(1)).alias("c"), F.sum("_v").alias("s"))
    whole = W.partitionBy("series")
    before = whole.orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        "series", "slice",
        F.coalesce(F.sum("c").over(before), F.lit(0)).alias("offset"),
        F.sum("c").over(whole).alias("n"),
        (F.sum("s").over(whole) / F.sum("c").over(whole)).alias("mean"),
    )
    inside = F.row_number().over(W.partitionBy("series", "slice").orderBy("_ts", "_id"))
    return (
        sliced.withColumn("i", inside)
        .join(offsets, ["series", "slice"])
        .select("series", (F.col("offset") + F.col("i") - 1).alias("pos"), (F.col("_v") - F.col("mean")).alias("value"), "n")
    )


def with_crossings(samples: DataFrame, block: int = BLOCK) -> DataFrame:
    """Adds ``crossing``: 1 where the sign differs from the previous sample's.

    A block's last sample is also sent to the next block, so neighbours always meet and
    no window spans a whole series.
    """
    last = F.col("pos") % block == block - 1
    own = F.floor(F.col("pos") / block)
    blocks = F.when(last, F.array(own, own + 1)).otherwise(F.array(own))
    spread = samples.withColumn("_block", F.explode(blocks))
    near = F.when(F.abs("value") <= TINY, F.lit(0.0)).otherwise(F.col("value"))
    negative = (near < 0).cast("int")
    order = W.partitionBy("series", "_block").orderBy("pos")
    marked = spread.withColumn("_neg", negative).withColumn("_prev", F.lag("_neg").over(order))
    crossing = F.when(F.col("_prev").isNotNull() & (F.col("_prev") != F.col("_neg")), 1).otherwise(0)
    return marked.withColumn("crossing", crossing).where(F.floor(F.col("pos") / block) == F.col("_block")).drop("_block", "_neg", "_prev")


def framed(samples: DataFrame, frame: int = FRAME, hop: int = HOP) -> DataFrame:
    """One row per (sample, frame that holds it); frame f is centred on sample f * hop."""
    half = frame // 2
    first = F.greatest(F.lit(0), F.ceil((F.col("pos") - half + 1) / hop))
    last = F.least(F.floor((F.col("pos") + half) / hop), F.floor(F.col("n") / hop))
    return samples.where(first <= last).withColumn("frame", F.explode(F.sequence(first, last))).withColumn(
        "at", F.col("pos") - (F.col("frame") * hop - half)
    )


def frame_levels(samples: DataFrame, frame: int = FRAME, hop: int = HOP) -> DataFrame:
    """RMS and zero-crossing rate per frame; frames reach past the ends as if padded."""
    rows = framed(with_crossings(samples), frame, hop)
    return rows.groupBy("series", "frame").agg(
        F.sqrt(F.sum(F.col("value") * F.col("value")) / frame).alias("rms"),
        # A crossing counts where both of its samples lie in the frame.
        (F.sum(F.when(F.col("at") > 0, F.col("crossing")).otherwise(0)) / frame).alias("zcr"),
    )


def fft(values: Column, n: int) -> Column:
    """The discrete Fourier transform of an array of ``n`` doubles, a power of two: ARRAY<STRUCT<re, im>>.

    Radix-2 butterflies inside the row: the values in bit-reversed order, then log2(n) steps
    that each combine pairs ``half`` apart.
    """
    bits = n.bit_length() - 1
    if n != 1 << bits:
        raise ValueError(f"{n} is not a power of two")
    order = _reversed_bits(n, bits)
    numbers = F.sequence(F.lit(0), F.lit(n - 1))
    state = bind(values, lambda v: F.transform(order, lambda i: F.struct(F.get(v, i).alias("re"), F.lit(0.0).alias("im"))))
    for step in range(bits):
        state = _combined(state, numbers, 1 << step)
    return state


def _combined(state: Column, numbers: Column, half: int) -> Column:
    return bind(state, lambda x: F.transform(numbers, lambda i: _butterfly(x, i, half)))


def _reversed_bits(n: int, bits: int) -> Column:
    """0..n-1 with their bits in reverse order, as an expression of fixed size."""

    def reverse(i: Column) -> Column:
        return sum((F.shiftright(i, b).bitwiseAND(1) * (1 << (bits - 1 - b)) for b in range(bits)), F.lit(0))

    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), reverse)


def _butterfly(x: Column, i: Column, half: int) -> Column:
    place = i % half
    upper = i % (2 * half) < half
    a, b = F.get(x, F.when(upper, i).otherwise(i - half)), F.get(x, F.when(upper, i + half).otherwise(i))
    turn = place * (-math.pi / half)
    re = b["re"] * F.cos(turn) - b["im"] * F.sin(turn)
    im = b["re"] * F.sin(turn) + b["im"] * F.cos(turn)
    sign = F.when(upper, 1.0).otherwise(-1.0)
    return F.struct((a["re"] + sign * re).alias("re"), (a["im"] + sign * im).alias("im"))


def frame_arrays(samples: DataFrame, frame: int = FRAME, hop: int = HOP) -> DataFrame:
    """(series, frame, values): the ``frame`` samples of every frame in order, 0.0 where none is.

    A frame's samples are the only ones that come together.
    """
    rows = framed(samples, frame, hop).groupBy("series", "frame").agg(F.sort_array(F.collect_list(F.struct("at", "value"))).alias("held"))
    first, last = F.element_at("held", 1)["at"], F.element_at("held", -1)["at"]
    nothing = F.lit(0.0)
    whole = F.concat(
        F.array_repeat(nothing, first.cast("int")), F.transform("held", lambda h: h["value"].cast("double")),
        F.array_repeat(nothing, (frame - 1 - last).cast("int")),
    )
    # Positions normally run without gaps; otherwise each sample is looked up.
    by_place = bind(
        F.map_from_entries(F.transform("held", lambda h: F.struct(h["at"].cast("int"), h["value"].cast("double")))),
        lambda m: F.transform(F.sequence(F.lit(0), F.lit(frame - 1)), lambda i: F.coalesce(F.element_at(m, i), nothing)),
    )
    gapless = last - first + 1 == F.size("held")
    return rows.select("series", "frame", F.when(gapless, whole).otherwise(by_place).alias("values"))


def spectral_frames(samples: DataFrame, sample_rate: float, frame: int = FRAME, hop: int = HOP) -> DataFrame:
    """Centroid, bandwidth, roll-off and flatness per frame, from a Hann window and a Fourier transform in the row.

    ``frame`` is a power of two. A series is spread over its frames, however long it is.
    """
    turn = 2 * math.pi / frame
    hann = F.transform("values", lambda v, i: v * (0.5 - 0.5 * F.cos(turn * i)))
    spectrum = F.slice(fft(hann, frame), 1, frame // 2 + 1)
    powers = F.transform(spectrum, lambda z: z["re"] * z["re"] + z["im"] * z["im"])
    sized = frame_arrays(samples, frame, hop).select("series", "frame", powers.alias("powers"))
    step = sample_rate / frame
    zero = F.lit(0.0)

    def total(part) -> Column:
        """The sum of ``part(size, hz)`` over all bins."""
        return F.aggregate(F.transform("sizes", lambda s, i: part(s, i * F.lit(step))), zero, lambda acc, v: acc + v)

    summed = sized.withColumn("sizes", F.transform("powers", F.sqrt)).select(
        "*", total(lambda s, hz: s).alias("total"), total(lambda s, hz: s * hz).alias("weighted")
    )
    centred = summed.withColumn("centroid", F.when(F.col("total") > 0, F.col("weighted") / F.col("total")).otherwise(zero))
    off = lambda hz: hz - F.col("centroid")
    spread = F.when(F.col("total") > 0, total(lambda s, hz: off(hz) * off(hz) * s / F.col("total"))).otherwise(zero)
    reached = F.aggregate(
        "sizes", F.struct(zero.alias("up_to"), F.lit(0).alias("bins")),
        lambda acc, s: F.struct(
            (acc["up_to"] + s).alias("up_to"),
            (acc["bins"] + F.when(acc["up_to"] + s < ROLL_OFF * F.col("total"), 1).otherwise(0)).alias("bins"),
        ),
        lambda acc: acc["bins"] * F.lit(step),
    )
    floored = F.transform("powers", lambda p: F.greatest(F.lit(TINY), p))
    mean = lambda values: F.aggregate(values, zero, lambda acc, v: acc + v) / F.lit(frame // 2 + 1)
    return centred.select(
        "series", "frame", "centroid", F.sqrt(spread).alias("bandwidth"), reached.alias("rolloff"),
        (F.exp(mean(F.transform(floored, F.ln))) / mean(floored)).alias("flatness"),
    )


def song_features(frames: DataFrame, sample_rate: float, tempo: Column, n_samples: Column) -> DataFrame:
    """Song features from frame means; ``frames`` has rms, zcr, centroid, flatness, contrast, mfcc.

    ``mfcc`` holds the coefficients 1..4 of the frame.
    """
    mfcc_size = F.aggregate(F.transform("mfcc", F.abs), F.lit(0.0), lambda acc, v: acc + v) / F.size("mfcc")
    means = frames.groupBy("series").agg(
        F.avg("rms").alias("rms"), F.avg("zcr").alias("zcr"), F.avg("centroid").alias("centroid"),
        F.avg("flatness").alias("flatness"), F.avg("contrast").alias("contrast"), F.avg(mfcc_size).alias("mfcc"),
        F.max(tempo).alias("tempo"), F.max(n_samples).alias("n"),
    )
    rms = F.col("rms")
    raw = means.select(
        "series",
        (F.col("contrast") * 0.5 + 0.5).alias("danceability"),
        (rms * 10).alias("energy"),
        F.lit(0).alias("key"),
        F.least(F.lit(0.0), -60 + rms * 100).alias("loudness"),
        F.lit(0).alias("mode"),
        (F.col("mfcc") * 0.3).alias("speechiness"),
        (1 - F.col("centroid") / (sample_rate / 2)).alias("acousticness"),
        (1 - F.least(F.lit(1.0), F.col("zcr") * 10)).alias("instrumentalness"),
        (F.col("flatness") * 5).alias("liveness"),
        F.when(rms > 0.1, F.least(F.lit(1.0), rms * 5)).otherwise(F.lit(0.5)).alias("valence"),
        F.col("tempo").cast("double").alias("tempo"),
        (F.col("n") / sample_rate * 1000).alias("duration_ms"),
    )
    return raw.withColumns(normalise_ranges(F.col))


def sounding_range(samples: DataFrame, top_db: float = SILENCE_DB, frame: int = FRAME, hop: int = HOP) -> DataFrame:
    """(series, start, end): from the first to the last frame within ``top_db`` of the loudest."""
    levels = framed(samples, frame, hop).groupBy("series", "frame").agg(
        (F.sum(F.col("value") * F.col("value")) / frame).alias("power"), F.max("n").alias("n")
    )
    peak = levels.groupBy("series").agg(F.max("power").alias("peak"), F.max("n").alias("n"))
    loud = levels.select("series", "frame", "power").join(peak, "series").where(
        10 * F.log10(F.greatest("power", F.lit(TINY))) - 10 * F.log10(F.greatest("peak", F.lit(TINY))) > -top_db
    )
    return loud.groupBy("series").agg(
        (F.min("frame") * hop).alias("start"), F.least(F.max("n"), (F.max("frame") + 1) * hop).alias("end")
    )


def trimmed(samples: DataFrame, top_db: float = SILENCE_DB, frame: int = FRAME, hop: int = HOP) -> DataFrame:
    """Samples without leading and trailing silence."""
    ranges = sounding_range(samples, top_db, frame, hop)
    return samples.join(ranges, "series").where((F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("end"))).drop("start", "end")
