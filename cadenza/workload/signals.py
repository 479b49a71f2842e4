"""Signal jobs: one series per user of the events."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.operators import signal as sg
from cadenza.sources.tables import table
from cadenza.workload.registry import query

FRAME, HOP, RATE = 16, 4, 64.0

SAMPLES_SQL = """samples AS (SELECT user_id AS series, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos,
  value - avg(value) OVER (PARTITION BY user_id) AS value, count(*) OVER (PARTITION BY user_id) AS n FROM events)"""


def frames_sql(hop):
    """All frame numbers of the longest series."""
    return f"(SELECT unnest(range(CAST((SELECT max(n) // {hop} + 1 FROM samples) AS BIGINT))) AS frame)"


FRAMED_SQL = f"""crossed AS (SELECT *, CASE WHEN pos > 0 AND (CASE WHEN abs(value) <= 1e-10 THEN 0 ELSE value END < 0) <> (CASE WHEN abs(lag(value) OVER w) <= 1e-10 THEN 0 ELSE lag(value) OVER w END < 0) THEN 1 ELSE 0 END AS crossing
  FROM samples WINDOW w AS (PARTITION BY series ORDER BY pos)),
framed AS (SELECT series, frame, pos, value, crossing, n FROM crossed JOIN {frames_sql(HOP)} ON frame <= n // {HOP} AND pos >= frame * {HOP} - {FRAME // 2} AND pos < frame * {HOP} + {FRAME // 2}),
levels AS (SELECT series, frame, sqrt(sum(value * value) / {FRAME}) AS rms, sum(CASE WHEN pos > frame * {HOP} - {FRAME // 2} THEN crossing ELSE 0 END) / {FRAME}::DOUBLE AS zcr, max(n) AS n FROM framed GROUP BY series, frame)"""


def samples(spark, sf):
    return sg.positioned(table(spark, sf, "events"), "user_id", "ts", "event_id", "value")


@query(
    "j4_frame_levels",
    f"WITH {SAMPLES_SQL}, {FRAMED_SQL} SELECT series, frame, round(rms, 6) AS rms, round(zcr, 6) AS zcr FROM levels",
)
def j4(spark, sf):
    levels = sg.frame_levels(samples(spark, sf), FRAME, HOP)
    return levels.select("series", "frame", F.round("rms", 6).alias("rms"), F.round("zcr", 6).alias("zcr"))


@query(
    "j5_spectral_frames",
    f"""WITH {SAMPLES_SQL}, fr AS (SELECT series, frame, pos - (frame * 16 - 32) AS k, value FROM samples JOIN {frames_sql(16)} ON frame <= n // 16 AND pos >= frame * 16 - 32 AND pos < frame * 16 + 32),
    b AS (SELECT series, frame, bin, value * (0.5::DOUBLE - 0.5::DOUBLE * cos(pi() / 32 * k)) AS v, pi() / 32 * ((bin * k) % 64) AS angle FROM fr, (SELECT unnest(range(33)) AS bin)),
    s AS (SELECT series, frame, bin * 1.0::DOUBLE AS hz, sum(v * cos(angle)) AS re, sum(v * sin(angle)) AS im FROM b GROUP BY series, frame, bin),
    z AS (SELECT series, frame, hz, sqrt(re * re + im * im) AS size, greatest(1e-10::DOUBLE, re * re + im * im) AS power FROM s),
    t AS (SELECT *, sum(size) OVER w AS total, sum(size) OVER (w ORDER BY hz ROWS UNBOUNDED PRECEDING) AS up_to, CASE WHEN sum(size) OVER w > 0 THEN sum(hz * size) OVER w / sum(size) OVER w ELSE 0 END AS centre
      FROM z WINDOW w AS (PARTITION BY series, frame))
    SELECT series, frame, round(max(centre), 4) AS centroid, round(sqrt(sum(CASE WHEN total > 0 THEN (hz - centre) * (hz - centre) * size / total ELSE 0 END)), 4) AS bandwidth,
    min(CASE WHEN up_to >= 0.85::DOUBLE * total THEN hz END) AS rolloff, round(exp(avg(ln(power))) / avg(power), 6) AS flatness FROM t GROUP BY series, frame""",
)
def j5(spark, sf):
    made = sg.spectral_frames(samples(spark, sf), RATE, 64, 16)
    return made.select(
        "series", "frame", F.round("centroid", 4).alias("centroid"), F.round("bandwidth", 4).alias("bandwidth"), "rolloff",
        F.round("flatness", 6).alias("flatness"),
    )


@query(
    "j6_song_features",
    f"""WITH {SAMPLES_SQL}, {FRAMED_SQL}, f AS (SELECT series, rms / 400 AS rms, zcr / 10 AS zcr, 8 * zcr AS centroid, rms / 1000 AS flatness, rms / 4 AS contrast, n FROM levels),
    m AS (SELECT series, avg(rms) AS rms, avg(zcr) AS zcr, avg(centroid) AS centroid, avg(flatness) AS flatness, avg(contrast) AS contrast, avg(rms * 100) AS mfcc, max(n) AS n FROM f GROUP BY series),
    r AS (SELECT series, contrast * 0.5::DOUBLE + 0.5::DOUBLE AS d, rms * 10 AS e, least(0, -60 + rms * 100) AS l, mfcc * 0.3::DOUBLE AS s, 1 - centroid / 32 AS acousticness, 1 - least(1, zcr * 10) AS instrumentalness,
      flatness * 5 AS liveness, CASE WHEN rms > 0.1 THEN least(1, rms * 5) ELSE 0.5 END AS v, n FROM m)
    SELECT series, round(CASE WHEN d > 1 THEN least(1, d / 26) ELSE d END, 6) AS danceability, round(CASE WHEN e > 1 THEN least(1, e / 10) ELSE e END, 6) AS energy, round(greatest(-60, l), 6) AS loudness,
    round(CASE WHEN s > 1 THEN least(0.95::DOUBLE, s / 30) ELSE s END, 6) AS speechiness, round(acousticness, 6) AS acousticness, round(instrumentalness, 6) AS instrumentalness, round(liveness, 6) AS liveness,
    round(v, 6) AS valence, 120.0::DOUBLE AS tempo, round(n / 64.0::DOUBLE * 1000, 6) AS duration_ms FROM r""",
)
def j6(spark, sf):
    points = samples(spark, sf)
    levels = sg.frame_levels(points, FRAME, HOP)
    lengths = points.groupBy("series").agg(F.max("n").alias("n"))
    frames = levels.join(lengths, "series").select(
        "series", (F.col("rms") / 400).alias("rms"), (F.col("zcr") / 10).alias("zcr"), (8 * F.col("zcr")).alias("centroid"),
        (F.col("rms") / 1000).alias("flatness"), (F.col("rms") / 4).alias("contrast"),
        F.array(*[F.col("rms") / 4 * sign for sign in (1, -1, 1, -1)]).alias("mfcc"), "n",
    )
    made = sg.song_features(frames, RATE, F.lit(120), F.col("n")).drop("key", "mode")
    return made.select("series", *[F.round(c, 6).alias(c) for c in made.columns if c != "series"])


@query(
    "j7_silence_trim",
    f"""WITH {SAMPLES_SQL}, framed AS (SELECT series, frame, value, n FROM samples JOIN {frames_sql(2)} ON frame <= n // 2 AND pos >= frame * 2 - 2 AND pos < frame * 2 + 2),
    p AS (SELECT series, frame, sum(value * value) / 4 AS power, max(n) AS n FROM framed GROUP BY series, frame), k AS (SELECT *, max(power) OVER (PARTITION BY series) AS peak FROM p),
    r AS (SELECT series, min(frame) * 2 AS lo, least(max(n), (max(frame) + 1) * 2) AS hi FROM k WHERE 10 * log10(greatest(power, 1e-10)) - 10 * log10(greatest(peak, 1e-10)) > -3 GROUP BY series)
    SELECT series, pos, round(value, 6) AS value FROM samples JOIN r USING (series) WHERE pos >= lo AND pos < hi""",
)
def j7(spark, sf):
    kept = sg.trimmed(samples(spark, sf), top_db=3.0, frame=4, hop=2)
    return kept.select("series", "pos", F.round("value", 6).alias("value"))
