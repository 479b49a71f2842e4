"""Request quotas over fixed and sliding windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.functions.coerce import epoch_micros
from cadenza.operators.scoring import top_k

# Requests per minute and client; hourly limits per operation.
PER_MINUTE = 60
WINDOW_SECONDS = 60
HOURLY = {"search": 300, "download": 50}


def window_number(ts: str, seconds: int) -> Column:
    return F.floor(epoch_micros(ts) / (seconds * 1_000_000))


def fixed_window_quota(requests: DataFrame, key: str, ts: str, id_col: str, limit: int = PER_MINUTE, seconds: int = WINDOW_SECONDS) -> DataFrame:
    """Every request with allowed, remaining and the reset time of its window.

    Only the first ``limit`` requests of a window need a rank. They are found by a
    limited rank and joined back by request id, so a client that sends a third of all
    requests is never ranked in one task. Request ids must be unique; one that repeats is an
    error, since the join would multiply its rows.
    """
    numbered = requests.withColumn("window_no", window_number(ts, seconds))
    first = top_k(numbered.select(key, "window_no", ts, id_col), [key, "window_no"], [F.asc(ts), F.asc(id_col)], limit, "nth")
    # At most ``limit`` rows per key and window, so an id that repeats shows here.
    twice = F.raise_error(F.concat(F.lit("request id repeats: "), F.col(id_col).cast("string")))
    ranked = first.groupBy(id_col).agg(F.max("nth").alias("nth"), F.count(F.lit(1)).alias("_n"))
    once = ranked.select(id_col, F.when(F.col("_n") == 1, F.col("nth")).otherwise(twice.cast("int")).alias("nth"))
    joined = numbered.join(once, id_col, "left")
    return joined.select(
        id_col, key,
        F.col("nth").isNotNull().alias("allowed"),
        F.coalesce(limit - F.col("nth"), F.lit(0)).alias("remaining"),
        ((F.col("window_no") + 1) * seconds).alias("reset"),
    )


def window_counts(
    requests: DataFrame, key: str, ts: str, seconds: int = WINDOW_SECONDS, late: str | None = None, limit: Column | int = PER_MINUTE,
    slide: int | None = None,
) -> DataFrame:
    """Streaming twin: requests, allowed and refused per key and window, for update mode.

    With ``slide`` seconds the windows overlap and stand for a sliding hour or day. Every row
    counts, in whatever order files come; the state holds one count per key and window, as
    the result does. Only a stated ``late`` drops rows that come later behind the newest one.
    """
    window = F.window(ts, f"{seconds} seconds", f"{slide or seconds} seconds")
    timely = requests.withWatermark(ts, late) if late else requests
    counted = timely.groupBy(window.alias("w"), F.col(key)).agg(F.count(F.lit(1)).alias("requests"))
    cap = limit if isinstance(limit, Column) else F.lit(limit)
    return counted.select(
        key, F.unix_seconds("w.start").alias("start"), "requests",
        F.least(F.col("requests"), cap).alias("allowed"),
        F.greatest(F.col("requests") - cap, F.lit(0)).alias("refused"),
    )


def hourly_limit(operation: Column, limits: dict[str, int] = HOURLY) -> Column:
    """The limit of an operation; unknown operations are refused."""
    cases = [F.when(operation == name, F.lit(n).cast("bigint")) for name, n in limits.items()]
    return F.coalesce(*cases, F.lit(0).cast("bigint"))
