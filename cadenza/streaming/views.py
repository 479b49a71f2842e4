"""Time-to-live views, continuous ingest, retention and progressive top-k."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from cadenza.operators.scoring import top_k
from cadenza.session import path_exists, work_path, write_and_read
from cadenza.sources import catalog as cat
from cadenza.sources.sinks import first_per_key
from cadenza.streaming.runs import run_batches

# Cache lifetimes and retention ages; storage ceiling in megabytes.
URL_DAYS = 7
STORAGE_CEILING_MB = 450.0
AUDIO_HOURS = 6
CACHE_HOURS = 24
SONG_DAYS = 30
RECOMMENDATION_DAYS = 7


def latest_entries(log: DataFrame, key: str, ts: str, id_col: str, columns: list[str]) -> DataFrame:
    """The newest log entry per key; the map side combines, so a hot key costs nothing."""
    newest = log.groupBy(key).agg(F.max_by(F.struct(ts, *columns), F.struct(ts, id_col)).alias("e"))
    return newest.select(key, f"e.{ts}", *[f"e.{c}" for c in columns])


def valid_entries(latest: DataFrame, ts: str, status: str, url: str, as_of: Column, days: int = URL_DAYS) -> DataFrame:
    """Entries that still answer: status valid, a url, not older than the lifetime."""
    fresh = F.col(ts) >= as_of - F.expr(f"INTERVAL {days} DAYS")
    return latest.where(fresh & (F.col(status) == "valid") & F.col(url).isNotNull())


class ExpiringValue(StatefulProcessor):
    """Per key the newest valid entry; an invalid one clears it, a timer ends its lifetime."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "at BIGINT, url STRING, live BOOLEAN")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        at, url, live = self.entry.get() if self.entry.exists() else (-1, None, False)
        for chunk in rows:
            row = chunk.loc[chunk["micros"].idxmax()]
            if row["micros"] > at:
                at, live = int(row["micros"]), row["status"] == "valid" and row["url"] is not None
                url = row["url"] if live else None
        self.entry.update((at, url, live))
        if live:
            self.handle.registerTimer(at // 1000 + self.ttl_ms)
        yield self._row(key, at, url)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.entry.exists():
            at, _, live = self.entry.get()
            # A newer entry has its own, later timer.
            if live and at // 1000 + self.ttl_ms <= expiredTimerInfo.getExpiryTimeInMs():
                self.entry.clear()
                yield self._row(key, at, None)

    @staticmethod
    def _row(key, at, url) -> pd.DataFrame:
        return pd.DataFrame({"entry_key": [key[0]], "micros": [at], "url": pd.Series([url], dtype="object")})

    def close(self) -> None:
        pass


def expiring_view(log: DataFrame, days: int = URL_DAYS, late: str | None = None) -> DataFrame:
    """Streaming twin of the two functions above: one row per change of a key.

    ``log`` has entry_key, ts (zoned), micros, url, status. The newest value wins whatever the
    order of arrival. Only rows older than a whole lifetime behind the newest one are left
    out: such an entry has expired before it arrives. ``late`` overrides that bound.
    """
    return log.withWatermark("ts", late or f"{days} days").groupBy("entry_key").transformWithStateInPandas(
        statefulProcessor=ExpiringValue(days * 86_400_000),
        outputStructType="entry_key BIGINT, micros BIGINT, url STRING", outputMode="Update", timeMode="EventTime",
    )


def current_view(changes: DataFrame, as_of_micros: Column, days: int = URL_DAYS) -> DataFrame:
    """Keys that still answer, from all published changes (entry_key, micros, url, update).

    The watermark trails the newest row by a lifetime, so what expired meanwhile is left out here.
    """
    order = F.struct(F.col("update"), F.col("url").isNull())
    newest = changes.groupBy("entry_key").agg(F.max_by(F.struct("micros", "url"), order).alias("e")).select("entry_key", "e.*")
    fresh = F.col("micros") >= as_of_micros - days * 86_400_000_000
    return newest.where(F.col("url").isNotNull() & fresh)


#: Hash buckets of the ingested keys; a batch reads those that its own keys fall into.
KEY_BUCKETS = 256


def ingest(
    stream: DataFrame, target_path: str, order: str, text_columns: list[str], key: list[str], buckets: int = KEY_BUCKETS
) -> None:
    """Clean arriving rows and append the new ones; each batch owns a folder it may rewrite.

    Beside the rows, a batch writes 128-bit names of its new keys by hash bucket. A later batch
    meets only the buckets of its own keys, and names instead of rows, so its work follows its
    own size. Rewriting the batch's own folders makes a repeated batch harmless.
    """
    spark = stream.sparkSession
    names = "high BIGINT, low BIGINT, batch INT, bucket INT"

    def handle(batch: DataFrame, number: int) -> None:
        clean = cat.trim_text(cat.drop_empty_fill_unknown(batch, text_columns), text_columns)
        marked = [c for k in key for c in (F.col(k).isNull(), F.col(k))]
        named = clean.withColumns({"_high": F.xxhash64(*marked), "_low": F.xxhash64(F.lit("low"), *marked)})
        asked = write_and_read(first_per_key(named, key, order).withColumn("_bucket", F.pmod("_high", F.lit(buckets)).cast("int")), "arrived")
        numbers = [r[0] for r in asked.select("_bucket").distinct().collect()]  # at most all buckets
        if path_exists(spark, f"{target_path}/keys"):
            # Earlier batches only, by partition: a repeated batch must not see its own first try.
            stored = spark.read.schema(names).parquet(f"{target_path}/keys")
            known = stored.where((F.col("batch") < number) & F.col("bucket").isin(numbers or [-1]))
            same = (F.col("_high") == F.col("high")) & (F.col("_low") == F.col("low"))
            asked = write_and_read(asked.join(known, same, "left_anti"), "new-rows")
        asked.drop("_high", "_low", "_bucket").write.mode("overwrite").parquet(f"{target_path}/rows/batch={number}")
        kept = asked.select(F.col("_high").alias("high"), F.col("_low").alias("low"), F.col("_bucket").alias("bucket"))
        kept.write.mode("overwrite").partitionBy("bucket").parquet(f"{target_path}/keys/batch={number}")

    run_batches(stream, "ingest", handle)


def ingested(spark: SparkSession, target_path: str, schema: T.StructType) -> DataFrame:
    """All rows that :func:`ingest` has taken in."""
    return spark.read.schema(schema).parquet(f"{target_path}/rows").drop("batch")


def retention_plan(
    songs: DataFrame, recommendations: DataFrame, as_of: Column, storage_mb: Column | float,
    ceiling_mb: float = STORAGE_CEILING_MB,
) -> DataFrame:
    """What a clean-up would drop: (kind, id, action).

    ``songs`` has song_id, last_accessed, is_original; ``recommendations`` has rec_id,
    song_id, created_at. Below the storage ceiling everything stays.
    """
    full = (storage_mb if isinstance(storage_mb, Column) else F.lit(storage_mb)) > ceiling_mb
    month = as_of - F.expr(f"INTERVAL {SONG_DAYS} DAYS")
    week = as_of - F.expr(f"INTERVAL {RECOMMENDATION_DAYS} DAYS")
    recent = recommendations.where((F.col("created_at") > month) & F.col("song_id").isNotNull())
    named = recent.select("song_id").distinct().withColumn("_recent", F.lit(True))
    stale = ~F.col("is_original") & ((F.col("last_accessed") < month) | F.col("_recent").isNull())
    song_rows = songs.join(named, "song_id", "left").select(
        F.lit("song").alias("kind"), F.col("song_id").alias("id"), (F.coalesce(stale, F.lit(False)) & full).alias("dropped")
    )
    rec_rows = recommendations.select(
        F.lit("recommendation").alias("kind"), F.col("rec_id").alias("id"), ((F.col("created_at") < week) & full).alias("dropped")
    )
    both = song_rows.unionByName(rec_rows)
    return both.select("kind", "id", F.when(F.col("dropped"), "drop").otherwise("keep").alias("action"))


def file_retention_plan(files: DataFrame, as_of: Column, storage_mb: Column | float, ceiling_mb: float = STORAGE_CEILING_MB) -> DataFrame:
    """(kind, path, action) of stored files; ``files`` has kind ('audio' or 'cache'), path, modified."""
    full = (storage_mb if isinstance(storage_mb, Column) else F.lit(storage_mb)) > ceiling_mb
    limit = F.when(F.col("kind") == "audio", as_of - F.expr(f"INTERVAL {AUDIO_HOURS} HOURS")).otherwise(
        as_of - F.expr(f"INTERVAL {CACHE_HOURS} HOURS")
    )
    return files.select("kind", "path", F.when((F.col("modified") < limit) & full, "drop").otherwise("keep").alias("action"))


def progressive_top_k(stream: DataFrame, score, keys: list[str], order: list[Column], k: int, label: str = "progressive") -> DataFrame:
    """Keep the best ``k`` per key while catalog files arrive; every batch publishes a version.

    ``score`` turns arriving rows into scored rows. A batch reads the previous version and
    writes its own, so repeating it gives the same result.
    """
    spark: SparkSession = stream.sparkSession
    root = work_path(spark, label)
    published: list[str] = []

    def handle(batch: DataFrame, number: int) -> None:
        best = top_k(score(batch), keys, order, k)
        previous = f"{root}/version={number - 1}"
        if number > 0 and path_exists(spark, previous):
            best = top_k(best.drop("rank").unionByName(spark.read.parquet(previous).drop("rank")), keys, order, k)
        best.write.mode("overwrite").parquet(f"{root}/version={number}")
        published.append(f"{root}/version={number}")

    run_batches(stream, label, handle)
    return spark.read.parquet(published[-1])
