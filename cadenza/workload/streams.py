"""Quotas, time-to-live views, ingest, retention and progressive results."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.functions.coerce import epoch_micros
from cadenza.operators import scoring as sc
from cadenza.session import work_path, write_and_read
from cadenza.sources import catalog as cat
from cadenza.sources.tables import AUDIO_KEYS, songs, table
from cadenza.streaming import quota, runs, views
from cadenza.workload import sqlparts as sp
from cadenza.workload.inputs import genre_leads
from cadenza.workload.registry import query
from cadenza.workload.similarity import audio_sql

DAY = 86_400
AS_OF = "2024-01-31 00:00:00"


def as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


@query(
    "t1_fixed_window_quota",
    f"""WITH n AS (SELECT event_id, event_type, epoch_us(ts) // ({DAY}::BIGINT * 1000000) AS w, row_number() OVER (PARTITION BY event_type, epoch_us(ts) // ({DAY}::BIGINT * 1000000) ORDER BY ts, event_id) AS nth FROM events)
    SELECT event_id, event_type, nth <= 60 AS allowed, greatest(0, 60 - nth)::INTEGER AS remaining, ((w + 1) * {DAY})::BIGINT AS reset FROM n""",
)
def t1(spark, sf):
    return quota.fixed_window_quota(table(spark, sf, "events"), "event_type", "ts", "event_id", 60, DAY)


def table_stream(spark, sf, name, files_per_trigger=100):
    # A table is a file or a folder of parts; a pattern may name either, a plain path only a folder.
    return runs.read_files(spark, f"{sf}/{name}.parque[t]", table(spark, sf, name).schema, files_per_trigger=files_per_trigger)


def event_stream(spark, sf, files_per_trigger=100):
    return table_stream(spark, sf, "events", files_per_trigger)


def published_counts(counts, label, key):
    """The last count that update mode published for every key and window."""
    spark = counts.sparkSession
    path = work_path(spark, label)
    runs.run_batches(counts, label, lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/update={number}"), mode="update")
    published = spark.read.parquet(path)
    values = F.struct("requests", "allowed", "refused")
    return published.groupBy(key, "start").agg(F.max_by(values, "update").alias("v")).select(key, "start", "v.*")


@query(
    "t1_window_counts_stream",
    f"""SELECT event_type, epoch_us(ts) // ({DAY}::BIGINT * 1000000) * {DAY} AS start, count(*) AS requests, least(count(*), 60) AS allowed, greatest(count(*) - 60, 0) AS refused
    FROM events GROUP BY ALL""",
)
def t1_stream(spark, sf):
    # Windows are cut in a zoned timestamp.
    stream = event_stream(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    return published_counts(quota.window_counts(stream, "event_type", "ts", DAY, limit=60), "window-counts", "event_type")


LIMITS = {"click": 200, "view": 300, "purchase": 100, "error": 4}
LIMIT_SQL = " ".join(f"WHEN '{name}' THEN {n}" for name, n in (("click", 200), ("view", 300), ("purchase", 100), ("error", 4)))


@query(
    "t2_sliding_window_stream",
    f"""WITH w AS (SELECT event_type AS operation, (epoch_us(ts) // 21600000000 - unnest(range(4))) * 21600 AS start FROM events), n AS (SELECT operation, start, count(*) AS requests FROM w GROUP BY ALL),
    l AS (SELECT *, CASE operation {LIMIT_SQL} ELSE 0 END AS most FROM n) SELECT operation, start, requests, least(requests, most) AS allowed, greatest(requests - most, 0) AS refused FROM l""",
)
def t2(spark, sf):
    # A day's quota, renewed every six hours; signups have none and are refused.
    requests = event_stream(spark, sf).select(F.col("event_type").alias("operation"), F.col("ts").cast("timestamp").alias("ts"))
    limit = quota.hourly_limit(F.col("operation"), LIMITS)
    return published_counts(quota.window_counts(requests, "operation", "ts", DAY, limit=limit, slide=21_600), "sliding-counts", "operation")


@query(
    "t3_ttl_view",
    f"""WITH l AS (SELECT user_id, arg_max(ts, (ts, event_id)) AS ts, arg_max(CASE WHEN event_type = 'error' THEN 'invalid' ELSE 'valid' END, (ts, event_id)) AS status,
      arg_max(CASE WHEN event_type = 'signup' THEN NULL ELSE event_id END, (ts, event_id)) AS eid FROM events GROUP BY user_id)
    SELECT x.user_id, e.ts, e.props AS url, CAST(json_extract_string(e.props, '$.k') AS BIGINT) AS k FROM
      (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) x JOIN events e USING (event_id)
    WHERE r = 1 AND x.event_type NOT IN ('error', 'signup') AND x.ts >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY""",
)
def t3(spark, sf):
    log = cache_log(spark, sf)
    latest = views.latest_entries(log, "user_id", "ts", "event_id", ["url", "status"])
    valid = views.valid_entries(latest, "ts", "status", "url", as_of())
    return valid.select("user_id", "ts", "url", cat.parse_features(F.col("url"), "k BIGINT")["k"].alias("k"))


def cache_log(spark, sf, events=None):
    """Events as cache writes: errors are failures, sign-ups invalidate."""
    rows = table(spark, sf, "events") if events is None else events
    return rows.select(
        "user_id", "ts", "event_id",
        F.when(F.col("event_type") != "signup", F.col("props")).alias("url"),
        F.when(F.col("event_type") == "error", "invalid").otherwise("valid").alias("status"),
    )


@query(
    "t3_ttl_view_stream",
    """WITH x AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events)
    SELECT user_id AS entry_key, epoch_us(ts) AS micros, props AS url FROM x WHERE r = 1 AND event_type NOT IN ('error', 'signup') AND ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY""",
)
def t3_stream(spark, sf):
    log = cache_log(spark, sf, event_stream(spark, sf)).select(
        F.col("user_id").alias("entry_key"), F.col("ts").cast("timestamp").alias("ts"), epoch_micros("ts").alias("micros"), "url", "status"
    )
    path = work_path(spark, "ttl-view")

    def publish(batch, number):
        batch.write.mode("overwrite").parquet(f"{path}/update={number}")

    runs.run_batches(views.expiring_view(log), "ttl-view", publish, mode="update")
    changes = spark.read.schema("entry_key BIGINT, micros BIGINT, url STRING, update INT").parquet(path)
    newest = table(spark, sf, "events").agg(F.max(epoch_micros("ts")).alias("m")).scalar()
    return views.current_view(changes, newest)


@query(
    "t4_catalog_ingest_stream",
    r"""SELECT doc_id, text, lang, source, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY text, source ORDER BY doc_id) AS n FROM
    (SELECT doc_id, regexp_replace(text, '^[\s\p{Z}]+|[\s\p{Z}]+\z', '', 'g') AS text, lang, source, n_chars FROM documents)) WHERE n = 1""",
)
def t4(spark, sf):
    target = work_path(spark, "ingested")
    views.ingest(table_stream(spark, sf, "documents"), target, "doc_id", ["text", "lang", "source"], ["text", "source"])
    return views.ingested(spark, target, table(spark, sf, "documents").schema)


@query(
    "t5_retention_plan",
    """WITH m AS (SELECT max(o_orderdate) AS now FROM orders), s AS (SELECT c_custkey AS id, c_mktsegment = 'BUILDING' AS orig, max(o_orderdate) AS last FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL)
    SELECT 'song' AS kind, id, CASE WHEN (SELECT sum(o_totalprice) / 1e6 FROM orders) > 450 AND NOT orig AND (last IS NULL OR last <= now - INTERVAL 30 DAY) THEN 'drop' ELSE 'keep' END AS action FROM s, m
    UNION ALL SELECT 'recommendation', o_orderkey, CASE WHEN (SELECT sum(o_totalprice) / 1e6 FROM orders) > 450 AND o_orderdate < now - INTERVAL 7 DAY THEN 'drop' ELSE 'keep' END FROM orders, m""",
)
def t5(spark, sf):
    orders = table(spark, sf, "orders")
    accessed = orders.groupBy(F.col("o_custkey").alias("song_id")).agg(F.max("o_orderdate").alias("last_accessed"))
    catalog = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("song_id"), (F.col("c_mktsegment") == "BUILDING").alias("is_original")
    ).join(accessed, "song_id", "left")
    recs = orders.select(F.col("o_orderkey").alias("rec_id"), F.col("o_custkey").alias("song_id"), F.col("o_orderdate").alias("created_at"))
    latest = orders.agg(F.max("o_orderdate").alias("m")).scalar()
    # The storage in use, measured: the orders' prices stand for bytes.
    storage = orders.agg(F.sum("o_totalprice") / 1e6).scalar()
    return views.retention_plan(catalog, recs, latest, storage)


@query(
    "t5_file_retention",
    f"""WITH f AS (SELECT CASE WHEN event_type IN ('click', 'view') THEN 'audio' ELSE 'cache' END AS kind, '/store/' || event_id AS path, ts AS modified FROM events)
    SELECT kind, path, CASE WHEN (SELECT sum(floor(value * 1024)::BIGINT) / 1048576.0::DOUBLE FROM events) > 450 AND modified < TIMESTAMP '{AS_OF}' - CASE WHEN kind = 'audio' THEN INTERVAL 6 HOUR ELSE INTERVAL 24 HOUR END THEN 'drop' ELSE 'keep' END AS action FROM f""",
)
def t5_files(spark, sf):
    kind = F.when(F.col("event_type").isin("click", "view"), "audio").otherwise("cache")
    files = table(spark, sf, "events").select(kind.alias("kind"), F.concat(F.lit("/store/"), "event_id").alias("path"), F.col("ts").alias("modified"))
    storage = table(spark, sf, "events").agg(F.sum(F.floor(F.col("value") * 1024)) / 1048576.0).scalar()
    return views.file_retention_plan(files, as_of(), storage)


@query("t6_progressive_top_k_stream", audio_sql(sp.STANDARD))
def t6(spark, sf):
    catalog = songs(spark, sf).select("song_id", "track_name", "playlist_genre", *AUDIO_KEYS)
    path = work_path(spark, "arriving")
    catalog.repartition(4, "song_id").write.parquet(path)
    # Every batch reads the seeds: found once, in the rows that arrive.
    arriving = spark.read.schema(catalog.schema).parquet(path)
    seeds = write_and_read(sc.as_seeds(genre_leads(arriving), AUDIO_KEYS), "stream-seeds")
    stream = runs.read_files(spark, path, catalog.schema, files_per_trigger=1)

    def score(batch):
        pairs = sc.audio_pairs(batch, seeds)
        return pairs.select("seed.seed_id", "song_id", sc.score_round(sc.audio_score()).alias("audio"))

    return views.progressive_top_k(stream, score, ["seed_id"], [F.desc("audio"), F.asc("song_id")], 5)
