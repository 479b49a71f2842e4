"""Sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.plans.features import materialise
from cadenza.session import work_path
from cadenza.sources import catalog as cat
from cadenza.sources import sinks
from cadenza.sources.tables import AUDIO_KEYS, songs, table, texts
from cadenza.workload import sqlparts as sp
from cadenza.workload.registry import query

ROUNDED = ", ".join(f"round({n}, 6) AS {n}" for n in sp.AUDIO if n not in ("key", "mode", "duration_ms"))


def catalog_csv(spark, sf):
    """The catalog written as CSV, for the reader to load."""
    path = work_path(spark, "catalog-csv")
    rows = songs(spark, sf).select(
        F.col("song_id").cast("string").alias("track_id"), "track_name", "track_artist",
        F.col("cluster").cast("string").alias("track_album_name"), F.lit("all").alias("playlist_name"),
        "playlist_genre", "lyrics", *AUDIO_KEYS,
    )
    rows.write.csv(path, header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return path


@query(
    "a1_csv_catalog",
    f"""WITH {sp.SONGS} SELECT song_id::VARCHAR AS track_id, track_name, track_artist, lyrics, playlist_genre,
    key::BIGINT AS key, mode::BIGINT AS mode, duration_ms::BIGINT AS duration_ms, {ROUNDED} FROM songs""",
)
def a1(spark, sf):
    path = catalog_csv(spark, sf)
    df = cat.clean_numbers(cat.load_catalog(spark, f"{path}/missing", path))
    return df.select(
        "track_id", "track_name", "track_artist", "lyrics", "playlist_genre",
        *[F.col(n) if n in cat.WHOLE_KEYS else F.round(n, 6).alias(n) for n in AUDIO_KEYS],
    )


@query("a2_feature_scan", "SELECT vec_id, len(embedding)::INTEGER AS dims, round(embedding[1]::DOUBLE, 6) AS first FROM embeddings WHERE embedding IS NOT NULL")
def a2(spark, sf):
    scan = cat.scan_features(table(spark, sf, "embeddings"), "vec_id", "embedding")
    return scan.select("vec_id", F.size("embedding").alias("dims"), F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("first"))


@query(
    "a3_pack_features",
    f"""WITH {sp.SONGS} SELECT song_id, key::VARCHAR AS key, mode::VARCHAR AS mode, duration_ms::VARCHAR AS duration_ms,
    round(danceability, 6) AS danceability, round(loudness, 6) AS loudness, round(tempo, 6) AS tempo, 12 AS n_keys FROM songs""",
)
def a3(spark, sf):
    packed = songs(spark, sf).select("song_id", cat.pack_features().alias("j"))
    return packed.select(
        "song_id",
        *[F.get_json_object("j", f"$.{n}").alias(n) for n in ("key", "mode", "duration_ms")],
        *[F.round(F.get_json_object("j", f"$.{n}").cast("double"), 6).alias(n) for n in ("danceability", "loudness", "tempo")],
        F.size(F.json_object_keys("j")).alias("n_keys"),
    )


@query(
    "a4_parse_features",
    """WITH raw AS (SELECT event_id, CASE WHEN event_type = 'error' THEN substr(props, 1, length(props) - 1) ELSE props END AS j FROM events)
    SELECT event_id, CASE WHEN json_valid(j) THEN CAST(json_extract_string(CASE WHEN json_valid(j) THEN j END, '$.k') AS BIGINT) END AS k FROM raw""",
)
def a4(spark, sf):
    text = F.when(F.col("event_type") == "error", F.expr("substring(props, 1, length(props) - 1)")).otherwise(F.col("props"))
    return table(spark, sf, "events").select("event_id", cat.parse_features(text, "k BIGINT")["k"].alias("k"))


# Existing catalog: the first part of each (name, brand) among the smaller sizes.
TARGET_SQL = """target AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY p_name, p_brand ORDER BY p_partkey) AS n
  FROM part WHERE p_size <= 25) WHERE n = 1)"""
PART_KEY = ["p_name", "p_brand"]


def part_target(spark, sf):
    return sinks.first_per_key(table(spark, sf, "part").where("p_size <= 25"), PART_KEY, "p_partkey")


@query(
    "a5_append_new",
    f"""WITH {TARGET_SQL}, fresh AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY p_name, p_brand ORDER BY p_partkey) AS n
    FROM part) f WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM target t WHERE t.p_name = f.p_name AND t.p_brand = f.p_brand))
    SELECT *, 'kept' AS origin FROM target UNION ALL SELECT *, 'new' AS origin FROM fresh""",
)
def a5(spark, sf):
    target = part_target(spark, sf)
    fresh = sinks.append_new(target, table(spark, sf, "part"), "p_partkey", PART_KEY)
    return target.withColumn("origin", F.lit("kept")).unionByName(fresh.withColumn("origin", F.lit("new")))


@query(
    "a6_upsert",
    f"""WITH {TARGET_SQL}, latest AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY p_name, p_brand ORDER BY p_partkey DESC) AS n FROM part) WHERE n = 1)
    SELECT coalesce(t.p_partkey, (SELECT max(p_partkey) FROM target) + 1 + l.p_partkey) AS p_partkey, l.p_name, l.p_brand, l.p_type, l.p_size, l.p_retailprice
    FROM latest l LEFT JOIN target t USING (p_name, p_brand)
    UNION ALL SELECT * FROM target t WHERE NOT EXISTS (SELECT 1 FROM latest l WHERE l.p_name = t.p_name AND l.p_brand = t.p_brand)""",
)
def a6(spark, sf):
    return sinks.upsert(part_target(spark, sf), table(spark, sf, "part"), "p_partkey", "p_partkey", PART_KEY)


@query(
    "a7_patch",
    """WITH sold AS (SELECT l_partkey AS p_partkey, max(l_extendedprice) AS top, count(*) FILTER (WHERE l_returnflag = 'R') AS back FROM lineitem GROUP BY 1)
    SELECT p.p_partkey, p_name, p_brand, CASE WHEN back > 0 THEN NULL ELSE p_type END AS p_type, p_size,
    CASE WHEN top > 90000 THEN top ELSE p_retailprice END AS p_retailprice FROM part p LEFT JOIN sold USING (p_partkey)""",
)
def a7(spark, sf):
    sold = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(
        F.max("l_extendedprice").alias("top"), F.count_if(F.col("l_returnflag") == "R").alias("back")
    )
    patches = sold.select(
        "p_partkey", F.col("top").alias("p_retailprice"), F.lit(None).cast("string").alias("p_type"),
        F.array_compact(F.array(F.when(F.col("top") > 90000, F.lit("p_retailprice")), F.when(F.col("back") > 0, F.lit("p_type")))).alias("given"),
    )
    return sinks.patch(table(spark, sf, "part"), patches, "p_partkey", ["p_retailprice", "p_type"])


@query(
    "a8_delete",
    "SELECT * FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')",
)
def a8(spark, sf):
    gone = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return sinks.delete(table(spark, sf, "customer"), gone, "c_custkey")


@query(
    "a9_import_raw",
    f"""WITH {sp.TEXTS} SELECT track_name, track_artist, playlist_genre, lyrics, '{{}}' AS audio_features, NULL::VARCHAR AS word2vec_features,
    NULL::VARCHAR AS sentiment_features, NULL::VARCHAR AS topic_features, false AS is_original FROM songs""",
)
def a9(spark, sf):
    return cat.import_raw(texts(spark, sf))


@query(
    "a10_materialise",
    f"WITH {sp.SONGS} SELECT song_id, round(valence, 6) AS valence, round(list_sum(topics), 6) AS topic_sum FROM songs",
)
def a10(spark, sf):
    path = work_path(spark, "derived")
    derived = songs(spark, sf).select(
        "song_id", F.round("valence", 6).alias("valence"),
        F.round(F.aggregate("topics", F.lit(0.0), lambda a, v: a + v), 6).alias("topic_sum"),
    )
    materialise(derived, path)
    return materialise(derived, path)


# Files that the events stand for: one per event, in a folder per type, a kilobyte per unit of value.
@query(
    "a11_file_manifest",
    """SELECT '/store/' || event_type AS folder, count(*) AS files, round(sum((floor(value) * 1024)::BIGINT) / 1048576, 2) AS storage_mb FROM events GROUP BY event_type""",
)
def a11(spark, sf):
    path = F.concat(F.lit("/store/"), "event_type", F.lit("/"), "event_id", F.lit(".mp3"))
    length = (F.floor("value") * 1024).cast("bigint")
    return cat.storage_stats(table(spark, sf, "events").select(path.alias("path"), length.alias("length")))


@query(
    "a12_normalise_media",
    """WITH r AS (SELECT substr(md5(url), 1, 11) AS video_id, nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '') AS title,
      nullif(regexp_extract(url, '^https?://([^/]+)/', 1), '') AS uploader, html AS description, CASE WHEN contains(url, '?') THEN length(html) END AS duration,
      CASE WHEN contains(url, '#') THEN NULL ELSE page_id * 10 END AS view_count, CASE WHEN contains(url, '?') THEN string_split(url, '/') END AS tags FROM pages)
    SELECT video_id, coalesce(title, 'Unknown') AS title, coalesce(uploader, 'Unknown') AS uploader, coalesce(duration, 0)::BIGINT AS duration,
      coalesce(view_count, 0)::BIGINT AS view_count, coalesce(description, '') AS description, substr(coalesce(description, ''), 1, 500) AS short_description, coalesce(len(tags), 0)::INTEGER AS n_tags,
      'https://www.youtube.com/watch?v=' || video_id AS url, 'https://img.youtube.com/vi/' || video_id || '/hqdefault.jpg' AS thumbnail, 'youtube' AS source FROM r""",
)
def a12(spark, sf):
    pages = table(spark, sf, "pages")
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    host = F.regexp_extract("url", "^https?://([^/]+)/", 1)
    records = pages.select(
        F.substring(F.md5("url"), 1, 11).alias("video_id"),
        F.when(title != "", title).alias("title"),
        F.when(host != "", host).alias("uploader"),
        F.col("html").alias("description"),
        F.when(F.contains("url", F.lit("?")), F.length("html")).cast("bigint").alias("duration"),
        F.when(~F.contains("url", F.lit("#")), F.col("page_id") * 10).alias("view_count"),
        F.when(F.contains("url", F.lit("?")), F.split("url", "/")).alias("tags"),
    )
    return cat.normalise_media(records)


@query(
    "a13_batch_add",
    """WITH files AS (SELECT '/audio/' || source || '/' || doc_id || '_-' || lang || '.mp3' AS path FROM documents),
      meta AS (SELECT d.doc_id || '_-' || d.lang || '.mp3' AS file_name, 'song ' || quality AS track_name,
        CASE WHEN toxic = 0 THEN d.source END AS track_artist, d.lang AS playlist_genre FROM labels l JOIN documents d USING (doc_id))
    SELECT path, f.file_name, coalesce(track_name, regexp_replace(regexp_replace(f.file_name, '\\.[^.]*$', ''), '^[\\d_\\-\\s]+', '')) AS track_name,
      coalesce(track_artist, 'Unknown') AS track_artist, coalesce(playlist_genre, 'Unknown') AS playlist_genre
    FROM (SELECT path, regexp_replace(path, '^.*/', '') AS file_name FROM files) f LEFT JOIN meta m USING (file_name)""",
)
def a13(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source")
    name = F.concat(F.col("doc_id"), F.lit("_-"), F.col("lang"), F.lit(".mp3"))
    files = docs.select(F.concat(F.lit("/audio/"), F.col("source"), F.lit("/"), name).alias("path"))
    meta = docs.join(table(spark, sf, "labels"), "doc_id").select(
        name.alias("file_name"), F.concat(F.lit("song "), F.col("quality")).alias("track_name"),
        F.when(F.col("toxic") == 0, F.col("source")).alias("track_artist"), F.col("lang").alias("playlist_genre"),
    )
    return cat.batch_add(files, meta)

