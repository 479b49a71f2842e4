"""Joins and record linkage."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.functions import audio as au
from cadenza.operators import joins as jn, linkage as ln, lyrics_join as lj, scoring as sc
from cadenza.session import write_and_read
from cadenza.sources.tables import audio_map, songs, table, texts
from cadenza.workload import sqlparts as sp
from cadenza.workload.inputs import genre_leads
from cadenza.workload.registry import query


@query(
    "c1_seed_catalog_scoring",
    f"""WITH {sp.SONGS}, {sp.LEADS}, s AS (SELECT q.song_id AS seed_id, c.song_id, round({sp.tempo('q.tempo', 'c.tempo')}, 6) AS tempo_similarity
    FROM leads JOIN songs q ON q.song_id = seed_id JOIN songs c ON c.song_id <> q.song_id)
    SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY seed_id ORDER BY tempo_similarity DESC, song_id) AS INTEGER) AS rank FROM s) WHERE rank <= 50""",
)
def c1(spark, sf):
    catalog = songs(spark, sf).select("song_id", "track_name", "playlist_genre", "tempo")
    pairs = sc.against_seeds(catalog, sc.as_seeds(genre_leads(catalog), ["tempo"]))
    sim = au.tempo_similarity(F.col("seed.tempo"), F.col("tempo"))
    scored = pairs.select("seed.seed_id", "song_id", F.round(sim, 6).alias("tempo_similarity"))
    return sc.top_k(scored, ["seed_id"], [F.desc("tempo_similarity"), F.asc("song_id")], 50)


@query(
    "c2_fetch_by_id_list",
    "SELECT p_partkey, p_name, p_retailprice FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 49)",
)
def c2(spark, sf):
    ids = table(spark, sf, "lineitem").where("l_returnflag = 'R' AND l_quantity > 49").select(F.col("l_partkey").alias("p_partkey"))
    return jn.fetch_features(table(spark, sf, "part"), ids, "p_partkey", ["p_name", "p_retailprice"])


@query(
    "c3_hydrate_results",
    f"""WITH {sp.TEXTS} SELECT doc_id AS song_id, quality, coalesce(track_name, 'Unknown') AS track_name, coalesce(track_artist, 'Unknown') AS track_artist
    FROM labels LEFT JOIN songs ON song_id = doc_id""",
)
def c3(spark, sf):
    results = table(spark, sf, "labels").select(F.col("doc_id").alias("song_id"), "quality")
    return jn.hydrate(results, texts(spark, sf), "song_id", ["track_name", "track_artist"])


@query(
    "c4_backfill_missing",
    """SELECT p.page_id, CASE WHEN contains(p.url, '#') THEN d.text ELSE p.url END AS body, CASE WHEN contains(p.url, '?') THEN d.lang ELSE 'own' END AS lang
    FROM pages p LEFT JOIN documents d ON d.doc_id = p.page_id""",
)
def c4(spark, sf):
    pages = table(spark, sf, "pages").select(
        "page_id", F.when(F.contains("url", F.lit("#")), "").otherwise(F.col("url")).alias("body"),
        F.when(~F.contains("url", F.lit("?")), "own").alias("lang"),
    )
    lookup = table(spark, sf, "documents").select(F.col("doc_id").alias("page_id"), F.col("text").alias("body"), "lang")
    return jn.backfill(pages, lookup, "page_id", ["body", "lang"])


@query(
    "c5_retention",
    """SELECT * FROM customer WHERE c_mktsegment = 'BUILDING' OR c_custkey IN
    (SELECT o_custkey FROM orders WHERE o_orderdate > (SELECT max(o_orderdate) FROM orders) - INTERVAL 30 DAY)""",
)
def c5(spark, sf):
    orders = table(spark, sf, "orders")
    latest = orders.agg(F.max("o_orderdate").alias("m")).scalar()
    recent = orders.where(F.col("o_orderdate") > latest - F.expr("INTERVAL 30 DAYS")).select(F.col("o_custkey").alias("c_custkey"))
    return jn.keep_recommended(table(spark, sf, "customer"), recent, "c_custkey", F.col("c_mktsegment") == "BUILDING")


@query(
    "c6_artist_containment",
    """SELECT p_partkey, p_brand, wanted FROM part JOIN (SELECT DISTINCT upper(p_brand) AS wanted FROM part WHERE p_size > 45) ON contains(lower(p_brand), lower(wanted))""",
)
def c6(spark, sf):
    part = table(spark, sf, "part")
    asked = part.where("p_size > 45").select(F.upper("p_brand").alias("wanted")).distinct()
    return ln.containment_join(part.select("p_partkey", "p_brand"), asked, "p_brand", "wanted")


# Search hits: the parts a line item names by supplier number, in line order.
HITS_SQL = """hits AS (SELECT l_partkey AS query_id, l_linenumber, l_orderkey, h.p_name AS hit_title, h.p_brand AS hit_artist
  FROM lineitem JOIN part h ON h.p_partkey = l_suppkey),
first_hits AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY l_linenumber, l_orderkey, hit_title, hit_artist) AS INTEGER) AS position FROM hits) WHERE position <= {n})"""
HIT_ORDER = ["l_linenumber", "l_orderkey", "hit_title", "hit_artist"]


def search_hits(spark, sf):
    part = table(spark, sf, "part")
    shown = part.select(F.col("p_partkey").alias("l_suppkey"), F.col("p_name").alias("hit_title"), F.col("p_brand").alias("hit_artist"))
    lines = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("query_id"), "l_suppkey", "l_linenumber", "l_orderkey")
    queries = part.select(F.col("p_partkey").alias("query_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("artist"))
    return queries, lines.join(shown, "l_suppkey").drop("l_suppkey")


WITHIN = "(contains(lower({0}), lower({1})) OR contains(lower({1}), lower({0})))"


@query(
    "c7_accept_hits",
    f"""WITH {HITS_SQL.format(n=3)} SELECT query_id, position, p_name AS title, hit_title, p_brand AS artist, hit_artist FROM first_hits JOIN part ON p_partkey = query_id
    WHERE {WITHIN.format('p_name', 'hit_title')} OR {WITHIN.format('p_brand', 'hit_artist')}""",
)
def c7(spark, sf):
    queries, hits = search_hits(spark, sf)
    return ln.accepted_hits(queries, hits, [F.col(c) for c in HIT_ORDER]).drop("l_linenumber", "l_orderkey")


@query(
    "c8_common_key_join",
    f"""WITH {sp.SONGS} SELECT song_id, CASE WHEN cluster <= 3 THEN 2 ELSE 1 END AS n_common,
    round(0.5::DOUBLE * energy * energy + CASE WHEN cluster <= 3 THEN 2 * tempo * tempo ELSE 0 END, 6) AS dot FROM songs""",
)
def c8(spark, sf):
    other = F.create_map(F.lit("energy"), F.col("energy") * 0.5, F.lit("tempo"), F.col("tempo") * 2, F.lit("chroma"), F.lit(1.0))
    other = F.when(F.col("cluster") <= 3, other).otherwise(F.map_filter(other, lambda k, v: k != "tempo"))
    both = songs(spark, sf).select("song_id", jn.common_key_products(audio_map(), other).alias("m"))
    return both.select(
        "song_id", F.size("m").alias("n_common"),
        F.round(F.aggregate(F.map_values("m"), F.lit(0.0), lambda acc, v: acc + v), 6).alias("dot"),
    )


@query(
    "c9_deletable_files",
    """SELECT '/audio/' || e.event_id || CASE WHEN event_type = 'click' THEN '.mp3' WHEN event_type = 'view' THEN '.wav' ELSE '.txt' END AS path, ts AS modified FROM events e
    WHERE event_type IN ('click', 'view') AND ts < TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 24 HOUR AND e.event_id NOT IN (SELECT doc_id FROM labels)""",
)
def c9(spark, sf):
    ending = F.when(F.col("event_type") == "click", ".mp3").when(F.col("event_type") == "view", ".wav").otherwise(".txt")
    events = table(spark, sf, "events")
    files = events.select(F.concat(F.lit("/audio/"), "event_id", ending).alias("path"), F.col("ts").alias("modified"))
    active = events.join(table(spark, sf, "labels"), F.col("event_id") == F.col("doc_id")).select(F.concat(F.lit("/audio/"), "event_id", ending).alias("path"))
    as_of = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
    return jn.deletable_files(files, active, jn.AUDIO_ENDINGS, as_of, F.expr("INTERVAL 24 HOURS"))


@query(
    "c9_deletable_cache",
    """SELECT '/cache/' || event_id || CASE WHEN event_type = 'purchase' THEN '.pkl' WHEN event_type = 'error' THEN '.json' WHEN event_type = 'signup' THEN '.npy' ELSE '.tmp' END AS path, ts AS modified FROM events
    WHERE event_type IN ('purchase', 'error', 'signup') AND ts < TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 7 DAY AND event_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)""",
)
def c9_cache(spark, sf):
    endings = {"purchase": ".pkl", "error": ".json", "signup": ".npy"}
    kind = F.col("event_type")
    ending = F.coalesce(*[F.when(kind == k, F.lit(e)) for k, e in endings.items()], F.lit(".tmp"))
    events = table(spark, sf, "events").select("event_id", F.concat(F.lit("/cache/"), "event_id", ending).alias("path"), F.col("ts").alias("modified"))
    used = table(spark, sf, "labels").where("quality = 1").select(F.col("doc_id").alias("event_id"))
    active = events.join(used, "event_id", "left_semi").select("path")
    as_of = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
    return jn.deletable_files(events.select("path", "modified"), active, jn.CACHE_ENDINGS, as_of, F.expr("INTERVAL 7 DAYS"))


def confidence_sql(equal_t, within_t, equal_a, within_a, none_a):
    return f"""round(greatest(0, least(1, 0.5::DOUBLE + CASE WHEN lower(p_name) = lower(hit_title) THEN {equal_t} WHEN {WITHIN.format('p_name', 'hit_title')} THEN {within_t} ELSE 0 END::DOUBLE
      + CASE WHEN lower(p_brand) = lower(hit_artist) THEN {equal_a} WHEN {WITHIN.format('p_brand', 'hit_artist')} THEN {within_a} ELSE {none_a} END::DOUBLE)), 6)"""


@query(
    "c10_match_confidence",
    f"""WITH {HITS_SQL.format(n=1)} SELECT query_id, hit_title, hit_artist, {confidence_sql(0.3, 0.2, 0.2, 0.1, 0.0)} AS search_confidence,
    {confidence_sql(0.3, 0.3, 0.2, 0.2, -0.3)} AS open_confidence, CASE WHEN query_id % 3 = 0 THEN 0.6::DOUBLE ELSE {confidence_sql(0.3, 0.2, 0.2, 0.1, 0.0)} END AS corrected_confidence
    FROM first_hits JOIN part ON p_partkey = query_id""",
)
def c10(spark, sf):
    queries, hits = search_hits(spark, sf)
    first = sc.top_k(hits, ["query_id"], [F.col(c) for c in HIT_ORDER], 1, "position").join(queries, "query_id")
    args = [F.col(c) for c in ("title", "artist", "hit_title", "hit_artist")]
    return first.select(
        "query_id", "hit_title", "hit_artist",
        F.round(ln.match_confidence(*args, ln.SEARCH_HIT), 6).alias("search_confidence"),
        F.round(ln.match_confidence(*args, ln.OPEN_DATABASE), 6).alias("open_confidence"),
        # One query in three is answered by a source that corrects spelling itself.
        F.round(ln.match_confidence(*args, ln.SEARCH_HIT, autocorrected=F.col("query_id") % 3 == 0), 6).alias("corrected_confidence"),
    )


# One record per (part, return flag) stands for one answer of one metadata source.
SOURCES_SQL = """sources AS (SELECT l_partkey AS id, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS priority,
  CASE l_returnflag WHEN 'A' THEN 'genius' WHEN 'N' THEN 'lastfm' ELSE 'musicbrainz' END AS source, round(avg(l_tax) * 12, 6) AS confidence,
  CASE l_returnflag WHEN 'A' THEN ['album', 'release'] WHEN 'N' THEN ['album', 'genre', 'duration'] ELSE ['album', 'release', 'genre', 'duration'] END AS given,
  min(l_orderkey)::VARCHAR AS album, max(l_shipdate)::DATE::VARCHAR AS release, CASE WHEN l_returnflag = 'N' THEN min(l_linestatus) END AS genre,
  CASE WHEN min(l_suppkey) > 30 THEN min(l_suppkey) END AS duration FROM lineitem GROUP BY l_partkey, l_returnflag)"""
TAKEN_SQL = """marked AS (SELECT *, coalesce(max(confidence) OVER (PARTITION BY id ORDER BY priority ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS best FROM sources),
taken AS (SELECT * FROM marked WHERE confidence > best AND best < 0.8)"""
META_COLUMNS = ["album", "release", "genre", "duration"]


def last_given_sql(column):
    return f"(SELECT t.{column} FROM taken t WHERE t.id = m.id AND list_contains(given, '{column}') ORDER BY priority DESC LIMIT 1) AS {column}"


MERGED_SQL = f"""merged AS (SELECT id, confidence, source, {', '.join(map(last_given_sql, META_COLUMNS))} FROM
  (SELECT id, max(confidence) AS confidence, arg_max(source, priority) AS source FROM taken GROUP BY id) m)"""


def metadata_sources(spark, sf):
    flag = F.col("l_returnflag")
    grouped = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("id"), "l_returnflag").agg(
        F.round(F.avg("l_tax") * 12, 6).alias("confidence"), F.min("l_orderkey").cast("string").alias("album"),
        F.max("l_shipdate").cast("date").cast("string").alias("release"),
        F.min("l_linestatus").alias("status"), F.min("l_suppkey").alias("supp"),
    )
    return grouped.select(
        "id",
        F.when(flag == "A", 1).when(flag == "N", 2).otherwise(3).alias("priority"),
        F.when(flag == "A", "genius").when(flag == "N", "lastfm").otherwise("musicbrainz").alias("source"),
        "confidence",
        F.when(flag == "A", F.array(F.lit("album"), F.lit("release")))
        .when(flag == "N", F.array(F.lit("album"), F.lit("genre"), F.lit("duration")))
        .otherwise(F.array(*[F.lit(c) for c in META_COLUMNS])).alias("given"),
        "album", "release",
        F.when(flag == "N", F.col("status")).alias("genre"),
        F.when(F.col("supp") > 30, F.col("supp")).alias("duration"),
    )


@query("g7_source_survivorship", f"WITH {SOURCES_SQL}, {TAKEN_SQL}, {MERGED_SQL} SELECT * FROM merged")
def g7(spark, sf):
    return ln.survivorship(metadata_sources(spark, sf), "id", META_COLUMNS)


@query(
    "g8_metadata_overlay",
    f"""WITH {SOURCES_SQL}, {TAKEN_SQL}, {MERGED_SQL} SELECT p_partkey AS id, p_name, CASE WHEN confidence > 0.5 THEN coalesce(album, p_brand) ELSE p_brand END AS album,
    CASE WHEN confidence > 0.5 THEN coalesce(genre, p_type) ELSE p_type END AS genre, CASE WHEN confidence > 0.5 THEN coalesce(duration, 0) ELSE 0 END AS duration FROM part LEFT JOIN merged ON id = p_partkey""",
)
def g8(spark, sf):
    merged = ln.survivorship(metadata_sources(spark, sf), "id", META_COLUMNS)
    base = table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), "p_name", F.col("p_brand").alias("album"), F.col("p_type").alias("genre"), F.lit(0).cast("bigint").alias("duration")
    )
    return ln.overlay(base, merged, "id", ["album", "genre", "duration"])


@query(
    "g9_first_answer",
    f"WITH {SOURCES_SQL} SELECT id, arg_min(duration, priority) AS duration, arg_min(source, priority) AS source FROM sources WHERE duration IS NOT NULL GROUP BY id",
)
def g9(spark, sf):
    return ln.first_answer(metadata_sources(spark, sf), "id", "duration")


# Incoming uploads: one song per artist, the alphabetically first.
INCOMING_SQL = """incoming AS (SELECT song_id AS incoming_id, track_name, track_artist FROM (SELECT *, row_number() OVER (PARTITION BY track_artist ORDER BY track_name, song_id) AS r FROM songs) WHERE r = 1)"""
RAW_TERMS_SQL = r"""terms AS MATERIALIZED (SELECT song_id, term, count(*) AS tf FROM (SELECT song_id, unnest(regexp_extract_all(lower(lyrics), '[\p{L}\p{N}_]{2,}')) AS term FROM songs) GROUP BY ALL),
term_totals AS (SELECT song_id, sum(tf * tf) AS sq FROM terms GROUP BY song_id)"""


def duplicate_inputs(spark, sf):
    # Read by both sides and both legs, so the texts are counted once.
    catalog = write_and_read(sc.with_terms(texts(spark, sf), "lyrics", cleaned=False).drop("lyrics"), "raw-terms")
    first = catalog.groupBy("track_artist").agg(F.min(F.struct("track_name", "song_id")).alias("f")).select(F.col("f.song_id").alias("song_id"))
    incoming = catalog.join(first, "song_id", "left_semi").withColumnRenamed("song_id", "incoming_id")
    return catalog, write_and_read(incoming, "incoming")


DUPLICATE_TITLE = sp.normalised_title("{0}.track_name")


@query(
    "d31_find_duplicates",
    f"""WITH {sp.TEXTS}, {RAW_TERMS_SQL}, {INCOMING_SQL}, seeds AS (SELECT incoming_id AS seed_id FROM incoming), {sp.lyric_legs('seeds')},
    t AS (SELECT i.incoming_id, s.song_id, s.track_name, s.track_artist, {DUPLICATE_TITLE.format('i')} AS a, {DUPLICATE_TITLE.format('s')} AS b
      FROM incoming i JOIN songs s ON contains(lower(s.track_artist), lower(i.track_artist))),
    r AS (SELECT t.*, round(CASE WHEN greatest(length(a), length(b)) > 0 THEN 1 - levenshtein(a, b) / greatest(length(a), length(b))::DOUBLE ELSE 1 END, 6) AS title_similarity,
      CASE WHEN x.song_id IS NOT NULL AND y.song_id IS NOT NULL THEN round(coalesce(lyr.lyrics, 0), 6) END AS lyrics_similarity
      FROM t LEFT JOIN lyr ON lyr.seed_id = incoming_id AND lyr.song_id = t.song_id
      LEFT JOIN term_totals x ON x.song_id = t.song_id LEFT JOIN term_totals y ON y.song_id = incoming_id)
    SELECT incoming_id, song_id, track_name, track_artist, title_similarity, lyrics_similarity FROM r WHERE title_similarity >= 0.8 OR lyrics_similarity >= 0.8""",
)
def d31(spark, sf):
    return ln.find_duplicates(*duplicate_inputs(spark, sf))


@query(
    "d31_lyrics_duplicates",
    f"""WITH {sp.TEXTS}, {RAW_TERMS_SQL}, {INCOMING_SQL}, seeds AS (SELECT incoming_id AS seed_id FROM incoming), {sp.lyric_legs('seeds')}
    SELECT i.incoming_id, s.song_id, round(lyr.lyrics, 6) AS lyrics_similarity FROM incoming i JOIN songs s ON contains(lower(s.track_artist), lower(i.track_artist))
    JOIN lyr ON lyr.seed_id = i.incoming_id AND lyr.song_id = s.song_id WHERE round(lyr.lyrics, 6) >= 0.8""",
)
def d31_lyrics(spark, sf):
    catalog, incoming = duplicate_inputs(spark, sf)
    pairs = ln.duplicate_candidates(catalog, incoming).select("incoming_id", "song_id")
    scored = ln.with_lyrics_similarity(write_and_read(pairs, "candidates"), catalog, incoming)
    return scored.withColumn("lyrics_similarity", F.round("lyrics_similarity", 6)).where("lyrics_similarity >= 0.8")


ALL_LYRICS_SQL = f"""WITH {sp.TEXTS}, {RAW_TERMS_SQL}, d AS (SELECT a.song_id AS x, b.song_id AS y, sum(a.tf * b.tf)::DOUBLE AS dot, sum(a.tf * a.tf)::DOUBLE AS s11, sum(b.tf * b.tf)::DOUBLE AS s22
  FROM terms a JOIN terms b USING (term) GROUP BY ALL),
c AS (SELECT x, y, round(dot / (sqrt(s11 + {sp.C2} * (t.sq - s11)) * sqrt(s22 + {sp.C2} * (u.sq - s22))), 6) AS lyrics FROM d JOIN term_totals t ON t.song_id = x JOIN term_totals u ON u.song_id = y),
k AS (SELECT song_id, list(term || ' ' || tf ORDER BY term) AS counts FROM terms GROUP BY song_id), cl AS (SELECT song_id, min(song_id) OVER (PARTITION BY counts) AS class_id FROM k)"""


@query(
    "d31_all_lyrics_links",
    f"""{ALL_LYRICS_SQL} SELECT song_id, class_id, count(y) AS n_links FROM cl LEFT JOIN c ON x = song_id AND y <> song_id AND lyrics >= 0.8 GROUP BY ALL""",
)
def d31_all(spark, sf):
    catalog = write_and_read(sc.with_terms(texts(spark, sf), "lyrics", cleaned=False).select("song_id", "terms", "terms_sq"), "raw-terms")
    return lj.lyrics_links(catalog)


def title_pairs(spark, sf):
    """Each distinct (title, hit title) pair among the search hits, compared once."""
    queries, hits = search_hits(spark, sf)
    return hits.join(queries, "query_id").select("title", "hit_title").distinct()


@query(
    "h7_edit_ratio",
    f"""WITH {HITS_SQL.format(n=1)} SELECT title, hit_title, round(1 - levenshtein(title, hit_title) / greatest(length(title), length(hit_title))::DOUBLE, 6) AS ratio FROM
    (SELECT DISTINCT p_name AS title, hit_title FROM hits JOIN part ON p_partkey = query_id)""",
)
def h7_edit(spark, sf):
    ratio = ln.edit_ratio(F.col("title"), F.col("hit_title"))
    return title_pairs(spark, sf).select("title", "hit_title", F.round(ratio, 6).alias("ratio"))
