"""Projections, filters, predicates and cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.functions import audio, coerce
from cadenza.operators import gram_index as gi, search, shaping
from cadenza.sources import catalog as cat
from cadenza.sources.tables import audio_map, songs, spread_table, table, texts
from cadenza.workload import sqlparts as sp
from cadenza.workload.registry import query


@query(
    "b1_drop_empty_fill_unknown",
    """SELECT coalesce(s_name, 'Unknown') AS s_name, s_nationkey, n_regionkey FROM customer c LEFT JOIN supplier s ON s.s_suppkey = c.c_custkey
    LEFT JOIN nation n ON n.n_nationkey = s.s_nationkey AND n.n_regionkey > 1 WHERE s_name IS NOT NULL OR s_nationkey IS NOT NULL""",
)
def b1(spark, sf):
    raw = (
        table(spark, sf, "customer").join(table(spark, sf, "supplier"), F.col("c_custkey") == F.col("s_suppkey"), "left")
        .join(table(spark, sf, "nation").where("n_regionkey > 1"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
        .select("s_name", "s_nationkey", "n_regionkey")
    )
    return cat.drop_empty_fill_unknown(raw, ["s_name"])


@query(
    "b2_coerce_numbers",
    """WITH raw AS (SELECT event_id, CASE event_type WHEN 'error' THEN value || ' bpm' WHEN 'signup' THEN '' ELSE value::VARCHAR END AS t FROM events)
    SELECT event_id, coalesce(TRY_CAST(t AS DOUBLE), 0) AS tempo, coalesce(trunc(TRY_CAST(t AS DOUBLE))::BIGINT, 0) AS duration_ms FROM raw""",
)
def b2(spark, sf):
    text = F.when(F.col("event_type") == "error", F.concat(F.col("value"), F.lit(" bpm"))).when(
        F.col("event_type") == "signup", ""
    ).otherwise(F.col("value").cast("string"))
    raw = table(spark, sf, "events").select("event_id", text.alias("tempo"), text.alias("duration_ms"))
    return cat.clean_numbers(raw)


@query(
    "b3_lenient_scalars",
    """WITH raw AS (SELECT event_id, CASE event_type WHEN 'error' THEN [event_type, value::VARCHAR] WHEN 'click' THEN [] ELSE [value::VARCHAR, props] END AS a FROM events),
    n AS (SELECT event_id, a, list_filter(list_transform(a, lambda x: TRY_CAST(x AS DOUBLE)), lambda x: x IS NOT NULL) AS v FROM raw)
    SELECT event_id, coalesce(TRY_CAST(a[1] AS DOUBLE), 0) AS scalar, CASE WHEN len(v) > 0 THEN len(v) ELSE 1 END::INTEGER AS n_values, round(CASE WHEN len(v) > 0 THEN list_sum(v) ELSE 0 END, 6) AS total FROM n""",
)
def b3(spark, sf):
    number = F.col("value").cast("string")
    values = F.when(F.col("event_type") == "error", F.array("event_type", number)).when(
        F.col("event_type") == "click", F.array().cast("array<string>")
    ).otherwise(F.array(number, F.col("props")))
    raw = table(spark, sf, "events").select("event_id", values.alias("a"))
    parsed = raw.select("event_id", coerce.first_double(F.col("a")).alias("scalar"), coerce.numeric_values(F.col("a")).alias("v"))
    return parsed.select(
        "event_id", "scalar", F.size("v").alias("n_values"),
        F.round(F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x), 6).alias("total"),
    )


@query(
    "b4_trim_text",
    r"""SELECT conv_id, turn, regexp_replace(' ' || text || chr(10), '^[\s\p{Z}]+|[\s\p{Z}]+\z', '', 'g') AS text, trim(role) AS role FROM conversations""",
)
def b4(spark, sf):
    raw = table(spark, sf, "conversations").select("conv_id", "turn", F.concat(F.lit(" "), "text", F.lit("\n")).alias("text"), "role")
    return cat.trim_text(raw, ["text", "role"])


@query(
    "b5_get_by_id",
    f"WITH {sp.TEXTS} SELECT song_id, track_name, track_artist FROM songs WHERE song_id IN (SELECT doc_id FROM labels)",
)
def b5(spark, sf):
    asked = table(spark, sf, "labels").select(F.col("doc_id").alias("song_id"))
    return search.by_ids(texts(spark, sf), asked, "song_id").select("song_id", "track_name", "track_artist")


@query(
    "b6_substring_search",
    f"""WITH {sp.TEXTS} SELECT song_id, track_name, track_artist, playlist_genre FROM songs
    WHERE (track_name ILIKE '%the%' OR track_artist ILIKE '%the%') AND track_artist ILIKE '%SRC1%' AND playlist_genre ILIKE '%E%' ORDER BY track_name, song_id LIMIT 20""",
)
def b6(spark, sf):
    return search.substring_search(texts(spark, sf), "the", "SRC1", "E").select("song_id", "track_name", "track_artist", "playlist_genre")


@query(
    "b7_optional_filters",
    """SELECT p_partkey, p_name, p_brand, p_type FROM part WHERE p_name ILIKE '%ring%' AND p_brand ILIKE '%#1%' AND p_type ILIKE '%o%' AND p_retailprice IS NOT NULL""",
)
def b7(spark, sf):
    part = part_catalog(spark, sf)
    hits = search.filtered(part, "ring", "#1", "o", with_sentiment=F.col("p_retailprice"))
    return hits.select(
        F.col("song_id").alias("p_partkey"), F.col("track_name").alias("p_name"),
        F.col("track_artist").alias("p_brand"), F.col("playlist_genre").alias("p_type"),
    )


def part_catalog(spark, sf):
    return spread_table(spark, sf, "part").select(
        F.col("p_partkey").alias("song_id"), F.col("p_name").alias("track_name"), F.col("p_brand").alias("track_artist"),
        F.col("p_type").alias("playlist_genre"), "p_size", "p_retailprice",
    )


FUZZY = [
    {"title": "red plate"}, {"title": "smal widget"}, {"artist": "Brand#17"}, {"title": "hot ring", "genre": "ECONOMY"},
    {"artist": "brand 2"}, {"title": "rings"}, {"title": "large rod", "artist": "Brand#5"}, {"genre": "PROMO"},
    {"title": "plat"}, {"title": "blue gadget"},
]


def grams_sql(expr: str) -> str:
    words = f"regexp_extract_all(lower({expr}), '[\\p{{L}}\\p{{N}}]+')"
    return (
        f"list_distinct(flatten(list_transform({words}, lambda w: "
        f"list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"
    )


def sim_sql(a: str, b: str) -> str:
    both = f"len(list_intersect({a}, {b}))"
    return f"CASE WHEN len({a}) + len({b}) > 0 THEN {both} / (len({a}) + len({b}) - {both})::DOUBLE ELSE 0 END"


FUZZY_SQL = "q(request, title, artist, genre) AS (VALUES " + ", ".join(
    "(" + ", ".join([str(i)] + [f"'{r[k]}'" if k in r else "NULL" for k in ("title", "artist", "genre")]) + ")" for i, r in enumerate(FUZZY)
) + ")"


@query(
    "b8_fuzzy_search",
    f"""WITH {FUZZY_SQL}, qg AS (SELECT *, CASE WHEN title IS NOT NULL THEN {grams_sql('title')} END AS tg, CASE WHEN artist IS NOT NULL THEN {grams_sql('artist')} END AS ag FROM q),
    pg AS (SELECT *, {grams_sql('p_name')} AS ng, {grams_sql('p_brand')} AS bg FROM part),
    m AS (SELECT request, p_partkey AS song_id, p_type, genre, CASE WHEN title IS NOT NULL THEN {sim_sql('ng', 'tg')} END AS ts,
      CASE WHEN artist IS NOT NULL THEN {sim_sql('bg', 'ag')} END AS a_s FROM pg, qg)
    SELECT request, song_id, round(CASE WHEN ts IS NOT NULL THEN CASE WHEN ts >= 0.8 THEN 3.0::DOUBLE WHEN ts >= 0.5 THEN 2.0::DOUBLE ELSE ts END
      ELSE CASE WHEN a_s >= 0.8 THEN 2.0::DOUBLE WHEN a_s >= 0.5 THEN 1.5::DOUBLE ELSE a_s END END, 6) AS relevance
    FROM m WHERE ts >= 0.3 OR a_s >= 0.3 OR p_type = genre""",
)
def b8(spark, sf):
    hits = search.fuzzy_search(part_catalog(spark, sf), FUZZY, "track_name", "track_artist", "playlist_genre")
    return hits.select("request", "song_id", F.round("relevance", 6).alias("relevance"))


@query(
    "b8_fuzzy_page",
    f"""WITH {FUZZY_SQL}, qg AS (SELECT *, CASE WHEN title IS NOT NULL THEN {grams_sql('title')} END AS tg, CASE WHEN artist IS NOT NULL THEN {grams_sql('artist')} END AS ag FROM q),
    pg AS (SELECT *, {grams_sql('p_name')} AS ng, {grams_sql('p_brand')} AS bg FROM part),
    m AS (SELECT request, p_partkey AS song_id, p_name, p_type, genre, CASE WHEN title IS NOT NULL THEN {sim_sql('ng', 'tg')} END AS ts,
      CASE WHEN artist IS NOT NULL THEN {sim_sql('bg', 'ag')} END AS a_s FROM pg, qg),
    r AS (SELECT *, CASE WHEN ts IS NOT NULL THEN CASE WHEN ts >= 0.8 THEN 3.0::DOUBLE WHEN ts >= 0.5 THEN 2.0::DOUBLE ELSE ts END
      ELSE CASE WHEN a_s >= 0.8 THEN 2.0::DOUBLE WHEN a_s >= 0.5 THEN 1.5::DOUBLE ELSE a_s END END AS relevance FROM m WHERE ts >= 0.3 OR a_s >= 0.3 OR p_type = genre)
    SELECT * FROM (SELECT request, song_id, p_name AS track_name, round(relevance, 6) AS relevance, CAST(row_number() OVER (PARTITION BY request ORDER BY relevance DESC NULLS LAST, p_name, song_id) AS INTEGER) AS place FROM r)
    WHERE place > 5 AND place <= 15""",
)
def b8_page(spark, sf):
    hits = search.fuzzy_search(part_catalog(spark, sf), FUZZY, "track_name", "track_artist", "playlist_genre")
    return search.fuzzy_page(hits, 5, 10).select("request", "song_id", "track_name", F.round("relevance", 6).alias("relevance"), "place")


# Many requests at once: two words of every benchmark text as a title, or a made-up source as an artist.
MANY_SQL = """asked AS (SELECT item_id AS request, CASE WHEN item_id % 3 <> 1 THEN array_to_string(list_slice(string_split(text, ' '), 1, 2), ' ') END AS title,
  CASE WHEN item_id % 3 = 1 THEN 'Src' || item_id END AS artist, CAST(NULL AS VARCHAR) AS genre FROM benchmark)"""


def many_requests(spark, sf):
    nth = F.col("item_id") % 3
    return table(spark, sf, "benchmark").select(
        F.col("item_id").alias("request"), F.when(nth != 1, F.substring_index("text", " ", 2)).alias("title"),
        F.when(nth == 1, F.concat(F.lit("Src"), "item_id")).alias("artist"), F.lit(None).cast("string").alias("genre"),
    )


@query(
    "b8_indexed_search",
    f"""WITH {sp.TEXTS}, {MANY_SQL}, qg AS (SELECT *, CASE WHEN title IS NOT NULL THEN {grams_sql('title')} END AS tg, CASE WHEN artist IS NOT NULL THEN {grams_sql('artist')} END AS ag FROM asked),
    pg AS (SELECT song_id, {grams_sql('track_name')} AS ng, {grams_sql('track_artist')} AS bg FROM songs),
    m AS (SELECT request, song_id, CASE WHEN title IS NOT NULL THEN {sim_sql('ng', 'tg')} END AS ts, CASE WHEN artist IS NOT NULL THEN {sim_sql('bg', 'ag')} END AS a_s FROM pg, qg)
    SELECT request, song_id, round(CASE WHEN ts IS NOT NULL THEN CASE WHEN ts >= 0.8 THEN 3.0::DOUBLE WHEN ts >= 0.5 THEN 2.0::DOUBLE ELSE ts END
      ELSE CASE WHEN a_s >= 0.8 THEN 2.0::DOUBLE WHEN a_s >= 0.5 THEN 1.5::DOUBLE ELSE a_s END END, 6) AS relevance FROM m WHERE ts >= 0.3 OR a_s >= 0.3""",
)
def b8_indexed(spark, sf):
    catalog = texts(spark, sf).drop("lyrics")
    titles, artists = gi.build_index(catalog, "track_name"), gi.build_index(catalog, "track_artist")
    hits = gi.search_many(catalog, many_requests(spark, sf), titles, artists)
    return hits.select("request", "song_id", F.round("relevance", 6).alias("relevance"))


@query(
    "b6_indexed_search",
    f"""WITH {sp.TEXTS}, asked AS (SELECT item_id AS request, string_split(text, ' ')[1] AS text FROM benchmark)
    SELECT request, song_id, track_name FROM songs JOIN asked ON contains(lower(track_name), lower(asked.text))""",
)
def b6_indexed(spark, sf):
    catalog = texts(spark, sf).drop("lyrics")
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("request"), F.substring_index("text", " ", 1).alias("text"))
    index = gi.build_index(catalog, "track_name", raw=True)
    return gi.substring_many(catalog, asked, index, "track_name").select("request", "song_id", "track_name")


@query(
    "b9_exact_lookup",
    """WITH asked AS (SELECT DISTINCT upper(p_name) AS title, lower(p_brand) AS artist FROM part WHERE p_size > 25)
    SELECT title, artist, min(p_partkey) AS song_id FROM asked JOIN part ON lower(title) = lower(p_name) AND lower(artist) = lower(p_brand) GROUP BY ALL""",
)
def b9(spark, sf):
    part = table(spark, sf, "part")
    asked = part.where("p_size > 25").select(F.upper("p_name").alias("title"), F.lower("p_brand").alias("artist")).distinct()
    return search.first_matches(part_catalog(spark, sf), asked, "track_name", "song_id", "track_artist")


@query(
    "b10_genre_page",
    f"WITH {sp.TEXTS} SELECT song_id, track_name, track_artist FROM songs WHERE playlist_genre = 'en' ORDER BY track_name, song_id LIMIT 10 OFFSET 5",
)
def b10(spark, sf):
    rows = texts(spark, sf).where(F.col("playlist_genre") == "en")
    return search.page(rows, ["track_name", "song_id"], 5, 10).select("song_id", "track_name", "track_artist")


@query(
    "b11_feature_ranges",
    f"WITH {sp.SONGS} SELECT song_id, round(tempo, 6) AS tempo, round(energy, 6) AS energy FROM songs WHERE tempo BETWEEN 100 AND 135 AND energy BETWEEN 0.4 AND 0.9",
)
def b11(spark, sf):
    rows = search.in_ranges(songs(spark, sf), tempo=(100, 135), energy=(0.4, 0.9))
    return rows.select("song_id", F.round("tempo", 6).alias("tempo"), F.round("energy", 6).alias("energy"))


@query("b12_exclusion_list", f"WITH {sp.TEXTS} SELECT song_id, track_name FROM songs WHERE song_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def b12(spark, sf):
    bad = table(spark, sf, "labels").where("quality = 0").select(F.col("doc_id").alias("song_id"))
    return search.excluding(texts(spark, sf), bad, "song_id").select("song_id", "track_name")


RAW_FEATURES = {
    "danceability": "26 * danceability", "speechiness": "30 * speechiness", "energy": "10 * energy",
    "valence": "3 * valence - 1", "loudness": "1.5D * loudness", "tempo": "2 * tempo",
}


@query(
    "b13_normalise_ranges",
    f"""WITH {sp.SONGS}, r AS (SELECT song_id, 26 * danceability AS d, 30 * speechiness AS s, 10 * energy AS e, 3 * valence - 1 AS v, 1.5::DOUBLE * loudness AS l, 2 * tempo AS t FROM songs)
    SELECT song_id, round(CASE WHEN d > 1 THEN least(1, greatest(0, d / 26)) ELSE d END, 6) AS danceability, round(CASE WHEN s > 1 THEN least(0.95::DOUBLE, greatest(0, s / 30)) ELSE s END, 6) AS speechiness,
    round(CASE WHEN e > 1 THEN least(1, greatest(0, e / 10)) ELSE e END, 6) AS energy, round(least(1, greatest(0, v)), 6) AS valence, round(greatest(-60, l), 6) AS loudness, round(least(250, t), 6) AS tempo FROM r""",
)
def b13(spark, sf):
    raw = songs(spark, sf).select("song_id", *[F.expr(e).alias(n) for n, e in RAW_FEATURES.items()])
    return raw.select("song_id", *[F.round(c, 6).alias(n) for n, c in audio.normalise_ranges(F.col).items()])


@query(
    "b14_standard_keys",
    f"WITH {sp.SONGS} SELECT song_id, CASE WHEN cluster > 3 THEN 11 ELSE 12 END AS n_keys, round(energy, 6) AS energy, false AS has_extra FROM songs",
)
def b14(spark, sf):
    wide = F.map_concat(audio_map(), F.create_map(F.lit("mfcc_1"), F.lit(0.5), F.lit("chroma"), F.lit(0.1)))
    wide = F.when(F.col("cluster") > 3, F.map_filter(wide, lambda k, v: k != "key")).otherwise(wide)
    kept = songs(spark, sf).select("song_id", shaping.standard_keys(wide).alias("m"))
    return kept.select(
        "song_id", F.size("m").alias("n_keys"), F.round(F.try_element_at("m", F.lit("energy")), 6).alias("energy"),
        F.map_contains_key("m", "chroma").alias("has_extra"),
    )


@query(
    "b15_detect_unnormalised",
    f"WITH {sp.SONGS} SELECT song_id, cluster = 2 OR 2 * danceability > 1 OR 1.8::DOUBLE * speechiness > 1 AS video FROM songs",
)
def b15(spark, sf):
    marker = F.when(F.col("cluster") == 2, "video").otherwise("catalog")
    flag = audio.looks_unnormalised(marker, 2 * F.col("danceability"), 1.8 * F.col("speechiness"))
    return songs(spark, sf).select("song_id", flag.alias("video"))


@query(
    "b16_fixed_vector",
    f"""WITH {sp.SONGS}, v AS (SELECT song_id, list_transform([{', '.join(f"CAST({n} AS DOUBLE)" if n not in ('key', 'tempo') else '0.0::DOUBLE' for n in sp.AUDIO)}], lambda x: round(x, 6)) AS vector FROM songs)
    SELECT song_id, vector FROM v""",
)
def b16(spark, sf):
    partial = F.map_filter(audio_map(), lambda k, v: ~k.isin("key", "tempo"))
    vector = songs(spark, sf).select("song_id", shaping.fixed_vector(partial).alias("v"))
    return vector.select("song_id", F.transform("v", lambda x: F.round(x, 6)).alias("vector"))


@query(
    "b17_variable_vector",
    f"""WITH {sp.SONGS} SELECT song_id, [round(acousticness, 6), round(danceability, 6), round(w2v[1], 6), round(w2v[2], 6), round(tempo, 6)] AS vector FROM songs WHERE cluster <= 3""",
)
def b17(spark, sf):
    w2v = F.when(F.col("cluster") <= 3, F.slice("w2v", 1, 2)).otherwise(F.slice("w2v", 1, 3))
    lists = F.create_map(
        F.lit("danceability"), F.array("danceability"), F.lit("acousticness"), F.array("acousticness"),
        F.lit("mfcc"), w2v, F.lit("tempo"), F.array("tempo"), F.lit("id"), F.array(F.col("song_id").cast("double")),
    )
    rows = songs(spark, sf).select("song_id", shaping.variable_vector(lists).alias("v"))
    return shaping.same_arity(rows, "v", F.lit(5)).select("song_id", F.transform("v", lambda x: F.round(x, 6)).alias("vector"))


@query(
    "b18_default_records",
    "SELECT doc_id, CASE WHEN l.doc_id IS NULL THEN 1 ELSE 0.25 END::DOUBLE AS neu, CASE WHEN l.doc_id IS NULL THEN 0.5 ELSE 0.75 END::DOUBLE AS subjectivity FROM documents LEFT JOIN labels l USING (doc_id)".replace("SELECT doc_id", "SELECT documents.doc_id"),
)
def b18(spark, sf):
    stored = F.when(F.col("quality").isNotNull(), F.create_map(F.lit("neu"), F.lit(0.25), F.lit("subjectivity"), F.lit(0.75)))
    rows = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left")
    record = shaping.with_defaults(stored, shaping.default_sentiment())
    return rows.select("doc_id", record.alias("m")).select(
        "doc_id", F.try_element_at("m", F.lit("neu")).alias("neu"), F.try_element_at("m", F.lit("subjectivity")).alias("subjectivity")
    )


@query(
    "b18_failed_extraction",
    f"WITH {sp.SONGS} SELECT doc_id, CASE WHEN song_id IS NULL THEN 10 ELSE 12 END AS n_keys, round(coalesce(tempo, 0), 6) AS tempo FROM documents LEFT JOIN songs ON song_id = doc_id",
)
def b18_audio(spark, sf):
    stored = songs(spark, sf).select(F.col("song_id").alias("doc_id"), audio_map().alias("m"))
    rows = table(spark, sf, "documents").select("doc_id").join(stored, "doc_id", "left")
    record = rows.select("doc_id", shaping.with_defaults(F.col("m"), shaping.default_audio()).alias("m"))
    return record.select("doc_id", F.size("m").alias("n_keys"), F.round(F.try_element_at("m", F.lit("tempo")), 6).alias("tempo"))


@query(
    "b19_feature_profile",
    f"WITH {sp.SONGS} " + " UNION ALL ".join(f"SELECT song_id, '{n}' AS feature, round(least(1, greatest(0, {n})), 6) AS value FROM songs" for n in sp.PROFILE),
)
def b19(spark, sf):
    return shaping.profile(songs(spark, sf), "song_id").withColumn("value", F.round("value", 6))


@query(
    "b20_check_requests",
    r"""SELECT page_id, CASE WHEN NOT regexp_matches(url, '^https?://(www\.|m\.)?th') THEN 'bad url' WHEN length(regexp_extract(url, '[#=]([a-z0-9]+)$', 1)) < 2 THEN 'text too short'
    WHEN NOT length(html) // 100 BETWEEN 1 AND 100 THEN 'limit out of range' END AS refused FROM pages""",
)
def b20(spark, sf):
    asked = table(spark, sf, "pages").select(
        "page_id", "url", F.regexp_extract("url", "[#=]([a-z0-9]+)$", 1).alias("text"), F.floor(F.length("html") / 100).alias("limit")
    )
    return search.check_requests(asked, "url", "text", "limit", link_pattern=r"^https?://(www\.|m\.)?th").select("page_id", "refused")


@query(
    "b20_check_audio_requests",
    r"""SELECT doc_id, CASE WHEN length(text) < 2 THEN 'text too short' WHEN length(text) > 200 THEN 'text too long'
    WHEN lang <> 'en' AND coalesce((32 * (doc_id % 11))::VARCHAR, '') NOT IN ('64', '96', '128', '192', '256', '320') THEN 'bad quality' END AS refused FROM documents""",
)
def b20_audio(spark, sf):
    asked = table(spark, sf, "documents").select(
        "doc_id", F.concat(F.lit("https://youtu.be/"), "doc_id").alias("url"), "text", F.lit(5).alias("limit"),
        F.when(F.col("lang") != "en", (32 * (F.col("doc_id") % 11)).cast("string")).alias("quality"),
    )
    return search.check_requests(asked, "url", "text", "limit", "quality").select("doc_id", "refused")
