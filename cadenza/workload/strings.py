"""Scalar string, date and comparison functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.functions import coerce, text as tx
from cadenza.sources.tables import table, texts
from cadenza.workload import sqlparts as sp
from cadenza.workload.registry import query

MARKED_SQL = "marked AS (SELECT doc_id, CASE WHEN lang = 'en' THEN '[Chorus] ' || text || chr(10) || chr(10) || ' [Verse 2: x] ' || text ELSE text END AS text FROM documents)"


def marked(spark, sf):
    """Documents, the English ones with section markers and a second stanza."""
    text = F.when(
        F.col("lang") == "en", F.concat(F.lit("[Chorus] "), "text", F.lit("\n\n [Verse 2: x] "), "text")
    ).otherwise(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", text.alias("text"))


@query(
    "h1_clean_to_words",
    r"""SELECT doc_id, array_to_string(regexp_extract_all(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}_\s\p{Z}]', ' ', 'g'), '\p{Nd}+', ' ', 'g'), '[\p{L}\p{N}_]+'), ' ') AS clean FROM documents""",
)
def h1(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.clean_to_words(F.col("text")).alias("clean"))


@query("h2_clean_for_similarity", f"WITH {MARKED_SQL} SELECT doc_id, {sp.cleaned('text')} AS clean FROM marked")
def h2(spark, sf):
    return marked(spark, sf).select("doc_id", tx.clean_for_similarity(F.col("text")).alias("clean"))


@query(
    "h3_clean_to_line",
    f"WITH {MARKED_SQL} " + r"SELECT doc_id, trim(regexp_replace(regexp_replace(text, '\[[^\]\n]*\]', '', 'g'), '[\s\p{Z}]+', ' ', 'g')) AS clean FROM marked",
)
def h3(spark, sf):
    return marked(spark, sf).select("doc_id", tx.clean_to_line(F.col("text")).alias("clean"))


STRIP = r"regexp_replace({0}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+\z', '', 'g')"


@query(
    "h4_clean_lines",
    f"WITH {MARKED_SQL} SELECT doc_id, array_to_string(list_filter(list_transform(string_split(regexp_replace(text, '\\[[^\\]\\n]*\\]', '', 'g'), chr(10)), lambda l: {STRIP.format('l')}), lambda l: l <> ''), chr(10)) AS clean FROM marked",
)
def h4(spark, sf):
    return marked(spark, sf).select("doc_id", tx.clean_lines(F.col("text")).alias("clean"))


STOP_WORDS = ["the", "and", "of", "to", "in", "de", "la", "el", "que", "und", "der", "die", "le", "les", "un", "a"]


@query(
    "h5_word_tokens",
    f"SELECT doc_id, list_filter({sp.word_tokens('text')}, lambda t: t NOT IN ({sp.quoted(STOP_WORDS)})) AS tokens FROM documents",
)
def h5(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.words(F.col("text"), STOP_WORDS).alias("tokens"))


DRESSED_SQL = "CASE WHEN p_size > 40 THEN upper(p_name) || ' (Live 2020) [HD] Official Video!' WHEN p_size > 20 THEN 'After ' || p_name || ' feat. ' || p_brand ELSE p_name || '  - Lyrics' END"


@query("h6_normalise_title", f"SELECT p_partkey, {sp.normalised_title(DRESSED_SQL)} AS title FROM part")
def h6(spark, sf):
    title = F.when(F.col("p_size") > 40, F.concat(F.upper("p_name"), F.lit(" (Live 2020) [HD] Official Video!"))).when(
        F.col("p_size") > 20, F.concat(F.lit("After "), "p_name", F.lit(" feat. "), "p_brand")
    ).otherwise(F.concat("p_name", F.lit("  - Lyrics")))
    return table(spark, sf, "part").select("p_partkey", tx.normalise_title(title).alias("title"))


@query(
    "h8_description_fields",
    """SELECT p_partkey, CASE WHEN p_size > 30 THEN p_name || ' mix' WHEN p_size > 10 THEN p_name END AS song, CASE WHEN p_size > 30 THEN p_type WHEN p_size > 20 THEN p_brand END AS artist FROM part""",
)
def h8(spark, sf):
    nl = F.lit("\n")
    lines = F.concat_ws(
        "\n", F.lit("Thanks for watching"),
        F.when(F.col("p_size") > 10, F.concat(F.lit("SONG: "), "p_name", F.lit("  "))),
        F.when(F.col("p_size") > 20, F.concat(F.lit("Artist "), "p_brand")),
        F.when(F.col("p_size") > 30, F.concat(F.lit("Music: "), "p_type", F.lit(" - "), "p_name", F.lit(" mix"))),
    )
    text = F.concat(lines, nl, F.lit("bye"))
    return table(spark, sf, "part").select("p_partkey", tx.described_song(text).alias("song"), tx.described_artist(text).alias("artist"))


@query(
    "h9_artist_title_split",
    "SELECT p_partkey, CASE WHEN p_size > 25 THEN p_brand ELSE p_type END AS artist, CASE WHEN p_size > 25 THEN p_name || ' - live' ELSE p_name END AS title FROM part",
)
def h9(spark, sf):
    title = F.when(F.col("p_size") > 25, F.concat_ws(" - ", "p_brand", "p_name", F.lit("live"))).otherwise(F.col("p_name"))
    artist, rest = tx.split_artist_title(title, F.col("p_type"))
    return table(spark, sf, "part").select("p_partkey", artist.alias("artist"), rest.alias("title"))


LINK_SQL = """CASE WHEN contains(url, '?') THEN 'https://www.youtube.com/watch?v=' || substr(md5(url), 1, 11) || '&t=1' WHEN contains(url, '#') THEN 'https://youtu.be/' || substr(md5(url), 1, 11) ELSE url END"""


@query(
    "h10_video_links",
    f"""WITH l AS (SELECT page_id, {LINK_SQL} AS link FROM pages), i AS (SELECT page_id, coalesce(nullif(regexp_extract(link, '(?:v=|/)([0-9A-Za-z_-]{{11}}).*', 1), ''),
      nullif(regexp_extract(link, '(?:embed/)([0-9A-Za-z_-]{{11}})', 1), ''), nullif(regexp_extract(link, '(?:youtu\\.be/)([0-9A-Za-z_-]{{11}})', 1), '')) AS id FROM l)
    SELECT page_id, id, 'https://img.youtube.com/vi/' || id || '/hqdefault.jpg' AS thumbnail FROM i""",
)
def h10(spark, sf):
    vid = F.substring(F.md5("url"), 1, 11)
    link = F.when(F.contains("url", F.lit("?")), F.concat(F.lit("https://www.youtube.com/watch?v="), vid, F.lit("&t=1"))).when(
        F.contains("url", F.lit("#")), F.concat(F.lit("https://youtu.be/"), vid)
    ).otherwise(F.col("url"))
    rows = table(spark, sf, "pages").select("page_id", link.alias("link"))
    return rows.select("page_id", tx.video_id(F.col("link")).alias("id"), tx.thumbnail_url(F.col("link")).alias("thumbnail"))


@query(
    "h11_url_slug",
    f"WITH {sp.TEXTS} " + r"SELECT song_id, 'https://www.azlyrics.com/lyrics/' || replace(regexp_replace(lower(track_artist), '[^\p{L}\p{N}_\s\p{Z}\-]', '', 'g'), ' ', '') || '/' || replace(regexp_replace(lower(track_name), '[^\p{L}\p{N}_\s\p{Z}\-]', '', 'g'), ' ', '') || '.html' AS url FROM songs",
)
def h11(spark, sf):
    url = F.concat(
        F.lit("https://www.azlyrics.com/lyrics/"), tx.url_slug(F.col("track_artist")), F.lit("/"), tx.url_slug(F.col("track_name")), F.lit(".html")
    )
    return texts(spark, sf).select("song_id", url.alias("url"))


@query("h12_title_from_file", r"SELECT p_partkey, regexp_replace(p_partkey || '_- ' || p_name || CASE WHEN p_size > 25 THEN '.v2' ELSE '' END, '^[\d_\-\s]+', '') AS title FROM part")
def h12(spark, sf):
    path = F.concat(
        F.lit("/audio/"), F.col("p_partkey"), F.lit("_- "), "p_name", F.when(F.col("p_size") > 25, ".v2").otherwise(""), F.lit(".mp3")
    )
    return table(spark, sf, "part").select("p_partkey", tx.title_from_file(path).alias("title"))


@query(
    "h12_file_pattern",
    f"WITH {sp.TEXTS} " + r"SELECT song_id, replace(regexp_replace(track_name, '[^\p{L}\p{N}_\s\p{Z}\-]', '', 'g'), ' ', '_') AS pattern FROM songs",
)
def h12_pattern(spark, sf):
    return texts(spark, sf).select("song_id", tx.file_pattern(F.col("track_name")).alias("pattern"))


@query(
    "h13_sections",
    f"WITH {MARKED_SQL} " + r"""SELECT doc_id, list_transform(regexp_extract_all(text, '\[([^\]\n]*)\]', 1), lambda m: m || CASE WHEN contains(lower(m), 'chorus') THEN '!' ELSE '' END) AS markers,
    len(list_filter(regexp_split_to_array(text, '\n\s*\n'), lambda s: regexp_matches(s, '[^\s\p{Z}]')))::INTEGER AS n_stanzas FROM marked""",
)
def h13(spark, sf):
    marks = F.transform(
        tx.section_markers(F.col("text")), lambda m: F.concat(m["marker"], F.when(m["chorus"], "!").otherwise(""))
    )
    return marked(spark, sf).select("doc_id", marks.alias("markers"), F.size(tx.stanzas(F.col("text"))).alias("n_stanzas"))


@query(
    "h14_duration_text",
    "SELECT o_orderkey, (floor(o_totalprice * 20 / 60000)::BIGINT % 60)::VARCHAR || ':' || lpad((floor(o_totalprice * 20 / 1000)::BIGINT % 60)::VARCHAR, 2, '0') AS duration FROM orders",
)
def h14(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", tx.duration_text(F.col("o_totalprice") * 20).alias("duration"))


@query("h17_search_text", "SELECT p_partkey, p_name || ' ' || p_brand || ' official audio' AS query FROM part")
def h17(spark, sf):
    return table(spark, sf, "part").select("p_partkey", tx.search_text(F.col("p_name"), F.col("p_brand")).alias("query"))


@query(
    "h18_age_predicates",
    "WITH a AS (SELECT *, TIMESTAMP '2024-01-31 00:00:00' AS now FROM events) SELECT event_id, ts < now - INTERVAL 7 DAY AS over_7d, ts < now - INTERVAL 30 DAY AS over_30d, ts < now - INTERVAL 24 HOUR AS over_24h, ts < now - INTERVAL 6 HOUR AS over_6h FROM a",
)
def h18(spark, sf):
    as_of = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
    ages = {"over_7d": "7 DAYS", "over_30d": "30 DAYS", "over_24h": "24 HOURS", "over_6h": "6 HOURS"}
    return table(spark, sf, "events").select(
        "event_id", *[(F.col("ts") < as_of - F.expr(f"INTERVAL {age}")).alias(name) for name, age in ages.items()]
    )


@query(
    "h19_tolerant_compare",
    """WITH r AS (SELECT event_id, value::VARCHAR AS a, CASE event_type WHEN 'error' THEN event_type WHEN 'click' THEN '9' ELSE '10.5' END AS b FROM events)
    SELECT event_id, coalesce(TRY_CAST(a AS DOUBLE) < TRY_CAST(b AS DOUBLE), a < b) AS less, coalesce(TRY_CAST(a AS DOUBLE) = TRY_CAST(b AS DOUBLE), a = b) AS same FROM r""",
)
def h19(spark, sf):
    a = F.col("value").cast("string")
    b = F.when(F.col("event_type") == "error", F.col("event_type")).when(F.col("event_type") == "click", "9").otherwise("10.5")
    return table(spark, sf, "events").select(
        "event_id", coerce.tolerant_compare(a, b, "<").alias("less"), coerce.tolerant_compare(a, b, "==").alias("same")
    )


@query("h21_rename_keys", "SELECT doc_id, quality::DOUBLE AS positive, toxic::DOUBLE AS negative, 0.5::DOUBLE AS compound, 3 AS n_keys FROM labels")
def h21(spark, sf):
    record = F.create_map(
        F.lit("pos"), F.col("quality").cast("double"), F.lit("neg"), F.col("toxic").cast("double"), F.lit("compound"), F.lit(0.5)
    )
    rows = table(spark, sf, "labels").select("doc_id", tx.rename_keys(record, tx.LONG_SENTIMENT_KEYS).alias("m"))
    return rows.select(
        "doc_id", *[F.try_element_at("m", F.lit(k)).alias(k) for k in ("positive", "negative", "compound")], F.size("m").alias("n_keys")
    )
