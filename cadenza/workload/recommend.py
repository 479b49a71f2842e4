"""Recommendation products."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.functions import audio, text as tx
from cadenza.operators import aggregates as ag, cells as ce, scoring as sc, spaces as vs
from cadenza.operators.sentiment import lexicon_sentiment
from cadenza.plans import products as pr, similar
from cadenza.session import write_and_read
from cadenza.sources.tables import AUDIO_KEYS, audio_vector, song_view, songs, table
from cadenza.workload import sqlparts as sp
from cadenza.workload.inputs import feature_lexicon, genre_leads, song_cells, song_features
from cadenza.workload.registry import query
from cadenza.workload.similarity import AUDIO_STD, STD_COSINE_SQL, TOP_SQL, audio_space

RESULT = "seed_id, song_id, track_name, track_artist, combined, audio, lyrics, sentiment, rank"


def leads(features):
    return sc.as_seeds(genre_leads(features), similar.SEED_COLUMNS)


@query("d19_similar_songs", f"WITH {sp.BASE}, {sp.scored()}, {sp.refined(5)} SELECT {RESULT} FROM ranked")
def d19(spark, sf):
    features = song_features(spark, sf)
    return similar.similar_songs(features, leads(features), k=5)


# External records: the benchmark texts beside the embedding of the same number, with raw
# extracted feature ranges. Those of one cluster are flagged as instrumentals without words.
EXT_SQL = f"""ext AS (SELECT b.item_id AS song_id, b.text AS lyrics, e.label <> 3 AS sung,
  {sp.u(1)} * 26 AS rd, {sp.u(2)} * 10 AS re, CAST(least(11, floor(12 * {sp.u(3)})) AS INTEGER) AS key, -60 + 60 * {sp.u(4)} AS loudness, CASE WHEN {sp.u(5)} >= 0.5 THEN 1 ELSE 0 END AS mode,
  {sp.u(6)} * 30 AS rs, {sp.u(7)} AS acousticness, {sp.u(8)} AS instrumentalness, {sp.u(9)} AS liveness, {sp.u(10)} AS valence, 60 + 140 * {sp.u(11)} AS tempo,
  CAST(floor(120000 + 180000 * {sp.u(12)}) AS INTEGER) AS duration_ms FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id),
extn AS MATERIALIZED (SELECT *, rd > 1 OR rs > 1 AS video, CASE WHEN rd > 1 THEN least(1, greatest(0, rd / 26)) ELSE rd END AS danceability,
  CASE WHEN re > 1 THEN least(1, greatest(0, re / 10)) ELSE re END AS energy, CASE WHEN rs > 1 THEN least(0.95::DOUBLE, greatest(0, rs / 30)) ELSE rs END AS speechiness FROM ext)"""
EXT_TERMS_SQL = f"""ext_terms AS (SELECT song_id, term, count(*) AS tf FROM (SELECT song_id, unnest(regexp_extract_all({sp.cleaned('lyrics')}, '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM extn) GROUP BY ALL),
ext_totals AS (SELECT song_id, sum(tf * tf) AS sq FROM ext_terms GROUP BY song_id), ext_ids AS (SELECT song_id AS seed_id FROM extn)"""


def external_records(spark, sf):
    texts = table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), "text", F.lit("").alias("lang"), F.lit("").alias("source"))
    raw = song_view(texts, table(spark, sf, "embeddings")).select(
        F.col("song_id").alias("seed_id"), *AUDIO_KEYS, "lyrics", (F.col("cluster") != 3).alias("sung")
    )
    raw = raw.withColumns({"danceability": F.col("danceability") * 26, "speechiness": F.col("speechiness") * 30, "energy": F.col("energy") * 10})
    flagged = raw.withColumn("video", audio.looks_unnormalised(F.lit("file"), F.col("danceability"), F.col("speechiness")))
    return flagged.withColumns(audio.normalise_ranges(F.col))


def external_queries(spark, sf):
    # The records feed the sentiment and the terms; both are small beside the catalog.
    records = write_and_read(external_records(spark, sf), "external-records")
    mood = lexicon_sentiment(records, "seed_id", "lyrics", feature_lexicon(spark, sf))
    worded = F.col("sung") & (F.col("terms_sq") > 0)
    return sc.with_terms(records, "lyrics").withColumn("worded", worded).drop("lyrics", "sung").join(mood, "seed_id")


EXT_SCORED = f"""{sp.lyric_legs('ext_ids', 'ext_terms', 'ext_totals')},
raw AS (SELECT q.song_id AS seed_id, c.song_id, c.track_name, c.track_artist, q.worded, CASE WHEN q.video THEN 0.12 ELSE 0.15 END::DOUBLE AS low,
    CASE WHEN q.video THEN {sp.audio_sim(sp.VIDEO)} ELSE {sp.audio_sim(sp.STANDARD)} END AS ra, coalesce(lyr.lyrics, 0) AS rl,
    CASE WHEN q.worded AND c.cluster <> 2 THEN {sp.mood_cos()} ELSE 0 END AS rs
  FROM (SELECT *, sung AND song_id IN (SELECT song_id FROM ext_terms) AS worded FROM extn JOIN xmood USING (song_id)) q
  CROSS JOIN features c LEFT JOIN lyr ON lyr.seed_id = q.song_id AND lyr.song_id = c.song_id),
scored AS (SELECT * FROM (SELECT *, round(ra, 6) AS audio, round(rl, 6) AS lyrics, round(rs, 6) AS sentiment,
    round(CASE WHEN worded THEN 0.7::DOUBLE * ra + 0.2::DOUBLE * rl + 0.1::DOUBLE * rs ELSE ra END, 6) AS combined FROM raw)
  WHERE audio >= 0.8::DOUBLE * low AND combined >= 0.12::DOUBLE)"""


@query(
    "d20_similar_to_external",
    f"WITH {sp.BASE}, {EXT_SQL}, {EXT_TERMS_SQL}, {sp.sentiment('extn', 'song_id', 'lyrics', 'xmood')}, {EXT_SCORED}, "
    f"{sp.refined(5, audio_floor='low')} SELECT {RESULT} FROM ranked",
)
def d20(spark, sf):
    features = song_features(spark, sf)
    # Songs of one cluster have no stored sentiment.
    catalog = features.withColumns({m: F.when(F.col("cluster") != 2, F.col(m)) for m in similar.MOOD})
    return pr.similar_to_external(catalog, external_queries(spark, sf), k=5)


VIDEO_PAIRS_SQL = f"vp AS (SELECT q.song_id AS seed_id, c.song_id, c.track_name, c.track_artist, round({sp.audio_sim(sp.VIDEO)}, 6) AS audio FROM extn q CROSS JOIN songs c)"


VIDEO_SEARCH_SQL = f"""WITH {sp.SONGS}, {EXT_SQL}, {VIDEO_PAIRS_SQL}, s AS (SELECT *, count(*) OVER (PARTITION BY seed_id) AS n, median(audio) OVER (PARTITION BY seed_id) AS med FROM vp WHERE audio >= 0.096::DOUBLE),
    f AS (SELECT *, n > 10 AS many, audio >= greatest(0.12::DOUBLE, med * 0.85::DOUBLE) AS good FROM s), g AS (SELECT *, count(*) FILTER (WHERE good) OVER (PARTITION BY seed_id) AS ok FROM f)
    SELECT seed_id, song_id, track_name, track_artist, audio AS combined, audio, 0.0::DOUBLE AS lyrics, 0.0::DOUBLE AS sentiment, rank FROM
    (SELECT *, CAST(row_number() OVER (PARTITION BY seed_id ORDER BY audio DESC, song_id) AS INTEGER) AS rank FROM g WHERE NOT many OR good OR ok < 5) WHERE rank <= 5"""


@query("d21_video_audio_search", VIDEO_SEARCH_SQL)
def d21(spark, sf):
    return pr.similar_by_video_audio(songs(spark, sf), external_records(spark, sf), k=5)


@query("d21_bounded_search", VIDEO_SEARCH_SQL)
def d21_bounded(spark, sf):
    found = ce.nearest_by_audio(
        song_cells(spark, sf), external_records(spark, sf), 5, audio.VIDEO_WEIGHTS, sc.MIN_VIDEO_AUDIO * sc.START_FACTOR, exclude_self=False
    )
    return pr.video_results(found.best, songs(spark, sf))


MOOD_ROWS = ", ".join(
    f"('{m}', [" + ", ".join(f"{float(p.get(n, 0.0))}::DOUBLE" for n in sp.AUDIO) + "])" for m, p in sp.MOODS.items()
)


@query(
    "d22_mood_prototypes",
    f"""WITH {sp.SONGS}, {AUDIO_STD}, moods(mood, p) AS (VALUES {MOOD_ROWS}), q AS (SELECT mood, list_transform(list_zip(p, m, s), lambda z: (z[1] - z[2]) / z[3]) AS v FROM moods, a_l),
    sc AS (SELECT mood, song_id, round({sp.cos('q.v', 'a.v')}, 6) AS score FROM q, a) SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY mood ORDER BY score DESC, song_id) AS INTEGER) AS rank FROM sc) WHERE rank <= 5""",
)
def d22(spark, sf):
    return pr.songs_for_moods(songs(spark, sf).select("song_id", audio_vector().alias("v")), list(pr.MOODS), 5)


def mood_distance_sql(mood, p):
    return f"STRUCT_PACK(d := sqrt({' + '.join(f'({n} - {w}::DOUBLE) * ({n} - {w}::DOUBLE)' for n, w in p.items())}), m := '{mood}')"


PAGE_SQL = "(SELECT song_id AS seed_id FROM songs WHERE playlist_genre = 'de' ORDER BY track_name, song_id LIMIT 10)"


@query(
    "d23_genre_page_recommendations",
    f"WITH {sp.base(f'leads AS {PAGE_SQL}')}, {sp.scored()}, {sp.refined(5)} SELECT {RESULT} FROM ranked",
)
def d23(spark, sf):
    return pr.recommend_for_page(song_features(spark, sf), F.col("playlist_genre") == "de")


# A song's mood is that of the nearest prototype.
MOOD_PAGE_SQL = f"""moody AS (SELECT song_id, track_name, list_sort([{', '.join(mood_distance_sql(m, p) for m, p in sp.MOODS.items())}])[1].m AS mood FROM songs),
leads AS (SELECT song_id AS seed_id FROM moody WHERE mood = 'romantic' ORDER BY track_name, song_id LIMIT 10 OFFSET 5)"""


@query(
    "d23_mood_page_recommendations",
    f"WITH {sp.base(MOOD_PAGE_SQL)}, {sp.scored()}, {sp.refined(5)} SELECT {RESULT} FROM ranked",
)
def d23_mood(spark, sf):
    mood = pr.predicted_mood({n: F.col(n) for n in ("valence", "energy", "danceability")})
    return pr.recommend_for_page(song_features(spark, sf), mood == "romantic", 5, 10)


NAMED_SQL = """named AS (SELECT track_name AS title FROM (SELECT *, row_number() OVER (PARTITION BY track_artist ORDER BY track_name, song_id) AS r FROM songs) WHERE r = 1),
leads AS (SELECT DISTINCT seed_id FROM (SELECT lower(title) AS t, min(song_id) AS seed_id FROM named JOIN songs ON lower(track_name) = lower(title) GROUP BY ALL))"""


@query(
    "d24_recommend_by_name",
    f"WITH {sp.base(NAMED_SQL)}, {sp.scored()}, {sp.refined(5)} SELECT {RESULT} FROM ranked",
)
def d24(spark, sf):
    features = song_features(spark, sf)
    first = features.groupBy("track_artist").agg(F.min(F.struct("track_name", "song_id")).alias("f"))
    named = first.select(F.col("f.track_name").alias("title")).distinct()
    return pr.recommend_by_name(features, named)


@query(
    "d25_mood_lists",
    f"""WITH {sp.BASE} SELECT * FROM (SELECT 'happy' AS mood, song_id, compound FROM features ORDER BY compound DESC, song_id LIMIT 10)
    UNION ALL SELECT * FROM (SELECT 'sad' AS mood, song_id, compound FROM features ORDER BY compound, song_id LIMIT 10)""",
)
def d25(spark, sf):
    features = song_features(spark, sf).select("song_id", "compound")
    return pr.mood_list(features, "happy").select(F.lit("happy").alias("mood"), "*").unionByName(
        pr.mood_list(features, "sad").select(F.lit("sad").alias("mood"), "*")
    )


@query(
    "d26_playlist",
    f"""WITH {sp.BASE}, {sp.scored()}, once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seed_id, track_name, track_artist ORDER BY combined DESC, song_id) AS copy FROM scored) WHERE copy = 1)
    SELECT {RESULT} FROM (SELECT *, {TOP_SQL.format('combined')} FROM once) WHERE rank <= 20""",
)
def d26(spark, sf):
    features = song_features(spark, sf)
    return pr.playlist(features, leads(features), 20)


@query(
    "d27_genre_restricted",
    f"""WITH {sp.BASE}, {sp.scored(among="c.playlist_genre = 'fr'")}, {sp.refined(5)} SELECT {RESULT} FROM ranked""",
)
def d27(spark, sf):
    features = song_features(spark, sf)
    return similar.similar_songs(features.where("playlist_genre = 'fr'"), leads(features), k=5)


TOP_STD = f"WITH {sp.SONGS}, {sp.LEADS}, {AUDIO_STD}, {STD_COSINE_SQL}, t AS (SELECT * FROM (SELECT *, {TOP_SQL.format('score')} FROM cosines) WHERE rank <= 10)"


@query(
    "d28_component_split",
    f"""{TOP_STD} SELECT seed_id, t.song_id, round(score * 0.6::DOUBLE, 6) AS audio, round(CASE WHEN cluster < 3 THEN score * 0.4::DOUBLE ELSE 0 END, 6) AS lyrics,
    CASE WHEN cluster < 4 THEN 'https://www.youtube.com/watch?v=' || substr(md5(track_name), 1, 11) END AS link FROM t JOIN songs USING (song_id)""",
)
def d28(spark, sf):
    near = vs.cosine_neighbours(*audio_space(spark, sf), k=10)
    rows = near.join(songs(spark, sf).select("song_id", "track_name", "cluster"), "song_id")
    url = F.when(F.col("cluster") < 4, F.concat(F.lit("https://www.youtube.com/watch?v="), F.substring(F.md5("track_name"), 1, 11)))
    made = rows.select(
        "seed_id", "song_id", pr.component_split(F.col("score"), F.col("cluster") < 3).alias("parts"), pr.external_links(url).alias("links")
    )
    return made.select(
        "seed_id", "song_id", *[F.round(F.col(f"parts.{p}"), 6).alias(p) for p in ("audio", "lyrics")], F.col("links.youtube").alias("link")
    )


@query(
    "d29_estimated_components",
    f"{TOP_STD} SELECT seed_id, song_id, round(score * 0.8::DOUBLE + 0.1::DOUBLE, 6) AS audio, round(score * 0.7::DOUBLE + 0.2::DOUBLE, 6) AS lyrics, round(score * 0.6::DOUBLE + 0.3::DOUBLE, 6) AS sentiment FROM t",
)
def d29(spark, sf):
    near = vs.cosine_neighbours(*audio_space(spark, sf), k=10)
    return near.select("seed_id", "song_id", *[F.round(c, 6).alias(n) for n, c in pr.estimated_components(F.col("score")).items()])


@query(
    "d30_analysis_report",
    f"""WITH {sp.BASE} SELECT song_id, round(energy, 6) AS energy, round(valence, 6) AS valence, neg, neu, pos, compound, list_position(topics, list_max(topics))::BIGINT - 1 AS top_topic,
    list_sort([{', '.join(mood_distance_sql(m, p) for m, p in sp.MOODS.items())}])[1].m AS mood FROM features""",
)
def d30(spark, sf):
    features = song_features(spark, sf)
    mood = pr.predicted_mood({n: F.col(n) for n in ("valence", "energy", "danceability")})
    return features.select(
        "song_id", F.round("energy", 6).alias("energy"), F.round("valence", 6).alias("valence"), *similar.MOOD,
        (F.array_position("topics", F.array_max("topics")) - 1).alias("top_topic"), mood.alias("mood"),
    )


@query(
    "e5_similarity_distribution",
    f"""WITH {sp.SONGS}, {EXT_SQL}, {VIDEO_PAIRS_SQL} SELECT seed_id, count(*) AS n, min(audio) AS lowest, max(audio) AS highest, round(avg(audio), 6) AS mean, round(median(audio), 6) AS median,
    {', '.join(f"count(*) FILTER (WHERE audio >= 0.{i}) AS at_0{i}, round(100 * count(*) FILTER (WHERE audio >= 0.{i}) / count(*)::DOUBLE, 6) AS share_0{i}" for i in range(1, 6))} FROM vp GROUP BY seed_id""",
)
def e5(spark, sf):
    pairs = pr.video_audio_pairs(songs(spark, sf), external_records(spark, sf))
    return ag.similarity_distribution(pairs, "seed_id", "audio")


@query(
    "e6_histogram",
    f"""WITH {sp.SONGS}, {EXT_SQL}, {VIDEO_PAIRS_SQL}, bins AS (SELECT unnest(range(10)) AS bin), h AS (SELECT least(floor(audio * 10), 9)::BIGINT AS bin, count(*) AS n FROM vp WHERE audio BETWEEN 0 AND 1 GROUP BY 1)
    SELECT bin, coalesce(n, 0) AS n FROM bins LEFT JOIN h USING (bin)""",
)
def e6(spark, sf):
    return ag.histogram(pr.video_audio_pairs(songs(spark, sf), external_records(spark, sf)), "audio")


@query(
    "e7_refinement_statistics",
    f"""WITH {sp.BASE}, {sp.scored()} SELECT seed_id, count(*) AS n, {', '.join(f"round(median({m}), 6) AS {m}_median, round(stddev_pop({m}), 6) AS {m}_std, round(avg({m}), 6) AS {m}_mean" for m in ('audio', 'combined'))} FROM scored GROUP BY seed_id""",
)
def e7(spark, sf):
    features = song_features(spark, sf)
    profile = sc.score_profile(similar.score_pairs(features, leads(features)), ["seed_id"], ["audio", "combined"])
    return profile.select("seed_id", "n", *[F.round(c, 6).alias(c) for c in profile.columns if c not in ("seed_id", "n")])


@query("e12_result_quality", f"WITH {sp.BASE}, {sp.scored()}, {sp.refined(5)} SELECT seed_id, count(*) AS n, round(avg(combined), 6) AS quality FROM ranked GROUP BY seed_id")
def e12(spark, sf):
    features = song_features(spark, sf)
    return ag.result_quality(similar.similar_songs(features, leads(features), k=5), "seed_id", "combined")


@query("f5_refinement", f"WITH {sp.BASE}, {sp.scored()}, {sp.refined(40)} SELECT seed_id, song_id, combined, rank FROM ranked")
def f5(spark, sf):
    features = song_features(spark, sf)
    ranked = sc.refine_and_rank(similar.score_pairs(features, leads(features)), ["seed_id"], 40)
    return ranked.select("seed_id", "song_id", "combined", "rank")


@query(
    "f6_threshold_sweep",
    f"""WITH {sp.BASE}, {sp.scored()}, levels AS (SELECT s.*, level, 0.15::DOUBLE + 0.05::DOUBLE * level AS low FROM scored s, (SELECT unnest(range(4))::INTEGER AS level)),
    pass AS (SELECT * FROM levels WHERE audio >= 0.8::DOUBLE * low AND combined >= 0.8::DOUBLE * low), {sp.refined(5, 'seed_id, level', source='pass', audio_floor='low', floor='low')},
    quality AS (SELECT seed_id, level, round(avg(combined), 6) AS mean, count(*) AS n FROM ranked GROUP BY ALL), best AS (SELECT seed_id, level FROM (SELECT *, row_number() OVER (PARTITION BY seed_id ORDER BY mean DESC, level) AS r
      FROM quality WHERE level = 0 OR n >= 3.5) WHERE r = 1)
    SELECT seed_id, level, song_id, combined, rank FROM ranked JOIN best USING (seed_id, level)""",
)
def f6(spark, sf):
    features = song_features(spark, sf)
    swept = pr.threshold_sweep(similar.score_pairs(features, leads(features)), k=5)
    return swept.select("seed_id", "level", "song_id", "combined", "rank")


@query(
    "h15_explained_results",
    f"""WITH {sp.BASE}, {sp.scored()}, {sp.refined(5)}, p AS (SELECT *, list_filter([CASE WHEN audio > 0.7 THEN 'very similar sound profile' WHEN audio > 0.5 THEN 'similar sound profile' END,
      CASE WHEN lyrics > 0.7 THEN 'very similar lyrical themes' WHEN lyrics > 0.5 THEN 'similar lyrical themes' END,
      CASE WHEN sentiment > 0.7 THEN 'matching emotional tone' WHEN sentiment > 0.5 THEN 'similar emotional tone' END], lambda x: x IS NOT NULL) AS why FROM ranked)
    SELECT seed_id, song_id, 'Recommended because of ' || CASE WHEN len(why) = 0 THEN 'overall similarity' ELSE array_to_string(why, ' and ') END AS reason,
      CASE WHEN combined >= 0.7 THEN 'high' WHEN combined >= 0.4 THEN 'medium' ELSE 'low' END AS band FROM p""",
)
def h15(spark, sf):
    features = song_features(spark, sf)
    found = similar.similar_songs(features, leads(features), k=5)
    return found.select("seed_id", "song_id", *[c.alias(n) for n, c in pr.explanation_columns().items()])


@query(
    "h16_score_contributions",
    f"""WITH {sp.BASE}, {sp.scored()}, {sp.refined(5)} """
    + " UNION ALL ".join(
        f"SELECT seed_id, song_id, '{leg}' AS component, round({w}::DOUBLE * {leg}, 6) AS contribution, CASE WHEN {leg} >= 0.7 THEN 'high' WHEN {leg} >= 0.4 THEN 'medium' ELSE 'low' END AS band FROM ranked"
        for leg, w in (("audio", 0.7), ("lyrics", 0.2), ("sentiment", 0.1))
    ),
)
def h16(spark, sf):
    features = song_features(spark, sf)
    found = similar.similar_songs(features, leads(features), k=5)
    long = found.unpivot(["seed_id", "song_id"], ["audio", "lyrics", "sentiment"], "component", "score")
    weight = F.create_map(*[c for leg, w in sc.DEFAULT_WEIGHTS.items() for c in (F.lit(leg), F.lit(w))])
    contribution = F.round(F.element_at(weight, F.col("component")) * F.col("score"), 6)
    return long.select("seed_id", "song_id", "component", contribution.alias("contribution"), tx.score_band(F.col("score")).alias("band"))
