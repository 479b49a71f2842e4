"""Similarity scores and neighbour searches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.functions import arrays, audio as au
from cadenza.operators import cells as ce, neighbour_index as ni, scoring as sc, spaces as vs
from cadenza.plans import similar
from cadenza.session import write_and_read
from cadenza.sources.tables import AUDIO_KEYS, audio_vector, songs, table, texts
from cadenza.workload import sqlparts as sp
from cadenza.workload.inputs import genre_leads, song_cells, song_features
from cadenza.workload.registry import query

PAIRS_SQL = "FROM leads JOIN songs q ON q.song_id = seed_id JOIN songs c ON c.song_id <> q.song_id"
TOP_SQL = "CAST(row_number() OVER (PARTITION BY seed_id ORDER BY {0} DESC, song_id) AS INTEGER) AS rank"


def audio_pairs(spark, sf):
    catalog = songs(spark, sf)
    return sc.audio_pairs(
        catalog.select("song_id", *AUDIO_KEYS), sc.as_seeds(genre_leads(catalog), AUDIO_KEYS)
    )


def top5(scored: DataFrame, column: str, k: int = 5) -> DataFrame:
    return sc.top_k(scored, ["seed_id"], [F.desc(column), F.asc("song_id")], k)


def best_sql(source: str, column: str, k: int = 50) -> str:
    """The ``k`` best rows per seed of a subquery or table."""
    return f"SELECT * FROM (SELECT *, {TOP_SQL.format(column)} FROM {source}) WHERE rank <= {k}"


def audio_sql(weights):
    return f"""WITH {sp.SONGS}, {sp.LEADS}, s AS (SELECT q.song_id AS seed_id, c.song_id, round({sp.audio_sim(weights)}, 6) AS audio {PAIRS_SQL})
    SELECT * FROM (SELECT *, {TOP_SQL.format('audio')} FROM s) WHERE rank <= 5"""


@query("d1_audio_similarity", audio_sql(sp.STANDARD))
def d1(spark, sf):
    scored = audio_pairs(spark, sf).select("seed.seed_id", "song_id", sc.score_round(sc.audio_score()).alias("audio"))
    return top5(scored, "audio")


@query("d1_bounded_search", audio_sql(sp.STANDARD))
def d1_bounded(spark, sf):
    catalog = songs(spark, sf).select("song_id", "track_name", "playlist_genre", *AUDIO_KEYS)
    kept = song_cells(spark, sf)
    return ce.nearest_by_audio(kept, sc.as_seeds(genre_leads(catalog), AUDIO_KEYS), 5).best


@query("d2_video_audio_similarity", audio_sql(sp.VIDEO))
def d2(spark, sf):
    scored = audio_pairs(spark, sf).select("seed.seed_id", "song_id", sc.score_round(sc.audio_score(au.VIDEO_WEIGHTS)).alias("audio"))
    return top5(scored, "audio")


# Records that lack features: two have too few in common, some miss one.
def missing_sql(side: str, name: str) -> str:
    if name in ("danceability", "energy", "tempo", "valence", "acousticness", "instrumentalness", "loudness"):
        return f"{side}.cluster <> 1"
    return f"{side}.cluster <> 3" if name == "liveness" else "true"


def partial_sql() -> str:
    both = {n: f"({missing_sql('q', n)} AND {missing_sql('c', n)})" for n in sp.STANDARD}
    common = " + ".join(f"CASE WHEN {b} THEN 1 ELSE 0 END" for b in both.values())
    used = " + ".join(f"CASE WHEN {b} THEN {sp.STANDARD[n]}::DOUBLE ELSE 0 END" for n, b in both.items())
    score = " + ".join(f"CASE WHEN {b} THEN {sp.STANDARD[n]}::DOUBLE * ({sp.feature_sim(n, 'q', 'c')}) ELSE 0 END" for n, b in both.items())
    return f"CASE WHEN {common} < 3 THEN 0 ELSE ({score}) / ({used}) END"


@query(
    "d1_partial_records",
    f"WITH {sp.SONGS}, {sp.LEADS}, s AS (SELECT q.song_id AS seed_id, c.song_id, round({partial_sql()}, 6) AS audio {PAIRS_SQL}) {best_sql('s', 'audio')}",
)
def d1_partial(spark, sf):
    catalog = songs(spark, sf).select("song_id", "track_name", "playlist_genre", "cluster", *AUDIO_KEYS)
    pairs = sc.against_seeds(catalog, sc.as_seeds(genre_leads(catalog), [*AUDIO_KEYS, "cluster"]))

    def present(prefix):
        def test(name):
            cluster = F.col(f"{prefix}cluster")
            if name in ("speechiness", "liveness"):
                return cluster != 3 if name == "liveness" else F.lit(True)
            return cluster != 1

        return test

    score = au.partial_similarity(lambda n: F.col(f"seed.{n}"), F.col, (present("seed."), present("")))
    return top5(pairs.select("seed.seed_id", "song_id", sc.score_round(score).alias("audio")), "audio", 50)


@query(
    "d3_tempo_similarity",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(CASE WHEN g <= 5 THEN 1 WHEN g <= 20 THEN 1 - (g - 5) / 15 ELSE greatest(0, 1 - g / 40) END, 9) AS similarity FROM
    (SELECT *, least(abs(l_quantity * 4 - t), abs(l_quantity * 4 - 2 * t), abs(l_quantity * 4 - 0.5::DOUBLE * t)) AS g FROM (SELECT *, l_extendedprice / 500 AS t FROM lineitem))""",
)
def d3(spark, sf):
    seed, other = F.col("l_quantity") * 4, F.col("l_extendedprice") / 500
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(au.tempo_similarity(seed, other), 9).alias("similarity")
    )


@query(
    "d4_loudness_similarity",
    f"WITH {sp.SONGS}, {sp.LEADS}, s AS (SELECT q.song_id AS seed_id, c.song_id, round(1 - least(1, abs(q.loudness - c.loudness) / 20), 6) AS similarity {PAIRS_SQL}) {best_sql('s', 'similarity')}",
)
def d4(spark, sf):
    sim = au.range_similarity(F.col("seed.loudness"), F.col("loudness"), 20.0)
    return top5(audio_pairs(spark, sf).select("seed.seed_id", "song_id", sc.score_round(sim).alias("similarity")), "similarity", 50)


@query(
    "d5_score_breakdown",
    f"""WITH {sp.SONGS}, {sp.LEADS}, s AS (SELECT q.song_id AS seed_id, c.song_id, round({sp.audio_sim(sp.STANDARD)}, 6) AS audio,
      {', '.join(f"round({sp.feature_sim(n, 'q', 'c')}, 6) AS {n}" for n in sp.STANDARD)} {PAIRS_SQL}),
    t AS (SELECT * FROM (SELECT *, {TOP_SQL.format('audio')} FROM s) WHERE rank <= 5)
    """ + " UNION ALL ".join(f"SELECT seed_id, song_id, rank, '{n}' AS feature, {n} AS similarity FROM t" for n in sp.STANDARD),
)
def d5(spark, sf):
    parts = {n: sc.score_round(au.feature_similarity(n, F.col(f"seed.{n}"), F.col(n))).alias(n) for n in au.STANDARD_WEIGHTS}
    scored = audio_pairs(spark, sf).select("seed.seed_id", "song_id", sc.score_round(sc.audio_score()).alias("audio"), *parts.values())
    return top5(scored, "audio").unpivot(["seed_id", "song_id", "rank"], list(parts), "feature", "similarity")


def raw_cosine_sql(pairs: str = PAIRS_SQL) -> str:
    return f"s AS (SELECT q.song_id AS seed_id, c.song_id, c.track_name, c.track_artist, round({sp.cos(sp.vec('q'), sp.vec('c'))}, 6) AS combined {pairs})"


@query(
    "d6_raw_cosine_with_floor",
    f"""WITH {sp.SONGS}, {sp.LEADS}, {raw_cosine_sql()} SELECT seed_id, song_id, track_name, track_artist, combined, combined AS audio, 0.0::DOUBLE AS lyrics, 0.0::DOUBLE AS sentiment, rank
    FROM (SELECT *, {TOP_SQL.format('combined')} FROM s WHERE combined >= 0.15) WHERE rank <= 5""",
)
def d6(spark, sf):
    catalog = songs(spark, sf)
    return similar.similar_by_raw_cosine(catalog, sc.as_seeds(genre_leads(catalog), AUDIO_KEYS), 5)


@query(
    "d7_raw_cosine",
    f"""WITH {sp.SONGS}, {sp.LEADS}, {raw_cosine_sql('FROM leads JOIN songs q ON q.song_id = seed_id CROSS JOIN songs c')} SELECT seed_id, song_id, combined, rank
    FROM (SELECT *, {TOP_SQL.format('combined')} FROM s) WHERE rank <= 5""",
)
def d7(spark, sf):
    catalog = songs(spark, sf)
    pairs = similar.raw_cosine_pairs(catalog, sc.as_seeds(genre_leads(catalog), AUDIO_KEYS), exclude_self=False)
    return top5(pairs, "combined").select("seed_id", "song_id", "combined", "rank")


def std_sql(name: str, source: str, vector: str) -> str:
    """CTE ``name``(song_id, v) of standardised vectors."""
    return f"""{name}_r AS (SELECT song_id, {vector} AS v FROM {source}),
{name}_c AS (SELECT i, avg(x) AS m, stddev_pop(x) AS s FROM (SELECT unnest(v) AS x, generate_subscripts(v, 1) AS i FROM {name}_r) GROUP BY i),
{name}_l AS (SELECT list(m ORDER BY i) AS m, list(CASE WHEN s = 0 THEN 1 ELSE s END ORDER BY i) AS s FROM {name}_c),
{name} AS (SELECT song_id, list_transform(list_zip(v, m, s), lambda z: (z[1] - z[2]) / z[3]) AS v FROM {name}_r, {name}_l)"""


AUDIO_STD = std_sql("a", "songs s", sp.vec("s"))
SPACE_PAIRS = "FROM leads JOIN {0} q ON q.song_id = seed_id JOIN {0} c ON c.song_id <> q.song_id"
STD_COSINE_SQL = f"cosines AS (SELECT seed_id, c.song_id, round({sp.cos('q.v', 'c.v')}, 6) AS score {SPACE_PAIRS.format('a')})"


def euclid_sql(a, b):
    return f"sqrt(list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))"


KNN_SQL = f"""d AS (SELECT seed_id, c.song_id, round({euclid_sql('q.v', 'c.v')}, 6) AS distance {SPACE_PAIRS.format('a')}),
n AS (SELECT *, max(distance) OVER (PARTITION BY seed_id) AS far FROM (SELECT *, CAST(row_number() OVER (PARTITION BY seed_id ORDER BY distance, song_id) AS INTEGER) AS rank FROM d) WHERE rank <= 10),
knn AS (SELECT seed_id, song_id, distance, rank, round(1 - distance / far, 6) AS score FROM n)"""


def audio_space(spark, sf):
    catalog = songs(spark, sf).select("song_id", "track_name", "playlist_genre", audio_vector().alias("v"))
    # The scaled matrix is written once: the catalog side and the seeds both read it.
    space = write_and_read(vs.standardised(catalog, ["v"]), "audio-space")
    return space, sc.as_seeds(genre_leads(space), ["v"])


@query(
    "d8_standardised_cosine",
    f"WITH {sp.SONGS}, {sp.LEADS}, {AUDIO_STD}, {STD_COSINE_SQL} SELECT * FROM (SELECT *, {TOP_SQL.format('score')} FROM cosines) WHERE rank <= 5",
)
def d8(spark, sf):
    return vs.cosine_neighbours(*audio_space(spark, sf), k=5)


@query("d9_euclid_neighbours", f"WITH {sp.SONGS}, {sp.LEADS}, {AUDIO_STD}, {KNN_SQL} SELECT * FROM knn")
def d9(spark, sf):
    return vs.euclid_neighbours(*audio_space(spark, sf), k=10)


@query(
    "d10_fused_lists",
    f"""WITH {sp.SONGS}, {sp.LEADS}, {AUDIO_STD}, {STD_COSINE_SQL}, {KNN_SQL}, u AS (SELECT seed_id, song_id, score FROM knn UNION ALL
      SELECT seed_id, song_id, score FROM (SELECT *, {TOP_SQL.format('score')} FROM cosines) WHERE rank <= 5), b AS (SELECT seed_id, song_id, max(score) AS score FROM u GROUP BY ALL)
    SELECT * FROM (SELECT *, {TOP_SQL.format('score')} FROM b) WHERE rank <= 5""",
)
def d10(spark, sf):
    space, seeds = audio_space(spark, sf)
    return vs.fused([vs.euclid_neighbours(space, seeds, 10), vs.cosine_neighbours(space, seeds, 5)], 5)


SPACES = {
    "w2v": "w2v", "audio": sp.vec("features"), "sentiment": "[neg, neu, pos, compound]", "topics": "topics",
}


def space_of(features: DataFrame, name: str) -> DataFrame:
    vector = {"w2v": F.col("w2v"), "audio": audio_vector(), "sentiment": similar.sentiment_vector(), "topics": F.col("topics")}[name]
    return features.select("song_id", "track_name", "playlist_genre", vector.alias("v"))


def angular_sql(name, vector, k):
    return f"""SELECT '{name}' AS space, seed_id, song_id, round(sqrt(greatest(0, 2 * (1 - score))), 6) AS distance, rank FROM (SELECT *, {TOP_SQL.format('score')} FROM
    (SELECT seed_id, c.song_id, round({sp.cos('q.v', 'c.v')}, 6) AS score FROM leads JOIN {name}_v q ON q.song_id = seed_id JOIN {name}_v c ON c.song_id <> q.song_id)) WHERE rank <= {k}"""


def angular_ctes(names):
    return ", ".join(f"{n}_v AS (SELECT song_id, {SPACES[n]} AS v FROM features)" for n in names)


@query(
    "d11_space_neighbours",
    f"WITH {sp.BASE}, {angular_ctes(SPACES)} " + " UNION ALL ".join(angular_sql(n, v, 10) for n, v in SPACES.items()),
)
def d11(spark, sf):
    features = song_features(spark, sf)
    lists = []
    for name in SPACES:
        space = space_of(features, name)
        near = vs.angular_neighbours(space, sc.as_seeds(genre_leads(space), ["v"]), 10)
        lists.append(near.select(F.lit(name).alias("space"), "*"))
    return reduce(DataFrame.unionByName, lists)


@query("d11_approximate_neighbours")
def d11_lsh(spark, sf):
    space = space_of(song_features(spark, sf), "w2v")
    return vs.approximate_neighbours(space, sc.as_seeds(genre_leads(space), ["v"]), 10)


def indexed_neighbours(spark, sf, name, k=10):
    """Neighbours of the genres' leads from an index of half of the catalog, to which the rest was added."""
    space = space_of(song_features(spark, sf), name)
    half = F.col("song_id") % 2 == 0
    index = ni.extend(ni.build(space.where(half), per_cell=INDEX_CELL, k=k), space.where(~half))
    return ni.search(index, sc.as_seeds(genre_leads(space), ["v"]), k).best


# Songs of an index cell in the workload, whose catalogs are small.
INDEX_CELL = 50


@query("d11_index_neighbours")
def d11_index(spark, sf):
    lists = [indexed_neighbours(spark, sf, name).select(F.lit(name).alias("space"), "*") for name in SPACES]
    return reduce(DataFrame.unionByName, lists)


@query("d12_feature_type_neighbours", f"WITH {sp.BASE}, {angular_ctes(['sentiment'])} {angular_sql('sentiment', '', 5)}")
def d12(spark, sf):
    space = space_of(song_features(spark, sf), "sentiment")
    near = vs.angular_neighbours(space, sc.as_seeds(genre_leads(space), ["v"]), 5)
    return near.select(F.lit("sentiment").alias("space"), "*")


HYBRID_SPACES = ["w2v", "audio", "sentiment", "topics"]
HYBRID_VECTORS = {
    "w2v": "w2v", "audio": sp.vec("features"), "sentiment": "[polarity, subjectivity, neg, neu, pos, compound]", "topics": "topics",
}
HYBRID_BASE = f"WITH {sp.BASE}, " + ", ".join(std_sql(f"h_{n}", "features", v) for n, v in HYBRID_VECTORS.items()) + """,
h AS (SELECT song_id, h_w2v.v AS w2v, h_audio.v AS audio, h_sentiment.v AS sentiment, h_topics.v AS topics FROM h_w2v JOIN h_audio USING (song_id) JOIN h_sentiment USING (song_id) JOIN h_topics USING (song_id)),
hv AS (SELECT *, list_concat(list_concat(list_transform(w2v, lambda x: 0.4::DOUBLE * x), list_transform(audio, lambda x: 0.3::DOUBLE * x)),
  list_concat(list_transform(sentiment, lambda x: 0.2::DOUBLE * x), list_transform(topics, lambda x: 0.1::DOUBLE * x))) AS v FROM h)"""
HYBRID_SCORED = f"""hs AS (SELECT seed_id, c.song_id, round({sp.cos('q.v', 'c.v')}, 6) AS score, {sp.cos('q.w2v', 'c.w2v')} AS lyrics_similarity, {sp.cos('q.audio', 'c.audio')} AS audio_similarity,
  1 - {euclid_sql('q.sentiment', 'c.sentiment')} AS sc, 1 - {euclid_sql('q.topics', 'c.topics')} AS tc {SPACE_PAIRS.format('hv')}),
ht AS (SELECT * FROM (SELECT *, {TOP_SQL.format('score')} FROM hs) WHERE rank <= 5)"""


def hybrid_inputs(spark, sf):
    features = song_features(spark, sf)
    vectors = features.select(
        "song_id", "w2v", audio_vector().alias("audio"),
        F.array("polarity", "subjectivity", *similar.MOOD).alias("sentiment"), "topics",
    )
    space = write_and_read(vs.hybrid_space(vectors, HYBRID_SPACES), "hybrid-space")
    leads = genre_leads(features.select("song_id", "track_name", "playlist_genre")).select("song_id")
    seeds = sc.as_seeds(space.join(write_and_read(leads, "leads"), "song_id", "left_semi"), [*HYBRID_SPACES, "unit"])
    return space, seeds


@query("d13_hybrid_neighbours", f"{HYBRID_BASE}, {HYBRID_SCORED} SELECT seed_id, song_id, score, rank FROM ht")
def d13(spark, sf):
    return vs.hybrid_neighbours(*hybrid_inputs(spark, sf)).select("seed_id", "song_id", "score", "rank")


@query(
    "d14_component_cosines",
    f"{HYBRID_BASE}, {HYBRID_SCORED} SELECT seed_id, song_id, rank, round(lyrics_similarity, 6) AS lyrics_similarity, round(audio_similarity, 6) AS audio_similarity FROM ht",
)
def d14(spark, sf):
    near = vs.hybrid_neighbours(*hybrid_inputs(spark, sf))
    return near.select("seed_id", "song_id", "rank", *[sc.score_round(F.col(c)).alias(c) for c in ("lyrics_similarity", "audio_similarity")])


@query(
    "d15_explained_neighbours",
    f"""{HYBRID_BASE}, {HYBRID_SCORED} SELECT seed_id, song_id, rank, round((sc - min(sc) OVER w) / (max(sc) OVER w - min(sc) OVER w + 1e-10), 6) AS sentiment_similarity,
    round((tc - min(tc) OVER w) / (max(tc) OVER w - min(tc) OVER w + 1e-10), 6) AS topic_similarity FROM ht WINDOW w AS (PARTITION BY seed_id)""",
)
def d15(spark, sf):
    near = vs.explained(vs.hybrid_neighbours(*hybrid_inputs(spark, sf)))
    return near.select("seed_id", "song_id", "rank", *[sc.score_round(F.col(c)).alias(c) for c in ("sentiment_similarity", "topic_similarity")])


@query(
    "d16_lyrics_cosine",
    f"WITH {sp.TEXTS}, {sp.TERMS}, {sp.LEADS}, {sp.lyric_legs()}, s AS (SELECT seed_id, song_id, round(lyrics, 6) AS lyrics FROM lyr) {best_sql('s', 'lyrics')}",
)
def d16(spark, sf):
    words = texts(spark, sf)
    # The seeds are chosen by name before any text is cut into terms.
    seeds = sc.as_seeds(sc.with_terms(genre_leads(words), "lyrics"), ["terms", "terms_sq"])
    scored = sc.lyrics_by_terms(sc.with_terms(words, "lyrics"), seeds)
    return top5(scored.select("seed_id", "song_id", sc.score_round(F.col("lyrics_raw")).alias("lyrics")), "lyrics", 50)


@query(
    "d17_sentiment_cosine",
    f"""WITH {sp.BASE}, s AS (SELECT q.song_id AS seed_id, c.song_id, round(CASE WHEN c.cluster = 2 THEN 0 WHEN c.cluster = 4 THEN
      CASE WHEN q.pos * q.pos + q.compound * q.compound > 0 AND c.pos * c.pos + c.compound * c.compound > 0 THEN (q.pos * c.pos + q.compound * c.compound)
        / (sqrt(q.pos * q.pos + q.compound * q.compound) * sqrt(c.pos * c.pos + c.compound * c.compound)) ELSE 0 END
      ELSE {sp.mood_cos()} END, 6) AS sentiment FROM leads JOIN features q ON q.song_id = seed_id JOIN features c ON c.song_id <> q.song_id) {best_sql('s', 'sentiment')}""",
)
def d17(spark, sf):
    features = song_features(spark, sf)
    mood = F.create_map(*[c for m in similar.MOOD for c in (F.lit(m), F.col(m))])
    # Stored maps differ in their keys: some hold two, some none.
    stored = F.when(F.col("cluster") == 4, F.map_filter(mood, lambda k, v: k.isin("pos", "compound"))).when(F.col("cluster") != 2, mood)
    catalog = features.select("song_id", "track_name", "playlist_genre", mood.alias("whole"), stored.alias("stored"))
    pairs = sc.against_seeds(catalog, sc.as_seeds(genre_leads(catalog), ["whole"]))
    cosine = sc.score_round(arrays.map_cosine(F.col("seed.whole"), F.col("stored")))
    return top5(pairs.select("seed.seed_id", "song_id", cosine.alias("sentiment")), "sentiment", 50)


@query(
    "d18_threshold_cascade",
    f"WITH {sp.BASE}, {sp.scored((0.3, 0.4, 0.3))}, s AS (SELECT seed_id, song_id, audio, lyrics, sentiment, combined FROM scored WHERE lyrics >= 0.1 AND sentiment >= 0.1) {best_sql('s', 'combined')}",
)
def d18(spark, sf):
    features = song_features(spark, sf)
    weights = {"audio": 0.3, "lyrics": 0.4, "sentiment": 0.3}
    scored = similar.score_pairs(features, sc.as_seeds(genre_leads(features), similar.SEED_COLUMNS), weights)
    return top5(scored.select("seed_id", "song_id", "audio", "lyrics", "sentiment", "combined"), "combined", 50)


@query(
    "f1_min_max_normalise",
    f"""WITH {sp.SONGS}, {sp.LEADS}, {AUDIO_STD}, {STD_COSINE_SQL}, t AS (SELECT * FROM (SELECT *, {TOP_SQL.format('score')} FROM cosines) WHERE rank <= 20)
    SELECT seed_id, song_id, round((score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w + 1e-10), 6) AS scaled FROM t WINDOW w AS (PARTITION BY seed_id)""",
)
def f1(spark, sf):
    near = vs.cosine_neighbours(*audio_space(spark, sf), k=20)
    return near.select("seed_id", "song_id", sc.score_round(vs.min_max_within(near, "seed_id", "score")).alias("scaled"))


@query(
    "f2_rank_aligned",
    f"""{HYBRID_BASE}, {HYBRID_SCORED}, l AS (SELECT seed_id, score, rank FROM (SELECT *, {TOP_SQL.format('score')} FROM (SELECT seed_id, song_id, round(lyrics_similarity, 6) AS score FROM hs)) WHERE rank <= 5),
    a AS (SELECT seed_id, score, rank FROM (SELECT *, {TOP_SQL.format('score')} FROM (SELECT seed_id, song_id, round(audio_similarity, 6) AS score FROM hs)) WHERE rank <= 5)
    SELECT seed_id, song_id, rank, ht.score AS similarity, l.score AS lyrics_similarity, a.score AS audio_similarity FROM ht JOIN l USING (seed_id, rank) JOIN a USING (seed_id, rank)""",
)
def f2(spark, sf):
    space, seeds = hybrid_inputs(spark, sf)
    hybrid = vs.hybrid_neighbours(space, seeds)

    def single(name):
        return vs.cosine_neighbours(space.select("song_id", F.col(name).alias("v")), seeds.select("seed_id", F.col(name).alias("v")), 5)

    return vs.rank_aligned(hybrid, single("w2v"), single("audio"))


@query(
    "h20_vector_functions",
    f"""SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 6) AS self_dot, round({sp.cos('list_transform(embedding, lambda x: x::DOUBLE)', 'list_reverse(list_transform(embedding, lambda x: x::DOUBLE))')}, 6) AS cos_reversed,
    round({euclid_sql('list_transform(embedding, lambda x: x::DOUBLE)', 'list_reverse(list_transform(embedding, lambda x: x::DOUBLE))')}, 6) AS dist_reversed FROM embeddings""",
)
def h20(spark, sf):
    v = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    a, b = F.col("v"), F.reverse("v")
    return v.select(
        "vec_id", F.round(arrays.dot(a, a), 6).alias("self_dot"), F.round(arrays.cosine(a, b), 6).alias("cos_reversed"),
        F.round(arrays.euclid(a, b), 6).alias("dist_reversed"),
    )
