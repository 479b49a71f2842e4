import pytest
from pyspark.sql import functions as F

from cadenza.operators import joins as jn, linkage as ln, search, shaping
from cadenza.sources import catalog as cat, sinks


@pytest.fixture(scope="module")
def songs(spark):
    rows = [(1, "Happy Song", "Happy Artist", "Pop", 120.0, 0.8), (2, "Sad Song", "Sad Artist", "Blues", 90.0, 0.4), (3, "Other", "Band", "Pop", 140.0, 0.9)]
    return spark.createDataFrame(rows, "song_id BIGINT, track_name STRING, track_artist STRING, playlist_genre STRING, tempo DOUBLE, energy DOUBLE")


def ids(df):
    return sorted(r.song_id for r in df.select("song_id").collect())


def test_search_by_each_field(songs):
    assert ids(search.substring_search(songs, "happy")) == [1]
    assert ids(search.substring_search(songs, "SONG", artist="sad")) == [2]
    assert ids(search.substring_search(songs, "o", genre="pop")) == [1, 3]
    assert ids(search.filtered(songs)) == []
    found = search.fuzzy_search(songs, [{"title": "hapy song"}, {"genre": "Blues"}], "track_name", "track_artist", "playlist_genre")
    assert sorted((r.request, r.song_id) for r in found.collect()) == [(0, 1), (0, 2), (1, 2)]


def test_ranges(songs):
    assert ids(search.in_ranges(songs, tempo=(100, 130), energy=(0.7, 1.0))) == [1]
    with pytest.raises(ValueError, match="exceeds"):
        search.in_ranges(songs, tempo=(200, 100))


def test_request_checks(spark):
    rows = [("https://youtube.com/watch", "ab", 5), ("ftp://x", "ab", 5), ("https://youtu.be/x", "a", 5), ("http://www.youtube.com/", "abc", 0)]
    df = spark.createDataFrame(rows, "url STRING, text STRING, n INT")
    assert [r.refused for r in search.check_requests(df, "url", "text", "n").collect()] == [None, "bad url", "text too short", "limit out of range"]


def test_load_appends_only_new_rows(spark):
    schema = "track_id BIGINT, track_name STRING, track_artist STRING"
    target = spark.createDataFrame([(1, "A", "x")], schema)
    batch = spark.createDataFrame([(10, "A", "x"), (11, "B", "x"), (12, "B", "x"), (13, "A", "y")], schema)
    fresh = sinks.append_new(target, batch, "track_id").collect()
    assert sorted(r.track_id for r in fresh) == [11, 13]


def test_upsert_keeps_ids_and_replaces_columns(spark):
    schema = "song_id BIGINT, track_name STRING, track_artist STRING, lyrics STRING"
    target = spark.createDataFrame([(1, "A", "x", "old"), (2, "C", "z", "stay")], schema)
    batch = spark.createDataFrame([(0, "A", "x", "mid"), (1, "A", "x", None), (2, "B", "y", "new")], "nr BIGINT, track_name STRING, track_artist STRING, lyrics STRING")
    got = {r.track_name: (r.song_id, r.lyrics) for r in sinks.upsert(target, batch, "song_id", "nr").collect()}
    assert got == {"A": (1, None), "C": (2, "stay"), "B": (5, "new")}


def test_patch_changes_only_given_fields(spark):
    target = spark.createDataFrame([(1, "a", "b"), (2, "c", "d")], "song_id BIGINT, track_name STRING, lyrics STRING")
    patches = spark.createDataFrame([(1, None, "zz", ["track_name"])], "song_id BIGINT, track_name STRING, lyrics STRING, given ARRAY<STRING>")
    got = {r.song_id: (r.track_name, r.lyrics) for r in sinks.patch(target, patches, "song_id", ["track_name", "lyrics"]).collect()}
    assert got == {1: (None, "b"), 2: ("c", "d")}


def test_bad_json_parses_to_null(spark):
    df = spark.createDataFrame([('{"energy": 0.5, "key": 3}',), ("{oops",), ("7",), (None,)], "j STRING")
    got = [r.f and (r.f.energy, r.f.key) for r in df.select(cat.parse_features(F.col("j")).alias("f")).collect()]
    assert got == [(0.5, 3), None, None, None]


def test_missing_catalog_is_an_error(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        cat.load_catalog(spark, str(tmp_path / "none.csv"))


def test_csv_keeps_line_breaks_and_quotes(spark, tmp_path):
    path = tmp_path / "songs.csv"
    path.write_text('track_id,track_name,track_artist,track_album_name,playlist_name,playlist_genre,lyrics,danceability,energy,key\n1,"A ""b""",x,,p,pop,"l1\nl2, c",0.5,bad,3.7\n')
    row = cat.clean_numbers(cat.load_catalog(spark, str(tmp_path / "no.csv"), str(path))).first()
    assert (row.track_name, row.lyrics, row.danceability, row.energy, row.key) == ('A "b"', "l1\nl2, c", 0.5, 0.0, 3)


def test_feature_vectors(spark):
    df = spark.createDataFrame([({"energy": 0.5, "mfcc": 1.0, "tempo": 100.0},)], "m MAP<STRING, DOUBLE>")
    row = df.select(shaping.standard_keys(F.col("m")).alias("s"), shaping.fixed_vector(F.col("m")).alias("v")).first()
    assert row.s == {"energy": 0.5, "tempo": 100.0}
    assert row.v == [0.0, 0.5, 0, 0, 0, 0, 0, 0, 0, 0, 100.0, 0]


def test_containment_join_finds_every_substring(spark):
    names = ["Anna", "Ann", "JoAnne Band", "nn", "", "band"]
    rows = spark.createDataFrame(list(enumerate(names)), "id INT, artist STRING")
    asked = spark.createDataFrame([("ANN",), ("band",), ("zz",), ("joanne band extra",)], "wanted STRING")
    got = {(r.id, r.wanted) for r in ln.containment_join(rows, asked, "artist", "wanted").collect()}
    assert got == {(i, w) for i, n in enumerate(names) for w in ("ANN", "band", "zz", "joanne band extra") if w.lower() in n.lower()}


def test_confidence(spark):
    def score(*texts, steps):
        return spark.range(1).select(ln.match_confidence(*[F.lit(t) for t in texts], steps).alias("c")).first().c

    assert score("Song", "Ann", "song", "ann", steps=ln.SEARCH_HIT) == pytest.approx(1.0)
    assert score("Song", "Ann", "The Song", "Annie", steps=ln.SEARCH_HIT) == pytest.approx(0.8)
    assert score("Song", "Ann", "Other", "Bob", steps=ln.OPEN_DATABASE) == pytest.approx(0.2)
    corrected = ln.match_confidence(*map(F.lit, ("Song", "Ann", "Other", "Bob")), ln.OPEN_DATABASE, autocorrected=F.lit(True))
    assert spark.range(1).select(corrected.alias("c")).first().c == pytest.approx(0.6)


def plain_survivor(sources):
    best, out = 0.0, {}
    for _, confidence, given, values in sorted(sources, key=lambda s: s[0]):
        if confidence > best:
            best = confidence
            out.update({c: values[c] for c in given})
            if best >= 0.8:
                break
    return out


def test_survivorship_against_a_loop(spark):
    import random

    rng = random.Random(5)
    rows, expected = [], {}
    for i in range(60):
        mine = []
        for p in rng.sample([1, 2, 3], rng.randrange(1, 4)):
            given = rng.sample(["album", "genre"], rng.randrange(0, 3))
            mine.append((p, rng.choice([0.2, 0.5, 0.6, 0.8, 0.9]), given, {"album": rng.choice([None, f"a{p}"]), "genre": f"g{p}"}))
        expected[i] = plain_survivor(mine)
        rows += [(i, p, f"s{p}", c, g, v["album"], v["genre"]) for p, c, g, v in mine]
    df = spark.createDataFrame(rows, "id INT, priority INT, source STRING, confidence DOUBLE, given ARRAY<STRING>, album STRING, genre STRING")
    for r in ln.survivorship(df, "id", ["album", "genre"]).collect():
        assert (r.album, r.genre) == (expected[r.id].get("album"), expected[r.id].get("genre"))


def test_duplicates_by_title_or_lyrics(spark):
    from cadenza.operators.scoring import with_terms

    rows = [(1, "Blue Sky (Official Video)", "Ann", "a completely different set of words"), (2, "Red", "Annie", "love me tender love me true"), (3, "Green", "Ann", "nothing alike at all"), (4, "Blue Sky", "Bob", "love me tender love me true"), (5, "Blue Sky", "ann", "")]
    catalog = spark.createDataFrame(rows, "song_id BIGINT, track_name STRING, track_artist STRING, lyrics STRING")
    incoming = spark.createDataFrame([(9, "blue sky", "ann", "love me tender love me true")], "incoming_id BIGINT, track_name STRING, track_artist STRING, lyrics STRING")
    found = ln.find_duplicates(with_terms(catalog, "lyrics", cleaned=False), with_terms(incoming, "lyrics", cleaned=False)).collect()
    got = {r.song_id: (r.title_similarity, r.lyrics_similarity) for r in found}
    assert got == {1: (1.0, 0.0), 2: (0.125, 1.0), 5: (1.0, None)}


def test_retention_ignores_null_ids(spark):
    catalog = spark.createDataFrame([(1, False), (2, False), (3, True)], "song_id BIGINT, orig BOOLEAN")
    recent = spark.createDataFrame([(1,), (None,)], "song_id BIGINT")
    assert ids(jn.keep_recommended(catalog, recent, "song_id", F.col("orig"))) == [1, 3]


def test_vocabulary_is_cut_by_frequency_alone(spark):
    from cadenza.operators.aggregates import document_frequency

    docs = [["a", "b", "c"], ["a", "b", "d", "d"], ["a", "c", "e"], ["f", "b"], ["g"]]
    df = spark.createDataFrame([(d,) for d in docs], "tokens ARRAY<STRING>")
    counts = {t: sum(t in d for d in docs) for d in docs for t in d}
    for low, share in ((1, 0.6), (2, 0.6), (1, 0.4)):
        expected = {t: n for t, n in counts.items() if low <= n <= share * len(docs)}
        assert {r.term: r.df for r in document_frequency(df, "tokens", low, share).collect()} == expected


def test_fuzzy_pages_follow_relevance_then_title(songs):
    found = search.fuzzy_search(songs, [{"title": "song"}, {"genre": "Pop"}], "track_name", "track_artist", "playlist_genre")
    rows = search.fuzzy_page(found, 0, 5).orderBy("request", "place").collect()
    assert [(r.request, r.song_id) for r in rows] == [(0, 2), (0, 1), (1, 1), (1, 3)]
    assert [r.song_id for r in search.fuzzy_page(found, 1, 1).orderBy("request").collect()] == [1, 3]


def test_unparsed_rows(spark):
    from cadenza.operators.aggregates import unparsed

    df = spark.createDataFrame([("1", "2.5"), ("x", "1"), (None, ""), ("3", "4 in")], "a STRING, b STRING")
    assert unparsed(df, ["a", "b"]).count() == 2
