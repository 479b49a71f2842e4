"""Many fuzzy requests against single ones, and what they write; views that leave texts behind."""

import random
import re

from pyspark.sql import functions as F

from cadenza import session
from cadenza.operators import gram_index as gi
from cadenza.operators import search
from cadenza.operators import sentiment as se
from cadenza.sources.tables import song_view

REQUESTS = [
    (0, "red plate", None, None), (1, None, "Src17", None), (2, "hot ring", "src2", None), (3, None, None, "de"), (4, "RING", None, "en"),
    (5, None, None, None), (6, "zzz", None, None), (7, "red plate", None, None), (8, "plat red", None, None),
]


def some_songs(spark):
    random.seed(2)
    words = ["red", "Plate", "hot", "ring", "rod", "blue"]
    rows = [(i, " ".join(random.sample(words, 2)) if i % 9 else None, f"src{i % 23}", random.choice(["en", "de", None])) for i in range(300)]
    rows.append((None, "red plate", "src1", "en"))
    rows.append(rows[1])
    return spark.createDataFrame(rows, "song_id LONG, track_name STRING, track_artist STRING, playlist_genre STRING")


def searched(spark, catalog, requests):
    asked = spark.createDataFrame(requests, "request INT, title STRING, artist STRING, genre STRING")
    titles, artists = gi.build_index(catalog, "track_name"), gi.build_index(catalog, "track_artist")
    return gi.search_many(catalog, asked, titles, artists)


def test_every_kind_of_request_equals_the_scan(spark):
    catalog = some_songs(spark)
    queries = [{k: v for k, v in zip(("title", "artist", "genre"), r[1:]) if v} for r in REQUESTS]
    want = search.fuzzy_search(catalog, queries, "track_name", "track_artist", "playlist_genre").where("song_id IS NOT NULL")
    rows = lambda df: sorted(
        (r["request"], r["song_id"], r["track_artist"], None if r["relevance"] is None else round(r["relevance"], 9)) for r in df.collect()
    )
    key = lambda r: (r[0], r[1], r[2], -1 if r[3] is None else r[3])
    assert sorted(rows(searched(spark, catalog, REQUESTS)), key=key) == sorted(rows(want), key=key)


def test_hits_of_requests_of_one_text_are_not_written(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(gi, "work_path", session.work_path)
    monkeypatch.setattr(session, "work_root", lambda _: str(tmp_path))
    catalog = some_songs(spark)
    found = searched(spark, catalog, [(i, None, f"src{i}", None) for i in range(20)]).count()
    assert found > 3000
    tables = [p for p in tmp_path.iterdir() if not p.name.startswith("grams-")]
    assert tables and max(spark.read.parquet(str(p)).count() for p in tables) < found / 5


def test_songs_without_lyrics_send_no_texts_through_the_join(spark):
    docs = spark.createDataFrame([(1, "a b c d", "en", "s")], "doc_id LONG, text STRING, lang STRING, source STRING")
    vectors = spark.createDataFrame([(1, [0.1] * 64, 2)], "vec_id LONG, embedding ARRAY<FLOAT>, label INT")
    view = song_view(docs, vectors)
    assert view.first()["track_name"] == "a b c" and view.first()["lyrics"] == "a b c d"
    plan = view.select("song_id", "track_name")._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Join Inner.*substring_index", plan, re.S) and not re.search(r"substring_index.*Join Inner", plan, re.S)


def test_outer_punctuation_goes_without_a_pattern_for_each_word(spark):
    texts = ["'Well,' she said: \"no!\" -- a.b. (ok) ;) ... !!a!! é! «x», _y_ \\z\\ 1.5, ¿q? ~t~", "", " . ", "..ab", "a b.,c"]
    df = spark.createDataFrame([(t,) for t in texts], "t STRING")
    words = df.select("t", se.sentiment_words(F.col("t")).alias("w"))
    for row in words.collect():
        parts = [p for p in re.split(r"[\s ]+", row["t"]) if p]
        bare = [re.sub(r"^[!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]+\Z", "", p) for p in parts]
        assert row["w"] == [p if len(b) <= 2 else b for p, b in zip(parts, bare)]
    assert "regexp_replace" not in words._jdf.queryExecution().optimizedPlan().toString()


def test_lexicon_cuts_texts_once(spark, sf):
    from collections import Counter

    from cadenza.workload import inputs

    rows = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    counts = Counter(w for text in rows for w in re.findall(r"\w+", (text or "").lower()))
    got = inputs.lexicon(spark, sf)
    total = sum(counts.values())
    want = {w for w, n in counts.items() if n * inputs.LEXICON_SHARE >= total}
    assert {r["term"] for r in got.collect()} == want and len(want) > 10
    # Neither the counts nor their total go back to the texts.
    assert "regexp_extract_all" not in got._jdf.queryExecution().toString()
