import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.functions import arrays, audio
from cadenza.operators import scoring as sc
from cadenza.plans import products as pr, similar
from cadenza.sources.tables import AUDIO_KEYS


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "seed,other,expected",
    [(120, 120, 1.0), (120, 60, 1.0), (60, 120, 1.0), (100, 110, 1 - 5 / 15), (100, 120, 0.0), (100, 120.5, 1 - 20.5 / 40), (100, 160, 0.0), (100, 145, 1 - 27.5 / 40), (300, 50, 0.0)],
)
def test_tempo_curve(spark, seed, other, expected):
    assert one(spark, audio.tempo_similarity(F.lit(float(seed)), F.lit(float(other)))) == pytest.approx(expected)


def test_cosine_of_itself_and_of_orthogonal_vectors(spark):
    a, b = F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(2.0))
    assert one(spark, arrays.cosine(a, a)) == pytest.approx(1.0)
    assert one(spark, arrays.cosine(a, b)) == 0.0
    assert one(spark, arrays.cosine(a, F.array(F.lit(0.0), F.lit(0.0)))) == 0.0


def plain_similarity(a, b, weights):
    score = 0.0
    for name, weight in weights.items():
        x, y = (0.0 if v[name] is None else v[name] for v in (a, b))
        if math.isnan(x) or math.isnan(y):
            continue
        if name == "tempo":
            gap = min(abs(x - y), abs(x - 2 * y), abs(x - 0.5 * y))
            part = 1.0 if gap <= 5 else 1 - (gap - 5) / 15 if gap <= 20 else max(0.0, 1 - gap / 40)
        else:
            part = 1 - min(1.0, abs(x - y) / (20.0 if name == "loudness" else 1.0))
        score += weight * part
    return score / sum(weights.values())


def random_songs(n, seed, holes=False):
    rng = random.Random(seed)
    songs = []
    for i in range(n):
        song = {k: rng.random() for k in AUDIO_KEYS}
        song.update(tempo=60 + 140 * rng.random(), loudness=-60 * rng.random(), key=float(rng.randrange(12)), mode=1.0, duration_ms=2e5)
        if holes and i % 7 == 0:
            song["tempo"] = float("nan")
        if holes and i % 5 == 0:
            song["energy"] = None
        songs.append({"song_id": i, **song})
    return songs


def song_frame(spark, songs):
    schema = "song_id BIGINT, " + ", ".join(f"{k} DOUBLE" for k in AUDIO_KEYS)
    return spark.createDataFrame([tuple([s["song_id"]] + [s[k] for k in AUDIO_KEYS]) for s in songs], schema)


@pytest.mark.parametrize("weights", [audio.STANDARD_WEIGHTS, audio.VIDEO_WEIGHTS])
def test_audio_similarity_with_holes(spark, weights):
    songs = random_songs(40, 1, holes=True)
    frame = song_frame(spark, songs)
    seeds = sc.as_seeds(frame.where("song_id in (0, 3, 5, 8)"), AUDIO_KEYS)
    got = sc.audio_pairs(frame, seeds).select("seed.seed_id", "song_id", sc.audio_score(weights).alias("s")).collect()
    assert len(got) == 4 * 39
    for row in got:
        assert row.s == pytest.approx(plain_similarity(songs[row.seed_id], songs[row.song_id], weights), abs=1e-12)


def tfidf_cosine(a, b):
    terms = set(a) | set(b)
    idf = {t: math.log(3 / (1 + (t in a) + (t in b))) + 1 for t in terms}
    va, vb = ([d.get(t, 0) * idf[t] for t in sorted(terms)] for d in (a, b))
    dot = sum(x * y for x, y in zip(va, vb))
    return dot / math.sqrt(sum(x * x for x in va) * sum(y * y for y in vb))


def test_lyrics_leg_equals_two_document_tfidf(spark):
    texts = {1: "The cat sat; the cat [Chorus] ran!", 2: "A cat and the dog sat", 3: "nothing shared here", 4: ""}
    words = {k: {} for k in texts}
    import re

    for k, t in texts.items():
        for w in re.findall(r"\w{2,}", re.sub(r"[^\w\s]", "", re.sub(r"\[.*?\]", "", t.lower()))):
            words[k][w] = words[k].get(w, 0) + 1
    docs = sc.with_terms(spark.createDataFrame(list(texts.items()), "song_id BIGINT, lyrics STRING"), "lyrics")
    seeds = sc.as_seeds(docs.where("song_id in (1, 4)"), ["terms", "terms_sq"])
    pairs = sc.against_seeds(docs, seeds, exclude_self=False).select("seed.seed_id", "song_id", sc.lyrics_cosine().alias("lyrics"))
    got = {(r.seed_id, r.song_id): r.lyrics for r in pairs.collect()}
    assert got[1, 1] == pytest.approx(1.0)
    assert got[1, 2] == pytest.approx(tfidf_cosine(words[1], words[2]))
    assert all(v == 0.0 for k, v in got.items() if k not in ((1, 1), (1, 2)))


def scored_frame(spark, rows):
    return spark.createDataFrame(rows, "seed_id BIGINT, song_id BIGINT, audio DOUBLE, lyrics DOUBLE, sentiment DOUBLE, combined DOUBLE")


def random_scores(seeds, n, seed):
    rng = random.Random(seed)
    return [
        (s, i, round(rng.betavariate(5, 2), 6), 0.0, 0.0, round(rng.choice([rng.betavariate(5, 2), 0.8]), 6))
        for s in range(seeds) for i in range(n)
    ]


def test_profile_is_exact(spark):
    rows = random_scores(3, 501, 2)
    got = {r.seed_id: r for r in sc.score_profile(scored_frame(spark, rows), ["seed_id"], ["audio", "combined"]).collect()}
    for s in range(3):
        for metric, at in (("audio", 2), ("combined", 5)):
            values = [r[at] for r in rows if r[0] == s]
            assert got[s][f"{metric}_median"] == pytest.approx(statistics.median(values))
            assert got[s][f"{metric}_std"] == pytest.approx(np.std(values))


def plain_refine(rows, k, floor=0.15):
    if len(rows) > 3 * k:
        cuts = []
        for at in (2, 5):
            values = [r[at] for r in rows]
            cuts.append(max(floor, statistics.median(values) * 0.85, statistics.median(values) - np.std(values)))
        kept = [r for r in rows if r[2] >= cuts[0] and r[5] >= cuts[1]]
        if len(kept) >= max(k, 3):
            rows = kept
    return [r[1] for r in sorted(rows, key=lambda r: (-r[5], r[1]))[:k]]


@pytest.mark.parametrize("n,k", [(200, 5), (12, 5), (16, 5), (40, 13)])
def test_refinement_against_brute_force(spark, n, k):
    rows = random_scores(4, n, n)
    ranked = sc.refine_and_rank(scored_frame(spark, rows), ["seed_id"], k).collect()
    for s in range(4):
        got = [r.song_id for r in sorted((r for r in ranked if r.seed_id == s), key=lambda r: r["rank"])]
        assert got == plain_refine([r for r in rows if r[0] == s], k)


@pytest.mark.parametrize("n", [1, 64, 65, 300])
def test_any_number_of_seeds_meets_every_song_once(spark, n):
    frame = song_frame(spark, random_songs(300, 3))
    seeds = sc.as_seeds(frame.where(f"song_id < {n}"), AUDIO_KEYS)
    got = sc.against_seeds(frame, seeds).select("seed.seed_id", "song_id").collect()
    assert len(got) == len({tuple(r) for r in got}) == n * 299


def test_no_seeds_and_repeated_seeds(spark):
    frame = song_frame(spark, random_songs(30, 3))
    assert sc.against_seeds(frame, sc.as_seeds(frame.limit(0), AUDIO_KEYS)).count() == 0
    twice = sc.as_seeds(frame.where("song_id = 1"), AUDIO_KEYS)
    assert sc.against_seeds(frame, twice.unionByName(twice)).count() == 2 * 29


def test_large_requests_join_by_block_without_a_broadcast(spark):
    frame = song_frame(spark, random_songs(200, 4))
    seeds = sc.as_seeds(frame, AUDIO_KEYS)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert sc.against_seeds(frame, seeds).count() == 200 * 199
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_unknown_mood_is_an_error(spark):
    with pytest.raises(ValueError, match="unknown mood"):
        pr.mood_seeds(spark, ["happy", "bored"])
    with pytest.raises(ValueError, match="unknown mood"):
        pr.mood_list(spark.range(1), "bored")


def test_playlist_repeats_no_title(spark, sf):
    from cadenza.workload.inputs import genre_leads, song_features

    features = song_features(spark, sf)
    seeds = sc.as_seeds(genre_leads(features), similar.SEED_COLUMNS)
    rows = pr.playlist(features, seeds, 15).collect()
    keys = [(r.seed_id, r.track_name, r.track_artist) for r in rows]
    assert rows and len(keys) == len(set(keys))


def test_sweep_prefers_the_best_mean(spark):
    # Level 0 keeps a poor third song; the strict level keeps two good ones, which is too few for k = 5.
    rows = [(1, 1, 0.9, 0.0, 0.0, 0.9), (1, 2, 0.8, 0.0, 0.0, 0.8), (1, 3, 0.13, 0.0, 0.0, 0.13)]
    few = pr.threshold_sweep(scored_frame(spark, rows), 5).collect()
    assert {r.song_id for r in few} == {1, 2, 3} and {r.level for r in few} == {0}
    enough = pr.threshold_sweep(scored_frame(spark, rows), 2).collect()
    assert {r.song_id for r in enough} == {1, 2} and {r.level for r in enough} == {0}
