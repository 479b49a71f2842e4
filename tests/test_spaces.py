import numpy as np
import pytest

from cadenza.operators import scoring as sc, spaces as vs
from cadenza.plans import products as pr
from cadenza.sources import catalog as cat


def space_of(spark, matrix):
    return spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(matrix)], "song_id BIGINT, v ARRAY<DOUBLE>")


def cosines(matrix):
    norms = np.linalg.norm(matrix, axis=1)
    return matrix @ matrix.T / np.outer(norms, norms)


def nearest(scores, seed, k, descending=True):
    order = sorted((i for i in range(len(scores)) if i != seed), key=lambda i: (-scores[i] if descending else scores[i], i))
    return order[:k]


@pytest.fixture(scope="module")
def matrix():
    return np.round(np.random.default_rng(9).normal(size=(300, 6)), 3)


def test_standardised_uses_the_population_std(spark):
    got = vs.standardised(space_of(spark, [[1, 5], [3, 5]]), ["v"]).orderBy("song_id").collect()
    assert [r.v for r in got] == [[-1.0, 0.0], [1.0, 0.0]]


def test_more_seeds_than_one_batch_holds(spark, matrix):
    space = space_of(spark, matrix)
    near = vs.cosine_neighbours(space, sc.as_seeds(space, ["v"]), 3).collect()
    scores = np.round(cosines(matrix), 6)
    for seed in range(300):
        mine = sorted((r["rank"], r.song_id) for r in near if r.seed_id == seed)
        assert [s for _, s in mine] == nearest(scores[seed], seed, 3)


def test_euclid_scores(spark, matrix):
    space = space_of(spark, matrix)
    near = vs.euclid_neighbours(space, sc.as_seeds(space.where("song_id = 7"), ["v"]), 4).orderBy("rank").collect()
    distance = np.round(np.linalg.norm(matrix - matrix[7], axis=1), 6)
    assert [r.song_id for r in near] == nearest(distance, 7, 4, descending=False)
    assert near[-1].score == 0.0 and near[0].score == pytest.approx(1 - distance[near[0].song_id] / distance[near[-1].song_id], abs=1e-6)


def test_hybrid_equals_the_concatenated_vector(spark, matrix):
    parts = {"w2v": matrix[:, :3], "audio": matrix[:, 3:5], "sentiment": matrix[:, 4:], "topics": matrix[:, 1:4]}
    rows = [(i, *[[float(x) for x in p[i]] for p in parts.values()]) for i in range(len(matrix))]
    features = spark.createDataFrame(rows, "song_id BIGINT, " + ", ".join(f"{n} ARRAY<DOUBLE>" for n in parts))
    space = vs.hybrid_space(features, list(parts))
    seeds = sc.as_seeds(space.where("song_id in (2, 9)"), [*parts, "unit"])
    near = vs.hybrid_neighbours(space, seeds, 5).collect()
    scaled = {n: (p - p.mean(axis=0)) / p.std(axis=0) for n, p in parts.items()}
    joined = np.hstack([vs.HYBRID_WEIGHTS[n] * p for n, p in scaled.items()])
    scores = np.round(cosines(joined), 6)
    for seed in (2, 9):
        assert [r.song_id for r in sorted(near, key=lambda r: r["rank"]) if r.seed_id == seed] == nearest(scores[seed], seed, 5)
    for r in near:
        assert r.audio_similarity == pytest.approx(cosines(scaled["audio"])[r.seed_id, r.song_id])
        assert r.topic_closeness == pytest.approx(1 - np.linalg.norm(scaled["topics"][r.seed_id] - scaled["topics"][r.song_id]))


def test_approximate_neighbours_report_exact_distances(spark, matrix):
    space = space_of(spark, matrix)
    near = vs.approximate_neighbours(space, sc.as_seeds(space.where("song_id < 5"), ["v"]), 10).collect()
    exact = np.sqrt(np.maximum(0, 2 * (1 - np.round(cosines(matrix), 6))))
    found = 0
    for r in near:
        assert r.song_id != r.seed_id and r.distance == pytest.approx(exact[r.seed_id, r.song_id], abs=1e-5)
        found += r.song_id in nearest(exact[r.seed_id], r.seed_id, 10, descending=False)
    assert found >= 40


def test_moods_are_scaled_like_the_catalog(spark):
    rng = np.random.default_rng(10)
    matrix = rng.random((50, 12))
    got = pr.songs_for_moods(space_of(spark, matrix), ["Happy", "sad"], 3).collect()
    mean, std = matrix.mean(axis=0), matrix.std(axis=0)
    for mood in ("happy", "sad"):
        query = (np.array([pr.MOODS[mood].get(n, 0.0) for n in pr.AUDIO_KEYS]) - mean) / std
        scaled = (matrix - mean) / std
        scores = np.round(scaled @ query / (np.linalg.norm(scaled, axis=1) * np.linalg.norm(query)), 6)
        assert [r.song_id for r in sorted(got, key=lambda r: r["rank"]) if r.mood == mood] == nearest(scores, -1, 3)


def test_storage_stats(spark):
    rows = [("/store/a/x.mp3", 1_048_576), ("/store/a/y.mp3", 524_288), ("/store/b/z", 0)]
    got = {r.folder: (r.files, r.storage_mb) for r in cat.storage_stats(spark.createDataFrame(rows, "path STRING, length BIGINT")).collect()}
    assert got == {"/store/a": (2, 1.5), "/store/b": (1, 0.0)}


def test_approximate_search_never_multiplies_rows_by_seeds(spark, matrix):
    space = space_of(spark, matrix)
    near = vs.approximate_neighbours(space, sc.as_seeds(space.where("song_id < 5"), ["v"]), 10)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "seed-blocks" not in plan
