"""Vector links against all pairs."""

import math

import numpy as np
import pytest

from cadenza.llm import multi_index as mi
from test_minhash_join import roots


def plain(rows, cosine=mi.COSINE):
    good = {}
    for i, (_, v, label) in enumerate(rows):
        if label is None or not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            continue
        x = np.array(v, np.float64)
        x = x / np.abs(x).max()
        good[i] = (label, len(v), x / np.sqrt((x * x).sum()))
    links = [
        (i, j) for i in good for j in good
        if i < j and good[i][:2] == good[j][:2] and good[i][2] @ good[j][2] >= cosine
    ]
    degree = {i: 0 for i in range(len(rows))}
    for i, j in links:
        degree[i] += 1
        degree[j] += 1
    root = roots(range(len(rows)), links)
    least = {}
    for i, (key, _, _) in enumerate(rows):
        if key is not None:
            least[root[i]] = min(least.get(root[i], key), key)
    return [(key, degree[i], least.get(root[i])) for i, (key, _, _) in enumerate(rows)]


def compare(frame):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in frame.collect()]
    order = lambda r: tuple((v is not None, v or 0) for v in r)
    got = mi.near_vectors(frame).collect()
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got), key=order) == sorted(plain(rows), key=order)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
    return got


def test_embeddings(spark, small):
    compare(spark.read.parquet(f"{small}/embeddings.parquet"))


@pytest.mark.parametrize("seed", range(2))
def test_crowds_and_borders(spark, seed, monkeypatch):
    # Small blocks and cells, so that every path of the index is taken.
    monkeypatch.setattr(mi, "PER_CELL", 20)
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(25):
        centre = rng.normal(size=12)
        for _ in range(rng.integers(1, 30)):
            v = centre + rng.normal(size=12) * rng.choice([0.0, 0.02, 0.08, 0.15])
            rows.append((len(rows), [float(np.float32(x)) for x in v * rng.choice([1, 5])], int(rng.integers(0, 2))))
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    whole = mi.link_vectors
    monkeypatch.setattr(mi, "link_vectors", lambda a, c, kind: whole(a, c, kind, block=16))
    compare(frame)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0, 0.0], 1), (2, [1.0, 0.0, 0.0], 1), (3, [1.0, 0.0, 0.0], 2), (4, [1.0, 0.0, 0.0], None),
        (5, None, 1), (6, [], 1), (7, [0.0, 0.0, 0.0], 1), (8, [nan, 1.0, 0.0], 1), (9, [inf, 1.0, 0.0], 1),
        (10, [None, 1.0, 0.0], 1), (11, [1.0, 0.0], 1), (12, [2.0, 0.001, 0.0], 1), (None, [1.0, 0.0, 0.0], 1),
        (13, [-1.0, 0.0, 0.0], 1), (14, [1e-30, 0.0, -0.0], 1), (15, [1e30, 0.0, 0.0], 1), (1, [1.0, 0.0, 0.0], 1),
        (None, [0.0, 1.0, 0.0], 3), (16, [5.0], 1), (17, [7.0], 1),
    ]
    frame = spark.createDataFrame([(*r, 0, "c") for r in rows], "vec_id long, embedding array<float>, label int, node int, copy string")
    compare(frame)
    assert mi.near_vectors(frame.limit(0)).collect() == []


def test_traversal_is_ascending_and_reaches_every_partner():
    rng = np.random.default_rng(3)
    points = rng.normal(size=(600, 8))
    points[300:] = points[:300] + rng.normal(size=(300, 8)) * 0.03
    units = points / np.linalg.norm(points, axis=1, keepdims=True)
    books = tuple(mi.fit_codebook(h, 8) for h in (units[:, :4], units[:, 4:]))
    home, visited = mi.visits(units, books, math.sqrt(2 - 2 * 0.98))
    links = np.argwhere(np.triu(units @ units.T >= 0.98, 1))
    assert len(links) > 200
    assert all(home[b] in visited[a] and home[a] in visited[b] for a, b in links)
    assert all(v[0] == h for v, h in zip(visited, home)) and min(map(len, visited)) < 64
