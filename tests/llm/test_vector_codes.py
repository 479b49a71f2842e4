"""Integer codebooks against a plain run, and the pivots' bounds against full evaluation."""

import hashlib
import math
import random

import numpy as np
import pytest

from cadenza.llm import vector_codes as vc


def plain(rows, entries=vc.ENTRIES, rounds=vc.ROUNDS):
    """{(key, code, error, label_error, digest): how often} with Python integers alone, equal lengths."""
    kept = [
        (k, l, [math.floor(vc.SCALE * x) for x in v]) for k, l, v in rows
        if v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = {}
    for length in {len(v) for _, _, v in kept}:
        own = [r for r in kept if len(r[2]) == length]
        cuts = vc.part_bounds(length, vc.PARTS)
        least = sorted(own, key=lambda r: (r[0] is None, r[0] or 0, np.array(r[2], "<i4").tobytes()))[:entries]
        books = [[r[2][a:b] for r in least] for a, b in cuts]

        def nearest(part, book):
            return min((sum((x - y) ** 2 for x, y in zip(part, e)), i) for i, e in enumerate(book))

        for _ in range(rounds):
            for p, (a, b) in enumerate(cuts):
                taken = {}
                for _, _, v in own:
                    taken.setdefault(nearest(v[a:b], books[p])[1], []).append(v[a:b])
                for i, members in taken.items():
                    books[p][i] = [sum(c) // len(members) for c in zip(*members)]
        digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
        for k, l, v in own:
            found = [nearest(v[a:b], book) for (a, b), book in zip(cuts, books)]
            out.setdefault((k, l, "".join(f"{i:02x}" for _, i in found), sum(d for d, _ in found), digest), 0)
            out[k, l, "".join(f"{i:02x}" for _, i in found), sum(d for d, _ in found), digest] += 1
    totals = {}
    for (_, l, _, error, _), n in out.items():
        totals[l] = totals.get(l, 0) + n * error
    return sorted((((k, c, e, totals[l], d), n) for (k, l, c, e, d), n in out.items()), key=repr)


def found(frame, **more):
    out = {}
    for r in vc.compress_vectors(frame, **more).collect():
        row = (r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"])
        out[row] = out.get(row, 0) + 1
    return sorted(out.items(), key=repr)


SCHEMA = "vec_id long, embedding array<float>, label int, code string, error long"


def frame_of(spark, rows):
    return spark.createDataFrame([(k, v, l, "clash", -1) for k, l, v in rows], SCHEMA).repartition(3)


def vectors(n, length, seed, ids=None):
    rng = random.Random(seed)
    return [(i if ids is None else ids[i], rng.choice([0, 1, None]), [float(np.float32(rng.gauss(0, 0.3))) for _ in range(length)]) for i in range(n)]


@pytest.mark.parametrize("length", [16, 7, 1])
def test_small_tables_equal_a_plain_run(spark, length):
    rows = vectors(60, length, length)
    assert found(frame_of(spark, rows), entries=8) == plain(rows, entries=8)


def test_odd_rows(spark):
    rows = vectors(30, 8, 5, ids=[i // 2 for i in range(30)])  # repeated keys
    rows += [rows[0]] * 20 + [(90 + i, 1, rows[1][2]) for i in range(20)]  # repeated rows and copies
    rows += [(50, 1, None), (51, 1, [None] * 8), (52, 0, [math.nan] * 8), (53, 0, [math.inf] + [0.0] * 7)]
    rows += [(54, None, []), (None, 3, [0.5] * 8), (None, 3, [0.25] * 8), (55, None, [0.1, -0.2, 0.3]), (56, 2, [-0.0] * 8)]
    assert found(frame_of(spark, rows), entries=6) == plain(rows, entries=6)
    assert vc.compress_vectors(frame_of(spark, rows).limit(0)).collect() == []
    assert found(frame_of(spark, [(50, 1, None)])) == []


def test_ties_go_to_the_lower_index(spark):
    rows = [(i, 0, [x / 1024] * 4) for i, x in enumerate([0, 10, 5, 5, 5, 15, 10])]
    assert found(frame_of(spark, rows), entries=2, rounds=0) == plain(rows, entries=2, rounds=0)
    assert found(frame_of(spark, rows), entries=2) == plain(rows, entries=2)


def test_huge_components_do_not_overflow(spark):
    rows = [(i, 0, [3e38 * (-1) ** i] * 64) for i in range(4)] + [(9, 0, [1.0] * 64)]
    got = vc.compress_vectors(frame_of(spark, rows), entries=1).collect()
    assert len(got) == 5 and all(0 < r["error"] < 2**63 and r["label_error"] >= r["error"] for r in got)


def test_pivots_spare_evaluations_and_lose_nothing():
    rng = np.random.default_rng(7)
    centres = rng.integers(-900, 900, (64, 16))
    points = (centres[rng.integers(0, 64, 3000)] + rng.integers(-40, 40, (3000, 16))).astype(np.int64)
    entries = np.concatenate([points[:200], points[:20]])  # ties
    pivots = vc.choose_pivots(entries, vc.PIVOTS)
    index, far, made = vc.nearest_entries(points, np.sqrt(vc.squared(points, pivots)), entries, np.sqrt(vc.squared(entries, pivots)))
    full = vc.squared(points, entries)
    assert (index == full.argmin(1)).all() and (far == full.min(1)).all()
    assert made < 0.25 * full.size


def test_whole_table_equals_a_plain_run(spark, small):
    frame = spark.read.parquet(f"{small}/embeddings.parquet")
    rows = [(r["vec_id"], r["label"], r["embedding"]) for r in frame.collect()]
    assert found(frame, entries=16, rounds=2) == plain(rows, entries=16, rounds=2)
