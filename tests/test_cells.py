"""Searches by cell bounds: the same rows as scoring every song, from a part of the cells."""

import math
import random

import pytest
from pyspark.sql import functions as F

from cadenza.functions import audio
from cadenza.operators import cells as ce
from tests.test_scoring import plain_similarity

NAMES = list(audio.STANDARD_WEIGHTS)


def clustered(n, seed):
    """Songs around a few centres, so that most cells are far from any one seed; some NaN and NULL features, and ties."""
    rng = random.Random(seed)
    centres = [{m: rng.random() for m in NAMES} for _ in range(12)]
    rows = []
    for i in range(n):
        centre = rng.choice(centres)
        row = {m: min(1.0, max(0.0, rng.gauss(centre[m], 0.04))) for m in NAMES}
        row |= {"tempo": 60 + 140 * row["tempo"], "loudness": -60 + 60 * row["loudness"]}
        rows.append((i, row))
    for i in range(0, n, 97):
        rows[i][1][rng.choice(NAMES)] = rng.choice([None, math.nan])
    for i in range(0, n - 1, 50):
        rows[i + 1] = (i + 1, dict(rows[i][1]))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, *[r[m] for m in NAMES]) for i, r in rows], "song_id long, " + ", ".join(f"{m} double" for m in NAMES))


@pytest.mark.parametrize("weights,floor,own", [(audio.STANDARD_WEIGHTS, 0.0, True), (audio.VIDEO_WEIGHTS, 0.9, False)])
def test_same_rows_from_fewer_cells(spark, weights, floor, own):
    rows = clustered(3000, 5)
    table = ce.build_cells(frame(spark, rows).repartition(4), per_cell=40)
    assert table.bounds.agg(F.sum("n")).first()[0] == 3000
    seeds = [rows[i] for i in (3, 97, 700, 1501)] + [(9001, {m: 0.5 for m in NAMES} | {"tempo": 500.0})]
    asked = frame(spark, seeds).withColumnRenamed("song_id", "seed_id")
    found = ce.nearest_by_audio(table, asked, 5, weights, floor, exclude_self=own)
    got = sorted((r["seed_id"], r["rank"], r["song_id"], r["audio"]) for r in found.best.collect())
    want = []
    for s, seed in seeds:
        scored = [(-round(plain_similarity(seed, r, weights), 6), i) for i, r in rows if not own or i != s]
        scored = sorted((x, i) for x, i in scored if -x >= floor)[:5]
        want += [(s, n, i, pytest.approx(-x, abs=2e-6)) for n, (x, i) in enumerate(scored, 1)]
    assert len(got) == len(want)
    assert [(a, b, d) for a, b, _, d in got] == [(a, b, d) for a, b, _, d in want]
    visits = found.visits.groupBy("seed_id").agg(F.sum("n").alias("n")).collect()
    assert all(v["n"] < 1500 for v in visits if v["seed_id"] != 9001), visits


def test_unvisited_cells_are_not_read(spark):
    rows = clustered(2000, 9)
    table = ce.build_cells(frame(spark, rows), per_cell=40)
    asked = frame(spark, rows[10:11]).withColumnRenamed("song_id", "seed_id")
    found = ce.nearest_by_audio(table, asked, 3)
    visited, cells = found.visits.select("cell").distinct().count(), table.bounds.count()
    assert visited < cells / 2
    plan = found.best._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan


def test_small_and_empty_catalogs(spark):
    rows = clustered(4, 1)
    table = ce.build_cells(frame(spark, rows), per_cell=1)
    asked = frame(spark, rows).withColumnRenamed("song_id", "seed_id")
    assert ce.nearest_by_audio(table, asked, 10).best.count() == 12
    empty = ce.build_cells(frame(spark, rows).limit(0))
    assert ce.nearest_by_audio(empty, asked, 10).best.count() == 0
