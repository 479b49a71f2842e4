"""The kept neighbour index: recall against exact neighbours, appending without a rebuild, cells read."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import neighbour_index as ni, scoring as sc, spaces as vs
from cadenza.workload import similarity as ws
from cadenza.workload.inputs import song_features

K = 10


def recall(got, want):
    """Share of the exact neighbours found, where equal cosines (to the last of six digits) count alike."""
    found, sought = {}, {}
    for rows, out in ((got, found), (want, sought)):
        for r in rows:
            out.setdefault(r["seed_id"], []).append(1 - r["distance"] ** 2 / 2)
    hits = sum(min(sum(c >= min(w) - 1.5e-6 for c in found.get(s, [])), len(w)) for s, w in sought.items())
    return hits / sum(map(len, sought.values()))


@pytest.mark.parametrize("name", list(ws.SPACES))
def test_recall_of_all_spaces_after_appending(spark, name):
    space = ws.space_of(song_features(spark, "/root/testdata/sf0.01"), name).persist()
    half = F.col("song_id") % 2 == 0
    index = ni.build(space.where(half), per_cell=25, k=K)
    before = index.cells.select("song_id", "cell", "code")
    files = set(before.inputFiles())
    ni.extend(index, space.where(~half))
    after = set(index.cells.inputFiles())
    # Appending adds files and rewrites none.
    assert files < after and len(index.centroids) > 4
    seeds = sc.as_seeds(space.where("song_id % 9 = 0"), ["v"])
    found = ni.search(index, seeds, K)
    got, want = found.best.collect(), vs.angular_neighbours(space, seeds, K).collect()
    assert len(got) == len(want)
    assert recall(got, want) >= 0.9
    exact = {(r["seed_id"], r["song_id"]): r["distance"] for r in vs.angular_neighbours(space, seeds, 500).collect()}
    assert all(exact[r["seed_id"], r["song_id"]] == pytest.approx(r["distance"], abs=2e-3) for r in got)
    space.unpersist()


def test_a_search_reads_only_probed_cells(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 8))
    rows = [(i, (centres[i % 20] + rng.normal(scale=0.05, size=8)).tolist()) for i in range(2000)]
    space = spark.createDataFrame([*rows, (9000, [0.0] * 8)], "song_id long, v array<double>")
    index = ni.build(space, per_cell=100)
    assert index.cells.count() == 2000 and index.probes < 5
    found = ni.search(index, sc.as_seeds(space.where("song_id = 7"), ["v"]), 5)
    assert found.probed.count() == index.probes
    assert re.search(r"PartitionFilters: \[[^\]]*cell", found.best._jdf.queryExecution().executedPlan().toString())
    assert all(r["song_id"] % 20 == 7 and r["song_id"] != 7 for r in found.best.collect())


def test_small_indexes(spark):
    space = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0])], "song_id long, v array<double>")
    seeds = sc.as_seeds(space, ["v"])
    assert {(r["seed_id"], r["song_id"]) for r in ni.search(ni.build(space), seeds, 5).best.collect()} == {(1, 2), (2, 1)}
    empty = ni.build(space.limit(0))
    assert empty.cells.count() == 0
