"""Deep pages against a plain sort, and the ranges they read."""

import random
import re

from pyspark.sql import functions as F

from cadenza.operators import paging as pg


def test_pages_at_any_depth(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([None, *range(40)]), f"t{rng.randrange(30)}") for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, score int, title string").repartition(5)
    kept = pg.paged(df, [F.desc_nulls_last("score"), "title", "id"], range_rows=200)
    want = [r[0] for r in sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[2], r[0]))]
    assert kept.total == 3000 and len(kept.starts) > 8
    for offset, limit in ((0, 10), (195, 20), (1499, 1), (2900, 200), (2990, 10), (3000, 5), (0, 0)):
        got = [(r["place"], r["id"]) for r in kept.page(offset, limit).collect()]
        assert got == [(offset + i + 1, w) for i, w in enumerate(want[offset : offset + limit])]


def test_a_deep_page_reads_its_ranges_only(spark):
    df = spark.range(10_000).select("id", (F.col("id") * 7919 % 10_007).alias("key"))
    kept = pg.paged(df, ["key"], range_rows=500)
    page = kept.page(9000, 20)
    plan = page._jdf.queryExecution().executedPlan().toString()
    wanted = re.search(r"PartitionFilters: \[[^\]]*_range", plan)
    assert wanted and len(kept.starts) > 10
    assert page.select(F.input_file_name().alias("f")).distinct().count() <= 2


def test_a_long_result_has_no_more_ranges_than_the_driver_bears(spark):
    df = spark.range(3000).select("id", (F.col("id") * 7919 % 3001).alias("key"))
    kept = pg.paged(df, ["key"], range_rows=5)
    assert 100 < len(kept.starts) <= pg.MOST_RANGES and kept.total == 3000
    want = sorted(range(3000), key=lambda i: i * 7919 % 3001)[2250:2300]
    assert [(r["place"], r["id"]) for r in kept.page(2250, 50).collect()] == [(2251 + i, w) for i, w in enumerate(want)]


def test_empty_result(spark):
    kept = pg.paged(spark.range(0), ["id"])
    assert kept.total == 0 and kept.page(0, 10).collect() == []
