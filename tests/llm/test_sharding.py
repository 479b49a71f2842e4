"""Rendezvous sharding: the law, gapless slots, weights, growth."""

import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from cadenza.llm import sharding


def test_documents(spark, documents):
    rows = sharding.shard_documents(documents, [1.0] * 8).collect()
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    slots = defaultdict(list)
    for r in rows:
        body = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(body) + 1, zlib.crc32(body), "key")
        assert r["grown_shard"] in (r["shard"], 8)
        slots[r["shard"]].append(r["slot"])
    assert len(rows) == len(texts)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(8))


def test_odd_rows_keep_the_law(spark, odd_documents):
    rows = sharding.shard_documents(odd_documents, [1.0] * 8).collect()
    assert len(rows) == odd_documents.count()
    by_key = defaultdict(set)
    for r in rows:
        by_key[r["doc_id"]].add((r["shard"], r["grown_shard"]))
    assert all(len(s) == 1 for s in by_key.values())
    assert {(r["size"], r["text_crc32"]) for r in rows if r["doc_id"] in (3, 4)} == {(1, 0)}
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_hot_key_and_repeated_rows(spark):
    docs = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("doc_id"), F.lit("t").alias("text"))
    rows = sharding.shard_documents(docs, [1.0] * 8).collect()
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(rows) == 3000


def test_weights_and_growth(spark):
    keys = spark.range(20_000).withColumnRenamed("id", "k")
    weights = [1.0, 2.0, 0.0, 5.0]
    out = keys.select(
        sharding.rendezvous_shard(["k"], weights).alias("a"), sharding.rendezvous_shard(["k"], [*weights, 2.0]).alias("b")
    ).collect()
    share = Counter(r["a"] for r in out)
    assert share[2] == 0
    for shard, weight in enumerate(weights):
        assert share[shard] / 20_000 == pytest.approx(weight / 8, abs=0.015)
    assert all(r["b"] in (r["a"], 4) for r in out)
    assert sum(r["b"] == 4 for r in out) / 20_000 == pytest.approx(0.2, abs=0.015)


def test_bad_weights_and_empty(spark, no_documents):
    for weights in ([], [0.0], [-1.0, 2.0]):
        with pytest.raises(ValueError):
            sharding.rendezvous_shard(["k"], weights)
    assert sharding.shard_documents(no_documents, [1.0] * 3).collect() == []


def test_native_plan(documents):
    plan = sharding.shard_documents(documents, [1.0] * 8)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
