"""Ranked search against a plain scorer over all documents and items."""

import math
import re
from collections import Counter

import pytest

from cadenza.llm import bag_search as bs

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, top=bs.TOP):
    bags = [(k, Counter(terms(t))) for k, t in docs]
    count = sum(1 for _, b in bags if b)
    length = sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        asked = terms(text)
        scored = []
        for k, b in bags:
            if b:
                m = 75 + (25 * b.total() * count) // length
                s = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 12 * m)) for t in asked if b[t])
                if s > 0:
                    scored.append((-s, k is None, k or 0, k))
        out += [(item, n, k, -s) for n, (s, _, _, k) in enumerate(sorted(scored, key=lambda r: r[:3])[:top], 1)]
    return sorted(out, key=repr)


def found(docs, items, **more):
    rows = bs.search(docs, items, **more).collect()
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in rows), key=repr)


def pairs(frame):
    return [tuple(r) for r in frame.collect()]


def test_whole_tables(spark, small, documents):
    items = spark.read.parquet(f"{small}/benchmark.parquet")
    want = plain(pairs(documents.select("doc_id", "text")), pairs(items.select("item_id", "text")))
    assert found(documents, items) == want
    # Blocks of few items each give the same.
    assert found(documents, items.limit(5), block_bytes=300) == plain(
        pairs(documents.select("doc_id", "text")), pairs(items.limit(5).select("item_id", "text"))
    )


def test_odd_tables(spark, odd_documents, no_documents):
    rows = [(1, "two TWO three"), (1, "two TWO three"), (2, None), (3, ""), (None, "word"), (4, "!!! --"), (5, "ünï çödé 0"), (6, "absent"), (7, "W5X5 same LINE the")]
    items = spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], "item_id long, text string, doc_id string, rank int, score int")
    docs = odd_documents.drop("kept", "shard", "word")
    assert found(odd_documents, items) == plain(pairs(docs.select("doc_id", "text")), rows)
    assert found(no_documents, items) == [] and found(odd_documents, items.limit(0)) == []


def test_classes_expand_by_ascending_key(spark):
    # Two classes that tie, interleaved, with more members than are returned, and one hot text.
    texts = ["alpha beta", "beta alpha"]
    rows = [(i, texts[i % 2]) for i in range(60)] + [(100 + i, "gamma " * 3 + "delta") for i in range(60)] + [(500, "alpha " * 40), (501, "other")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    items = spark.createDataFrame([(1, "alpha"), (2, "gamma delta delta"), (3, "beta alpha gamma")], "item_id long, text string")
    got = found(docs, items)
    assert got == plain(rows, pairs(items)) and len(got) == 60
    assert found(docs, items, top=3) == plain(rows, pairs(items), top=3)


def test_long_items_sum_in_halves(spark, monkeypatch):
    rows = [(i, f"rare{i} " * (i + 1) + "common") for i in range(40)]
    items = [(1, "rare3 " * 3_000_000), (2, "rare7 common")]
    docs, asked = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert found(docs, asked) == plain(rows, items)


def test_hashes_are_verified(monkeypatch):
    raw, offsets = bs.at.as_binary(bs.pa.array(["one two"], bs.pa.large_string()))
    monkeypatch.setattr(bs.at, "run_hashes", lambda codes, starts, ends: bs.np.zeros(len(starts), bs.np.uint64))
    with pytest.raises(ValueError):
        bs.items_of([1], ["one two"])
