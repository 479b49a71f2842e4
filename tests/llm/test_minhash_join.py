"""Near duplicates against all pairs, and components against union-find."""

import random
import re

import numpy as np
import pytest

from cadenza.llm import minhash_join as mj
from cadenza.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_set(text, width):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    if not words:
        return frozenset()
    if len(words) < width:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def roots(nodes, links):
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            up[n] = up[up[n]]
            n = up[n]
        return n

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {n: root(n) for n in nodes}


def plain_components(rows, width):
    """Row number -> (set size, least key of the rows linked), for rows with a key."""
    sets = [plain_set(t, width) for _, t in rows]
    able = [i for i, (k, _) in enumerate(rows) if k is not None and sets[i]]
    links = [
        (i, j) for n, i in enumerate(able) for j in able[n + 1 :]
        if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])
    ]
    root = roots(able, links)
    least = {}
    for i in able:
        least[root[i]] = min(least.get(root[i], rows[i][0]), rows[i][0])
    return [(k, len(sets[i]), least[root[i]] if i in root else k) for i, (k, _) in enumerate(rows)]


def compare(docs, width):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    order = lambda r: tuple((v is not None, v or 0) for v in r)
    got = mj.near_duplicates(docs, width=width).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=order) == sorted(
        plain_components(rows, width), key=order
    )
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    return got


@pytest.mark.parametrize("width", [2, 5])
def test_documents(documents, width):
    assert any(not r["kept"] for r in compare(documents, width))


def near_copies(seed, words=60, copies=40):
    """A chain and a crowd of near copies around one text, and texts that share its line."""
    rng = random.Random(seed)
    base = [f"b{seed}w{rng.randrange(500)}" for _ in range(words)]
    out = []
    for _ in range(copies):
        text = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 4])):
            text[rng.randrange(words)] = f"x{rng.randrange(10_000)}"
        out.append(" ".join(text))
    chain = list(base)
    for i in range(0, words, 3):
        chain[i] = f"c{i}"
        out.append(" ".join(chain))
    for _ in range(copies):
        own = [f"y{rng.randrange(10_000)}" for _ in range(rng.choice([5, 20, 80]))]
        out.append(" ".join(own + base[: rng.choice([5, 15, 40])]))
    return out


@pytest.mark.parametrize("width,block", [(2, mj.BLOCK), (5, mj.BLOCK), (2, 16)])
def test_crowds_chains_and_shared_lines(spark, width, block, monkeypatch):
    # Small blocks and lists, so that every path is taken.
    monkeypatch.setattr(mj, "BLOCK", block)
    monkeypatch.setattr(mj, "SHORT_LIST", block // 2)
    texts = [t for seed in range(6) for t in near_copies(seed)]
    random.Random(9).shuffle(texts)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    compare(docs, width)


def test_odd_documents(odd_documents, no_documents):
    got = compare(odd_documents, 2)
    assert {(r["component_id"], r["n_shingles"]) for r in got if r["doc_id"] in (6, 7)} == {(6, 1)}
    assert all(r["kept"] for r in got if r["doc_id"] in (3, 4, 5, None))
    assert mj.near_duplicates(no_documents).collect() == []


def test_keep_one(odd_documents, no_documents):
    kept = mj.keep_one(odd_documents)
    assert kept.columns == odd_documents.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 3, 4, 5, 6, 8, 10, 11] and ids.count(None) == 2
    assert mj.keep_one(no_documents).collect() == []


def test_prefix_of_any_order_meets(spark):
    # Signatures with exactly the least agreement always share a posted pair.
    rng = np.random.default_rng(5)
    rows = []
    for pair in range(50):
        a = rng.integers(0, 2**32, mj.COORDINATES, dtype=np.uint64).astype(np.uint32)
        b = rng.integers(0, 2**32, mj.COORDINATES, dtype=np.uint64).astype(np.uint32)
        same = rng.choice(mj.COORDINATES, mj.MATCHES, replace=False)
        b[same] = a[same]
        rows += [(2 * pair, bytearray(a.tobytes())), (2 * pair + 1, bytearray(b.tobytes()))]
    classes = spark.createDataFrame(rows, "node long, signature binary")
    posted = mj.postings(classes, mj.COORDINATES, mj.MATCHES).collect()
    assert all(r["often"] >= sum(x["token"] == r["token"] for x in posted) for r in posted[:50])
    by_token = {}
    for r in posted:
        by_token.setdefault(r["token"], set()).add(r["node"])
    met = {tuple(sorted(s)) for s in by_token.values() if len(s) > 1}
    assert met == {(2 * p, 2 * p + 1) for p in range(50)}


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(rng.choice([20, 150, 400]))]
    links += [(n, n + 1) for n in range(1000, 1080)] + [(5000, n) for n in range(2000, 2300)]
    rng.shuffle(links)
    frame = spark.createDataFrame([*links, (None, 4), (7, None), (9, 9)], "a long, b long")
    real = [(a, b) for a, b in links if a != b]
    want = roots({n for pair in real for n in pair}, real)
    got = {r["node"]: r["component"] for r in components(frame, "a", "b").collect()}
    assert got == want
    assert components(frame.limit(0), "a", "b").collect() == []


def test_keep_one_decides_by_row(spark):
    words = lambda name: " ".join(f"{name}{i}" for i in range(40))
    rows = [
        (1, words("a")), (7, words("b")), (7, words("c")),  # unlike texts under one key
        (8, words("a")), (8, words("d")),  # one a copy of an earlier document, one clean
        (9, words("b") + " tail"), (9, ""), (9, None), (9, " "),  # a near copy, and texts without words
        (10, words("e")), (10, words("e")), (10, words("e") + " tail"),  # copies under one key
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    left = [(r["doc_id"], r["text"]) for r in mj.keep_one(docs).collect()]
    sure = [(1, words("a")), (7, words("b")), (7, words("c")), (8, words("d")), (9, ""), (9, None), (9, " ")]
    order = lambda r: (r[0], r[1] is not None, r[1] or "")
    assert sorted((r for r in left if r[0] != 10), key=order) == sorted(sure, key=order)
    assert len([r for r in left if r[0] == 10]) == 1


def test_texts_under_one_key_are_not_multiplied(spark):
    texts = near_copies(3)
    docs = spark.createDataFrame([(5, t) for t in texts], "doc_id long, text string")
    signed = mj.sign_documents(docs, "doc_id", "text", 2, mj.COORDINATES)
    wanted = signed.selectExpr("node", "struct(doc_id AS key, name) AS member").distinct()
    sets = mj.full_sets(docs, "doc_id", "text", 2, wanted)
    joined = sets._jdf.queryExecution().optimizedPlan().toString()
    assert "xxhash64" in joined and sets.count() == wanted.select("node").distinct().count()


def test_any_column_names_and_null_keys(spark):
    words = lambda name: " ".join(f"{name}{i}" for i in range(40))
    names = ["_member", "_wanted", "_text_name", "_key", "key", "name", "node", "own_key", "row", "gone", "body", "wanted"]
    rows = [(1, words("a")), (2, words("a") + " tail"), (None, words("a")), (None, words("b")), (None, words("b")), (3, words("c")), (3, words("c"))]
    docs = spark.createDataFrame([(*r, *[9 - i] * len(names)) for i, r in enumerate(rows)], ["doc_id", "text", *names])
    assert sorted(r["component_id"] for r in mj.near_duplicates(docs).collect() if r["doc_id"] is not None) == [1, 1, 3, 3]
    kept = mj.keep_one(docs)
    assert kept.columns == docs.columns
    left = sorted(((r["doc_id"] or 0, r["text"], r["row"]) for r in kept.collect()))
    assert left == [(0, words("b"), 5), (1, words("a"), 9), (3, words("c"), 3)]
