"""Label model on planted labellers, and verdicts against the given labels."""

import numpy as np
import pytest

from cadenza.llm import weak_labels as wl


def test_em_finds_planted_accuracies():
    rng = np.random.default_rng(1)
    accuracy, coverage = np.array([0.95, 0.9, 0.8, 0.7, 0.85]), np.array([0.9, 0.8, 0.9, 0.9, 0.7])
    bad = rng.random(60_000) < 0.5
    right = rng.random((60_000, 5)) < accuracy
    table = np.where(right == bad[:, None], wl.BAD, wl.GOOD)
    table = np.where(rng.random(table.shape) < coverage, table, wl.ABSTAIN)
    patterns, counts = np.unique(wl.pattern_of(table), return_counts=True)
    assert (wl.votes_of(wl.pattern_of(table), 5) == table).all()
    model = wl.fit_label_model(patterns, counts, 5)
    assert np.abs(model.accuracy - accuracy).max() < 0.02
    assert ((model.posterior(table) > 0.5) == bad).mean() > 0.96


def test_em_tells_one_sided_labellers_apart():
    """Labellers that only vote bad, or only good, and never disagree."""
    rng = np.random.default_rng(2)
    bad = rng.random(40_000) < 0.1
    table = np.full((40_000, 4), wl.ABSTAIN)
    for j in (0, 1):
        table[bad & (rng.random(40_000) < 0.6), j] = wl.BAD
    for j in (2, 3):
        table[~bad & (rng.random(40_000) < 0.9), j] = wl.GOOD
    patterns, counts = np.unique(wl.pattern_of(table), return_counts=True)
    model = wl.fit_label_model(patterns, counts, 4)
    seen = (table != wl.ABSTAIN).any(1)
    assert ((model.posterior(table) > 0.5) == bad)[seen].mean() > 0.999


def test_em_without_texts():
    model = wl.fit_label_model(np.zeros(0, np.int64), np.zeros(0), 9)
    assert (model.accuracy == 0.8).all()


def test_verdicts_against_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    # Labels of even ids teach the abusive words, those of odd ids measure.
    out = wl.classify_documents(docs, labels.where("doc_id % 2 = 0"))
    rows = out.join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    toxic = [r["kept"] for r in rows if r["toxic"] == 1]
    clean = [r["kept"] for r in rows if r["toxic"] == 0 and r["quality"] == 1]
    junk = [r["kept"] for r in rows if r["quality"] == 0]
    assert len(toxic) > 50 and np.mean(toxic) < 0.05
    assert np.mean(clean) > 0.99
    assert len(junk) > 50 and np.mean(junk) < 0.2


def test_odd_documents(spark, odd_documents, no_documents):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    odd = spark.createDataFrame([(1, 1, None), (None, 0, 1), (1, 1, 0), (1, 1, 0), (2, 0, 1)], none.schema)
    for labels in (none, odd):
        rows = wl.classify_documents(odd_documents, labels).collect()
        assert len(rows) == odd_documents.count()
        assert all(0 <= r["bad_score"] <= 1 and len(r["votes"]) == len(wl.LABELLERS) for r in rows)
    kept = wl.keep_good(odd_documents, none)
    assert kept.columns == odd_documents.columns and {r["n_words"] for r in kept.collect()} <= {-1}
    assert wl.classify_documents(no_documents, none).collect() == []
    assert wl.keep_good(no_documents, odd).collect() == []


def test_markers_spread_over_many_rare_words(spark):
    """Each abusive word is in one of a hundred toxic texts, in two languages; clean rare words and near copies are no markers."""
    rng = np.random.default_rng(5)
    bad = {"en": [f"vile{i}" for i in range(200)], "de": [f"boese{i}" for i in range(200)]}
    plain = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(6000):
        lang = "en" if i % 2 else "de"
        words = [str(w) for w in rng.choice(plain, 40)] + [f"rare{rng.integers(900)}"]
        toxic = i % 5 == 0
        if toxic:
            words += [str(w) for w in rng.choice(bad[lang], 2, replace=False)]
        rows.append((i, " ".join(words), lang))
        labels.append((i, 1, int(toxic)))
    copied = " ".join([*rng.choice(plain, 40), "onlyhere", "andhere"])
    for i in range(60):  # near copies of one toxic text
        rows.append((7000 + i, f"{copied} tail{i % 3}", "en"))
        labels.append((7000 + i, 1, 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = set(wl.learn_markers(docs, told, "doc_id", "text", "lang").tolist())
    raw = lambda w: np.frombuffer(w.encode(), np.uint8)
    name = lambda w: int(wl.at.words_of(raw(w), np.array([0, len(w)]), lower=True).hashes[0])
    for lang in bad:
        assert np.mean([name(w) in found for w in bad[lang]]) > 0.8
    assert not any(name(w) in found for w in [*plain, *(f"rare{i}" for i in range(900)), "onlyhere", "andhere"])


def test_repeated_rows_do_not_fill_the_training_task(spark, monkeypatch):
    monkeypatch.setattr(wl, "TRAINING_SAMPLE", 50)
    rows = [(1, "the same text here again and again.")] * 3000 + [(i, f"word{i} is here with other words today.") for i in range(2, 200)]
    docs = spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, lang string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = wl.fit(docs, none)
    assert np.isfinite(model.weights).all() and model.weights.any()


def plain_posteriors(table, rounds=500):
    """EM of independent labellers in plain loops."""
    n, m = table.shape
    right = [0.8] * m
    for _ in range(rounds):
        bad = []
        for row in table:
            odds = 0.0
            for j, v in enumerate(row):
                odds += (int(v) - 1) * np.log(right[j] / (1 - right[j]))
            bad.append(1 / (1 + np.exp(-odds)))
        for j in range(m):
            hits, given = wl.PRIOR_RIGHT, wl.PRIOR_VOTES
            for row, b in zip(table, bad):
                given += row[j] != wl.ABSTAIN
                hits += b if row[j] == wl.BAD else 1 - b if row[j] == wl.GOOD else 0
            right[j] = min(0.999, max(0.55, hits / given))
    return np.array(right), np.array(bad)


def test_votes_and_posteriors_equal_a_plain_run(spark, documents):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = wl.classify_documents(documents, none).collect()
    table = np.array([r["votes"] for r in rows]) + 1
    patterns, counts = np.unique(wl.pattern_of(table), return_counts=True)
    model = wl.fit_label_model(patterns, counts, table.shape[1], rounds=500)
    right, bad = plain_posteriors(table[:, :], rounds=60)
    assert np.abs(model.accuracy - right).max() < 1e-3
    assert np.abs(np.array([r["weak_bad"] for r in rows]) - bad).max() < 1e-2
    # The plainest labellers, counted anew from the texts.
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    for r in rows:
        words = [w for w in wl_words(texts[r["doc_id"]])]
        symbols = sum(c in "#*$%&|<>" for c in texts[r["doc_id"]]) / max(1, len(words))
        adjacent = sum(a == b for a, b in zip(words, words[1:])) / max(1, len(words))
        assert (r["votes"][0] == 1) == (symbols > 0.05) and (r["votes"][1] == 1) == (adjacent > 0.2)


def wl_words(text):
    import re

    return re.findall("[^\x20\x09-\x0d]+", text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
