"""Heavy work on texts is dealt by the size of their files, not by how they lie in them, and weighed in stretches of texts."""

import os
import random

from pyspark.sql import functions as F

from cadenza.operators import models, sentiment as se
from cadenza.plans import features as fe
from cadenza.session import parts_for, work_path
from cadenza.workload import inputs


def written(spark, rows, schema, name):
    """One file, however many rows."""
    path = work_path(spark, name)
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
    return spark.read.parquet(path)


def test_parts_follow_the_files_sizes(spark):
    df = written(spark, [(i, os.urandom(500).hex()) for i in range(400)], "id long, text string", "sized")
    cores = spark.sparkContext.defaultParallelism
    assert parts_for(df, 1 << 30) == cores and parts_for(df, 1000) > 100
    assert parts_for(df.withColumn("words", F.split("text", "0")), 1000) == parts_for(df, 1000)
    assert parts_for(spark.range(5).toDF("id"), 1000) == cores


def test_topic_passes_meet_bounded_parts(spark, monkeypatch):
    """words of one file are counted in parts by its size, and a pass adds up few tables of the vocabulary's size."""
    rows = [(i, [f"w{(i * 7 + j * j) % 90}" for j in range(30)]) for i in range(600)]
    docs = written(spark, rows, "song_id long, tokens array<string>", "topics")
    seen = {}

    def watched(kind):
        class Watched(kind):
            def fit(self, rows):
                seen[kind.__name__] = rows.rdd.getNumPartitions()
                return super().fit(rows)

        return Watched

    cores = spark.sparkContext.defaultParallelism
    size = os.path.getsize(docs.inputFiles()[0].removeprefix("file://"))
    monkeypatch.setattr(models, "TEXT_BYTES", size // (3 * cores), raising=False)
    monkeypatch.setattr(models, "COUNT_PARTS", cores + 2, raising=False)
    monkeypatch.setattr(models, "CountVectorizer", watched(models.CountVectorizer))
    monkeypatch.setattr(models, "LDA", watched(models.LDA))
    model = models.fit_topics(docs, "tokens", k=3, passes=2, no_below=2, no_above=1.0)
    assert seen["CountVectorizer"] >= 3 * cores and seen["LDA"] == cores + 2
    assert models.topic_keywords(model, 4).count() == 12


def test_feature_texts_are_dealt_evenly_once(spark, monkeypatch):
    """rows that a join leaves in one file reach every core, and texts pass the join once for the three legs."""
    rows = [(i, f"song {i}", "good day not bad at all! " * (i % 9 + 1)) for i in range(400)]
    docs = written(spark, rows, "song_id long, track_name string, lyrics string", "even").where("song_id < 80")
    joined = docs.join(spark.range(80).withColumnRenamed("id", "song_id"), "song_id")
    lexicon = spark.createDataFrame([("good", 2.0, 0.5, 0.5), ("bad", -2.0, -0.5, 0.5)], "term string, valence double, polarity double, subjectivity double")
    held = {}

    def watched(df, label):
        path = work_path(df.sparkSession, label)
        df.write.parquet(path)
        held[label] = path
        return df.sparkSession.read.parquet(path)

    monkeypatch.setattr(fe, "write_and_read", watched, raising=False)
    out = fe.build_features(joined, lexicon)
    assert list(held) == ["feature-texts"]
    sizes = [r["count"] for r in spark.read.parquet(held["feature-texts"]).groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) == spark.sparkContext.defaultParallelism and max(sizes) <= 2 * min(sizes)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [song_id") == 3 and "Range" not in plan
    got = {r["song_id"]: r for r in out.collect()}
    assert len(got) == 80 and got[3]["track_name"] == "song 3" and got[3]["terms_sq"] > 0 and got[3]["pos"] > 0


def test_few_files_do_not_bind_the_lexicon_to_few_cores(spark, monkeypatch):
    docs = written(spark, [(i, "sun sea sand " * 20) for i in range(300)], "doc_id long, text string", "words")
    seen = {}
    kept = inputs.write_and_read

    def watched(df, label):
        seen[label] = df._jdf.queryExecution().executedPlan().toString()
        return kept(df, label)

    monkeypatch.setattr(inputs, "table", lambda *_: docs)
    monkeypatch.setattr(inputs, "spread_table", lambda *_: docs, raising=False)  # a table too large to be spread
    monkeypatch.setattr(inputs, "write_and_read", watched)
    words = {r["term"] for r in inputs.lexicon(spark, "").collect()}
    assert words == {"sun", "sea", "sand"} and "RoundRobinPartitioning" in seen["word-counts"]


def test_sentiment_in_rows_equals_the_joins(spark, monkeypatch):
    """Every rule, by words that meet at random; ids that are null or repeat are summed as before."""
    rng = random.Random(11)
    words = [
        "good", "GOOD", "bad", "Bad!", "fine", "so", "this", "never", "NEVER", "without", "doubt", "least", "at", "very", "VERY", "kind", "sort", "of",
        "just", "enough", "but", "BUT", "not", "isn't", "slightly", "a", ":)", "(good)", "--", "ok?", "!!", "straße", "ΣΟΦΟΣ", "\u00a0", "x\u2003good",
    ]
    spaces = [" ", "  ", "\n", "\t", "\u000b", "\u00a0", "\u0085"]
    texts = ["".join(rng.choice(words) + (rng.choice(spaces) if rng.random() < 0.3 else " ") for _ in range(rng.randrange(40))) for _ in range(1500)]
    rows = [(i if i % 50 else i // 100, t) for i, t in enumerate(texts)] + [(None, "good"), (5000, None), (5001, ""), (5002, " ! ?? ")]
    docs = spark.createDataFrame(rows, "id long, body string").repartition(5)
    terms = [("good", 1.9), ("bad", -2.5), ("fine", 0.8), ("so", 1.0), ("least", -0.3), ("not", None), ("of", 0.0), (":)", 2.0), ("σοφος", 1.5), ("\u03c3\u03bf\u03c6\u03bf\u03c2", 1.1), (None, 3.0)]
    terms = list(dict(terms).items())
    lexicon = spark.createDataFrame(terms, "term string, valence double")
    by_rows, by_join = (se.lexicon_sentiment(docs, "id", "body", lexicon, in_rows=r) for r in (True, False))
    assert "MapInArrow" in by_rows._jdf.queryExecution().toString() and "MapInArrow" not in by_join._jdf.queryExecution().toString()
    as_set = lambda df: sorted(map(str, df.collect()))
    assert as_set(by_rows) == as_set(by_join)
    # A lexicon that is large or names a term twice is joined.
    twice = lexicon.union(lexicon.limit(1))
    assert se._held(twice) is None
    monkeypatch.setattr(se, "MOST_TERMS", 3)
    assert se._held(lexicon) is None and "MapInArrow" not in se.lexicon_sentiment(docs, "id", "body", lexicon, in_rows=True)._jdf.queryExecution().toString()
