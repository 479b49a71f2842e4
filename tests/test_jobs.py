import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cadenza.operators import models, pages as pg, signal as sg
from cadenza.session import path_exists, work_path
from cadenza.sources import catalog as cat
from cadenza.streaming import quota, runs, views
from cadenza.workload import streams


def sine(spark, seconds=0.5, rate=22_050, hz=440.0):
    n = int(seconds * rate)
    wave = 0.5 * np.sin(2 * np.pi * hz * np.arange(n) / rate + 0.1)
    rows = pd.DataFrame({"series": 1, "pos": np.arange(n), "value": wave, "n": n})
    return spark.createDataFrame(rows), wave, rate


def plain_frames(wave, frame, hop):
    half, out = frame // 2, {}
    for f in range(len(wave) // hop + 1):
        lo, hi = max(0, f * hop - half), min(len(wave), f * hop + half)
        part = wave[lo:hi]
        crossings = int(np.sum(np.signbit(part[1:]) != np.signbit(part[:-1])))
        out[f] = (np.sqrt(np.sum(part**2) / frame), crossings / frame)
    return out


def test_frame_levels_of_a_sine(spark):
    samples, wave, _ = sine(spark)
    expected = plain_frames(wave, sg.FRAME, sg.HOP)
    got = {r.frame: (r.rms, r.zcr) for r in sg.frame_levels(samples).collect()}
    assert set(got) == set(expected)
    for f, pair in expected.items():
        assert got[f] == pytest.approx(pair, abs=2e-3 if f * sg.HOP < sg.FRAME else 1e-9)


def test_crossings_meet_across_blocks(spark):
    values = [(-1.0) ** i for i in range(50)]
    df = spark.createDataFrame([(1, i, v, 50) for i, v in enumerate(values)], "series INT, pos BIGINT, value DOUBLE, n BIGINT")
    got = sg.with_crossings(df, block=7).agg(F.sum("crossing").alias("c"), F.count("*").alias("n")).first()
    assert (got.c, got.n) == (49, 50)


def test_spectrum_of_a_sine(spark):
    samples, _, rate = sine(spark)
    inner = [r for r in sg.spectral_frames(samples, rate).collect() if 4 <= r.frame <= 15]
    assert inner and all(abs(r.centroid - 440) < 25 and r.flatness < 0.01 and r.rolloff < 500 for r in inner)


@pytest.mark.parametrize("frame,hop,n", [(8, 2, 21), (64, 16, 300), (2048, 512, 3000), (4, 4, 1)])
def test_spectrum_equals_a_plain_transform(spark, frame, hop, n):
    rng = np.random.default_rng(frame)
    wave = rng.normal(size=n)
    df = spark.createDataFrame([(1, i, float(v), n) for i, v in enumerate(wave)], "series INT, pos BIGINT, value DOUBLE, n BIGINT")
    # Without some of the samples, frames have holes, which count as 0.
    for keep in (np.ones(n, bool), rng.random(n) < 0.8 if n < 500 else np.ones(n, bool)):
        kept = df.where(F.col("pos").isin(np.flatnonzero(keep).tolist())) if not keep.all() else df
        got = {r.frame: (r.centroid, r.bandwidth, r.rolloff, r.flatness) for r in sg.spectral_frames(kept, 1000.0, frame, hop).collect()}
        padded = np.concatenate([np.zeros(frame), np.where(keep, wave, 0), np.zeros(frame)])
        hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(frame) / frame)
        for f, values in got.items():
            start = f * hop - frame // 2 + frame
            power = np.abs(np.fft.rfft(padded[start : start + frame] * hann)) ** 2
            size, hz = np.sqrt(power), np.arange(frame // 2 + 1) * 1000.0 / frame
            total = size.sum()
            centre = (hz * size).sum() / total if total > 0 else 0.0
            wide = math.sqrt((((hz - centre) ** 2) * size).sum() / total) if total > 0 else 0.0
            floored = np.maximum(power, 1e-10)
            rolloff = hz[np.flatnonzero(np.cumsum(size) >= 0.85 * total - 1e-12)[0]]
            assert values == (
                pytest.approx(centre, abs=1e-6), pytest.approx(wide, abs=1e-6), pytest.approx(rolloff),
                pytest.approx(np.exp(np.log(floored).mean()) / floored.mean(), rel=1e-6, abs=1e-9),
            ), f
        assert got


def test_positions_of_a_hot_series(spark):
    rng = random.Random(6)
    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(seconds=rng.randrange(600)), 1 if i % 3 else i % 5 + 2, rng.random()) for i in range(400)]
    df = spark.createDataFrame(rows, "event_id BIGINT, ts TIMESTAMP_NTZ, user_id INT, value DOUBLE")
    got = {(r.series, r.pos): (r.value, r.n) for r in sg.positioned(df, "user_id", "ts", "event_id", "value").collect()}
    for user in {r[2] for r in rows}:
        mine = sorted((r for r in rows if r[2] == user), key=lambda r: (r[1], r[0]))
        mean = sum(r[3] for r in mine) / len(mine)
        for pos, r in enumerate(mine):
            assert got[(user, pos)] == (pytest.approx(r[3] - mean), len(mine))


def test_trim_drops_silence_at_the_ends(spark):
    values = [0.0] * 100 + [0.5] * 100 + [0.0] * 50 + [0.5] * 20 + [0.0] * 130
    df = spark.createDataFrame([(1, i, v, 400) for i, v in enumerate(values)], "series INT, pos BIGINT, value DOUBLE, n BIGINT")
    kept = sg.trimmed(df, frame=8, hop=4).agg(F.min("pos").alias("a"), F.max("pos").alias("b"), F.count("*").alias("n")).first()
    assert kept.a in range(92, 101) and kept.b in range(269, 280) and kept.n == kept.b - kept.a + 1


HTML = """<html><script>var a = "<div class='lyrics'>no</div>";</script><div class="x MyLyricBox">{long}</div>
<div class="lyrics">one<p>two<div>three &amp; four</div></div><div data-lyrics-container="true">A<br>B</div><div data-lyrics-container="true">C</div></html>"""


def test_container_cascade(spark):
    long = "w" * 120
    page = HTML.format(long=long)
    without = page.replace("data-lyrics-container", "data-other")
    pages = [page, without, without.replace('class="lyrics"', 'class="none"'), "<div class='lyricish'>short</div>", None]
    rows = pg.page_texts(spark.createDataFrame(list(enumerate(pages)), "id INT, html STRING"), "id", "html").orderBy("id").collect()
    assert [r.text for r in rows] == ["A B\nC", "one two three & four", long, None, None]


def test_nested_containers_are_whole(spark):
    pages = [
        '<div class="lyrics">a<div>b<div>c</div>d</div>e</div>f',
        '<DIV Class="lyrics">a<div class="lyrics">b</DIV >c</div>d',
        '<div class="lyrics">a<div>b</div>c',  # never closed
        '</div><div class="lyrics">a</div>',  # a stray closing tag
        '<div data-lyrics-container="true">a<div data-lyrics-container="true">b</div>c</div><div data-lyrics-container="true">d</div>',
        '<divider class="lyrics">a</divider>', "", "<div",
    ]
    rows = pg.page_texts(spark.createDataFrame(list(enumerate(pages)), "id INT, html STRING"), "id", "html").orderBy("id").collect()
    assert [r.text for r in rows] == ["a b c d e", "a b c", "a b c", "a", "a b c\nb\nd", None, None, None]


def test_links_unwrap_redirects(spark):
    html = '<a href="/url?q=https://genius.com/a-lyrics/lyrics/&sa=1">x</a><a class="k" href="https://other.com/lyrics/">y</a>'
    df = spark.createDataFrame([(html, "https://g.com/search?q=1")], "html STRING, url STRING")
    links = pg.matching_links(F.col("html"), F.col("url"), ["genius.com", "/lyrics/"], r"(?:url\?q=)(https://genius.com[^&]+)")
    assert df.select(links.alias("l")).first().l == ["https://genius.com/a-lyrics/lyrics/"]


def test_topics_and_word_vectors(spark):
    rng = random.Random(7)
    themes = [["sun", "sea", "sand", "wave"], ["rain", "cloud", "storm", "wind"]]
    rows = [(i, [rng.choice(themes[i % 2]) for _ in range(30)]) for i in range(60)] + [(60, [])]
    docs = spark.createDataFrame(rows, "song_id BIGINT, tokens ARRAY<STRING>").cache()
    model = models.fit_topics(docs, "tokens", k=4, passes=5, no_above=1.0)
    got = {r.song_id: r.topics for r in models.topic_distributions(model, docs, "song_id", "tokens").collect()}
    assert got[60] == [0.0] * 4
    assert all(sum(t) == pytest.approx(1.0) and min(t) >= 0 for i, t in got.items() if i != 60)
    assert models.topic_keywords(model, 3).count() == 12
    vectors = {r.song_id: r.vector for r in models.document_vectors(docs, "song_id", "tokens", dims=8).collect()}
    assert len(vectors) == 61 and vectors[60] == [0.0] * 8 and any(vectors[0])


def test_sliding_counts_over_several_triggers(spark):
    rng = random.Random(8)
    start = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    requests = [(rng.choice(["search", "search", "download", "other"]), start + dt.timedelta(seconds=i * 40 + rng.randrange(30))) for i in range(600)]
    schema = "operation STRING, ts TIMESTAMP"
    path, out = work_path(spark, "requests"), work_path(spark, "counts")
    shuffled = requests[:]
    rng.shuffle(shuffled)  # rows come late by hours, across triggers
    for part in range(3):
        spark.createDataFrame(shuffled[part * 200 : part * 200 + 200], schema).coalesce(1).write.mode("append").parquet(path)
    stream = runs.read_files(spark, path, spark.read.parquet(path).schema, files_per_trigger=1)
    limits = {"search": 20, "download": 5}
    counts = quota.window_counts(stream, "operation", "ts", 3600, limit=quota.hourly_limit(F.col("operation"), limits), slide=600)
    runs.run_batches(counts, "sliding", lambda df, n: df.write.mode("overwrite").parquet(f"{out}/update={n}"), mode="update")
    last = {}
    for r in sorted(spark.read.parquet(out).collect(), key=lambda r: r.update):
        last[r.operation, r.start] = (r.requests, r.allowed, r.refused)
    want = {}
    for operation, at in requests:
        second = int(at.timestamp())
        for k in range(6):
            begin = (second // 600 - k) * 600
            want[operation, begin] = want.get((operation, begin), 0) + 1
    assert last == {k: (n, min(n, limits.get(k[0], 0)), max(0, n - limits.get(k[0], 0))) for k, n in want.items()}


def test_expiring_view_over_several_triggers(spark):
    day = 86_400
    writes = [(1, 0, "u1", "valid"), (2, 0, "u2", "valid"), (1, 3 * day, None, "invalid"), (3, 9 * day, "u3", "valid"), (4, 20 * day, "u4", "valid")]
    path = work_path(spark, "cache")
    start = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    for key, second, url, status in writes:
        row = [(key, start + dt.timedelta(seconds=second), 1_704_067_200_000_000 + second * 1_000_000, url, status)]
        spark.createDataFrame(row, "entry_key BIGINT, ts TIMESTAMP, micros BIGINT, url STRING, status STRING").coalesce(1).write.mode("append").parquet(path)
    stream = runs.read_files(spark, path, spark.read.parquet(path).schema, files_per_trigger=1)
    out = work_path(spark, "view")
    runs.run_batches(views.expiring_view(stream, late="1 hour"), "view", lambda df, n: df.write.mode("overwrite").parquet(f"{out}/update={n}"), mode="update")
    rows = spark.read.schema("entry_key BIGINT, micros BIGINT, url STRING, update INT").parquet(out).collect()
    last = {}
    for r in sorted(rows, key=lambda r: (r.update, r.url is None)):
        last[r.entry_key] = r.url
    # 1 was invalidated, 2 and 3 outlived their week, 4 is fresh.
    assert last == {1: None, 2: None, 3: None, 4: "u4"}


def test_view_keeps_late_rows(spark):
    day = 86_400
    writes = [(1, 20 * day, "new", "valid"), (2, 19 * day, None, "invalid"), (3, 15 * day, "late", "valid"), (2, 18 * day, "older", "valid"), (1, 16 * day, "older", "valid"), (4, 2 * day, "dead", "valid")]
    path, out = work_path(spark, "late-cache"), work_path(spark, "late-view")
    start = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    for key, second, url, status in writes:
        row = [(key, start + dt.timedelta(seconds=second), 1_704_067_200_000_000 + second * 1_000_000, url, status)]
        spark.createDataFrame(row, "entry_key BIGINT, ts TIMESTAMP, micros BIGINT, url STRING, status STRING").coalesce(1).write.mode("append").parquet(path)
    stream = runs.read_files(spark, path, spark.read.parquet(path).schema, files_per_trigger=1)
    runs.run_batches(views.expiring_view(stream), "late-view", lambda df, n: df.write.mode("overwrite").parquet(f"{out}/update={n}"), mode="update")
    changes = spark.read.schema("entry_key BIGINT, micros BIGINT, url STRING, update INT").parquet(out)
    as_of = F.lit(1_704_067_200_000_000 + 20 * day * 1_000_000)
    assert {r.entry_key: r.url for r in views.current_view(changes, as_of).collect()} == {1: "new", 3: "late"}


def test_a_repeated_request_id_is_an_error(spark):
    rows = [(1, dt.datetime(2024, 1, 1), "a"), (1, dt.datetime(2024, 1, 1), "b")]
    df = spark.createDataFrame(rows, "id BIGINT, ts TIMESTAMP_NTZ, client STRING")
    with pytest.raises(Exception, match="request id repeats"):
        quota.fixed_window_quota(df, "client", "ts", "id").collect()


def test_view_keeps_the_newest_valid_entry(spark):
    now = dt.datetime(2024, 2, 1)
    rows = [(1, now - dt.timedelta(days=8), 1, "a", "valid"), (2, now - dt.timedelta(days=1), 2, "b", "valid"), (2, now, 3, "c", "invalid"), (3, now, 4, "d", "valid"), (3, now, 5, "e", "valid")]
    log = spark.createDataFrame(rows, "k INT, ts TIMESTAMP_NTZ, nr INT, url STRING, status STRING")
    latest = views.latest_entries(log, "k", "ts", "nr", ["url", "status"])
    valid = views.valid_entries(latest, "ts", "status", "url", F.lit("2024-02-01").cast("timestamp_ntz"))
    assert [(r.k, r.url) for r in valid.collect()] == [(3, "e")]


def test_ingest_dedupes_across_batches(spark):
    path, target = work_path(spark, "raw"), work_path(spark, "target")
    schema = "nr BIGINT, track_name STRING, track_artist STRING"
    for rows in ([(1, " A ", "x"), (2, None, "y")], [(3, "A", "x"), (4, "B", "x")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    stream = runs.read_files(spark, path, spark.read.parquet(path).schema, files_per_trigger=1)
    views.ingest(stream, target, "nr", ["track_name", "track_artist"], ["track_name", "track_artist"])
    kept = views.ingested(spark, target, spark.read.parquet(path).schema)
    assert {(r.track_name, r.track_artist) for r in kept.collect()} == {("A", "x"), ("Unknown", "y"), ("B", "x")} and kept.count() == 3


def test_ingest_takes_a_folder_of_parts_and_meets_only_its_buckets(spark, sf, monkeypatch):
    folder = work_path(spark, "parts")
    spark.read.parquet(f"{sf}/documents.parquet").repartition(5, "doc_id").write.parquet(f"{folder}/documents.parquet")
    whole = streams.table_stream
    monkeypatch.setattr(streams, "table_stream", lambda spark, sf, name: whole(spark, sf, name, files_per_trigger=1))
    read = []
    path_exists = views.path_exists
    monkeypatch.setattr(views, "path_exists", lambda spark, path: read.append(path) or path_exists(spark, path))
    got, want = (streams.t4(spark, f).select("text", "source").distinct().count() for f in (folder, sf))
    assert got == want > 0 and streams.t4(spark, folder).count() == want
    # Earlier rows are known by their names alone.
    assert read and all(p.endswith("/keys") for p in read)


def test_fixed_window_quota_of_one_hot_client(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(seconds=i % 90), "hot") for i in range(300)]
    df = spark.createDataFrame(rows, "id BIGINT, ts TIMESTAMP_NTZ, client STRING")
    out = {r.id: r for r in quota.fixed_window_quota(df, "client", "ts", "id").collect()}
    assert len(out) == 300 and sum(r.allowed for r in out.values()) == 120
    first = min(rows, key=lambda r: (r[1], r[0]))[0]
    assert out[first].remaining == 59 and out[first].reset == 1_704_067_260


def test_materialised_tables_are_reused(spark):
    from cadenza.plans.features import materialise

    path = work_path(spark, "once")
    assert not path_exists(spark, path)
    assert materialise(spark.range(3), path).count() == 3
    assert materialise(spark.range(99), path).count() == 3


def test_media_defaults(spark):
    schema = "video_id STRING, title STRING, uploader STRING, duration BIGINT, view_count BIGINT, description STRING, tags ARRAY<STRING>"
    row = cat.normalise_media(spark.createDataFrame([("abc", None, None, None, 7, "d" * 600, None)], schema)).first()
    assert (row.title, row.uploader, row.duration, row.view_count, len(row.description), len(row.short_description), row.n_tags) == ("Unknown", "Unknown", 0, 7, 600, 500, 0)
    assert row.url.endswith("watch?v=abc")


def test_catalog_build_and_lyrics_analysis(spark, sf):
    from cadenza.sources.tables import songs, table
    from cadenza.workload import texts

    built = texts.i7(spark, sf).collect()
    assert len(built) == songs(spark, sf).select("track_name", "track_artist").distinct().count()
    assert all(len(r.w2v) == 100 and len(r.audio_scaled) == 12 for r in built)
    assert all(sum(r.topics) == pytest.approx(1.0) or sum(r.topics) == 0.0 for r in built)
    assert np.mean([r.audio_scaled for r in built], axis=0) == pytest.approx(np.zeros(12), abs=1e-9)
    analysed = texts.i8(spark, sf).collect()
    assert len(analysed) == table(spark, sf, "documents").count()
    assert all((sum(r.topics) > 0) == bool(r.tokens) and -1 <= r.compound <= 1 for r in analysed)
