import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cadenza.functions import text as tx
from cadenza.operators import sentiment as se


def column(spark, values, fn):
    df = spark.createDataFrame(list(enumerate(values)), "i INT, t STRING")
    return [r.x for r in df.select("i", fn(F.col("t")).alias("x")).orderBy("i").collect()]


def test_term_counts(spark):
    texts = ["a b a c b a", "", "one", "x x x x"]
    got = column(spark, texts, lambda t: tx.term_counts(tx.words(t)))
    assert [{s.term: s.tf for s in row} for row in got] == [dict(Counter(t.split())) for t in texts]


def test_missing_text_has_no_tokens(spark):
    assert column(spark, [None], tx.words) == [[]]
    assert column(spark, [None], tx.similarity_tokens) == [[]]
    assert column(spark, [None], tx.clean_to_words) == [""]


def test_title_normalisation_deletes_substrings(spark):
    titles = ["Song (Live) [HD] Official Video", "After Dark", "Lift", "A  B!! audio"]
    assert column(spark, titles, tx.normalise_title) == ["song", "aer dark", "li", "a b"]


def test_lyrics_cleaning(spark):
    text = "[Verse 1]\nHello,  World\n\n  it's 42 [x]times  "
    assert column(spark, [text], tx.clean_to_line) == ["Hello, World it's 42 times"]
    assert column(spark, [text], tx.clean_lines) == ["Hello,  World\nit's 42 times"]
    assert column(spark, [text], tx.clean_to_words) == ["verse hello world it s x times"]


def test_description_fields(spark):
    both = "hi\nSONG: Blue \nartist: Ann\nbye"
    music = both + "\nMusic: Bob - Red\n"
    assert column(spark, [both, music, "none"], tx.described_song) == ["Blue", "Red", None]
    assert column(spark, [both, music, "none"], tx.described_artist) == ["Ann", "Bob", None]


def test_artist_title_split(spark):
    titles = ["A - B - C", "Plain"]
    assert column(spark, titles, lambda t: tx.split_artist_title(t, F.lit("Up"))[0]) == ["A", "Up"]
    assert column(spark, titles, lambda t: tx.split_artist_title(t, F.lit("Up"))[1]) == ["B - C", "Plain"]


def test_video_links(spark):
    urls = ["https://www.youtube.com/watch?v=abcdefghijk&t=1", "https://youtu.be/ABCDEFGHIJ_", "https://x.org/a", None]
    assert column(spark, urls, tx.video_id) == ["abcdefghijk", "ABCDEFGHIJ_", None, None]
    assert column(spark, urls, tx.thumbnail_url)[0] == "https://img.youtube.com/vi/abcdefghijk/hqdefault.jpg"


def test_durations_wrap_at_the_hour(spark):
    df = spark.createDataFrame([(65_000,), (3_661_000,), (0,)], "ms BIGINT")
    assert [r.x for r in df.select(tx.duration_text(F.col("ms")).alias("x")).collect()] == ["1:05", "1:01", "0:00"]


def test_file_titles(spark):
    assert column(spark, ["/a/01_-My Song.v2.mp3", "Plain.wav"], tx.title_from_file) == ["My Song.v2", "Plain"]


def test_trigrams_follow_the_published_padding(spark):
    assert set(column(spark, ["cat"], tx.trigrams)[0]) == {"  c", " ca", "cat", "at "}
    same = tx.trigram_similarity(tx.trigrams(F.lit("red plate")), tx.trigrams(F.lit("Plate, red")))
    assert spark.range(1).select(same.alias("s")).first().s == 1.0


def test_reasons(spark):
    text = lambda *s: spark.range(1).select(tx.reason_text(*[F.lit(x) for x in s]).alias("r")).first().r
    assert text(0.8, 0.6, 0.1) == "Recommended because of very similar sound profile and similar lyrical themes"
    assert text(0.5, 0.5, 0.5) == "Recommended because of overall similarity"


LEXICON = {"good": 1.9, "great": 3.1, "bad": -2.5, "horrible": -2.5, "love": 3.2}


def plain_sentiment(text):
    """The published rule set over the small lexicon, word by word."""
    words = []
    for token in text.split():
        bare = token.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
        words.append(token if len(bare) <= 2 else bare)
    caps = [w.isupper() for w in words]
    differ = 0 < sum(caps) < len(words)
    negated = lambda w: w.lower() in se.NEGATORS or "n't" in w.lower()
    scores = []
    for i, word in enumerate(words):
        low = word.lower()
        v = LEXICON.get(low, 0.0)
        if low in LEXICON:
            if word.isupper() and differ:
                v += 0.733 if v > 0 else -0.733
            for d, factor in ((1, 1.0), (2, 0.95), (3, 0.9)):
                if i < d or words[i - d].lower() in LEXICON:
                    continue
                prev = words[i - d].lower()
                step = 0.293 if prev in se.BOOSTERS_UP else -0.293 if prev in se.BOOSTERS_DOWN else 0.0
                if step:
                    step = -step if v < 0 else step
                    if words[i - d].isupper() and differ:
                        step += 0.733 if v > 0 else -0.733
                    v += step * factor
                before = [w.lower() for w in words[max(0, i - d) : i]]
                if d >= 2 and before[0] == "never" and any(w in ("so", "this") for w in before[1:]):
                    v *= 1.25
                elif d >= 2 and before[0] == "without" and "doubt" in before[1:]:
                    pass
                elif negated(words[i - d]):
                    v *= -0.74
        scores.append(v)
    lows = [w.lower() for w in words]
    if "but" in lows:
        at = lows.index("but")
        scores = [s * 0.5 if i < at else s * 1.5 if i > at else s for i, s in enumerate(scores)]
    marks = text.count("?")
    emphasis = min(text.count("!"), 4) * 0.292 + (0.0 if marks <= 1 else marks * 0.18 if marks <= 3 else 0.96)
    total = sum(scores)
    total += emphasis if total > 0 else -emphasis if total < 0 else 0.0
    up = sum(s + 1 for s in scores if s > 0)
    down = sum(s - 1 for s in scores if s < 0)
    flat = sum(s == 0 for s in scores)
    if up > -down:
        up += emphasis
    elif up < -down:
        down -= emphasis
    whole = up - down + flat
    return (abs(down / whole), flat / whole, abs(up / whole), total / math.sqrt(total * total + 15)) if whole else (0, 1, 0, 0)


SENTENCES = [
    "This is good", "This is not good", "really very good song", "I never this good felt", "it was bad but now it is GREAT",
    "without a doubt great", "without doubt great", "horrible!!! why??", "LOVE it", "LOVE", "isn't it kinda bad?", "", "plain words only",
    "never so good, VERY bad and good?? ok???", "good good bad", "hardly ever not so great",
]


def test_sentiment_rules(spark):
    docs = spark.createDataFrame(list(enumerate(SENTENCES)), "id INT, body STRING")
    lexicon = spark.createDataFrame(list(LEXICON.items()), "term STRING, valence DOUBLE")
    got = {r.id: r for r in se.lexicon_sentiment(docs, "id", "body", lexicon).collect()}
    for i, sentence in enumerate(SENTENCES):
        row = got[i]
        assert (row.neg, row.neu, row.pos, row.compound) == pytest.approx(plain_sentiment(sentence), abs=6e-4), sentence


def test_polarity_defaults(spark):
    docs = spark.createDataFrame([(1, ["good", "x"]), (2, ["x"]), (3, [])], "id INT, tokens ARRAY<STRING>")
    lexicon = spark.createDataFrame([("good", 0.7, 0.6)], "term STRING, polarity DOUBLE, subjectivity DOUBLE")
    got = {r.id: (r.polarity, r.subjectivity) for r in se.lexicon_polarity(docs, "id", "tokens", lexicon).collect()}
    assert got == {1: (0.7, 0.6), 2: (0.0, 0.0), 3: (0.0, 0.5)}


def test_word_pattern_matches_python(spark):
    text = "Été naïve über_cool 42 don't—stop ßtraße"
    assert column(spark, [text], tx.words)[0] == re.findall(r"\w+", text.lower())
