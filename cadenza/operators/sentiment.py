"""Rule-based lexicon sentiment; the lexicon is an input table (term, valence)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.functions.arrays import bind

# Fixed values of the published rule set.
BOOST = 0.293
CAPS_BOOST = 0.733
NEGATION = -0.74
ALPHA = 15.0
NEAR_FACTORS = (1.0, 0.95, 0.9)

# Shares on the edge between two third digits go up, whatever the order of summing.
TIE = 1e-9

# The published degree adverbs, whole and in their order.
BOOSTERS_UP = [
    "absolutely", "amazingly", "awfully", "completely", "considerable", "considerably", "decidedly", "deeply",
    "effing", "enormous", "enormously", "entirely", "especially", "exceptional", "exceptionally", "extreme",
    "extremely", "fabulously", "flipping", "flippin", "frackin", "fracking", "fricking", "frickin", "frigging",
    "friggin", "fully", "fuckin", "fucking", "fuggin", "fugging", "greatly", "hella", "highly", "hugely",
    "incredible", "incredibly", "intensely", "major", "majorly", "more", "most", "particularly", "purely",
    "quite", "really", "remarkably", "so", "substantially", "thoroughly", "total", "totally", "tremendous",
    "tremendously", "uber", "unbelievably", "unusually", "utter", "utterly", "very",
]
BOOSTERS_DOWN = [
    "almost", "barely", "hardly", "kinda", "kindof", "kind-of", "less", "little", "marginal", "marginally",
    "occasional", "occasionally", "partly", "scarce", "scarcely", "slight", "slightly", "somewhat", "sorta",
    "sortof", "sort-of",
]

# Two-word degree adverbs, all of which weaken.
BOOSTER_PAIRS = ["just enough", "kind of", "sort of"]

# Negation words.
NEGATORS = [
    "aint", "arent", "cannot", "cant", "couldnt", "darent", "didnt", "doesnt", "ain't", "aren't",
    "can't", "couldn't", "daren't", "didn't", "doesn't", "dont", "hadnt", "hasnt", "havent", "isnt",
    "mightnt", "mustnt", "neither", "don't", "hadn't", "hasn't", "haven't", "isn't", "mightn't",
    "mustn't", "neednt", "needn't", "never", "none", "nope", "nor", "not", "nothing", "nowhere",
    "oughtnt", "shant", "shouldnt", "uhuh", "wasnt", "werent", "oughtn't", "shan't", "shouldn't",
    "uh-uh", "wasn't", "weren't", "without", "wont", "wouldnt", "won't", "wouldn't", "rarely",
    "seldom", "despite",
]

#: Terms of a lexicon that every task holds; a larger one is joined.
MOST_TERMS = 20_000
#: Texts whose words are weighed at once.
TEXTS = 500

# ASCII punctuation.
PUNCTUATION = "".join(chr(c) for first, last in ("!/", ":@", "[`", "{~") for c in range(ord(first), ord(last) + 1))


def sentiment_words(text: Column) -> Column:
    """White-space tokens; outer punctuation goes where more than two characters stay."""
    parts = F.filter(F.split(text, r"[\s\p{Z}]+"), lambda t: t != "")

    def bare(t: Column) -> Column:
        stripped = F.btrim(t, F.lit(PUNCTUATION))
        return F.when(F.length(stripped) <= 2, t).otherwise(stripped)

    return F.transform(parts, bare)


def _is_caps(word: Column) -> Column:
    return (word == F.upper(word)) & (word != F.lower(word))


def _boost(prev: Column, valence: Column, caps_differ: Column, factor: float) -> Column:
    low = F.lower(prev)
    size = F.when(low.isin(BOOSTERS_UP), F.lit(BOOST)).when(low.isin(BOOSTERS_DOWN), F.lit(-BOOST))
    signed = F.when(valence < 0, -size).otherwise(size)
    caps = F.when(_is_caps(prev) & caps_differ, F.when(valence > 0, F.lit(CAPS_BOOST)).otherwise(F.lit(-CAPS_BOOST)))
    return F.coalesce((signed + F.coalesce(caps, F.lit(0.0))) * factor, F.lit(0.0))


def _negated(word: Column) -> Column:
    low = F.lower(word)
    return F.coalesce(low.isin(NEGATORS) | F.contains(low, F.lit("n't")), F.lit(False))


def _negate(valence: Column, distance: int, p1: Column, p2: Column, p3: Column) -> Column:
    """Negation by the word ``distance`` places back, with its "never so" and "without doubt" cases."""
    l1, l2, l3 = F.lower(p1), F.lower(p2), F.lower(p3)
    intens = ["so", "this"]
    if distance == 1:
        return F.when(_negated(p1), valence * NEGATION).otherwise(valence)
    if distance == 2:
        return (
            F.when((l2 == "never") & l1.isin(intens), valence * 1.25)
            .when((l2 == "without") & (l1 == "doubt"), valence)
            .when(_negated(p2), valence * NEGATION)
            .otherwise(valence)
        )
    return (
        F.when((l3 == "never") & (l2.isin(intens) | l1.isin(intens)), valence * 1.25)
        .when((l3 == "without") & ((l2 == "doubt") | (l1 == "doubt")), valence)
        .when(_negated(p3), valence * NEGATION)
        .otherwise(valence)
    )


def _count_of(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def _least(valence: Column, p1: Column, p2: Column, p1_known: Column) -> Column:
    """"least" just before a word turns it, but "at least" and "very least" do not."""
    turns = p1.isNotNull() & ~p1_known & (F.lower(p1) == "least")
    spared = F.coalesce(F.lower(p2).isin("at", "very"), F.lit(False))
    return F.when(turns & ~spared, valence * NEGATION).otherwise(valence)


def _idiom_keys(word: Column, p1: Column, p2: Column, p3: Column, n1: Column, n2: Column) -> list[Column]:
    """The two- and three-word phrases around a word, in the order in which they are tried."""
    return [
        F.lower(F.concat_ws(" ", *words))
        for words in ([p1, word], [p2, p1, word], [p2, p1], [p3, p2, p1], [p3, p2], [word, n1], [word, n1, n2])
    ]


def _with_idioms(hits: DataFrame, idioms: DataFrame) -> DataFrame:
    """Column ``s`` replaced by the valence of the idiom a word stands in.

    Of the phrases that end at or before the word the first known one counts; a known phrase
    that begins with the word overrides it, the longer one last. They apply where the third
    word back is there and no lexicon word, as the negation rule of that distance does.
    """
    keys = _idiom_keys(*[F.col(c) for c in ("word", "p1", "p2", "p3", "n1", "n2")])
    known = idioms.select(F.lower("phrase").alias("phrase"), F.col("valence").alias("phrase_valence"))
    active = F.col("p3").isNotNull() & F.col("p3_term").isNull() & F.col("valence").isNotNull()
    for i, key in enumerate(keys):
        named = known.select(F.col("phrase").alias(f"_k{i}"), F.col("phrase_valence").alias(f"_v{i}"))
        present = F.col("n1").isNotNull() if i == 5 else F.col("n2").isNotNull() if i == 6 else F.lit(True)
        hits = hits.join(named, F.when(active & present, key) == F.col(f"_k{i}"), "left")
    forward = F.coalesce("_v6", "_v5")
    backward = F.coalesce(*[F.col(f"_v{i}") for i in range(5)])
    return hits.withColumn("s", F.coalesce(forward, backward, "s")).drop(*[f"_{x}{i}" for x in "kv" for i in range(7)])


def _held(lexicon: DataFrame) -> dict[str, float | None] | None:
    """The valences of a small lexicon that names every term once, for all tasks; none of another."""
    rows = lexicon.select("term", F.col("valence").cast("double")).where("term IS NOT NULL").limit(MOST_TERMS + 1).collect()
    out = {r["term"]: r["valence"] for r in rows}
    sound = len(out) == len(rows) <= MOST_TERMS and not any(v is not None and math.isnan(v) for v in out.values())
    return out if sound else None


# Words that the rules name, by number.
_NAMED = {
    "never": 1, "so": 2, "this": 2, "without": 3, "doubt": 4, "least": 5, "at": 6, "very": 6,
    "just": 7, "enough": 8, "kind": 9, "sort": 9, "of": 10, "but": 11,
}
_STEPS = {**dict.fromkeys(BOOSTERS_UP, BOOST), **dict.fromkeys(BOOSTERS_DOWN, -BOOST)}
_NEGATORS = frozenset(NEGATORS)
_PARTS = {"total": "DOUBLE", "up": "DOUBLE", "down": "DOUBLE", "met": "BIGINT", "n": "BIGINT"}


def _weighed(texts: pa.Array, lexicon: dict[str, float | None]) -> dict[str, np.ndarray]:
    """Per text the sums over its lexicon words by the rules of :func:`_weighed_by_join`, side by side for all words."""
    lists = pc.split_pattern_regex(texts, r"[\t\n\x0b\f\r\p{Z}]+")
    flat, doc = lists.flatten(), np.repeat(np.arange(len(texts)), lists.value_lengths().to_numpy())
    filled = pc.not_equal(flat, "")
    flat, doc = flat.filter(filled), doc[filled.to_numpy(zero_copy_only=False)]
    n = np.bincount(doc, minlength=len(texts))
    pos = np.arange(len(doc)) - (np.cumsum(n) - n)[doc]
    codes = flat.dictionary_encode()
    stripped = pc.utf8_trim(codes.dictionary, PUNCTUATION)
    words = pc.if_else(pc.less_equal(pc.utf8_length(stripped), 2), codes.dictionary, stripped).to_pylist()
    low = [w.lower() for w in words]
    each = codes.indices.to_numpy()

    def of(values, kind):
        return np.array(values, kind)[each]

    valence = of([v if (v := lexicon.get(t)) is not None and t not in _STEPS else math.nan for t in low], float)
    known, caps = of([t in lexicon for t in low], bool), of([w == w.upper() and w != t for w, t in zip(words, low)], bool)
    step, negated = of([_STEPS.get(t, 0.0) for t in low], float), of([t in _NEGATORS or "n't" in t for t in low], bool)
    named = of([_NAMED.get(t, 0) for t in low], np.int8)

    n_caps = np.bincount(doc[caps], minlength=len(texts))
    but = np.zeros(len(texts), np.int64)
    last = np.flatnonzero(named == 11)[::-1]
    but[doc[last]] = pos[last] + 1
    hit = np.flatnonzero(~np.isnan(valence))
    s, own = valence[hit], doc[hit]
    differ = ((n_caps > 0) & (n_caps < n))[own]
    s = np.where(caps[hit] & differ, np.where(s > 0, s + CAPS_BOOST, s - CAPS_BOOST), s)
    p = [np.maximum(hit - d, 0) for d in range(4)]
    there = [pos[hit] >= d for d in range(4)]
    active = [there[d] & ~known[p[d]] for d in range(4)]
    is_ = lambda d, number: named[p[d]] == number
    for d, factor in enumerate(NEAR_FACTORS, start=1):
        size = step[p[d]]
        louder = np.where(caps[p[d]] & differ, np.where(s > 0, CAPS_BOOST, -CAPS_BOOST), 0.0)
        s = np.where(active[d] & (size != 0), s + (np.where(s < 0, -size, size) + louder) * factor, s)
        turned = np.where(negated[p[d]], s * NEGATION, s)
        if d > 1:
            nearer = range(1, d)
            any_ = lambda number: np.logical_or.reduce([is_(e, number) for e in nearer])
            turned = np.where(is_(d, 3) & any_(4), s, turned)
            turned = np.where(is_(d, 1) & any_(2), s * 1.25, turned)
        s = np.where(active[d], turned, s)
    for d in (3, 2):
        pair = (is_(d, 7) & is_(d - 1, 8)) | (is_(d, 9) & is_(d - 1, 10))
        s = np.where(active[3] & pair, s - BOOST, s)
    s = np.where(active[1] & is_(1, 5) & ~(there[2] & is_(2, 6)), s * NEGATION, s)
    before, at = but[own], pos[hit] + 1
    s = np.where(before > 0, np.where(at < before, s * 0.5, np.where(at > before, s * 1.5, s)), s)

    def sums(values):
        return np.bincount(own, values, len(texts))

    return {
        "total": sums(s), "up": sums(np.where(s > 0, s + 1, 0.0)), "down": sums(np.where(s < 0, s - 1, 0.0)),
        "met": sums(s != 0).astype(np.int64), "n": n.astype(np.int64),
    }


def _weighed_in_rows(docs: DataFrame, id_col: str, lexicon: dict[str, float | None]) -> DataFrame:
    """One row a text with the sums over its lexicon words; ``docs`` has the id, _text, bangs and marks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, TEXTS):
                part = batch.slice(first, TEXTS)
                found = _weighed(part.column(1), lexicon)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), *map(pa.array, found.values())], [*names, *found])

    names = [id_col, "bangs", "marks"]
    kinds = docs.schema
    schema = ", ".join([*[f"`{c}` {kinds[c].dataType.simpleString()}" for c in names], *[f"{c} {k}" for c, k in _PARTS.items()]])
    return docs.select(id_col, "_text", "bangs", "marks").mapInArrow(run, schema)


def _weighed_by_join(docs: DataFrame, id_col: str, text_col: str, lexicon: DataFrame, idioms: DataFrame | None) -> DataFrame:
    """Sums over each document's lexicon words: total, up, down, flat, bangs and marks.

    Every word keeps its neighbours from the array it came from, so no window is
    needed; lexicon and idioms are joined by hash, broadcast or not as Spark's size threshold
    says, and the sums combine before their one shuffle.
    """
    words = sentiment_words(F.coalesce(F.col(text_col), F.lit("")))
    base = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), words.alias("_w"))
    lowered = F.transform("_w", F.lower)
    n_caps = F.size(F.filter("_w", _is_caps))
    # Per-document values are taken below the explode: above it they would run per word.
    per_doc = base.select(
        id_col,
        F.size("_w").alias("_n"),
        F.least(_count_of(F.col("_text"), "!"), F.lit(4)).alias("_bangs"),
        _count_of(F.col("_text"), "?").alias("_marks"),
        ((n_caps > 0) & (n_caps < F.size("_w"))).alias("_caps_differ"),
        F.array_position(lowered, "but").alias("_but"),
        bind(
            F.col("_w"),
            lambda w: F.transform(
                w,
                lambda t, i: F.struct(
                    t.alias("word"), (i + 1).alias("at"), F.get(w, i - 1).alias("p1"),
                    F.get(w, i - 2).alias("p2"), F.get(w, i - 3).alias("p3"),
                    F.get(w, i + 1).alias("n1"), F.get(w, i + 2).alias("n2"),
                ),
            ),
        ).alias("_items"),
    )
    per_word = per_doc.select(
        id_col, "_n", "_bangs", "_marks", "_caps_differ", "_but", F.explode_outer("_items").alias("t")
    ).select(id_col, "_n", "_bangs", "_marks", "_caps_differ", "_but", "t.*")

    known = lexicon.select("term", "valence")
    low = F.lower("word")
    hits = per_word.join(known, (low == F.col("term")) & ~low.isin(BOOSTERS_UP + BOOSTERS_DOWN), "left").drop("term")
    # Only words of the lexicon go on, and one row per document to stand for the rest.
    hits = hits.where(F.col("valence").isNotNull() | (F.coalesce("at", F.lit(1)) == 1))
    for p in ("p1", "p2", "p3"):
        other = known.select(F.col("term").alias(f"{p}_term"))
        key = F.when(F.col("valence").isNotNull(), F.lower(p))
        hits = hits.join(other, key == F.col(f"{p}_term"), "left")

    p1, p2, p3 = F.col("p1"), F.col("p2"), F.col("p3")
    caps = F.col("_caps_differ")
    v = F.col("valence")
    hits = hits.withColumn(
        "s",
        F.when(_is_caps(F.col("word")) & caps, F.when(v > 0, v + CAPS_BOOST).otherwise(v - CAPS_BOOST)).otherwise(v),
    )
    for distance, (p, factor) in enumerate(zip(("p1", "p2", "p3"), NEAR_FACTORS), start=1):
        s = F.col("s")
        active = F.col(p).isNotNull() & F.col(f"{p}_term").isNull()
        hits = hits.withColumn("s", F.when(active, s + _boost(F.col(p), s, caps, factor)).otherwise(s))
        hits = hits.withColumn("s", F.when(active, _negate(F.col("s"), distance, p1, p2, p3)).otherwise(F.col("s")))
    if idioms is not None:
        hits = _with_idioms(hits, idioms)
    for first, second in ((p3, p2), (p2, p1)):
        pair = F.lower(F.concat_ws(" ", first, second)).isin(BOOSTER_PAIRS)
        weaker = F.when(p3.isNotNull() & F.col("p3_term").isNull() & pair, F.lit(BOOST)).otherwise(F.lit(0.0))
        hits = hits.withColumn("s", F.col("s") - weaker)
    hits = hits.withColumn("s", _least(F.col("s"), p1, p2, F.col("p1_term").isNotNull()))
    s = F.col("s")
    hits = hits.withColumn(
        "s",
        F.coalesce(
            F.when((F.col("_but") > 0) & (F.col("at") < F.col("_but")), s * 0.5)
            .when((F.col("_but") > 0) & (F.col("at") > F.col("_but")), s * 1.5)
            .otherwise(s),
            F.lit(0.0),
        ),
    )
    s = F.col("s")
    return hits.groupBy(id_col).agg(
        F.sum(s).alias("total"),
        F.sum(F.when(s > 0, s + 1).otherwise(0.0)).alias("up"),
        F.sum(F.when(s < 0, s - 1).otherwise(0.0)).alias("down"),
        (F.max("_n") - F.count(F.when(s != 0, 1))).alias("flat"),
        F.max("_bangs").alias("bangs"),
        F.max("_marks").alias("marks"),
    )


def lexicon_sentiment(
    docs: DataFrame, id_col: str, text_col: str, lexicon: DataFrame, idioms: DataFrame | None = None, in_rows: bool = False
) -> DataFrame:
    """neg, neu, pos and compound per document; an empty text is neutral.

    ``idioms`` (phrase of two or three words, valence) is a second input table, like the
    lexicon. Words are joined with both. With ``in_rows`` a lexicon of at most ``MOST_TERMS``
    terms is held by every task instead, which weighs all words of many texts side by side; a
    larger one, or one with idioms, is still joined.
    """
    held = _held(lexicon) if in_rows and idioms is None else None
    if held is None:
        summed = _weighed_by_join(docs, id_col, text_col, lexicon, idioms)
    else:
        text = F.coalesce(F.col(text_col), F.lit(""))
        rows = docs.select(F.col(id_col), text.alias("_text")).withColumns(
            {"bangs": F.least(_count_of(F.col("_text"), "!"), F.lit(4)), "marks": _count_of(F.col("_text"), "?")}
        )
        summed = _weighed_in_rows(rows, id_col, held).groupBy(id_col).agg(
            *[F.sum(c).alias(c) for c in ("total", "up", "down")], (F.max("n") - F.sum("met")).alias("flat"),
            F.max("bangs").alias("bangs"), F.max("marks").alias("marks"),
        )
    marks = F.col("marks")
    emphasis = F.col("bangs") * 0.292 + F.when(marks > 3, F.lit(0.96)).when(marks > 1, marks * 0.18).otherwise(F.lit(0.0))
    raw = F.col("total")
    shifted = F.when(raw > 0, raw + emphasis).when(raw < 0, raw - emphasis).otherwise(raw)
    up = F.when(F.col("up") > -F.col("down"), F.col("up") + emphasis).otherwise(F.col("up"))
    down = F.when(F.col("up") < -F.col("down"), F.col("down") - emphasis).otherwise(F.col("down"))
    out = summed.select(id_col, shifted.alias("x"), up.alias("up"), down.alias("down"), "flat")
    whole = F.col("up") - F.col("down") + F.col("flat")

    def share(part: Column) -> Column:
        return F.when(whole > 0, F.round(F.abs(part / whole) + TIE, 3)).otherwise(F.lit(0.0))

    compound = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("x") / F.sqrt(F.col("x") * F.col("x") + ALPHA)))
    return out.select(
        id_col,
        share(F.col("down")).alias("neg"),
        F.when(whole > 0, F.round(F.col("flat") / whole + TIE, 3)).otherwise(F.lit(1.0)).alias("neu"),
        share(F.col("up")).alias("pos"),
        F.round(compound, 4).alias("compound"),
    )


def lexicon_polarity(docs: DataFrame, id_col: str, tokens_col: str, lexicon: DataFrame) -> DataFrame:
    """Mean polarity and subjectivity of the lexicon words in each token list.

    No tokens at all gives (0, 0.5); tokens without a lexicon word give (0, 0).
    """
    tokens = docs.select(id_col, F.explode_outer(tokens_col).alias("token"))
    known = lexicon.select("term", "polarity", "subjectivity")
    joined = tokens.join(known, F.col("token") == F.col("term"), "left")
    agg = joined.groupBy(id_col).agg(
        F.count("token").alias("n"),
        F.avg("polarity").alias("polarity"),
        F.avg("subjectivity").alias("subjectivity"),
    )
    none = F.when(F.col("n") == 0, F.lit(0.5)).otherwise(F.lit(0.0))
    return agg.select(
        id_col,
        F.coalesce("polarity", F.lit(0.0)).alias("polarity"),
        F.coalesce("subjectivity", none).alias("subjectivity"),
    )
