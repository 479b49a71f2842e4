"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on each text. Expectation
maximisation over the counts of vote patterns estimates how often each labeller is right; the posterior of a pattern labels its texts. A logistic
scorer over hashed features learns from the posteriors of a bounded sample and judges all
documents.

Vote patterns number at most ``3 ** labellers``, so the statistics that EM needs stay small
whatever the corpus, and cover all of it. Abusive words are learnt per language from a
bounded sample of labelled rows; every other rule is fixed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.llm import arrow_text as at
from cadenza.llm.quality_rules import per_row, text_counts
from cadenza.llm.tables import gathered

#: Labelled rows, chosen by hash, from which abusive words are learnt.
LABELLED_SAMPLE = 20_000
#: Documents, chosen by hash, that the scorer trains on, about.
TRAINING_SAMPLE = 8_192
#: Abusive words kept at most of a language; in how many of its toxic texts one must be, how much
#: more often than in the others, and its evidence against that of one chance word among all (at
#: -3 some twenty words may pass by chance; a text needs two of them, or one in 200 words).
MARKER_WORDS = 1000
MARKER_TEXTS = 4
MARKER_ODDS = 30.0
MARKER_EVIDENCE = -3.0
#: Hashed feature buckets and passes of the scorer.
FEATURE_BITS = 18
EPOCHS = 12

LABELLERS = [
    "symbols", "adjacent_repeats", "repeated_windows", "duplicate_lines", "shouting", "abuse", "dense_abuse",
    "clean_prose", "punctuated", "varied",
]
GOOD, ABSTAIN, BAD = 0, 1, 2


def text_measures(raw: np.ndarray, offsets: np.ndarray, markers: np.ndarray) -> tuple[dict[str, np.ndarray], at.Words]:
    """Shares per row that the labellers and the scorer look at, and the lower-cased words."""
    rows = len(offsets) - 1
    plain = at.words_of(raw, offsets, lower=False)
    words = at.renamed(plain, at.LOWER[raw])
    counts = text_counts(raw, offsets, plain)
    n = np.maximum(counts["n_words"], 1)
    same = (words.hashes[1:] == words.hashes[:-1]) & (words.rows[1:] == words.rows[:-1])
    adjacent = np.bincount(words.rows[1:][same], minlength=rows)
    final = words.codes[words.ends - 1]
    stops = (final == ord(".")) | (final == ord("!")) | (final == ord("?"))
    sentences = np.bincount(words.rows[stops], minlength=rows)
    abusive = at.among(bare_hashes(words), markers)
    upper, lower = (raw >= 65) & (raw <= 90), (raw >= 97) & (raw <= 122)
    lines = np.bincount(np.searchsorted(offsets, np.flatnonzero(raw == 10), "right") - 1, minlength=rows) + 1
    # Sorted by row, then by the hash's upper bits, which are enough for a share.
    own = np.sort(words.rows.astype(at.U64) << at.U64(40) | words.hashes >> at.U64(24))
    new = np.ones(len(own), bool)
    new[1:] = own[1:] != own[:-1]
    distinct = np.bincount((own[new] >> at.U64(40)).astype(np.int64), minlength=rows)
    return {
        "n_words": counts["n_words"],
        "symbols": counts["n_symbols"] / n,
        "adjacent": adjacent / n,
        "repeated": counts["n_repeat_words"] / n,
        "dup_lines": counts["n_dup_lines"] / lines,
        "sentences": sentences / n,
        "capitals": per_row(upper, offsets) / np.maximum(per_row(upper | lower, offsets), 1),
        "bangs": per_row(raw == ord("!"), offsets) / n,
        "abusive": np.bincount(words.rows[abusive], minlength=rows).astype(float),
        "abuse": np.bincount(words.rows[abusive], minlength=rows) / n,
        # Distinct words against what a text of that length would have at most.
        "varied": distinct / np.minimum(n, 200.0),
    }, words


def bare_hashes(words: at.Words) -> np.ndarray:
    """Hashes of the words without ``.,;:!?`` and quotes at their ends."""
    marks = np.zeros(256, bool)
    marks[list(b".,;:!?\"'()")] = True
    starts, ends = words.starts.copy(), words.ends.copy()
    for _ in range(2):  # at most two marks on either side
        longer = ends - starts > 1
        starts += longer & marks[words.codes[np.minimum(starts, max(len(words.codes) - 1, 0))]] if len(starts) else 0
        longer = ends - starts > 1
        ends -= longer & marks[words.codes[ends - 1]] if len(ends) else 0
    return at.run_hashes(words.codes, starts, ends)


def votes(m: dict[str, np.ndarray]) -> np.ndarray:
    """Rows x labellers of GOOD, ABSTAIN or BAD."""
    some = m["n_words"] > 0
    loud = (m["capitals"] > 0.5) | (m["bangs"] > 0.3)
    abusive, dense = m["abusive"] >= 2, (m["abusive"] >= 1) & (m["abuse"] >= 0.005)
    civil = some & (m["symbols"] <= 0.05) & (m["adjacent"] <= 0.2) & ~loud & ~abusive & ~dense
    plain = civil & (m["symbols"] < 0.01) & (m["adjacent"] < 0.1) & (m["repeated"] < 0.3) & (m["dup_lines"] < 0.4)
    rules = [
        (m["symbols"] > 0.05, BAD), (m["adjacent"] > 0.2, BAD), (m["repeated"] > 0.4, BAD),
        (m["dup_lines"] > 0.5, BAD), (some & loud, BAD), (abusive, BAD), (dense, BAD),
        (plain, GOOD), (civil & (m["sentences"] > 0.01), GOOD), (civil & (m["varied"] > 0.4), GOOD),
    ]
    return np.stack([np.where(hit, kind, ABSTAIN) for hit, kind in rules], 1)


def pattern_of(table: np.ndarray) -> np.ndarray:
    return table @ (3 ** np.arange(table.shape[1]))


def votes_of(pattern: np.ndarray, labellers: int) -> np.ndarray:
    return pattern[:, None] // (3 ** np.arange(labellers))[None, :] % 3


@dataclass
class LabelModel:
    """The chance of each labeller to be right when it votes."""

    accuracy: np.ndarray

    def posterior(self, table: np.ndarray) -> np.ndarray:
        """The chance of bad for rows of votes; one half without a vote."""
        logit = (table - 1) @ np.log(self.accuracy / (1 - self.accuracy))
        return 1 / (1 + np.exp(-np.clip(logit, -50, 50)))


#: What is assumed of a labeller before the texts are seen: right in 8 of 10 votes.
PRIOR_RIGHT, PRIOR_VOTES = 8.0, 10.0


def fit_label_model(patterns: np.ndarray, counts: np.ndarray, labellers: int, rounds: int = 200) -> LabelModel:
    """EM over vote patterns. Votes are independent given the class, and better than chance.

    Neither class is taken as more common: most labellers vote one way only, and a class
    balance learnt from them would talk the rarer kind down. With no patterns the prior is
    the result.
    """
    table, counts = votes_of(patterns, labellers), counts.astype(float)
    given = ((table != ABSTAIN) * counts[:, None]).sum(0)
    model = LabelModel(np.full(labellers, PRIOR_RIGHT / PRIOR_VOTES))
    for _ in range(rounds):
        bad = model.posterior(table)
        right = np.where(table == BAD, bad[:, None], np.where(table == GOOD, 1 - bad[:, None], 0.0))
        accuracy = ((right * counts[:, None]).sum(0) + PRIOR_RIGHT) / (given + PRIOR_VOTES)
        accuracy = np.clip(accuracy, 0.55, 0.999)
        done = np.abs(accuracy - model.accuracy).max(initial=0) < 1e-9
        model = LabelModel(accuracy)
        if done:
            break
    return model


def learn_markers(docs: DataFrame, labels: DataFrame, key: str, text: str, lang: str | None) -> np.ndarray:
    """Hashes of words that mark toxic texts of a language, from at most ``LABELLED_SAMPLE`` labelled rows.

    A marker is ``MARKER_ODDS`` times as often in a language's toxic texts as in its others,
    and its log-likelihood ratio against chance beats the number of the language's words by
    ``MARKER_EVIDENCE``; the ``MARKER_WORDS`` with the most evidence stay. It need not be in
    many texts: abuse is spread over many words. Equal texts count once, as do near copies
    (texts with the same least hash of three words).
    """
    told = labels.where(F.col("toxic").isNotNull() & F.col(key).isNotNull()).select(key, "toxic").distinct()
    sample = told.orderBy(F.xxhash64(key, "toxic"), key, "toxic").limit(LABELLED_SAMPLE)
    language = F.coalesce(F.col(lang).cast("string"), F.lit("?")) if lang else F.lit("?")
    # At most LABELLED_SAMPLE rows of two numbers.
    met = docs.select(key, F.col(text).alias("_body"), language.alias("_lang")).join(F.broadcast(sample), key)
    texts = met.select("_lang", (F.col("toxic") == 1).cast("int").alias("_bad"), "_body", F.xxhash64("_body").alias("_name"))
    once = texts.dropDuplicates(["_name"]).drop("_name")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, raw, offsets in at.slices(batch, "_body"):
                words = at.words_of(raw, offsets, lower=True)
                bare = bare_hashes(words)
                _, first = np.unique(at.mix(bare ^ at.mix(words.rows.astype(at.U64) + at.U64(1))), return_index=True)
                first.sort()
                cuts = np.searchsorted(words.rows[first], np.arange(end - start + 1))
                lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(bare[first].view(np.int64)))
                part = batch.slice(start, end - start)
                # The least hash of a text's runs of three words, or of all its words where it has fewer.
                runs, begin = at.window_hashes(words, 3)
                sketch = np.zeros(end - start, at.U64)
                np.add.at(sketch, words.rows, at.mix(words.hashes))
                runs_of = words.rows[begin]
                some, starts = np.unique(runs_of, return_index=True)
                sketch[some] = np.minimum.reduceat(runs, starts) if len(some) else 0
                yield pa.RecordBatch.from_arrays(
                    [at.column(part, "_lang"), at.column(part, "_bad"), pa.array(sketch.view(np.int64)), lists],
                    ["lang", "bad", "sketch", "words"],
                )

    rows = once.mapInArrow(run, "lang string, bad int, sketch long, words array<long>")
    whole = rows.select("lang", "bad", "sketch").distinct().groupBy("lang").agg(
        F.sum("bad").alias("all_bad"), F.count(F.lit(1)).alias("all")
    )
    met_in = rows.select("lang", "bad", "sketch", F.explode("words").alias("word")).distinct()
    counted = met_in.groupBy("lang", "word").agg(F.sum("bad").alias("in_bad"), F.count(F.lit(1)).alias("in_all"))
    sizes = counted.groupBy("lang").agg(F.count(F.lit(1)).alias("words"))
    known = counted.where(F.col("in_bad") >= MARKER_TEXTS).join(whole, "lang").join(sizes, "lang")
    in_bad, in_good = F.col("in_bad"), F.col("in_all") - F.col("in_bad")
    odds = ((in_bad + 0.5) / (F.col("all_bad") + 1.0)) / ((in_good + 0.5) / (F.col("all") - F.col("all_bad") + 1.0))
    # Log-likelihood ratio of the word's toxic share against the language's.
    share = F.least(F.col("all_bad") / F.col("all"), F.lit(1 - 1e-9))
    part = lambda n, expected: F.when(n > 0, n * F.log(n / expected)).otherwise(F.lit(0.0))
    evidence = part(in_bad, F.col("in_all") * share) + part(in_good, F.col("in_all") * (1 - share))
    far = known.select("lang", "word", odds.alias("odds"), (evidence - F.log("words")).alias("evidence")).where(
        (F.col("odds") >= MARKER_ODDS) & (F.col("evidence") >= MARKER_EVIDENCE)
    )
    order = Window.partitionBy("lang").orderBy(F.desc("evidence"), "word")
    best = far.withColumn("place", F.row_number().over(order)).where(F.col("place") <= MARKER_WORDS)
    return np.sort(gathered(best.select("word").distinct())["word"].astype(np.int64).view(at.U64))


STEPPED = ["symbols", "adjacent", "repeated", "dup_lines", "capitals", "bangs", "varied", "abuse"]


def features(
    m: dict[str, np.ndarray], table: np.ndarray, words: at.Words, row: int, cuts: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, values) of one row: its distinct words, its shares in steps, and its votes."""
    mask = at.U64((1 << FEATURE_BITS) - 1)
    names, counts = np.unique(words.hashes[cuts[row] : cuts[row + 1]], return_counts=True)
    value = np.log1p(counts)
    value = value / max(np.sqrt((value * value).sum()), 1e-12)
    steps = [min(int(8 * m[k][row] ** 0.5 * 2), 15) for k in STEPPED]
    steps += [min(int(m["abusive"][row]), 3), *table[row].tolist()]
    named = at.mix(np.array([1 + 16 * i + s for i, s in enumerate(steps)], at.U64))
    return (np.concatenate([names, named]) & mask).astype(np.int64), np.concatenate([value, np.ones(len(steps))])


def train_scorer(rows: list[tuple[np.ndarray, np.ndarray, float]]) -> np.ndarray:
    """Weights of hashed logistic regression on soft labels, by AdaGrad in a fixed order; the last is the bias."""
    weights, grown = np.zeros((1 << FEATURE_BITS) + 1), np.full((1 << FEATURE_BITS) + 1, 1e-6)
    order = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for i in order.permutation(len(rows)):
            buckets, values, label = rows[i]
            score = weights[buckets] @ values + weights[-1]
            error = 1 / (1 + np.exp(-np.clip(score, -50, 50))) - label
            step = error * values
            np.add.at(grown, buckets, step * step)
            np.add.at(weights, buckets, -0.3 * step / np.sqrt(grown[buckets]))
            grown[-1] += error * error
            weights[-1] -= 0.3 * error / np.sqrt(grown[-1])
    return weights


@dataclass
class Classifier:
    """Fixed-size model: abusive words, label model, scorer weights."""

    markers: np.ndarray
    labels: LabelModel
    weights: np.ndarray


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", lang: str | None = "lang") -> Classifier:
    markers = learn_markers(docs, labels, key, text, lang)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, raw, offsets in at.slices(batch, text):
                patterns = pattern_of(votes(text_measures(raw, offsets, markers)[0]))
                names, counts = np.unique(patterns, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(counts, pa.int64())], ["pattern", "n"])

    seen = docs.select(text).mapInArrow(vote, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n"))
    patterns = gathered(seen.orderBy("pattern"))  # at most 3 ** labellers rows
    counts = patterns["n"].astype(np.int64)
    model = fit_label_model(patterns["pattern"].astype(np.int64), counts, len(LABELLERS))

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[np.ndarray, np.ndarray, float]] = []
        for batch in batches:
            for start, end, raw, offsets in at.slices(batch, text):
                m, words = text_measures(raw, offsets, markers)
                table = votes(m)
                label, told = model.posterior(table), (table != ABSTAIN).any(1)
                cuts = words.bounds()
                rows += [(*features(m, table, words, i, cuts), float(label[i])) for i in np.flatnonzero(told).tolist()]
        yield pa.RecordBatch.from_arrays([pa.array([train_scorer(rows)], pa.list_(pa.float64()))], ["weights"])

    total = max(1, int(counts.sum()))
    # A bounded sample for one task: rows chosen by the hash of key and text, repeated ones once.
    named = docs.select(F.xxhash64(key, text).alias("name"), F.col(text).alias(text))
    chosen = named.where(F.pmod("name", F.lit(total)) < TRAINING_SAMPLE).dropDuplicates(["name"])
    bounded = chosen.orderBy("name").limit(2 * TRAINING_SAMPLE).select(text)
    learnt = bounded.orderBy(F.xxhash64(text)).coalesce(1).mapInArrow(train, "weights array<double>").first()
    weights = np.array(learnt["weights"]) if learnt else np.zeros((1 << FEATURE_BITS) + 1)
    return Classifier(markers, model, weights)


def classify(docs: DataFrame, model: Classifier, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` of every row with votes, weak_bad, bad_score and kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # about 2 MB, whatever the corpus
    extra = [
        T.StructField("votes", T.ArrayType(T.IntegerType())), T.StructField("weak_bad", T.DoubleType()),
        T.StructField("bad_score", T.DoubleType()), T.StructField("kept", T.BooleanType()),
    ]
    schema = T.StructType([*docs.select(*keep).schema.fields, *extra])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for start, end, raw, offsets in at.slices(batch, text):
                m, words = text_measures(raw, offsets, model.markers)
                table = votes(m)
                cuts = words.bounds()
                scores = np.full(end - start, model.weights[-1])
                for i in range(end - start):
                    buckets, values = features(m, table, words, i, cuts)
                    scores[i] += model.weights[buckets] @ values
                chance = 1 / (1 + np.exp(-np.clip(scores, -50, 50)))
                part = batch.slice(start, end - start)
                arrays = [at.column(part, c) for c in keep]
                arrays += [
                    pa.array((table - 1).tolist(), pa.list_(pa.int32())), pa.array(model.labels.posterior(table)),
                    pa.array(chance), pa.array(chance < 0.5),
                ]
                yield pa.RecordBatch.from_arrays(arrays, [*keep, "votes", "weak_bad", "bad_score", "kept"])

    return docs.select(*keep, *([] if text in keep else [text])).mapInArrow(run, schema)


def classify_documents(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", lang: str | None = "lang"
) -> DataFrame:
    """One row per document: key, votes, weak_bad, bad_score, kept.

    ``votes`` has -1 (good), 0 (nothing) or 1 (bad) per labeller, ``weak_bad`` is the label
    model's posterior, ``bad_score`` the scorer's chance of bad, ``kept`` whether it is below
    one half. ``labels`` (key, toxic) may be empty; then no word counts as abusive. A null
    text counts as empty: no labeller votes on it. Repeated rows are judged alike; null keys
    take part; an empty table gives no rows; extra columns are ignored.
    """
    return classify(docs, fit(docs, labels, key, text, lang), [key], text)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier keeps, with their own columns (clashing names included)."""
    others = F.struct(F.lit(0), *[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("_row")
    judged = classify(docs.select(others, F.col("text").alias("_body")), fit(docs, labels), ["_row", "_body"], "_body")
    whole = [F.col("_body").alias(c) if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns]
    return judged.where("kept").select(*whole)
