"""Ranked lexical search over deduplicated bags of words.

Only the items' terms can score, so a document is reduced to a bag: the occurrences of these
terms, and a whole number ``m`` from its length. Documents whose bags are identical score
alike for every item. They form one class (grouped by hash and verified by equality of the
whole bag), each class is scored once, and the best classes are expanded to their members by
ascending key. A class is never expanded beyond the members that can be returned.

Two passes: the first reads the texts and writes bags, from which the statistics follow; the
second scores the classes. Items come in blocks of a bounded number of distinct terms, whose
vocabulary and postings travel to the tasks; a task keeps the best classes of each item only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.llm import arrow_text as at
from cadenza.llm.tables import gathered, settle

TOP = 20
#: Text bytes of the items that are answered in one pass over the documents; one longer item is a block of its own.
BLOCK_BYTES = 1 << 22
#: Contributions (class, item, term) that are summed at once.
BATCH_SUMS = 1 << 22

# Bytes of a term: digits, letters and everything beyond ASCII; multi-byte characters have no other bytes.
TERM = np.zeros(256, bool)
TERM[48:58] = TERM[65:91] = TERM[97:123] = TERM[128:] = True


def terms_of(raw: np.ndarray, offsets: np.ndarray) -> at.Words:
    """Maximal runs of term bytes of a slice, A-Z lower-cased."""
    inside = TERM[raw]
    apart = np.ones(len(raw) + 1, bool)
    apart[1:-1] = ~inside[1:] | ~inside[:-1]
    apart[offsets] = True
    starts = np.flatnonzero(inside & apart[:-1])
    ends = np.flatnonzero(inside & apart[1:]) + 1
    rows = np.searchsorted(offsets, starts, "right") - 1
    codes = at.LOWER[raw]
    return at.Words(codes, ~inside, offsets, starts, ends, rows, at.run_hashes(codes, starts, ends))


@dataclass
class Items:
    """A block of items: the sorted hashes of its terms with their bytes, and who asks for which term."""

    ids: list
    terms: np.ndarray  # sorted 64-bit hashes
    spelled: list[bytes]
    asked: np.ndarray  # for each term, where its (item, repeats) entries begin; n + 1 values
    item: np.ndarray
    repeats: np.ndarray

    @property
    def longest(self) -> int:
        """The most terms of an item, repeats included."""
        return int(np.bincount(self.item, self.repeats, max(1, len(self.ids))).max()) if len(self.item) else 0


def items_of(ids: list, texts: list[str | None]) -> Items:
    raw, offsets = at.as_binary(pa.array(texts, pa.large_string()))
    words = terms_of(raw, offsets)
    names, first, term = np.unique(words.hashes, return_index=True, return_inverse=True)
    spelled = [words.text(i) for i in first.tolist()]
    if any(words.text(i) != spelled[t] for i, t in enumerate(term.tolist())):
        raise ValueError("two terms of the items share a hash")
    pairs, repeats = np.unique(np.column_stack([term, words.rows]).astype(np.int64), axis=0, return_counts=True)
    asked = np.searchsorted(pairs[:, 0], np.arange(len(names) + 1))
    return Items(ids, names, spelled, asked, pairs[:, 1], repeats)


def item_blocks(items: DataFrame, key: str, text: str, most: int = BLOCK_BYTES) -> Iterator[Items]:
    """The items in blocks of at most ``most`` text bytes, or one item."""
    ids, texts, size = [], [], 0
    for row in items.select(F.col(key).alias("key"), F.col(text).alias("text")).toLocalIterator():
        length = len((row["text"] or "").encode())
        if ids and size + length > most:
            yield items_of(ids, texts)
            ids, texts, size = [], [], 0
        ids.append(row["key"])
        texts.append(row["text"])
        size += length
    if ids:
        yield items_of(ids, texts)


def bags_of(docs: DataFrame, key: str, text: str, items: Items) -> DataFrame:
    """(key, n, bag) per document: all its terms with repeats, and (term, occurrences) of the items' terms.

    A bag is a row of 32-bit numbers, by ascending term; it is empty where no item can meet it.
    """
    shared = docs.sparkSession.sparkContext.broadcast(items)  # a block's vocabulary, bounded by BLOCK_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        for batch in batches:
            for start, end, raw, offsets in at.slices(batch, "text"):
                words = terms_of(raw, offsets)
                place = np.minimum(np.searchsorted(items.terms, words.hashes), max(0, len(items.terms) - 1))
                met = np.flatnonzero(items.terms[place] == words.hashes) if len(items.terms) else np.zeros(0, np.int64)
                pairs, first, counts = np.unique(
                    words.rows[met] * len(items.terms) + place[met], return_index=True, return_counts=True
                )
                term, row = (pairs % max(1, len(items.terms))), pairs // max(1, len(items.terms))
                # A hash names a term only if its first occurrence in the text is spelled like it.
                same = [words.text(w) == items.spelled[t] for w, t in zip(met[first].tolist(), term.tolist())]
                keep = np.array(same, bool)
                table = np.column_stack([term[keep], counts[keep]]).astype("<u4")
                cuts = np.searchsorted(row[keep], np.arange(end - start + 1))
                bags = [table[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
                yield pa.RecordBatch.from_arrays(
                    [at.column(batch, "key").slice(start, end - start), pa.array(words.per_row, pa.int64()), pa.array(bags, pa.binary())],
                    ["key", "n", "bag"],
                )

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(run, "key long, n long, bag binary")


def document_frequency(bags: DataFrame, terms: int) -> np.ndarray:
    """In how many documents each of the block's terms occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(terms, np.int64)
        for batch in batches:
            table = np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u4").reshape(-1, 2)
            total += np.bincount(table[:, 0], minlength=terms)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used])], ["term", "df"])

    got = gathered(bags.select("bag").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")))
    df = np.zeros(terms, np.int64)
    df[got["term"]] = got["df"]
    return df


def class_members(bags: DataFrame, m: Column, top: int) -> DataFrame:
    """(bag, m, key, place): the ``top`` least keys of every class of identical bag and m, null keys last.

    The limited rank cuts each partition before the shuffle, so a class of a third of all
    documents is never gathered.
    """
    alike = bags.where(F.octet_length("bag") > 0).select("bag", m.alias("m"), "key")
    order = W.partitionBy("bag", "m").orderBy(F.asc_nulls_last("key"))
    return alike.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)


def score_classes(classes: DataFrame, items: Items, weights: np.ndarray, top: int) -> DataFrame:
    """(item, score, class, least): each task's best classes of every item, in the order of score and least key."""
    shared = classes.sparkSession.sparkContext.broadcast((items, weights))
    # Sums of whole numbers below 2 ** 53 are exact in doubles; larger ones are summed in two halves.
    halves = int(weights.max(initial=0)) * 10**6 * max(1, items.longest) >= 1 << 53

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights = shared.value
        width = len(items.ids)
        held = np.zeros((0, 4), np.int64)  # item, score, class, least key

        def best(rows: np.ndarray) -> np.ndarray:
            rows = rows[np.lexsort((rows[:, 2], rows[:, 3], -rows[:, 1], rows[:, 0]))]
            place = np.arange(len(rows)) - np.searchsorted(rows[:, 0], rows[:, 0])
            return rows[place < top]

        def scores(bags: list[bytes], m: np.ndarray) -> np.ndarray:
            """Class x item scores."""
            table = np.frombuffer(b"".join(bags), "<u4").reshape(-1, 2).astype(np.int64)
            of = np.repeat(np.arange(len(bags)), [len(b) // 8 for b in bags])
            term, tf = table[:, 0], table[:, 1]
            part = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[of]))
            asks = items.asked[term + 1] - items.asked[term]
            each = np.repeat(np.arange(len(term)), asks)
            entry = np.arange(len(each)) - np.repeat(np.cumsum(asks) - asks, asks) + items.asked[term][each]
            cell = of[each] * width + items.item[entry]
            size = len(bags) * width
            if halves:
                value = part[each]
                low = np.bincount(cell, (value & 0xFFFFFF) * items.repeats[entry], size).astype(np.int64)
                high = np.bincount(cell, (value >> 24) * items.repeats[entry], size).astype(np.int64)
                return (low + (high << 24)).reshape(len(bags), width)
            return np.bincount(cell, part[each] * items.repeats[entry], size).astype(np.int64).reshape(len(bags), width)

        for batch in batches:
            bags = at.column(batch, "bag").to_pylist()
            m, name = at.column(batch, "m").to_numpy(), at.column(batch, "class").to_numpy()
            least = at.column(batch, "least").fill_null(np.iinfo(np.int64).max).to_numpy()
            floor = np.zeros(width, np.int64)
            step = max(1, min(BATCH_SUMS // max(1, width), 1024))
            for start in range(0, len(bags), step):
                made = scores(bags[start : start + step], m[start : start + step])
                # An item with enough classes needs no class below the last of them.
                full = np.bincount(held[:, 0], minlength=width) >= top
                lowest = np.full(width, np.iinfo(np.int64).max)
                np.minimum.at(lowest, held[:, 0], held[:, 1])
                floor = np.where(full, lowest, 1)
                cls, item = np.nonzero(made >= np.maximum(floor, 1)[None, :])
                found = np.column_stack([item, made[cls, item], name[start + cls], least[start + cls]])
                held = best(np.concatenate([held, found]))
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(held[:, i])) for i in range(4)], ["item", "score", "class", "least"])

    return classes.select("class", "bag", "m", "least").mapInArrow(run, "item long, score long, class long, least long")


def search_block(docs: DataFrame, items: Items, key: str, text: str, top: int) -> DataFrame:
    """(item, rank, key, score) of one block of items."""
    bags = settle(bags_of(docs, key, text, items), "bags")
    stats = bags.agg(F.count_if(F.col("n") > 0).alias("N"), F.sum("n").alias("L")).first()
    count, length = int(stats["N"]), int(stats["L"] or 0)
    df = document_frequency(bags, len(items.terms))
    weights = np.array([math.floor(1000 * math.log((2 * count + 2) / (2 * int(d) + 1))) for d in df], np.int64)
    m = (F.lit(75) + F.expr(f"(25 * n * {count}L) div {max(1, length)}L")).cast("long")
    members = settle(class_members(bags, m, top), "class-members")
    # The classes' first members stand for them; a class is named by a written number.
    classes = settle(
        members.where(F.col("place") == 1).select(F.monotonically_increasing_id().alias("class"), "bag", "m", F.col("key").alias("least")),
        "bag-classes",
    )
    scored = score_classes(classes, items, weights, top)
    order = W.partitionBy("item").orderBy(F.desc("score"), F.asc("least"), F.asc("class"))
    best = settle(scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top).drop("place"), "best-classes")
    # At most ``top`` classes of each item are expanded, each to at most ``top`` members.
    named = settle(best.select("class").distinct().join(classes, "class").select("class", "bag", "m"), "chosen-classes")
    expanded = settle(members.select("bag", "m", "key").join(named, ["bag", "m"]).select("class", "key"), "chosen-members")
    ranked = W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("key"))
    rows = best.select("item", "score", "class").join(expanded, "class")
    return rows.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top).select("item", "rank", "key", "score")


def search(
    docs: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    top: int = TOP,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The ``top`` best documents of every item: item_key, rank, key, score.

    Terms are maximal runs of digits, letters and characters beyond ASCII, A-Z lower-cased. A
    term weighs floor(1000 * ln((2 N + 2) / (2 df + 1))), a document has m = 75 + (25 n N) div L,
    and its score sums weight * ((10**9 tf) div (1000 tf + 12 m)) over the item's terms, repeats
    included. Documents score above 0; equal scores go by ascending key.

    Every item row is an item of its own, also where ids repeat or are null; an item without
    text, terms or matches has no rows. Documents without text or terms match nothing. Rows
    that repeat a key are documents of their own; null keys come after all others. Keys are
    whole numbers. Empty tables give no rows; extra columns are ignored.
    """
    spark = docs.sparkSession
    kind = items.schema[item_key].dataType.simpleString()
    out = spark.createDataFrame([], f"`{item_key}` {kind}, rank int, `{key}` long, score long")
    for block in item_blocks(items, item_key, item_text, block_bytes):
        if not len(block.terms):
            continue
        found = settle(search_block(docs, block, key, text, top), "found")
        names = spark.createDataFrame(list(enumerate(block.ids)), f"item long, name {kind}")
        out = out.unionByName(
            found.join(F.broadcast(names), "item").select(  # at most the items of one block
                F.col("name").alias(item_key), "rank", F.col("key").alias(key), "score"
            )
        )
    return out
