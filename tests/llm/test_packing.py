"""Packing against the tokenizers library, a plain best-fit search, and whole coverage."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cadenza.llm import packing
from cadenza.llm.queries import BYTE_PATTERN, BYTE_RANKS, BYTE_TOKENIZER

WINDOW = packing.WINDOW


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def check(rows, docs, tokenizer):
    """Every document's ids lie once in gapless sequences of at most a window."""
    want = sorted(
        [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for _, t in docs
    )
    sequences, texts = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        texts[r["doc_id"]].append(r)
    for spans in sequences.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end and length > 0
            end = offset + length
        assert end <= WINDOW
    ids_of = defaultdict(list)
    for d, t in docs:
        ids_of[d].append([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0])
    pieces = [(r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows]
    expected = [
        (d, s, len(ids[s : s + WINDOW]), zlib.crc32(np.array(ids[s : s + WINDOW], "<u4").tobytes()), len(ids))
        for d, many in ids_of.items() for ids in many for s in range(0, len(ids), WINDOW)
    ]
    order = lambda row: tuple((v is not None, v or 0) for v in row)
    assert sorted(pieces, key=order) == sorted(expected, key=order)
    return len(sequences), sum(map(len, want))


def test_documents(documents, tokenizer):
    rows = packing.pack_documents(documents, BYTE_RANKS, BYTE_PATTERN, BYTE_TOKENIZER).collect()
    used, tokens = check(rows, [(r["doc_id"], r["text"]) for r in documents.collect()], tokenizer)
    assert used * WINDOW <= tokens * 1.02 + WINDOW


def test_odd_documents(odd_documents, tokenizer):
    rows = packing.pack_documents(odd_documents, BYTE_RANKS, BYTE_PATTERN, BYTE_TOKENIZER).collect()
    check(rows, [(r["doc_id"], r["text"]) for r in odd_documents.collect()], tokenizer)


def test_added_token_is_one_id(spark, tokenizer):
    texts = ["hello <|endoftext|> x", "<|endoftext|><|endoftext|>", "a<|endoftext|", " <|endoftext|>\nb", "<|endoftext|>"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = packing.pack_documents(docs, BYTE_RANKS, BYTE_PATTERN, BYTE_TOKENIZER, with_ids=True).collect()
    check(rows, list(enumerate(texts)), tokenizer)
    assert 50256 in next(r["ids"] for r in rows if r["doc_id"] == 0)


def test_ids_and_empty(documents, no_documents):
    rows = packing.pack_documents(documents.limit(20), BYTE_RANKS, BYTE_PATTERN, BYTE_TOKENIZER, with_ids=True).collect()
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and r["length"] == len(r["ids"]) for r in rows)
    assert packing.pack_documents(no_documents, BYTE_RANKS, BYTE_PATTERN, BYTE_TOKENIZER).collect() == []


def plain_best_fit(lengths, window):
    rooms, sequence, offset = [], [0] * len(lengths), [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        fits = [(room, s) for s, room in enumerate(rooms) if room >= lengths[i]]
        if not fits:
            rooms.append(window)
            fits = [(window, len(rooms) - 1)]
        room = min(r for r, _ in fits)
        chosen = next(s for r, s in fits if r == room)
        sequence[i], offset[i] = chosen, window - rooms[chosen]
        rooms[chosen] -= lengths[i]
    return sequence, offset


@pytest.mark.parametrize("window", [1, 7, 16, 100])
def test_best_fit_decreasing(window):
    rng = random.Random(window)
    for n in (0, 1, 5, 60):
        lengths = [rng.randint(1, window) for _ in range(n)]
        sequence, offset = packing.best_fit_decreasing(np.array(lengths, np.int64), window)
        plain, _ = plain_best_fit(lengths, window)
        # Ties between equal rooms may go to either window; the rooms left are the same.
        left = lambda s: sorted(window - sum(l for l, x in zip(lengths, s) if x == i) for i in set(s))
        assert left(list(sequence)) == left(plain)


def test_blocks_bound_a_task(spark):
    lengths = [random.Random(3).randint(1, 1023) for _ in range(500)]
    pieces = spark.createDataFrame([(i, 0, n, 0, n) for i, n in enumerate(lengths)], "doc_id long, start long, length long, ids_crc32 long, doc_tokens long").coalesce(1)
    rows = packing.place_remainders(pieces, block=64).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(500))
    total = defaultdict(int)
    for r in rows:
        total[r["sequence_id"]] += r["length"]
    assert max(total.values()) <= 1024
