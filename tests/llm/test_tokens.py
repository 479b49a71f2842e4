"""Longest-match counts and piece paths against plain searches and the sentencepiece library."""

import math
import random
import zlib

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from cadenza.llm import longest_match as lm
from cadenza.llm import piece_viterbi as pv
from cadenza.llm.queries import PIECES


def greedy(word, initial, inner):
    count, at, pieces = 0, 0, initial
    while at < len(word):
        size = max((n for n in range(1, len(word) - at + 1) if word[at : at + n] in pieces), default=0)
        if not size:
            return 0
        count, at, pieces = count + 1, at + size, inner
    return count


@settings(max_examples=200, deadline=None)
@given(
    st.sets(st.text("abc", min_size=1, max_size=5), max_size=12), st.sets(st.text("abc", min_size=1, max_size=5), max_size=12),
    st.lists(st.text("abcd", min_size=1, max_size=14), max_size=8),
)
def test_longest_match_is_greedy(initial, inner, words):
    initial, inner = {p.encode() for p in initial}, {p.encode() for p in inner}
    machine = lm.LongestMatch(initial, inner)
    for word in words:
        assert machine.count(word.encode()) == greedy(word.encode(), initial, inner)


def test_counts_of_documents(documents, odd_documents, no_documents):
    initial, inner = map(set, lm.vocabulary(PIECES))
    known = {}

    def pieces(word):
        if word not in known:
            known[word] = greedy(word, initial, inner)
        return known[word]

    for docs in (documents, odd_documents):
        for known_words in (10, lm.KNOWN_WORDS):
            rows = lm.count_tokens(docs, PIECES, known_words=known_words).collect()
            want = []
            for r in docs.collect():
                words = (r["text"] or "").encode().split()
                each = [pieces(w) for w in words]
                want.append((r["doc_id"], len(words), sum(n or 1 for n in each), sum(n == 0 for n in each)))
            key = lambda r: tuple((v is not None, v or 0) for v in r)
            assert sorted(map(tuple, rows), key=key) == sorted(want, key=key)
    assert lm.count_tokens(no_documents, PIECES).collect() == []


def plain_best(coder, scores, stretch):
    best = [0.0] + [-math.inf] * len(stretch)
    for end in range(1, len(stretch) + 1):
        for start in range(end):
            if stretch[start:end] in scores:
                best[end] = max(best[end], best[start] + scores[stretch[start:end]])
        if stretch[end - 1] not in coder.single:
            best[end] = max(best[end], best[end - 1] + pv.FALLBACK)
    return best[-1]


@settings(max_examples=200, deadline=None)
@given(st.sets(st.text("abc▁", min_size=1, max_size=4), min_size=1, max_size=15), st.text("abcdé▁ ", max_size=15), st.randoms())
def test_viterbi_is_best_and_round_trips(pieces, text, rng):
    pieces = sorted({pv.MARK, *(p for p in pieces if pv.MARK not in p.lstrip(pv.MARK))})
    numbered = [(p, 300 + i, -rng.randint(1, 9) * pv.SCALE // rng.choice([1, 3])) for i, p in enumerate(pieces)]
    coder = pv.PieceCoder(numbered, list(range(256)), remembered=2)
    scores = {p: s for p, _, s in numbered}
    by_id = {i: s for _, i, s in numbered}
    assert coder.decode(coder.encode(text)) == text
    stretch = text.replace(" ", pv.MARK)
    ids = coder.best_path(stretch)
    bytes_used = [i for i in ids if i < 256]
    chars = len(bytes(bytes_used).decode())
    got = sum(by_id.get(i, 0) for i in ids) + pv.FALLBACK * chars
    assert got == plain_best(coder, scores, stretch)


def test_unfit_vocabularies_are_errors():
    for pieces in (["a"], [pv.MARK, "a" + pv.MARK]):
        with pytest.raises(ValueError):
            pv.PieceCoder([(p, 300 + i, -1.0) for i, p in enumerate(pieces)], list(range(256)))


def test_against_the_library(documents):
    """The same unigram scores in the library's own model give the same total score."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(PIECES, "rb") as f:
        model.ParseFromString(f.read())
    pieces, _ = pv.vocabulary(PIECES)
    scores = {i: s for _, i, s in pieces}
    for i, piece in enumerate(model.pieces):
        piece.score = scores.get(i, 0) / pv.SCALE
    model.trainer_spec.model_type = 1  # unigram
    library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    coder = pv.coder(PIECES)
    total = lambda ids: sum(scores.get(i, 0) for i in ids) / pv.SCALE
    compared = 0
    for r in documents.limit(60).collect():
        for word in r["text"].split()[:200]:
            if coder.single.issuperset(pv.MARK + word):
                mine, theirs = coder.encode(word), library.encode(word)
                assert coder.decode(mine) == word
                assert total(mine) == pytest.approx(total(theirs), abs=1e-3)
                compared += 1
    assert compared > 1000


def test_documents_round_trip(documents, odd_documents, no_documents):
    for docs in (documents, odd_documents):
        out = pv.encode_documents(docs, PIECES, with_ids=True)
        rows = out.collect()
        assert len(rows) == docs.count() and all(r["exact"] for r in rows)
        assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["n_pieces"] for r in rows)
        back = pv.decode_documents(out, PIECES).collect()
        key = lambda r: tuple((v is not None, str(v)) for v in r)
        assert sorted(map(tuple, back), key=key) == sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=key)
    assert pv.encode_documents(no_documents, PIECES).collect() == []


def test_whole_text_path_is_the_chain_of_its_stretches():
    coder = pv.coder(PIECES)
    rng = random.Random(4)
    for _ in range(50):
        text = "".join(rng.choice(["the", " ", "  ", "house", "Ünder", "x", "\n", "12"]) for _ in range(12)) or "a"
        scores = {i: s for (_, i, s) in pv.vocabulary(PIECES)[0]}
        total = lambda ids: sum(scores.get(i, pv.FALLBACK) for i in ids)
        whole = coder.best_path(pv.MARK + text.replace(" ", pv.MARK))
        assert whole == coder.encode(text)
        # However texts come together, each keeps its ids.
        together, bounds = coder.encode_texts([text, "other " + text, "", text])
        assert together[bounds[0] : bounds[1]].tolist() == together[bounds[3] : bounds[4]].tolist() == whole


def spelled(word, initial, inner):
    """Greedy longest match by characters; the lone mark and byte tokens where no piece fits."""
    count, at, pieces = 0, 0, initial
    while at < len(word):
        size = max((n for n in range(1, len(word) - at + 1) if word[at : at + n] in pieces), default=0)
        if not size and pieces is initial:
            count, pieces = count + 1, inner
            continue
        count += 1 if size else len(word[at].encode())
        at, pieces = at + (size or 1), inner
    return count


def test_every_word_is_spelled(spark, documents, odd_documents):
    from cadenza.llm.queries import op6_token_counts

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    machine = lm.automaton(PIECES, True)
    for word in ["ñes", "2024", "7", "ç", "中文字", "\U0001f9ff", "\U0001f9ff\U0001f9ff1"]:
        assert machine.count(word.encode()) == len(library.encode(word)), word
    initial, inner = ({p.decode() for p in side} for side in lm.vocabulary(PIECES))
    for docs in (documents, odd_documents):
        want = []
        for r in docs.collect():
            words = [w.decode() for w in (r["text"] or "").encode().split()]
            want.append((r["doc_id"], len(words), sum(spelled(w, initial, inner) for w in words), 0))
        key = lambda r: tuple((v is not None, v or 0) for v in r)
        rows = lm.count_tokens(docs, PIECES, spell=True).collect()
        assert sorted(map(tuple, rows), key=key) == sorted(want, key=key)
    got = op6_token_counts(spark, "/root/testdata/sf0.001").agg({"n_unknown": "sum"}).first()[0]
    assert got == 0
