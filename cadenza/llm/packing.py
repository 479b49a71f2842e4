"""Token packing into fixed windows by best-fit decreasing.

A document is its token ids plus an end id. Longer than a window, it is cut into full
windows, which are sequences of their own; the remainder (or a whole shorter document) is
packed. Inside a task, blocks of remainders are placed longest first, each into the open
window with the least room that still holds it. A segment tree indexed by remaining room
finds that window.

No row moves between tasks: cutting follows the scan of the documents, packing the scan of
the written pieces, whose blocks are bounded. A block wastes at most the tail of its own
windows.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm import arrow_text as at
from cadenza.llm.tables import settle

WINDOW = 1024
END_ID = 0
#: Remainders placed together; bounds a task's memory.
BLOCK_PIECES = 1 << 16
#: Tokens after which a task hands its pieces on.
BATCH_TOKENS = 1 << 20


@lru_cache(maxsize=2)
def byte_pair_encoding(ranks_path: str, pattern: str, tokenizer_path: str | None = None) -> tiktoken.Encoding:
    """The public byte-level vocabulary as ranks, with the added tokens of a tokenizer file.

    An added token in a text is one id and cuts the text around it, as the tokenizer file has
    it; only plain added tokens are known (no stripping, no normalising, not as single words).
    """
    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    added: list[dict] = []
    if tokenizer_path:
        with open(tokenizer_path, encoding="utf-8") as lines:
            added = json.load(lines)["added_tokens"]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
            raise ValueError(f"added tokens of {tokenizer_path} are more than plain strings")
    return tiktoken.Encoding(
        "ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={t["content"]: t["id"] for t in added}
    )


class RoomTree:
    """Open windows by remaining room: a segment tree of counts over 0..window."""

    def __init__(self, window: int) -> None:
        self.width = 1 << window.bit_length()
        self.count = [0] * (2 * self.width)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def put(self, room: int, sequence: int) -> None:
        self.open[room].append(sequence)
        node = room + self.width
        while node:
            self.count[node] += 1
            node >>= 1

    def take_tightest(self, need: int) -> tuple[int, int] | None:
        """(room, sequence) of the least room that is at least ``need``, removed; or None."""
        node = need + self.width
        if not self.count[node]:
            # Climb until a right sibling has windows, then go down to its leftmost one.
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.width:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        room = node - self.width
        while node:
            self.count[node] -= 1
            node >>= 1
        return room, self.open[room].pop()


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece; equal lengths keep their order. No length exceeds the window."""
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree, opened = RoomTree(window), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        found = tree.take_tightest(need)
        if found is None:
            found = (window, opened)
            opened += 1
        room, sequence[i] = found
        offset[i] = window - room
        if room > need:
            tree.put(room - need, int(sequence[i]))
    return sequence, offset


PIECES = "start long, length long, ids_crc32 long, doc_tokens long"


def cut_documents(
    docs: DataFrame, key: str, text: str, ranks_path: str, pattern: str, tokenizer_path: str | None = None,
    window: int = WINDOW, with_ids: bool = False,
) -> DataFrame:
    """One row per piece: the key, start, length, ids_crc32, doc_tokens and, if asked for, ids.

    A null text counts as empty: one piece that holds the end id alone.
    """
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, {PIECES}" + (", ids array<int>" if with_ids else "")

    def as_batch(keys: pa.Array, out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out)) if out else [()] * 6
        arrays = [keys.take(pa.array(columns[0], pa.int64())), *(pa.array(c, pa.int64()) for c in columns[1:5])]
        names = [key, "start", "length", "ids_crc32", "doc_tokens"]
        if with_ids:
            arrays.append(pa.array(columns[5], pa.list_(pa.int32())))
            names.append("ids")
        return pa.RecordBatch.from_arrays(arrays, names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = byte_pair_encoding(ranks_path, pattern, tokenizer_path)
        for batch in batches:
            keys, texts = at.column(batch, key), at.column(batch, text)
            out: list[tuple] = []
            tokens = 0
            for row, body in enumerate(texts):
                ids = np.array([*coder.encode(body.as_py() or "", allowed_special="all"), END_ID], "<u4")
                for start in range(0, len(ids), window):
                    part = ids[start : start + window]
                    out.append((row, start, len(part), zlib.crc32(part.tobytes()), len(ids), part))
                tokens += len(ids)
                if tokens >= BATCH_TOKENS:
                    yield as_batch(keys, out)
                    out, tokens = [], 0
            yield as_batch(keys, out)

    return docs.select(key, text).mapInArrow(cut, schema)


def place_remainders(pieces: DataFrame, window: int = WINDOW, block: int = BLOCK_PIECES) -> DataFrame:
    """Adds odd ``sequence_id`` and ``offset`` to pieces shorter than a window."""

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = TaskContext.get().partitionId() << 40
        held: list[pd.DataFrame] = []
        count = used = 0

        def packed() -> pd.DataFrame:
            nonlocal held, count, used
            frame = pd.concat(held, ignore_index=True)
            sequence, offset = best_fit_decreasing(frame["length"].to_numpy(), window)
            frame["sequence_id"] = 2 * (first + used + sequence) + 1
            frame["offset"] = offset
            used += int(sequence.max()) + 1
            held, count = [], 0
            return frame

        for frame in frames:
            for at_row in range(0, len(frame), block):
                part = frame.iloc[at_row : at_row + block]
                if count + len(part) > block:
                    yield packed()
                held.append(part)
                count += len(part)
        if count:
            yield packed()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return pieces.mapInPandas(place, f"{schema}, sequence_id long, offset long")


def pack_documents(
    docs: DataFrame,
    ranks_path: str,
    pattern: str,
    tokenizer_path: str | None = None,
    key: str = "doc_id",
    text: str = "text",
    window: int = WINDOW,
    with_ids: bool = False,
) -> DataFrame:
    """All documents as pieces in sequences of at most ``window`` tokens.

    Columns: the key, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if
    asked for, ids. The added tokens of ``tokenizer_path`` are single ids. Every id of every document lies in exactly one piece; offsets of a
    sequence run on from 0 without gaps; what is left of a window is padding. Sequence ids
    are unique, even for full windows and odd for packed ones, with gaps between tasks.
    Null texts count as empty; null and repeated keys are documents like any other; an empty
    table gives no pieces; extra columns are ignored.
    """
    pieces = settle(cut_documents(docs, key, text, ranks_path, pattern, tokenizer_path, window, with_ids), "pieces")
    full = pieces.where(F.col("length") == window).select(
        "*", (F.monotonically_increasing_id() * 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    rest = place_remainders(pieces.where(F.col("length") < window), window)
    columns = [key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return full.unionByName(rest).select(*columns, *(["ids"] if with_ids else []))
