"""Near duplicates by an inverted join on MinHash signature coordinates.

Equal shingle sets form one class first, so copies are never compared. A class has one
MinHash value per coordinate. Two classes are candidates when at least ``matches`` of their
``coordinates`` agree. Classes are posted under (coordinate, value) pairs, and

* prefix: under one total order of all pairs, rare before frequent, two classes that agree
  in ``matches`` pairs share one of their first ``coordinates - matches + 1``. Only these
  are posted. Any total order keeps this true; the one used orders by a counting sketch of
  fixed size, so common shingles end up outside the prefixes;
* skip merging: a posting carries one byte per coordinate of its class. The members of a list
  are merged by counting agreeing bytes; a list hands on a forest of those that agree, so
  members already connected are skipped and no list emits all its pairs.

The components of these forests hold all candidates. Inside a component all pairs are
confirmed on their full shingle sets, unless links found before connect them already. Lists
and components above a bounded size are cut into blocks that meet pairwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm import arrow_text as at
from cadenza.llm.components import components
from cadenza.llm.tables import gathered, settle

COORDINATES = 48
#: Least agreeing coordinates of a candidate: fewer has a chance of 4.8e-5 at Jaccard 0.8, 8.6e-6 at 0.82.
MATCHES = 27
#: Members of a list or component that one task compares with as many others; longer ones are cut.
BLOCK = 2048
#: Shingles in such a block of a component, so that long texts bound it as well.
BLOCK_SHINGLES = 1 << 20
#: Lists up to this length hand on their agreeing pairs as they are, longer ones a forest.
SHORT_LIST = 64
#: Counters of the sketch that orders postings: fixed size, whatever the corpus.
SKETCH_BITS = 18
PERCENT = 80

_FACTORS = at.mix(np.arange(1, 257, dtype=at.U64)) | at.U64(1)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row of a slice, sorted inside a row, and their n + 1 bounds.

    A row with fewer words than ``width`` has its whole sequence as one shingle, a row
    without words has none.
    """
    words = at.words_of(raw, offsets, lower=True)
    rows = len(offsets) - 1
    hashes, first = at.window_hashes(words, width)
    of = words.rows[first]
    per_row = words.per_row
    short = np.flatnonzero((per_row > 0) & (per_row < width))
    begins = words.bounds()
    whole = np.zeros(len(short), at.U64)
    for k in range(width - 1):
        has = per_row[short] > k
        whole[has] = at.mix(whole[has] + words.hashes[begins[short[has]] + k] + at.U64(k + 1))
    out = [np.zeros(0, at.U64)] * rows
    for row, value in zip(short.tolist(), whole):
        out[row] = np.array([value], at.U64)
    cuts = np.searchsorted(of, np.arange(rows + 1))
    for row in np.flatnonzero(np.diff(cuts)).tolist():
        out[row] = np.unique(hashes[cuts[row] : cuts[row + 1]])
    sizes = np.array([len(s) for s in out], np.int64)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    return np.concatenate([np.zeros(0, at.U64), *out]), bounds


def class_hashes(shingles: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One 64-bit name per set (0 for an empty one); equal sets have equal names."""
    sums = np.concatenate([np.zeros(1, at.U64), np.cumsum(at.mix(shingles))])
    sizes = np.diff(bounds).astype(at.U64)
    names = at.mix(sums[bounds[1:]] - sums[bounds[:-1]] + sizes * at.U64(0x9FB21C651E98DF25))
    return np.where(sizes > 0, names, at.U64(0))


def minhash(shingles: np.ndarray, bounds: np.ndarray, coordinates: int) -> np.ndarray:
    """Signatures (rows x coordinates, 32-bit names of the least shingles) of the non-empty sets."""
    filled = bounds[:-1][np.diff(bounds) > 0]
    out = np.zeros((len(filled), coordinates), np.uint32)
    if len(filled):
        for i in range(coordinates):
            least = np.minimum.reduceat(shingles * _FACTORS[i], filled)
            out[:, i] = least & at.U64(0xFFFFFFFF)
    return out


def sign_documents(docs: DataFrame, key: str, text: str, width: int, coordinates: int) -> DataFrame:
    """(key, name, n_shingles, node, signature): node and signature are null for texts without words.

    ``name`` is a hash of the text: key and name tell rows apart where a key repeats.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, raw, offsets in at.slices(batch, text):
                shingles, bounds = shingle_sets(raw, offsets, width)
                sizes = np.diff(bounds)
                signed = minhash(shingles, bounds, coordinates)
                packed = iter(signed)
                signatures = [next(packed).tobytes() if n else None for n in sizes]
                nodes = class_hashes(shingles, bounds).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(at.column(batch, c).slice(start, end - start) for c in (key, "name")), pa.array(sizes, pa.int64()),
                        pa.array(nodes, pa.int64(), mask=sizes == 0), pa.array(signatures, pa.binary()),
                    ],
                    [key, "name", "n_shingles", "node", "signature"],
                )

    named = docs.select(key, text, F.xxhash64(text).alias("name"))
    return named.mapInArrow(run, f"`{key}` {kind}, name long, n_shingles long, node long, signature binary")


def _signature_rows(column: pa.Array, coordinates: int) -> np.ndarray:
    joined = b"".join(column.to_pylist())
    return np.frombuffer(joined, np.uint32).reshape(-1, coordinates)


def _pair_names(signatures: np.ndarray) -> np.ndarray:
    """A 64-bit name for every (coordinate, value)."""
    numbers = np.arange(signatures.shape[1], dtype=at.U64) << at.U64(32)
    return at.mix(signatures.astype(at.U64) | numbers[None, :])


def posting_sketch(classes: DataFrame, coordinates: int) -> np.ndarray:
    """Counts of (coordinate, value) pairs in a fixed number of buckets, over all classes."""
    size = 1 << SKETCH_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            names = _pair_names(_signature_rows(batch.column(0), coordinates))
            total += np.bincount((names & at.U64(size - 1)).astype(np.int64).ravel(), minlength=size)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], ["bucket", "n"])

    counted = classes.select("signature").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    got = gathered(counted)  # at most 2 ** SKETCH_BITS rows
    sketch = np.zeros(size, np.int64)
    sketch[got["bucket"]] = got["n"]
    return sketch


def postings(classes: DataFrame, coordinates: int, matches: int) -> DataFrame:
    """(token, node, bytes, often): each class under its ``coordinates - matches + 1`` rarest pairs.

    ``bytes`` has the last byte of every coordinate's value, ``often`` the sketch's count,
    which no list of the token exceeds.
    """
    prefix = coordinates - matches + 1
    sketch = classes.sparkSession.sparkContext.broadcast(posting_sketch(classes, coordinates))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signatures = _signature_rows(batch.column(1), coordinates)
            names = _pair_names(signatures)
            often = sketch.value[(names & at.U64((1 << SKETCH_BITS) - 1)).astype(np.int64)]
            rare = np.lexsort((names, often))[:, :prefix]
            tokens = np.take_along_axis(names, rare, 1).view(np.int64).ravel()
            counts = np.take_along_axis(often, rare, 1).ravel()
            nodes = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), prefix)
            short = (signatures & np.uint32(255)).astype(np.uint8)
            packed = pa.array([row.tobytes() for row in short], pa.binary())
            packed = packed.take(pa.array(np.repeat(np.arange(len(short)), prefix)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(tokens), pa.array(nodes), packed, pa.array(counts)], ["token", "node", "bytes", "often"]
            )

    return classes.select("node", "signature").mapInArrow(post, "token long, node long, bytes binary, often long")


def _block_pairs(rows: DataFrame, blocks: Column) -> DataFrame:
    """Each row once per pair of blocks its own block belongs to, as (low, high, is_low)."""
    own = F.pmod(F.xxhash64("node", F.lit(1)), blocks).cast("int")
    dealt = rows.withColumns({"_own": own, "_other": F.explode(F.sequence(F.lit(0), blocks - 1))})
    return dealt.withColumns(
        {"low": F.least("_own", "_other"), "high": F.greatest("_own", "_other"), "is_low": F.col("_own") <= F.col("_other")}
    ).drop("_own", "_other")


def _stretches(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """A sorted partition in pieces of whole groups: the last group of a batch waits for the next."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        changes = np.zeros(batch.num_rows, bool)
        for key in keys:
            values = batch.column(key).to_numpy(zero_copy_only=False)
            changes[1:] |= values[1:] != values[:-1]
        changes[0] = bool(held) and any(held[-1].column(k)[-1].as_py() != batch.column(k)[0].as_py() for k in keys)
        cuts = np.flatnonzero(changes)
        if len(cuts):
            if held or cuts[-1]:
                yield pa.Table.from_batches([*held, batch.slice(0, int(cuts[-1]))]).combine_chunks()
            held = [batch.slice(int(cuts[-1]))]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _group_bounds(table: pa.Table, keys: list[str]) -> np.ndarray:
    changes = np.zeros(table.num_rows + 1, bool)
    changes[[0, -1]] = True
    for key in keys:
        values = table.column(key).to_numpy()
        changes[1:-1] |= values[1:] != values[:-1]
    return np.flatnonzero(changes)


def _rows_of(column: pa.ChunkedArray, kind: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)


def _agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Agreeing coordinates of every row of ``a`` with every row of ``b``."""
    total = np.zeros((len(a), len(b)), np.uint8)
    for i in range(a.shape[1]):
        total += a[:, i][:, None] == b[:, i][None, :]
    return total


def spanning_forest(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and the least node each reaches by links between left and right, itself left out."""
    most = np.iinfo(np.int64).max
    a, b = left.copy(), right.copy()
    while True:
        low_a = np.minimum(a, np.where(linked, b[None, :], most).min(1))
        low_b = np.minimum(b, np.where(linked, low_a[:, None], most).min(0))
        if (low_a == a).all() and (low_b == b).all():
            break
        a, b = low_a, low_b
    nodes, least = np.concatenate([left, right]), np.concatenate([a, b])
    other = nodes != least
    return nodes[other], least[other]


LIST_KEYS = ["token", "low", "high"]


def candidate_forest(posted: DataFrame, coordinates: int, matches: int) -> DataFrame:
    """(a, b) links that connect all classes that share a list and agree in ``matches`` coordinates."""
    # Only a token whose sketch count exceeds a block can have a longer list.
    long_lists = posted.where(F.col("often") > BLOCK).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    cut = settle(
        long_lists.where(F.col("n") > BLOCK).select("token", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")),
        "long-lists",
    )
    dealt = _block_pairs(posted.drop("often").join(cut, "token", "left"), F.coalesce("blocks", F.lit(1))).drop("blocks")
    partitions = int(posted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = dealt.repartition(partitions, *LIST_KEYS).sortWithinPartitions(*LIST_KEYS)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _stretches(batches, LIST_KEYS):
            node = table["node"].to_numpy()
            signs = _rows_of(table["bytes"], np.uint8, coordinates)
            is_low = table["is_low"].combine_chunks().to_numpy(zero_copy_only=False)
            whole = table["low"].to_numpy() == table["high"].to_numpy()
            bounds = _group_bounds(table, LIST_KEYS)
            sizes = np.diff(bounds)
            end = np.repeat(bounds[1:], sizes)
            short = np.repeat(sizes <= SHORT_LIST, sizes)
            found = []
            for step in range(1, min(int(sizes.max()), SHORT_LIST)):
                first = np.flatnonzero(short[:-step] & (np.arange(len(node) - step) + step < end[:-step]))
                meets = whole[first] | (is_low[first] != is_low[first + step])
                first = first[meets]
                agree = (signs[first] == signs[first + step]).sum(1) >= matches
                found.append((node[first[agree]], node[first[agree] + step]))
            for start, stop in zip(bounds[:-1][sizes > SHORT_LIST], bounds[1:][sizes > SHORT_LIST]):
                rows = np.arange(start, stop)
                left, right = (rows, rows) if whole[start] else (rows[is_low[rows]], rows[~is_low[rows]])
                linked = _agreement(signs[left], signs[right]) >= matches
                found.append(spanning_forest(linked, node[left], node[right]))
            a, b = (np.concatenate([x[i] for x in found] or [np.zeros(0, np.int64)]) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["a", "b"])

    return ordered.mapInArrow(merge, "a long, b long").where(F.col("a") > F.col("b")).distinct()


def named_texts(docs: DataFrame, key: str, text: str, *more: Column) -> DataFrame:
    """(own_key, own_name, *more): rows by key and hash of the text, whatever their columns are called."""
    return docs.select(F.col(key).alias("own_key"), F.xxhash64(text).alias("own_name"), *more)


def same_text(other: DataFrame, key: str, name: str) -> Column:
    """Whether a row of ``named_texts`` is the text that ``other`` names; null keys are equal."""
    return F.col("own_key").eqNullSafe(other[key]) & (F.col("own_name") == other[name])


def full_sets(docs: DataFrame, key: str, text: str, width: int, wanted: DataFrame) -> DataFrame:
    """(node, shingles) of the ``wanted`` (node, member) classes, from a whole text of each."""
    known = wanted.select("member.key", "member.name", F.col("node").alias("wanted"))
    # The wanted keys grow with the corpus: never broadcast, so that every size has the same plan.
    # A key may come with several texts: the text's name goes into the join, so none is multiplied.
    bodies = named_texts(docs, key, text, F.col(text).alias("body")).join(known.hint("merge"), same_text(known, "key", "name"))
    bodies = bodies.select("wanted", "body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = at.column(batch, "wanted").to_numpy(zero_copy_only=False)
            for start, end, raw, offsets in at.slices(batch, "body"):
                shingles, bounds = shingle_sets(raw, offsets, width)
                nodes = class_hashes(shingles, bounds).view(np.int64)
                values = pa.array([shingles[x:y].tobytes() for x, y in zip(bounds[:-1], bounds[1:])], pa.binary())
                # Texts of one name may differ, however rarely: only that of the wanted class counts.
                own = pa.array(nodes == asked[start:end])
                yield pa.RecordBatch.from_arrays([pa.array(nodes), values], ["node", "shingles"]).filter(own)

    # Rows that repeat a key and a text give the same set.
    return bodies.mapInArrow(run, "node long, shingles binary").dropDuplicates(["node"])


def confirmed_forest(sets: DataFrame, percent: int, coordinates: int, matches: int) -> DataFrame:
    """(a, b) links that connect what links of 100 * intersection >= percent * union connect.

    ``sets`` has (component, blocks, node, shingles): only rows of one component are compared.
    """
    keys = ["component", "low", "high"]
    partitions = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = _block_pairs(sets, F.col("blocks")).drop("blocks")
    ordered = dealt.repartition(partitions, *keys).sortWithinPartitions(*keys)

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _stretches(batches, keys):
            node = table["node"].to_numpy()
            is_low = table["is_low"].combine_chunks().to_numpy(zero_copy_only=False)
            whole = table["low"].to_numpy() == table["high"].to_numpy()
            bodies = table["shingles"].combine_chunks()
            bounds = _group_bounds(table, keys)
            links: list[tuple[int, int]] = []
            for start, stop in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                if stop - start > 1:
                    own = [np.frombuffer(b, at.U64) for b in bodies[start:stop].to_pylist()]
                    low = np.ones(stop - start, bool) if whole[start] else is_low[start:stop]
                    links += linked_sets(own, node[start:stop], low, bool(whole[start]), percent, coordinates, matches)
            a, b = zip(*links) if links else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return ordered.mapInArrow(confirm, "a long, b long")


def linked_sets(
    sets: list[np.ndarray], nodes: np.ndarray, low: np.ndarray, whole: bool, percent: int, coordinates: int, matches: int
) -> list[tuple[int, int]]:
    """Links between sorted shingle sets that connect all that are similar enough.

    Without ``whole`` only ``low`` sets meet the others. Sets whose signatures agree too
    little and sets that links already connect are not intersected.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    flat = np.concatenate(sets)
    signs = (minhash(flat, bounds, coordinates) & np.uint32(255)).astype(np.uint8)
    names, ids = np.unique(flat, return_inverse=True)
    flags = np.zeros(len(names), bool)
    group = np.arange(len(sets))
    links = []
    for i in np.flatnonzero(low).tolist():
        later = np.arange(i + 1, len(sets)) if whole else np.flatnonzero(~low)
        later = later[group[later] != group[i]]
        smaller, larger = np.minimum(sizes[i], sizes[later]), np.maximum(sizes[i], sizes[later])
        later = later[100 * smaller >= percent * larger]
        later = later[(signs[later] == signs[i]).sum(1) >= matches]
        if not len(later):
            continue
        flags[ids[bounds[i] : bounds[i + 1]]] = True
        for j in later.tolist():
            if group[j] == group[i]:
                continue
            both = int(np.count_nonzero(flags[ids[bounds[j] : bounds[j + 1]]]))
            if 100 * both >= percent * (sizes[i] + sizes[j] - both):
                links.append((int(nodes[i]), int(nodes[j])))
                group[group == group[j]] = group[i]
        flags[ids[bounds[i] : bounds[i + 1]]] = False
    return links


def link_classes(
    classes: DataFrame, docs: DataFrame, key: str, text: str, width: int, percent: int, coordinates: int, matches: int
) -> DataFrame:
    """(a, b) links between classes that connect all classes any link connects."""
    forest = candidate_forest(postings(classes, coordinates, matches), coordinates, matches)
    found = settle(components(forest, "a", "b"), "candidates")
    wanted = settle(classes.select("node", "member", "n_shingles").join(found, "node"), "wanted")
    sizes = wanted.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("total"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("int")
    sizes = settle(sizes.select("component", blocks.alias("blocks")), "component-sizes")
    placed = settle(wanted.select("node", "component").join(sizes, "component"), "placed")
    sets = full_sets(docs, key, text, width, wanted).join(placed, "node")
    return confirmed_forest(sets, percent, coordinates, matches)


def near_duplicates(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    width: int = 2,
    percent: int = PERCENT,
    coordinates: int = COORDINATES,
    matches: int = MATCHES,
) -> DataFrame:
    """One row per document: key, n_shingles, component_id, kept.

    A document's set holds its distinct ``width``-word shingles (A-Z lower-cased); documents
    link when their sets' Jaccard similarity reaches ``percent`` / 100. ``component_id`` is
    the least key reachable by links. Texts without words (null, empty, blank) have an empty
    set and stand alone, as does a row with a null key, whose component is null and which is
    kept. Rows that repeat a key are documents of their own under that key. An empty table
    gives no rows; extra columns are ignored.
    """
    out = named_documents(docs, key, text, width, percent, coordinates, matches).withColumn(
        "component_id", F.when(F.col(key).isNotNull(), F.coalesce("own.key", key))
    )
    return out.select(key, "n_shingles", "component_id", F.col(key).eqNullSafe(F.col("component_id")).alias("kept"))


def named_documents(
    docs: DataFrame, key: str, text: str, width: int, percent: int, coordinates: int = COORDINATES, matches: int = MATCHES,
    nameless: bool = False,
) -> DataFrame:
    """One row per document: key, name, n_shingles, node, own: the least (key, name) of its component.

    ``own`` is null for texts without words, and for rows without a key unless ``nameless``
    lets them link; a null key then comes after all others.
    """
    signed = settle(sign_documents(docs, key, text, width, coordinates), "signed")
    able = signed.where(F.col("node").isNotNull() & (F.lit(nameless) | F.col(key).isNotNull()))
    own = F.struct(F.col(key).isNull().alias("absent"), F.col(key).alias("key"), "name")
    classes = settle(
        able.groupBy("node").agg(
            F.min(own).alias("member"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"),
        ),
        "classes",
    )
    links = link_classes(classes, docs, key, text, width, percent, coordinates, matches)
    found = settle(components(links, "a", "b"), "components")
    members = classes.select("node", "member").join(found, "node")
    least = settle(members.groupBy("component").agg(F.min("member").alias("least")), "least-keys")
    linked = settle(found.join(least, "component").select("node", "least"), "linked")
    rows = signed.select(key, "name", "n_shingles", "node")
    named = settle(classes.join(linked, "node", "left").select("node", F.coalesce("least", "member").alias("own")), "named")
    return rows.join(named, "node", "left")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = PERCENT) -> DataFrame:
    """The documents that stay: of each group of near duplicates the row with the least key.

    A null key comes after all others. Texts without words all stay. Rows that repeat a key
    are documents of their own: where they differ in text, the least hash of the text decides
    inside a group; of rows equal in key and text the one with the least further columns
    stays (columns without an order, such as maps, are left out of that). All columns are
    returned, whatever they are called.
    """
    rows = named_documents(docs, key, text, width, percent, nameless=True).where(F.col("own").isNotNull())
    first = F.col(key).eqNullSafe(F.col("own.key")) & (F.col("name") == F.col("own.name"))
    told = rows.groupBy(key, "name").agg(F.count(F.lit(1)).alias("rows"), F.max(first).alias("first"))
    # Only rows with something to decide take part in the join.
    decided = settle(
        told.where((F.col("rows") > 1) | ~F.col("first")).select(
            F.col(key).alias("key"), "name", (~F.col("first")).alias("gone")
        ),
        "decided",
    )
    gone = decided.where("gone")
    repeated = decided.where(~F.col("gone"))
    whole = named_texts(docs, key, text, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    left = whole.join(gone, same_text(gone, "key", "name"), "left_anti")
    if repeated.isEmpty():
        return left.select("row.*")
    ordered = [F.col(f"row.`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"]
    once = left.join(repeated, same_text(repeated, "key", "name"), "left_semi").groupBy("own_key", "own_name").agg(
        F.min_by("row", F.struct(*ordered)).alias("row")
    )
    alone = left.join(repeated, same_text(repeated, "key", "name"), "left_anti")
    return alone.select("row.*").unionByName(once.select("row.*"))
