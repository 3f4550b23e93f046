"""Operator 6: near duplicates by SimHash, with pivot distance tables.

Two fingerprints within a distance r differ in their distance to any third, a
pivot, by at most r. Each different fingerprint's distances to many pivots are
computed once and written down; they are its coordinates. Pivots alone would have
all pairs looked at, so pairs meet only where they must agree: of ``blocks`` parts
of the bits at most r differ, so some ``blocks - r`` parts are equal, and each
choice of them is a key. The rows of a key are sorted by the coordinate that
spreads them most, and a row is paired only with those up to r further on; a pair
is discarded if any other coordinate differs by more, and only survivors are
compared bit by bit.
"""

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.llm.buckets import Linked, deal, in_runs, pairs, whole_runs
from quillmark.llm.components import components
from quillmark.llm.worker import slices, texts
from quillmark.sources.stages import stage

BITS = 64
SEED = 42
#: Fingerprints a key may have by chance before more blocks are taken.
CROWD = 256


def fingerprint(text: str, words: int = 4) -> int:
    """SimHash of a text, as a signed 64-bit integer.

    A-Z are lower-cased; words are what stands between ASCII white space. Every
    occurrence of ``words`` words in a row counts, joined by one space, or the
    whole text if it has fewer; a text without words has fingerprint 0. A bit is
    set if it is in more than half of the shingles' XXH64 values.
    """
    import xxhash

    own = text.encode().lower().split()
    if not own:
        return 0
    ends = np.cumsum([len(w) + 1 for w in own]) - 1
    n = max(1, len(own) - words + 1)
    starts = np.concatenate([[0], ends[: n - 1] + 1]).tolist()
    ends = ends[-n:].tolist()
    joined, hashed = b" ".join(own), xxhash.xxh64_intdigest
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 15):
        part = zip(starts[at : at + (1 << 15)], ends[at : at + (1 << 15)])
        values = np.array([hashed(joined[a:b], SEED) for a, b in part], "<u8")
        bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    packed = np.packbits(counts * 2 > n, bitorder="little")
    return int(packed.view("<i8")[0])


def fingerprints(documents: DataFrame, words: int = 4) -> DataFrame:
    """doc_id, row (a hash of the text) and fp of every whole text; null is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            found = pa.array([fingerprint(text, words) for text in texts(batch)], pa.int64())
            yield pa.record_batch([batch.column("doc_id"), batch.column("row"), found], ["doc_id", "row", "fp"])

    whole = documents.select(F.col("doc_id").cast("long").alias("doc_id"), _row(documents["text"]).alias("row"), "text")
    return whole.mapInArrow(run, "doc_id long, row long, fp long")


def _row(text) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _masks(bits: int, blocks: int) -> list[int]:
    """For each choice of ``blocks - bits`` of the blocks, the bits in them, as a signed integer."""
    edges = [BITS * n // blocks for n in range(blocks + 1)]
    whole = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    masks = [sum(choice) for choice in combinations(whole, blocks - bits)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def _blocks(classes: int, bits: int) -> int:
    """So many blocks that a key has a few hundred fingerprints of different groups at most."""
    blocks = bits + 2
    while classes >> (BITS * (blocks - bits) // blocks) > CROWD and blocks < 2 * bits:
        blocks += 1
    return blocks


def with_distances(classes: DataFrame, pivots: int = 24) -> DataFrame:
    """The table with the Hamming distances of ``fp`` to fixed pivots, eight in a long each."""
    drawn = np.random.default_rng(SEED).integers(-1 << 63, (1 << 63) - 1, pivots, np.int64, endpoint=True)
    far = [F.bit_count(F.col("fp").bitwiseXOR(F.lit(p))) for p in drawn.tolist()]
    eights = [far[n : n + 8] for n in range(0, pivots, 8)]
    packed = [sum((F.shiftleft(d.cast("long"), 8 * n) for n, d in enumerate(e)), F.lit(0).cast("long")) for e in eights]
    return classes.withColumns({f"pivots_{n}": column for n, column in enumerate(packed)})


def _windows(end: np.ndarray, distances: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of the rows, tile by tile, and there the row each row's partners end before.

    A tile is sorted by the pivot whose distances vary most in it.
    """
    begin = np.concatenate([[0], np.flatnonzero(end[1:] != end[:-1]) + 1])
    size = np.diff(np.append(begin, len(end)))
    far = distances.astype(np.int64)
    spread = np.add.reduceat(far * far, begin) * size[:, None] - np.add.reduceat(far, begin) ** 2
    tile = np.repeat(np.arange(len(begin)), size)
    own = far[np.arange(len(end)), np.repeat(spread.argmax(axis=1), size)] + tile * (4 * BITS)
    order = np.argsort(own, kind="stable")
    return order, np.searchsorted(own[order], own[order] + bits, "right")


def links(classes: DataFrame, bits: int = 4, blocks: int = 6) -> DataFrame:
    """Links a, b between ids of near fingerprints (id, fp, distances): enough to hold each group together.

    Rows of a null id are left out. Any two fingerprints that differ in at most
    ``bits`` bits are compared, in each tile of the keys they share; of a dense
    tile only the links that join what was apart are given, at most one per row.
    More blocks make more and rarer keys, and the same links.
    """
    masks = _masks(bits, blocks)
    keys = F.array(*(F.xxhash64(F.lit(n), F.col("fp").bitwiseAND(F.lit(m))) for n, m in enumerate(masks)))
    coordinates = [c for c in classes.columns if c.startswith("pivots_")]
    keyed = classes.where("id IS NOT NULL").select("id", "fp", *coordinates, F.explode(keys).alias("key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, end in whole_runs(batches, "key"):
            distances = np.stack([table[c].to_numpy() for c in coordinates], axis=1).view(np.int8)
            order, end = _windows(end, distances, bits)
            ids, fps = table["id"].to_numpy()[order], table["fp"].to_numpy().view(np.uint64)[order]
            distances = distances[order]
            linked = Linked(len(ids))
            for a, b in pairs(end):
                new = linked.apart(a, b)
                a, b = a[new], b[new]
                near = np.abs(distances[a] - distances[b]).max(axis=1, initial=0) <= bits
                a, b = a[near], b[near]
                near = np.bitwise_count(fps[a] ^ fps[b]) <= bits
                if near.any():
                    linked.link(a[near], b[near])
            hung = np.flatnonzero(linked.first != np.arange(len(ids)))
            if len(hung):
                yield pa.record_batch([pa.array(ids[hung]), pa.array(ids[linked.first[hung]])], ["a", "b"])

    return in_runs(deal(keyed, "key", "fp"), "key").mapInArrow(run, "a long, b long")


def near_duplicates(documents: DataFrame, words: int = 4, bits: int = 4) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id reachable by links), row of every document.

    Equal fingerprints, that of all texts without words included, are one class
    and searched once. Rows without an id keep their fingerprint and get the
    component of others with it, or null; repeated rows each keep their row.
    An empty table gives an empty one; other columns, whatever they are called, are
    left out. ``row`` is a hash of the text.
    """
    prints = stage(fingerprints(documents, words), "fingerprints")
    classes = stage(with_distances(prints.groupBy("fp").agg(F.min("doc_id").alias("id"))), "classes")
    found = components(links(classes, bits, _blocks(classes.count(), bits)))
    placed = classes.join(found, classes["id"] == found["node"], "left")
    placed = placed.select(F.col("fp"), F.coalesce("component", "id").alias("component_id"))
    return prints.join(placed, "fp").select("doc_id", "fp", "component_id", "row")


def without_near_duplicates(documents: DataFrame, words: int = 4, bits: int = 4) -> DataFrame:
    """One document of each group of ``near_duplicates``, with all its columns.

    The one of the smallest id stays; of several rows of that id, one. Rows
    without an id are only grouped by equal fingerprints, and stay behind others.
    """
    found = near_duplicates(documents, words, bits)
    alone = F.when(F.col("component_id").isNull(), F.col("fp"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "row")).alias("first")
    kept = found.groupBy("component_id", alone.alias("alone")).agg(first)
    kept = kept.select(F.col("first.doc_id").alias("__doc"), F.col("first.row").alias("__row")).distinct()
    same = documents["doc_id"].eqNullSafe(kept["__doc"]) & (_row(documents["text"]) == kept["__row"])
    return documents.join(kept, same).dropDuplicates(["__doc", "__row"]).select(*documents.columns)
