"""Operator 9: near duplicates among vectors by cross-polytope hashing.

A vector is rotated by three rounds of random signs and a fast Hadamard
transform; its hash is the axis it is nearest to, with the sign. ``functions``
such hashes make a bucket, ``tables`` times, and each vector is also put into the
buckets it nearly fell into. Vectors of one bucket are compared exactly.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.buckets import Linked, deal, in_runs, pairs, whole_runs
from quillmark.llm.components import components
from quillmark.llm.worker import slices
from quillmark.sources.stages import stage

TABLES, FUNCTIONS, SEED = 6, 3, 7


def _hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Hadamard transform of every row; the width is a power of two."""
    rows, width = x.shape
    half = 1
    while half < width:
        x = x.reshape(rows, -1, 2, half)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2)
        half *= 2
        x = x.reshape(rows, width)
    return x


def buckets(x: np.ndarray, tables: int = TABLES, functions: int = FUNCTIONS) -> np.ndarray:
    """Buckets of unit vectors: per table that of the nearest axes, and for each
    function one more with its second nearest axis in place of the first."""
    rows, width = x.shape
    size = 1 << max(1, (width - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, size - width)))
    found = np.empty((rows, tables, 1 + functions), np.int64)
    each = np.arange(rows)
    for table in range(tables):
        best, second = np.empty((2, functions, rows), np.int64)
        for n in range(functions):
            signs = np.random.default_rng([SEED, size, table, n]).integers(0, 2, (3, size)) * 2 - 1
            y = x
            for flip in signs:
                y = _hadamard(y * flip)
            top = np.argpartition(np.abs(y), size - 2, axis=1)[:, size - 2 :]
            height = np.abs(np.take_along_axis(y, top, axis=1))
            first = height.argmax(axis=1)
            for out, which in ((best, first), (second, 1 - first)):
                axis = top[each, which]
                out[n] = axis * 2 + (y[each, axis] < 0)
        for probe in range(1 + functions):
            code = np.full(rows, table, np.int64)
            for n in range(functions):
                code = code * (2 * size) + (second[n] if n == probe - 1 else best[n])
            found[:, table, probe] = code
    return np.sort(found.reshape(rows, -1), axis=1)


def _matrix(column) -> np.ndarray:
    """Rows of a list column, all of one length, as unit vectors in double precision."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def usable(vector: str):
    """Whether a vector can be compared: no null or non-finite component, and not all zero."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    some = F.exists(vector, lambda x: x != 0)
    return F.coalesce(F.forall(vector, finite) & some, F.lit(False))


def _hashed(classes: DataFrame, tables: int, functions: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2048):
            lists = batch.column("embedding")
            sizes = np.diff(lists.offsets.to_numpy())
            for size in np.unique(sizes).tolist():
                rows = pa.array(np.flatnonzero(sizes == size))
                own = batch.take(rows)
                codes = buckets(_matrix(own.column("embedding")), tables, functions)
                bounds = pa.array(np.arange(len(codes) + 1, dtype=np.int32) * codes.shape[1])
                keys = pa.ListArray.from_arrays(bounds, pa.array(codes.ravel()))
                yield pa.record_batch([*own.columns, keys], [*own.schema.names, "keys"])

    return classes.mapInArrow(run, classes.select("*", F.array(F.lit(0).cast("long")).alias("keys")).schema)


def _compared(met: DataFrame, least: float) -> DataFrame:
    """id, links and low (smallest id it hangs on) of vectors that have links in a tile.

    A pair counts in the smallest of the buckets it shares, so once over all tiles.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, end in whole_runs(batches, "key"):
            ids, copies, key, part, sizes = (table[c].to_numpy() for c in ("id", "copies", "key", "part", "size"))
            alone = table["alone"].to_numpy()
            keys = table["keys"].combine_chunks()
            keys = keys.flatten().to_numpy().reshape(len(keys), -1)
            x = np.zeros((len(ids), sizes.max()))
            for size in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == size)
                x[rows, :size] = _matrix(table["embedding"].take(pa.array(rows)))
            links, linked = np.zeros(len(ids), np.int64), Linked(len(ids))
            for a, b in pairs(end, 1 << 14):
                meets = (alone[a] | (part[a] != part[b])) & (sizes[a] == sizes[b])
                a, b = a[meets], b[meets]
                near = np.einsum("ij,ij->i", x[a], x[b]) >= least
                a, b = a[near], b[near]
                if not len(a):
                    continue
                linked.link(a, b)
                first = np.full(len(a), np.iinfo(np.int64).max)
                open_ = np.arange(len(a))
                for n in range(keys.shape[1]):
                    mine = keys[a[open_], n]
                    shared = (keys[b[open_]] == mine[:, None]).any(axis=1)
                    first[open_[shared]] = mine[shared]
                    open_ = open_[~shared]
                    if not len(open_):
                        break
                here = first == key[a]
                np.add.at(links, a[here], copies[b[here]])
                np.add.at(links, b[here], copies[a[here]])
            hung = np.flatnonzero((links > 0) | (linked.first != np.arange(len(ids))))
            if len(hung):
                columns = [pa.array(c) for c in (ids[hung], links[hung], ids[linked.first[hung]])]
                yield pa.record_batch(columns, ["id", "links", "low"])

    return met.mapInArrow(run, "id long, links long, low long")


def near_vectors(
    embeddings: DataFrame, least: float = 0.95, tables: int = TABLES, functions: int = FUNCTIONS
) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector.

    Vectors link if their cosine in double precision is at least ``least`` and
    they meet in a bucket; of the pairs of that cosine nearly all do (measured in
    the tests). Equal vectors are one class, compared once and counted as often
    as they occur. Vectors that are null, empty, zero or hold null or non-finite
    components, and rows without an id, link with nothing and are kept; vectors
    of different length do not link. ``functions`` may grow with the data.
    """
    vectors = embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    sound = F.col("vec_id").isNotNull() & usable("embedding")
    classes = vectors.where(sound).groupBy("embedding").agg(
        F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies")
    )
    hashed = stage(_hashed(classes, tables, functions), "hashed_vectors")
    rows = hashed.select("id", F.size("embedding").alias("size"), F.explode(F.array_distinct("keys")).alias("key"))
    met = deal(rows, "key", "id").join(hashed.select("id", "copies", "embedding", "keys"), "id")
    compared = stage(_compared(in_runs(met, "key"), least), "compared_vectors")
    found = components(compared.select(F.col("id").alias("a"), F.col("low").alias("b")))
    links = compared.groupBy("id").agg(F.sum("links").alias("links"))
    done = hashed.select("id", "copies", "embedding").join(links, "id", "left")
    done = done.join(found.withColumnRenamed("node", "id"), "id", "left").select(
        "embedding",
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component", "id").alias("component_id"),
    )
    alone = F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")
    joined = vectors.where(sound).join(done, "embedding")
    joined = joined.select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    return joined.unionByName(vectors.where(~sound).select("vec_id", *alone))
