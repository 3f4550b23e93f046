"""Rows that share a key, dealt out in tiles of bounded size and read run by run."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST = 2048


def deal(rows: DataFrame, key: str, by: str, most: int = MOST) -> DataFrame:
    """Rows whose key occurs more than once, with the tiles they belong to.

    A key with more than ``most`` rows is cut into parts by a hash of ``by``; any
    two parts meet in a tile, and each part has one to itself. Adds tile, part,
    and alone, which tells if the tile is the part's own: rows of one part meet
    there, rows of different parts in the tile of both.
    """
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    joined = rows.join(sizes, key)
    parts = F.ceil(F.col("_n") / most)
    joined = joined.withColumn("_parts", parts).withColumn(
        "part", F.pmod(F.xxhash64(by), F.col("_parts")).cast("int")
    )
    others = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1),
        lambda x: F.least("part", x) * F.col("_parts") + F.greatest("part", x),
    )
    tiles = F.when(F.col("_parts") == 1, F.array(F.lit(0).cast("long"))).otherwise(others)
    joined = joined.withColumn("tile", F.explode(tiles))
    alone = F.col("tile") == F.col("part") * (F.col("_parts") + 1)
    return joined.withColumn("alone", alone).drop("_n", "_parts")


def in_runs(dealt: DataFrame, key: str) -> DataFrame:
    """The tiles' rows side by side, each tile in one task."""
    return dealt.repartition(key, "tile").sortWithinPartitions(key, "tile")


def whole_runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole tiles, with the row each row's tile ends before."""

    def ends(table: pa.Table) -> np.ndarray:
        keys, tiles = table[key].to_numpy(), table["tile"].to_numpy()
        new = np.flatnonzero((keys[1:] != keys[:-1]) | (tiles[1:] != tiles[:-1])) + 1
        bounds = np.append(new, len(keys))
        return np.repeat(bounds, np.diff(np.concatenate([[0], bounds])))

    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        if not table.num_rows:
            continue
        end = ends(table)
        cut = int(np.searchsorted(end, table.num_rows))  # where the last tile begins
        if cut:
            yield table.slice(0, cut), end[:cut]
        rest = table.slice(cut)
    if rest is not None and rest.num_rows:
        yield rest, ends(rest)


def pairs(end: np.ndarray, most: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows of one tile, in parts of at most ``most``: nearest neighbours first."""
    left = np.arange(len(end))
    for apart in range(1, len(end)):
        left = left[left + apart < end[left]]
        if not len(left):
            return
        for at in range(0, len(left), most):
            yield left[at : at + most], left[at : at + most] + apart


class Linked:
    """Which rows hang together, as the first row of each group so far."""

    def __init__(self, rows: int):
        self.first = np.arange(rows)

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.first[a] != self.first[b]

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        first = self.first
        while True:
            low = np.minimum(first[a], first[b])
            np.minimum.at(first, first[a], low)
            np.minimum.at(first, first[b], low)
            while (further := first[first] != first).any():
                first[further] = first[first[further]]
            if (first[a] == first[b]).all():
                return
