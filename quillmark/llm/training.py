"""What the two classifiers share: a bounded sample of labels, and sums over all tasks."""

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: str, by: int) -> Column:
    """crc32 of an id as text, modulo ``by``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % by


def label_sample(labels: DataFrame, label: str, learn: Column, most: int) -> DataFrame:
    """doc_id and label (0 or 1) of about ``most`` labelled rows at most, to be broadcast.

    A row is in by the hash of its id, so the sample is the same in every run.
    Null ids and labels are left out; of an id's several labels the largest counts.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & learn)
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    share = min(1.0, most / max(1, known.count()))
    return known.where(F.pmod(F.xxhash64("doc_id", F.lit(label)), F.lit(1 << 20)) < int(share * (1 << 20)))


def summed(rows: DataFrame, task: Callable[[Iterator[pa.RecordBatch]], np.ndarray], blocks: int = 32) -> np.ndarray:
    """The sum over all tasks of the int64 array that ``task`` makes of its rows.

    The array has a fixed size; each task sends it in ``blocks`` parts, which are
    added in two steps, so no task reads what all others have sent. Only the sum
    comes to the driver.
    """

    def block(n: int, part: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"block": n, "data": zlib.compress(part.tobytes(), 1)}])

    def numbers(data: bytes) -> np.ndarray:
        return np.frombuffer(zlib.decompress(data), "<i8")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for n, part in enumerate(np.array_split(task(batches).ravel(), blocks)):
            yield block(n, part.astype("<i8"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for row in batch.select(["block", "data"]).to_pylist():
                part = numbers(row["data"])
                sums[row["block"]] = sums[row["block"]] + part if row["block"] in sums else part
        yield from (block(n, part) for n, part in sums.items())

    kind = "block long, data binary"
    counted = rows.mapInArrow(count, kind).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(16)))
    once = counted.repartition("block", "salt").select("block", "data").mapInArrow(add, kind)
    found = {r["block"]: r["data"] for r in once.repartition("block").mapInArrow(add, kind).collect()}
    return np.concatenate([numbers(found[n]) for n in range(blocks)]) if found else np.empty(0, np.int64)
