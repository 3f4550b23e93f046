"""Operator 12: best-fit packing by sums of squares.

A document goes into the open sequence whose choice makes the sum, over all
gaps, of the squared number of open sequences with that gap smallest. That keeps
open sequences of every gap at hand, so that nearly all get filled to the end.

Each task packs the documents it reads, longest first, and writes the sequences
it has filled, so their ids are never shuffled. Those still open at the end are
few; their pieces alone are dealt anew, in groups of bounded size, and packed
again by the same rule, now with a new sequence only where no open one has room.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.byte_ids import IDS, by_bytes, byte_chunks
from quillmark.llm.worker import slices
from quillmark.session import new_path
from quillmark.sources.stages import restore

WINDOW = 1024
#: Ids of pieces shorter than the window that are packed together, four bytes each.
GROUP = 4_000_000

PIECE = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64())])
ROW = "sequence_id long, filled boolean, n_tokens long, pieces array<struct<doc_id long, piece int, start long, length long>>, ids binary"
Piece = tuple[tuple, bytes]


class SumOfSquares:
    """Open sequences by their gap, and the choice among them."""

    NONE = 1 << 40

    def __init__(self, window: int):
        self.window = window
        #: Open sequences of each gap. A full sequence is not open, so gap 0 has none; a new one has the whole window as gap.
        self.counts = np.zeros(window + 1, np.int64)
        self.empty = np.full(window + 1, self.NONE)
        self.empty[window] = 0
        self.open: list[list[list[Piece]]] = [[] for _ in range(window + 1)]

    def gap_for(self, size: int, late: bool) -> int:
        """The gap whose choice makes the squared counts smallest; of equal ones the
        smallest gap. Late, a new sequence is the last choice."""
        # a sequence moved from gap g to g - size changes the sum by 2 (n[g - size] - n[g]) + 2
        change = self.counts[: self.window + 1 - size] - self.counts[size:]
        change *= 2
        change += self.empty[size:]
        change[0] -= 1  # a sequence filled to the end counts nowhere any more
        change[-1] += self.NONE // 2 if late else -1  # a new one counted nowhere before
        return size + int(change.argmin())

    def place(self, size: int, piece: Piece, late: bool = False) -> list[Piece] | None:
        """Puts a piece into a sequence, which is returned if it is full then."""
        gap = self.gap_for(size, late)
        if gap < self.window:
            sequence = self.open[gap].pop()
            self.counts[gap] -= 1
            if not self.counts[gap]:
                self.empty[gap] = self.NONE
        else:
            sequence = []
        sequence.append(piece)
        rest = gap - size
        if not rest:
            return sequence
        self.open[rest].append(sequence)
        self.counts[rest] += 1
        self.empty[rest] = 0
        return None

    def close(self) -> list[list[Piece]]:
        """All open sequences, which are open no longer."""
        left = [x for same in self.open for x in same]
        self.__init__(self.window)
        return left


def _pack(pieces: Iterator[list[Piece]], window: int, late: bool) -> Iterator[pa.RecordBatch]:
    """Sequences as rows, in batches; those not filled are marked, unless this is the late packing."""
    number = (TaskContext.get().partitionId() << 33) + int(late)

    def rows(done: list[list[Piece]], filled: bool) -> Iterator[pa.RecordBatch]:
        nonlocal number
        for at in range(0, len(done), 1024):
            some = done[at : at + 1024]
            ids = [b"".join(x[1] for x in one) for one in some]
            columns = [
                pa.array(range(number, number + 2 * len(some), 2), pa.int64()),
                pa.array([filled or late] * len(some), pa.bool_()),
                pa.array([len(x) // IDS.itemsize for x in ids], pa.int64()),
                pa.array([[x[0] for x in one] for one in some], pa.list_(PIECE)),
                pa.array(ids, pa.binary()),
            ]
            number += 2 * len(some)
            yield pa.record_batch(columns, ["sequence_id", "filled", "n_tokens", "pieces", "ids"])

    def packed(group: list[Piece]) -> Iterator[pa.RecordBatch]:
        group.sort(key=lambda x: -x[0][3])  # stable, so a task that runs again does the same
        packer = SumOfSquares(window)
        full = [done for x in group if (done := packer.place(x[0][3], x, late))]
        yield from rows(full, True)
        yield from rows(packer.close(), False)

    group, held = [], 0
    for some in pieces:
        yield from rows([[x] for x in some if x[0][3] == window], True)
        for x in some:
            if x[0][3] < window:
                group.append(x)
                held += x[0][3]
            if held >= GROUP:
                yield from packed(group)
                group, held = [], 0
    yield from packed(group)


def _cut(batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int, window: int) -> Iterator[list[Piece]]:
    """Pieces of the texts: whole, or the rest first and then as many whole windows as there are."""
    chunks = byte_chunks(tokenizer)
    for batch in by_bytes(slices(batches, 4096), "text"):
        flat, sizes = chunks.encode(batch.column("text"), end_id)
        raw, at, some = memoryview(flat.tobytes()), 0, []
        for doc_id, size in zip(batch.column("doc_id").to_pylist(), sizes.tolist()):
            start, end = 0, (size - 1) % window + 1
            for piece in range(-(-size // window)):
                some.append(((doc_id, piece, start, end - start), raw[4 * (at + start) : 4 * (at + end)].tobytes()))
                start, end = end, end + window
            at += size
        yield some


def _again(batches: Iterator[pa.RecordBatch]) -> Iterator[list[Piece]]:
    """The pieces of written sequences."""
    for batch in slices(batches, 1024):
        some = []
        for pieces, ids in zip(batch.column("pieces").to_pylist(), batch.column("ids").to_pylist()):
            at = 0
            for x in pieces:
                end = at + IDS.itemsize * x["length"]
                some.append(((x["doc_id"], x["piece"], x["start"], x["length"]), ids[at:end]))
                at = end
        yield some


def _written(rows: DataFrame, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    path = new_path(rows.sparkSession, name)
    rows.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    return restore(rows.sparkSession, path, rows.schema)


def write_sequences(documents: DataFrame, tokenizer: str, end_id: int, window: int = WINDOW) -> DataFrame:
    """Packs whole texts into sequences of at most ``window`` ids and writes them.

    ``documents`` needs doc_id and text; other columns are left out. A text's ids
    are the library's, with ``end_id`` behind; null is empty and so has that id
    alone. A text of at most ``window`` ids stays whole. A longer one is cut into
    pieces of ``window`` ids, of which the first may be shorter; piece numbers and
    ``start`` count from 0. Repeated rows and ids, null ids too, are packed each;
    a table without rows gives none.

    Returns sequence_id (unique, with holes), n_tokens, pieces (doc_id, piece,
    start, length, in their order) and ids (binary, little-endian unsigned 32-bit,
    unpadded).
    """
    first = lambda batches: _pack(_cut(batches, tokenizer, end_id, window), window, False)
    once = _written(documents.select("doc_id", "text").mapInArrow(first, ROW), "sequences", ("filled",))
    still_open = once.where(~F.col("filled"))
    tokens = still_open.agg(F.sum("n_tokens")).first()[0] or 0
    again = lambda batches: _pack(_again(batches), window, True)
    # each open sequence has a number of its own, so no document's repeats meet in one group
    dealt = still_open.repartition(max(1, -(-tokens // GROUP)), "sequence_id")
    twice = _written(dealt.mapInArrow(again, ROW), "refilled_sequences")
    return once.where("filled").unionByName(twice).drop("filled")


def placed_pieces(packed: DataFrame) -> DataFrame:
    """The pieces of ``write_sequences``, each with its ids as they stand there:
    doc_id, piece, start, length, ids, ids_crc32, sequence_id, offset."""
    before = F.transform(
        "pieces", lambda x, n: F.aggregate(F.slice("pieces", 1, n), F.lit(0).cast("long"), lambda s, y: s + y["length"])
    )
    spots = F.explode(F.arrays_zip(F.col("pieces").alias("piece"), before.alias("offset")))
    found = packed.select("sequence_id", F.col("ids").alias("all"), spots.alias("spot"))
    found = found.select("sequence_id", "all", "spot.piece.*", "spot.offset")
    first, size = (F.col("offset") * 4 + 1).cast("int"), (F.col("length") * 4).cast("int")
    found = found.withColumn("ids", F.substring("all", first, size))
    length = (F.octet_length("ids") / 4).cast("long").alias("length")
    return found.select("doc_id", "piece", "start", length, "ids", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")
