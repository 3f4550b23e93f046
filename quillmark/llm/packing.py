"""Operator 2: shortest-pack-first packing over the length histogram.

Only lengths meet on the driver: the histogram has a count for each length up
to the window, whatever the number of documents. Patterns are planned there and
joined back to the pieces by their rank among pieces of the same length.
"""

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmark.llm.tokens import IDS, encoded
from quillmark.llm.worker import slices
from quillmark.session import new_path
from quillmark.sources.stages import restore, stage

WINDOW = 4096
#: Ids below 65,536 take two bytes on their way to a sequence.
NARROW = np.dtype("<u2")
#: Rows of counts (a length in a task) that are sent to all executors, about 160 bytes each; more are joined by a shuffle.
COUNTS = 500_000

PIECE = "doc_id long, start long, length long, doc_tokens long, ids binary"
NUMBERED_NAMES = ("doc_id", "start", "length", "doc_tokens", "ids", "within")


def _cut(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    names = NUMBERED_NAMES[:-1]
    for batch in batches:
        rows = []
        for doc_id, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist()):
            total = len(ids or b"") // 4
            for at in range(0, total, window):
                end = min(at + window, total)
                rows.append((doc_id, at, end - at, total, ids[4 * at : 4 * end]))
        columns = zip(*rows) if rows else [()] * 5
        yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def _kept_small(df: DataFrame, name: str) -> DataFrame:
    """``stage`` for tables of ids, which take much less room so."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return restore(df.sparkSession, path, df.schema)


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds ``within``, the rank among the task's pieces of the same length; ids get two bytes where they fit."""
    met: dict[int, int] = {}
    for batch in batches:
        within, short = [], []
        for length, raw in zip(batch.column("length").to_pylist(), batch.column("ids").to_pylist()):
            within.append(met.get(length, 0))
            met[length] = within[-1] + 1
            ids = np.frombuffer(raw, IDS)
            short.append(raw if ids.max() >> 16 else ids.astype(NARROW).tobytes())
        columns = [batch.column(c) for c in ("doc_id", "start", "length", "doc_tokens")]
        yield pa.record_batch([*columns, pa.array(short, pa.binary()), pa.array(within, pa.int64())], NUMBERED_NAMES)


def number_texts(documents: DataFrame, tokenizer: str, end_id: int, window: int = WINDOW) -> DataFrame:
    """Pieces of at most ``window`` ids: doc_id, start, length, doc_tokens, ids, part and within, as a written table.

    Encoded as by ``tokens.encode_texts``, cut and ranked in one Python step: ``part``
    is the task, ``within`` the rank among its pieces of a length. A document longer
    than the window fills as many windows as it can, and what is left is one more
    piece; others stay whole. A null or empty text is the end id alone; repeated
    rows and null ids have pieces each, and an empty table has none.
    """
    run = lambda batches: _numbered(_cut(encoded(batches, tokenizer, end_id), window))
    cut = documents.select("doc_id", "text").mapInArrow(run, f"{PIECE}, within long")
    return _kept_small(cut.withColumn("part", F.spark_partition_id()), "pieces")


def patterns(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[tuple[int, ...], int]]:
    """Packing patterns and how many sequences use each.

    Lengths are placed longest first, each into the packs that are shortest so
    far, all packs of one pattern at once; a length too long for the shortest
    pack opens new packs. A length splits at most one pattern and opens at most
    one, so there are at most two patterns per length, whatever the counts.
    """
    packs: list[tuple[int, tuple[int, ...], int]] = []
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if packs and packs[0][0] + length <= window:
                fill, pattern, count = heapq.heappop(packs)
                used = min(left, count)
                if used < count:
                    heapq.heappush(packs, (fill, pattern, count - used))
                heapq.heappush(packs, (fill + length, (*pattern, length), used))
                left -= used
                continue
            # one new pack at a time takes as many of this length as it has room for
            room = window // length
            full, rest = divmod(left, room)
            for size, count in ((room, full), (rest, 1)):
                if size and count:
                    heapq.heappush(packs, (size * length, (length,) * size, count))
            left = 0
    return sorted((pattern, count) for _, pattern, count in packs)[::-1]


def slots(packs: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, rank_from, rank_to, sequence_from, offset) that place every rank of every length."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, count in packs:
        offset = 0
        for length in pattern:
            rank = taken.get(length, 0)
            taken[length] = rank + count
            rows.append((length, rank, rank + count, sequence, offset))
            offset += length
        sequence += count
    return rows


def _before(dealt: DataFrame) -> DataFrame:
    """Per length and part its count, and how many pieces of that length the parts before it have."""
    counts = dealt.groupBy("length", "part").count()
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0)))


def _in_blocks(rows: list[tuple]) -> tuple[list[tuple], list[tuple]]:
    """The rows of ``slots``, one for each block of ranks they reach into, with the block
    behind the length; and each length's ranks per block.

    Blocks are as wide as the length's slots are on average. So there are at most
    twice as many rows, and a rank is held against about two of them on average,
    however many slots its length has and however uneven they are.
    """
    of_length: dict[int, list[tuple]] = {}
    for row in rows:
        of_length.setdefault(row[0], []).append(row)
    widths = {length: -(-max(r[2] for r in own) // len(own)) for length, own in of_length.items()}
    cut = [
        (length, block, first, end, *rest)
        for length, first, end, *rest in rows
        for block in range(first // widths[length], (end - 1) // widths[length] + 1)
    ]
    return cut, [*widths.items()]


def _placed(numbered: DataFrame, histogram: DataFrame, window: int) -> DataFrame:
    """Pieces with a rank by their length, with sequence_id and offset; histogram: length and count.

    Sequences are numbered from 0 and filled from offset 0 without gaps.
    """
    spark = numbered.sparkSession
    counts = {r["length"]: r["count"] for r in histogram.collect()}
    rows, widths = _in_blocks(slots(patterns(counts, window)))
    # at most two patterns per length and a window of slots per pattern: bounded, not by the data
    kinds = "length long, block long, rank_from long, rank_to long, sequence_from long, offset long"
    plan = F.broadcast(spark.createDataFrame(rows, kinds))
    wide = numbered.join(F.broadcast(spark.createDataFrame(widths, "length long, width long")), "length")
    wide = wide.withColumn("block", F.expr("rank div width"))
    here = (wide["length"] == plan["length"]) & (wide["block"] == plan["block"])
    here = here & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to"))
    placed = wide.join(plan, here).drop(plan["length"], plan["block"])
    sequence = F.col("sequence_from") + F.col("rank") - F.col("rank_from")
    return placed.withColumn("sequence_id", sequence).drop("rank", "width", "block", "rank_from", "rank_to", "sequence_from")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sequences of listed pieces: their ids one behind the other, each again of four bytes."""
    for batch in slices(batches, 256):
        ids = []
        for pieces in batch.column("listed").to_pylist():
            kinds = (IDS if len(x["ids"]) == 4 * x["length"] else NARROW for x in pieces)
            ids.append(b"".join(np.frombuffer(x["ids"], kind).astype(IDS).tobytes() for x, kind in zip(pieces, kinds)))
        names = ["sequence_id", "n_tokens", "pieces"]
        yield pa.record_batch([*(batch.column(c) for c in names), pa.array(ids, pa.binary())], [*names, "ids"])


def sequences(packed: DataFrame) -> DataFrame:
    """The packed ids themselves: sequence_id, n_tokens, pieces, ids (binary, unpadded).

    ``pieces`` lists what a sequence is made of, by offset: offset, length, doc_id, start, doc_tokens.
    """
    piece = F.sort_array(F.collect_list(F.struct("offset", "length", "doc_id", "start", "doc_tokens", "ids")))
    grouped = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), piece.alias("all"))
    bare = F.transform("all", lambda x: x.dropFields("ids")).alias("pieces")
    listed = F.transform("all", lambda x: F.struct(x["length"].alias("length"), x["ids"].alias("ids"))).alias("listed")
    grouped = grouped.select("sequence_id", "n_tokens", bare, listed)
    return grouped.mapInArrow(_joined, grouped.drop("listed").schema.add("ids", "binary"))


def placed_pieces(packed: DataFrame) -> DataFrame:
    """The pieces of written ``sequences``, each with its ids as they stand there.

    doc_id, start, length, ids, ids_crc32, doc_tokens, sequence_id, offset; length
    and checksum are of the ids found between a piece's offset and the next one's.
    """
    ends = F.transform("pieces", lambda x, n: F.coalesce(F.get("pieces", n + 1)["offset"], F.octet_length("ids") / 4).cast("int"))
    spots = F.explode(F.arrays_zip(F.col("pieces").alias("piece"), ends.alias("end")))
    found = packed.select("sequence_id", F.col("ids").alias("all"), spots.alias("spot"))
    found = found.select("sequence_id", "all", "spot.piece.*", "spot.end")
    first, size = (F.col("offset") * 4 + 1).cast("int"), ((F.col("end") - F.col("offset")) * 4).cast("int")
    found = found.withColumn("ids", F.substring("all", first, size))
    length = (F.octet_length("ids") / 4).cast("long").alias("length")
    return found.select("doc_id", "start", length, "ids", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def write_sequences(documents: DataFrame, tokenizer: str, end_id: int, window: int = WINDOW) -> DataFrame:
    """``sequences`` of all texts, encoded and cut, as a written table.

    Pieces are numbered by the counts of the tasks that cut them, so their ids
    are moved once, to their sequence; twice if there are too many counts. Null
    and empty texts, repeated rows and null ids are packed like others, texts of
    any length are cut, other columns are left out, and an empty table has no sequence.
    """
    pieces = number_texts(documents, tokenizer, end_id, window)
    counts = stage(_before(pieces), "counts")
    before = counts.drop("count").hint("broadcast" if counts.count() <= COUNTS else "merge")
    rank = (F.col("before") + F.col("within")).alias("rank")
    columns = ["doc_id", "start", "length", "doc_tokens", "ids"]
    numbered = pieces.join(before, ["length", "part"]).select(*columns, rank)
    histogram = counts.groupBy("length").agg(F.sum("count").alias("count"))
    return _kept_small(sequences(_placed(numbered, histogram, window)), "sequences")
