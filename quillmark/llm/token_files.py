"""Operator 1: token ids of whole texts as files of patched frame-of-reference blocks.

A file holds the documents of one range of doc_id, in ascending order:
blocks (see ``pfor``), then an index: the place of every block u8, per document
its id i8, the place of its first id u8 and a u1 that is 0 for a null id; then a
tail of six u8: blocks, documents, ids, place of the index, block size, mark.
"""

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmark.llm import pfor
from quillmark.llm.tokens import IDS, encoded
from quillmark.sources.stages import stage

MARK = 0x314B4F54524F4650
#: Ids held in memory at once by the writer and the reader.
HELD = 1 << 19


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


class _Writer:
    def __init__(self, path: str):
        system, place = _open(path)
        system.create_dir(place.rpartition("/")[0], recursive=True)
        self.out = system.open_output_stream(place)
        self.place, self.ids, self.held = 0, 0, 0
        self.waiting: list[bytes] = []
        self.blocks, self.docs = [], []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append((doc_id or 0, self.ids, doc_id is not None))
        self.waiting.append(ids)
        self.ids += len(ids) // IDS.itemsize
        self.held += len(ids) // IDS.itemsize
        if self.held >= HELD:
            self.flush(self.held - self.held % pfor.BLOCK)

    def flush(self, n: int) -> None:
        values = np.frombuffer(b"".join(self.waiting), IDS)
        for block in pfor.encode(values[:n]):
            self.blocks.append(self.place)
            self.out.write(block)
            self.place += len(block)
        self.waiting, self.held = [values[n:].tobytes()], len(values) - n

    def close(self) -> None:
        self.flush(self.held)
        docs = np.array(self.docs, [("id", "<i8"), ("at", "<u8"), ("known", "u1")])
        for part in (np.array(self.blocks, "<u8"), *(docs[x] for x in docs.dtype.names)):
            self.out.write(part.tobytes())
        tail = [len(self.blocks), len(docs), self.ids, self.place, pfor.BLOCK, MARK]
        self.out.write(np.array(tail, "<u8").tobytes())
        self.out.close()


def write_tokens(documents: DataFrame, folder: str, tokenizer: str, end_id: int) -> DataFrame:
    """Encode all texts and write them to ``folder`` in ascending doc_id order.

    Returns the manifest, one row per file: file_no (ascending as the ids are),
    path, n_docs, n_ids. Only files of the manifest count: a task that was lost
    or run twice leaves a file that the manifest does not name. Null ids come
    first, rows of one id are ordered by text, a null text is empty, and a table
    without rows has no file. Texts are shuffled once, by ranges of doc_id.
    """
    ordered = documents.select("doc_id", "text").repartitionByRange("doc_id")
    ordered = ordered.sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = None
        for batch in encoded(batches, tokenizer, end_id):
            if writer is None and batch.num_rows:
                part = TaskContext.get().partitionId()
                path = f"{folder}/tokens-{part:06d}-{uuid.uuid4().hex}.pfor"
                writer = _Writer(path)
            for doc_id, ids in zip(*(c.to_pylist() for c in batch.columns)):
                writer.add(doc_id, ids)
        if writer:
            writer.close()
            row = {"file_no": part, "path": path, "n_docs": len(writer.docs), "n_ids": writer.ids}
            yield pa.RecordBatch.from_pylist([row])

    files = ordered.mapInArrow(run, "file_no long, path string, n_docs long, n_ids long")
    return stage(files, "token_files")


def _documents(path: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of documents: ids, known, starts and ends, and the token ids of the run."""
    system, place = _open(path)
    with system.open_input_file(place) as file:
        read = lambda at, n, kind: np.frombuffer(file.read_at(n * np.dtype(kind).itemsize, at), kind)
        size = file.size()
        n_blocks, n_docs, n_ids, index, block, mark = read(size - 48, 6, "<u8").tolist()
        if (block, mark) != (pfor.BLOCK, MARK):
            raise ValueError(f"not a token file: {path}")
        blocks = np.append(read(index, n_blocks, "<u8"), index).astype(np.int64)
        index += 8 * n_blocks
        docs = read(index, n_docs, "<i8")
        bounds = np.append(read(index + 8 * n_docs, n_docs, "<u8"), n_ids).astype(np.int64)
        known = read(index + 16 * n_docs, n_docs, "u1")
        at = 0
        while at < n_docs:
            to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + HELD, "right")) - 1)
            first, last = bounds[at] // block, -(-bounds[to] // block)
            data = file.read_at(int(blocks[last] - blocks[first]), int(blocks[first]))
            ids = pfor.decode(data, blocks[first:last] - blocks[first])
            yield docs[at:to], known[at:to], bounds[at : to + 1], ids[bounds[at] - first * block :]
            at = to


def read_tokens(manifest: DataFrame) -> DataFrame:
    """Every document of the files: doc_id, start, n_tokens, ids.

    ``start`` counts the ids of all documents before it, in the order of the
    files; ``ids`` is binary, little-endian unsigned 32-bit integers. One task
    reads one file, a bounded run of documents at a time.
    """
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("before", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    files = max(1, manifest.count())
    placed = placed.select("file_no", "path", "before").repartitionByRange(files, "file_no")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                for docs, known, bounds, ids in _documents(row["path"]):
                    own = (bounds - bounds[0]).tolist()
                    raw = memoryview(ids.astype(IDS).tobytes())
                    yield pa.record_batch(
                        [
                            pa.array(docs, pa.int64(), mask=known == 0),
                            pa.array(bounds[:-1] + row["before"], pa.int64()),
                            pa.array(np.diff(bounds), pa.int64()),
                            pa.array([bytes(raw[4 * a : 4 * b]) for a, b in zip(own, own[1:])], pa.binary()),
                        ],
                        ["doc_id", "start", "n_tokens", "ids"],
                    )

    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")
