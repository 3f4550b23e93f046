"""Operator 3: quality by random-indexing word vectors and a small network.

Every word, known by its 64-bit hash, has a fixed sparse random index vector; its
word vector is the sum of the index vectors of its neighbours over the whole
corpus. A table keeps it for each word of two texts or more; what a word of one
text only would have there is found in that text when it is pooled. A document is
the mean word vector of its words, and of its different words. A two-layer network
gives the score; its temperature is set on labelled rows that it was not trained on.
"""

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.llm import words as w
from quillmark.llm.training import label_sample, remainder
from quillmark.llm.worker import share, slices, texts
from quillmark.session import new_path, passing_shuffles, small_batches
from quillmark.sources.stages import restore, save, stage

WIDTH, ONES, SEED = 64, 4, 11
#: Numbers that stand for how a word is written; others are hashes of words.
SHAPES = 64
WINDOW = 2
#: Words that a task holds before it sends the rare ones on, about 160 bytes each.
HELD = 400_000
#: A word held is sent on once it has occurred more often; no sum is beyond four times that, and two such fit two bytes.
OFTEN = 4000
#: Words of chunks that a task holds before it asks for them.
ASKED = 1_000_000
#: Bytes of texts whose words are found at a time, if no text is longer.
GROUP = 1 << 18
#: Words and shapes, counted each time, of the texts whose vectors a task holds at once, about.
CHUNK = 12_000_000
#: Chunks are worked on in so many rounds at most, of at least so many chunks; only one round's texts and vectors are on disk.
ROUNDS, LEAST_CHUNKS = 4, 3
#: Chunks whose marks share a number.
BLOCK = 62
#: Labelled rows that the network is trained on, at most.
LABELS = 20_000
HIDDEN = 48
#: Rows of sums that are sent at a time, and the most ones a row is sent as.
SENT, FEW = 8192, 40
SUMS = "word long, count long, texts long, sums binary"
SUMS_NAMES = ["word", "count", "texts", "sums"]


def _keys(found: w.Words) -> tuple[np.ndarray, np.ndarray]:
    """For each word its 64-bit hash, and the number of its shape: kind, length, capitals."""
    size = found.end - found.begin
    capitals = found.capitals()
    case = np.where(capitals == 0, 0, np.where(capitals == 1, 1, np.where(capitals * 2 > size, 3, 2)))
    length = np.minimum(np.log2(size).astype(np.int64), 3)
    return found.hashes().view(np.int64), (found.kind.astype(np.int64) * 4 + case) * 4 + length


def _different(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys, and for each key its place among them."""
    found = pa.array(keys).dictionary_encode()
    return found.dictionary.to_numpy(), found.indices.to_numpy().astype(np.int64)


def _merged(keys: np.ndarray, *columns: np.ndarray) -> list[np.ndarray]:
    """Each different key, in order, and the sums of its columns."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])

    def added(column: np.ndarray) -> np.ndarray:
        if not len(first):
            return column
        # each column lies together while it is added up
        return np.add.reduceat(np.ascontiguousarray(column[order].T), first, axis=-1).T

    return [keys[first], *map(added, columns)]


def _packed(sums: np.ndarray) -> pa.Array:
    """Rows of sums as bytes: few ones as their places, with the sign in the highest
    bit; else one byte a number where they fit, else two or eight."""
    size = np.abs(sums)
    ones, most = size.sum(axis=1), size.max(axis=1, initial=0)
    kind = np.select([ones <= FEW, most < 1 << 7, most < 1 << 15], [0, 1, 2], 3)
    sizes = np.choose(kind, [ones, WIDTH, 2 * WIDTH, 8 * WIDTH])
    begin = np.cumsum(sizes) - sizes
    data = np.zeros(int(sizes.sum()), np.uint8)
    row, place = np.nonzero(sums * (kind == 0)[:, None])
    value = sums[row, place]
    units = np.repeat(place + 128 * (value < 0), np.abs(value)).astype(np.uint8)
    few = np.flatnonzero(kind == 0)
    data[np.repeat(begin[few] - (np.cumsum(sizes[few]) - sizes[few]), sizes[few]) + np.arange(len(units))] = units
    for n, number in ((1, "<i1"), (2, "<i2"), (3, "<i8")):
        rows = np.flatnonzero(kind == n)
        raw = sums[rows].astype(number).view(np.uint8)
        data[begin[rows][:, None] + np.arange(raw.shape[1])] = raw
    offsets = np.append(begin, len(data)).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(sums), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _sent(keys: np.ndarray, counts: np.ndarray, many: np.ndarray, sums: np.ndarray, last: bool = False) -> Iterator[pa.RecordBatch]:
    """Rows of sums. At last only their direction counts, and they take a byte a number at most."""
    for at in range(0, len(keys), SENT):
        part = sums[at : at + SENT].astype(np.int64)
        if last and len(part):
            most = np.abs(part).max(axis=1, keepdims=True)
            part = np.where(most < 128, part, np.rint(part * (127 / np.maximum(most, 1))).astype(np.int64))
        numbers = [pa.array(x[at : at + SENT], pa.int64()) for x in (keys, counts, many)]
        yield pa.record_batch([*numbers, _packed(part)], SUMS_NAMES)


def _unpacked(column: pa.Array) -> np.ndarray:
    column = column.cast(pa.large_binary())
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data, sizes = np.frombuffer(column.buffers()[2] or b"", np.uint8), np.diff(bounds)
    sums = np.zeros((len(column), WIDTH), np.int64)
    for number in ("<i1", "<i2", "<i8"):
        rows = np.flatnonzero(sizes == WIDTH * np.dtype(number).itemsize)
        raw = data[bounds[rows][:, None] + np.arange(WIDTH * np.dtype(number).itemsize)]
        sums[rows] = np.ascontiguousarray(raw).view(number)
    few = np.flatnonzero(sizes <= FEW)
    row = np.repeat(few, sizes[few])
    units = data[np.repeat(bounds[few] - (np.cumsum(sizes[few]) - sizes[few]), sizes[few]) + np.arange(len(row))].astype(np.int64)
    ones = np.bincount(row * WIDTH + (units & 127), np.where(units > 127, -1, 1), sums.size)
    return sums + ones.astype(np.int64).reshape(sums.shape)


def _read(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    numbers = (batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names if c != "sums")
    return (*numbers, _unpacked(batch.column("sums")))


def _units(of: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The index vectors of words: for each quarter the place of its one, and its sign."""
    of = of.view(np.uint64)
    for n in range(ONES):
        # the index vector is made of the word's hash: a one in each quarter
        place = ((of >> np.uint64(60 - 4 * n)) & np.uint64(15)).astype(np.int64)
        yield place, ((of >> np.uint64(40 + n)) & np.uint64(1)).astype(np.float64) * 2 - 1


def _sum_up(sums: np.ndarray, to: np.ndarray, of: np.ndarray) -> None:
    """Adds the index vectors of the words ``of`` to the rows ``to``."""
    part = WIDTH // ONES
    for n, (place, sign) in enumerate(_units(of)):
        found = np.bincount(to * part + place, sign, len(sums) * part).astype(np.int32)
        sums[:, n * part : (n + 1) * part] += found.reshape(-1, part)


def _neighbours(at: np.ndarray, own: np.ndarray, shape: np.ndarray, text: np.ndarray, size: int) -> np.ndarray:
    """The sums of the neighbours' index vectors of ``size`` words, and of all shapes after them."""
    part, rows = WIDTH // ONES, size + SHAPES
    sums = np.empty((rows, WIDTH), np.int32)
    same = [(text[apart:] == text[:-apart]).astype(float) for apart in range(1, WINDOW + 1)]
    behind = np.zeros(len(own))  # how many neighbours stand before the word
    for apart, near in enumerate(same, 1):
        behind[apart:] += near
    to, shape_to = at * part, (size + shape) * part
    for n, (place, sign) in enumerate(_units(own)):
        # shapes on either side are given the word on the right
        spots, ones = [shape_to + place], [sign * behind]
        for apart, near in enumerate(same, 1):
            after = sign[apart:] * near
            spots += [to[:-apart] + place[apart:], to[apart:] + place[:-apart], shape_to[:-apart] + place[apart:]]
            ones += [after, sign[:-apart] * near, after]
        found = np.bincount(np.concatenate(spots), np.concatenate(ones), rows * part)
        sums[:, n * part : (n + 1) * part] = found.reshape(-1, part)
    return sums


class _Held:
    """Sums of at most ``HELD`` words, in two bytes a number; ``keys`` are the words in order, ``place`` their rows."""

    def __init__(self) -> None:
        self.size = 0
        self.keys, self.place = np.empty(0, np.int64), np.empty(0, np.int64)
        self.words, self.counts, self.many = (np.zeros(HELD, kind) for kind in (np.int64, np.int16, np.int16))
        self.sums = np.zeros((HELD, WIDTH), np.int16)

    def rows(self, some: np.ndarray) -> Iterator[pa.RecordBatch]:
        """These rows, to be sent."""
        for at in range(0, len(some), SENT):
            part = some[at : at + SENT]
            yield from _sent(self.words[part], self.counts[part], self.many[part], self.sums[part])

    def add(self, words: np.ndarray, counts: np.ndarray, many: np.ndarray, sums: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Adds rows of different words, in order; gives back what is to be sent."""
        if self.size + len(words) > HELD:
            yield from self.leave(HELD // 2)
        held = counts <= OFTEN
        if self.size + len(words) > HELD:
            held[:] = False
        if not held.all():
            yield from _sent(*(x[~held] for x in (words, counts, many, sums)))
            words, counts, many, sums = (x[held] for x in (words, counts, many, sums))
        spot = np.searchsorted(self.keys, words)
        known = np.zeros(len(words), bool)
        if self.size:
            known = self.keys[np.minimum(spot, self.size - 1)] == words
        rows, new = self.place[spot[known]], ~known
        for own, more in ((self.counts, counts), (self.many, many), (self.sums, sums)):
            own[rows] += more[known].astype(np.int16)
        added = np.arange(self.size, self.size + int(new.sum()))
        for own, more in ((self.words, words), (self.counts, counts), (self.many, many), (self.sums, sums)):
            own[self.size : self.size + len(added)] = more[new]
        self.keys, self.place = np.insert(self.keys, spot[new], words[new]), np.insert(self.place, spot[new], added)
        self.size += len(added)
        full = rows[self.counts[rows] > OFTEN]
        yield from self.rows(full)
        self.counts[full], self.many[full], self.sums[full] = 0, 0, 0

    def leave(self, most: int) -> Iterator[pa.RecordBatch]:
        """Keeps the commonest words only, ``most`` at most; the rows of the others are to be sent."""
        counts = self.counts[: self.size]
        if self.size <= most:
            return
        least = np.partition(counts, self.size - most - 1)[self.size - most - 1]
        kept = np.flatnonzero(counts > least)
        yield from self.rows(np.flatnonzero((counts <= least) & (counts > 0)))
        self.size = len(kept)
        for own in (self.words, self.counts, self.many, self.sums):
            own[: self.size] = own[kept]
        self.place = np.argsort(self.words[: self.size])
        self.keys = self.words[self.place]


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per word and shape how often it occurs, in how many texts (of more than one, at
    least two), and the sum of its neighbours' index vectors; a word may come again.

    The commonest words stay in the task; the rare ones are sent on when others need their place.
    """
    held = _Held()
    shapes = np.zeros((SHAPES, WIDTH + 2), np.int64)  # how often, in how many texts, and the sums
    for batch in slices(batches, 256):
        for group in w.parts(texts(batch), GROUP):
            found = w.words(group)
            if not len(found.text):
                continue
            own, shape = _keys(found)
            words, at = _different(own)
            order, rank = np.argsort(words), np.empty(len(words), np.int64)
            rank[order] = np.arange(len(words))
            words, at = words[order], rank[at]
            both, text = np.concatenate([at, len(words) + shape]), np.concatenate([found.text, found.text])
            counts = np.bincount(both, minlength=len(words) + SHAPES)
            first, last = np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64)
            last[both], first[both[::-1]] = text, text[::-1]
            many = np.minimum(counts, 1) + (first != last)
            sums = _neighbours(at, own, shape, found.text, len(words))
            shapes += np.hstack([x[len(words) :].reshape(SHAPES, -1) for x in (counts, many, sums)])
            yield from held.add(words, *(x[: len(words)] for x in (counts, many, sums)))
    yield from held.rows(np.flatnonzero(held.counts[: held.size]))
    own = np.flatnonzero(shapes[:, 0])
    yield from _sent(own, shapes[own, 0], shapes[own, 1], shapes[own, 2:])


def _added(batches: Iterator[pa.RecordBatch], least_texts: int) -> Iterator[pa.RecordBatch]:
    """Sums of rows that are ordered by word, of words of so many texts and of all shapes."""
    last = None

    def kept(rows) -> Iterator[pa.RecordBatch]:
        keys, many = rows[0], rows[2]
        some = (many >= least_texts) | ((keys >= 0) & (keys < SHAPES))
        yield from _sent(*(x[some] for x in rows), last=True)

    for batch in slices(batches, 4096):
        if not batch.num_rows:
            continue
        rows = _read(batch)
        found = _merged(*(np.concatenate(x) for x in zip(last, rows)) if last else rows)
        last = [x[-1:] for x in found]
        yield from kept([x[:-1] for x in found])
    if last:
        yield from kept(last)


def word_sums(documents: DataFrame, least_texts: int = 1) -> DataFrame:
    """word, count, texts and sums of the neighbours' index vectors over all texts, as a
    written table with a row for every shape and every word of so many texts (1 or 2).

    A word that occurs in one text only needs no row: all its neighbours stand in
    that text, where ``pooled`` finds the same sums.
    """
    met = documents.select("text").mapInArrow(_contexts, SUMS)
    added = lambda batches: _added(batches, least_texts)
    return stage(met.repartition("word").sortWithinPartitions("word").mapInArrow(added, SUMS), "words")


def _scales(counts: np.ndarray, sums: np.ndarray, total: int) -> np.ndarray:
    """What sums are multiplied with to make unit vectors of words; rare words weigh more."""
    length = np.sqrt((sums.astype(float) ** 2).sum(axis=1))
    weight = 1e-2 / (1e-2 + counts / max(1, total))
    return (weight / np.maximum(length, 1)).astype(np.float32)


class Table(NamedTuple):
    """Words in order with their vectors: one byte a number, and a scale for each; ``total`` words and shapes in all texts."""

    words: np.ndarray
    sums: np.ndarray
    scales: np.ndarray
    total: int

    @staticmethod
    def of(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], total: int) -> "Table":
        if not parts:
            return Table(np.empty(0, np.int64), np.empty((0, WIDTH), np.int8), np.empty(0, np.float32), total)
        words = np.concatenate([x[0] for x in parts])
        order = np.argsort(words)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        sums, scales, at = np.empty((len(words), WIDTH), np.int8), np.empty(len(words), np.float32), 0
        for own, numbers, scale in parts:
            to = place[at : at + len(own)]
            sums[to], scales[to], at = numbers, scale, at + len(own)
        return Table(words[order], sums, scales, total)


def _marked(held: list[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """The words of chunks, each once with a mark for each of a block's chunks that has it."""
    for block in sorted({n // BLOCK for n, _ in held}):
        own = [(n % BLOCK, x) for n, x in held if n // BLOCK == block]
        word = np.concatenate([x for _, x in own])
        mark = np.concatenate([np.full(len(x), 1 << n, np.int64) for n, x in own])
        order = np.argsort(word)
        word, mark = word[order], mark[order]
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])[: len(word)])
        if len(first):
            columns = (word[first], np.full(len(first), block), np.bitwise_or.reduceat(mark, first))
            yield pa.record_batch([pa.array(x, pa.int64()) for x in columns], ["word", "block", "marks"])


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of the texts of each chunk; a word may come again."""
    held: list[tuple[int, np.ndarray]] = []
    for batch in slices(batches, 1024):
        own, chunk = texts(batch), batch.column("chunk").to_numpy()
        for n in np.unique(chunk).tolist():
            groups = w.parts([own[i] for i in np.flatnonzero(chunk == n)], GROUP)
            held.extend((n, np.unique(np.concatenate(_keys(w.words(g))))) for g in groups)
        if sum(len(x) for _, x in held) > ASKED:
            yield from _marked(held)
            held.clear()
    yield from _marked(held)


def _given(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors for each chunk that asked for them, many in a row: a written batch of words, counts and sums."""
    for batch in batches:
        marks, block = (batch.column(c).to_numpy() for c in ("marks", "block"))
        vectors = batch.select(["word", "count", "sums"])
        for b in np.unique(block).tolist():
            for n in range(BLOCK):
                rows = np.flatnonzero((block == b) & ((marks >> n) & 1 > 0))
                if len(rows):
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, vectors.schema) as out:
                        out.write_batch(vectors.take(pa.array(rows)))
                    chunk = pa.array([b * BLOCK + n], pa.int64())
                    yield pa.record_batch([chunk, pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["chunk", "vectors"])


def looked_up(rows: DataFrame, words: DataFrame, work: Callable, schema) -> DataFrame:
    """What ``work`` makes of batches of rows and of the ``Table`` of their words, as a written table.

    Rows with doc_id and text are dealt into chunks; every chunk gets the vectors
    of its own words, which come before its rows. Chunks are worked on in rounds,
    so that texts and vectors of a part of the chunks only are on their way at a time.
    """
    # each word has one shape
    total = 2 * (words.where(F.col("word").between(0, SHAPES - 1)).agg(F.sum("count")).first()[0] or 0)
    chunks = total // CHUNK + 1
    rounds = max(1, min(ROUNDS, chunks // LEAST_CHUNKS))
    names = rows.columns
    number = F.pmod(F.xxhash64("row.doc_id", "row.text"), F.lit(chunks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, table = None, [], None
        for batch in slices(batches, 4096):
            chunk = batch.column("chunk").to_numpy()
            is_row = batch.column("vectors").is_null().to_numpy(zero_copy_only=False)
            marks = chunk * 2 + is_row
            starts = np.flatnonzero(np.concatenate([[True], marks[1:] != marks[:-1]])[: len(marks)])
            for start, end in zip(starts.tolist(), [*starts[1:].tolist(), len(marks)]):
                part = batch.slice(start, end - start)
                if chunk[start] != now:
                    now, held, table = chunk[start], [], None
                if not is_row[start]:
                    for data in part.column("vectors"):
                        for given in pa.ipc.open_stream(data.as_buffer()):
                            word, count, sums = _read(given)
                            held.append((word, sums.astype(np.int8), _scales(count, sums, total)))
                    continue
                if table is None:
                    table, held = Table.of(held, total), []
                for some in slices([part], 128):
                    yield from work(pa.record_batch(some.column("row").flatten(), names), table)

    path = new_path(rows.sparkSession, "looked_up")
    for n in range(rounds):
        dealt = rows.select(F.struct(*names).alias("row")).withColumn("number", number).where(F.col("number") % rounds == n)
        dealt = dealt.select("row", F.expr(f"number div {rounds}").alias("chunk"))
        asked = dealt.select("chunk", F.col("row.text").alias("text")).mapInArrow(_asked, "word long, block long, marks long")
        asked = asked.repartition("word").groupBy("word", "block").agg(F.bit_or("marks").alias("marks"))
        given = asked.join(words, "word").select("block", "marks", "word", "count", "sums").mapInArrow(_given, "chunk long, vectors binary")
        both = given.unionByName(dealt, allowMissingColumns=True)
        # a chunk's vectors come first
        both = both.repartition("chunk").sortWithinPartitions("chunk", F.col("vectors").isNull())
        save(both.mapInArrow(run, schema), path, append=True)
    return restore(rows.sparkSession, path, schema)


def _alone(found: w.Words, own: np.ndarray, unknown: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of one text only: their text, how often they stand there, and their vectors, from their neighbours there."""
    places = np.flatnonzero(unknown)
    _, first, at, times = np.unique(own[places], return_index=True, return_inverse=True, return_counts=True)
    sums = np.zeros((len(first), WIDTH), np.int32)
    for apart in range(1, WINDOW + 1):
        for beside in (places + apart, places - apart):
            inside = (beside >= 0) & (beside < len(own))
            inside[inside] = found.text[beside[inside]] == found.text[places[inside]]
            _sum_up(sums, at[inside], own[beside[inside]])
    return found.text[places[first]], times, sums * _scales(times, sums, total)[:, None]


def pooled(many: list[str], words: np.ndarray, vectors: np.ndarray, scales: np.ndarray | None = None, total: int = 1) -> np.ndarray:
    """Per text: mean vectors of its words and of its different words, their logarithms of number.

    ``words``, in order, have the vectors, times their scales if given. Other words
    of the texts must be those of one text only, of ``total`` words and shapes in
    all. A text, however long, is counted as a whole.
    """
    rows, size = len(many), max(1, len(words))
    scales = np.ones(len(words), np.float32) if scales is None else scales
    sums, counts = np.zeros((rows, 2 * WIDTH), np.float64), np.zeros((rows, 2))

    def add(keys: np.ndarray, times: np.ndarray) -> None:
        """Texts times the words plus their place, in order, and how often."""
        if len(keys):
            text, word = keys // size, keys % size
            # each number of all vectors lies together while it is added up
            x = np.ascontiguousarray(vectors[word].T) * scales[word]
            starts = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
            at = text[starts]
            sums[at, WIDTH:] += np.add.reduceat(x, starts, axis=1).T
            x *= times.astype(np.float32)
            sums[at, :WIDTH] += np.add.reduceat(x, starts, axis=1).T
            counts[at, 0] += np.add.reduceat(times, starts)
            counts[at, 1] += np.diff(np.append(starts, len(keys)))

    def looked(different: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of some words, which are looked up in order, each once; whether they are known."""
        order = np.argsort(different)
        spots = np.empty(len(different), np.int64)
        spots[order] = np.searchsorted(words, different[order])
        known = words[np.minimum(spots, len(words) - 1)] == different if len(words) else np.zeros(len(different), bool)
        return spots[of], known[of]

    open_keys, open_times = np.empty(0, np.int64), np.empty(0, np.int64)
    for group in w.parts(many, GROUP):
        found = w.words(group)
        own, shape = _keys(found)
        spots, known = zip(looked(*_different(own)), looked(np.arange(SHAPES), shape))
        keys = np.concatenate([found.text[k] * size + x[k] for x, k in zip(spots, known)])
        keys.sort()
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])
        keys, times = keys[starts], np.diff(np.append(starts, len(keys)))
        if len(open_keys):
            keys, times = _merged(np.concatenate([open_keys, keys]), np.concatenate([open_times, times]))
        ended = np.searchsorted(keys, group[-1][0] * size)  # the last text may go on in the next group
        open_keys, open_times = keys[ended:], times[ended:]
        add(keys[:ended], times[:ended])
        if not known[0].all():
            text, times, x = _alone(found, own, ~known[0], total)
            order = np.argsort(text, kind="stable")
            text, times, x = text[order], times[order], np.ascontiguousarray(x[order].T)
            starts = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
            for at, numbers in ((0, x * times), (WIDTH, x)):
                sums[text[starts], at : at + WIDTH] += np.add.reduceat(numbers, starts, axis=1).T
            counts[text[starts]] += np.stack([np.add.reduceat(times, starts), np.diff(np.append(starts, len(text)))], axis=1)
    add(open_keys, open_times)
    means = sums / np.maximum(np.repeat(counts, WIDTH, axis=1), 1)
    return np.hstack([means, np.log1p(counts), np.log1p(counts[:, :1]) - np.log1p(counts[:, 1:])])


@dataclass
class Network:
    """Two layers; inputs are shifted and scaled, the last sum is divided by the temperature."""

    shift: np.ndarray
    scale: np.ndarray
    first: np.ndarray
    first_bias: np.ndarray
    second: np.ndarray
    second_bias: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.tanh((x - self.shift) * self.scale @ self.first + self.first_bias)
        return (hidden @ self.second + self.second_bias) / self.temperature

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -60, 60)))


def _fit(x: np.ndarray, y: np.ndarray, rounds: int = 40, batch: int = 128, rate: float = 3e-3, decay: float = 1e-4) -> Network:
    """Adam on the log loss of shuffled batches, with the same random numbers in every run."""
    rng = np.random.default_rng(SEED)
    shift, scale = x.mean(axis=0), 1 / (x.std(axis=0) + 1e-6)
    z = (x - shift) * scale
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    theta = [rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), np.array(np.log(share / (1 - share)))]
    moments = [[np.zeros_like(t), np.zeros_like(t)] for t in theta]
    step = 0
    for _ in range(rounds if 0 < y.sum() < len(y) else 0):
        order = rng.permutation(len(y))
        for at in range(0, len(y), batch):
            rows = order[at : at + batch]
            hidden = np.tanh(z[rows] @ theta[0] + theta[1])
            logit = hidden @ theta[2] + theta[3]
            error = (1 / (1 + np.exp(-np.clip(logit, -60, 60))) - y[rows]) / len(rows)
            back = error[:, None] * theta[2] * (1 - hidden * hidden)
            slopes = [z[rows].T @ back + decay * theta[0], back.sum(axis=0), hidden.T @ error + decay * theta[2], error.sum()]
            step += 1
            for n, slope in enumerate(slopes):
                mean, square = moments[n]
                mean += 0.1 * (slope - mean)
                square += 0.001 * (slope * slope - square)
                ahead = mean / (1 - 0.9**step) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
                theta[n] = theta[n] - rate * ahead
    return Network(shift, scale, *theta[:3], float(theta[3]))


def _calibrated(network: Network, x: np.ndarray, y: np.ndarray) -> Network:
    """Sets the temperature that makes rows not trained on likeliest."""
    if not len(y):
        return network
    logits = network.logits(x)
    candidates = np.exp(np.linspace(np.log(0.25), np.log(8), 121))
    losses = [np.logaddexp(0, -np.where(y > 0, logits, -logits) / t).mean() for t in candidates]
    network.temperature = float(candidates[int(np.argmin(losses))])
    return network


def train(documents: DataFrame, labels: DataFrame, learn: Column, words: DataFrame, most: int = LABELS) -> Network:
    """Learns from about ``most`` labelled documents at most; every fifth sets the temperature.

    Without any label all scores are 1/2; with labels of one kind all are its share.
    """
    sample = label_sample(labels, "quality", learn, most)

    def run(batch: pa.RecordBatch, table: Table) -> Iterator[pa.RecordBatch]:
        x = pooled(texts(batch), *table).astype("<f4")
        data = pa.array([row.tobytes() for row in x], pa.binary())
        yield pa.record_batch([batch.column("doc_id"), batch.column("label"), data], ["doc_id", "label", "x"])

    known = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")
    known = known.select("doc_id", "label", "text")
    rows = looked_up(known, words, run, "doc_id long, label int, x binary").toArrow()
    size = 2 * WIDTH + 3
    if not rows.num_rows:
        return Network(np.zeros(size), np.ones(size), np.zeros((size, 1)), np.zeros(1), np.zeros(1), 0.0)
    x = np.frombuffer(b"".join(rows["x"].to_pylist()), "<f4").reshape(-1, size).astype(float)
    y, ids = rows["label"].to_numpy().astype(float), rows["doc_id"].to_numpy()
    order = np.lexsort((x[:, 0], ids))
    x, y = x[order], y[order]
    held = np.arange(len(y)) % 5 == 4
    return _calibrated(_fit(x[~held], y[~held]), x[held], y[held])


def score(documents: DataFrame, network: Network, words: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """All columns of the documents, or those given, and ``quality_score``, 0 to 1; a null text scores as an empty one.

    A column of that name is replaced. The result is written, so columns that are
    not needed, such as texts, are better left out.
    """
    shared = share(documents.sparkSession, network)
    names = [c for c in columns or documents.columns if c != "quality_score"]

    def run(batch: pa.RecordBatch, table: Table) -> Iterator[pa.RecordBatch]:
        # rounded, so that equal texts score alike in batches of any size
        found = pa.array(shared().scores(pooled(texts(batch), *table)).round(9), pa.float64())
        yield pa.record_batch([*(batch.column(c) for c in names), found], [*names, "quality_score"])

    schema = documents.select(*names).withColumn("quality_score", F.lit(0.5).cast("double")).schema
    needed = dict.fromkeys([*names, "doc_id", "text"])
    return looked_up(documents.select(*needed), words, run, schema)


def quality(documents: DataFrame, labels: DataFrame, held_out_by: int = 3, held_out: int = 1, columns: list[str] | None = None) -> DataFrame:
    """The documents, or some of their columns, with ``quality_score``: how likely they are of quality 1.

    Word vectors are counted over all documents. Labels are learnt only of ids
    whose crc32 as text, modulo ``held_out_by``, is not ``held_out``.
    """
    spark = documents.sparkSession
    small_batches(spark)
    with passing_shuffles(spark):
        words = word_sums(documents, least_texts=2)
        network = train(documents, labels, remainder("doc_id", held_out_by) != held_out, words)
        return score(documents, network, words, columns)
