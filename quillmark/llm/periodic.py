"""Operator 13: runs of repeating words by an online sparse diagonal table.

The table has a diagonal for each lag: at word i, lag p, it holds how many words
up to i equal the word p places before. Only lags at which a word's earlier
occurrences match are held (sparse), words are gone through in order (online),
and a diagonal that ends with sufficient length emits its run at once.

A run of length L with period p has L - p matches on its diagonal, and L has to
be at least ``least`` and 2 p, so a diagonal needs ``max(least - p, p)`` matches
and never fewer than half of ``least``. That is used to open few diagonals:

* earlier occurrences are those of the word with the next words behind it, half
  of ``least`` in all; and only those with another word before them, as
  the others are on a diagonal that is open already;
* a diagonal whose matches don't reach the needed length is not opened; sums over
  the words tell (equal words have equal sums, and what is opened is compared word by word);
* a multiple of a lag whose run begins at the same word and reaches as far is not
  opened either: its run would be the same stretch, and not with its smallest period.

What is left is bounded by the words, however often a word repeats.
"""

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillmark.llm.byte_ids import by_bytes
from quillmark.llm.worker import slices

#: Words: what stands between white space of ASCII, as ``bytes.split`` has it too.
WORD = r"[^\x20\x09-\x0D]+"
LEAST = 12
#: Pairs of occurrences looked at together.
TOGETHER = 1 << 20

BASE = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xD6E8FEB86659FD93)
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


class Diagonals:
    """The open diagonals of some documents, whose words are numbered one behind the other.

    ``ids`` are the words, equal ones with equal numbers; ``bounds`` the documents' ends, after a 0.
    """

    def __init__(self, ids: np.ndarray, bounds: np.ndarray, least: int):
        self.ids, self.least, self.gram = ids, least, max(1, -(-least // 2))
        doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        self.begin, self.end = bounds[:-1][doc], bounds[1:][doc]
        self.powers = np.full(len(ids) + 1, BASE, np.uint64)
        self.powers[:1] = 1
        np.multiply.accumulate(self.powers, out=self.powers)
        mixed = (ids.astype(np.uint64) + np.uint64(1)) * MIX
        mixed ^= mixed >> np.uint64(29)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed * self.powers[:-1], dtype=np.uint64)])
        self.mixed = mixed

    def _occurrences(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places whose next words stand elsewhere in the document too, side by side
        by those words and by the word before; and where each place's like, and its
        like with the same word before, end."""
        n, gram = len(self.ids) - self.gram + 1, self.gram
        none = np.zeros(0, np.int64)
        if n <= 0:
            return none, none, none
        key = self.begin[:n].astype(np.uint64) * BASE
        for k in range(gram):
            key += self.mixed[k : n + k] * self.powers[k]
        key ^= key >> np.uint64(31)
        places = np.flatnonzero(np.arange(n) + gram <= self.end[:n])
        key = key[places]
        order = np.argsort(key, kind="stable")
        key = key[order]
        same = key[1:] == key[:-1]
        often = np.append(same, False) | np.append(False, same) if len(key) else np.zeros(0, bool)
        places, key = places[order][often], key[often]
        if not len(places):
            return none, none, none
        before = np.where(places > self.begin[places], self.ids[places - 1], -1)
        order = np.lexsort((places, before, key))
        places, before, key = places[order], before[order], key[order]
        new = key[1:] != key[:-1]
        ends = [np.append(np.flatnonzero(x) + 1, len(places)) for x in (new, new | (before[1:] != before[:-1]))]
        like, alike = (np.repeat(x, np.diff(x, prepend=0)) for x in ends)
        return places, like, alike

    def opened(self) -> tuple[np.ndarray, np.ndarray]:
        """Diagonals long enough, by sums: where they begin and their lag, in order."""
        places, like, alike = self._occurrences()
        partners = like - alike
        upto = np.cumsum(partners)
        begins, lags = [], []
        at = 0
        while at < len(places):
            done = upto[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(upto, done + TOGETHER, "right")))
            some = np.arange(at, to)
            a = np.repeat(some, partners[at:to])
            b = np.arange(len(a)) - np.repeat(upto[at:to] - partners[at:to] - done, partners[at:to]) + alike[a]
            here, earlier = np.maximum(places[a], places[b]), np.minimum(places[a], places[b])
            lag = here - earlier
            need = np.maximum(self.least - lag, lag)
            room = here + need <= self.end[here]
            here, earlier, lag, need = here[room], earlier[room], lag[room], need[room]
            later = self.sums[here + need] - self.sums[here]
            long = later == (self.sums[earlier + need] - self.sums[earlier]) * self.powers[lag]
            begins.append(here[long])
            lags.append(lag[long])
            at = to
        begin, lag = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (begins, lags))
        order = np.lexsort((lag, begin))
        return begin[order], lag[order]

    def matches(self, here: int, lag: int) -> int:
        """How many words from ``here`` on equal those ``lag`` before, counted in growing blocks."""
        at, block, end = here, 64, int(self.end[here])
        while at < end:
            to = min(at + block, end)
            other = self.ids[at:to] != self.ids[at - lag : to - lag]
            if other.any():
                return at + int(other.argmax()) - here
            at, block = to, 2 * block
        return end - here

    def runs(self) -> np.ndarray:
        """Rows (start, length, smallest period) by start and period; starts are places in ``ids``."""
        found, of_start = [], defaultdict(list)
        for here, lag in zip(*(x.tolist() for x in self.opened())):
            start, need = here - lag, max(self.least - lag, lag)
            if any(lag % period == 0 and end >= here + need for period, end in of_start[start]):
                continue
            length = self.matches(here, lag)
            if length >= need:
                of_start[start].append((lag, here + length))
                found.append((start, length + lag, lag))
        return np.array(sorted((s, p, n) for s, n, p in found), np.int64).reshape(-1, 3)[:, [0, 2, 1]]


def _found(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    for batch in by_bytes(slices(batches, 4096), "text"):
        words = [(x or b"").split() for x in batch.column("text").cast(pa.binary()).to_pylist()]
        bounds = np.cumsum([0, *map(len, words)], dtype=np.int64)
        every = pa.array((x for own in words for x in own), pa.binary())
        ids = every.dictionary_encode().indices.to_numpy().astype(np.int64)
        rows = Diagonals(ids, bounds, least).runs()
        gone = np.zeros(len(ids) + 1, np.int64)
        np.add.at(gone, rows[:, 0] + rows[:, 2], 1)
        np.add.at(gone, rows[:, 0] + rows[:, 1], -1)
        kept = np.cumsum(gone)[:-1] == 0
        first = np.searchsorted(rows[:, 0], bounds)
        rows[:, 0] -= np.repeat(bounds[:-1], np.diff(first))
        collapsed = [b" ".join(own) for own in words]
        for n in np.flatnonzero(np.diff(first)):
            collapsed[n] = b" ".join(x for x, k in zip(words[n], kept[bounds[n] : bounds[n + 1]].tolist()) if k)
        parts = [pa.array(rows[:, k]) for k in range(3)]
        runs = pa.StructArray.from_arrays(parts, fields=list(RUN))
        columns = [
            batch.column("doc_id").cast(pa.int64()),
            pa.array(np.diff(bounds)),
            pa.ListArray.from_arrays(pa.array(first, pa.int32()), runs),
            pa.array(collapsed, pa.binary()).cast(pa.string()),
        ]
        yield pa.record_batch(columns, ["doc_id", "n_words", "runs", "collapsed"])


def periodic_runs(documents: DataFrame, least: int = LEAST) -> DataFrame:
    """All runs of repeating words of each whole text, and the text without the repeats.

    A run is a stretch of words with smallest period q, of at least ``least`` and
    2 q words, that no neighbouring word extends. Returns one row per row of
    ``documents``, which needs doc_id and text: doc_id, n_words, runs (start,
    length, period; by start, then period) and collapsed, the words joined by one
    space but for those that a run has after its first q. Other columns are left
    out. A null or empty text has no words and no runs; repeated rows and ids, null
    ids too, are each answered; a table without rows gives none. No text is cut,
    and a long one is looked at alone. Rows aren't moved.
    """
    kind = "doc_id long, n_words long, runs array<struct<start long, length long, period long>>, collapsed string"
    return documents.select("doc_id", "text").mapInArrow(lambda batches: _found(batches, least), kind)
