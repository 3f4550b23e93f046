"""Operator 4: toxic documents and sentences by multiple-instance learning.

A label tells that some sentence of a document is toxic, not which. A sentence's
probability is that of a linear model of its words and their beginnings; a
document's is the noisy-or of its sentences: that not all of them are clean.
The weights that make the document labels likeliest also find the sentences.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.llm import words as w
from quillmark.llm.training import label_sample, remainder, summed
from quillmark.llm.worker import share, slices, texts

LOG = 18
FEATURES = 1 << LOG
#: Bytes of a word's beginnings that count beside the word itself.
BEGINNINGS = (4, 5, 6, 7, 8, 9)
#: Labelled rows that are learnt from, and features that are weighed, at most.
LABELS, WEIGHED = 20_000, 1 << 12
LEAST_DOCUMENTS, LEAST_SCORE = 4, 6.0
ENDS = np.frombuffer(b".!?\n", np.uint8)


def _features(found: w.Words) -> np.ndarray:
    """Buckets of each letter word: the word, and its beginnings."""
    hashed = [found.hashes()] + [found.hashes(n) + np.uint64(n * int(w.MIX) % (1 << 64)) for n in BEGINNINGS]
    return np.stack([(h >> np.uint64(64 - LOG)).astype(np.int64) for h in hashed], axis=1)


def _sentences(found: w.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each letter word its sentence, and each sentence's text and place in the data."""
    ends = np.concatenate([[0], np.cumsum(np.isin(found.data, ENDS))])
    letters = found.kind == w.LETTER
    numbers = ends[found.begin[letters]]
    first = np.flatnonzero(np.concatenate([[True], numbers[1:] != numbers[:-1]])) if len(numbers) else np.empty(0, int)
    sentence = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(numbers))))
    return letters, sentence, first


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def sentences(self, found: w.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per sentence with letters: text, first and last word's bounds, log odds."""
        letters, _, first = _sentences(found)
        if not len(first):
            return (np.empty(0, np.int64),) * 3 + (np.empty(0),)
        own = self.weights[_features(found)[letters]].sum(axis=1)
        logits = np.add.reduceat(own, first) + self.bias
        last = np.append(first[1:], letters.sum()) - 1
        return found.text[letters][first], found.begin[letters][first], found.end[letters][last], logits


def noisy_or(logits: np.ndarray, owner: np.ndarray, owners: int) -> np.ndarray:
    """1 less the product of the sentences' chances to be clean; 0 without a sentence."""
    return -np.expm1(-np.bincount(owner, np.logaddexp(0, logits), owners))


def _document_counts(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
    """Of clean and of toxic documents, how many have each feature, and how many there are."""
    counts = np.zeros((2, FEATURES + 1), np.int64)
    for batch in slices(batches, 128):
        labels = batch.column("label").to_numpy()
        for n, text in enumerate(texts(batch)):
            seen = [np.unique(_features(found)[found.kind == w.LETTER]) for found in map(w.words, w.parts([text]))]
            label = int(labels[n] > 0)
            counts[label, np.unique(np.concatenate(seen))] += 1
            counts[label, FEATURES] += 1
    return counts


def _chosen(counts: np.ndarray) -> np.ndarray:
    """Features whose share differs between toxic and clean documents far beyond chance."""
    clean, toxic = counts.reshape(2, -1)
    n0, n1 = clean[-1], toxic[-1]
    share = (clean[:-1] + toxic[:-1]) / (n0 + n1)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n0 + 1 / n1))
    score = np.abs(toxic[:-1] / n1 - clean[:-1] / n0) / spread
    score[(clean + toxic)[:-1] < LEAST_DOCUMENTS] = 0
    best = np.argsort(-score, kind="stable")[:WEIGHED]
    return np.sort(best[score[best] >= LEAST_SCORE])


def _fit(features: np.ndarray, sentence: np.ndarray, owner: np.ndarray, y: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, float]:
    """Weights of the chosen features, and the bias, by Adam on the log loss of the noisy-or.

    ``sentence``: of each feature; ``owner``: the document of each sentence.
    """
    size, sentences = max(1, int(features.max(initial=0)) + 1), len(owner)
    share = np.clip(y.mean(), 1e-3, 0.999)
    theta = np.zeros(size + 1)
    theta[-1] = np.log(share / max(1.0, sentences / len(y)))
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        logits = np.bincount(sentence, theta[features], sentences) + theta[-1]
        chance = 1 / (1 + np.exp(-np.clip(logits, -50, 50)))
        whole = np.clip(noisy_or(logits, owner, len(y)), 1e-9, 1)
        slope = np.where(y > 0, 1 - 1 / whole, 1)[owner] * chance / len(y)
        slopes = np.append(np.bincount(features, slope[sentence], size), slope.sum()) + 5e-5 * theta * (np.arange(size + 1) < size)
        mean += 0.1 * (slopes - mean)
        square += 0.02 * (slopes * slopes - square)
        theta -= 0.15 * mean / (1 - 0.9**step) / (np.sqrt(square / (1 - 0.98**step)) + 1e-8)
    return theta[:-1], float(theta[-1])


def train(documents: DataFrame, labels: DataFrame, learn: Column, most: int = LABELS) -> Model:
    """Learns from about ``most`` labelled documents at most.

    Features are chosen by counts over these documents; of their sentences only
    the chosen ones come to the driver. Without labels of both kinds every
    sentence has the same small chance.
    """
    sample = label_sample(labels, "toxic", learn, most)
    known = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")
    known = known.select("doc_id", "label", "text")
    counts = summed(known, _document_counts)
    if not len(counts) or not counts.reshape(2, -1)[:, -1].all():
        return Model(np.zeros(FEATURES), -7.0)
    chosen = _chosen(counts)
    place = np.full(FEATURES, -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    shared = share(documents.sparkSession, place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = shared()
        kinds = ("doc_id", "label", "features", "sentence", "sentences")
        for batch in slices(batches, 128):
            ids, marks = batch.column("doc_id").to_pylist(), batch.column("label").to_pylist()
            rows = []
            for doc_id, label, text in zip(ids, marks, texts(batch)):
                features, sentence, total = [], [], 0
                for found in map(w.words, w.parts([text])):
                    letters, number, first = _sentences(found)
                    spots = place[_features(found)[letters]]
                    row, column = np.nonzero(spots >= 0)
                    features.append(spots[row, column])
                    sentence.append(number[row] + total)
                    total += len(first)
                data = [np.concatenate(x).astype("<i4").tobytes() for x in (features, sentence)]
                rows.append(dict(zip(kinds, (doc_id, label, *data, total))))
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("features", pa.binary()), ("sentence", pa.binary()), ("sentences", pa.int32())]))

    rows = known.mapInArrow(run, "doc_id long, label int, features binary, sentence binary, sentences int").toArrow()
    rows = rows.sort_by([("doc_id", "ascending"), ("features", "ascending")])
    total = rows["sentences"].to_numpy().astype(np.int64)
    before = np.cumsum(total) - total
    features = [np.frombuffer(x, "<i4") for x in rows["features"].to_pylist()]
    sentence = [np.frombuffer(x, "<i4") + b for x, b in zip(rows["sentence"].to_pylist(), before)]
    owner = np.repeat(np.arange(len(total)), total)
    y = (rows["label"].to_numpy() > 0).astype(float)
    found, bias = _fit(np.concatenate(features), np.concatenate(sentence), owner, y)
    weights = np.zeros(FEATURES)
    weights[chosen[: len(found)]] = found
    return Model(weights, bias)


def score(documents: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """All columns, ``toxic_score`` (0 to 1) and ``toxic_sentences``: begin, end, score.

    Sentences end at . ! ? or a line feed. Those of a chance of ``least`` or more
    are listed, in order, by the places of their first and behind their last byte
    in the UTF-8 text. A text without letters scores 0. Columns of these names are replaced.
    """
    shared = share(documents.sparkSession, model)
    names = [c for c in documents.columns if c not in ("toxic_score", "toxic_sentences")]
    spans = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared()
        for batch in slices(batches, 128):
            many = texts(batch)
            clean = np.zeros(len(many))
            listed: list[list[dict]] = [[] for _ in many]
            seen: dict[int, int] = {}
            for group in w.parts(many):
                text, begin, end, logits = model.sentences(w.words(group))
                clean += np.bincount(text, np.logaddexp(0, logits), len(many))
                starts, at = {}, 0
                for n, data in group:
                    starts[n] = seen.get(n, 0) - at
                    seen[n] = seen.get(n, 0) + len(data)
                    at += len(data) + 1
                for n in np.flatnonzero(logits >= np.log(least / (1 - least))).tolist():
                    move = starts[int(text[n])]
                    chance = 1 / (1 + np.exp(-np.clip(logits[n], -50, 50)))
                    listed[text[n]].append({"begin": int(begin[n]) + move, "end": int(end[n]) + move, "score": float(chance)})
            # rounded, so that equal texts score alike in batches of any size
            found = [pa.array((-np.expm1(-clean)).round(9), pa.float64()), pa.array(listed, spans)]
            yield pa.record_batch([*(batch.column(c) for c in names), *found], [*names, "toxic_score", "toxic_sentences"])

    kept_columns = documents.select(*names)
    kind = "array<struct<begin:bigint,end:bigint,score:double>>"
    schema = kept_columns.withColumns({"toxic_score": F.lit(0.5).cast("double"), "toxic_sentences": F.lit(None).cast(kind)}).schema
    return kept_columns.mapInArrow(run, schema)


def toxicity(documents: DataFrame, labels: DataFrame, held_out_by: int = 5, held_out: int = 0) -> DataFrame:
    """The documents with ``toxic_score`` and ``toxic_sentences``.

    Labels are learnt only of ids whose crc32 as text, modulo ``held_out_by``, is
    not ``held_out``.
    """
    learn = remainder("doc_id", held_out_by) != held_out
    return score(documents, train(documents, labels, learn))
