"""Best-fit packing against the tokenizers library, and its choices against plain Python."""

import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quillmark.llm import best_fit
from quillmark.llm.byte_ids import ByteChunks, by_bytes
from quillmark.llm.queries import QUERIES

BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "", None, " ", "\n", "a  b", "a \n b", "a\n\nb\n", " x", "x ", "don't I'LL 's", "3.14, 2,000!", "a.b.c ... d?!",
    "<|endoftext|>", "a <|endoftext|> b", "a\n<|endoftext|>.", "é, È. ß;", " x  y", "a  b", "a \u0085b", "a 　b",
    "日本語 。 です", "x\x1c y\x1f\nz", "🎉 🎉, ok", "½ ² ³.", "tab\tand\x0bmore \x0c\r\n end", "x" * 70_000, "long words " * 20_000,
]


def ids_of(path, texts):
    found = Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)
    return [[*x.ids, 2] for x in found]


def got_of(path, texts):
    chunks = ByteChunks(path)
    out = []
    for batch in by_bytes(iter([pa.record_batch([pa.array(texts, pa.string())], ["text"])]), "text", 5000):
        flat, sizes = chunks.encode(batch.column("text"), 2)
        out += [x.tolist() for x in np.split(flat, np.cumsum(sizes)[:-1])]
    return out


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_chunks_encode_as_whole_texts(path):
    rng = random.Random(4)
    letters = "ab'dest inEŔéß.,'!  \n\t1²½-_σΣİ日🎉\xa0 \x85:"
    texts = ODD + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(2000)]
    assert got_of(path, texts) == ids_of(path, texts)
    assert ByteChunks(path).by_chunk == (path == BYTES)


def test_chunks_are_forgotten_and_learnt_again(monkeypatch):
    monkeypatch.setattr(ByteChunks, "MOST", 10)
    texts = [f"word{n} and more." for n in range(50)] * 3 + ODD[:-2]
    chunks = ByteChunks(BYTES)
    got = [chunks.encode(pa.array([t], pa.string()), 2)[0].tolist() for t in texts]
    assert got == ids_of(BYTES, texts)


@pytest.mark.parametrize("late", [False, True])
def test_each_choice_makes_the_squares_smallest(late):
    rng = random.Random(6)
    window = 30
    packer, gaps = best_fit.SumOfSquares(window), []
    for n in range(600):
        size = rng.randint(1, window - 1)
        squares = lambda open_gaps: sum(open_gaps.count(g) ** 2 for g in set(open_gaps) - {0})
        choices = []
        for g in sorted(set(gaps) - {0}):
            if g >= size:
                moved = gaps.copy()
                moved[moved.index(g)] = g - size
                choices.append((squares(moved), g, moved))
        if not (late and choices):
            choices.append((squares([*gaps, window - size]), window, [*gaps, window - size]))
        packer.place(size, ((n, 0, 0, size), b""), late)
        gaps = min(choices, key=lambda c: c[:2])[2]
        assert packer.counts.tolist() == [0, *(gaps.count(g) for g in range(1, window)), 0]


def check(pieces, documents, window, path):
    """Whole contract of placed pieces; gives the number of sequences."""
    ids = {}
    for (doc_id, _), own in zip(documents, ids_of(path, [t for _, t in documents])):
        ids.setdefault(doc_id, []).append(own)
    by_doc, by_sequence = {}, {}
    for r in pieces:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(ids)
    for doc_id, rows in by_doc.items():
        expected = []
        for own in ids[doc_id]:
            start, end = 0, (len(own) - 1) % window + 1
            for piece in range(-(-len(own) // window)):
                expected.append((piece, start, end - start, zlib.crc32(np.array(own[start:end], "<u4").tobytes())))
                start, end = end, end + window
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(expected)
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
    return len(by_sequence)


def test_odd_documents_are_packed_whole(spark, documents, texts):
    pieces = best_fit.placed_pieces(best_fit.write_sequences(documents, BYTES, end_id=2)).collect()
    check(pieces, texts, 1024, BYTES)


def test_no_documents_give_no_sequences(spark, no_documents):
    assert best_fit.write_sequences(no_documents, BYTES, end_id=2).count() == 0


def test_groups_of_few_ids_lose_nothing(spark, documents, texts, monkeypatch):
    monkeypatch.setattr(best_fit, "GROUP", 3000)
    pieces = best_fit.placed_pieces(best_fit.write_sequences(documents, BYTES, end_id=2, window=64)).collect()
    check(pieces, texts, 64, BYTES)


def test_pieces_that_never_fill_a_sequence(spark):
    rows = [(n, "a b c d e f") for n in range(300)]  # seven ids each, so one to a sequence of twelve
    documents = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    packed = best_fit.write_sequences(documents, BYTES, end_id=2, window=12)
    assert packed.count() == 300


def test_op12_query(spark, sf):
    pieces = QUERIES["op12_best_fit"](spark, sf).collect()
    documents = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    used = check(pieces, documents, 1024, BYTES)
    least = -(-sum(r.length for r in pieces) // 1024)
    assert used <= 1.02 * least + 1
