"""Token files, packing and byte-level BPE against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from quillmark.llm import byte_bpe, packing, pfor, token_files
from quillmark.llm.queries import QUERIES
from quillmark.llm.tokens import ChunkEncoder
from quillmark.session import new_path

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")


def ids_of(path, texts):
    return [x.ids for x in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def some_texts(n=400):
    rng = random.Random(3)
    letters = "abcdeth inEŔéß.,'!  \n\t1²½-_σΣİ日🎉\xa0"
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("values", [
    [], [5], [0, 2**32 - 1] * 700, [7] * 1024, [0] * 1000 + [2**31] * 48, list(range(3000)),
    np.random.default_rng(1).integers(0, 2**32, 5000).tolist(),
])
def test_blocks_give_back_what_was_packed(values):
    values = np.array(values, "<u4")
    blocks = pfor.encode(values)
    starts = np.cumsum([0, *map(len, blocks)])[:-1]
    assert (pfor.decode(b"".join(blocks), starts) == values).all()


def test_outliers_do_not_widen_a_block():
    few = np.array([*range(1000), *[2**31] * 24], "<u4")
    assert len(pfor.encode(few)[0]) < 1024 * 10 // 8 + 24 * 6 + 20


def test_chunks_encode_as_whole_texts():
    texts = some_texts() + ["AB!! cd.. e.f <|endoftext|>x ..", "a\x1cb", "ΑΣ. Σ", "I'LL DON'T", "²x x² x1."]
    got = [np.frombuffer(x, "<u4").tolist() for x in ChunkEncoder(WORDS).encode(texts)]
    assert got == ids_of(WORDS, texts)


def test_new_words_of_small_letters_go_straight_to_the_model():
    rng = random.Random(7)
    letters = [x for x in map(chr, range(256)) if x.isalpha() and x.islower()]
    words = ["".join(rng.choices(letters if n % 2 else "etaoins", k=rng.randint(1, 12))) for n in range(2000)]
    encoder = ChunkEncoder(WORDS)
    encoder.known.update({x: encoder.whole(x) for x in (".", ",", "?!")})
    encoder.library = encoder.known.library = None  # nothing else is to be encoded as a text
    texts = [" ".join(words), *words[:200], *(f"{w}, {w}?!\nAE{w}." for w in words[200:300])]
    got = [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)]
    assert got == ids_of(WORDS, texts)


def test_words_are_encoded_alike_when_some_are_forgotten(monkeypatch):
    monkeypatch.setattr(ChunkEncoder, "MOST", 50)
    encoder, texts = ChunkEncoder(WORDS), [f"W\xf6rter{n}, stra\xdfe \xc9t\xe9{chr(97 + n % 26)} don't #{n}!" for n in range(300)]
    got = [np.frombuffer(x, "<u4").tolist() for x in (y for at in range(0, 300, 20) for y in encoder.encode(texts[at : at + 20]))]
    assert got == ids_of(WORDS, texts)


def test_added_tokens_in_capitals_are_plain_text():
    """The library looks for them before it lower-cases; only the exact spelling is a control token."""
    marks = ["<|ENDOFTEXT|>", "<|EndOfText|>", "<|STARTOFTEXT|>", "<|startOfText|>", "<|endoftext|>", "<|startoftext|>"]
    texts = [f for m in marks for f in (m, f"A Word{m}, and {m}.", f"{m}{m} <|endoftext|> \xc9mile", f"{m} \u65e5")]
    got = [np.frombuffer(x, "<u4").tolist() for x in ChunkEncoder(WORDS).encode(texts)]
    assert got == ids_of(WORDS, texts)
    assert 49407 not in got[0] and 49407 in got[16]


def test_token_files_hold_all_ids_in_order(spark, documents, texts):
    manifest = token_files.write_tokens(documents, new_path(spark, "t"), WORDS, end_id=1)
    rows = token_files.read_tokens(manifest).collect()
    ordered = sorted(texts, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    expected, at = [], 0
    for (doc_id, _), ids in zip(ordered, ids_of(WORDS, [t for _, t in ordered])):
        raw = np.array([*ids, 1], "<u4").tobytes()
        expected.append((doc_id, at, len(ids) + 1, raw))
        at += len(ids) + 1
    got = sorted(((r["doc_id"], r["start"], r["n_tokens"], bytes(r["ids"])) for r in rows), key=lambda r: r[1])
    assert got == expected


def test_files_of_no_documents(spark, no_documents):
    manifest = token_files.write_tokens(no_documents, new_path(spark, "t"), WORDS, end_id=1)
    assert token_files.read_tokens(manifest).count() == 0


def test_only_files_of_the_manifest_are_read(spark, documents):
    """A task that was run twice leaves a file that nothing names."""
    folder = new_path(spark, "t")
    first = token_files.write_tokens(documents, folder, WORDS, end_id=1)
    token_files.write_tokens(documents, folder, WORDS, end_id=1)
    assert token_files.read_tokens(first).count() == documents.count()


def test_op1_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    at, expected = 0, []
    for row, ids in zip(docs, ids_of(WORDS, [r["text"] for r in docs])):
        raw = np.array([*ids, 1], "<u4")
        expected.append((row["doc_id"], at, len(raw), zlib.crc32(raw.tobytes())))
        at += len(raw)
    assert sorted(map(tuple, QUERIES["op1_token_files"](spark, sf).collect())) == expected


def check_packing(rows, ids, window=packing.WINDOW):
    """Every id once, in its place; sequences gapless and not too long."""
    found = {}
    for r in rows:
        found.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
    for doc_id, pieces in found.items():
        at = 0
        for start, length, crc, total in sorted(pieces):
            own = np.array(ids[doc_id][start : start + length], "<u4")
            assert (start, total, crc) == (at, len(ids[doc_id]), zlib.crc32(own.tobytes()))
            at += length
        assert at == len(ids[doc_id])
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= window
    return sequences


def test_op2_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    ids = {r["doc_id"]: [*x, 2] for r, x in zip(docs, ids_of(WORDS, [r["text"] for r in docs]))}
    rows = QUERIES["op2_packing"](spark, sf).collect()
    assert {r["doc_id"] for r in rows} == set(ids)
    sequences = check_packing(rows, ids)
    total = sum(map(len, ids.values()))
    assert len(sequences) * packing.WINDOW - total <= 0.02 * total + packing.WINDOW


def test_packing_of_odd_documents(spark, documents, no_documents, texts):
    unique = documents.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    ids = dict(zip([d for d, _ in texts], [[*x, 2] for x in ids_of(WORDS, [t for _, t in texts])]))
    packed = lambda df, **more: packing.placed_pieces(packing.write_sequences(df, WORDS, 2, **more))
    check_packing(packed(unique).collect(), ids)
    rows = packed(documents).collect()
    whole = [r["doc_tokens"] for r in rows if r["start"] == 0]
    assert len(whole) == documents.count() and sum(r["doc_id"] is None for r in rows) == 2
    assert sum(r["length"] for r in rows) == sum(whole)
    assert packed(no_documents).count() == 0
    short = packed(unique, window=64).collect()
    assert max(r["length"] for r in short) == 64
    check_packing(short, ids, window=64)


def test_sequences_hold_the_ids(spark, documents):
    rows = packing.write_sequences(documents.where("doc_id < 8"), WORDS, 2, window=512).collect()
    total = sum(x["length"] for r in rows for x in r["pieces"])
    assert sum(len(r["ids"]) // 4 for r in rows) == total
    assert all(len(r["ids"]) == 4 * r["n_tokens"] <= 4 * 512 for r in rows)


def test_every_rank_has_one_slot_and_is_held_against_few():
    rng = random.Random(8)
    for histogram in ({1: 10**6, **{n: rng.randint(1, 50) for n in range(2, 4000)}}, {n: rng.choice([1, 10**5]) for n in range(1, 900)}):
        rows = packing.slots(packing.patterns(histogram))
        cut, widths = packing._in_blocks(rows)
        widths = dict(widths)
        assert set(widths) == set(histogram) and len(cut) <= 2 * len(rows)
        held = {}
        for length, block, first, end, *_ in cut:
            assert first < (block + 1) * widths[length] and end > block * widths[length]
            held[length] = held.get(length, 0) + widths[length]
        assert all(held[n] <= 2 * count + 2 * widths[n] for n, count in histogram.items())
        for length in rng.sample(sorted(histogram), 50):
            for rank in {0, histogram[length] - 1, rng.randrange(histogram[length])}:
                block = rank // widths[length]
                assert sum(r[:2] == (length, block) and r[2] <= rank < r[3] for r in cut) == 1


@pytest.mark.parametrize("most", [packing.COUNTS, 0])
def test_digests_come_from_written_sequences(spark, documents, sf, monkeypatch, most):
    """Ids altered in the written sequences show in op2's rows, and the pipeline's last stage keeps the ids."""
    monkeypatch.setattr(packing, "COUNTS", most)
    some = documents.where("doc_id < 9")
    found = corpus_pipeline.pack(spark, some, sf).collect()
    whole = {}
    for r in sorted(found, key=lambda r: r["start"]):
        raw = bytes(r["ids"])
        assert (len(raw) // 4, zlib.crc32(raw)) == (r["length"], r["ids_crc32"])
        whole.setdefault((r["doc_id"], r["doc_tokens"]), []).append(raw)
    kept = {(r["doc_id"], r["text"]) for r in some.collect()}
    texts = sorted(kept, key=repr)
    for (doc_id, _), ids in zip(texts, ids_of(WORDS, [t for _, t in texts])):
        copies = sum(r["doc_id"] == doc_id for r in some.select("doc_id").collect())
        assert b"".join(whole[doc_id, len(ids) + 1]) == np.array([*ids, 2], "<u4").tobytes() * copies
    write = packing.write_sequences
    zeroed = F.expr("unhex(repeat('00', octet_length(ids)))")
    monkeypatch.setattr(packing, "write_sequences", lambda *a, **b: write(*a, **b).withColumn("ids", zeroed))
    rows = QUERIES["op2_packing"](spark, sf).collect()
    assert rows and all(r["ids_crc32"] == zlib.crc32(bytes(4 * r["length"])) for r in rows)


def test_patterns_place_all_lengths_and_stay_few():
    rng = random.Random(5)
    histogram = {n: rng.randint(1, 10**6) for n in rng.sample(range(1, 4097), 900)}
    packs = packing.patterns(histogram)
    placed = {}
    for pattern, count in packs:
        assert sum(pattern) <= 4096
        for n in pattern:
            placed[n] = placed.get(n, 0) + count
    assert placed == histogram
    assert len(packs) <= 3 * len(histogram)


def test_op7_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    own = Tokenizer.from_file(BYTES)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    expected = {
        (r["doc_id"], len(ids), sha(",".join(map(str, ids))), sha(own.decode(ids, skip_special_tokens=False)))
        for r, ids in zip(docs, ids_of(BYTES, [r["text"] for r in docs]))
    }
    assert {tuple(r) for r in QUERIES["op7_byte_bpe"](spark, sf).collect()} == expected


def test_byte_bpe_is_the_library(spark, documents, no_documents):
    odd = spark.createDataFrame([(n, t) for n, t in enumerate(some_texts())], "doc_id long, text string")
    for table in (odd, documents.select("doc_id", "text")):
        rows = table.collect()
        expected = sorted(((r["doc_id"], x) for r, x in zip(rows, ids_of(BYTES, [r["text"] for r in rows]))), key=repr)
        tokens = byte_bpe.encode(table, BYTES)
        assert sorted(((r["doc_id"], r["ids"]) for r in tokens.collect()), key=repr) == expected
        back = sorted(((r["doc_id"], r["decoded"]) for r in byte_bpe.decode(tokens, BYTES).collect()), key=repr)
        assert back == sorted(((r["doc_id"], r["text"] or "") for r in rows), key=repr)
    assert byte_bpe.encode(no_documents, BYTES).count() == 0


def test_decode_keeps_columns_and_replaces_broken_bytes(spark):
    emoji = ids_of(BYTES, ["🎉"])[0]
    rows = spark.createDataFrame([(1, emoji[:1], "a"), (2, None, "b"), (3, [], "c")], "doc_id long, ids array<int>, decoded string")
    got = {r["doc_id"]: r["decoded"] for r in byte_bpe.decode(rows.withColumn("more", F.lit(1)), BYTES).collect()}
    assert got == {1: Tokenizer.from_file(BYTES).decode(emoji[:1], skip_special_tokens=False), 2: "", 3: ""}
