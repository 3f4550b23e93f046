"""Runs of repeating words against their definition."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from quillmark.llm import periodic
from quillmark.llm.queries import QUERIES


def brute(words, least):
    """All runs by their definition: (start, length, smallest period)."""
    found = set()
    for p in range(1, len(words)):
        i = p
        while i < len(words):
            j = i
            while j < len(words) and words[j] == words[j - p]:
                j += 1
            start, length = i - p, j - i + p
            if j > i and length >= max(least, 2 * p):
                if not any(all(words[k] == words[k - q] for k in range(start + q, j)) for q in range(1, p)):
                    found.add((start, length, p))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {k for s, n, p in runs for k in range(s + p, s + n)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


@pytest.mark.parametrize("least", [1, 2, 5, 12, 13, 20])
def test_diagonals_find_what_the_definition_says(least):
    rng = random.Random(least)
    for _ in range(250):
        docs = []
        for _ in range(rng.randint(1, 4)):
            n, letters = rng.randint(0, 60), rng.randint(1, 3)
            words = [rng.randint(1, letters) for _ in range(n)]
            if n and rng.random() < 0.5:
                a = rng.randrange(n)
                p = 1 + (n - a) // (3 + rng.randint(0, 7))
                words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            docs.append(words)
        bounds = np.cumsum([0, *map(len, docs)])
        got = periodic.Diagonals(np.array(sum(docs, []), np.int64), bounds, least).runs().tolist()
        assert got == [[s + b, n, p] for b, words in zip(bounds.tolist(), docs) for s, n, p in brute(words, least)]


def test_sums_that_collide_open_nothing(monkeypatch):
    """Where all sums are equal, words are still compared one by one."""
    monkeypatch.setattr(periodic, "MIX", np.uint64(0))
    rng = random.Random(5)
    for _ in range(100):
        words = [rng.randint(1, 2) for _ in range(40)]
        got = periodic.Diagonals(np.array(words, np.int64), np.array([0, 40]), 12).runs()
        assert [tuple(x) for x in got.tolist()] == brute(words, 12)


@pytest.mark.parametrize("words, runs", [
    (np.ones(500_000, np.int64), [[0, 500_000, 1]]),
    (np.tile(np.arange(7), 50_000), [[0, 350_000, 7]]),
])
def test_endless_repeats_open_few_diagonals(words, runs):
    assert periodic.Diagonals(words, np.array([0, len(words)]), 12).runs().tolist() == runs


def test_runs_of_odd_documents(spark, documents, texts):
    got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic.periodic_runs(documents).collect()), key=repr)
    expected = []
    for doc_id, text in texts:
        words = [w.decode() for w in (text or "").encode().split()]
        runs = brute(words, 12) if len(words) < 5000 else [(0, len(words), 6)]
        expected.append((doc_id, len(words), runs, collapsed(words, runs)))
    assert got == sorted(expected, key=repr)


def test_no_documents_have_no_runs(no_documents):
    assert periodic.periodic_runs(no_documents).count() == 0


def test_op13_query(spark, sf):
    got = {r.doc_id: r for r in QUERIES["op13_periodic_runs"](spark, sf).collect()}
    documents = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(documents)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for r in documents:
        words = [w.decode() for w in (r.text or "").encode().split()]
        n, h = len(words), zlib.crc32(str(r.doc_id).encode())
        if n > 1500:
            continue
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = brute(words, 12)
        s, n, p = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else (None, None, None)
        listed = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
        mine = got[r.doc_id]
        assert tuple(mine)[1:] == (len(runs), s, n, p, runs and 1000 * n // p or None, sha(listed), sha(collapsed(words, runs)))
