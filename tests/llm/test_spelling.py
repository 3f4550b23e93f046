"""Spelling variants against plain Python."""

import random
import re
import zlib
from collections import Counter

import pytest

from quillmark.llm import spelling
from quillmark.llm.queries import QUERIES


def near(words):
    """All pairs that differ by exactly one letter, by the shorter words each can become."""
    rests = {}
    for w in words:
        for k in range(len(w)):
            rests.setdefault((k, w[:k] + w[k + 1 :]), set()).add(w)
    pairs = {(a, b) for same in rests.values() for a in same for b in same if a != b}
    for (_, rest), longer in rests.items():
        if rest in words:
            pairs |= {(a, rest) for a in longer} | {(rest, a) for a in longer}
    return pairs


def grouped(counts, times=5):
    partners = {}
    for a, b in near(set(counts)):
        partners.setdefault(a, []).append(b)
    form = {}
    for w, n in counts.items():
        best = min(partners.get(w, []), key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= times * n else None
    rows = []
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        rows.append((w, form[w], root, n, len(partners.get(w, [])), counts.get(form[w])))
    return sorted(rows, key=repr)


def table(spark, counts):
    return spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)


@pytest.mark.parametrize("letters, most, n", [("ab", 8, 150), ("abé", 5, 200), ("a", 40, 40), ("xyz", 12, 120)])
def test_neighbours_of_all_words(spark, letters, most, n):
    rng = random.Random(n)
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(1, most))) for _ in range(n)}
    got = [tuple(r) for r in spelling.neighbours(table(spark, dict.fromkeys(words, 1))).collect()]
    assert len(got) == len(set(got)) and set(got) == near(words)


def test_neighbours_of_one_word_and_none(spark):
    assert spelling.neighbours(table(spark, {"lonely": 1})).count() == 0
    assert spelling.neighbours(table(spark, {"": 1, "a": 1, "b": 1})).count() == 2
    assert spelling.neighbours(table(spark, {"x": 1}).where("false")).count() == 0


def test_very_long_words(spark):
    long = "".join(random.Random(1).choice("abcdefg") for _ in range(30_000))
    words = {long, long[:-1], long[1:], long[:15_000] + "x" + long[15_001:], long[:7] + "x" + long[7:], "short"}
    got = {tuple(r) for r in spelling.neighbours(table(spark, dict.fromkeys(words, 1))).collect()}
    assert got == near(words)


def test_hashes_that_collide_add_nothing(spark, monkeypatch):
    """Where all prefixes of a direction share a node, all edges hang there; the pairs stay the same."""
    import numpy as np

    monkeypatch.setattr(spelling, "BASE", np.uint64(1))  # words with the same letters share their nodes
    words = {"abcdef", "abcdfe", "abcde", "bacdef", "fedcba", "fedcbx", "abcdeff", "xbcdef"}
    got = {tuple(r) for r in spelling.neighbours(table(spark, dict.fromkeys(words, 1))).collect()}
    assert got == near(words)


def test_forms_and_roots(spark):
    counts = {"tables": 1000, "tabless": 200, "tablesss": 40, "tablessss": 8, "tablezs": 39, "ctables": 200, "other": 7, "othar": 7, "zables": 201}
    got = sorted(map(tuple, spelling.variants(table(spark, counts)).collect()), key=repr)
    assert got == grouped(counts)


def test_ties_take_the_first_word_in_code_point_order(spark):
    counts = {"zzzzzz": 1, "zzzzzé": 5, "zzzzza": 5, "azzzzz": 5, "ÿzzzzz": 5}
    rows = {r.word: r.form for r in spelling.variants(table(spark, counts)).collect()}
    assert rows["zzzzzz"] == "azzzzz"


def test_runs_of_odd_documents(spark, documents, texts):
    got = Counter((r.doc_id, r.run) for r in spelling.runs(documents, 3).collect())
    lower = {c: c.lower() for c in spelling.CAPITALS}
    expected = Counter(
        (d, "".join(lower.get(c, c) for c in run))
        for d, t in texts for run in re.findall("[A-Za-zÀ-ÿ]+", t or "") if len(run) >= 3
    )
    assert got == expected


def test_no_documents_have_no_words(no_documents):
    words = spelling.frequent(spelling.runs(no_documents).withColumnRenamed("run", "word"), 6, 5)
    assert spelling.variants(words).count() == 0


def test_op11_query(spark, sf):
    counts = Counter()
    lower = str.maketrans(spelling.CAPITALS, spelling.CAPITALS.lower())
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        for run in re.findall("[A-Za-zÀ-ÿ]+", r.text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{r.doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    found = QUERIES["op11_spelling"](spark, sf)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, found.collect()), key=repr) == grouped(counts)
