"""SimHash, line and vector duplicates and binary search against brute force."""

import random
import re
import tracemalloc

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from quillmark.llm import binary_search, buckets, lines, near_vectors, simhash
from quillmark.llm.components import components
from quillmark.llm.oracles import ORACLES
from quillmark.llm.queries import QUERIES


def groups(n, pairs):
    """The smallest member of each member's group."""
    least = list(range(n))

    def find(x):
        while least[x] != x:
            x = least[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        least[b] = a
    return [find(x) for x in range(n)]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_gives_what_its_sql_gives(spark, sf, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    theirs = con.execute(ORACLES[name])
    order = [c[0] for c in theirs.description]
    ours = QUERIES[name](spark, sf)
    assert sorted(ours.columns) == sorted(order)
    assert sorted(map(tuple, ours.select(*order).collect()), key=repr) == sorted(theirs.fetchall(), key=repr)


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(n, n + 1) for n in range(300, 360)]
    links = spark.createDataFrame([*pairs, (5, 5), (None, 4), (4, None)], "a long, b long")
    found = {r["node"]: r["component"] for r in components(links).collect()}
    assert [found.get(n, n) for n in range(361)] == groups(361, pairs)
    assert components(links.where("false")).count() == 0


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_op6_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    prints = [plain_fingerprint(r["text"]) for r in docs]
    p = np.array(prints, np.uint64)
    a, b = np.nonzero(np.triu(np.bitwise_count(p[:, None] ^ p) <= 4, 1))
    least = groups(len(docs), zip(a.tolist(), b.tolist()))
    expected = {(r["doc_id"], f"{f:016x}", docs[c]["doc_id"]) for r, f, c in zip(docs, prints, least)}
    assert {tuple(r) for r in QUERIES["op6_simhash"](spark, sf).collect()} == expected


def test_fingerprints_of_odd_texts(spark, documents, no_documents, texts):
    rows = simhash.fingerprints(documents).collect()
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    expected = sorted(((d, signed(plain_fingerprint(t))) for d, t in texts), key=repr)
    assert sorted(((r["doc_id"], r["fp"]) for r in rows), key=repr) == expected
    assert simhash.near_duplicates(no_documents).count() == 0


def test_one_document_of_each_group_stays(spark, documents, no_documents):
    kept = simhash.without_near_duplicates(documents)
    assert kept.columns == documents.columns
    ids = sorted((r["doc_id"] for r in kept.select("doc_id").collect()), key=repr)
    # 3 and 7 are copies, 4, 5 and 9 have no words as one of those without an id; the other has words
    assert ids == sorted([1, 2, 3, 4, 8, -6, None], key=repr)
    assert simhash.without_near_duplicates(no_documents).count() == 0


@pytest.mark.parametrize("blocks", [6, 8])
def test_links_of_random_and_dense_fingerprints(spark, monkeypatch, blocks):
    """Chains of near prints, a dense group beyond one tile, and prints at distance 4 and 5."""
    monkeypatch.setattr(buckets, "MOST", 64)
    monkeypatch.setattr(buckets.deal, "__defaults__", (64,))
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 40, np.uint64)
    flips = lambda x, n: x ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, n, replace=False)))
    prints = [*base, *(flips(x, 4) for x in base), *(flips(x, 5) for x in base), *(flips(base[0], 2) for _ in range(500))]
    p = np.unique(np.array(prints, np.uint64))
    rows = [(n, int(v)) for n, v in enumerate(p.view(np.int64))]
    classes = simhash.with_distances(spark.createDataFrame(rows, "id long, fp long"))
    links = simhash.links(classes, blocks=blocks).collect()
    a, b = np.nonzero(np.triu(np.bitwise_count(p[:, None] ^ p) <= 4, 1))
    assert groups(len(p), [(r["a"], r["b"]) for r in links]) == groups(len(p), zip(a.tolist(), b.tolist()))


def test_pivot_distances_are_written_down(spark):
    prints = np.random.default_rng(5).integers(-1 << 63, 1 << 62, 50)
    rows = simhash.with_distances(spark.createDataFrame([(int(f),) for f in prints], "fp long"), pivots=24).collect()
    drawn = np.random.default_rng(simhash.SEED).integers(-1 << 63, (1 << 63) - 1, 24, np.int64, endpoint=True)
    for r in rows:
        found = np.array([r[f"pivots_{n}"] for n in range(3)]).view(np.int8)
        assert found.tolist() == np.bitwise_count((np.int64(r["fp"]) ^ drawn).view(np.uint64)).tolist()


def test_a_row_is_paired_only_within_the_window_of_a_pivot():
    """No near pair is lost, and far fewer pairs are looked at than the tiles have."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 600, np.uint64)
    near = base ^ (np.uint64(1) << rng.integers(0, 64, 600).astype(np.uint64))
    tile = np.sort(rng.integers(0, 4, 1200))
    end = np.searchsorted(tile, tile, "right")
    fps = rng.permutation(np.concatenate([base, near]))
    drawn = rng.integers(0, 1 << 63, 24, np.uint64)
    distances = np.bitwise_count(fps[:, None] ^ drawn).astype(np.int8)
    order, windows = simhash._windows(end, distances, 4)
    assert (tile[order] == tile).all() and (windows <= end).all()
    looked, survive, found = 0, 0, set()
    for a, b in buckets.pairs(windows):
        looked += len(a)
        a, b = order[a], order[b]
        kept = np.abs(distances[a] - distances[b]).max(axis=1) <= 4
        survive += int(kept.sum())
        hit = kept & (np.bitwise_count(fps[a] ^ fps[b]) <= 4)
        found |= {(min(x, y), max(x, y)) for x, y in zip(a[hit].tolist(), b[hit].tolist())}
    a, b = np.nonzero(np.triu((np.bitwise_count(fps[:, None] ^ fps) <= 4) & (tile[:, None] == tile), 1))
    assert found == set(zip(a.tolist(), b.tolist()))
    every = int((end - np.arange(1200) - 1).sum())
    assert looked < 0.6 * every and survive < 0.01 * every


def test_more_fingerprints_have_more_blocks():
    assert [simhash._blocks(n, 4) for n in (0, 10**6, 10**9, 10**10, 10**11, 10**15)] == [6, 6, 7, 7, 8, 8]
    assert simhash._blocks(10**12, 0) == 2


# Lines


def near(a, b):
    """Whether one word put in, taken out or replaced makes two rows of words equal."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > 1 or a == b:
        return False
    for n in range(len(a)):
        rest = a[:n] + a[n + 1 :]
        if rest == b or len(a) == len(b) and rest == b[:n] + b[n + 1 :]:
            return True
    return False


def plain_lines(docs, least_words=10):
    places = sorted(
        ((d is not None, d or 0), n, tuple(w for w in re.split(r"[ \t\n\x0b\f\r]+", line) if w))
        for d, t in docs
        for n, line in enumerate((t or "").split("\n"))
    )
    result = {}
    for i, (d, n, words) in enumerate(places):
        first = None
        for e, m, other in places[:i]:
            if words and (words == other or max(len(words), len(other)) >= least_words and near(words, other)):
                first = e[1], m
                break
        result[d[1], n] = first
    return result


def made_lines():
    rng = random.Random(4)
    vocabulary = "a b c d e f".split()
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(8, 14))] for _ in range(12)]
    docs = []
    for d in range(40):
        own = []
        for _ in range(rng.randint(0, 5)):
            words = list(rng.choice(base))
            for _ in range(rng.randint(0, 2)):
                at = rng.randrange(len(words))
                kind = rng.randrange(3)
                words[at : at + (kind != 0)] = [] if kind == 1 else [rng.choice(vocabulary)]
            own.append((" " if rng.random() < 0.5 else "  ").join(words))
        docs.append((d, "\n".join(own)))
    return docs


def test_lines_against_all_pairs(spark):
    docs = made_lines()
    found = lines.repeated_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    # of lines in a row, the earliest equal or near one is the first
    expected = plain_lines(docs)
    got = {(r["doc_id"], r["line_no"]): None if r["kept"] else (r["first_doc_id"], r["first_line_no"]) for r in found}
    assert {k for k, v in got.items() if v is None} == {k for k, v in expected.items() if v is None}
    assert len(got) == len(expected)


def test_lines_of_odd_texts(spark, documents, no_documents):
    kept = lines.without_repeated_lines(documents)
    assert kept.columns == documents.columns and kept.count() == documents.count()
    texts = {(r["doc_id"], r["text"]) for r in kept.select("doc_id", "text").collect()}
    assert (3, "The first line of a text.\nA second line, and more.") in texts and (7, "") in texts
    assert (5, None) in texts and (4, "") in texts and (9, " \t\r\n \n") in texts
    assert lines.repeated_lines(no_documents).count() == 0
    assert lines.without_repeated_lines(no_documents).count() == 0


def test_lines_need_no_python(spark, sf, plan_of):
    plan = plan_of(QUERIES["op8_lines"](spark, sf))
    assert "Python" not in plan and "Arrow" not in plan


# Vectors


def made_vectors():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(150, 64))
    parts = [x]
    for cosine in (0.951, 0.96, 0.98, 0.999):
        z = rng.normal(size=x.shape)
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        z -= (z * unit).sum(axis=1, keepdims=True) * unit
        z /= np.linalg.norm(z, axis=1, keepdims=True)
        parts.append(cosine * unit + np.sqrt(1 - cosine**2) * z)
    dense = x[0] + 0.02 * rng.normal(size=(200, 64))
    return np.concatenate([*parts, dense, x[:20], 3 * x[20:30]])


@pytest.mark.parametrize("most", [buckets.MOST, 50])
def test_vectors_against_all_pairs(spark, monkeypatch, most):
    monkeypatch.setattr(buckets.deal, "__defaults__", (most,))
    x = made_vectors()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = np.triu(unit @ unit.T >= 0.95, 1)
    a, b = np.nonzero(linked)
    rows = spark.createDataFrame([(n, v.tolist()) for n, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = {r["vec_id"]: r for r in near_vectors.near_vectors(rows).collect()}
    degrees = np.bincount(np.concatenate([a, b]), minlength=len(x))
    got = np.array([found[n]["n_links"] for n in range(len(x))])
    assert (got <= degrees).all() and got.sum() >= 0.99 * degrees.sum()
    if (got == degrees).all():
        least = groups(len(x), zip(a.tolist(), b.tolist()))
        assert [found[n]["component_id"] for n in range(len(x))] == least
    assert all(r["kept"] == (r["component_id"] == n) for n, r in found.items())


def test_recall_on_the_given_vectors(spark):
    sf = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    x = np.array([r["embedding"] for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    expected = ((x @ x.T) >= 0.95).sum() - len(x)
    assert sum(r["n_links"] for r in QUERIES["op9_near_vectors"](spark, sf).collect()) >= 0.9 * expected


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    one = [1.0] + [0.0] * 63
    odd = [None, [], [0.0] * 64, [nan] + one[1:], [inf] + one[1:], [None] + one[1:]]
    vectors = [*enumerate([*odd, one, one, [2.0 * v for v in one], [-v for v in one], [1.0, 0.0], [3.0, 0.0]]), (None, one)]
    rows = spark.createDataFrame([(n, v, "clash") for n, v in vectors], "vec_id long, embedding array<float>, id string")
    found = {r["vec_id"]: tuple(r)[1:] for r in near_vectors.near_vectors(rows).collect()}
    assert all(found[n] == (0, n, True) for n in range(6))
    assert found[6] == (2, 6, True) and found[7] == (2, 6, False) and found[8] == (2, 6, False)
    assert found[9] == (0, 9, True) and found[10] == (1, 10, True) and found[11] == (1, 10, False)
    assert found[None] == (0, None, True)
    assert near_vectors.near_vectors(rows.where("false")).count() == 0


# Binary codes


def test_search_against_all_rows(spark):
    rng = np.random.default_rng(8)
    codes = np.concatenate([rng.integers(-(2**63), 2**63 - 1, 300), np.repeat(rng.integers(0, 99, 3), 20), [0, -1, 1]])
    rows = [(n, int(c)) for n, c in enumerate(codes)]
    table = spark.createDataFrame([*rows, rows[0], (None, 5), (999, None)], "id long, code long")
    found = binary_search.search(table, table.where("id % 20 = 0"), k=7).collect()
    expected = set()
    for n, c in rows[::20]:
        apart = sorted(((c ^ d) & (2**64 - 1)).bit_count() * 1000 + m for m, d in rows if m != n)[:7]
        expected |= {(n, i + 1, v % 1000, v // 1000) for i, v in enumerate(apart)}
    assert {tuple(r) for r in found} == expected and len(found) == len(expected)


def near_copies(n):
    """Codes that are all alike in their lowest segment."""
    return [(i, int(x) << 16) for i, x in enumerate(np.random.default_rng(4).integers(0, 2**12, n))]


def test_many_queries_share_a_segment(spark, monkeypatch):
    """Both sides of a hot group are cut, and the result is that of plain comparison."""
    seen = spark.sparkContext.accumulator(0)
    cogroup = type(spark.range(0).groupBy("id").cogroup(spark.range(0).groupBy("id")))
    apply = cogroup.applyInArrow

    def watched(self, run, schema):
        def counting(own, asked):
            seen.add(int(asked.num_rows > 200))
            return run(own, asked)

        return apply(self, counting, schema)

    monkeypatch.setattr(cogroup, "applyInArrow", watched)
    for name, value in (("ASKED", 64), ("GROUP", 64), ("HITS", 500)):
        monkeypatch.setattr(binary_search, name, value, raising=False)
    rows = near_copies(400)
    table = spark.createDataFrame(rows, "id long, code long")
    found = {tuple(r) for r in binary_search.search(table, table, k=3).collect()}
    expected = set()
    for n, c in rows:
        apart = sorted((c ^ d).bit_count() * 1000 + m for m, d in rows if m != n)[:3]
        expected |= {(n, i + 1, v % 1000, v // 1000) for i, v in enumerate(apart)}
    assert found == expected and seen.value == 0


def test_hits_are_held_in_bounded_parts(monkeypatch):
    codes = np.unique([c for _, c in near_copies(6000)])
    own = pa.table({"code": codes, "least": codes, "copies": np.ones(len(codes), np.int32), "value": codes & 0xFFFF, "upper": np.zeros(len(codes), np.int32)})
    asked = pa.table({"query": codes, "bound": np.full(len(codes), 64), "value": codes & 0xFFFF})
    tracemalloc.start()
    found = binary_search._look_up(own, asked, 0, 16, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.num_rows == 5 * len(codes) and len(codes) ** 2 > 8_000_000 and peak < 150e6


def test_search_of_few_or_no_rows(spark):
    table = spark.createDataFrame([(0, 5), (20, 4)], "id long, code long")
    found = {tuple(r) for r in binary_search.search(table, table, k=3).collect()}
    assert found == {(0, 1, 20, 1), (20, 1, 0, 1)}
    assert binary_search.search(table.where("false"), table.where("false"), k=3).count() == 0


def test_codes_of_odd_vectors(spark):
    rows = [(1, [1.0, -1.0, 0.5]), (2, None), (3, []), (4, [None, 2.0]), (None, [1.0]), (5, [0.0] * 64 + [1.0]), (6, [float("nan"), 1.0])]
    table = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<float>, code string")
    assert {tuple(r) for r in binary_search.codes(table).collect()} == {(1, 5), (4, 2), (5, 1), (6, 2)}
