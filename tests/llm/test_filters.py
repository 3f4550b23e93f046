"""Classifiers by held-out accuracy, archives by exact round trips, and the pipeline."""

import gzip
import hashlib
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillmark.llm import lines, packing, quality, simhash, toxicity, warc
from quillmark.llm import words as w
from quillmark.llm.queries import QUERIES
from quillmark.session import new_path

LABELS = "doc_id long, quality int, toxic int"


@pytest.mark.parametrize("name, label, by, held, least", [
    ("op3_quality", "quality", 3, 1, 0.97), ("op4_toxicity", "toxic", 5, 0, 0.95),
])
def test_held_out_accuracy(spark, name, label, by, held, least):
    sf = "/root/testdata/sf0.1"
    rows = QUERIES[name](spark, sf).collect()
    known = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % by == held)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
    tested = [r for r in rows if r["held_out"] and r["doc_id"] in known]
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert np.mean([r["predicted"] == known[r["doc_id"]] for r in tested]) >= least


def test_offending_sentences_are_found(spark):
    rows = []
    for n in range(300):
        bad = n % 3 == 0
        plain = [f"word{n % 7} is here and number {n % 11}.", "Nothing to see.", f"Thé end of text {n % 5}."]
        rows.append((n, " ".join([plain[0], *(["You are a zorgblat!"] if bad else []), *plain[1:]]), int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    scored = toxicity.score(docs, toxicity.train(docs.drop("toxic"), docs.select("doc_id", "toxic"), F.lit(True)))
    for r in scored.collect():
        assert (r["toxic_score"] >= 0.5) == bool(r["toxic"])
        spans = [r["text"].encode()[s["begin"] : s["end"]].decode() for s in r["toxic_sentences"]]
        assert spans == (["You are a zorgblat"] if r["toxic"] else [])


def test_noisy_or():
    logits = np.log(np.array([0.5, 0.5, 0.1]) / np.array([0.5, 0.5, 0.9]))
    assert np.allclose(toxicity.noisy_or(logits, np.array([0, 0, 1]), 3), [0.75, 0.1, 0])


@pytest.mark.parametrize("operator, column", [(quality.quality, "quality_score"), (toxicity.toxicity, "toxic_score")])
def test_scores_of_odd_documents(spark, documents, no_documents, operator, column):
    some = [(n, n % 2, 1 - n % 2) for n in (7, 3, 5, 4, 1, 2, 8)] + [(None, 1, 1), (3, None, None), (7, 0, 1)]
    for labels in (spark.createDataFrame(some, LABELS), spark.createDataFrame([], LABELS)):
        found = operator(documents, labels)
        rows = found.collect()
        assert len(rows) == documents.count() and all(0 <= r[column] <= 1 for r in rows)
        empty = {r[column] for r in rows if not (r["text"] or "")}
        assert len(empty) == 1
        assert set(found.columns) - {"toxic_sentences"} == set(documents.columns) - {"toxic_sentences"}
        assert operator(no_documents, labels).count() == 0


def test_words_of_parts():
    """Words keep their hash wherever they stand, and long texts are cut between words."""
    long = "alpha Beta " * 200_000
    groups = list(w.parts(["beta,alpha", long, ""]))
    hashes = set()
    total = 0
    for group in groups:
        found = w.words(group)
        letters = found.kind == w.LETTER
        hashes |= set(found.hashes()[letters].tolist())
        total += int(letters.sum())
    assert len(hashes) == 2 and total == 400_002 and len(groups) > 1


def known_words(texts):
    """All words and shapes of the texts, in order, and a vector for each."""
    keys = np.unique(np.concatenate([k for g in w.parts(texts) for k in quality._keys(w.words(g))]))
    return keys, np.random.default_rng(2).normal(size=(len(keys), quality.WIDTH)).astype(np.float32)


def test_different_words_of_long_texts_count_once(monkeypatch):
    """A text looked at in parts has the features of the same text looked at whole."""
    texts = ["one two three " * 2, "one two three " * 250_000]
    short, long = quality.pooled(texts, *known_words(texts))
    assert np.allclose(long[: 2 * quality.WIDTH], short[: 2 * quality.WIDTH], atol=1e-4)
    assert long[-2] == short[-2] and np.isclose(long[-1], np.log1p(1_500_000) - short[-2])
    rng = np.random.default_rng(3)
    texts = [" ".join(f"word{n}" for n in rng.integers(0, 50, size)) for size in (3, 900, 0, 700, 1, 40)]
    known = known_words(texts)
    whole = quality.pooled(texts, *known)
    monkeypatch.setattr(w, "PART", 1000)
    assert np.allclose(quality.pooled(texts, *known), whole)


def test_every_word_has_a_vector_of_its_own(spark, monkeypatch):
    """No two words share a count or a vector, and neither depends on how texts are dealt out."""
    letters = np.array(list("abcdefghijklmnopqrst"))
    names = ["x" + "".join(letters[[n // 8000, n // 400 % 20, n // 20 % 20, n % 20]]) for n in range(20_000)]
    docs = spark.createDataFrame([(n, " ".join(names[n : n + 6])) for n in range(0, 20_000, 5)], "doc_id long, text string").repartition(4)
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    scores = lambda: sorted((r["doc_id"], r["quality_score"]) for r in quality.quality(docs, labels).collect())
    plain = quality.word_sums(docs).where("word NOT BETWEEN 0 AND 63")
    assert plain.count() == 20_000 and plain.agg(F.max("count")).first()[0] == 2
    scored = scores()
    for name, value in (("HELD", 300), ("CHUNK", 5_000)):
        monkeypatch.setattr(quality, name, value)
    again = quality.word_sums(docs).where("word NOT BETWEEN 0 AND 63")
    read = lambda df: {r["word"]: (r["count"], bytes(r["sums"])) for r in df.collect()}
    assert read(plain) == read(again)
    assert np.allclose([s for _, s in scored], [s for _, s in scores()], atol=1e-6)


def test_common_words_stay_in_the_task(monkeypatch):
    """A word that comes all the time takes one row of a task's sums, not one each time rare words need room."""
    monkeypatch.setattr(quality, "HELD", 400)
    monkeypatch.setattr(quality, "GROUP", 500)
    texts = [" ".join(f"common{i % 20} rare{n}x{i}" for i in range(40)) for n in range(100)]
    batch = pa.record_batch([pa.array(texts)], ["text"])
    rows = [quality._read(x) for x in quality._contexts(iter([batch]))]
    keys = np.concatenate([x[0] for x in rows])
    found = dict(zip(*(x.tolist() for x in quality._merged(keys, np.concatenate([x[1] for x in rows])))))
    own = [quality._keys(w.words(next(w.parts([t]))))[0].tolist() for t in texts]
    for word in set().union(*own):
        assert found[word] == sum(x.count(word) for x in own)
    common = {x for x in own[0] if all(x in o for o in own)}
    assert len(common) >= 20 and sum(k in common for k in keys.tolist()) <= 2 * len(common)


@pytest.mark.parametrize("often", [1, 3, 4000])
def test_sums_held_are_those_of_all_neighbours(monkeypatch, often):
    """Sums do not depend on how many words a task holds, nor on when a frequent word is sent."""
    rng = np.random.default_rng(4)
    texts = [" ".join(f"W{n}" if n % 3 else f"w{n}!" for n in (rng.pareto(0.6, 60) * 3).astype(int) % 5000) for _ in range(60)] + ["", "a b " * 20_000, "a"]
    batch = pa.record_batch([pa.array(texts)], ["text"])

    def found():
        rows = [quality._read(x) for x in quality._contexts(iter([batch]))]
        return quality._merged(*(np.concatenate(x) for x in zip(*rows)))

    keys, counts, many, sums = found()
    assert np.abs(sums).max() > 1 << 15 and counts.sum() == 2 * sum(len(w.words(g).text) for g in w.parts(texts))
    for name, value in (("OFTEN", often), ("HELD", 30 * often)):
        monkeypatch.setattr(quality, name, value)
        assert all(np.array_equal(x, y) for x, y in zip(found(), (keys, counts, many, sums)))


def test_packed_sums_come_back():
    """Sums of any size are read as they were sent; two bytes a number are enough for most of the large ones."""
    sums = np.zeros((6, quality.WIDTH), np.int64)
    sums[1, :3], sums[2], sums[3, 5], sums[4, 6], sums[5, 7] = (2, -3, 1), np.arange(64) - 32, -32_767, 1 << 40, -128
    packed = quality._packed(sums)
    assert np.array_equal(quality._unpacked(packed), sums)
    assert [len(x.as_py()) for x in packed] == [0, 6, 64, 128, 512, 128]


def test_texts_move_in_rounds(spark, monkeypatch):
    """Of many chunks only a part's texts and vectors are on their way at a time, and the scores are those of one round."""
    docs = spark.range(600).select(F.when(F.col("id") % 50 > 0, F.col("id")).alias("doc_id"), F.expr("concat('word', id % 7, ' and word', id % 11, ' of ', id)").alias("text"))
    labels = docs.where("doc_id IS NOT NULL").select("doc_id", (F.col("doc_id") % 7 % 2).cast("int").alias("quality"))
    read = lambda **kind: sorted((r["doc_id"] or -1, r["quality_score"]) for r in quality.quality(docs, labels, **kind).collect())
    whole, moved, save = read(), [], quality.save
    assert len(whole) == 600

    def spied(df, path, by=(), append=False):
        save(df, path, by, append)
        moved.append((path, spark.read.parquet(path).count()))

    monkeypatch.setattr(quality, "save", spied)
    monkeypatch.setattr(quality, "CHUNK", 60)
    assert read(columns=["doc_id"]) == whole
    rounds = [n for path, n in moved if path == moved[-1][0]]
    assert len(rounds) == quality.ROUNDS and rounds[-1] == 600 and max(np.diff([0, *rounds])) <= 300


def test_words_of_one_text_are_pooled_as_if_they_had_a_row(spark):
    """Features are those of a table of all words, and of the method done plainly, word by word."""
    rng = np.random.default_rng(8)
    common = [f"w{n}" for n in range(40)]
    texts = [" ".join([*rng.choice(common, rng.integers(0, 30)), f"Only{n}", *rng.choice(common, 5), f"only{n}", f"rare{n}!"]) for n in range(150)]
    texts += ["", "alone", texts[3], "x" * 3000 + " y z"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    features = {}
    for least in (1, 2):
        table = quality.word_sums(docs, least)
        run = lambda batch, table: [pa.record_batch([batch.column("doc_id"), pa.array(quality.pooled(batch.column("text").to_pylist(), *table).tolist())], ["doc_id", "x"])]
        found = quality.looked_up(docs, table, run, "doc_id long, x array<double>").collect()
        features[least] = np.array([r["x"] for r in sorted(found, key=lambda r: r["doc_id"])])
    assert quality.word_sums(docs, 2).count() < quality.word_sums(docs, 1).count() - 100
    assert np.allclose(features[1], features[2], atol=1e-6)
    keys = [quality._keys(w.words(next(w.parts([t])))) for t in texts]
    vector, count = {}, {}

    def index(word):
        word, x = int(word) % 2**64, np.zeros(quality.WIDTH)
        for n in range(4):
            x[16 * n + (word >> 60 - 4 * n & 15)] += (word >> 40 + n & 1) * 2 - 1
        return x

    for own, shape in keys:
        for i, word in enumerate(own):
            near = [(j, index(own[j])) for j in (i - 2, i - 1, i + 1, i + 2) if 0 <= j < len(own)]
            for key, x in ((word, [v for _, v in near]), (shape[i], [])):
                vector[key] = vector.get(key, 0) + sum(x, np.zeros(quality.WIDTH))
                count[key] = count.get(key, 0) + 1
        for i in range(len(own)):
            for j in (i + 1, i + 2):
                if j < len(own):
                    vector[shape[i]] = vector[shape[i]] + index(own[j])
                    vector[shape[j]] = vector[shape[j]] + index(own[j])
    total = sum(count.values())
    for n, (own, shape) in enumerate(keys):
        both = [*own, *shape]
        unit = lambda k: vector[k] / max(1, np.linalg.norm(vector[k])) * 0.01 / (0.01 + count[k] / total)
        for at, some in ((0, both), (quality.WIDTH, sorted(set(both)))):
            mean = sum(map(unit, some), np.zeros(quality.WIDTH)) / max(1, len(some))
            # sums beyond a byte are rounded to one
            assert np.allclose(features[2][n][at : at + quality.WIDTH], mean, atol=3e-3)
        assert np.isclose(features[2][n][-3], np.log1p(len(both))) and np.isclose(features[2][n][-2], np.log1p(len(set(both))))


@pytest.mark.parametrize("most", [1, 5, 127, 128, 10**6])
def test_sums_are_read_as_they_were_sent(most):
    rng = np.random.default_rng(most)
    sums = rng.integers(-most, most + 1, (500, quality.WIDTH)) * (rng.random((500, quality.WIDTH)) < rng.random((500, 1)))
    assert (quality._unpacked(quality._packed(sums)) == sums).all()
    assert (quality._unpacked(quality._packed(sums).slice(7, 100)) == sums[7:107]).all()
    assert len(quality._packed(sums[:0])) == 0


# Archives


def sent_sums(texts):
    """Rows that a task sends for some texts, and what they come to for each word or shape."""
    batches = pa.table({"text": pa.array(texts, pa.string())}).to_batches(100)
    rows, found = 0, {}
    for batch in quality._contexts(iter(batches)):
        rows += batch.num_rows
        for key, count, many, sums in zip(*quality._read(batch)):
            old = found.get(int(key), (0, 0, 0))
            found[int(key)] = old[0] + int(count), old[1] + int(many), old[2] + sums
    return rows, found


def plain_sums(texts):
    found = {}
    for text in texts:
        words = w.words([(0, text.encode())])
        own, shape = (x.tolist() for x in quality._keys(words))
        for n, key in [*enumerate(own), *enumerate(shape)]:
            found.setdefault(key, [0, set(), np.zeros(quality.WIDTH, np.int64)])
            found[key][0] += 1
            found[key][1].add(text)
        for n in range(len(own)):
            for m in range(n + 1, min(n + quality.WINDOW + 1, len(own))):
                for to, of in ((own[n], own[m]), (own[m], own[n]), (shape[n], own[m]), (shape[m], own[m])):
                    bits = of % 2**64
                    for part in range(quality.ONES):
                        place = part * 16 + (bits >> (60 - 4 * part) & 15)
                        found[to][2][place] += 1 if bits >> (40 + part) & 1 else -1
    return found


@pytest.mark.parametrize("held, group", [(quality.HELD, 1 << 18), (20, 100), (1, 1)])
def test_sums_held_as_bytes_are_exact(monkeypatch, held, group):
    """The most frequent words have sums beyond a byte, at once or only after some were added up."""
    monkeypatch.setattr(quality, "HELD", held)
    monkeypatch.setattr(quality, "GROUP", group)
    texts = [f"The word{n % 7} of the {chr(97 + n % 5)} House, no {n}." for n in range(300)] + ["so it " * 700, "", "one"]
    _, found = sent_sums(texts)
    plain = plain_sums(texts)
    assert max(abs(x[2]).max() for x in plain.values()) > 127
    assert found.keys() == plain.keys()
    for key, (count, texts_of, sums) in plain.items():
        assert found[key][0] == count and (found[key][2] == sums).all()
        assert (found[key][1] > 1) == (len(texts_of) > 1)


def test_a_task_sends_a_word_once_unless_it_holds_very_many():
    letters = "abcdefghijklmnopqrst"
    words = [f"{a}{b}{c}{d}" for a in letters for b in letters for c in letters for d in letters[:13]]
    texts = [" ".join(words[at : at + 100]) for at in range(0, len(words), 100)]
    rows, found = sent_sums(texts + texts[::-1] + texts)
    assert len(words) == 104_000 and len(found) > 104_000
    assert rows < 1.1 * len(found)


def test_nothing_but_the_words_is_left_when_scores_are_asked_for(spark, documents):
    files = lambda: {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(
        spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if f.getName().startswith("shuffle_")}
    before, name = files(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(name)
    scored = quality.quality(documents, spark.createDataFrame([(7, 1), (3, 0)], "doc_id long, quality int"))
    for _ in range(100):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before
    assert spark.conf.get(name) == was
    assert scored.count() == documents.count()


def made_pages(spark):
    same, other = "<p>" + "x" * 200, "é" * 60
    rows = [
        (5, "http://a/5", same), (2, None, same), (9, "http://a/9\r\nX: y", same), (1, "u", "short"), (4, "u", "short"),
        (7, "u", None), (8, "u", ""), (3, "u", other), (6, "u", other), (None, "u", other), (10, "u", "\r\n\r\nWARC/1.1\r\n" * 20),
        (11, "u", "z" * 3_000_000), (11, "u", "z" * 3_000_000), (12, "u", "z" * 3_000_000),
    ]
    return spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string").repartition(3)


def written(spark, pages):
    spark.dataSource.register(warc.WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    folder = new_path(spark, "warc")
    warc.page_records(pages).write.format("warc").mode("append").save(folder)
    return folder


def test_archives_of_odd_pages(spark):
    pages = made_pages(spark)
    rows = spark.read.format("warc").load(written(spark, pages)).withColumn("page_id", warc.page_id("record_id")).collect()
    html = {r["page_id"]: (r["html"] or "").encode() for r in pages.collect()}
    kinds = sorted(((r["page_id"], r["record_type"], r["refers_to"]) for r in rows), key=repr)
    expected = [(n, "response", None) for n in (1, 2, 3, 4, 7, 8, 10, 11, 11)]
    expected += [(n, "revisit", f"urn:page:{m}") for n, m in ((5, 2), (9, 2), (6, 3), (None, 3), (12, 11))]
    assert kinds == sorted(expected, key=repr)
    for r in rows:
        body = html[r["page_id"]]
        assert r["payload_digest"] == "sha256:" + hashlib.sha256(body).hexdigest()
        assert r["payload_length"] == len(body)
        assert r["payload"] == (body if r["record_type"] == "response" else None)


def test_no_pages(spark):
    folder = written(spark, made_pages(spark).where("false"))
    assert spark.read.format("warc").load(folder).count() == 0


def test_predicates_reach_the_reader_and_payloads_stay_unread(spark, plan_of):
    folder = written(spark, made_pages(spark))
    reader = spark.read.format("warc").option("payload", "false")
    few = reader.load(folder).where("record_type = 'revisit' and refers_to in ('urn:page:2', 'urn:page:3')")
    assert few.count() == 4 and few.where("payload is not null").count() == 0
    own = warc.WarcReader({"path": folder})
    from pyspark.sql.datasource import EqualTo, GreaterThan

    left = list(own.pushFilters([EqualTo(("record_type",), "revisit"), GreaterThan(("payload_length",), 5)]))
    assert len(left) == 1 and own.tests == [("warc-type", "is", "revisit")]
    found = [n for p in own.partitions() for b in own.read(p) for n in b.column("record_type").to_pylist()]
    assert found == ["revisit"] * 5


class Watched:
    """A file that counts what is read of it."""

    def __init__(self, data):
        self.data, self.read = data, 0

    def size(self):
        return len(self.data)

    def read_at(self, n, at):
        assert 0 <= at < len(self.data) or n == 0
        self.read += len(self.data[at : at + n])
        return self.data[at : at + n]


@pytest.fixture
def inflated(monkeypatch):
    """How many bytes each call of an inflater has given."""
    sizes, make = [], warc.zlib.decompressobj

    class Inflater:
        def __init__(self, *args):
            self.own = make(*args)

        def __getattr__(self, name):
            return getattr(self.own, name)

        def decompress(self, data, *most):
            sizes.append(len(found := self.own.decompress(data, *most)))
            return found

    monkeypatch.setattr(warc.zlib, "decompressobj", Inflater)
    return sizes


def members(payloads):
    return b"".join(
        warc._member(warc._record({
            "record_id": f"urn:page:{n}", "record_type": "response", "target_uri": "u", "date": "d", "refers_to": None,
            "payload_digest": "sha256:0", "payload_length": None, "payload": payload,
        }))
        for n, payload in enumerate(payloads)
    )


def noise(size, seed=0):
    return np.random.default_rng(seed).integers(33, 126, size).astype(np.uint8).tobytes()


def test_small_pages_that_are_not_wanted_are_neither_inflated_nor_read_twice(inflated):
    payloads = [noise(3000 + n, n) for n in range(250)]
    file = Watched(members(payloads))
    assert list(warc._blocks(file, lambda headers: None)) == []
    assert file.read <= len(file.data)
    assert sum(inflated) <= 250 * warc.HEAD < sum(map(len, payloads)) // 2
    del inflated[:]
    heads = list(warc._blocks(Watched(file.data), lambda headers: False))
    assert [int(h["content-length"]) > len(p) for (h, _), p in zip(heads, payloads)] == [True] * 250
    assert sum(inflated) <= 250 * 2 * warc.HEAD
    whole = Watched(file.data)
    found = [block.partition(warc.BLANK)[2] for _, block in warc._blocks(whole, lambda headers: True)]
    assert found == payloads and whole.read == len(file.data)


def test_large_payloads_are_passed_over(inflated):
    """Of a record that isn't wanted no more is read than what was read ahead."""
    file = Watched(members([noise(2_000_000), b"small", noise(1_000_000), b""]))
    wanted = lambda headers: True if headers["warc-record-id"] == "<urn:page:1>" else None
    assert [block.partition(warc.BLANK)[2] for _, block in warc._blocks(file, wanted)] == [b"small"]
    assert file.read <= 4 * warc.CHUNK and sum(inflated) <= 5 * warc.HEAD


@pytest.mark.parametrize("size", [0, 1, warc.FEED, warc.CHUNK - 1, warc.CHUNK, 300_000])
def test_payloads_of_any_size_come_back(size):
    """Well and badly packed ones, which end anywhere in what is read ahead."""
    payloads = [noise(size), b"x" * size, b"\r\n\r\n" * size, noise(size, 1)]
    data = members(payloads)
    for one in (data, b"".join(gzip.compress(gzip.decompress(members([p]))) for p in payloads)):
        found = [block.partition(warc.BLANK)[2] for _, block in warc._blocks(Watched(one), lambda headers: True)]
        assert found == payloads
        assert [block.count(warc.BLANK) > 0 for _, block in warc._blocks(Watched(one), lambda headers: False)] == [True] * 4


@pytest.mark.parametrize("cut", [1, 40, 2000])
def test_archives_cut_short_are_an_error(cut):
    data = members([b"a", noise(5000)])[:-cut]
    with pytest.raises(ValueError):
        list(warc._blocks(Watched(data), lambda headers: True))


def record(kind, body, **more):
    head = {"WARC-Type": kind, "WARC-Record-ID": "<urn:x>", "Content-Length": len(body), **more}
    return ("WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n").encode() + body + b"\r\n\r\n"


@pytest.mark.parametrize("packed", [False, True])
def test_archives_of_others(spark, tmp_path, packed):
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/plain\r\n\r\nbody"
    records = [
        record("warcinfo", b"software: x\r\n"), record("response", http, **{"Content-Type": "application/http"}),
        record("resource", b"", **{"Content-Type": "text/plain"}), record("request", b"y" * 200_000),
    ]
    data = b"".join(gzip.compress(r) if packed else r for r in records)
    (tmp_path / ("a.warc.gz" if packed else "a.warc")).write_bytes(data)
    spark.dataSource.register(warc.WarcSource)
    rows = spark.read.format("warc").load(str(tmp_path)).collect()
    assert [r["record_type"] for r in rows] == ["warcinfo", "response", "resource", "request"]
    assert [bytes(r["payload"]) for r in rows] == [b"software: x\r\n", b"body", b"", b"y" * 200_000]


def test_lost_tasks_leave_no_records(spark):
    """Files of a failed write are not read."""
    folder = written(spark, made_pages(spark))
    count = spark.read.format("warc").load(folder).count()
    warc.WarcWriter({"path": folder}, False).write(iter([]))
    (__import__("pathlib").Path(folder.removeprefix("file://")) / "left.warc.gz").write_bytes(b"broken")
    assert spark.read.format("warc").load(folder).count() == count


# Pipeline


def test_stages_of_the_pipeline(spark, sf):
    """Every stage's decision is that of its operator, on what the one before kept."""
    assert len(corpus_pipeline.STAGES) == 5
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    first, second, third, fourth, last = (f for _, f in corpus_pipeline.STAGES)
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}

    good = first(spark, docs, sf).cache()
    scores = quality.quality(docs, labels)
    assert good.columns == docs.columns and ids(good) == ids(scores.where("quality_score >= 0.5"))
    clean = second(spark, good, sf).cache()
    scores = toxicity.toxicity(good, labels)
    assert clean.columns == docs.columns and ids(clean) == ids(scores.where("toxic_score < 0.5"))
    thin = third(spark, clean, sf).cache()
    assert thin.columns == docs.columns and ids(thin) == ids(clean)
    kept = lines.repeated_lines(clean).where("kept").groupBy("doc_id").agg(F.collect_set("line_no").alias("n"))
    kept = {r["doc_id"]: r["n"] for r in kept.collect()}
    whole = {r["doc_id"]: r["text"].split("\n") for r in clean.collect()}
    for r in thin.collect():
        assert r["text"] == "\n".join(whole[r["doc_id"]][n] for n in sorted(kept.get(r["doc_id"], [])))
    alone = fourth(spark, thin, sf).cache()
    groups = {r["component_id"] for r in simhash.near_duplicates(thin).collect()}
    assert alone.columns == docs.columns and ids(alone) == groups and alone.count() == len(groups)
    packed = last(spark, alone, sf)
    assert ids(packed) == groups and packed.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= packing.WINDOW


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_on_odd_documents(spark, sf, documents, no_documents, name, stage):
    plain = documents.select("doc_id", "text", "lang", "source", "n_chars")
    found = stage(spark, plain, sf)
    assert found.count() > 0
    if name != "packing":
        assert found.columns == plain.columns
    assert stage(spark, no_documents.select(*plain.columns), sf).count() == 0
