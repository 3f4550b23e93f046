"""Operator 11: spelling variants by a relational trie frontier.

The trie of all words is a table of edges. The frontier is a table of states
(word, position, node, edits): the first ``position`` letters of the word have
been read on the way to the node, with that many edits. Round by round the states
are joined with the edges below their nodes, until none is left; a state with one
edit that has read its whole word at a node where a word ends is a neighbour.

What keeps the frontier small, and loses no neighbour:

* One edit always can be made at the first letter that differs. So states without
  edits stay on the path of their own word, and leave it only by edges that begin
  with another letter.
* Of two near words either the first or the last half is equal. Each word is read
  forwards and backwards, and leaves its path in its second half only.
* Edges go from one node where words part or end to the next and carry all
  letters between, so the rounds are as many as such nodes lie on a word's second
  half, not as many as it has letters.

Nodes are 64-bit hashes of prefixes. If two prefixes shared one, their edges would
hang on one node: states could go astray, but none is lost, and what a state says
to be its neighbour is looked up among the words before it counts.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.llm.worker import slices
from quillmark.sources.stages import stage

BASE = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xD6E8FEB86659FD93)
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Letters of words read together.
TOGETHER = 1 << 18


def runs(documents: DataFrame, least_letters: int = 6) -> DataFrame:
    """doc_id and run for each maximal run of at least that many letters (A-Z, a-z,
    U+00C0 to U+00FF) in each whole text, with A-Z in small letters.

    A null or empty text has none; repeated rows and ids have theirs each.
    """
    letters = F.regexp_extract_all("text", F.lit(f"[A-Za-zÀ-ÿ]{{{least_letters},}}"), F.lit(0))
    found = documents.select("doc_id", F.explode(letters).alias("run"))
    return found.withColumn("run", F.translate("run", CAPITALS, CAPITALS.lower()))


def frequent(words: DataFrame, least_letters: int, least: int) -> DataFrame:
    """word and n of words with that many letters and occurrences; tasks count their own first."""
    long = words.where(F.length("word") >= least_letters)
    return long.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def _nodes(codes: np.ndarray, sizes: np.ndarray, numbers: np.ndarray, back: bool) -> pa.RecordBatch:
    """The prefixes of some words, from the half on, as rows (number, back, depth, node, letter)."""
    begin = np.cumsum(sizes) - sizes
    at = np.arange(len(codes)) - np.repeat(begin, sizes)
    if back:
        codes = codes[np.repeat(begin + sizes - 1, sizes) - at]
    powers = np.full(int(sizes.max()) + 1, BASE, np.uint64)
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    mixed = (codes.astype(np.uint64) + np.uint64(1)) * MIX
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((mixed ^ (mixed >> np.uint64(29))) * powers[at], dtype=np.uint64)])
    first = (sizes - 1) // 2  # a near word has a letter less at the least, and is left in its second half
    spots = sizes - first + 1
    word = np.repeat(np.arange(len(sizes)), spots)
    depth = np.arange(len(word)) - np.repeat(np.cumsum(spots) - spots, spots) + first[word]
    ends = depth == sizes[word]
    node = (sums[begin[word] + depth] - sums[begin[word]] + np.uint64(back)) * MIX
    letter = np.where(ends, -1, codes[np.minimum(begin[word] + depth, len(codes) - 1)].astype(np.int64))
    columns = [numbers[word], np.full(len(word), back), depth.astype(np.int32), (node ^ (node >> np.uint64(31))).view(np.int64), letter.astype(np.int32)]
    return pa.record_batch([pa.array(x) for x in columns], ["number", "back", "depth", "node", "letter"])


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 4096):
        numbers, words = batch.column("number").to_numpy(), batch.column("word").to_pylist()
        at = 0
        while at < len(words):
            end, letters = at + 1, len(words[at])
            while end < len(words) and letters < TOGETHER:
                letters += len(words[end])
                end += 1
            sizes = np.fromiter(map(len, words[at:end]), np.int64, end - at)
            codes = np.frombuffer("".join(words[at:end]).encode("utf-32-le"), np.uint32)
            for back in (False, True):
                yield _nodes(codes, sizes, numbers[at:end], back)
            at = end


def _paths(words: DataFrame) -> DataFrame:
    """Each word, forwards and backwards, with the nodes on its second half where
    words part or end: number, back, letters, spots (depth, node, ends)."""
    kind = "number long, back boolean, depth int, node long, letter int"
    prefixes = words.select("number", "word").mapInArrow(_prefixes, kind)
    # a node is one of a direction, as its hash holds the direction
    parting = prefixes.groupBy("node").agg(F.min("letter").alias("least"), F.max("letter").alias("most"))
    parting = parting.where("least = -1 OR least < most").select("node", (F.col("least") == -1).alias("ends"))
    spots = F.sort_array(F.collect_list(F.struct("depth", "node", "ends"))).alias("spots")
    listed = prefixes.select("number", "back", "depth", "node").join(parting, "node").groupBy("number", "back").agg(spots)
    letters = F.when(F.col("back"), F.reverse("word")).otherwise(F.col("word")).alias("letters")
    return listed.join(words, "number").select("number", "back", letters, "spots")


def _part(text: Column, begin: Column, size: Column) -> Column:
    """``size`` letters from the place ``begin``, counted from 0; fewer where the text ends."""
    return F.substring(text, begin + 1, size)


def _edges(paths: DataFrame) -> DataFrame:
    """The trie: node, letter, label (the letters behind that one), child, ends (whether a word ends there)."""
    pairs = F.transform(F.slice("spots", F.lit(2), F.size("spots") - 1), lambda x, n: F.struct(F.get("spots", n).alias("a"), x.alias("b")))
    found = paths.select("letters", F.explode(pairs).alias("e"))
    label = _part(F.col("letters"), F.col("e.a.depth") + 1, F.col("e.b.depth") - F.col("e.a.depth") - 1)
    letter = _part(F.col("letters"), F.col("e.a.depth"), F.lit(1))
    edge = [F.col("e.a.node").alias("node"), letter.alias("letter"), label.alias("label")]
    return found.select(*edge, F.col("e.b.node").alias("child"), F.col("e.b.ends").alias("ends")).distinct()


def _first_round(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """States after their edit: number, back, letters, node, position, ends, and ``near``, the word they are on the way to."""
    size = F.length("letters")
    own = paths.select("number", "back", "letters", F.explode("spots").alias("spot")).where(F.col("spot.depth") >= F.floor(size / 2))
    own = own.select("number", "back", "letters", F.col("spot.node").alias("node"), F.col("spot.depth").alias("depth"), F.col("spot.ends").alias("at_end"))
    text, depth, behind = F.col("letters"), F.col("depth"), F.length("label")
    before = _part(text, F.lit(0), depth)
    rest = lambda n: _part(text, depth + n, size)
    # the first letter that differs is replaced, put in, or left out
    replaced = (depth < size) & (_part(text, depth + 1, behind) == F.col("label"))
    put_in = _part(text, depth, behind) == F.col("label")
    left_out = (_part(text, depth + 1, F.lit(1)) == F.col("letter")) & (_part(text, depth + 2, behind) == F.col("label"))
    state = lambda chosen, read, near: F.when(chosen, F.struct((depth + read + behind).alias("position"), near.alias("near")))
    states = F.array_compact(
        F.array(
            state(replaced, 1, F.concat(before, F.col("letter"), rest(1))),
            state(put_in, 0, F.concat(before, F.col("letter"), rest(0))),
            state(left_out, 2, F.concat(before, rest(1))),
        )
    )
    met = own.join(edges, "node").where(F.col("letter") != _part(text, depth, F.lit(1))).where(replaced | put_in | left_out)
    met = met.select("number", "back", "letters", F.col("child").alias("node"), "ends", F.explode(states).alias("state"))
    moved = met.select("number", "back", "letters", "node", "state.position", "ends", "state.near")
    # without its last letter a word may stand on its own path already
    last = own.where((depth == size - 1) & F.col("at_end"))
    return moved.unionByName(
        last.select("number", "back", "letters", "node", size.alias("position"), F.lit(True).alias("ends"), before.alias("near"))
    )


def neighbours(words: DataFrame) -> DataFrame:
    """Pairs (word, near): all words that differ from a word by exactly one letter
    put in, left out or replaced; both directions of a pair are listed, once each.

    ``words`` has one row for each word; null and empty words are near to none. A word is a
    sequence of code points of any length. A table without rows gives none.
    """
    words = stage(words.where("word <> ''").select("word", F.monotonically_increasing_id().alias("number")), "words")
    paths = stage(_paths(words), "paths")
    edges = stage(_edges(paths), "edges")
    states = stage(_first_round(paths, edges), "states")
    found = []
    while states.take(1):
        text, position = F.col("letters"), F.col("position")
        read = F.when(F.col("back"), F.reverse("near")).otherwise(F.col("near"))
        found.append(states.where(F.col("ends") & (position == F.length("letters"))).select("number", read.alias("near")))
        going = states.where(position < F.length("letters")).drop("ends").withColumn("letter", _part(text, position, F.lit(1)))
        further = going.join(edges, ["node", "letter"]).where(_part(text, position + 1, F.length("label")) == F.col("label"))
        position = (position + 1 + F.length("label")).alias("position")
        states = stage(further.select("number", "back", "letters", F.col("child").alias("node"), position, "ends", "near"), "states")
    if not found:
        return words.select("word", F.col("word").alias("near")).where("false")
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    pairs = pairs.distinct().join(words.select(F.col("word").alias("near")), "near")
    return pairs.join(words, "number").select("word", "near")


def roots(forms: DataFrame) -> DataFrame:
    """word and root of a table (word, form): the last word that forms lead to.

    Forms must not lead in a circle. Each round goes twice as far as the one before.
    """
    far = stage(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = far.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = stage(far.join(step, "root", "left"), "further_roots")
        if not joined.where("next IS NOT NULL").take(1):
            return far
        far = joined.select("word", F.coalesce("next", "root").alias("root"))


def variants(words: DataFrame, times: int = 5) -> DataFrame:
    """Groups words by spelling: word, form, root, n, n_near, form_n.

    ``words`` has word and n, one row for each word. A word's form is its near
    word (see ``neighbours``) of largest n, of equal ones the first in code point
    order, if that n is at least ``times`` (2 or more) the word's own; else null.
    """
    words = stage(words.select("word", "n"), "counted_words")
    pairs = neighbours(words).join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = F.min(F.struct((-F.col("near_n")).alias("n"), "near"))
    nearest = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    nearest = words.join(nearest, "word", "left").withColumn("n_near", F.coalesce("n_near", F.lit(0).cast("long")))
    chosen = -F.col("best.n") >= times * F.col("n")
    formed = nearest.select(
        "word", "n", "n_near", F.when(chosen, F.col("best.near")).alias("form"), F.when(chosen, -F.col("best.n")).alias("form_n")
    )
    formed = stage(formed, "forms")
    last = roots(formed.where("form IS NOT NULL"))
    rooted = formed.join(last, "word", "left").withColumn("root", F.coalesce("root", "word"))
    return rooted.select("word", "form", "root", "n", "n_near", "form_n")
