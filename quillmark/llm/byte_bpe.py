"""Operator 7: byte-level BPE by backtracking over longest matches, and its inverse.

A piece of text is covered left to right by the longest token that starts there,
found by an Aho-Corasick automaton over all tokens. A token is only put behind
one it is compatible with: merging the bytes of both must give the two tokens
again. If none fits, the last token is taken back and a shorter one tried there.
A covering in which all neighbours are compatible is the one the merges give,
and as a place is given up at most once, the work is linear in the text.
"""

import json
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillmark.llm.worker import kept, slices, texts

IDS = np.dtype("<i4")
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# Fixed: how the public byte-level tokenizers cut a text into pieces.
PIECES = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+"
    rf"| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)


def _letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for.

    Printable bytes stand for themselves, the others for the letters from 256 on.
    """
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(other)}


class ByteBPE:
    #: Pieces and token pairs remembered by a worker, about 150 bytes each.
    MOST = 500_000
    #: Stands between pieces in the automaton's input; no byte's letter.
    GAP = "\u0100"

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        letters = _letters()
        raw = lambda word: bytes(map(letters.__getitem__, word))
        ids = described["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in described["added_tokens"]}
        self.pieces = regex.compile(PIECES)
        marks = sorted(self.special, key=len, reverse=True)
        self.marks = regex.compile("|".join(map(regex.escape, marks))) if marks else None

        self.bytes: dict[int, bytes] = {i: raw(word) for word, i in ids.items()}
        merges = [m.split(" ") if isinstance(m, str) else m for m in described["model"]["merges"]]
        self.merged: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}
        for rank, (left, right) in enumerate(merges):
            pair = ids[left], ids[right]
            self.merged[pair] = rank
            self.made.setdefault(ids[left + right], (*pair, rank))

        self.automaton = ahocorasick.Automaton()
        for i, word in self.bytes.items():
            self.automaton.add_word(word.decode("latin-1"), (i, len(word)))
        self.automaton.make_automaton()
        by_word = {word: i for i, word in self.bytes.items()}
        #: The next shorter token that a token begins with.
        self.shorter: dict[int, int | None] = {}
        for i, word in self.bytes.items():
            starts = (by_word.get(word[:n]) for n in range(len(word) - 1, 0, -1))
            self.shorter[i] = next((x for x in starts if x is not None), None)
        self.known: dict[str, bytes] = {}
        self.fits: dict[tuple[int, int], bool] = {}

        words = self.bytes | {i: word.encode() for word, i in self.special.items()}
        table = [words.get(i, b"") for i in range(max(words) + 1)]
        self.offsets = np.concatenate([[0], np.cumsum([len(x) for x in table])])
        self.blob = np.frombuffer(b"".join(table), np.uint8)

    def _edge(self, token: int, side: int) -> list[tuple[int, int, int]]:
        """The tokens at one end of a token while it is merged: (token, made at, used up at)."""
        found, until = [], len(self.merged)
        while token in self.made:
            made = self.made[token]
            found.append((token, made[2], until))
            token, until = made[side], made[2]
        return [*found, (token, -1, until)]

    def compatible(self, left: int, right: int) -> bool:
        """Whether no merge across the border comes before those that make the two tokens.

        Of equal merges the one further left is done first.
        """
        pair = left, right
        if (known := self.fits.get(pair)) is None:
            known = True
            for a, a_made, a_until in self._edge(left, 1):
                for b, b_made, b_until in self._edge(right, 0):
                    if a_made < b_until and b_made < a_until:
                        rank = self.merged.get((a, b))
                        if rank is not None and rank < a_until and rank <= b_until:
                            known = False
            if len(self.fits) > self.MOST:
                self.fits.clear()
            self.fits[pair] = known
        return known

    def _cover(self, longest: list[int], begin: int, end: int) -> list[int]:
        """Tokens of the bytes from ``begin`` to ``end``; longest: of each place."""
        tokens: list[int] = []
        closed: set[int] = set()
        at, token = begin, longest[begin]
        while at < end:
            stop = at + len(self.bytes[token])
            if stop not in closed and (not tokens or self.compatible(tokens[-1], token)):
                tokens.append(token)
                at = stop
                token = longest[at]
            elif (less := self.shorter[token]) is not None:
                token = less
            else:
                closed.add(at)
                token = tokens.pop()
                at -= len(self.bytes[token])
        return tokens

    def _learn(self, pieces: list[str]) -> None:
        """Encode pieces that are new, in one pass of the automaton over all of them."""
        raw = [piece.encode() for piece in pieces]
        joined = self.GAP.join(x.decode("latin-1") for x in raw) + self.GAP
        longest = [0] * len(joined)
        for last, (token, size) in self.automaton.iter(joined):
            longest[last - size + 1] = token  # of one start, longer ones end later
        begin = 0
        for piece, x in zip(pieces, raw):
            tokens = self._cover(longest, begin, begin + len(x))
            self.known[piece] = np.array(tokens, IDS).tobytes()
            begin += len(x) + 1

    def encode(self, many: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian 32-bit integers."""
        cut: list[list[str | int]] = []
        for text in many:
            parts = self.marks.split(text) if self.marks else [text]
            own = self.pieces.findall(parts[0])
            for mark, part in zip(self.marks.findall(text) if len(parts) > 1 else (), parts[1:]):
                own.append(self.special[mark])
                own += self.pieces.findall(part)
            cut.append(own)
        if len(self.known) > self.MOST:  # what was met first is what recurs most
            self.known = dict(islice(self.known.items(), self.MOST // 2))
        for i in self.special.values():
            self.known.setdefault(i, np.array([i], IDS).tobytes())
        if new := [*set().union(*cut).difference(self.known)]:
            self._learn(new)
        return [b"".join(map(self.known.__getitem__, own)) for own in cut]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of all ids, copied from one table by their offsets."""
        if not len(ids):
            return b""
        begin = self.offsets[ids]
        sizes = self.offsets[ids + 1] - begin
        ends = np.cumsum(sizes)
        return self.blob[np.repeat(begin - ends + sizes, sizes) + np.arange(ends[-1])].tobytes()


def _model(path: str) -> ByteBPE:
    return kept(f"byte bpe {path}", lambda: ByteBPE(path))


def encode(documents: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and ids (array of int) of every whole text.

    Special tokens written out in a text get their id, as in the library. A null
    or empty text has no ids. Other columns are left out; rows are not moved.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(tokenizer)
        for batch in slices(batches, 64):
            found = model.encode(texts(batch))
            bounds = np.cumsum([0, *(len(x) // 4 for x in found)]).astype(np.int32)
            flat = np.frombuffer(b"".join(found), IDS)
            ids = pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat, pa.int32()))
            yield pa.record_batch([batch.column("doc_id").cast(pa.int64()), ids], ["doc_id", "ids"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, tokenizer: str) -> DataFrame:
    """All columns but ``ids``, and ``decoded``: the text of the ids.

    Null ids give an empty text; bytes that are no UTF-8 are replaced, and an id
    that the vocabulary lacks ends the job.
    """
    others = [c for c in tokens.columns if c not in ("ids", "decoded")]
    schema = tokens.select(*others).schema.add("decoded", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(tokenizer)
        for batch in slices(batches, 64):
            lists = batch.column("ids")
            flat = lists.values.to_numpy(zero_copy_only=False).astype(np.int64)
            bounds = lists.offsets.to_numpy()
            text = [
                model.decode(flat[a:b]).decode("utf-8", "replace") if b > a else ""
                for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())
            ]
            yield pa.record_batch([*(batch.column(c) for c in others), pa.array(text, pa.string())], [*others, "decoded"])

    return tokens.select(*others, "ids").mapInArrow(run, schema)
