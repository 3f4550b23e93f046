"""Ids of whole texts by the public ``tokenizers`` library."""

import os
import re
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillmark.llm.worker import kept, slices, texts

IDS = np.dtype("<u4")


def _whole(library, text: str) -> bytes:
    return np.array(library.encode(text, add_special_tokens=False).ids, IDS).tobytes()


class _Known(dict):
    """Ids by chunk; those of a chunk that is not there yet are found and kept."""

    MARKS = ".,;:!?|#$%&*"
    #: Small letters that no normal form changes; each run of them is one word.
    LETTERS = "".join(x for x in map(chr, range(256)) if x.isalpha() and x.islower())
    WORD = re.compile(f"[{LETTERS}]+")
    #: Words to try the tokenizer's model with.
    WORDS = (*LETTERS, LETTERS, LETTERS[::-1], "st", "the", "llama", "dont", "endoftext", "stra\xdfe", "\xe9t\xe9", "qq" * 40)

    def __init__(self, library, items: Iterable[tuple[str, bytes]] = ()):
        super().__init__(items)
        self.library, self.model = library, library.model
        #: Letters as the model is given them.
        self.given = str.maketrans({x: "".join(p for p, _ in library.pre_tokenizer.pre_tokenize_str(x)) for x in self.LETTERS})
        self.by_word = all(self._of_model(x) == _whole(library, x) for x in self.WORDS)

    def _of_model(self, word: str) -> bytes:
        word = word if word.isascii() else word.translate(self.given)
        return np.array([x.id for x in self.model.tokenize(word)], IDS).tobytes()

    def __missing__(self, chunk: str) -> bytes:
        """Marks behind a word are parted from it, as words recur more."""
        word = chunk.rstrip(self.MARKS)
        if self.by_word and self.WORD.fullmatch(chunk):
            ids = self._of_model(chunk)
        elif word != chunk and word[-1:].lower()[-1:].isalnum():
            ids = self[word] + self[chunk[len(word) :]]
        else:
            ids = _whole(self.library, chunk)
        self[chunk] = ids
        return ids


class ChunkEncoder:
    """Encodes each different chunk between white space once and joins the ids.

    Right only for a tokenizer that drops white space and looks at no chunk's
    neighbours, as ``word_bpe_49k`` does: it turns white space into one space,
    lower-cases letter by letter, and parts words from marks. ``by_chunk``
    tells; any other tokenizer gets whole texts.
    """

    #: Chunks remembered by a worker, about 200 bytes each.
    MOST = 500_000
    #: White space to Python's ``split`` but not to the tokenizer.
    ODD = re.compile("[\x1c-\x1f]")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        #: Added tokens in small letters; the library looks for them before it lower-cases.
        self.added = [x.content.lower() for x in self.library.get_added_tokens_decoder().values()]
        probe = "Ab, c? .1!"
        parts = ["ab", ",", "c", "?", ".1", "!"]
        self.by_chunk = self.whole(probe) == b"".join(map(self.whole, parts))
        self.known = _Known(self.library) if self.by_chunk else {}

    def whole(self, text: str) -> bytes:
        return _whole(self.library, text)

    def _chunks(self, text: str) -> list[str] | None:
        """The chunks of a text, in small letters where that is sure to change no id."""
        if self.ODD.search(text):
            return None
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text.split()
        lower = text.lower()
        return text.split() if any(x in lower for x in self.added) else lower.split()

    def encode(self, many: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        if not self.by_chunk:
            found = self.library.encode_batch(many, add_special_tokens=False)
            return [np.array(x.ids, IDS).tobytes() for x in found]
        chunks = [self._chunks(text) for text in many]
        if len(self.known) > self.MOST:  # what was met first is what recurs most
            self.known = _Known(self.library, islice(self.known.items(), self.MOST // 2))
        known = self.known.__getitem__
        return [
            self.whole(text) if own is None else b"".join(map(known, own))
            for text, own in zip(many, chunks)
        ]


def encoder(path: str) -> ChunkEncoder:
    return kept(f"chunks {path}", lambda: ChunkEncoder(path))


def encoded(batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int) -> Iterator[pa.RecordBatch]:
    """doc_id and ids of a task's texts; to be followed by more work in the same task,
    as every further Python step would be another worker with words of its own."""
    own, last = encoder(tokenizer), np.array([end_id], IDS).tobytes()
    for batch in slices(batches, 128):
        ids = [x + last for x in own.encode(texts(batch))]
        columns = [batch.column("doc_id").cast(pa.int64()), pa.array(ids, pa.binary())]
        yield pa.record_batch(columns, ["doc_id", "ids"])


def encode_texts(documents: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """doc_id and ids of every whole text, with ``end_id`` after the last.

    ``ids`` is binary, little-endian unsigned 32-bit integers. A null or empty
    text has the end id alone. Other columns are left out; rows are neither
    moved nor merged, so repeated ids and texts each keep their row.
    """
    run = lambda batches: encoded(batches, tokenizer, end_id)
    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary")
