"""Ids of whole texts by a byte-level tokenizer of the public ``tokenizers`` library.

A batch of texts is cut, with numpy on its bytes, at places that no pre-token of
the published pattern reaches over; each different chunk is encoded once and the
ids of the texts are gathered from those of the chunks.
"""

import json
import os
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa

from quillmark.llm.worker import kept

IDS = np.dtype("<u4")
#: Bytes of text looked at together; a longer text is looked at alone.
TOGETHER = 4 << 20
#: Behind a letter or digit these always begin a pre-token.
MARKS = b".,;:!?"


def _table(chosen: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chosen)] = True
    return table


#: White space of ASCII, and four characters that are white space to some patterns only.
WHITE = _table(b" \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f")
MARK = _table(MARKS)
ALNUM = _table(bytes(range(48, 58)) + bytes(range(65, 91)) + bytes(range(97, 123)))


def chunk_starts(data: np.ndarray) -> np.ndarray:
    """Marks where, in UTF-8 bytes, a chunk may begin: at a single space, at and behind a
    single line break, and at a mark behind a letter or digit.

    White space that touches other white space is left alone, as are the
    neighbours of characters that may be white space beyond ASCII.
    """
    near = np.concatenate([[0, 0], data, [0, 0]]).astype(np.uint8)  # near[i + 2] is data[i]
    odd = WHITE[near]
    two = (near[:-1] == 0xC2) & ((near[1:] == 0x85) | (near[1:] == 0xA0))
    # U+1680, U+2000 to U+207F and U+3000 to U+303F: all spaces beyond those two, and some marks
    three = (near[:-1] == 0xE1) & (near[1:] == 0x9A) | (near[:-1] == 0xE2) & ((near[1:] == 0x80) | (near[1:] == 0x81))
    three |= (near[:-1] == 0xE3) & (near[1:] == 0x80)
    odd[:-1] |= two | three
    odd[1:] |= two | three
    odd[2:] |= three[:-1]
    here, before, behind = near[2:-2], ~odd[1:-3], ~odd[3:-1]
    starts = ((here == 32) | (here == 10)) & before & behind
    starts |= (near[1:-3] == 10) & ~odd[:-4] & ~odd[2:-2]
    starts |= MARK[here] & ALNUM[near[1:-3]]
    return starts


class ByteChunks:
    """Encodes each different chunk once. Right for a tokenizer without normalizer
    and with the published byte-level pre-tokenizer; ``by_chunk`` tells from its
    file, and any other one gets whole texts."""

    #: Chunks and ids remembered by a worker, and the longest chunk that is.
    MOST, MOST_IDS, LONGEST = 400_000, 4_000_000, 64

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        made = json.loads(self.library.to_str())
        before = made["pre_tokenizer"] or {}
        plain = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
        added = [x["content"].encode() for x in made["added_tokens"] if not (x["lstrip"] or x["rstrip"] or x["single_word"])]
        whole = all(not chunk_starts(np.frombuffer(x, np.uint8)).any() and x.isascii() for x in added)
        self.by_chunk = bool(plain and made["normalizer"] is None and whole and len(added) == len(made["added_tokens"]))
        self.known: dict[bytes, int] = {}
        self.flat, self.begin = np.zeros(0, IDS), np.zeros(1, np.int64)

    def _ids(self, chunks: list[bytes]) -> list[list[int]]:
        found = self.library.encode_batch_fast([x.decode("utf-8", "replace") for x in chunks], add_special_tokens=False)
        return [x.ids for x in found]

    def _forget(self) -> None:
        """Keep what was met first, which is what recurs most."""
        half = min(len(self.known), self.MOST // 2)
        old = [(x, n) for x, n in islice(self.known.items(), half)]
        ids = [self.flat[self.begin[n] : self.begin[n + 1]] for _, n in old]
        self.known = {x: n for n, (x, _) in enumerate(old)}
        self.flat = np.concatenate([np.zeros(0, IDS), *ids])
        self.begin = np.concatenate([[0], np.cumsum([len(x) for x in ids], dtype=np.int64)]).astype(np.int64)

    def _numbers(self, chunks: list[bytes]) -> np.ndarray:
        """The place of each chunk's ids; new chunks are learnt."""
        numbers = np.fromiter((self.known.get(x, -1) for x in chunks), np.int64, len(chunks))
        new = np.flatnonzero(numbers < 0)
        if len(new):
            fresh = [chunks[i] for i in new]
            ids = self._ids(fresh)
            numbers[new] = np.arange(len(new)) + len(self.begin) - 1
            self.known.update((x, n) for x, n in zip(fresh, numbers[new].tolist()) if len(x) <= self.LONGEST)
            sizes = np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))
            self.begin = np.concatenate([self.begin, self.begin[-1] + sizes])
            self.flat = np.concatenate([self.flat, np.fromiter((x for own in ids for x in own), IDS, sizes[-1])])
        return numbers

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one behind the other, ``end_id`` after each, and how
        many each has with it. A null text is empty."""
        if not self.by_chunk:
            ids = [self.library.encode(x or "", add_special_tokens=False).ids for x in texts.to_pylist()]
            sizes = np.array([len(x) + 1 for x in ids], np.int64)
            return np.array([x for own in ids for x in (*own, end_id)], IDS), sizes
        if len(self.known) > self.MOST or len(self.flat) > self.MOST_IDS:
            self._forget()
        texts = texts.cast(pa.large_binary()).fill_null(b"")
        bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
        bounds = bounds - bounds[0]
        if not len(data):
            return np.full(len(texts), end_id, IDS), np.ones(len(texts), np.int64)
        starts = chunk_starts(data)
        starts[bounds[:-1][np.diff(bounds) > 0]] = True
        begins = np.flatnonzero(starts)
        ends = np.append(begins, len(data)).astype(np.int64)
        buffers = [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))]
        chunks = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begins), buffers).dictionary_encode()
        numbers = self._numbers(chunks.dictionary.to_pylist())[chunks.indices.to_numpy()]
        sizes = self.begin[numbers + 1] - self.begin[numbers]
        behind = np.cumsum(sizes)
        spots = np.repeat(self.begin[numbers] - behind + sizes, sizes)
        spots += np.arange(behind[-1])
        upto = np.concatenate([[0], behind])[np.searchsorted(ends, bounds)]
        return np.insert(self.flat[spots], upto[1:], end_id), np.diff(upto) + 1


def byte_chunks(path: str) -> ByteChunks:
    return kept(f"byte chunks {path}", lambda: ByteChunks(path))


def by_bytes(batches: Iterator[pa.RecordBatch], name: str, most: int = TOGETHER) -> Iterator[pa.RecordBatch]:
    """The batches in parts of about ``most`` bytes of that column, one row at least."""
    for batch in batches:
        texts = batch.column(name).cast(pa.large_binary())
        bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else []
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + most, "right")) - 1)
            yield batch.slice(at, end - at)
            at = end
