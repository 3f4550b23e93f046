"""Words of many texts at once as hash buckets, found with numpy on their bytes."""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from quillmark.llm.worker import kept

SPACE, LETTER, DIGIT, MARK = range(4)
#: Bytes looked at together; longer texts are looked at in parts, cut at white space if there is any.
PART = 1 << 20
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
MIX = np.uint64(0xD6E8FEB86659FD93)


def _kinds() -> np.ndarray:
    kinds = np.full(256, MARK, np.uint8)
    kinds[:33] = SPACE
    kinds[[*range(65, 91), *range(97, 123), *range(128, 256)]] = LETTER
    kinds[48:58] = DIGIT
    return kinds


KINDS = _kinds()


def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, up to a part and a bit."""
    both = []
    for base in (BASE, INVERSE):
        factors = np.full(2 * PART + 1, base, np.uint64)
        factors[0] = 1
        both.append(np.multiply.accumulate(factors))
    return both[0], both[1]


@dataclass
class Words:
    """Words of some texts, in order: text (its number), begin, end, kind, and the hash of their prefixes."""

    data: np.ndarray
    text: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    kind: np.ndarray
    sums: np.ndarray

    def hashes(self, most: int = 1 << 62) -> np.ndarray:
        """Hash of each word's first ``most`` bytes, small and capital ASCII letters alike."""
        last = np.minimum(self.end, self.begin + most)
        spread = (self.sums[last] - self.sums[self.begin]) * kept("word_powers", _powers)[1][self.begin]
        return (spread ^ (spread >> np.uint64(29))) * MIX

    def capitals(self) -> np.ndarray:
        """How many capital ASCII letters each word has."""
        counts = np.concatenate([[0], np.cumsum((self.data >= 65) & (self.data <= 90))])
        return counts[self.end] - counts[self.begin]


def parts(texts: list[str], most: int = PART) -> Iterator[list[tuple[int, bytes]]]:
    """The texts' bytes in groups of about ``most`` bytes; a text longer than ``PART`` comes in several parts."""
    group, size = [], 0
    for n, text in enumerate(texts):
        data = text.encode()
        at = 0
        while at < len(data) or at == 0:
            end = min(len(data), at + PART)
            if end < len(data):
                space = max(data.rfind(b" ", at, end), data.rfind(b"\n", at, end))
                end = space + 1 if space > at else end
            if group and size + end - at > most:
                yield group
                group, size = [], 0
            group.append((n, data[at:end]))
            size += end - at + 1
            at = end
            if not data:
                break
    if group:
        yield group


def words(group: list[tuple[int, bytes]]) -> Words:
    """All runs of letters, of digits and of marks in a group of parts; they end where a part ends."""
    data = np.frombuffer(b"\n".join(d for _, d in group) + b"\n", np.uint8)
    ends = np.cumsum([len(d) + 1 for _, d in group])
    kinds = KINDS[data]
    change = np.flatnonzero(kinds[1:] != kinds[:-1]) + 1
    bounds = np.concatenate([[0], change, [len(data)]])
    kind = kinds[bounds[:-1]]
    keep = kind != SPACE
    begin, end, kind = bounds[:-1][keep], bounds[1:][keep], kind[keep]
    lower = np.where((data >= 65) & (data <= 90), data + 32, data)
    powers = kept("word_powers", _powers)[0]
    sums = np.concatenate([[np.uint64(0)], np.cumsum((lower.astype(np.uint64) + np.uint64(1)) * powers[: len(data)])])
    numbers = np.array([n for n, _ in group])
    return Words(data, numbers[np.searchsorted(ends, begin, "right")], begin, end, kind, sums)
