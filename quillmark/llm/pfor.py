"""Patched frame-of-reference blocks of unsigned 32-bit integers.

A block holds up to ``BLOCK`` values less their minimum, packed at one width.
The width is that of a percentile of the block, the one of ``PERCENTILES`` that
makes the block smallest; values too wide for it keep their low bits in place
and have position and high bits in an exception list behind the packed words.

Block: minimum u4, values u2, exceptions u2, width u1 and three zero bytes,
packed words, exception positions u2, exception high bits u4. Little-endian.
"""

import numpy as np

BLOCK = 1024
LANES = 64
PERCENTILES = (0.9, 0.95, 0.98, 1.0)
HEAD = np.dtype([("least", "<u4"), ("values", "<u2"), ("patches", "<u2"), ("width", "u1"), ("zero", "u1", 3)])


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of BLOCK values below 2**width as rows of 64-bit words."""
    lanes = np.ascontiguousarray(values.reshape(-1, LANES).T)
    words = np.zeros((width, lanes.shape[1]), np.uint64)
    for lane in range(LANES):
        word, shift = divmod(lane * width, 64)
        words[word] |= lanes[lane] << np.uint64(shift)
        if shift + width > 64:
            words[word + 1] |= lanes[lane] >> np.uint64(64 - shift)
    return np.ascontiguousarray(words.T).reshape(len(values), -1)


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    rows = len(words)
    words = np.ascontiguousarray(words.reshape(-1, width).T)
    lanes = np.empty((LANES, words.shape[1]), np.uint64)
    mask = np.uint64((1 << width) - 1)
    for lane in range(LANES):
        word, shift = divmod(lane * width, 64)
        value = words[word] >> np.uint64(shift)
        if shift + width > 64:
            value = value | words[word + 1] << np.uint64(64 - shift)
        lanes[lane] = value & mask
    return np.ascontiguousarray(lanes.T).reshape(rows, BLOCK)


def _widths(offsets: np.ndarray) -> np.ndarray:
    """Width of each block: of the candidates, the one with the fewest bytes."""
    bits = np.frexp(offsets.astype(np.float64))[1]
    rows = np.arange(len(offsets))[:, None]
    counts = np.bincount((rows * 33 + bits).ravel(), minlength=len(offsets) * 33).reshape(-1, 33)
    below = counts.cumsum(axis=1)
    choices = np.stack([(below >= np.ceil(p * BLOCK)).argmax(axis=1) for p in PERCENTILES])
    patches = BLOCK - below[np.arange(len(offsets)), choices]
    cost = choices * (BLOCK // 8) + patches * 6
    return choices[cost.argmin(axis=0), np.arange(len(offsets))]


def encode(values: np.ndarray) -> list[bytes]:
    """The blocks of some values; only the last may be short."""
    short = -len(values) % BLOCK
    if not len(values):
        return []
    padded = np.append(values, np.full(short, values[-1], values.dtype)).reshape(-1, BLOCK)
    least = padded.min(axis=1)
    offsets = (padded - least[:, None]).astype(np.uint64)
    widths = _widths(offsets)
    blocks: list[bytes] = [b""] * len(padded)
    for width in np.unique(widths).tolist():
        rows = np.flatnonzero(widths == width)
        own = offsets[rows]
        packed = _pack(own & np.uint64((1 << width) - 1), width) if width else None
        high = (own >> np.uint64(width)).astype("<u4")
        for n, row in enumerate(rows.tolist()):
            size = BLOCK - short if row == len(padded) - 1 else BLOCK
            at = np.flatnonzero(high[n, :size])
            head = np.array([(least[row], size, len(at), width, 0)], HEAD).tobytes()
            body = packed[n].tobytes() if width else b""
            blocks[row] = head + body + at.astype("<u2").tobytes() + high[n, at].tobytes()
    return blocks


def decode(data: bytes, starts: np.ndarray) -> np.ndarray:
    """The values of blocks that begin at ``starts`` in ``data``, one after the other."""
    if not len(starts):
        return np.empty(0, np.uint32)
    raw = np.frombuffer(data, np.uint8)
    heads = raw[starts[:, None] + np.arange(HEAD.itemsize)].copy().view(HEAD)[:, 0]
    out = np.empty((len(starts), BLOCK), np.uint64)
    for width in np.unique(heads["width"]).tolist():
        rows = np.flatnonzero(heads["width"] == width)
        begin = starts[rows] + HEAD.itemsize
        size = BLOCK // 8 * width
        if width:
            words = raw[begin[:, None] + np.arange(size)].view("<u8")
            out[rows] = _unpack(words, width)
        else:
            out[rows] = 0
        for row, at in zip(rows.tolist(), (begin + size).tolist()):
            if n := int(heads["patches"][row]):
                spots = np.frombuffer(data, "<u2", n, at)
                high = np.frombuffer(data, "<u4", n, at + 2 * n).astype(np.uint64)
                out[row, spots] |= high << np.uint64(width)
    out += heads["least"].astype(np.uint64)[:, None]
    full = heads["values"] == BLOCK
    if full.all():
        return out.astype(np.uint32).ravel()
    return out.astype(np.uint32)[np.arange(BLOCK) < heads["values"][:, None]]
