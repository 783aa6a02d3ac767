"""Vectorised text units: words, shingles and content-chosen anchors.

Everything here works on one buffer of many texts at a time with numpy, so
that the cost per text is a few array passes and not a Python loop per word.
Hashes are 64-bit polynomial sums (wrapping) over random unit values, so the
hash of any run of units comes from two prefix sums.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa

SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: Bytes of text that are worked on at once.
CHUNK = 1 << 18


@functools.cache
def _table() -> np.ndarray:
    """A fixed random 64-bit value for each byte."""
    return np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.empty(n, np.uint64), np.empty(n, np.uint64)
    up[0] = down[0] = 1
    up[1:], down[1:] = _BASE, _INVERSE
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse."""
    size = 1 << max(16, int(n - 1).bit_length() if n > 1 else 0)
    up, down = _powers(size)
    return up[:n], down[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xA24BAED4963EE407)
    h ^= h >> np.uint64(29)
    return h


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] for each pair; equal runs hash alike wherever they stand."""
    n = len(values)
    up, down = powers(n + 1)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(values * up[:n], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and n + 1 offsets into them; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_binary()) if column.type not in (pa.large_binary(),) else column
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(sizes: np.ndarray, most: int = 8 * CHUNK):
    """(from, to) ranges of rows whose sizes add up to about `most`; one row at least."""
    at, n = 0, len(sizes)
    total = np.concatenate([[0], np.cumsum(sizes)])
    while at < n:
        to = max(at + 1, int(np.searchsorted(total, total[at] + most, "right")) - 1)
        yield at, to
        at = to


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    """A-Z to a-z, all other bytes unchanged."""
    return np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words [^ \\t-\\r]+ of each text, and n + 1 word offsets by text."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = (raw != 32) & ((raw < 9) | (raw > 13))
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    inner = offsets[1:-1]
    inner = inner[inner < n]
    first[inner] = solid[inner]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    ends_at = inner[inner > 0] - 1
    last[ends_at] = solid[ends_at]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return run_hashes(_table()[raw], starts, ends) if len(starts) else np.zeros(0, np.uint64)


def byte_values(raw: np.ndarray) -> np.ndarray:
    return _table()[raw]


def pieces(offsets: np.ndarray, window: int, most: int = CHUNK):
    """Cut texts into pieces of at most about `most` units for one pass.

    Yields lists of (text, from, to) whose units add up to about `most`. A text
    longer than that becomes several pieces that overlap by window - 1 units,
    so that each window of a text starts in exactly one piece.
    """
    some, held = [], 0
    for i in range(len(offsets) - 1):
        at, end = int(offsets[i]), int(offsets[i + 1])
        while end - at > most + window:
            yield [(i, at, at + most + window - 1)]
            at += most
        if end - at >= window:
            some.append((i, at, end))
            held += end - at
        if held >= most:
            yield some
            some, held = [], 0
    if some:
        yield some


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` consecutive values, by doubling."""
    n, span, least = len(values), 1, values
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    return np.minimum(least[: n - width + 1], least[width - span :]) if span < width else least


def gram_hashes(values: np.ndarray, gram: int) -> np.ndarray:
    """Hash of each run of `gram` consecutive values."""
    n = len(values)
    up, down = powers(n + 1)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(values * up[:n], out=sums[1:])
    h = sums[gram:] - sums[: n + 1 - gram]
    h *= down[: n + 1 - gram]
    h += np.uint64(gram)
    return mix(h)


def anchors(values: np.ndarray, lengths: np.ndarray, gram: int, window: int):
    """Content-chosen anchors of every window of `window` units.

    values: 64-bit units of pieces that stand one after the other, lengths:
    units by piece (each at least `window`). A window's anchor is the start of
    its gram of `gram` units with the least hash, leftmost first: it depends
    on the window's content only, so equal windows have equal anchors.

    Returns for each anchor its position, the hash of its gram, and the first
    and last start of the windows that it stands for; all int64 but the hash.
    """
    n = len(values)
    if n < window:
        return (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    hashes = gram_hashes(values, gram)
    bits = np.uint64(max(20, int(n).bit_length()))
    keyed = hashes >> bits
    keyed <<= bits
    keyed |= np.arange(len(hashes), dtype=np.uint64)
    least = _sliding_min(keyed, window - gram + 1)
    least &= np.uint64((1 << int(bits)) - 1)
    least = least.astype(np.int64)
    # a window must lie in one piece
    ends = np.cumsum(lengths)
    valid = np.zeros(n + 1, np.int32)
    np.add.at(valid, ends - lengths, 1)
    np.add.at(valid, ends - window + 1, -1)
    valid = np.cumsum(valid[: len(least)]) > 0
    # a run of windows with one anchor: it begins where the anchor changes or windows become valid
    change = np.empty(len(least) + 1, bool)
    change[0] = change[-1] = True
    np.not_equal(least[1:], least[:-1], out=change[1:-1])
    change[1:-1] |= valid[1:] != valid[:-1]
    new = np.flatnonzero(change)
    first, last = new[:-1], new[1:] - 1
    keep = valid[first]
    first, last = first[keep], last[keep]
    return least[first], hashes[least[first]], first, last
