"""Suffix-array dedup: bytes of strings that occur earlier in the corpus go.

Suffixes (at content-chosen anchors, see `repeats`) are range-partitioned by
their leading bytes with splitters from a sample; each bucket sorts its suffixes
by multikey quicksort, eight bytes a key, and neighbours of sufficient common
length are repeats. Suffixes that agree in a gram never stand on two sides of a
border, so buckets need no comparison across it, but for a gram that fills
several buckets: its suffixes are dealt over them and compared across.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import frames, repeats, units

#: Bytes of a string that must repeat, and of the grams that anchors begin.
WINDOW, GRAM = 100, 32
_PREFIX = 24


def _keys(rows: np.ndarray, width: int) -> np.ndarray:
    """Leading bytes as values that compare like the bytes; a 1 at the end keeps zeros."""
    out = np.ones((len(rows), width + 1), np.uint8)
    out[:, :width] = rows[:, :width]
    return out.view(f"S{width + 1}").ravel()


def multikey_quicksort(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort rows of unsigned keys by three-way partitions, all open segments of rows in one pass.

    A segment is rows that agree in their first `depth` keys. Its pivot is the median of
    three of its keys at `depth`; rows below, at and above it become segments, and the rows at
    it go on to the next key. Returns the order, and for each place the number of keys that its
    row shares with the row before (all: equal rows; first: 0).
    """
    n, width = keys.shape
    order, shared = np.arange(n), np.zeros(n, np.int64)
    start, size, depth = np.array([0]), np.array([n]), np.array([0])
    while True:
        ended = depth == width
        shared[frames.ranges(start[ended] + 1, size[ended] - 1)] = width
        more = ~ended & (size > 1)
        start, size, depth = start[more], size[more], depth[more]
        if not len(start):
            return order, shared
        three = np.sort(np.stack([keys[order[start + at], depth] for at in (0 * size, size // 2, size - 1)]), axis=0)
        at = frames.ranges(start, size)
        first = np.cumsum(size) - size  # of each segment, in `at`
        row = order[at]
        key, pivot = keys[row, np.repeat(depth, size)], np.repeat(three[1], size)
        place, cuts = np.empty(len(at), np.int64), [start]
        for part in (key < pivot, key == pivot, key > pivot):
            count = np.concatenate([[0], np.cumsum(part)])
            mine = count[first + size] - count[first]
            place[part] = (np.repeat(cuts[-1] - count[first], size) + count[:-1])[part]
            cuts.append(cuts[-1] + mine)
        order[place] = row
        for a, b in ((1, 3), (2, 3)):  # rows on two sides of a border differ in this key
            inner = (cuts[a] > start) & (cuts[a] < cuts[b])
            shared[cuts[a][inner]] = depth[inner]
        sizes = [b - a for a, b in zip(cuts, cuts[1:], strict=False)]
        start, size, depth = np.concatenate(cuts[:3]), np.concatenate(sizes), np.concatenate([depth, depth + 1, depth])


class SuffixArray:
    """Rows of bytes in order, and the bytes that each shares with the one before."""

    def __init__(self, rows: np.ndarray):
        n, width = rows.shape
        padded = np.zeros((n, -(-width // 8) * 8), np.uint8)
        padded[:, :width] = rows
        self.order, eights = multikey_quicksort(padded.view(">u8").astype(np.uint64))
        self.shared = np.minimum(eights * 8, width)
        # within the eight bytes that differ
        at = np.flatnonzero((self.shared < width) & (np.arange(n) > 0))
        a = padded[self.order[at][:, None], self.shared[at][:, None] + np.arange(8)]
        b = padded[self.order[at - 1][:, None], self.shared[at][:, None] + np.arange(8)]
        self.shared[at] = np.minimum(self.shared[at] + (a != b).argmax(axis=1), width)

    def cut(self, depth: int) -> np.ndarray:
        new = self.shared < depth
        new[0] = True
        run = np.cumsum(new) - 1
        out = np.empty(len(run), np.int64)
        out[self.order] = np.where(np.bincount(run)[run] > 1, run, -1)
        return out


class SuffixOrder:
    """Range partition by sampled splitters; where a sample can't split enough, ranges are split by
    the hash of the suffixes' grams."""

    def __init__(self, sample: np.ndarray, buckets: int):
        self.width = min(_PREFIX, sample.shape[1])
        keys = np.sort(_keys(sample, self.width))
        ranges = min(buckets, len(keys) // repeats.SLICES + 1)
        at = np.arange(1, ranges) * len(keys) // ranges
        self.splitters = np.unique(keys[at])
        self.parts = -(-buckets // (len(self.splitters) + 1)) if ranges < buckets else 1

    def route(self, right: np.ndarray, grams: np.ndarray) -> np.ndarray:
        to = np.searchsorted(self.splitters, _keys(right, self.width), "right")
        return to * self.parts + (grams % np.uint64(self.parts)).astype(np.int64)

    def index(self, rows: np.ndarray) -> SuffixArray:
        return SuffixArray(rows)


def spec(window: int = WINDOW) -> repeats.Spec:
    return repeats.Spec("bytes", window, max(8, window * GRAM // WINDOW) if window >= 26 else max(1, window // 2), True, SuffixOrder, max(1, window // 3))


def dedup_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, keep: tuple[str, ...] = (), as_text: bool = False) -> DataFrame:
    """Like dedup(), but the id and the columns in `keep` are fields of one column `own`: they may
    have any names."""
    s = spec(window)
    keyed = docs.select(frames.id_column(id_col).alias("did"), frames.row_key(text_col).alias("th"), frames.text_column(text_col).alias("text"), F.struct(F.col(id_col), *(F.col(f"`{c}`") for c in keep)).alias("own"))

    def kept(batches):
        for rb in batches:
            raw, offsets = units.text_buffer(rb.column("text"))
            spans, own = rb.column("spans"), rb.column("own")
            for a, b in units.slices(np.diff(offsets)):
                rest, sizes, gone, runs = [], [], [], []
                for i in range(a, b):
                    text = raw[offsets[i] : offsets[i + 1]]
                    mask = repeats.removed_mask(spans[i].as_py(), len(text))
                    rest.append(text[~mask].tobytes() if mask.any() else text.tobytes())
                    sizes.append(len(text))
                    gone.append(int(mask.sum()))
                    runs.append(int(np.count_nonzero(mask[1:] & ~mask[:-1]) + (len(mask) > 0 and mask[0])))
                yield frames.batch(own=own.slice(a, b - a), n_bytes=pa.array(sizes, pa.int64()), n_removed=pa.array(gone, pa.int64()), n_spans=pa.array(runs, pa.int64()), kept=pa.array([x.decode("utf-8", "ignore") for x in rest] if as_text else rest, pa.string() if as_text else pa.binary()))

    own = keyed.schema["own"].dataType.simpleString()
    return repeats.removed_spans(keyed, s).mapInArrow(kept, f"own {own}, n_bytes long, n_removed long, n_spans long, kept {'string' if as_text else 'binary'}")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, keep: tuple[str, ...] = (), as_text: bool = False) -> DataFrame:
    """One row per row of docs: id, the columns in `keep`, n_bytes, n_removed, n_spans and
    `kept`, the remaining bytes.

    A byte goes if a string of `window` bytes covers it that also starts earlier:
    in a row with a smaller id, or in the same id at an earlier byte. Null texts
    are empty; null ids come last; rows that repeat an id count as one document,
    and where they agree at the same byte both stay; rows equal in id and text have
    equal results. Texts may be of any length. An empty table gives no rows. Columns not
    named are left out; those of `keep` mustn't have the results' names (see dedup_rows).
    as_text: `kept` is a string, without what is left of characters that a cut has split.
    """
    return dedup_rows(docs, id_col, text_col, window, keep, as_text).select("own.*", "n_bytes", "n_removed", "n_spans", "kept")
