"""Substring dedup on words with prefix-partitioned suffix trees.

Suffixes (at content-chosen anchors, see `repeats`) are grouped by prefixes of
variable length: a prefix that a sample finds too frequent for one group is
lengthened by a word, as often as needed. Each group's suffix tree is built top
down, a word at a time: a node stands where the next words of suffixes with a
common prefix differ. Only suffixes below a node as deep as a window asks for
repeat; with the tree of the reversed prefixes its nodes give the maximal
repeats. Words are compared by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import frames, repeats, units

#: Words of a sequence that must repeat, and of the grams that anchors begin.
WINDOW, GRAM = 50, 8


def _prefix(rows: np.ndarray, words: int) -> np.ndarray:
    h = np.full(len(rows), words, np.uint64)
    for k in range(words):
        h = units.mix(h + rows[:, k])
    return h


class SuffixTree:
    """The internal nodes of a tree of rows of words: depth (words that all rows below share),
    parent, and the rows below as a range of `order`. Rows that are equal end in a node as deep
    as they are long."""

    def __init__(self, rows: np.ndarray):
        n, width = rows.shape
        order, inner = np.arange(n), np.full(n, -1)  # the lowest node so far above each place
        nodes: list[tuple[np.ndarray, ...]] = []
        made = 0
        first, size = np.array([0]), np.array([n])  # runs of rows that share `d` words, two rows at least
        for d in range(width + 1):
            if not len(first):
                break
            at, start = frames.ranges(first, size), np.cumsum(size) - size
            run = np.repeat(np.arange(len(first)), size)
            if d < width:
                key = rows[order[at], d]
                o = np.lexsort((key, run))
                order[at], key = order[at[o]], key[o]
                new = np.ones(len(at), bool)
                new[1:] = (key[1:] != key[:-1]) | (run[1:] != run[:-1])
                splits = np.add.reduceat(new, start) > 1
            else:
                new, splits = np.zeros(len(at), bool), np.ones(len(first), bool)
            if splits.any():
                count = int(splits.sum())
                nodes.append((np.full(count, d), inner[first[splits]], first[splits], size[splits]))
                inner[frames.ranges(first[splits], size[splits])] = np.repeat(np.arange(made, made + count), size[splits])
                made += count
            if d < width:
                head = np.flatnonzero(new)
                first, size = at[head], np.diff(np.append(head, len(at)))
                first, size = first[size > 1], size[size > 1]
        self.order = order
        self.depth, self.parent, self.first, self.size = (np.concatenate(x) for x in zip(*nodes, strict=True)) if nodes else np.zeros((4, 0), np.int64)

    def cut(self, depth: int) -> np.ndarray:
        """For each row the topmost node above it that is as deep as that; -1: none."""
        above = np.where(self.parent < 0, -1, self.depth[self.parent])
        top = np.flatnonzero((self.depth >= depth) & (above < depth))
        out = np.full(len(self.order), -1)
        out[self.order[frames.ranges(self.first[top], self.size[top])]] = np.repeat(top, self.size[top])
        return out


class PrefixTrees:
    """Groups of suffixes by prefixes of variable length, and their trees."""

    def __init__(self, sample: np.ndarray, buckets: int):
        self.buckets, self.long = buckets, []
        most = max(1, len(sample) // (2 * buckets))
        rest = sample
        for words in range(1, sample.shape[1]):
            if buckets == 1 or not len(rest):
                break
            found, back, count = np.unique(_prefix(rest, words), return_inverse=True, return_counts=True)
            self.long.append(found[count > most])
            rest = rest[count[back] > most]

    def route(self, right: np.ndarray, grams: np.ndarray) -> np.ndarray:
        group = _prefix(right, 1)
        open_ = np.arange(len(right))
        for words, long in enumerate(self.long, 1):
            open_ = open_[np.isin(group[open_], long)]
            if not len(open_):
                break
            group[open_] = _prefix(right[open_], words + 1)
        return (group % np.uint64(self.buckets)).astype(np.int64)

    def index(self, rows: np.ndarray) -> SuffixTree:
        return SuffixTree(rows)


def spec(window: int = WINDOW) -> repeats.Spec:
    return repeats.Spec("words", window, max(1, window * GRAM // WINDOW), False, PrefixTrees, max(1, 3 * window))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: id, the columns in `keep`, n_words, n_removed and `kept`,
    the remaining words joined by one space.

    Words are [^ \\t-\\r]+, unchanged. A word goes if a window of `window` words
    covers it whose words also stand one after the other in a row with a smaller
    id. Null texts have no words; null ids come last; rows that repeat an id
    don't count against each other, and rows equal in id and text have equal results.
    Texts may be of any length. An empty table gives no rows. Columns not named are left out;
    those of `keep` mustn't have the results' names.
    """
    s = spec(window)
    keyed = docs.select(frames.id_column(id_col).alias("did"), frames.row_key(text_col).alias("th"), frames.text_column(text_col).alias("text"), F.struct(F.col(id_col), *(F.col(c) for c in keep)).alias("own"))

    def kept(batches):
        for rb in batches:
            raw, offsets = units.text_buffer(rb.column("text"))
            spans, own = rb.column("spans"), rb.column("own")
            for a, b in units.slices(np.diff(offsets)):
                part = raw[offsets[a] : offsets[b]]
                starts, ends, at = units.words(part, offsets[a : b + 1] - offsets[a])
                # each word with the space after it, in one buffer
                index = frames.ranges(starts, ends - starts + 1)
                spaced = np.append(part, np.uint8(32))[index] if len(index) else np.zeros(0, np.uint8)
                sizes = ends - starts + 1
                cuts = np.concatenate([[0], np.cumsum(sizes)])
                spaced[cuts[1:] - 1] = 32
                rest, gone = [], []
                for i in range(a, b):
                    s, e = int(at[i - a]), int(at[i - a + 1])
                    mask = repeats.removed_mask(spans[i].as_py(), e - s)
                    text = spaced[cuts[s] : cuts[e]]
                    if mask.any():
                        text = text[np.repeat(~mask, sizes[s:e])]
                    rest.append(text[:-1].tobytes())
                    gone.append(int(mask.sum()))
                yield frames.batch(own=own.slice(a, b - a), n_words=pa.array(np.diff(at), pa.int64()), n_removed=pa.array(gone, pa.int64()), kept=pa.array(rest, pa.binary()).cast(pa.string()))

    own = keyed.schema["own"].dataType.simpleString()
    out = repeats.removed_spans(keyed, s).mapInArrow(kept, f"own {own}, n_words long, n_removed long, kept string")
    return out.select("own.*", "n_words", "n_removed", "kept")
