"""Packing by power-of-two decomposition.

A document of n tokens is cut into n // size whole sequences and one piece for
each one-bit of the remainder, longest first. Pieces of one length fill
sequences of their own, size // length to a sequence, so only the last sequence
of each length is short, and no piece is cut again.
"""

from __future__ import annotations

import functools
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import frames, units

SIZE, END_ID = 2048, 1
#: Different words that a worker remembers the ids of.
REMEMBERED = 1 << 19
#: Pieces that are numbered in one go.
NUMBERED = 50_000


@functools.lru_cache(maxsize=1)
def _encoder(path: str):
    """text -> ids of the tokenizer in the file, special tokens' strings as the file has them.

    Where merges and ids stand in the same order (byte-level BPE), a faster
    library gives the same ids from the same file's vocabulary.
    """
    import json

    import tiktoken
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab, merges = spec["model"].get("vocab"), spec["model"].get("merges") or []
    special = [x["content"] for x in spec.get("added_tokens") or []]
    plain = bytes(range(33, 127)) + bytes(range(161, 173)) + bytes(range(174, 256))
    letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
    pre = spec.get("pre_tokenizer") or {}
    simple = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)

    def encode_slow(text: str) -> list[int]:
        return slow.encode(text, add_special_tokens=False).ids

    if not (simple and spec["model"].get("type") == "BPE" and all(vocab.get(a + b) == 256 + i for i, (a, b) in enumerate(pairs))):
        return encode_slow, special
    ranks = {bytes(letters[c] for c in t): i for t, i in vocab.items() if t not in special}
    # the pre-tokenizer's fixed pattern
    pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    fast = tiktoken.Encoding("bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    return (lambda text: encode_slow(text) if any(s in text for s in special) else fast(text)), special


def _parts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of parts that can be encoded apart: texts, and white space after a character
    that is none (the pre-tokenizer always cuts there)."""
    n = len(raw)
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    back = [np.concatenate([np.zeros(k, np.uint8), raw[: n - k]]) if n > k else np.zeros(n, np.uint8) for k in (1, 2, 3, 4)]
    one = (back[0] > 32) & (back[0] < 127)
    two = (back[0] >= 128) & (back[1] >= 0xC3) & (back[1] <= 0xDF)
    three = (back[0] >= 128) & (back[1] >= 128) & (back[1] < 0xC0) & ((back[2] == 0xE0) | ((back[2] >= 0xE4) & (back[2] <= 0xEF)))
    four = (back[0] >= 128) & (back[3] >= 0xF0)
    cut = space & (one | two | three | four)
    starts = offsets[:-1]
    cut[starts[starts < n]] = True
    return np.flatnonzero(cut)


class _Ids:
    """Ids of parts by hash; starts anew when it holds too many."""

    def __init__(self, path: str):
        self.encode, _ = _encoder(path)
        self.clear()

    def clear(self):
        self.known, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def look_up(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        """Ids of all parts one after the other, and their number by part."""
        h = units.word_hashes(raw, starts, ends)
        found, first, back = np.unique(h, return_index=True, return_inverse=True)
        new = ~np.isin(found, self.known, assume_unique=True)
        if new.any():
            if len(self.known) + int(new.sum()) > REMEMBERED:
                self.clear()
                new = np.ones(len(found), bool)
            data = raw.tobytes()
            got = [self.encode(data[s:e].decode("utf-8", "replace")) for s, e in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)]
            sizes = np.array([len(x) for x in got], np.int64)
            at = len(self.ids) + np.cumsum(sizes) - sizes
            self.ids = np.concatenate([self.ids, np.array([i for x in got for i in x], np.uint32)])
            known = np.concatenate([self.known, found[new]])
            o = np.argsort(known, kind="stable")
            self.known, self.at, self.size = known[o], np.concatenate([self.at, at])[o], np.concatenate([self.size, sizes])[o]
        k = np.searchsorted(self.known, found)[back]
        return self.ids[frames.ranges(self.at[k], self.size[k])], self.size[k]


def lengths(n: int, size: int = SIZE) -> list[int]:
    """Lengths of the pieces of n tokens."""
    rest = n % size
    return [size] * (n // size) + [1 << k for k in range(size.bit_length() - 1, -1, -1) if rest >> k & 1]


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """Pieces of each row of docs: id, th (tells texts apart), start, length, ids_crc32,
    doc_tokens and ids. Null texts are empty: one piece that holds the end id alone."""

    def cut(batches):
        frames.steady_heap()
        ids = _Ids(tokenizer)
        for rb in batches:
            raw, offsets = units.text_buffer(rb.column("text"))
            did, th = rb.column("doc"), rb.column("th")
            for a, b in units.slices(np.diff(offsets)):
                part, at = raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                starts = _parts(part, at) if len(part) else np.zeros(0, np.int64)
                flat, counts = ids.look_up(part, starts, np.append(starts[1:], len(part))) if len(starts) else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
                total = np.concatenate([[0], np.cumsum(counts)])[np.searchsorted(starts, at)]
                rows, begin, length, crc, tokens, values = [], [], [], [], [], []
                for i in range(b - a):
                    mine = np.append(flat[total[i] : total[i + 1]], np.uint32(end_id)).astype("<u4")
                    data, s = mine.tobytes(), 0
                    for n in lengths(len(mine), size):
                        rows.append(a + i)
                        begin.append(s)
                        length.append(n)
                        crc.append(zlib.crc32(data[4 * s : 4 * (s + n)]))
                        tokens.append(len(mine))
                        values.append(data[4 * s : 4 * (s + n)])
                        s += n
                take = pa.array(rows, pa.int64())
                yield frames.batch(doc=did.take(take), th=th.take(take), start=pa.array(begin, pa.int64()), length=pa.array(length, pa.int64()), ids_crc32=pa.array(crc, pa.int64()), doc_tokens=pa.array(tokens, pa.int64()), ids=pa.array(values, pa.binary()))

    source = frames.small_batches(docs).select(F.col(id_col).alias("doc"), frames.row_key(text_col).alias("th"), frames.text_column(text_col).alias("text"))
    kind = source.schema["doc"].dataType.simpleString()
    return source.mapInArrow(cut, f"doc {kind}, th long, start long, length long, ids_crc32 long, doc_tokens long, ids binary").withColumnRenamed("doc", id_col)


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """Pieces of all rows of docs with sequence_id and offset.

    tokenizer: path of a file of the tokenizers library, there on all machines.
    Sequences hold pieces of one length; their ids count up from 0, longest
    pieces first. with_ids: also the ids (4 little-endian bytes each). Rows that
    repeat each have pieces of their own. An empty table gives no rows.
    """
    cut = pieces(docs, tokenizer, id_col, text_col, size, end_id)
    cut = frames.staged(cut if with_ids else cut.drop("ids"), "pieces")
    groups = cut.count() // NUMBERED + 1
    cut = cut.withColumn("group", F.pmod(F.xxhash64(id_col, "th", "start"), F.lit(groups)))
    counts = cut.groupBy("length", "group").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("length", "group", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    # sequences of longer pieces come first: one row for each length, 12 at most
    every = Window.orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy("length").agg(F.count("*").alias("n")).withColumn("sequences", F.ceil(F.col("n") * F.col("length") / F.lit(size)).cast("long"))
    totals = totals.select("length", F.coalesce(F.sum("sequences").over(every), F.lit(0)).alias("base"))
    places = counts.join(F.broadcast(totals), "length")
    rank = F.row_number().over(Window.partitionBy("length", "group").orderBy(id_col, "th", "start")).cast("long") - 1
    numbered = cut.withColumn("rank", rank).join(places, ["length", "group"])
    place, per = F.col("rank") + F.col("before"), (F.lit(size) / F.col("length")).cast("long")
    out = numbered.withColumn("sequence_id", F.col("base") + F.floor(place / per).cast("long")).withColumn("offset", F.pmod(place, per) * F.col("length"))
    return out.select(id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else []))
