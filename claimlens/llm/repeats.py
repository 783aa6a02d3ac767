"""Windows of `window` units that occur more than once in a corpus.

The common frame of substring dedup (units are words) and suffix-array dedup
(units are bytes). Suffixes that begin at every unit would make a corpus many
times larger in a shuffle, so only suffixes at content-chosen anchors travel:
each window's anchor is the start of its least-hashed gram. Equal windows have
equal anchors, so a window that repeats is found at its anchor, and each window
belongs to exactly one anchor.

1. Anchors' gram hashes are dealt by hash; those that occur once go no further.
   What a task has seen twice itself sends its hash once, with a count, so that a
   gram that fills the corpus doesn't fill a bucket. The counts also tell which
   grams would fill a bucket of step 3.
2. Around each remaining anchor, its context (all units of its windows) goes to
   the bucket of its suffix's leading units (`Order.route`).
3. A bucket indexes the suffixes to the right of the anchors and the reversed
   prefixes to the left (`Order.index`). Windows that begin j units before their
   anchors are equal if their suffixes share window - j units and their
   prefixes share j: a group of the one index and one of the other meet. The
   first occurrence stays, the others are removed.
4. A gram so frequent that it would fill a bucket is dealt over all of them by
   places of documents; what each bucket keeps of its windows is then compared
   across buckets.
5. Each document gets its removed runs.

Rows equal in id and text are one document throughout: they lie side by side
after the join of step 2, where all but the first are skipped, and share the
result of step 5.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import frames, units

#: Bytes of text whose anchors meet in one bucket of step 1, and of steps 3 and 4.
FILTER_BYTES, BUCKET_BYTES = 6 << 20, 2 << 20
#: A gram with more suffixes than so many buckets hold on average is dealt over all.
SPREAD = 2
#: Slices of text that are sampled for each bucket's border, at most in all (the driver holds 7 suffixes
#: or so of each), and their characters. They only affect balance: beyond it, buckets split by hash.
SLICES, MOST_SLICES, SLICE = 16, 8192, 2048
#: Anchors, and bytes of contexts, that a task gathers before it sends them.
FLUSH_ANCHORS, FLUSH_BYTES = 1 << 18, 6 << 20
#: Buckets over which the places of one document that are known already are dealt.
SALTS = 16


class Groups(Protocol):
    """An index of rows by their leading units."""

    def cut(self, depth: int) -> np.ndarray:
        """For each row a number of the group of rows that share `depth` units with it; -1: no other does."""


class Order(Protocol):
    """How suffixes are dealt to buckets and indexed there."""

    def route(self, right: np.ndarray, grams: np.ndarray) -> np.ndarray:
        """Bucket of each suffix, from its units and its gram's hash."""

    def index(self, rows: np.ndarray) -> Groups:
        """Rows of units (at least two), indexed."""


@dataclass(frozen=True)
class Spec:
    kind: str  #: "bytes" or "words"
    window: int
    gram: int
    within: bool  #: an earlier start in the same document counts too
    plan: Callable[[np.ndarray, int], Order]  #: from a sample of suffixes and the number of buckets
    apart: int  #: units of text (bytes) for each anchor, about

    @property
    def left(self) -> int:
        return self.window - self.gram

    def units(self, raw: np.ndarray, offsets: np.ndarray):
        """Units as sent in contexts, 64-bit values for hashing, and offsets by text."""
        if self.kind == "bytes":
            return raw, None, offsets
        starts, ends, at = units.words(raw, offsets)
        values = units.word_hashes(raw, starts, ends)
        return values, values, at


def _found(spec: Spec, raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple]:
    """(units, text of each anchor, position, hash, first, last window start) of parts of a buffer.
    Positions count from the start of the buffer."""
    for a, b in units.slices(np.diff(offsets), 4 * units.CHUNK):
        part, values, at = spec.units(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        for some in units.pieces(at, spec.window, units.CHUNK if spec.kind == "bytes" else units.CHUNK // 4):
            sizes = np.array([e - s for _, s, e in some])
            v = np.concatenate([(units.byte_values(part[s:e]) if values is None else values[s:e]) for _, s, e in some])
            pos, h, first, last = units.anchors(v, sizes, spec.gram, spec.window)
            k = np.searchsorted(np.cumsum(sizes), pos, "right")
            shift = np.array([s for _, s, _ in some]) - (np.cumsum(sizes) - sizes)
            text = np.array([i for i, _, _ in some])[k]
            yield part, at, a, text, pos + shift[k], h, first + shift[k], last + shift[k]


def _columns(rb: pa.RecordBatch):
    did = rb.column("did").to_numpy(zero_copy_only=False)
    th = rb.column("th").to_numpy(zero_copy_only=False)
    return did, th, *units.text_buffer(rb.column("text"))


# --- 1: anchors that occur more than once -------------------------------------------------


def _new_rows(rb: pa.RecordBatch, seen: set) -> pa.RecordBatch:
    """The rows whose id and text weren't seen yet."""
    at = []
    for i, key in enumerate(zip(rb.column("did").to_numpy(zero_copy_only=False).tolist(), rb.column("th").to_numpy(zero_copy_only=False).tolist(), strict=True)):
        if key not in seen:
            seen.add(key)
            at.append(i)
    return rb if len(at) == rb.num_rows else rb.take(pa.array(at, pa.int64()))


def _filter_rows(spec: Spec, buckets: int):
    def rows(batches):
        frames.steady_heap()
        held, docs, seen, n, m = [], [], set(), 0, 0
        for rb in batches:
            did, th, raw, offsets = _columns(_new_rows(rb, seen))
            for _, at, a, text, pos, h, _, _ in _found(spec, raw, offsets):
                used, index = np.unique(text, return_inverse=True)
                docs.append((did[a + used], th[a + used]))
                held.append((_name(h), (m + index).astype(np.uint32), (pos - at[text]).astype(np.int64)))
                m += len(used)
                n += len(h)
                if n >= FLUSH_ANCHORS:
                    yield _filter_flush(held, docs, buckets)
                    held, docs, n, m = [], [], 0, 0
                    seen.clear()
        if n:
            yield _filter_flush(held, docs, buckets)

    return rows


def _filter_flush(held, docs, buckets):
    h, di, pos = (np.concatenate(x) for x in zip(*held, strict=True))
    did, th = (np.concatenate(x) for x in zip(*docs, strict=True))
    o = np.argsort(h, kind="stable")
    h, di, pos = h[o], di[o], pos[o]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    count = np.diff(np.append(first, len(h)))
    # one entry for each hash: with its place if it is alone, else with its count
    eh, alone = h[first], count == 1
    edi, epos, twice = di[first], pos[first], np.repeat(~alone, count)
    to = bucket_of(eh, buckets)
    kdi, kpos = di[twice], pos[twice]
    salt = units.mix(eh[:1])[0] % np.uint64(SALTS)
    spread = (units.mix((did ^ th).view(np.uint64) * np.uint64(SALTS) + salt) % np.uint64(buckets)).astype(np.int64)[kdi]
    o = np.argsort(spread, kind="stable")
    kdi, kpos, spread = kdi[o], kpos[o], spread[o]
    out_b = np.union1d(to, spread)
    out_p = []
    for s, e, q, r in zip(*(np.searchsorted(x, out_b, side) for x in (to, spread) for side in ("left", "right")), strict=True):
        one = alone[s:e]
        used, index = np.unique(np.concatenate([edi[s:e][one], kdi[q:r]]), return_inverse=True)
        n = int(one.sum())
        gaps = np.diff(eh[s:e], prepend=np.uint64(0))
        out_p.append(frames.pack(gaps, np.packbits(one), count[s:e][~one].astype(np.uint32), index[:n].astype(np.uint32), epos[s:e][one], index[n:].astype(np.uint32), kpos[q:r], did[used], th[used]))
    return frames.batch(bucket=pa.array(out_b, pa.int64()), payload=pa.array(out_p, pa.binary()))


def _name(grams: np.ndarray) -> np.ndarray:
    """48 bits for each gram's hash. Anchors have small hashes, these are spread evenly."""
    return units.mix(grams) >> np.uint64(16)


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of 48-bit hashes; rises with the hash."""
    return ((h >> np.uint64(16)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _filter_bucket(most: int):
    """Places of grams that occur in more than one entry, and of those known already, by document;
    grams that occur more than `most` times, in rows of their own (column hot)."""

    def bucket(pdf: pd.DataFrame) -> pd.DataFrame:
        frames.steady_heap()
        hs, counts, places, docs, known, base, m = [], [], [], [], [], 0, 0
        for value in pdf["payload"]:
            gaps, bits, count, di, pos, kdi, kpos, did, th = frames.unpack(value)
            h = np.cumsum(gaps)
            one = np.unpackbits(bits, count=len(h)).astype(bool)
            at, times = np.full(len(h), -1, np.int64), np.ones(len(h), np.int64)
            at[one] = np.arange(len(di)) + m
            times[~one] = count
            hs.append(h)
            counts.append(times)
            places.append((at, di.astype(np.int64) + base, pos))
            known.append((kdi.astype(np.int64) + base, kpos))
            docs.append((did, th))
            base += len(did)
            m += len(di)
        h, count, at = np.concatenate(hs), np.concatenate(counts), np.concatenate([x[0] for x in places])
        di, pos = np.concatenate([x[1] for x in places]), np.concatenate([x[2] for x in places])
        del hs, counts, places
        o = np.argsort(h, kind="stable")
        h, count, at = h[o], count[o], at[o]
        new = np.ones(len(h) + 1, bool)
        new[1:-1] = h[1:] != h[:-1]
        first = np.flatnonzero(new[:-1])
        hot = h[first][np.add.reduceat(count, first) > most] if len(first) else h
        shared = at[~(new[:-1] & new[1:])]
        shared = shared[shared >= 0]
        di = np.concatenate([di[shared], *(x[0] for x in known)])
        pos = np.concatenate([pos[shared], *(x[1] for x in known)])
        did, th = (np.concatenate(x) for x in zip(*docs, strict=True))
        did, th = did[di], th[di]
        o = np.lexsort((pos, th, did))
        did, th, pos = did[o], th[o], pos[o]
        # rows equal in id and text, in different entries, have their places once
        fresh = np.ones(len(did), bool)
        fresh[1:] = (did[1:] != did[:-1]) | (th[1:] != th[:-1]) | (pos[1:] != pos[:-1])
        did, th, pos = did[fresh], th[fresh], pos[fresh].astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], (did[1:] != did[:-1]) | (th[1:] != th[:-1])])) if len(did) else np.zeros(0, np.int64)
        parts = [p.tobytes() for p in np.split(pos, first[1:])] if len(first) else []
        none = [None] * len(hot)
        return pd.DataFrame({"did": np.concatenate([did[first], np.zeros(len(hot), np.int64)]), "th": np.concatenate([th[first], np.zeros(len(hot), np.int64)]), "pos": parts + none, "hot": pd.array([None] * len(first) + hot.astype(np.int64).tolist(), "Int64")})

    return bucket


# --- 2: contexts --------------------------------------------------------------------------


def _contexts(spec: Spec, part, at, text, pos):
    """Matrix of the units from pos - left to pos + window; zero where the text doesn't reach."""
    index = pos[:, None] + np.arange(-spec.left, spec.window)
    inside = (index >= at[text][:, None]) & (index < at[text + 1][:, None])
    return np.where(inside, part[np.clip(index, 0, len(part) - 1)], part.dtype.type(0))


def _context_rows(spec: Spec, order: Order, buckets: int, hot: np.ndarray):
    def rows(batches):
        frames.steady_heap()
        held, size, before = [], 0, None
        for rb in batches:
            did, th, raw, offsets = _columns(rb)
            hits = rb.column("pos")
            again = np.zeros(len(did), bool)  # rows come in the order of id and text
            again[1:] = (did[1:] == did[:-1]) & (th[1:] == th[:-1])
            if len(did):
                again[0] = before == (did[0], th[0])
                before = did[-1], th[-1]
            for part, at, a, text, pos, h, first, last in _found(spec, raw, offsets):
                keep = np.zeros(len(pos), bool)
                local = pos - at[text]
                cuts = np.flatnonzero(np.diff(text, prepend=-1))
                for s, e in zip(cuts, np.append(cuts, len(text))[1:], strict=True):
                    if not again[i := a + int(text[s])]:
                        wanted = np.frombuffer(b"".join(hits[i].as_py() or ()), np.int64)
                        keep[s:e] = np.isin(local[s:e], wanted)
                every = np.flatnonzero(keep)
                for s in range(0, len(every), FLUSH_ANCHORS >> 5):
                    some = every[s : s + (FLUSH_ANCHORS >> 5)]
                    t, p, gram = text[some], pos[some], h[some]
                    ctx = _contexts(spec, part, at, t, p)
                    d, k = did[a + t], th[a + t]
                    bucket = order.route(ctx[:, spec.left :], gram)
                    if len(hot):
                        often = np.isin(_name(gram), hot)
                        place = units.mix((d ^ k).view(np.uint64) + (local[some] >> 12).astype(np.uint64)) % np.uint64(buckets)
                        bucket = np.where(often, place.astype(np.int64), bucket)
                    else:
                        often = np.zeros(len(some), bool)
                    held.append((bucket, ctx, d, k, local[some], (p - last[some]).astype(np.uint8), (p - first[some]).astype(np.uint8), often.astype(np.uint8)))
                    size += ctx.nbytes
                    if size >= FLUSH_BYTES:
                        yield _context_flush(held)
                        held, size = [], 0
        if held:
            yield _context_flush(held)

    return rows


def _context_flush(held):
    bucket, *arrays = (np.concatenate(x) for x in zip(*held, strict=True))
    o = np.argsort(bucket, kind="stable")
    bucket, arrays = bucket[o], [x[o] for x in arrays]
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
    payload = [frames.pack(*(x[s:e] for x in arrays), raw=(0,)) for s, e in zip(cuts, np.append(cuts, len(bucket))[1:], strict=True)]
    return frames.batch(bucket=pa.array(bucket[cuts].astype(np.int64)), payload=pa.array(payload, pa.binary()))


# --- 3: equal windows in a bucket ---------------------------------------------------------


def _spans(did, th, pos, removed: np.ndarray, low: int, window: int) -> dict:
    """removed[i, j - low]: the window j before the anchor i goes. Runs of j join to one span;
    spans by document, as pairs of int64."""
    n = len(did)
    edge = np.diff(np.pad(removed.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    i, a = np.nonzero(edge == 1)
    _, b = np.nonzero(edge == -1)
    start, end = pos[i] - (b - 1 + low), pos[i] - (a + low) + window
    o = np.lexsort((start, th[i], did[i])) if n else i
    i, start, end = i[o], start[o], end[o]
    if not len(i):
        return {"did": np.zeros(0, np.int64), "th": np.zeros(0, np.int64), "spans": []}
    new = np.flatnonzero(np.concatenate([[True], (did[i][1:] != did[i][:-1]) | (th[i][1:] != th[i][:-1])]))
    both = np.stack([start, end], axis=1).astype(np.int64)
    return {"did": did[i][new], "th": th[i][new], "spans": [x.tobytes() for x in np.split(both, new[1:])]}


def _equal_windows(spec: Spec, order: Order, buckets: int):
    def bucket(pdf: pd.DataFrame) -> pd.DataFrame:
        frames.steady_heap()
        ctx, did, th, pos, low, high, hot = (np.concatenate(x) for x in zip(*map(frames.unpack, pdf["payload"]), strict=True))
        o = np.lexsort((th, pos, did))
        ctx, did, th, pos, low, high, hot = (x[o] for x in (ctx, did, th, pos, low.astype(np.int64), high.astype(np.int64), hot.astype(bool)))
        n, left, window = len(did), spec.left, spec.window
        right = order.index(ctx[:, left:])
        back = order.index(np.ascontiguousarray(ctx[:, :left][:, ::-1])) if left else None
        everyone = np.zeros(n, np.int64)
        removed = np.zeros((n, left + 1), bool)
        firsts, any_hot = [], bool(hot.any())
        for j in range(int(low.min()), int(high.max()) + 1):
            of_right, of_left = right.cut(window - j), back.cut(j) if j else everyone
            inside = (low <= j) & (j <= high)
            sel = np.flatnonzero(inside & (of_right >= 0) & (of_left >= 0))
            _, at, again = np.unique(of_right[sel] << 32 | of_left[sel], return_index=True, return_inverse=True)
            f = sel[at][again]
            earlier = did[f] < did[sel]
            if spec.within:
                earlier |= (did[f] == did[sel]) & (pos[f] < pos[sel])
            removed[sel[earlier], j] = True
            if any_hot:
                first_here = inside & hot
                first_here[sel[earlier]] = False
                some = np.flatnonzero(first_here)
                firsts.append((some, np.full(len(some), j)))
        out = _spans(did, th, pos, removed, 0, window)
        kinds = np.zeros(len(out["did"]), np.int64) - 1
        frame = pd.DataFrame({"slot": kinds, **out})
        if not firsts:
            return frame
        i, j = (np.concatenate(x) for x in zip(*firsts, strict=True))
        h1, h2 = _window_hashes(ctx, left - j, i, window)
        slot = (h1 % np.uint64(buckets)).astype(np.int64)
        o = np.argsort(slot, kind="stable")
        slot, i, j, h1, h2 = slot[o], i[o], j[o], h1[o], h2[o]
        cuts = np.flatnonzero(np.diff(slot, prepend=-1))
        packed = [frames.pack(h1[s:e], h2[s:e], did[i[s:e]], th[i[s:e]], pos[i[s:e]] - j[s:e]) for s, e in zip(cuts, np.append(cuts, len(slot))[1:], strict=True)]
        return pd.concat([frame, pd.DataFrame({"slot": slot[cuts], "did": np.int64(0), "th": np.int64(0), "spans": packed})])

    return bucket


def _window_hashes(ctx: np.ndarray, start: np.ndarray, rows: np.ndarray, window: int):
    """Two 64-bit hashes of ctx[row, start:start + window]."""
    h1, h2 = np.empty(len(rows), np.uint64), np.empty(len(rows), np.uint64)
    one, two = (np.random.default_rng(s).integers(1, 1 << 63, window, dtype=np.uint64) | np.uint64(1) for s in (11, 12))
    for a in range(0, len(rows), 1 << 14):
        s = slice(a, a + (1 << 14))
        w = units.mix(ctx[rows[s][:, None], start[s][:, None] + np.arange(window)].astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        h1[s], h2[s] = units.mix((w * one).sum(axis=1, dtype=np.uint64)), units.mix((w * two).sum(axis=1, dtype=np.uint64))
    return h1, h2


# --- 4: across the buckets of one prefix --------------------------------------------------


def _across(spec: Spec):
    def slot(pdf: pd.DataFrame) -> pd.DataFrame:
        h1, h2, did, th, start = (np.concatenate(x) for x in zip(*map(frames.unpack, pdf["spans"]), strict=True))
        o = np.lexsort((start, did, h2, h1))
        h1, h2, did, th, start = (x[o] for x in (h1, h2, did, th, start))
        new = np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
        f = np.flatnonzero(new)[np.cumsum(new) - 1]
        earlier = did[f] < did
        if spec.within:
            earlier |= (did[f] == did) & (start[f] < start)
        out = _spans(did[earlier], th[earlier], start[earlier], np.ones((int(earlier.sum()), 1), bool), 0, spec.window)
        return pd.DataFrame(out)

    return slot


# --- all steps ----------------------------------------------------------------------------


def _sample(spec: Spec, docs: DataFrame, size: int, buckets: int) -> np.ndarray:
    """Suffixes at some anchors of slices of text, of long texts as many more as these are longer."""

    def suffixes(batches):
        for rb in batches:
            raw, offsets = units.text_buffer(rb.column("text"))
            for part, at, _, text, pos, _, _, _ in _found(spec, raw, offsets):
                some = slice(None, None, 8)
                ctx = _contexts(spec, part, at, text[some], pos[some])[:, spec.left : spec.left + spec.gram]
                yield frames.batch(suffix=pa.array([x.tobytes() for x in ctx], pa.binary()))

    step = max(1, size // min(SLICES * buckets, MOST_SLICES))
    length, part = F.octet_length("text"), F.pmod(F.xxhash64("did", "th"), F.lit(1 << 20)) / F.lit(1 << 20)
    some = docs.select("text", length.alias("length"), part.alias("part")).withColumn("n", F.floor(F.col("length") / step + F.col("part")).cast("int")).where("n > 0")
    start = lambda k: F.floor((k + F.col("part")) * F.greatest(F.col("length") - SLICE, F.lit(0)) / F.col("n")).cast("int") + 1
    slices = some.select(F.explode(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda k: F.substr("text", start(k), F.lit(SLICE)))).alias("text"))
    got = [x[0] for x in slices.mapInArrow(suffixes, "suffix binary").collect()]
    kind = np.uint8 if spec.kind == "bytes" else np.uint64
    return np.frombuffer(b"".join(got), kind).reshape(len(got), spec.gram)


def removed_spans(docs: DataFrame, spec: Spec) -> DataFrame:
    """docs: did, th, text and any more columns. Adds `spans`: int64 pairs [start, end) of
    the units to remove, as a list of packed values (null: none)."""
    size = frames.total_bytes(frames.small_batches(docs), "text")
    few, many = size // FILTER_BYTES + 1, size // BUCKET_BYTES + 1
    order = spec.plan(_sample(spec, docs, size, many) if many > 1 else np.zeros((0, spec.gram), np.uint8), many)
    most = SPREAD * BUCKET_BYTES // spec.apart
    filtered = docs.select("did", "th", "text").mapInArrow(_filter_rows(spec, few), "bucket long, payload binary")
    filtered = frames.staged(filtered.groupBy("bucket").applyInPandas(_filter_bucket(most), "did long, th long, pos binary, hot long"), "repeated-grams")
    # one for each `most` anchors at most, that is 8 bytes for SPREAD * BUCKET_BYTES of text
    hot = np.array([r[0] for r in filtered.where("hot IS NOT NULL").select("hot").collect()], np.int64).view(np.uint64)
    hits = filtered.where("hot IS NULL").groupBy("did", "th").agg(F.collect_list("pos").alias("pos"))
    # a merge join leaves equal rows side by side
    contexts = docs.select("did", "th", "text").join(hits.hint("merge"), ["did", "th"]).mapInArrow(_context_rows(spec, order, many, hot), "bucket long, payload binary")
    found = frames.staged(contexts.groupBy("bucket").applyInPandas(_equal_windows(spec, order, many), "slot long, did long, th long, spans binary"), "repeats")
    frames.drop(filtered)
    across = found.where("slot >= 0").groupBy("slot").applyInPandas(_across(spec), "did long, th long, spans binary")
    spans = found.where("slot < 0").unionByName(across, allowMissingColumns=True).groupBy("did", "th").agg(F.collect_list("spans").alias("spans"))
    return docs.join(spans.hint("merge"), ["did", "th"], "left")


def removed_mask(values: list | None, n: int) -> np.ndarray:
    """Which of n units the packed spans cover."""
    if not values:
        return np.zeros(n, bool)
    pairs = np.frombuffer(b"".join(values), np.int64).reshape(-1, 2)
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, pairs[:, 0], 1)
    np.add.at(steps, pairs[:, 1], -1)
    return np.cumsum(steps[:-1]) > 0
