"""N-gram Jaccard join with set-relation skipping.

A document's set is its distinct word shingles. Equal sets are one class.

1. A class links only if four fifths of its elements stand in other classes too.
   Elements of a fixed part of the hash space are counted first: classes in which
   too many of these stand alone are out, which are all but near copies.
2. Of the classes that are left, elements are ordered from rare to frequent. Sets
   that overlap enough share an element among the first few of that order, so an
   index lists, for each such element, the classes that hold it there, with their
   sizes and positions.
3. Lists are compared in rounds. At first each set meets a few leading sets of its
   lists; linked sets share their answers (their component) from then on, and
   only lists that still hold several components go on. The last round compares
   what is still apart in full, sorted by position: entries whose position leaves
   too few elements for the overlap that is asked for are skipped as a block.
   A parity sketch bounds a pair's difference from below before the exact
   comparison, which is on the classes' repeated elements.

Lists longer than a block are dealt over several blocks, in another way each
round, and over pairs of blocks in the last one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import components, frames, units
from .repeats import FLUSH_ANCHORS, bucket_of

#: Words of a shingle; least similarity in hundredths.
WORDS, SHARE = 5, 80
#: Of 65,536 parts of the hash space, those whose elements are counted first.
COUNTED = 26_000
#: Bits of a sketch. Leading sets that a list's sets meet, round by round; None: all.
BITS, ROUNDS = 2048, (2, 16, None)
#: Entries of a block.
BLOCK = 512
#: Bytes of text whose elements meet in one bucket; classes that are sent to all machines at most.
BUCKET_BYTES, FEW = 8 << 20, 200_000


def shingles(raw: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after the other, and their n + 1 places."""
    low = units.lower_ascii(raw)
    starts, ends, at = units.words(low, offsets)
    h = units.word_hashes(low, starts, ends)
    counts = np.diff(at)
    text = np.repeat(np.arange(len(counts)), np.maximum(counts - words + 1, 0))
    first = frames.ranges(at[:-1], np.maximum(counts - words + 1, 0))
    grams = units.gram_hashes(h, words) if len(h) >= words else np.zeros(0, np.uint64)
    value = grams[first] if len(first) else np.zeros(0, np.uint64)
    few = np.flatnonzero((counts > 0) & (counts < words))
    if len(few):
        text = np.concatenate([text, few])
        value = np.concatenate([value, units.run_hashes(h, at[few], at[few + 1])])
    o = np.lexsort((value, text))
    text, value = text[o], value[o]
    new = np.ones(len(value), bool)
    new[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
    text, value = text[new], value[new]
    return value, np.searchsorted(text, np.arange(len(counts) + 1))


def _sums(value: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sums over each set that tell sets apart."""
    out = []
    for v in (units.mix(value), units.mix(value ^ np.uint64(0x5851F42D4C957F2D))):
        total = np.concatenate([[np.uint64(0)], np.cumsum(v)])
        out.append((total[at[1:]] - total[at[:-1]]).view(np.int64))
    return out[0], out[1]


def _class(one: np.ndarray, two: np.ndarray, n: np.ndarray) -> np.ndarray:
    return units.mix(one.view(np.uint64) + two.view(np.uint64) * np.uint64(31) + n.astype(np.uint64)).view(np.int64)


def needed(a, b, share: int = SHARE):
    """Least overlap of two sets of sizes a and b."""
    return -(-share * (a + b) // (100 + share))


def prefix(n, share: int = SHARE):
    """Elements of a set of size n of which one at least is shared."""
    return n - -(-share * n // 100) + 1


def _parts(rb: pa.RecordBatch, words: int):
    raw, offsets = units.text_buffer(rb.column("text"))
    for a, b in units.slices(np.diff(offsets), 4 * units.CHUNK):
        value, at = shingles(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], words)
        yield a, b, value, at


def _counted(value: np.ndarray) -> np.ndarray:
    return (value & np.uint64(0xFFFF)) < np.uint64(COUNTED)


def _profiles(words: int):
    def rows(batches):
        frames.steady_heap()
        for rb in batches:
            for a, b, value, at in _parts(rb, words):
                one, two = _sums(value, at)
                n = np.diff(at)
                counted = np.concatenate([[0], np.cumsum(_counted(value))])
                yield frames.batch(did=rb.column("did").slice(a, b - a), th=rb.column("th").slice(a, b - a), n=pa.array(n, pa.int64()), counted=pa.array(counted[at[1:]] - counted[at[:-1]], pa.int64()), one=pa.array(one), two=pa.array(two), c=pa.array(_class(one, two, n)))

    return rows


def _entries(words: int, buckets: int):
    """Counted elements by bucket: those that one class of a flush holds with it, others without;
    for classes the number of their elements that others of the flush hold too."""

    def flush(held):
        h, c = (np.concatenate(x) for x in zip(*held, strict=True))
        used, index = np.unique(c, return_inverse=True)
        o = np.argsort(h, kind="stable")
        h, index = h[o] >> np.uint64(16), index[o]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        count = np.diff(np.append(first, len(h)))
        alone, eh, ec = count == 1, h[first], index[first]
        shared = np.bincount(index[np.repeat(~alone, count)], minlength=len(used))
        to, spread = bucket_of(eh, buckets), (units.mix(used.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        k = np.flatnonzero(shared)
        k = k[np.argsort(spread[k], kind="stable")]
        keys, packed = np.union1d(to, spread[k]), []
        for s, e, q, r in zip(*(np.searchsorted(x, keys, side) for x in (to, spread[k]) for side in ("left", "right")), strict=True):
            one = alone[s:e]
            mine, back = np.unique(ec[s:e][one], return_inverse=True)
            packed.append(frames.pack(np.diff(eh[s:e], prepend=np.uint64(0)), np.packbits(one), back.astype(np.uint32), used[mine], used[k[q:r]], shared[k[q:r]]))
        return frames.batch(bucket=pa.array(keys, pa.int64()), payload=pa.array(packed, pa.binary()))

    def rows(batches):
        frames.steady_heap()
        held, size, seen = [], 0, set()
        for rb in batches:
            for _, _, value, at in _parts(rb, words):
                n = np.diff(at)
                one, two = _sums(value, at)
                c = _class(one, two, n)
                fresh = np.zeros(len(n), bool)  # a class counts once
                for i, key in enumerate(c.tolist()):
                    if key not in seen:
                        seen.add(key)
                        fresh[i] = True
                keep = _counted(value) & np.repeat(fresh, n)
                held.append((value[keep], np.repeat(c, n)[keep]))
                size += len(held[-1][0])
                if size >= FLUSH_ANCHORS:
                    yield flush(held)
                    held, size = [], 0
                    seen.clear()
        if size:
            yield flush(held)

    return rows


def _totals(classes: list, counts: list) -> tuple[np.ndarray, np.ndarray]:
    used, index = np.unique(np.concatenate(classes), return_inverse=True)
    return used, np.bincount(index, np.concatenate(counts), minlength=len(used)).astype(np.int64)


def _repeated(pdf: pd.DataFrame, parts: int) -> pd.DataFrame:
    """For classes, at least the number of their counted elements in this bucket that other classes
    hold too, packed by part of the classes."""
    frames.steady_heap()
    hs, ones, cs, known, shared = [], [], [], [], []
    for value in pdf["payload"]:
        gaps, bits, back, mine, kc, kn = frames.unpack(value)
        one = np.unpackbits(bits, count=len(gaps)).astype(bool)
        c = np.zeros(len(gaps), np.int64)
        c[one] = mine[back]
        hs.append(np.cumsum(gaps))
        ones.append(one)
        cs.append(c)
        known.append(kc)
        shared.append(kn)
    h, one, c = np.concatenate(hs), np.concatenate(ones), np.concatenate(cs)
    o = np.lexsort((c, h))
    h, one, c = h[o], one[o], c[o]
    found = [np.zeros(0, np.int64)]
    if len(h):
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        several = ~np.logical_and.reduceat(one, first) | (np.maximum.reduceat(c, first) != np.minimum.reduceat(c, first))
        several = np.repeat(several, np.diff(np.append(first, len(h)))) & one
        several[1:] &= (h[1:] != h[:-1]) | (c[1:] != c[:-1]) | ~one[:-1]  # a class once for each element
        found.append(c[several])
    alone = np.concatenate(found)
    used, count = _totals([alone, *known], [np.ones(len(alone), np.int64), *shared])
    part = (units.mix(used.view(np.uint64)) % np.uint64(parts)).astype(np.int64)
    o = np.argsort(part, kind="stable")
    used, count, part = used[o], count[o], part[o]
    cuts = np.flatnonzero(np.diff(part, prepend=-1))
    payload = [frames.pack(used[s:e], count[s:e]) for s, e in zip(cuts, np.append(cuts, len(part))[1:], strict=True)]
    return pd.DataFrame({"part": part[cuts], "payload": payload})


def _summed(pdf: pd.DataFrame) -> pd.DataFrame:
    used, count = _totals(*zip(*map(frames.unpack, pdf["payload"]), strict=True))
    return pd.DataFrame({"c": used, "r": count})


def _sets(words: int):
    """Elements and sketch of each class: bit k of a sketch is the parity of the elements dealt to it."""

    def rows(batches):
        frames.steady_heap()
        for rb in batches:
            for a, b, value, at in _parts(rb, words):
                bit = (units.mix(value) % np.uint64(BITS)).astype(np.int64)
                odd = np.bincount(bit + np.repeat(np.arange(b - a) * BITS, np.diff(at)), minlength=(b - a) * BITS) & 1
                sketch = np.packbits(odd.astype(bool).reshape(b - a, BITS), axis=1)
                elements = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(value.view(np.int64)))
                yield frames.batch(c=rb.column("c").slice(a, b - a), elements=elements, sketch=pa.array([x.tobytes() for x in sketch], pa.binary()))

    return rows


def _may_link(na, pa_, nb, pb, share):
    """Neither sizes nor what stands behind these positions rules the pair out."""
    sizes = 100 * np.minimum(na, nb) >= share * np.maximum(na, nb)
    return sizes & (np.minimum(na - pa_, nb - pb) >= needed(na, nb, share))


def _difference(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Odd bits in which sketches differ: as many elements at least differ."""
    return np.bitwise_count(a ^ b).sum(axis=1)


def _met(share: int, leaders: int | None, sketched: bool):
    """Pairs of classes that meet in a list and may link. Rows come list by list (h, i, j): entries of
    side 0 meet those behind them (i = j) or all of side 1; only the first `leaders` of side 0 do."""
    names = ["h", "i", "j", "side", "p", "n", "c", "label"]

    def meet(x: dict) -> pa.RecordBatch:
        first, cross = x["first"], x["i"] != x["j"]
        size = np.diff(np.append(first, len(cross)))
        own = np.add.reduceat((x["side"] == 0).astype(np.int64), first)  # entries of side 0
        cross = cross[first]
        # places rise within a list's side: how far an entry's partners may reach
        place = ((np.repeat(np.arange(len(first)), size) * 2 + x["side"]) << 32) + x["p"]
        c, n, p, label = x["c"], x["n"], x["p"], x["label"]
        out, k = [], 0
        while leaders is None or k < leaders:
            some = np.flatnonzero((own > k) & (size > k + 1))
            if not len(some):
                break
            lead = first[some] + k
            begin = np.where(cross[some], first[some] + own[some], lead + 1)
            end = first[some] + size[some]
            if leaders is None:
                far = n[lead] * (100 - share) // share
                end = np.searchsorted(place, ((some * 2 + cross[some]) << 32) + far, "right")
            length = np.maximum(end - begin, 0)
            a, b = np.repeat(lead, length), frames.ranges(begin, length)
            ok = (label[a] != label[b]) & _may_link(n[a], p[a], n[b], p[b], share)
            a, b = a[ok], b[ok]
            if sketched and len(a):
                fine = n[a] + n[b] - _difference(x["sketch"][a], x["sketch"][b]) >= 2 * needed(n[a], n[b], share)
                a, b = a[fine], b[fine]
            if len(a):
                out.append((c[a], c[b]))
            k += 1
        if not out:
            return frames.batch(a=pa.array([], pa.int64()), b=pa.array([], pa.int64()))
        a, b = (np.concatenate(y) for y in zip(*out, strict=True))
        both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
        return frames.batch(a=pa.array(both[:, 0]), b=pa.array(both[:, 1]))

    def rows(batches):
        frames.steady_heap()
        held = None
        for rb in batches:
            if not rb.num_rows:
                continue
            x = {k: rb.column(k).to_numpy().astype(np.int64) for k in names}
            if sketched:
                x["sketch"] = np.frombuffer(b"".join(rb.column("sketch").to_pylist()), np.uint64).reshape(rb.num_rows, -1)
            if held:
                x = {k: np.concatenate([held[k], v]) for k, v in x.items()}
            new = (x["h"][1:] != x["h"][:-1]) | (x["i"][1:] != x["i"][:-1]) | (x["j"][1:] != x["j"][:-1])
            first = np.flatnonzero(np.concatenate([[True], new]))
            held = {k: v[first[-1] :] for k, v in x.items()}  # its list may go on
            if len(first) > 1:
                yield meet({k: v[: first[-1]] for k, v in x.items()} | {"first": first[:-1]})
        if held:
            yield meet(held | {"first": np.array([0])})

    return rows


def _pairs(entries: DataFrame, labels: DataFrame, sketches: DataFrame, leaders: int | None, share: int, seed: int) -> DataFrame:
    """Pairs that meet in lists of several components: a, b."""
    held = entries.join(labels.withColumnRenamed("u", "c"), "c", "left").withColumn("label", F.coalesce("label", "c"))
    lists = held.groupBy("h").agg((F.min("label") != F.max("label")).alias("apart"), F.ceil(F.count("*") / F.lit(BLOCK)).alias("blocks"))
    held = held.join(lists.where("apart").select("h", "blocks"), "h").withColumn("own", F.pmod(F.xxhash64("c", F.lit(seed)), "blocks"))
    sketched = seed > 0
    if sketched:  # the first round's pairs are few, and nearly all link
        held = held.join(sketches, "c")
    if leaders is None:
        held = held.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        held = held.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other"), "side": (F.col("own") > F.col("other")).cast("int"), "o": F.col("p")})
    else:
        held = held.withColumns({"i": F.col("own"), "j": F.col("own"), "side": F.lit(0), "o": F.xxhash64(F.lit(seed), "c")})
    held = held.repartition("h", "i", "j").sortWithinPartitions("h", "i", "j", "side", "o", "c")
    columns = ["h", "i", "j", "side", "p", "n", "c", "label"] + ["sketch"] * sketched
    return held.select(*columns).mapInArrow(_met(share, leaders, sketched), "a long, b long").distinct()


def _compared(share: int):
    """Of pairs with their sizes and repeated elements, those that link."""

    def rows(batches):
        frames.steady_heap()
        for rb in batches:
            left, right = rb.column("ea"), rb.column("eb")
            sizes = np.diff(left.offsets.to_numpy()) + np.diff(right.offsets.to_numpy())
            na, nb = rb.column("na").to_numpy(), rb.column("nb").to_numpy()
            both = np.zeros(rb.num_rows, np.int64)
            for a, b in units.slices(sizes, units.CHUNK):
                x, y = left.slice(a, b - a), right.slice(a, b - a)
                value = np.concatenate([x.flatten().to_numpy(), y.flatten().to_numpy()])
                pair = np.concatenate([np.repeat(np.arange(b - a), np.diff(z.offsets.to_numpy())) for z in (x, y)])
                o = np.lexsort((value, pair))
                value, pair = value[o], pair[o]
                same = (value[1:] == value[:-1]) & (pair[1:] == pair[:-1])
                both[a:b] = np.bincount(pair[1:][same], minlength=b - a)
            ok = 100 * both >= share * (na + nb - both)
            yield pa.RecordBatch.from_arrays([rb.column("a"), rb.column("b")], names=["a", "b"]).filter(pa.array(ok))

    return rows


def _links(sets: DataFrame, pairs: DataFrame, share: int) -> DataFrame:
    """The pairs of classes that link, staged: a, b."""
    side = sets.select("c", "n", "elements")
    # the sets of the many are sent to their pairs, and these once to those that they share
    both = pairs.join(side.toDF("b", "nb", "eb"), "b").join(side.toDF("a", "na", "ea"), "a")
    return frames.staged(both.select("a", "b", "na", "nb", "ea", "eb").mapInArrow(_compared(share), "a long, b long"), "links")


def _candidates(docs: DataFrame, classes: DataFrame, size: int, words: int, share: int) -> DataFrame:
    """Classes that may link, staged: c, n, sketch, and as `elements` those that others of them hold
    too, from rare to frequent."""
    buckets = size // BUCKET_BYTES + 1
    counts = docs.select("text").mapInArrow(_entries(words, buckets), "bucket long, payload binary").groupBy("bucket").applyInPandas(lambda pdf: _repeated(pdf, buckets // 16 + 1), "part long, payload binary")
    counts = counts.groupBy("part").applyInPandas(_summed, "c long, r long")
    alone = F.col("counted") - F.coalesce("r", F.lit(0))
    likely = frames.staged(classes.join(counts, "c", "left").where(alone <= F.expr(f"n - ({share} * n + 99) div 100")).select("c", "n", "did", "th"), "likely")
    few = likely.count() <= FEW
    ids = likely.select("c", "did", "th")
    texts = docs.select("did", "th", "text").join(F.broadcast(ids) if few else ids, ["did", "th"]).select("c", "text").dropDuplicates(["c"])
    sets = frames.staged(texts.mapInArrow(_sets(words), "c long, elements array<long>, sketch binary"), "sets")
    each = sets.select("c", F.explode("elements").alias("h"))
    often = each.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    order = each.join(often, "h").groupBy("c").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("order"))
    ranked = likely.select("c", "n").dropDuplicates(["c"]).join(order, "c").join(sets.select("c", "sketch"), "c")
    # elements that no other class holds come first in the order; one of the first few must be shared
    kept = ranked.withColumn("alone", F.col("n") - F.size("order")).where(F.expr(f"alone <= n - ({share} * n + 99) div 100"))
    out = frames.staged(kept.select("c", "n", "sketch", "alone", F.col("order.h").alias("elements")), "candidates")
    frames.drop(likely, sets)
    return out


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, share: int = SHARE) -> DataFrame:
    """One row for each row of docs: id, th (tells texts of one id apart), n_shingles,
    component_id, the least id reachable by links (100 * overlap >= share * union), and
    component, a number of the linked group (null: empty).

    Words are [^ \\t-\\r]+ with A-Z in lower case. A text of fewer words than a shingle is one
    shingle; without words it is empty and linked with nothing. Null texts are empty; a null
    id is above all others and stays null where nothing else is reached. Rows that repeat an
    id are rows of their own, and an empty one among them keeps that id. Texts may be of any
    length. Links have no order, so ties don't arise. An empty table gives no rows. Shingles are
    compared by 64-bit hashes.
    """
    size = frames.total_bytes(frames.small_batches(docs), text_col)
    docs = docs.select(F.col(id_col).alias("own"), frames.id_column(id_col).alias("did"), frames.row_key(text_col).alias("th"), frames.text_column(text_col).alias("text"))
    profile = frames.staged(docs.select("did", "th", "text").mapInArrow(_profiles(words), "did long, th long, n long, counted long, one long, two long, c long"), "profiles")
    classes = profile.where("n > 0").groupBy("c", "n", "one", "two").agg(F.min(F.struct("did", "th")).alias("least"), F.first("counted").alias("counted"))
    classes = frames.staged(classes.select("c", "n", "counted", "least.did", "least.th"), "classes")
    sets = _candidates(docs, classes, size, words, share)
    first = F.slice("elements", 1, F.expr(f"cast(n - ({share} * n + 99) div 100 + 1 - alone as int)"))
    entries = sets.select("c", "n", "alone", F.posexplode(first).alias("place", "h")).select("c", "n", "h", (F.col("alone") + F.col("place")).alias("p"))
    labels, links, met, spent = docs.sparkSession.createDataFrame([], "u long, label long"), None, None, [sets]
    for seed, leaders in enumerate(ROUNDS):
        pairs = _pairs(entries, labels, sets.select("c", "sketch"), leaders, share, seed)
        pairs = frames.staged(pairs.join(met, ["a", "b"], "left_anti") if met else pairs, "pairs")
        found = _links(sets, pairs, share)
        met, links = (met.union(pairs), links.union(found)) if met else (pairs, found)
        labels = components.components(links.toDF("u", "v"))
        spent += [pairs, found, labels]
    frames.drop(*spent[:-1])
    named = classes.select("c", "did").join(labels.withColumnRenamed("u", "c"), "c", "left").withColumn("label", F.coalesce("label", "c"))
    least = named.groupBy("label").agg(F.min("did").alias("least"))
    named = named.join(least, "label").groupBy("c").agg(F.min("least").alias("least"), F.min("label").alias("component"))
    named = frames.staged(named, "named")  # so that the join below is of two exchanges, and may split a class of many copies
    out = profile.select("did", "th", "n", "c").join(named, "c", "left")
    own = F.when(F.col("did") != frames.LAST_ID, F.col("did"))
    component = F.when(F.col("n") > 0, F.least("did", "least")).otherwise(F.col("did"))
    return out.select(own.alias(id_col), "th", F.col("n").alias("n_shingles"), F.when(component != frames.LAST_ID, component).alias("component_id"), "component")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, share: int = SHARE) -> DataFrame:
    """The rows of docs that stay if one row of each linked group does: the one with the least id
    (null last). Empty texts all stay; of rows that repeat wholly in id and text one does, the
    first by a hash of its other columns."""
    found = join(docs, id_col, text_col, words, share).withColumn("did", frames.id_column(id_col))
    first = found.where("n_shingles > 0").groupBy("component").agg(F.min(F.struct("did", "th")).alias("least")).select("least.did", "least.th", F.lit(False).alias("empty"))
    empty = found.where("n_shingles = 0").select("did", "th", F.lit(True).alias("empty")).distinct()
    columns = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.select(F.struct(*columns).alias("own"), frames.id_column(id_col).alias("did"), frames.row_key(text_col).alias("th"))
    kept = keyed.join(first.union(empty), ["did", "th"])
    place = F.row_number().over(Window.partitionBy("did", "th").orderBy(F.xxhash64("own")))
    return kept.withColumn("place", place).where("empty OR place = 1").select("own.*")
