"""Approximate nearest neighbours on shifted space-filling curves.

Vectors are rotated, cut into groups of a few dimensions each, and every group
gives one Hilbert ordering of all vectors (each with a shift of its own). An
ordering is range-partitioned into cells of equal frequency; a query visits the
cells around its own place on every curve, and what it meets on all curves is
merged and ranked by the exact measure. Equal vectors take one place together.

How small cells may be depends on the vectors: a bounded sample is searched both
ways, exactly and along the curves, and cells are the smallest that keep the
recall asked for. Where vectors have structure, that share falls as their number
grows, and so does the part of the table that a query visits.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import frames, units

#: Curves, dimensions of each, bits of a dimension, cells visited to either side.
CURVES, DIMS, BITS, AROUND = 16, 4, 8, 2
#: Vectors that the rotation's scale and the cells' borders come from, those of them that are searched
#: both ways, and the recall to keep; vectors in one group of a join, and queries.
SAMPLE, TRIED, RECALL, GROUP, ASKED = 20_000, 300, 0.95, 20_000, 2_000
#: Cells of a curve at least (if there are vectors enough) and at most.
FEWEST, MOST = 32, 2048
#: Different vectors that a cell has at least; small tables have fewer cells.
LEAST = 8


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Place of integer points (n, dims) with `bits` bits each on the Hilbert curve (int64)."""
    x = points.astype(np.int64).copy()
    n, dims = x.shape
    # undo the excess work of the curve's rotations, from the top bit down
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            on = (x[:, i] & q) != 0
            swap = (x[:, 0] ^ x[:, i]) & p
            x[:, 0] = np.where(on, x[:, 0] ^ p, x[:, 0] ^ swap)
            if i:
                x[:, i] = np.where(on, x[:, i], x[:, i] ^ swap)
        q >>= 1
    for i in range(1, dims):  # Gray code
        x[:, i] ^= x[:, i - 1]
    t = np.zeros(n, np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[:, -1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t[:, None]
    key = np.zeros(n, np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = key << 1 | (x[:, i] >> b & 1)
    return key


@dataclass
class Index:
    rotation: np.ndarray
    low: np.ndarray
    high: np.ndarray
    shift: np.ndarray
    borders: list[np.ndarray]

    def keys(self, vectors: np.ndarray) -> np.ndarray:
        """Key of each vector on each curve."""
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        y = unit @ self.rotation
        side = 1 << BITS
        grid = np.clip(((y - self.low) / (self.high - self.low) + self.shift) * (side / 2), 0, side - 1).astype(np.int64)
        return np.stack([hilbert(g, BITS) for g in np.split(grid, range(DIMS, grid.shape[1], DIMS), axis=1)], axis=1)

    def cells(self, keys: np.ndarray, side: str = "right") -> np.ndarray:
        return np.stack([np.searchsorted(b, keys[:, c], side) for c, b in enumerate(self.borders)], axis=1)

    def around(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last cell that a query visits on each curve: all that hold its key, those
        around them, and all of a key that fills several of these."""
        last = len(self.borders[0])
        lo = np.maximum(self.cells(keys, "left") - AROUND, 0)
        hi = np.minimum(self.cells(keys, "right") + AROUND, last)
        if last:
            for c, b in enumerate(self.borders):
                lo[:, c] = np.where(lo[:, c] < last, np.minimum(lo[:, c], np.searchsorted(b, b[np.minimum(lo[:, c], last - 1)], "left")), lo[:, c])
                hi[:, c] = np.where(hi[:, c] > 0, np.maximum(hi[:, c], np.searchsorted(b, b[np.maximum(hi[:, c] - 1, 0)], "right")), hi[:, c])
        return lo, hi


def usable(vector: str = "embedding"):
    """Vectors that take part: none of their components null or not finite, not all zero."""
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return v.isNotNull() & (F.size(v) > 0) & fine & F.exists(v, lambda x: x != 0)


def fit(vectors: np.ndarray, seed: int = 5, cells: int = FEWEST) -> Index:
    """An index from a sample of vectors; it only places cells, every vector gets a place."""
    dims = vectors.shape[1]
    rng = np.random.default_rng(seed)
    rounds = -(-CURVES * DIMS // dims)
    rotation = np.concatenate([np.linalg.qr(rng.normal(size=(dims, dims)))[0] for _ in range(rounds)], axis=1)[:, : CURVES * DIMS]
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    y = unit @ rotation
    low, high = np.quantile(y, 0.001, axis=0), np.quantile(y, 0.999, axis=0)
    index = Index(rotation, low, np.maximum(high, low + 1e-9), rng.uniform(0, 1, y.shape[1]), [])
    index.borders = borders(np.sort(index.keys(vectors), axis=0), cells)
    return index


def borders(keys: np.ndarray, cells: int) -> list[np.ndarray]:
    """Keys between cells of equal frequency, from sorted keys by curve."""
    at = np.arange(1, cells) * len(keys) // cells
    return [keys[at, c] for c in range(keys.shape[1])]


def _kept(index: Index, unit: np.ndarray, keys: np.ndarray, k: int) -> int:
    """The most cells for which searches among these vectors keep the recall."""
    asked = np.arange(0, len(unit), max(1, len(unit) // TRIED))[:TRIED]
    near = unit[asked] @ unit.T
    near[np.arange(len(asked)), asked] = -2
    best = np.argpartition(-near, k, axis=1)[:, :k]
    order = np.sort(keys, axis=0)
    cells = FEWEST
    while (more := cells * 5 // 4) <= min(MOST, len(unit) // LEAST):
        tried = Index(index.rotation, index.low, index.high, index.shift, borders(order, more))
        lo, hi = tried.around(keys[asked])
        at = tried.cells(keys)
        met = ((at[best] >= lo[:, None]) & (at[best] <= hi[:, None])).any(axis=2)
        if met.mean() < RECALL:
            break
        cells = more
    return cells


def calibrated(vectors: np.ndarray, n: int, k: int) -> Index:
    """An index of n vectors from a sample of them. Its cells are as many as keep the recall in the
    sample, and grow beyond it as they did from a quarter of the sample to all of it."""
    index = fit(vectors, cells=max(1, min(FEWEST, n // LEAST + 1)))
    if len(vectors) <= 2 * FEWEST * LEAST:
        return index
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    keys = index.keys(vectors)
    few, cells = _kept(index, unit[::4], keys[::4], k), _kept(index, unit, keys, k)
    power = float(np.clip(np.log(cells / few) / np.log(4), 0, 1))
    cells = int(min(MOST, cells * max(1.0, n / len(vectors)) ** power))
    index.borders = borders(np.sort(keys, axis=0), cells)
    return index


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest vectors found for each query by cosine, but for its own: query_id, rank
    (from 1), vec_id, score. Nearest first, ties to the smaller id. Vectors that are null,
    zero or hold null or non-finite components take no part, nor do rows with null ids or of
    another length than most; rows that repeat an id count once, as the least vector.
    No rows if no vector is left."""
    # floats travel as floats; all arithmetic is in double precision
    kind = "float" if all(d.schema[vector_col].dataType.simpleString() == "array<float>" for d in (vectors, queries)) else "double"
    clean = [d.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(f"array<{kind}>").alias("v")).where(usable("v") & F.col("id").isNotNull()).groupBy("id").agg(F.min("v").alias("v")) for d in (vectors, queries)]
    n, size = clean[0].agg(F.count("*"), F.mode(F.size("v"))).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if not n:
        return vectors.sparkSession.createDataFrame([], schema)
    clean = [d.where(F.size("v") == size) for d in clean]
    # equal vectors are one class with its smallest ids: k, and one that may be the query's own
    least = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    classes = clean[0].withColumn("least", least).where(F.col("least") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    classes = classes.select(F.col("ids")[0].alias("id"), "ids", "v")
    n = classes.count()
    sampled = classes.where(F.pmod(F.xxhash64("id"), F.lit(max(1, n // SAMPLE))) == 0).limit(2 * SAMPLE).select("v").collect()
    index = calibrated(np.array([r["v"] for r in sampled] or [[1.0] * size], float), n, k)
    cells = len(index.borders[0]) + 1
    groups = n // (cells * GROUP) + 1
    parts = clean[1].count() // (cells * ASKED) + 1

    def places(query: bool):
        def rows(batches):
            for rb in batches:
                if not rb.num_rows:
                    continue
                ids = rb.column("id").to_numpy(zero_copy_only=False)
                v = rb.column("v").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(ids), -1)
                keys = index.keys(v)
                if query:
                    lo, hi = index.around(keys)
                    spans = (hi - lo + 1).ravel()
                    row = np.repeat(np.repeat(np.arange(len(ids)), CURVES), spans * groups)
                    curve = np.repeat(np.tile(np.arange(CURVES), len(ids)), spans * groups)
                    step = np.concatenate([np.tile(np.arange(s), (groups, 1)).T.ravel() for s in spans])
                    cell, group = np.repeat(lo.ravel(), spans * groups) + step, np.tile(np.arange(groups), int(spans.sum()))
                else:
                    # equal keys may fill several cells: dealt over them
                    first, last = index.cells(keys, "left"), index.cells(keys, "right")
                    salt = units.mix(ids.astype(np.uint64))
                    cell = (first + (salt[:, None] % (last - first + 1).astype(np.uint64)).astype(np.int64)).ravel()
                    row, curve = np.repeat(np.arange(len(ids)), CURVES), np.tile(np.arange(CURVES), len(ids))
                    group = np.repeat(((salt >> np.uint64(20)) % np.uint64(groups)).astype(np.int64), CURVES)
                for s in range(0, len(row), 20_000):
                    e = slice(s, s + 20_000)
                    held = {} if query else {"ids": rb.column("ids").take(pa.array(row[e]))}
                    part = (units.mix(ids[row[e]].astype(np.uint64)) % np.uint64(parts)).astype(np.int64) if query else np.zeros(0, np.int64)
                    yield frames.batch(**({"part": pa.array(part)} if query else {}), place=pa.array((curve[e] * cells + cell[e]) * groups + group[e]), id=pa.array(ids[row[e]]), **held, v=rb.column("v").take(pa.array(row[e])))

        return rows

    def meet(have: pd.DataFrame, want: pd.DataFrame) -> pd.DataFrame:
        """The k + 1 best classes of each query."""
        out = {"query_id": [], "class": [], "score": [], "ids": []}
        few = k + 1
        if len(have) and len(want):
            have = have.sort_values("id")
            ids, held, v = have["id"].to_numpy(), have["ids"].to_numpy(), np.stack(have["v"].to_numpy()).astype(float)
            norms = np.sqrt((v * v).sum(axis=1))
            for s in range(0, len(want), 256):
                part = want.iloc[s : s + 256]
                q = np.stack(part["v"].to_numpy()).astype(float)
                own = np.sqrt((q * q).sum(axis=1))
                rough = (q @ v.T) / (own[:, None] * norms)
                for i, me in enumerate(part["id"].to_numpy()):
                    r = rough[i]
                    least = np.partition(r, -few)[-few] if len(r) > few else -2.0
                    near = np.flatnonzero(r >= least - 1e-9)
                    exact = (v[near] * q[i]).sum(axis=1) / (norms[near] * own[i])
                    best = np.lexsort((ids[near], -exact))[:few]
                    out["query_id"].append(np.full(len(best), me))
                    out["class"].append(ids[near][best])
                    out["score"].append(exact[best])
                    out["ids"].append(held[near][best])
        return pd.DataFrame({c: np.concatenate(x) if x else np.zeros(0, object if c == "ids" else float) for c, x in out.items()}).astype({"query_id": "int64", "class": "int64"})

    have = classes.mapInArrow(places(False), f"place long, id long, ids array<long>, v array<{kind}>").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    want = clean[1].mapInArrow(places(True), f"part long, place long, id long, v array<{kind}>")
    found = have.groupBy("place", "part").cogroup(want.groupBy("place", "part")).applyInPandas(meet, "query_id long, class long, score double, ids array<long>")
    found = found.dropDuplicates(["query_id", "class"])
    near = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "class"))
    found = found.withColumn("near", near).where(F.col("near") <= k + 1).select("query_id", F.explode("ids").alias("vec_id"), "score").where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
