"""Toxicity by compression distance.

Two zstandard dictionaries are made from labelled texts: one of what ordinary
texts share, one of that and the passages that toxic texts share. (The library's
own trainer picks what is frequent in either class, which is ordinary prose in
both; what tells the classes apart is chosen here, and zstandard loads it as raw
content.) A document is cut
into windows of a few words; a window that the toxic dictionary compresses to
fewer bytes than the ordinary one is near toxic text. The saved bytes of a
document's windows, against thresholds that the labelled rows calibrate, give
its score.

A block that finds no match is stored as it is, so the first match in a short
window would save nothing. A primer that both dictionaries hold stands before
each window and pays for that first match.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import frames, units

#: Labelled rows of each class that are fitted on at most, whole, by the order of a hash.
SAMPLE = 2000
#: Words of a window, bytes of a gram, texts that must share it.
WORDS, GRAM, LEAST = 4, 5, 5
#: Least log odds of a gram in toxic texts, and their z-value; the best calibrated pair is taken.
CHOICES = ((1.0, 4.0), (1.0, 3.0), (2.5, 3.0), (2.5, 2.0))
LEVEL = 12
#: Saved bytes above the threshold from which windows are counted, too; features of a document.
ABOVE, FEATURES = (0, 2, 4), 7
#: Bytes of the two dictionaries' own parts; of the toxic one's sizes the best calibrated is taken.
ORDINARY, TOXIC = 100, (512, 4096, 8192)
PRIMER = bytes(range(1, 9))
#: Windows that a worker remembers.
REMEMBERED = 100_000


def spaced(raw: np.ndarray, offsets: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Words in ASCII lower case, each with one space behind it; their n + 1 places; word offsets by text."""
    starts, ends, at = units.words(raw, offsets)
    sizes = ends - starts + 1
    text = np.append(units.lower_ascii(raw), np.uint8(32))[frames.ranges(starts, sizes)] if len(starts) else np.zeros(0, np.uint8)
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    text[cuts[1:] - 1] = 32
    return text.tobytes(), cuts, at


def _whole(text: str) -> bytes:
    raw, offsets = units.text_buffer(pa.array([text]))
    return b" " + spaced(raw, offsets)[0]


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    weights: list[float] = field(default_factory=list)
    scale: list[float] = field(default_factory=list)
    threshold: int = 2
    _ready: tuple | None = None

    def __getstate__(self):
        return self.__dict__ | {"_ready": None}

    def saved(self, windows: list[bytes]) -> list[int]:
        """Bytes that the toxic dictionary saves on each window."""
        if self._ready is None:
            kw = {"level": LEVEL, "write_checksum": False, "write_content_size": False, "write_dict_id": False}
            make = [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d + PRIMER, dict_type=zstandard.DICT_TYPE_RAWCONTENT), **kw).compress for d in (self.ordinary, self.toxic)]
            self._ready = (*make, {})
        ordinary, toxic, known = self._ready
        out = []
        for w in windows:
            if (n := known.get(w)) is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                x = PRIMER + w
                n = known[w] = len(ordinary(x)) - len(toxic(x))
            out.append(n)
        return out

    def features(self, text: bytes, cuts: np.ndarray) -> list[float]:
        """text: spaced words; cuts: their places, from the text's first to past its last word."""
        c = cuts.tolist()
        windows = [b" " + text[c[i] : c[min(i + WORDS, len(c) - 1)]] for i in range(0, len(c) - 1, WORDS)]
        return self.of(self.saved(windows))

    def of(self, saved: list[int]) -> list[float]:
        """The most saved bytes, the windows that save threshold, and more, bytes and their shares, and the
        saved bytes of a window."""
        if not saved:
            return [0.0] * FEATURES
        s, n = np.array(saved), len(saved)
        over = [int((s >= self.threshold + k).sum()) for k in ABOVE]
        return [float(max(s.max(), 0)), *map(math.log1p, over), 100.0 * over[0] / (n + 10), 100.0 * over[-1] / (n + 10), float(s.sum()) / (n + 2)]

    def score(self, features: list[float]) -> float:
        if not self.weights:
            return 0.0
        z = self.weights[0] + sum(w * x / s for w, x, s in zip(self.weights[1:], features, self.scale, strict=True))
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))


def _grams(text: bytes) -> set[bytes]:
    return {text[i : i + GRAM] for i in range(len(text) - GRAM + 1)}


def shared_passages(toxic: list[bytes], ordinary: list[bytes]) -> dict[tuple[float, float], bytes]:
    """From spaced texts of either class: for each choice of least odds, the passages that toxic
    texts share that much more often, those that most of them share last."""
    t, o = Counter(), Counter()
    for x in toxic:
        t.update(_grams(x))
    likely = {g for g, n in t.items() if n >= LEAST}
    for x in ordinary:
        o.update(_grams(x) & likely)

    def odds(g: bytes) -> tuple[float, float]:
        log = math.log((t[g] + 0.5) / (len(toxic) + 1)) - math.log((o[g] + 0.5) / (len(ordinary) + 1))
        return log, log / math.sqrt(1 / (t[g] + 0.5) + 1 / (o[g] + 0.5))

    values, out = {g: odds(g) for g in likely}, {}
    for least in CHOICES:
        chosen = {g for g, v in values.items() if v[0] > least[0] and v[1] > least[1]}
        # the longest runs of chosen grams, by the number of texts that hold them
        held = Counter()
        for x in toxic:
            mine, i = set(), 0
            while i <= len(x) - GRAM:
                j = i
                while j <= len(x) - GRAM and x[j : j + GRAM] in chosen:
                    j += 1
                if j > i:
                    mine.add(x[i : j + GRAM - 1])
                i = j + 1
            held.update(mine)
        passages, known = [], b""
        for p in sorted((p for p, n in held.items() if n >= 3), key=lambda p: (-len(p), p)):
            if p not in known:  # nor part of a longer one
                passages.append(p)
                known += p + b"\0"
        passages.sort(key=lambda p: (held[p], p))
        out[least] = b"".join(passages)
    return out


def common_words(ordinary: list[bytes]) -> bytes:
    """The words that most ordinary texts share."""
    common = Counter()
    for x in ordinary:
        common.update(set(x.split()))
    return b" ".join(w for w, _ in sorted(common.items(), key=lambda i: (-i[1], i[0]))[:ORDINARY])[:ORDINARY] + b" "


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a logistic regression, the constant first, by Newton's method."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(len(w))
    penalty[0, 0] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def fit(texts: list[str | None], labels: list[int], totals: tuple[int, int] | None = None) -> Model:
    """A model from labelled texts: dictionaries from three of four texts of each class, their size
    and choice, the threshold and the weights from the fourth. totals: rows of the classes 0 and 1 among all labels. With one class only,
    scores are that class's smoothed share."""
    data = [(_whole(t or ""), int(y)) for t, y in zip(texts, labels, strict=True)]
    ones = sum(y for _, y in data)
    if not ones or ones == len(data):
        share = (ones + 0.5) / (len(data) + 1)
        return Model(b" " * 8, b" " * 8, [math.log(share / (1 - share))] + [0.0] * FEATURES, [1.0] * FEATURES)
    side, seen = [], Counter()
    for _, k in data:  # every fourth text of each class calibrates
        side.append(seen[k] % 4 == 3)
        seen[k] += 1
    if min(seen.values()) < 4:
        side = [True] * len(data)
    texts_of = [[x for i, (x, k) in enumerate(data) if k == one and (not side[i] or all(side))] for one in (1, 0)]
    found, base = shared_passages(*texts_of), common_words(texts_of[1])
    order, best = [i for i in range(len(data)) if side[i]], None
    target = np.array([data[i][1] for i in order], float)
    cut = []
    for i in order:
        raw = np.frombuffer(data[i][0], np.uint8)
        text, cuts, _ = spaced(raw, np.array([0, len(raw)]))
        c = cuts.tolist()
        cut.append([b" " + text[c[k] : c[min(k + WORDS, len(c) - 1)]] for k in range(0, len(c) - 1, WORDS)])
    for own in dict.fromkeys(p[-size:] for p in found.values() for size in TOXIC):
        model = Model(base, own + base)
        saved = [model.saved(w) for w in cut]
        for threshold in range(1, 6):
            model.threshold = threshold
            x = np.array([model.of(v) for v in saved])
            scale = np.maximum(x.std(axis=0), 1e-9)
            w = _logistic(x / scale, target)
            z = np.column_stack([np.ones(len(x)), x / scale]) @ w
            loss = float(np.mean(np.logaddexp(0, z) - target * z))
            if best is None or loss < best[0]:
                best = (loss, own, threshold, w.tolist(), scale.tolist())
    _, own, threshold, weights, scale = best
    model = Model(base, own + base)
    model.threshold, model.weights, model.scale = threshold, weights, scale
    if totals:  # the sample may hold the classes in other proportions than the labels
        model.weights[0] += math.log((totals[1] + 0.5) / (totals[0] + 0.5)) - math.log((ones + 0.5) / (len(data) - ones + 0.5))
    return model


def fold(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5; 0 is held out. Null ids: null."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5))


def fit_on(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on the labelled rows that are not held out: SAMPLE of each class at most, in the
    order of a hash. An id that labels repeat is toxic if one row says so; of documents that
    repeat an id the least text counts. Null texts are empty. Labels other than 0 and 1 don't
    count; without any labelled row all scores are a half."""
    kept = labels.where((fold(id_col) != 0) & F.col(label_col).isin(0, 1)).groupBy(id_col).agg(F.max(label_col).alias("label"))
    counts = {r[0]: r[1] for r in kept.groupBy("label").count().collect()}
    order = F.xxhash64(id_col)
    some = [kept.where(F.col("label") == k).orderBy(order, id_col).limit(SAMPLE) for k in (0, 1)]
    chosen = F.broadcast(some[0].unionByName(some[1]))  # 2 * SAMPLE rows at most
    texts = docs.select(id_col, F.col(text_col).cast("string").alias("text")).join(chosen, id_col)
    rows = texts.groupBy(id_col, "label").agg(F.min("text").alias("text")).select(order.alias("o"), F.coalesce("text", F.lit("")).alias("text"), "label").collect()
    rows.sort(key=lambda r: (r["o"], r["text"]))
    return fit([r["text"] for r in rows], [r["label"] for r in rows], (counts.get(0, 0), counts.get(1, 0)))


def score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """All columns of docs and `name` (none of theirs), 0 to 1. Null and empty texts have no window:
    they get the score of a text without anything toxic. Texts may be of any length; rows that repeat are
    rows of their own with one score; an empty table gives no rows."""
    own = frames.small_batches(docs).columns

    def rows(batches):
        frames.steady_heap()
        for rb in batches:
            raw, offsets = units.text_buffer(rb.column("text"))
            for a, b in units.slices(np.diff(offsets)):
                text, cuts, at = spaced(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                out = [model.score(model.features(text, cuts[at[i] : at[i + 1] + 1])) for i in range(b - a)]
                yield frames.batch(own=rb.column("own").slice(a, b - a), score=pa.array(out, pa.float64()))

    source = docs.select(F.struct(*(F.col(f"`{c}`") for c in own)).alias("own"), frames.text_column(text_col).alias("text"))
    kind = source.schema["own"].dataType.simpleString()
    out = source.mapInArrow(rows, f"own {kind}, score double")
    return out.select("own.*", F.col("score").alias(name))
