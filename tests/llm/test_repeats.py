import hashlib
import random
import re

import numpy as np
import pytest

from claimlens.llm import repeats, suffix_array, suffix_tree, units


def brute_bytes(rows, window):
    """rows: (id, text); ids null last."""
    key = lambda d: (d is None, d or 0)
    data = [(key(d), (t or "").encode()) for d, t in rows]
    first = {}
    for d, b in data:
        for s in range(len(b) - window + 1):
            w = b[s : s + window]
            first[w] = min(first.get(w, (d, s)), (d, s))
    out = []
    for d, b in data:
        gone = np.zeros(len(b) + 1, bool)
        for s in range(len(b) - window + 1):
            if first[b[s : s + window]] < (d, s):
                gone[s : s + window] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone[:-1]]) if b else b""
        out.append((len(b), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[0]), hashlib.sha256(kept).hexdigest()))
    return out


def brute_words(rows, window):
    key = lambda d: (d is None, d or 0)
    data = [(key(d), re.findall("[^\x20\x09-\x0d]+", t or "")) for d, t in rows]
    first = {}
    for d, w in data:
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            first[k] = min(first.get(k, d), d)
    out = []
    for d, w in data:
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < d:
                gone[s : s + window] = [True] * window
        out.append((len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


def corpus(seed, n=60):
    r = random.Random(seed)
    vocab = ["aé", "bb", "c", "dd", "the", "of", "x" * 9, "ü", "zz."]
    shared = [" ".join(r.choice(vocab) for _ in range(r.randint(10, 80))) for _ in range(6)]
    rows = [(None, None), (5, ""), (None, shared[0]), (6, "a" * 900), (7, "ab" * 450), (8, "a b " * 300)]
    for i in range(n):
        t = " ".join(r.choice([r.choice(shared), " ".join(r.choice(vocab) for _ in range(r.randint(0, 60)))]) for _ in range(r.randint(0, 4)))
        rows.append((10 + i, r.choice(["", "\n", " "]) + t))
    rows += [rows[10], (11, "other text for an id that repeats " * 4), (200, rows[9][1]), (201, rows[9][1])]
    r.shuffle(rows)
    return rows


@pytest.fixture(params=["one bucket", "many buckets"])
def dealt(request, monkeypatch):
    if request.param == "many buckets":
        monkeypatch.setattr(repeats, "FILTER_BYTES", 2000)
        monkeypatch.setattr(repeats, "BUCKET_BYTES", 1000)
        monkeypatch.setattr(repeats, "SPREAD", 1)
        monkeypatch.setattr(repeats, "FLUSH_ANCHORS", 100)
        monkeypatch.setattr(repeats, "FLUSH_BYTES", 5000)
    return request.param


@pytest.mark.parametrize("window", [12, 40])
def test_suffix_array(spark, dealt, window):
    rows = corpus(window)
    df = spark.createDataFrame([(d, t, i, 9) for i, (d, t) in enumerate(rows)], "doc_id long, text string, row int, kept int")
    got = {r["row"]: (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(bytes(r[-1])).hexdigest()) for r in suffix_array.dedup(df.drop("kept"), window=window, keep=("row",)).collect()}
    assert [got[i] for i in range(len(rows))] == brute_bytes(rows, window)
    assert suffix_array.dedup(df.limit(0)).count() == 0


@pytest.mark.parametrize("window", [5, 12])
def test_suffix_tree(spark, dealt, window):
    rows = corpus(window + 100)
    df = spark.createDataFrame([(d, t, i) for i, (d, t) in enumerate(rows)], "doc_id long, text string, row int")
    got = {r["row"]: (r["n_words"], r["n_removed"], r["kept"]) for r in suffix_tree.dedup(df, window=window, keep=("row",)).collect()}
    assert [got[i] for i in range(len(rows))] == brute_words(rows, window)
    assert suffix_tree.dedup(df.limit(0)).count() == 0


def test_suffix_tree_without_a_sample(spark, monkeypatch):
    """Repeats in texts so rare that the sample meets none of them."""
    monkeypatch.setattr(repeats, "BUCKET_BYTES", 1000)
    monkeypatch.setattr(repeats, "_sample", lambda spec, docs, size, buckets: np.zeros((0, spec.gram), np.uint64))
    rows = corpus(112)
    df = spark.createDataFrame([(d, t, i) for i, (d, t) in enumerate(rows)], "doc_id long, text string, row int")
    got = {r["row"]: (r["n_words"], r["n_removed"], r["kept"]) for r in suffix_tree.dedup(df, window=12, keep=("row",)).collect()}
    assert [got[i] for i in range(len(rows))] == brute_words(rows, 12)


def test_long_text_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(units, "CHUNK", 512)
    r = random.Random(3)
    long = "".join(r.choice("abcdef ") for _ in range(6000))
    rows = [(1, long), (2, "xx" + long[500:4000] + "yy"), (3, long[100:260] + long[100:260])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x["doc_id"]: (x["n_bytes"], x["n_removed"], x["n_spans"], hashlib.sha256(bytes(x["kept"])).hexdigest()) for x in suffix_array.dedup(df).collect()}
    assert [got[i] for i in (1, 2, 3)] == brute_bytes(rows, 100)


def _shared(x, y):
    return next((k for k in range(len(x)) if x[k] != y[k]), len(x))


@pytest.mark.parametrize("seed", range(4))
def test_multikey_quicksort(seed):
    a = np.random.default_rng(seed).integers(0, 2 + seed, (200, 7)).astype(np.uint64)
    order, shared = suffix_array.multikey_quicksort(a)
    assert [tuple(x) for x in a[order]] == sorted(tuple(x) for x in a)
    assert [_shared(a[order[i - 1]], a[order[i]]) for i in range(1, 200)] == shared[1:].tolist()


@pytest.mark.parametrize("index", [suffix_tree.SuffixTree, suffix_array.SuffixArray])
def test_groups_share_prefixes(index):
    for n in (1, 2, 150):
        a = np.random.default_rng(n).integers(0, 3, (n, 9)).astype(np.uint8)
        groups = index(a if index is suffix_array.SuffixArray else a.astype(np.uint64))
        for depth in range(1, 10):
            got = groups.cut(depth)
            for i in range(n):
                same = [j for j in range(n) if j != i and _shared(a[i], a[j]) >= depth]
                assert (got[i] >= 0) == bool(same) and all(got[j] == got[i] for j in same)
                assert not same or (got == got[i]).sum() == len(same) + 1


def test_suffix_tree_nodes():
    words = np.array([[1, 2, 3], [1, 2, 4], [1, 5, 6], [1, 2, 3]], np.uint64)
    tree = suffix_tree.SuffixTree(words)
    below = [sorted(tree.order[f : f + s].tolist()) for f, s in zip(tree.first, tree.size, strict=True)]
    assert list(zip(tree.depth.tolist(), tree.parent.tolist(), below, strict=True)) == [(1, -1, [0, 1, 2, 3]), (2, 0, [0, 1, 3]), (3, 1, [0, 3])]


def test_rare_long_texts(spark, monkeypatch):
    """Repeats in a few long texts among many short ones, which no sample of texts need meet."""
    monkeypatch.setattr(repeats, "BUCKET_BYTES", 100_000)
    r = random.Random(7)
    short = [(i, " ".join(f"w{r.randrange(10**6)}" for _ in range(r.randint(1, 40)))) for i in range(20_000)]
    long = [" ".join(f"w{r.randrange(10**6)}" for _ in range(70)) for _ in range(12)]
    rows = short + [(30_000 + k, t) for k, t in enumerate(long * 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = {x["doc_id"]: x["n_removed"] for x in suffix_tree.dedup(df).where("n_removed > 0").collect()}
    assert got == {30_012 + k: 70 for k in range(12)}


@pytest.mark.parametrize("dedup", [suffix_tree.dedup, suffix_array.dedup])
def test_rows_that_repeat_wholly(spark, dedup):
    text = " ".join(f"w{i}" for i in range(300))
    rows = [(1, text)] * 5000 + [(2, text)] * 50 + [(None, text)] * 50
    got = dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).groupBy("doc_id", "n_removed").count().collect()
    size = 300 if dedup is suffix_tree.dedup else len(text)
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, [(1, 0, 5000), (2, size, 50), (None, size, 50)]))


def test_one_gram_in_all(spark, monkeypatch):
    """A gram that fills buckets, within a text and over texts."""
    monkeypatch.setattr(repeats, "BUCKET_BYTES", 2000)
    monkeypatch.setattr(repeats, "FILTER_BYTES", 2000)
    rows = [(i, "ab" * (150 + i) + f" {i}") for i in range(30)] + [(100, "a" * 9000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {x["doc_id"]: (x["n_bytes"], x["n_removed"], x["n_spans"], hashlib.sha256(bytes(x["kept"])).hexdigest()) for x in suffix_array.dedup(df).collect()}
    assert [got[d] for d, _ in rows] == brute_bytes(rows, 100)
