import random
import re

import pytest

from claimlens.llm import jaccard


def brute(rows, words=5, share=80):
    sets = []
    for _, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= share * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), (True, 0)), (d is None, d or 0))
    return sorted((repr(d), len(sets[i]), repr(None if least[root(i)][0] else least[root(i)][1])) for i, (d, _) in enumerate(rows))


def corpus(seed):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows = [(None, None), (1, ""), (2, "one two"), (3, "One  TWO\n"), (4, "one"), (5, " \t\n")]
    bases = [[r.choice(vocab) for _ in range(r.choice([5, 6, 20, 60, 150, 300]))] for _ in range(12)]
    line = [r.choice(vocab) for _ in range(12)]
    for i in range(160):
        w = list(bases[0] if i % 3 == 0 else r.choice(bases))
        for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
            w[r.randrange(len(w))] = r.choice(vocab)
        if r.random() < 0.3:
            w += line
        rows.append((100 + i, " ".join(w) if r.random() < 0.8 else " ".join(w).upper()))
    rows += [rows[20], rows[20], (None, rows[30][1])]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_join(spark, monkeypatch, seed):
    monkeypatch.setattr(jaccard, "BUCKET_BYTES", 5000)
    if seed == 2:
        monkeypatch.setattr(jaccard, "FEW", 0)
        monkeypatch.setattr(jaccard, "BLOCK", 7)
        monkeypatch.setattr(jaccard, "ROUNDS", (1, None))
        monkeypatch.setattr(jaccard, "FLUSH_ANCHORS", 300)
    rows = corpus(seed)
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, c long")
    got = sorted((repr(r[0]), r["n_shingles"], repr(r["component_id"])) for r in jaccard.join(df).collect())
    assert got == brute(rows)


def test_empty_table(spark):
    assert jaccard.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0
