"""The pipeline's stages against brute force, each on its own input."""

import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from claimlens.llm import mixing, packing
from claimlens.llm.queries import tokenizer_path
from tests.llm import test_jaccard


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(9)
    vocab = [f"w{i}" for i in range(300)]
    line = " ".join(r.choice(vocab) for _ in range(30))
    rows, labels = [], []
    for i in range(120):
        words = [r.choice(vocab) for _ in range(r.choice([20, 60, 120]))]
        if i % 3 == 0:
            words[3] = words[-2] = r.choice(["nastyword", "vileslur"])
        text = " ".join(words) + ("\n" + line if i % 5 == 0 else "")
        rows.append((i, text, "en", f"src{i % 3}", len(text)))
        labels.append((i, 1, int(i % 3 == 0)))
    rows += [(1000 + i, rows[i][1] + (" more" if i % 2 else ""), "en", "src1", len(rows[i][1])) for i in range(1, 40)]
    rows += [(2000, None, None, None, None), (2001, "", "en", "src2", 0), (None, "a text of its own without an id", "en", "src2", 31), (5, rows[5][1], "en", "src2", 1)]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


@pytest.mark.skipif(not os.path.exists("/opt/tokenizers"), reason="no vocabulary files")
def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    steps = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [tuple(r) for r in docs.collect()]
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{k}")
        after = spark.read.parquet(f"{tmp_path}/{k}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        steps.append((name, before, [tuple(r) for r in after.collect()]))
        docs = after
    (_, raw, clean), (_, _, single), (_, _, cut), (_, _, mixed), (_, _, packed) = steps
    assert not Counter(map(repr, clean)) - Counter(map(repr, raw))
    toxic = [r for r in raw if r[1] and ("nastyword" in r[1] or "vileslur" in r[1])]
    kept = Counter(map(repr, clean))
    assert sum(kept[repr(r)] > 0 for r in toxic) <= 0.2 * len(toxic)
    assert sum(kept[repr(r)] == 0 for r in raw if r not in toxic) <= 5
    # one of each linked group, the least id
    want = test_jaccard.brute([(r[0], r[1]) for r in clean])
    least = {(d, n, c) for d, n, c in want if d == c or n == 0}
    assert {repr(r[0]) for r in single} == {d for d, _, _ in least}
    # bytes of repeats leave the texts
    data, first, left = [((r[0] is None, r[0] or 0), (r[1] or "").encode()) for r in single], {}, {}
    for d, b in data:
        for s in range(len(b) - 99):
            first[b[s : s + 100]] = min(first.get(b[s : s + 100], (d, s)), (d, s))
    for (d, b), r in zip(data, single, strict=True):
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - 99):
            if first[b[s : s + 100]] < (d, s):
                gone[s : s + 100] = True
        text = bytes(np.frombuffer(b, np.uint8)[~gone]).decode("utf-8", "ignore")
        if text or not gone.any():
            left[r[0]] = text
    assert {r[0]: r[1] or "" for r in cut} == left
    # as many copies as the mix takes, and all of their tokens
    times = {r["doc_id"]: r["repeats"] for r in mixing.mix(spark.read.parquet(f"{tmp_path}/2")).collect()}
    copies = Counter(r[0] for r in mixed)
    assert all(copies[d] == n for d, n in times.items())
    tokens = packing.pieces(spark.read.parquet(f"{tmp_path}/3"), tokenizer_path()).selectExpr("sum(length)").first()[0]
    assert sum(r[2] for r in packed) == tokens


def test_run(spark, folder, tmp_path):
    """The stages one after the other; what a stage does is tested above."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    got = corpus_pipeline.run(spark, folder)
    assert got.columns == docs.columns and corpus_pipeline.ORACLE_SQL is None
    assert Counter(map(repr, got.collect())) == Counter(map(repr, docs.collect())) and docs.count() > 0


@pytest.mark.skipif(not os.path.exists("/opt/tokenizers"), reason="no vocabulary files")
def test_sequences_hold_the_texts(spark):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(tokenizer_path())
    texts = ["one two three", "", "w " * 2500, None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ids, filled = {}, {}
    for r in corpus_pipeline.pack_sequences(spark, docs, "").orderBy("doc_id", "start").collect():
        piece = np.frombuffer(bytes(r["ids"]), "<u4").tolist()
        ids.setdefault(r["doc_id"], []).extend(piece)
        filled.setdefault(r["sequence_id"], []).append((r["offset"], piece))
    assert [ids[i] for i in range(4)] == [model.encode(t or "", add_special_tokens=False).ids + [packing.END_ID] for t in texts]
    for placed in filled.values():
        assert [o for o, _ in sorted(placed)] == np.cumsum([0] + [len(x) for _, x in sorted(placed)])[:-1].tolist()


def test_stages_keep_columns_of_any_names(spark, folder):
    """Columns that have the names of a stage's own, repeated rows and an empty table."""
    from tests.llm.test_queries import CLASHES

    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(30)
    docs = docs.union(docs.limit(2)).select("*", *(F.lit(i).alias(c) for i, c in enumerate(CLASHES.split())))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and out.count() > 0, name
        assert out.select(*CLASHES.split()).distinct().collect() == docs.select(*CLASHES.split()).distinct().collect()
        assert stage(spark, docs.limit(0), folder).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() > 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), folder).count() == 0
