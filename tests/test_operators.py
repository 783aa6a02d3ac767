import json
import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimlens import queries
from claimlens.functions import text as T
from claimlens.operators import chunkers, metrics, prompts, retrieval, sampling, stats
from claimlens.plans import workflows
from claimlens.protocols import HashedEmbedder, PredictedSegmenter, RuleSegmenter
from claimlens.schemas import ARTICLE, CLAIM
from claimlens.sources import collections, jsonl
from claimlens.streaming import ingest

ARTICLES = [
    ("Ada_Page", "Ada -LRB- born 1815 -RRB- wrote notes . She met Bob &amp; Eve .", "0\tAda -LRB- born 1815 -RRB- wrote notes .\tnotes\n1\t\n2\tShe met Bob &amp; Eve .\tBob"),
    ("Empty_Page", "", ""),
    ("Bob_Page", "Bob ran , because Eve ran . Eve won .", "0\tBob ran , because Eve ran .\n1\tEve won ."),
]
CLAIMS = [
    {"id": 1, "label": "SUPPORTS", "verifiable": "VERIFIABLE", "claim": "Ada wrote notes.", "evidence": [[["10", "11", "Ada_Page", "0"]]]},
    {"id": 2, "label": "NOT ENOUGH INFO", "verifiable": "NOT VERIFIABLE", "claim": "Eve ran.", "evidence": [[["15", None, None, None]]]},
    {"id": 3, "label": "REFUTES", "verifiable": "VERIFIABLE", "claim": "", "evidence": [[["Bob_Page", "1"]]]},
]


@pytest.fixture(scope="module")
def articles(spark):
    return spark.createDataFrame(ARTICLES, ARTICLE)


def rows(df):
    return [tuple(r) for r in df.orderBy("article_id", "chunk_index").collect()]


def test_fixed_char(spark):
    df = spark.createDataFrame([("x", "abcdefghij", "")], ARTICLE)
    assert [r[2] for r in rows(chunkers.fixed_char(df, 4, 1))] == ["abcd", "defg", "ghij", "j"]
    with pytest.raises(ValueError):
        chunkers.fixed_char(df, 4, 4)


def test_sentence_and_tokens(articles):
    assert rows(chunkers.sentence(articles)) == [
        ("Ada_Page", 0, "Ada ( born 1815 ) wrote notes .", [0]),
        ("Ada_Page", 1, "She met Bob & Eve .", [1]),
        ("Bob_Page", 0, "Bob ran , because Eve ran .", [0]),
        ("Bob_Page", 1, "Eve won .", [1]),
    ]
    got = rows(chunkers.fixed_token(articles, 6, 2).where("article_id = 'Bob_Page'"))
    assert got == [("Bob_Page", 0, "Bob ran , because Eve ran", [0]), ("Bob_Page", 1, "Eve ran . Eve won .", [0, 1]), ("Bob_Page", 2, "won .", [1])]

    class Words:
        def encode(self, text):
            return text.split(" ")

        def decode(self, ids):
            return " ".join(ids)

    assert rows(chunkers.fixed_token(articles, 6, 2, Words).where("article_id = 'Bob_Page'")) == got


@pytest.mark.parametrize(("n", "width", "overlap", "want"), [(8, 5, 2, ["0-4", "3-7", "6-7"]), (7, 5, 0, ["0-4", "5-6"]), (3, 2, 2, ["0-1", "1-2", "2-2"])])
def test_edu_windows(spark, n, width, overlap, want):
    units = spark.createDataFrame([("a", [(f"u{i}", i) for i in range(n)])], "article_id string, edus array<struct<text:string,sentence_id:int>>")
    got = [f"{r[3][0]}-{r[3][-1]}" for r in rows(chunkers.edu_windows(units, width, overlap))]
    assert got == want


def test_edus(articles):
    got = {r[0]: [tuple(e) for e in r[1]] for r in chunkers.edus(articles).collect()}
    assert got["Bob_Page"] == [("Bob ran ,", 0), ("because Eve ran .", 0), ("Eve won .", 1)]
    assert chunkers.split_by_predictions("ab cd", [0, 3], [1, 1]) == ["ab", "cd"]
    assert chunkers.split_by_predictions("ab cd", [0], [1, 1]) == ["ab cd"]


def test_votes(spark):
    p = spark.createDataFrame([(1, 0, 1), (1, 0, 0), (1, 1, 1), (1, 2, None)], "doc_id long, pos long, pred int")
    got = {m: {r["pos"]: r["pred"] for r in chunkers.token_votes(p, m).collect()} for m in ("max", "avg", "vote")}
    assert got == {"max": {0: 1, 1: 1, 2: 0}, "avg": {0: 0, 1: 1, 2: 0}, "vote": {0: 0, 1: 1, 2: 0}}


def test_factory_and_metadata(articles):
    with pytest.raises(ValueError):
        chunkers.chunk(articles, "other")
    with pytest.raises(ValueError):
        chunkers.chunk(articles, "fixed_char")
    m = chunkers.with_metadata(chunkers.chunk(articles, "sentence"), "sentence").where("article_id = 'Bob_Page' AND chunk_index = 1").first()
    assert (m["chunk_type"], m["chunk_size"], m["token_count"], m["cleaned"]) == ("sentence", 9, 3, True)


def test_metrics(spark):
    ranked = spark.createDataFrame([(1, "b", 1), (1, "a", 2), (1, "c", 3)], "claim_id long, article_id string, rank int")
    gold = spark.createDataFrame([(1, "a"), (1, "z"), (2, "q")], "claim_id long, article_id string")
    got = {r["k"]: (r["precision"], r["recall"], r["accuracy"]) for r in metrics.at_k(ranked, gold, (1, 3, 5)).where("claim_id = 1").collect()}
    assert got == {1: (0, 0, 0), 3: (pytest.approx(1 / 3), 0.5, 1), 5: (pytest.approx(0.2), 0.5, 1)}
    assert {r["claim_id"]: r["rr"] for r in metrics.reciprocal_rank(ranked, gold).collect()} == {1: 0.5, 2: 0.0}
    hits = spark.createDataFrame([(1, "b", 1), (1, "a", 2), (1, "b", 3), (1, "c", 4)], "claim_id long, article_id string, rank int")
    assert [r["article_id"] for r in retrieval.ranked_articles(hits).orderBy("rank").collect()] == ["b", "a", "c"]


def test_stats(spark):
    df = spark.createDataFrame([(1,), (2,), (4,), (9,)], "v int")
    r = df.agg(*stats.block(F.col("v"))).first()
    assert (r["mean"], round(r["std"], 4), r["min"], r["max"], r["median"], r["count"]) == (4, 3.0822, 1, 9, 3, 4)
    assert tuple(df.limit(0).agg(*stats.block(F.col("v"))).first()) == (0, 0, 0, 0, 0, 0)


def test_stratified(spark):
    df = spark.createDataFrame([(i, "A" if i < 6 else "B" if i < 9 else "C") for i in range(10)], "id long, label string")
    got = sampling.stratified(df, 5, "id").groupBy("label").count().collect()
    counts = {r["label"]: r["count"] for r in got}
    assert sum(counts.values()) == 5 and counts["A"] >= 3 and counts["B"] >= 1
    assert sampling.stratified(df, 50, "id").count() == 10
    assert sampling.simple(df, 3, "id").count() == 3


def test_search_agrees(spark):
    r = random.Random(1)
    rows_ = [(i, [r.gauss(0, 1) for _ in range(8)]) for i in range(60)] + [(90, [0.0] * 8), (91, None)]
    points = spark.createDataFrame(rows_, "point_id long, vector array<float>")
    claims = points.where("point_id % 20 = 0").withColumnRenamed("point_id", "claim_id")
    for config in (retrieval.RetrievalConfig(k=4), retrieval.RetrievalConfig("threshold", threshold=0.4)):
        a = sorted((x["claim_id"], x["rank"], x["point_id"]) for x in retrieval.search(points, claims, config).collect())
        b = sorted((x["claim_id"], x["rank"], x["point_id"]) for x in retrieval.search_native(points.where("point_id < 90"), claims, config).collect())
        assert a == b
    with pytest.raises(ValueError):
        retrieval.RetrievalConfig("other")
    assert retrieval.RetrievalConfig("threshold", threshold=0.5).name() == "threshold_0.50"


def test_collections(spark, articles, tmp_path):
    assert collections.collection_name("x/all-mpnet-base-v2", "sentence") == "mpnet_sentence_chunks"
    assert collections.collection_name("x/multi-qa-mpnet-base", "sentence") == "mpnet_sentence_chunks"
    points = collections.numbered(chunkers.sentence(articles))
    assert [r["point_id"] for r in points.orderBy("article_id", "chunk_index").collect()] == [0, 1, 2, 3]
    collections.create(points, str(tmp_path), "c")
    assert collections.verified(spark, str(tmp_path), "c") == 4
    with pytest.raises(ValueError):
        collections.verified(spark, str(tmp_path), "d")


def test_jsonl(spark, tmp_path):
    f = tmp_path / "a.jsonl"
    f.write_text("\n".join([*(json.dumps(dict(zip(("id", "text", "lines"), a, strict=True))) for a in ARTICLES), "not json"]) + "\n")
    assert jsonl.read(spark, str(f), ARTICLE, strict=False).count() == 3
    with pytest.raises(Exception):  # noqa: B017
        jsonl.read(spark, str(f), ARTICLE).collect()
    assert jsonl.read(spark, str(tmp_path / "none"), ARTICLE).count() == 0
    assert jsonl.listed(spark, str(tmp_path))[0].endswith("a.jsonl")
    with pytest.raises(ValueError):
        jsonl.listed(spark, str(tmp_path / "none"))
    assert jsonl.read_capped(spark, [str(f)], ARTICLE, 2).count() == 2
    assert jsonl.count_lines(spark, str(f)) == 4


def test_prompt(spark):
    df = spark.createDataFrame([("c",)], "claim string")
    text = df.select(prompts.prompt(F.col("claim"), F.lit("e"), [("x", "SUPPORTS")])).first()[0]
    assert text == prompts.HEADER + "Examples:\n\nClaim: x\nLabel: SUPPORTS\n\nClaim: c\n\nEvidence:\ne\n\nLabel:"


def test_workflow(spark, articles, tmp_path):
    claims = spark.createDataFrame(CLAIMS, CLAIM)
    out = workflows.run(spark, articles, claims, str(tmp_path), output=str(tmp_path / "out"))
    e = out.evaluation.first()
    assert e["total_claims"] == 1 and e["mean_reciprocal_rank"] == 1.0
    assert out.predictions.count() == 3 and out.accuracy.first()["support"] == 3
    assert HashedEmbedder(4).encode([""]) == [[0, 0, 0, 0]]
    samples, corpus, cover = workflows.reduce_dataset({"dev": (claims, 2)}, articles, 1)
    assert samples["dev"].count() == 2 and cover.count() == 1 and corpus.count() >= 1


def test_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.jsonl").write_text("\n".join(json.dumps(dict(zip(("id", "text", "lines"), a, strict=True))) for a in ARTICLES))
    ingest.chunk_stream(spark, str(source), str(tmp_path / "to"), str(tmp_path / "check")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "to")).count() == 4


def test_slowdown_by_limits(spark):
    times = spark.createDataFrame([(i, float(i * i)) for i in range(40)], "batch long, s double")
    got = stats.slowdown(times, "batch", "s")
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()
    first, last = sum(i * i for i in range(10)) / 10, sum(i * i for i in range(30, 40)) / 10
    assert list(got.first()) == pytest.approx([first, last, last / first])
    few = stats.slowdown(times.where("batch < 3"), "batch", "s").first()
    assert few["first"] == few["last"] == pytest.approx(5 / 3)


def test_containment_of_short_items(spark, tmp_path):
    items = ["one", "wo thr", "two thre", "one two thr", "ne two three fo", "ne two three four fi", "absent", " ", "five\nsix seven eight nine t"]
    texts = ["one two three four five\nsix seven eight nine ten", "stone", "two three", "", None, "one two  three"]
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r["claim_id"], r["article_id"]) for r in queries._contained(spark, str(tmp_path)).collect())
    assert got == sorted((i, str(d)) for i, x in enumerate(items) for d, t in enumerate(texts) if t and x in t)


def test_tiles_find_the_same_hits(spark, monkeypatch):
    r = np.random.default_rng(3)
    points = spark.createDataFrame([(i, f"a{i % 7}", [float(x) for x in r.normal(size=4)]) for i in range(60)] + [(99, "a", None)], "point_id long, article_id string, vector array<double>")
    claims = spark.createDataFrame([(i, [float(x) for x in r.normal(size=4)]) for i in range(9)], "claim_id long, vector array<double>")
    for config in (retrieval.RetrievalConfig(k=3), retrieval.RetrievalConfig("threshold", threshold=0.5)):
        want = sorted(map(tuple, retrieval.search(points, claims, config, digits=9).collect()))
        with monkeypatch.context() as m:
            m.setattr(retrieval, "QUERY_CELLS", 10)
            m.setattr(retrieval, "TILE", 25)
            assert sorted(map(tuple, retrieval.search(points, claims, config, digits=9).collect())) == want and want


def test_containment_of_odd_items(spark, tmp_path):
    """Items of any number of words, at the ends of words too, null and empty ones."""
    items = ["ab", "b", "b c", "a b c", "b cc dd e", "x y z w v", "  b ", "", None, "zz yy", "é ü"]
    texts = ["ab c dd", "a b cc dd ee", "xx y z w vv", "b", "", None, "a  b c", "zzz yyy", "q é üa", "xb cx"]
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r[0], int(r[1])) for r in queries.queries()["gold_from_containment"](spark, str(tmp_path)).collect())
    assert got == [(i, d) for i, x in enumerate(items) for d, t in enumerate(texts) if x and t and x in t]


def test_verifiable_counts(spark):
    rows = [(1, "VERIFIABLE", [[["1", "2", "A"], ["1", "2", None]]]), (2, "VERIFIABLE", [[["1", "2", "A"], ["B", "3"]]]), (3, "NOT VERIFIABLE", [[["1", "2", "C"]]]), (4, None, None)]
    df = spark.createDataFrame(rows, "id long, verifiable string, evidence array<array<array<string>>>")
    assert tuple(sampling.verifiable_counts(df).first()) == (2, 2)
    assert tuple(sampling.verifiable_counts(df.where("id > 2")).first()) == (0, 0)
    assert tuple(sampling.reference_counts(df).first()) == (3, 2)


def test_predicted_segmenter(spark):
    class Model:
        def offsets(self, text):
            return [i for i, c in enumerate(text) if c != " " and (i == 0 or text[i - 1] == " ")]

        def predict(self, text):
            if "fail" in text:
                raise ValueError(text)
            return [1] * (len(self.offsets(text)) - ("short" in text))

    segmenter = PredictedSegmenter(Model)
    assert segmenter.boundaries("one two three") == [4, 8]
    assert segmenter.boundaries("fail now") == [] and segmenter.boundaries("short of one") == []


def test_names_by_the_whole_path():
    assert collections.collection_name("multi-qa-lab/foo-v1", "sentence") == "multiqa_sentence_chunks"
    assert collections.collection_name("x/Foo-v1", "sentence") == "foo_sentence_chunks"


def test_run_calls_the_model_once_and_writes_all(spark, articles, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    class Counting:
        def generate(self, prompts):
            calls.add(len(prompts))
            return ["REFUTES"] * len(prompts)

    claims = spark.read.schema(CLAIM).json(spark.sparkContext.parallelize([json.dumps(c) for c in CLAIMS]))
    out = workflows.run(spark, articles, claims, str(tmp_path / "c"), "custom_edu", generator=Counting, output=str(tmp_path / "out"), overlap=1, edus_per_chunk=2)
    assert [out.accuracy.first()["support"], out.weighted.first()["support"], out.confusion.count()] == [3, 3, 3]
    assert calls.value == 3
    read = lambda name: spark.read.json(str(tmp_path / "out" / name))
    assert {r["metric"] for r in read("statistics_custom_edu_hashed").collect()} >= {"chunk_characters", "edu_tokens", "edus_per_chunk", "edus_per_sentence"}
    assert read("builds").first()["articles"] == 2 and read("evaluations").first()["avg_retrieval_time_ms"] > 0
    assert read("metrics").first()["model"] == "overlap" and read("per_class").count() == 3 and read("results").count() == 3


def test_models_are_added_by_name():
    assert workflows.add_embedding_model("m", HashedEmbedder).add("n", HashedEmbedder)["n"] is HashedEmbedder
    with pytest.raises(ValueError):
        workflows.MODELS["none"]


def _copies(n: int, dim: int) -> list[tuple[int, list[float]]]:
    """n different vectors, each three times, far apart."""
    r = np.random.default_rng(5)
    return [(i, [float(x) for x in v]) for i, v in enumerate(np.tile(r.normal(size=(n, dim)), (3, 1)).tolist())]


def test_native_search_of_many_claims(spark, monkeypatch):
    """More than 10,000 claims, claims in blocks, copies, vectors too wide to be written out, and few points."""
    points = spark.createDataFrame(_copies(150, 6), "point_id long, vector array<float>").repartition(3)
    claims = points.where("point_id % 11 = 0").withColumnRenamed("point_id", "claim_id")
    hits = lambda df: sorted((x["claim_id"], x["rank"], x["point_id"]) for x in df.collect())
    for config in (retrieval.RetrievalConfig(k=4), retrieval.RetrievalConfig("threshold", threshold=0.9)):
        want = hits(retrieval.search(points, claims, config))
        assert hits(retrieval.search_native(points, claims, config)) == want and want
        with monkeypatch.context() as m:
            m.setattr(retrieval, "QUERY_CELLS", 150)
            m.setattr(retrieval, "UNROLLED", 5)
            assert hits(retrieval.search_native(points, claims, config)) == want
    many = spark.range(10_001).select(F.col("id").alias("claim_id"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("vector"))
    two = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "point_id long, vector array<double>")
    got = retrieval.search_native(two, many, retrieval.RetrievalConfig(k=1)).groupBy("point_id").count().collect()
    assert {r["point_id"]: r["count"] for r in got} == {1: 2, 2: 9_999}


def test_search_holds_few_scores():
    """Neither the claims nor the points of a batch decide how much a task holds; ties go to the smaller id."""
    r = np.random.default_rng(7)
    v, q = r.normal(size=(10_000, 8)), r.normal(size=(3_000, 8))
    v[5_000:] = v[:5_000]
    order = r.permutation(10_000).tolist()
    q /= np.linalg.norm(q, axis=1)[:, None]
    tracemalloc.start()
    for config in (retrieval.RetrievalConfig(k=3), retrieval.RetrievalConfig("threshold", threshold=0.99)):
        for ids, places, scores in retrieval._best(v, order, list(range(3_000)), q, config, None):
            if 0 in ids and config.strategy == "top_k":
                unit = v[:5_000] / np.linalg.norm(v[:5_000], axis=1)[:, None]
                exact = np.tile((unit * q[0]).sum(axis=1), 2)
                want = sorted(range(10_000), key=lambda i: (-exact[i], order[i]))[:3]
                assert [int(p) for i, p in zip(ids, places, strict=True) if i == 0] == want
            del ids, places, scores
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 100e6


def test_hashed_weights_by_size(spark, monkeypatch):
    """Tasks that count words grow in number with the texts, not in size."""
    texts = spark.createDataFrame([(i % 90, f"a b{i} a c{i % 7} " * 20) for i in range(100)] + [(95, None), (96, "")], "doc_id long, text string")
    want = sorted(map(tuple, retrieval.hashed_weights(texts, "doc_id", F.col("text")).collect()))
    monkeypatch.setattr(retrieval, "TASK_BYTES", 400)
    got = retrieval.hashed_weights(texts, "doc_id", F.col("text"))
    assert sorted(map(tuple, got.collect())) == want and len({r[0] for r in want}) == 90
    tasks = got.select(F.spark_partition_id()).distinct().count()
    assert tasks > 30


def test_edus_hold_few_rows(spark, tmp_path):
    """Only some rows of a batch are Python objects at once."""
    to = str(tmp_path / "most")

    class Watching:
        def __init__(self):
            tracemalloc.start()

        def boundaries(self, line):
            if line.startswith("last"):
                with open(to, "w") as f:
                    f.write(str(tracemalloc.get_traced_memory()[1]))
                tracemalloc.stop()
            return []

    lines = "\n".join(f"{i}\tsentence {i}" for i in range(50))
    df = spark.range(4_000).coalesce(1).select(F.col("id").cast("string").alias("id"), F.lit("x").alias("text"), F.when(F.col("id") == 3_999, "0\tlast").otherwise(lines).alias("lines"))
    got = chunkers.edus(df, Watching, entities=False).agg(F.sum(F.size("edus")), F.count("*")).first()
    assert tuple(got) == (3_999 * 50 + 1, 4_000)
    assert int(open(to).read()) < 8e6


def test_unit_statistics_cut_once(spark, articles):
    """Units are made once for all statistics of them."""
    calls = spark.sparkContext.accumulator(0)

    class Counting(RuleSegmenter):
        def boundaries(self, line):
            calls.add(1)
            return super().boundaries(line)

    got = {r["metric"]: r for r in stats.edu_stats(chunkers.edus(articles, Counting)).collect()}
    assert calls.value == 4
    assert [got["edus_per_sentence"][c] for c in ("mean", "min", "max", "median", "count")] == [1.25, 1, 2, 1, 4]
    assert [got["edu_tokens"][c] for c in ("mean", "min", "max", "count")] == [4.8, 3, 8, 5]


def test_units_of_chunks_cut_once(spark, articles):
    calls = spark.sparkContext.accumulator(0)

    class Words:
        def boundaries(self, line):
            calls.add(1)
            return [i + 1 for i, c in enumerate(line) if c == " "]

    units = chunkers.edus(articles, Words)
    r = stats.edus_per_chunk(units).first()
    assert calls.value == 4
    sizes = [len(w) for _, n in ((r["article_id"], len(r["edus"])) for r in units.collect()) for w in (range(i, min(i + 5, n)) for i in range(0, n, 3))]
    assert (r["count"], r["mean"], r["min"], r["max"]) == (len(sizes), pytest.approx(sum(sizes) / len(sizes)), min(sizes), max(sizes))


def test_points_without_sentences(spark):
    """Chunks whose sentences nobody asks for don't look for them; the chunks are the same."""
    df = spark.createDataFrame([("x", "ab cd  ef gh " * 9, "0\tab cd\n1\tef gh"), ("y", " \x1c ", "0\ta"), ("z", None, None)], ARTICLE)
    want = [r[:3] for r in rows(chunkers.fixed_char(df, 10, 2, entities=False))]
    got = chunkers.fixed_char(df, 10, 2, entities=False, sentence_ids=False)
    assert rows(got) == want and want
    assert "split" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_text_is_only_cleaned_where_seen(spark):
    """Sentences and units need to know whether cleaning leaves anything; at the ends any white space goes."""
    spaces = [chr(c) for c in (*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
    texts = ["", None, "a", " -LRB- ", "-A-", "​", "".join(spaces), *spaces, *(c + "a b" + c + c for c in spaces)]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    t = F.col("t")
    old = F.regexp_replace(t, "(?U)^[\\s\\x1c-\\x1f]+|[\\s\\x1c-\\x1f]+$", "")
    for r in df.select((T.clean(t, False) != "").alias("a"), T.filled(t).alias("b"), old.alias("c"), T.strip(t).alias("d")).collect():
        assert (r.a, r.c) == (r.b, r.d)
    plan = chunkers.sentence(spark.createDataFrame(ARTICLES, ARTICLE), entities=False)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(coalesce(text" not in plan and "(?U)^" not in plan
