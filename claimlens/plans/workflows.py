"""Whole workflows: build a collection, evaluate retrieval, classify claims, reduce a dataset."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import product
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import evidence_articles
from ..operators import chunkers, metrics, prompts, retrieval, sampling, stats
from ..protocols import Embedder, Generator, HashedEmbedder, OverlapGenerator
from ..sources import collections, jsonl


class Models:
    """Embedding models by name; add() can be chained."""

    def __init__(self) -> None:
        self.known: dict[str, Callable[[], Embedder]] = {"hashed": HashedEmbedder}

    def add(self, name: str, make: Callable[[], Embedder]) -> Models:
        self.known[name] = make
        return self

    def __getitem__(self, name: str) -> Callable[[], Embedder]:
        if name not in self.known:
            raise ValueError(f"unknown embedding model: {name}")
        return self.known[name]


MODELS = Models()


def add_embedding_model(name: str, make: Callable[[], Embedder]) -> Models:
    return MODELS.add(name, make)


def statistics(spark: SparkSession, articles: DataFrame, points: DataFrame, kind: str, **options: Any) -> DataFrame:
    """Statistics of a collection's chunks, and of the sentences or units that they are made of."""
    out = stats.chunk_stats(points)
    if kind == "custom_edu":
        units = chunkers.edus(articles, *([options["segmenter"]] if "segmenter" in options else []))
        return out.unionByName(stats.edu_stats(units)).unionByName(stats.edus_per_chunk(units, options.get("edus_per_chunk", 5), options.get("overlap", 2)))
    return out.unionByName(stats.sentence_stats(chunkers.sentence(articles)))


def build_collection(articles: DataFrame, root: str, chunker: str = "sentence", model: str = "hashed", embedder: Callable[[], Embedder] | None = None, reset: bool = True, output: str | None = None, **options: Any) -> str:
    """Clean, chunk, describe, number, embed and write; returns the collection's name. output: a
    folder for its statistics and for a record of its totals and time."""
    began, spark = time.time(), articles.sparkSession
    chunks = chunkers.with_metadata(chunkers.chunk(articles, chunker, **options), chunker, **options)
    points = retrieval.embed(collections.numbered(chunks), embedder=embedder or MODELS[model])
    name = collections.collection_name(model, chunker)
    collections.create(collections.enriched(points, model, chunker), root, name, reset)
    if output:
        seconds, written = time.time() - began, collections.opened(spark, root, name)
        tail = model.rstrip("/").split("/")[-1]
        jsonl.overwrite(statistics(spark, articles, written, chunker, **options), f"{output}/statistics_{chunker}_{tail}")
        totals = stats.ingested(written).select(F.lit(name).alias("collection_name"), "*", F.lit(seconds).alias("seconds"), F.try_divide(F.col("chunks"), F.lit(seconds)).alias("chunks_per_second"))
        jsonl.append(totals, f"{output}/builds")
    return name


def build_all(articles: DataFrame, root: str, models: dict[str, Callable[[], Embedder]], kinds: dict[str, dict[str, Any]], reset: bool = True, output: str | None = None) -> list[str]:
    """A collection for each model and chunker."""
    return [build_collection(articles, root, kind, model, make, reset, output, **options) for (model, make), (kind, options) in product(models.items(), kinds.items())]


def gold_of(claims: DataFrame) -> DataFrame:
    """claim_id, article_id from nested evidence."""
    return claims.select(F.col("id").alias("claim_id"), F.explode(evidence_articles(F.col("evidence"))).alias("article_id"))


def embedded_claims(claims: DataFrame, embedder: Callable[[], Embedder] = HashedEmbedder) -> DataFrame:
    named = claims.select(F.col("id").alias("claim_id"), "claim", *(["label"] if "label" in claims.columns else []))
    return retrieval.embed(named, "claim", embedder=embedder)


@dataclass
class Results:
    hits: DataFrame
    evaluation: DataFrame
    predictions: DataFrame | None = None
    accuracy: DataFrame | None = None
    weighted: DataFrame | None = None
    confusion: DataFrame | None = None
    config: dict[str, Any] = field(default_factory=dict)


def _once(df: DataFrame) -> tuple[DataFrame, float]:
    """df, kept so that what reads it doesn't compute it again, and the seconds that it took."""
    began = time.time()
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    kept.count()
    return kept, time.time() - began


def evaluate_retrieval(points: DataFrame, claims: DataFrame, config: retrieval.RetrievalConfig, ks: tuple[int, ...] = metrics.KS, embedder: Callable[[], Embedder] = HashedEmbedder, hits: DataFrame | None = None) -> Results:
    """Hits of the claims with text and gold, and their evaluation with the mean time of a claim.
    hits: of these claims and any others, if they are there already."""
    gold = gold_of(claims)
    named = claims.select(F.col("id").alias("claim_id"), "claim")
    seconds = None
    if hits is None:
        hits, seconds = _once(retrieval.search(points, metrics.relevant(embedded_claims(claims, embedder), gold), config))
    asked = metrics.relevant(named, gold).select("claim_id")
    kept = gold.join(asked, "claim_id", "left_semi")
    evaluation = metrics.evaluation(retrieval.ranked_articles(hits.join(asked, "claim_id", "left_semi")), kept, ks)
    if seconds is not None:
        evaluation = evaluation.withColumn("avg_retrieval_time_ms", F.try_divide(F.lit(1000 * seconds), F.col("total_claims")))
    return Results(hits, evaluation, config={"strategy": config.name()})


def run(spark: SparkSession, articles: DataFrame, claims: DataFrame, root: str, chunker: str = "sentence", config: retrieval.RetrievalConfig | None = None, generator: Callable[[], Generator] = OverlapGenerator, embedder: Callable[[], Embedder] | None = None, examples: list[tuple[str, str]] | None = None, max_evidence: int = 5, output: str | None = None, model: str = "hashed", llm: str = "overlap", temperature: float = 0.0, **options: Any) -> Results:
    """Build, evaluate and classify; vectors, hits and answers are computed once and serve all."""
    config, embedder = config or retrieval.RetrievalConfig(), embedder or MODELS[model]
    name = build_collection(articles, root, chunker, model, embedder, output=output, **options)
    points = collections.opened(spark, root, name)
    everyone = embedded_claims(claims, embedder)
    hits, seconds = _once(retrieval.search(points, everyone, config))
    out = evaluate_retrieval(points, claims, config, embedder=embedder, hits=hits)
    out.evaluation = out.evaluation.withColumn("avg_retrieval_time_ms", F.lit(1000 * seconds / max(1, claims.count())))
    out.predictions, _ = _once(prompts.predict(everyone.drop("vector"), hits, generator, examples, max_evidence))
    labelled = out.predictions.withColumnRenamed("label", "true_label")
    out.accuracy, out.weighted, out.confusion = metrics.accuracy(labelled), metrics.weighted(labelled), metrics.confusion(labelled)
    if output:
        known = {"chunker": chunker, **{k: v for k, v in options.items() if isinstance(v, (int, float, str, bool))}}
        record = jsonl.run_record(spark, out.evaluation, embedding_model=model, chunker=chunker, chunker_config=json.dumps(known), collection_name=name, retrieval_strategy=config.strategy, retrieval_k=config.k if config.strategy == "top_k" else None, retrieval_threshold=config.threshold if config.strategy == "threshold" else None, overlap=options.get("overlap"))
        jsonl.append(record, f"{output}/evaluations")
        jsonl.overwrite(jsonl.grouped_results(hits, claims.select(F.col("id").alias("claim_id"), "claim")), f"{output}/results")
        jsonl.overwrite(labelled.select("claim_id", "claim", "true_label", "predicted_label", (F.col("true_label") == F.col("predicted_label")).alias("correct")), f"{output}/predictions")
        jsonl.overwrite(metrics.per_class(labelled), f"{output}/per_class")
        setup = [F.lit(v).alias(k) for k, v in (("model", llm), ("few_shot_examples", len(examples or [])), ("temperature", temperature))]
        jsonl.overwrite(out.weighted.join(out.accuracy.select("accuracy")).select(*setup, "accuracy", "precision", "recall", "f1", "support"), f"{output}/metrics")  # one row each
    return out


def reduce_dataset(splits: dict[str, tuple[DataFrame, int]], docs: DataFrame, extra: int, output: str | None = None, seed: int = sampling.SEED) -> tuple[dict[str, DataFrame], DataFrame, DataFrame]:
    """Stratified samples of the splits, the corpus that they need and `extra` more documents in
    random order, and the coverage of what is needed."""
    samples = {k: sampling.stratified(df, n, "id", seed=seed) for k, (df, n) in splits.items()}
    ids = sampling.required_ids(*samples.values())
    corpus = sampling.shuffled(sampling.reduced(docs, ids, extra, seed=seed), "id", seed)
    if output:
        for k, df in samples.items():
            jsonl.overwrite(df, f"{output}/{k}")
        jsonl.overwrite(corpus, f"{output}/wiki")
    return samples, corpus, sampling.coverage(corpus, ids)


def report(df: DataFrame, title: str = "", rows: int = 50) -> str:
    """A small table as text, numbers with three digits."""
    head = df.limit(rows).collect()
    lines = [title] if title else []
    for r in head:
        lines.append(" | ".join(f"{k}={v:.3f}" if isinstance(v, float) else f"{k}={v}" for k, v in r.asDict().items()))
    return "\n".join(lines)
