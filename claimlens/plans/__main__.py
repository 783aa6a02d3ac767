"""python -m claimlens.plans WIKI CLAIMS ROOT [options]: build, evaluate and classify."""

from __future__ import annotations

import argparse
import importlib

from pyspark.sql import SparkSession

from ..operators import prompts, sampling
from ..operators.retrieval import RetrievalConfig
from ..schemas import ARTICLE, CLAIM, LABELS
from ..sources import jsonl
from . import workflows


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("wiki_dir")
    p.add_argument("claims")
    p.add_argument("root")
    # Names and defaults of options.
    p.add_argument("--chunker_type", default="sentence")
    p.add_argument("--chunking_overlap", type=int, default=0)
    p.add_argument("--chunk_size", type=int, default=500)
    p.add_argument("--max_tokens", type=int, default=128)
    p.add_argument("--edus_per_chunk", type=int, default=5)
    p.add_argument("--retrieval_strategy", default="top_k")
    p.add_argument("--top_k", type=int, default=5)
    p.add_argument("--k_retrieval", type=int)
    p.add_argument("--threshold", type=float, default=0.5)
    p.add_argument("--max_files", type=int)
    p.add_argument("--max_claims", type=int)
    p.add_argument("--max_evidence", type=int, default=5)
    p.add_argument("--embedding_model_name", default="hashed")
    p.add_argument("--llm_name", default="overlap")
    p.add_argument("--temperature", type=float, default=0.0)
    p.add_argument("--few_shot_examples", type=int, default=0)
    p.add_argument("--examples_file")
    p.add_argument("--output")
    p.add_argument("--plugin", action="append", default=[], help="a module to import first: it may add chunkers, embedding models and generators")
    a = p.parse_args(argv)
    for name in a.plugin:
        importlib.import_module(name)
    spark = SparkSession.builder.appName("claimlens").getOrCreate()
    files = jsonl.listed(spark, a.wiki_dir)[: a.max_files]
    articles = jsonl.read(spark, files, ARTICLE, strict=False)
    claims = jsonl.read(spark, a.claims, CLAIM, strict=False, limit=a.max_claims)
    examples = None
    if a.few_shot_examples:
        labelled = jsonl.read(spark, a.examples_file or a.claims, CLAIM, strict=False)
        examples = [(r["claim"], r["label"]) for r in sampling.first_of_each(labelled, a.few_shot_examples, "id", LABELS).collect()]
    config = RetrievalConfig(a.retrieval_strategy, a.k_retrieval or a.top_k, a.threshold)
    options = {"fixed_char": {"size": a.chunk_size, "overlap": a.chunking_overlap}, "fixed_token": {"size": a.max_tokens, "overlap": a.chunking_overlap}, "custom_edu": {"overlap": a.chunking_overlap, "edus_per_chunk": a.edus_per_chunk}}.get(a.chunker_type, {})
    out = workflows.run(spark, articles, claims, a.root, a.chunker_type, config, prompts.GENERATORS[a.llm_name](a.temperature), examples=examples, max_evidence=a.max_evidence, output=a.output, model=a.embedding_model_name, llm=a.llm_name, temperature=a.temperature, **options)
    for title, df in (("retrieval", out.evaluation), ("accuracy", out.accuracy), ("weighted", out.weighted), ("confusion", out.confusion)):
        print(workflows.report(df, title))


if __name__ == "__main__":
    main()
