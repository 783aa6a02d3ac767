"""From raw documents to packed sequences: five stages, each over all that the one before kept.

Each stage's result is written as Parquet and read again. All but the last return the columns
of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlens.llm import frames, jaccard, mixing, packing, suffix_array, toxicity
from claimlens.llm.queries import tokenizer_path


def free_name(docs: DataFrame) -> str:
    """A column name that docs doesn't have."""
    return "_" + max(docs.columns, key=len)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go. It is fitted on labelled rows of this input."""
    model = toxicity.fit_on(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = free_name(docs)
    return toxicity.score(docs, model, name=score).where(F.col(score) < 0.5).drop(score)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by shingle similarity, the one with the least id stays."""
    return jaccard.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of long strings that occur earlier leave the texts; documents of which nothing is
    left go, those that were empty before stay. n_chars follows the text."""
    keep = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    cut = suffix_array.dedup_rows(docs, keep=keep, as_text=True).where("n_removed = 0 OR kept <> ''")
    length = F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("own.n_chars")) if "n_chars" in keep else None
    changed = {"text": F.col("kept"), "n_chars": length}
    return cut.select(*(changed.get(c, F.col(f"own.`{c}`")).alias(c) for c in docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.repeated(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their token ids and places in sequences."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("source_mix", mix_sources),
    ("packing", pack_sequences),
]

#: SQL has neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = frames.staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if last is not None:
            frames.drop(last)
        last = docs
    return docs
