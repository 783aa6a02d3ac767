"""One query for each operator of this subpackage, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, jaccard, licenses, media, mixing, packing, site_style, suffix_array, suffix_tree, toxicity


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_tree.dedup(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = toxicity.fit_on(docs, _read(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    held_out = F.coalesce(toxicity.fold() == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where(F.col("vec_id") % 50 == 0))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = site_style.extract(_read(spark, sf_dir, "pages"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def tokenizer_path() -> str:
    """Where the vocabulary of the packed ids lies; a parameter of the operator."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the digest is of the ids as they stand in the sequences
    out = packing.pack(_read(spark, sf_dir, "documents"), tokenizer_path())
    return out.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_array.dedup(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(_read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.read_back(media.store(_read(spark, sf_dir, "documents")))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_read(spark, sf_dir, "documents"))


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_substring_dedup": op1_substring_dedup,
        "op2_toxicity": op2_toxicity,
        "op3_nearest_neighbours": op3_nearest_neighbours,
        "op4_html_extraction": op4_html_extraction,
        "op5_packing": op5_packing,
        "op6_suffix_array_dedup": op6_suffix_array_dedup,
        "op7_jaccard_join": op7_jaccard_join,
        "op8_media_columns": op8_media_columns,
        "op9_license_scan": op9_license_scan,
        "op10_source_mix": op10_source_mix,
    }


def oracle_sql() -> dict[str, str]:
    return {"op9_license_scan": licenses.oracle(), "op10_source_mix": mixing.oracle()}
