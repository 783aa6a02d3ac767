"""Collections of points: Parquet tables named by model and chunker."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .jsonl import exists


def collection_name(model: str, chunker: str) -> str:
    """Last part of the model's path up to a dash, lower case; models of some families, whose names
    stand anywhere in the path, by family."""
    tail = model.rstrip("/").split("/")[-1]
    short = tail.split("-")[0].lower()
    for mark, name in (("minilm", "minilm"), ("mpnet", "mpnet"), ("multi-qa", "multiqa")):
        if mark in model.lower():
            short = name
            break
    return f"{short}_{chunker}_chunks"


def name_column(model, chunker):
    """collection_name over columns."""
    tail = F.element_at(F.split(model, "/"), -1)
    low = F.lower(model)
    short = F.when(F.contains(low, F.lit("minilm")), "minilm").when(F.contains(low, F.lit("mpnet")), "mpnet").when(F.contains(low, F.lit("multi-qa")), "multiqa").otherwise(F.lower(F.split_part(tail, F.lit("-"), F.lit(1))))
    return F.concat(short, F.lit("_"), chunker, F.lit("_chunks"))


def numbered(chunks: DataFrame, start: int = 0) -> DataFrame:
    """Adds point_id, dense in the order of articles and chunks. Articles are counted by the first
    characters of their ids; only these ranges' sums meet in one task."""
    sizes = chunks.groupBy("article_id").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("__range").orderBy("article_id").rowsBetween(Window.unboundedPreceding, -1)
    # ranges by the first characters of the id: their order is the ids' order
    ranged = sizes.withColumn("__range", F.substring("article_id", 1, 3))
    ranges = ranged.groupBy("__range").agg(F.sum("__n").alias("__sum"))
    base = ranges.select("__range", F.coalesce(F.sum("__sum").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    first = ranged.withColumn("__in", F.coalesce(F.sum("__n").over(before), F.lit(0))).join(base, "__range").select("article_id", (F.col("__base") + F.col("__in") + F.lit(start)).alias("__first"))
    return chunks.join(first, "article_id").withColumn("point_id", F.col("__first") + F.row_number().over(Window.partitionBy("article_id").orderBy("chunk_index")) - 1).drop("__first")


def enriched(points: DataFrame, model: str, chunker: str) -> DataFrame:
    return points.withColumns({"embedding_model": F.lit(model), "chunking_method": F.lit(chunker)})


def create(points: DataFrame, root: str, name: str, reset: bool = True) -> str:
    """Write a collection; reset replaces one that is there, else rows are added."""
    path = f"{root.rstrip('/')}/{name}"
    points.write.mode("overwrite" if reset else "append").parquet(path)
    return path


def verified(spark: SparkSession, root: str, name: str) -> int:
    """Points of a collection; ValueError if there is none."""
    path = f"{root.rstrip('/')}/{name}"
    if not exists(spark, path):
        raise ValueError(f"no collection {name}")
    return spark.read.parquet(path).count()


def opened(spark: SparkSession, root: str, name: str) -> DataFrame:
    if not exists(spark, f"{root.rstrip('/')}/{name}"):
        raise ValueError(f"no collection {name}")
    return spark.read.parquet(f"{root.rstrip('/')}/{name}")
