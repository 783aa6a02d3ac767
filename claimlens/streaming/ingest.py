"""Incremental ingest: new article files become chunks as they arrive. An extension; chunkers
keep no state between articles, so the batch transformations serve as they are."""

from __future__ import annotations

from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import chunkers
from ..schemas import ARTICLE


def chunk_stream(spark: SparkSession, source: str, target: str, checkpoint: str, kind: str = "sentence", once: bool = True, **options: Any) -> StreamingQuery:
    """Read JSON Lines files of articles from source and append their chunks to target."""
    articles = spark.readStream.schema(ARTICLE).option("mode", "DROPMALFORMED").json(source)
    writer = chunkers.chunk(articles, kind, **options).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
