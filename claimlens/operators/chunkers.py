"""Chunkers: articles (id, text, lines) to one row per chunk.

All give article_id, chunk_index, text and sentence_ids. Sentence ids count the
non-empty sentences of the article's lines.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..protocols import RuleSegmenter, Segmenter, Tokenizer

#: Rows of a batch that are Python objects at once.
ROWS = 256


def prepared(articles: DataFrame, entities: bool = True) -> DataFrame:
    """Articles with cleaned text and parsed sentences; articles without text are left out."""
    out = T.materialised(articles, article_id=F.col("id").cast("string"), clean=T.clean(F.col("text"), entities), sentences=T.annotated_sentences(F.col("lines"), entities))
    return out.where(F.col("clean") != "")


def _sentences(articles: DataFrame, entities: bool) -> DataFrame:
    """The same without the cleaned text, which is made only if it must be seen."""
    if entities:
        return prepared(articles).drop("clean")
    return T.materialised(articles.where(T.filled(F.col("text"))), article_id=F.col("id").cast("string"), sentences=T.annotated_sentences(F.col("lines"), entities))


def _explode(df: DataFrame, chunks: Column) -> DataFrame:
    """chunks: array of text and sentence_ids; empty texts go before chunks are numbered."""
    kept = F.filter(chunks, lambda c: c["text"] != "")
    return df.select("article_id", F.posexplode(kept).alias("chunk_index", "c")).select("article_id", "chunk_index", "c.text", "c.sentence_ids")


def _overlapping(positions: Column, start: Column, end: Column) -> Column:
    return F.transform(F.filter(positions, lambda p: (p["s"] < end) & (p["e"] > start)), lambda p: p["i"])


def sentence(articles: DataFrame, entities: bool = True) -> DataFrame:
    return _explode(_sentences(articles, entities), F.transform("sentences", lambda s, i: F.struct(s.alias("text"), F.array(i).alias("sentence_ids"))))


def _placed(df: DataFrame) -> DataFrame:
    """Prepared articles with the places of their sentences."""
    return T.materialised(df, article_id=F.col("article_id"), clean=F.col("clean"), positions=T.sentence_positions("clean", "sentences"))


def _step(size: int, overlap: int) -> int:
    if size <= 0 or overlap < 0 or overlap >= size:
        raise ValueError(f"overlap {overlap} must be at least 0 and below size {size}")
    return size - overlap


def fixed_char(articles: DataFrame, size: int = 500, overlap: int = 50, entities: bool = True, sentence_ids: bool = True) -> DataFrame:
    """Windows of `size` characters. sentence_ids: False leaves them out, and sentences aren't looked for."""
    step = _step(size, overlap)
    starts = F.sequence(F.lit(0), F.length("clean") - 1, F.lit(step))
    if not sentence_ids:
        df = T.materialised(articles, article_id=F.col("id").cast("string"), clean=T.clean(F.col("text"), entities)).where(F.col("clean") != "")
        texts = F.filter(F.transform(starts, lambda s: F.trim(F.substring(F.col("clean"), s + 1, F.lit(size)))), lambda t: t != "")
        return df.select("article_id", F.posexplode(texts).alias("chunk_index", "text"))
    df = _placed(prepared(articles, entities))
    return _explode(df, F.transform(starts, lambda s: F.struct(F.trim(F.substring(F.col("clean"), s + 1, F.lit(size))).alias("text"), _overlapping(F.col("positions"), s, s + size).alias("sentence_ids"))))


def fixed_token(articles: DataFrame, size: int = 128, overlap: int = 20, tokenizer: Callable[[], Tokenizer] | None = None, entities: bool = True) -> DataFrame:
    """Windows of `size` tokens. tokenizer: makes one; by default tokens are split at white space
    and everything stays in the JVM."""
    step = _step(size, overlap)
    df = _placed(prepared(articles, entities))
    if tokenizer is None:
        df = T.materialised(df, article_id=F.col("article_id"), clean=F.col("clean"), positions=F.col("positions"), tokens=F.split("clean", " "))
        tokens = F.col("tokens")
        df = df.withColumn("texts", F.transform(F.sequence(F.lit(0), F.size(tokens) - 1, F.lit(step)), lambda s: F.array_join(F.slice(tokens, s + 1, F.lit(size)), " ")))
    else:

        @F.pandas_udf("array<string>")
        def windows(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = tokenizer()
            for part in texts:
                yield part.map(lambda t: [model.decode(ids[s : s + size]).strip() for ids in [model.encode(t)] for s in range(0, len(ids), step)])

        df = df.withColumn("texts", windows("clean"))
    df = T.materialised(df, article_id=F.col("article_id"), clean=F.col("clean"), positions=F.col("positions"), texts=F.col("texts"))
    # a chunk's place is the first one where its text stands, looked up once
    chunks = F.expr(
        """transform(texts, t -> element_at(transform(array(locate(t, clean)), at -> named_struct('text', t, 'sentence_ids', if(at > 0,
        transform(filter(positions, p -> p.s < at - 1 + length(t) AND p.e > at - 1), p -> p.i), cast(array() AS array<int>)))), 1))"""
    )
    return _explode(df, chunks)


def edus(articles: DataFrame, segmenter: Callable[[], Segmenter] = RuleSegmenter, entities: bool = True) -> DataFrame:
    """Discourse units in order: article_id, edus (text, sentence_id, boundaries). Blank and
    one-character sentences give none but use up their ids."""
    df = _sentences(articles, entities)

    @F.arrow_udf("array<array<int>>")
    def cuts(sentences: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model, kind = segmenter(), pa.list_(pa.list_(pa.int32()))
        for part in sentences:
            yield pa.concat_arrays([pa.array([[list(model.boundaries(s)) for s in ss] for ss in part.slice(i, ROWS).to_pylist()], kind) for i in range(0, len(part), ROWS)] or [pa.array([], kind)])

    df = df.withColumn("cuts", cuts("sentences"))
    return df.select(
        "article_id",
        F.expr(
            """flatten(transform(filter(transform(sentences, (s, i) -> named_struct('s', s, 'i', i, 'c', get(cuts, i))), x -> length(trim(x.s)) > 1),
            x -> transform(filter(transform(concat(array(0), x.c), (b, k) -> trim(substring(x.s, b + 1, coalesce(get(x.c, k), length(x.s)) - b))), e -> e <> ''),
                e -> named_struct('text', e, 'sentence_id', x.i))))"""
        ).alias("edus"),
    )


def edu_windows(units: DataFrame, edus_per_chunk: int = 5, overlap: int = 2) -> DataFrame:
    """Windows over each article's units; a step below one is one."""
    step = max(1, edus_per_chunk - overlap) if overlap else edus_per_chunk
    windows = F.when(F.size("edus") > 0, F.transform(F.sequence(F.lit(0), F.size("edus") - 1, F.lit(step)), lambda i: F.slice("edus", i + 1, edus_per_chunk))).otherwise(F.array().cast("array<array<struct<text:string,sentence_id:int>>>"))
    chunks = F.transform(windows, lambda w: F.struct(F.array_join(w["text"], " ").alias("text"), F.array_sort(F.array_distinct(w["sentence_id"])).alias("sentence_ids")))
    return _explode(units, chunks)


def custom_edu(articles: DataFrame, edus_per_chunk: int = 5, overlap: int = 2, segmenter: Callable[[], Segmenter] = RuleSegmenter, entities: bool = True) -> DataFrame:
    return edu_windows(edus(articles, segmenter, entities), edus_per_chunk, overlap)


def split_by_predictions(line: str, offsets: list[int], predictions: list[int]) -> list[str]:
    """Units of a line whose tokens start at offsets and are predicted 1 where a unit begins. The
    first token's prediction doesn't count; without predictions, or if their number is wrong,
    the line is one unit."""
    if not line.strip():
        return []
    if not predictions or len(offsets) != len(predictions):
        return [line]
    starts = [0, *(o for o, p in zip(offsets[1:], predictions[1:], strict=True) if p == 1), len(line)]
    return [u for a, b in zip(starts, starts[1:], strict=False) if (u := line[a:b].strip())] or [line]


def predicted_boundaries(predictions: DataFrame) -> DataFrame:
    """Tokens predicted to begin a unit, first tokens included (splitting doesn't count these)."""
    return predictions.agg(F.coalesce(F.sum("pred"), F.lit(0)).cast("long").alias("boundaries"), F.count("pred").alias("tokens"))


def token_windows(tokens: Column, max_length: int = 512, stride: int = 256) -> Column:
    """Windows of max_length - 2 tokens; the last is the first that reaches the end."""
    width = max_length - 2
    last = F.greatest(F.ceil((F.size(tokens) - width) / F.lit(stride)).cast("int"), F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.struct((i * stride).alias("start"), F.slice(tokens, i * stride + 1, F.lit(width)).alias("tokens")))


def token_votes(predictions: DataFrame, method: str = "max", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One prediction for each token from those of all windows: keys, pos, pred. max, avg (above
    one half) or vote (more ones than zeros); an unknown method is max; none given: 0."""
    one = F.coalesce(F.sum(F.col("pred")), F.lit(0))
    rule = {"avg": F.avg("pred") > 0.5, "vote": one > F.count("pred") - one}.get(method, F.max("pred") > 0)
    return predictions.groupBy(*keys, "pos").agg(F.coalesce(rule, F.lit(False)).cast("int").alias("pred"))


# name, chunker, and arguments that must be given
CHUNKERS: dict[str, tuple[Callable[..., DataFrame], tuple[str, ...]]] = {
    "sentence": (sentence, ()),
    "fixed_char": (fixed_char, ("size", "overlap")),
    "fixed_token": (fixed_token, ("size", "overlap")),
    "custom_edu": (custom_edu, ("overlap",)),
}


def add_chunker(name: str, chunker: Callable[..., DataFrame], required: tuple[str, ...] = ()) -> None:
    CHUNKERS[name] = (chunker, required)


def chunk(articles: DataFrame, kind: str, **options: Any) -> DataFrame:
    if kind not in CHUNKERS:
        raise ValueError(f"unsupported chunker: {kind}")
    make, required = CHUNKERS[kind]
    if missing := [r for r in required if r not in options]:
        raise ValueError(f"{kind} needs {', '.join(missing)}")
    return make(articles, **options)


def with_metadata(chunks: DataFrame, kind: str, **options: Any) -> DataFrame:
    """Chunks with the columns that describe them, by kind of chunker."""
    out = chunks.withColumns(
        {
            "chunk_type": F.lit("edu_linear_head" if kind == "custom_edu" else kind),
            "chunk_size": F.length("text"),
            "token_count": F.size(T.tokens(F.col("text"))),
            "cleaned": T.strip(F.col("text")) != "",
        }
    )
    if kind == "fixed_char":
        out = out.withColumns({"target_size": F.lit(options.get("size", 500)), "overlap": F.lit(options.get("overlap", 50))})
    elif kind == "fixed_token":
        out = out.withColumns({"target_token_size": F.lit(options.get("size", 128)), "overlap_tokens": F.lit(options.get("overlap", 20))})
    elif kind == "custom_edu":
        out = out.withColumns({"num_sentences": F.size("sentence_ids"), "edus_per_chunk": F.lit(options.get("edus_per_chunk", 5)), "overlap": F.lit(options.get("overlap", 2)), "max_length": F.lit(512), "window_stride": F.lit(256), "aggregation_method": F.lit(options.get("method", "max")), "model_path": F.lit(options.get("model_path", ""))})
    return out
