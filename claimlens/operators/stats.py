"""Statistics of chunks and profiles of a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def block(value: Column) -> list[Column]:
    """mean, std (of the population), min, max, median and count; zeros for no value."""
    v = value.cast("double")
    parts = {"mean": F.avg(v), "std": F.stddev_pop(v), "min": F.min(v), "max": F.max(v), "median": F.percentile(v, F.lit(0.5))}
    return [*(F.coalesce(x, F.lit(0.0)).alias(k) for k, x in parts.items()), F.count(v).alias("count")]


#: Ranges of values that are ranked apart.
RANGES = 1024


def _quantiles(counts: DataFrame, shares: tuple[float, ...]) -> DataFrame:
    """metric, share and value, with linear interpolation, from metric, value (not null) and n, the
    rows of each value. Values are ranked in ranges, so no task holds more than one's."""
    ends = counts.groupBy("metric").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.sum("n").alias("total"))
    place = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * RANGES), F.lit(RANGES - 1))).otherwise(0)
    placed = counts.join(F.broadcast(ends), "metric").withColumn("range", place.cast("long"))  # a row for each metric
    sums = placed.groupBy("metric", "range").agg(F.sum("n").alias("sum"))
    before = Window.partitionBy("metric").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("metric", "range", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("base"))  # RANGES rows a metric
    inside = Window.partitionBy("metric", "range").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    ranked = placed.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(F.broadcast(sums), ["metric", "range"])
    at = F.col("base") + F.col("inside")
    asked = ranked.select("metric", "value", at.alias("at"), (at + F.col("n")).alias("end"), "total", F.explode(F.array(*map(F.lit, shares))).alias("share"))
    asked = asked.withColumn("rank", (F.col("total") - 1) * F.col("share"))
    holds = lambda r: (F.col("at") <= r) & (r < F.col("end"))
    low, high = F.floor("rank"), F.ceil("rank")
    found = asked.where(holds(low) | holds(high)).groupBy("metric", "share", "rank").agg(F.max(F.when(holds(low), F.col("value"))).alias("a"), F.max(F.when(holds(high), F.col("value"))).alias("b"))
    return found.select("metric", "share", (F.col("a") + (F.col("b") - F.col("a")) * (F.col("rank") - low)).alias("value"))


def blocks(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """One row of `block` for each named value: metric and its statistics. Values are counted first,
    once; the counts are kept."""
    named = F.array(*(F.struct(F.lit(k).alias("metric"), v.cast("double").alias("value")) for k, v in values.items()))
    counts = df.select(F.explode(named).alias("x")).select("x.*").groupBy("metric", "value").agg(F.count("value").alias("n")).persist()
    n, v = F.col("n"), F.col("value")
    parts = counts.groupBy("metric").agg((F.sum(v * n) / F.sum(F.when(n > 0, n))).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"), F.sum(n).alias("count"))
    off = v - F.col("mean")
    spread = counts.join(F.broadcast(parts.select("metric", "mean", "count")), "metric").groupBy("metric").agg(F.sqrt(F.sum(n * off * off) / F.first("count")).alias("std"))
    median = _quantiles(counts.where(n > 0), (0.5,)).select("metric", F.col("value").alias("median"))
    out = parts.join(F.broadcast(spread), "metric").join(F.broadcast(median), "metric", "left")  # a row for each metric
    return out.select("metric", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("mean", "std", "min", "max", "median")), "count")


def chunk_stats(chunks: DataFrame) -> DataFrame:
    return blocks(chunks, {"chunk_characters": F.length("text"), "chunk_tokens": F.size(T.tokens(F.col("text"))), "sentences_per_chunk": F.size("sentence_ids")})


def sentence_stats(sentences: DataFrame) -> DataFrame:
    return blocks(sentences, {"sentence_characters": F.length("text"), "sentence_tokens": F.size(T.tokens(F.col("text")))})


def edu_stats(units: DataFrame) -> DataFrame:
    """units: article_id and edus, as from chunkers.edus, which are made once: a row of units gives
    its units' texts and, from where its sentences begin, their numbers of units."""
    df = T.materialised(units, edus=F.col("edus"), ids=F.col("edus.sentence_id")).where(F.size("edus") > 0)
    begins = F.filter(F.sequence(F.lit(0), F.size("ids") - 1), lambda k: (k == 0) | (F.get("ids", k) != F.get("ids", k - 1)))
    df = T.materialised(df, edus=F.col("edus"), begins=begins)
    texts = F.transform("edus", lambda e: F.struct(e["text"].alias("text"), F.lit(None).cast("int").alias("n")))
    numbers = F.transform("begins", lambda b, j: F.struct(F.lit(None).cast("string").alias("text"), (F.coalesce(F.get("begins", j + 1), F.size("edus")) - b).alias("n")))
    flat = df.select(F.explode(F.concat(texts, numbers)).alias("e")).select("e.text", "e.n")
    tokens = F.when(F.col("text").isNotNull(), F.size(T.tokens(F.col("text"))))
    return blocks(flat, {"edu_characters": F.length("text"), "edu_tokens": tokens, "edus_per_sentence": F.col("n")})


def edus_per_chunk(units: DataFrame, edus_per_chunk: int = 5, overlap: int = 2) -> DataFrame:
    """Units of each chunk of chunkers.edu_windows over units, as one row of statistics."""
    step = max(1, edus_per_chunk - overlap) if overlap else edus_per_chunk
    n = T.materialised(units, n=F.size("edus")).where("n > 0")
    held = n.select(F.explode(F.transform(F.sequence(F.lit(0), F.col("n") - 1, F.lit(step)), lambda i: F.least(F.lit(edus_per_chunk), F.col("n") - i))).alias("held"))
    return blocks(held, {"edus_per_chunk": F.col("held")})


def ingested(chunks: DataFrame) -> DataFrame:
    """Totals of a build: articles, chunks and those whose text isn't clean. chunks: with_metadata."""
    return chunks.agg(F.countDistinct("article_id").alias("articles"), F.count("*").alias("chunks"), F.count_if(~F.col("cleaned")).alias("cleaning_issues"))


def multiple_edus(units: DataFrame) -> DataFrame:
    """Sentences of more than one unit: count and percentage."""
    per = units.select("article_id", F.explode("edus.sentence_id").alias("s")).groupBy("article_id", "s").agg(F.count("*").alias("n"))
    many = (F.col("n") > 1).cast("int")
    return per.agg(F.coalesce(F.sum(many), F.lit(0)).alias("count"), F.coalesce(100 * F.avg(many), F.lit(0.0)).alias("percentage"))


def distribution(df: DataFrame, label: str, missing: str | None = "MISSING") -> DataFrame:
    """Rows and percentage of each label, most frequent first; missing: what null becomes (None:
    such rows are left out)."""
    df = df.where(F.col(label).isNotNull()) if missing is None else df.withColumn(label, F.coalesce(F.col(label).cast("string"), F.lit(missing)))
    counts = df.groupBy(label).agg(F.count("*").alias("count"))
    total = counts.agg(F.sum("count").alias("total"))  # one row
    return counts.join(F.broadcast(total)).select(label, "count", (100 * F.col("count") / F.col("total")).alias("percentage")).orderBy(F.desc("count"), label)


def pattern_top(df: DataFrame, text: Column, pattern: str, n: int = 20) -> DataFrame:
    """The n most frequent matches of a pattern: token and count."""
    found = df.select(F.explode(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).alias("token"))
    return found.groupBy("token").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "token").limit(n)


def percentiles(df: DataFrame, value: Column, shares: tuple[float, ...] = (0.25, 0.5, 0.75, 0.9, 0.95)) -> DataFrame:
    """Exact percentiles with linear interpolation, one row each (none without values)."""
    counts = df.select(F.lit("").alias("metric"), value.cast("double").alias("value")).where("value IS NOT NULL").groupBy("metric", "value").agg(F.count("*").alias("n"))
    return _quantiles(counts, shares).select("share", "value")


def histogram(df: DataFrame, value: Column, bins: int = 50) -> DataFrame:
    """Rows in bins of equal width between the least and the greatest value: bin (from 0), count."""
    v = df.select(value.cast("double").alias("v")).where("v IS NOT NULL")
    ends = v.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))  # one row
    place = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))).otherwise(0)
    return v.join(F.broadcast(ends)).groupBy(place.cast("long").alias("bin")).agg(F.count("*").alias("count"))


def edge_cases(df: DataFrame, sentences: Column, lines: Column) -> DataFrame:
    """Articles that are very short (under 3 sentences), very long (over 200) or without lines."""
    return df.agg(F.count_if(sentences < 3).alias("very_short"), F.count_if(sentences > 200).alias("very_long"), F.count_if(T.strip(F.coalesce(lines, F.lit(""))) == "").alias("empty_lines"))


def entity_links(df: DataFrame, lines: Column) -> DataFrame:
    """Articles with a line that names an entity, and their percentage."""
    linked = F.coalesce(F.exists(T.annotated_lines(lines), lambda x: F.exists(x["entities"], lambda e: e != "")), F.lit(False))
    return df.agg(F.count_if(linked).alias("articles"), F.coalesce(100 * F.avg(linked.cast("int")), F.lit(0.0)).alias("percentage"))


def artifacts(df: DataFrame, text: Column, names: tuple[str, ...] = T.PROFILED) -> DataFrame:
    """Articles that hold each artifact, and their percentage."""
    flags = df.select(F.explode(T.artifact_flags(text, names)).alias("artifact", "found"))
    return flags.groupBy("artifact").agg(F.count_if("found").alias("articles"), (100 * F.avg(F.col("found").cast("int"))).alias("percentage"))


def overflow(df: DataFrame, tokens: Column, limit: int = 512) -> DataFrame:
    """Articles of more tokens than the limit: count and percentage; mean and most tokens."""
    n = df.select(tokens.alias("n"))
    return n.agg(F.count_if(F.col("n") > limit).alias("over"), (100 * F.avg((F.col("n") > limit).cast("int"))).alias("percentage"), F.avg("n").alias("mean"), F.max("n").alias("most"))


def slowdown(times: DataFrame, order: str, seconds: str, n: int = 10) -> DataFrame:
    """Means of the first and the last n batches, and their ratio."""
    ends = [times.orderBy(o).limit(n).select(F.col(seconds).alias("value"), F.lit(start).alias("start")) for o, start in ((F.asc(order), True), (F.desc(order), False))]
    both = ends[0].unionByName(ends[1])
    first, last = F.avg(F.when(F.col("start"), F.col("value"))), F.avg(F.when(~F.col("start"), F.col("value")))
    return both.agg(first.alias("first"), last.alias("last"), F.try_divide(last, first).alias("slowdown"))
