"""Retrieval and classification metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import LABELS

KS = (1, 3, 5, 10, 20)


def relevant(claims: DataFrame, gold: DataFrame, claim: str = "claim_id") -> DataFrame:
    """Claims with text and at least one gold article."""
    return claims.where(F.coalesce(F.col("claim"), F.lit("")) != "").join(gold.select(claim).distinct(), claim, "left_semi")


def judged(articles: DataFrame, gold: DataFrame, ks: tuple[int, ...] = KS, claim: str = "claim_id", article: str = "article_id") -> DataFrame:
    """at_k, and in each row the claim's reciprocal rank as rr: all from one ranking."""
    counts = gold.groupBy(claim).agg(F.count("*").alias("gold"))
    hits = articles.join(gold.select(claim, article), [claim, article]).select(claim, "rank")
    # only hits meet the ks; claims without any keep their rows
    ranks = hits.groupBy(claim).agg(F.collect_list("rank").alias("ranks"))
    grid = counts.join(ranks, claim, "left").select(claim, "gold", F.coalesce("ranks", F.array().cast("array<int>")).alias("ranks"), F.explode(F.array(*map(F.lit, ks))).alias("k"))
    grid = grid.withColumn("tp", F.size(F.filter("ranks", lambda r: r <= F.col("k"))).cast("long"))
    rr = F.coalesce(F.lit(1.0) / F.array_min("ranks"), F.lit(0.0))
    return grid.select(claim, "k", "tp", (F.col("tp") / F.col("k")).alias("precision"), F.coalesce(F.try_divide(F.col("tp"), F.col("gold")), F.lit(0.0)).alias("recall"), (F.col("tp") > 0).cast("int").alias("accuracy"), rr.alias("rr"))


def at_k(articles: DataFrame, gold: DataFrame, ks: tuple[int, ...] = KS, claim: str = "claim_id", article: str = "article_id") -> DataFrame:
    """For each claim with gold and each k: tp, precision (tp over k), recall (tp over gold) and
    accuracy (1 if any). articles: ranked without repeats; gold: distinct."""
    return judged(articles, gold, ks, claim, article).drop("rr")


def reciprocal_rank(articles: DataFrame, gold: DataFrame, claim: str = "claim_id", article: str = "article_id") -> DataFrame:
    """1 over the rank of each claim's first gold article, 0 for none."""
    first = articles.join(gold.select(claim, article), [claim, article]).groupBy(claim).agg(F.min("rank").alias("first"))
    return gold.select(claim).distinct().join(first, claim, "left").select(claim, F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0)).alias("rr"))


def averages(rows: DataFrame) -> DataFrame:
    """Means of at_k, or of judged (with mrr), over claims."""
    mrr = [F.avg("rr").alias("mrr")] if "rr" in rows.columns else []
    return rows.groupBy("k").agg(F.count("*").alias("claims"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("accuracy").alias("accuracy"), *mrr)


def evaluation(articles: DataFrame, gold: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """One row: claims, gold articles, mrr and maps of k to mean precision, recall, accuracy."""
    k = averages(at_k(articles, gold, ks)).agg(*(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", m)))).alias(f"{m}_at_k") for m in ("precision", "recall", "accuracy")))
    totals = gold.agg(F.countDistinct("claim_id").alias("total_claims"), F.count("*").alias("total_relevant_docs"))
    mrr = reciprocal_rank(articles, gold).agg(F.coalesce(F.avg("rr"), F.lit(0.0)).alias("mean_reciprocal_rank"))
    return totals.join(mrr).join(k)  # one row each


def accuracy(rows: DataFrame) -> DataFrame:
    return rows.agg(F.avg((F.col("true_label") == F.col("predicted_label")).cast("int")).alias("accuracy"), F.count("*").alias("support"))


def per_class(rows: DataFrame, labels: tuple[str, ...] | None = LABELS) -> DataFrame:
    """tp, fp, fn, support, precision, recall and f1 of each label; labels: those listed even if
    absent (None: those that occur). Divisions by zero are 0."""
    sides = rows.select(F.explode(F.array(F.struct(F.col("true_label").alias("label"), F.lit(1).alias("t"), F.lit(0).alias("p"), (F.col("true_label") == F.col("predicted_label")).cast("int").alias("ok")), F.struct(F.col("predicted_label").alias("label"), F.lit(0).alias("t"), F.lit(1).alias("p"), F.lit(0).alias("ok")))).alias("x")).select("x.*")
    counts = sides.groupBy("label").agg(F.sum("ok").alias("tp"), F.sum("t").alias("support"), F.sum("p").alias("predicted"))
    if labels is not None:
        grid = rows.sparkSession.createDataFrame([(x, i) for i, x in enumerate(labels)], "label string, place int")
        counts = grid.join(counts, "label", "left").select("label", "place", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("tp", "support", "predicted")))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    out = counts.withColumn("precision", ratio(F.col("tp"), F.col("predicted"))).withColumn("recall", ratio(F.col("tp"), F.col("support")))
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def weighted(rows: DataFrame) -> DataFrame:
    """Precision, recall and f1 averaged by support, over the labels that occur."""
    c = per_class(rows, None)
    return c.agg(*(F.coalesce(F.try_divide(F.sum(F.col(m) * F.col("support")), F.sum("support")), F.lit(0.0)).alias(m) for m in ("precision", "recall", "f1")), F.sum("support").alias("support"))


def confusion(rows: DataFrame, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """Counts of predicted labels (columns) for each true one, in the labels' order, zeros included."""
    grid = rows.sparkSession.createDataFrame([(x, i) for i, x in enumerate(labels)], "true_label string, place int")
    counts = rows.groupBy("true_label").pivot("predicted_label", list(labels)).count()
    return grid.join(counts, "true_label", "left").na.fill(0).orderBy("place")
