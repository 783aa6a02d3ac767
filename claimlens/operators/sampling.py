"""Exact, seeded samples and the reduction of a dataset.

Random order is the order of md5(seed, id): the same on every run and engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEED = 42


def draw(id_col: str, seed: int = SEED) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def simple(df: DataFrame, n: int, id_col: str, seed: int = SEED) -> DataFrame:
    """n rows at random, or all if there are fewer: also a reservoir's result."""
    return df.orderBy(draw(id_col, seed), id_col).limit(n)


def shuffled(df: DataFrame, id_col: str, seed: int = SEED) -> DataFrame:
    return df.orderBy(draw(id_col, seed), id_col)


def stratified(df: DataFrame, size: int, id_col: str, label: str = "label", seed: int = SEED) -> DataFrame:
    """Exactly `size` rows (or all): of each label its share, rounded down, and rows at random from
    the rest for what is missing. Unlabelled rows are the label UNKNOWN. id_col is unique."""
    rows = df.withColumn("__label", F.coalesce(F.col(label).cast("string"), F.lit("UNKNOWN"))).withColumn("__draw", draw(id_col, seed))
    counts = rows.groupBy("__label").agg(F.count("*").alias("__n"))
    total = counts.agg(F.sum("__n").alias("__total"))  # one row
    quota = counts.join(F.broadcast(total)).select("__label", F.least(F.floor(F.lit(size) * (F.col("__n") / F.col("__total"))), F.col("__n")).alias("__quota"))
    place = F.row_number().over(Window.partitionBy("__label").orderBy("__draw", id_col))
    ranked = rows.join(F.broadcast(quota), "__label").withColumn("__place", place)
    chosen = ranked.where("__place <= __quota")
    short = max(0, size - (quota.agg(F.sum("__quota")).first()[0] or 0))
    rest = ranked.where("__place > __quota").orderBy("__draw", id_col).limit(short)
    return chosen.unionByName(rest).select(*df.columns)


def required_ids(*claims: DataFrame) -> DataFrame:
    """Distinct lower-case article ids of all claims' evidence: id."""
    from ..functions.text import evidence_ids

    out = None
    for c in claims:
        ids = c.select(F.explode(evidence_ids(F.col("evidence"))).alias("id"))
        out = ids if out is None else out.union(ids)
    return out.distinct()


def reference_counts(*claims: DataFrame) -> DataFrame:
    """References of all claims' evidence, repeats counted, and different ids."""
    from ..functions.text import evidence_ids

    out = None
    for c in claims:
        ids = c.select(F.explode(evidence_ids(F.col("evidence"))).alias("id"))
        out = ids if out is None else out.union(ids)
    return out.agg(F.count("*").alias("references"), F.countDistinct("id").alias("ids"))


def verifiable(claims: DataFrame) -> DataFrame:
    return claims.where(F.col("verifiable") == "VERIFIABLE")


def verifiable_counts(claims: DataFrame) -> DataFrame:
    """Verifiable claims, and different third items of their evidence (null counts as one)."""
    kept = verifiable(claims)
    rows = kept.agg(F.count("*").alias("claims"))
    items = kept.select(F.explode(F.flatten("evidence")).alias("x")).where(F.size("x") >= 3).select(F.get("x", F.lit(2)).alias("id"))
    ids = items.agg((F.countDistinct("id") + F.max(F.col("id").isNull().cast("int"))).alias("ids"))
    return rows.join(F.broadcast(ids)).select("claims", F.coalesce("ids", F.lit(0)).cast("long").alias("ids"))  # one row each


def matching(docs: DataFrame, ids: DataFrame, id_col: str = "id", how: str = "left_semi") -> DataFrame:
    """Documents whose trimmed lower-case id is among ids (left_semi), or isn't (left_anti)."""
    return docs.join(ids.select(F.col("id").alias("__id")), F.lower(F.trim(F.col(id_col).cast("string"))) == F.col("__id"), how)


def reduced(docs: DataFrame, ids: DataFrame, extra: int, id_col: str = "id", seed: int = SEED) -> DataFrame:
    """Required documents and `extra` of the others at random."""
    return matching(docs, ids, id_col).unionByName(simple(matching(docs, ids, id_col, "left_anti"), extra, id_col, seed))


def coverage(docs: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """Required ids, those found in docs, and the percentage."""
    found = docs.select(F.lower(F.trim(F.col(id_col).cast("string"))).alias("id")).distinct()
    both = ids.select("id").distinct().join(found.withColumn("hit", F.lit(1)), "id", "left")
    return both.agg(F.count("*").alias("required"), F.count("hit").alias("found"), F.coalesce(100 * F.avg(F.coalesce("hit", F.lit(0))), F.lit(0.0)).alias("percentage"))


def first_of_each(df: DataFrame, n: int, order: str, labels: tuple[str, ...], label: str = "label") -> DataFrame:
    """The first n rows of each label, by the labels' order."""
    place = F.row_number().over(Window.partitionBy(label).orderBy(order))
    known = F.array_position(F.array(*map(F.lit, labels)), F.col(label))
    return df.where(F.col(label).isin(*labels)).withColumn("__place", place).where(F.col("__place") <= n).orderBy(known, order).drop("__place")
