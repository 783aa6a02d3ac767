"""Mixing sources to target weights by capped water-filling.

A source's weight asks for a share of the mix; its words can be taken at most
`epochs` times. Sources whose share is above that are clamped, and the rest of
the mix goes to the others by weight, again and again until none is above. With
sources sorted by capacity over weight the clamped ones come first, so the last
state of that loop is found from running sums in one pass.

A source is then taken whole as many times as its target holds it, and a seeded
part once more: documents in the order of a seeded hash, up to the target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import frames

#: Weights by the order of sources, repeating.
WEIGHTS = (5, 2, 1)
#: The mix's words for each word of the input, in hundredths; times that a source may be taken.
SHARE, EPOCHS, SEED = 150, 2, 17
_WORD = "[^\\x20\\x09-\\x0D]+"


def size_of(text: Column) -> Column:
    """Words of a text; null: 0."""
    # each run of white space and each word shrinks to one character, so that lengths count words
    short = F.regexp_replace(F.regexp_replace(text.cast("string"), _WORD, "w"), "[\\x20\\x09-\\x0D]+", "")
    return F.coalesce(F.length(short), F.lit(0)).cast("long")


def _draw(id_col: str, seed: int) -> Column:
    """The seeded order: the same in every run and engine."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))


def _by_source(name: str = "source") -> list:
    return [F.col(name).asc_nulls_last()]


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: int = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """From source and size of rows: source, source_size and target of each source. Sources stand
    in code point order, null last; a source without words has target 0."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.pmod(F.row_number().over(Window.orderBy(*_by_source())) - 1, F.lit(len(weights))) + 1).cast("int"))
    capped = sources.withColumn("weight", weight).withColumn("cap", F.col("source_size") * epochs)
    order = Window.orderBy(F.col("cap") / F.col("weight"), *_by_source())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    level = capped.withColumn("left", F.sum("source_size").over(whole) * share / F.lit(100.0) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    level = level.withColumn("open", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    # a source is clamped if what is left asks for more of it than its cap, all before it being clamped
    level = level.withColumn("free", F.col("left") * F.col("weight") <= F.col("cap") * F.col("open"))
    first = F.first(F.when(F.col("free"), F.col("left") / F.col("open")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    level = level.withColumn("level", first)
    target = F.when(F.col("level").isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")))
    return level.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: int = SHARE, epochs: int = EPOCHS, seed: int = SEED, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, source, size, source_size, target and taken (words
    that the mix takes of the row, repeats counted: size times `repeats`), repeats, and th, which
    tells texts of one id apart.

    The rows that are taken once more than the others of their source are the first in
    the order of a seeded hash of the id, as long as the middle of the row's words is
    below the target. Rows that repeat an id follow one another in that order, smaller
    ones first. Null texts have size 0; null sources are one source; null ids are one id.
    Other columns are left out.
    """
    sized = docs.select(F.col(id_col), F.col(source_col).alias("source"), size_of(F.col(text_col)).alias("size"), _draw(id_col, seed).alias("draw"), frames.row_key(text_col).alias("th"))
    sized = frames.staged(sized, "sizes")
    wanted = targets(sized, weights, share, epochs)
    # words of each source that are still wanted after its whole repetitions
    wanted = wanted.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    wanted = wanted.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    sized = sized.withColumn("group", F.substring("draw", 1, 3))
    groups = sized.groupBy("source", "group").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
    same = F.col("g.source").eqNullSafe(F.col("w.source"))
    groups = groups.alias("g").join(wanted.alias("w"), same).select("g.source", "g.group", "g.words", "g.before", "w.source_size", "w.target", "w.whole", "w.rest")
    rows = sized.alias("s").join(groups.alias("g"), F.col("s.source").eqNullSafe(F.col("g.source")) & (F.col("s.group") == F.col("g.group")))
    rows = rows.select(f"s.{id_col}", "s.source", "s.size", "s.draw", "s.th", "s.group", "g.words", "g.before", "g.source_size", "g.target", "g.whole", "g.rest")
    # of the 4,096 groups in the seeded order of a source, those before the target are taken, those
    # behind it not, and only rows of the one that holds it are sorted
    edge = (F.col("before") < F.col("rest")) & (F.col("before") + F.col("words") > F.col("rest"))
    inside = Window.partitionBy("source", "group").orderBy("draw", "size", "th").rowsBetween(Window.unboundedPreceding, -1)
    cut = rows.where(edge).withColumn("at", F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    cut = cut.withColumn("more", (F.col("at") + F.col("size") / 2 <= F.col("rest")).cast("long")).drop("at")
    rest = rows.where(~edge).withColumn("more", (F.col("before") + F.col("words") <= F.col("rest")).cast("long"))
    out = cut.unionByName(rest).withColumn("repeats", F.col("whole") + F.when(F.col("rest") > 0, F.col("more")).otherwise(F.lit(0)))
    return out.select(id_col, "source", "size", "source_size", "target", (F.col("repeats") * F.col("size")).alias("taken"), "repeats", "th")


def repeated(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: int = SHARE, epochs: int = EPOCHS, seed: int = SEED, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The mix itself: each row of docs as many times as mix() takes it. Of rows equal in id, source
    and text, those that the mix takes more often are the first by a hash of their other columns.
    An empty table gives no rows."""
    same = ["did", "th", "source"]
    times = mix(docs, weights, share, epochs, seed, id_col, source_col, text_col).where("repeats > 0")
    times = times.select(frames.id_column(id_col).alias("did"), "th", "source", F.col("repeats").cast("int").alias("repeats"))
    times = times.withColumn("place", F.row_number().over(Window.partitionBy(*same).orderBy(F.desc("repeats"))))
    own = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    keyed = docs.select(own.alias("own"), frames.id_column(id_col).alias("did"), frames.row_key(text_col).alias("th"), F.col(source_col).alias("source"))
    keyed = keyed.withColumn("place", F.row_number().over(Window.partitionBy(*same).orderBy(F.xxhash64("own"))))
    keys = [F.col(f"k.{c}").eqNullSafe(F.col(f"t.{c}")) for c in (*same, "place")]
    taken = keyed.alias("k").join(times.alias("t"), keys).select("k.own", "t.repeats")
    return taken.select("own", F.explode(F.sequence(F.lit(1), "repeats"))).select("own.*")


def oracle() -> str:
    """The same for DuckDB, over documents."""
    cases = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(WEIGHTS))
    return f"""
    WITH sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
        md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS draw FROM documents),
    sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
    weighed AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} {cases} END AS weight,
        source_size * {EPOCHS} AS cap FROM sources),
    levels AS (SELECT *, sum(source_size) OVER () * {SHARE} / 100.0
        - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining,
        sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS unclamped FROM weighed),
    level AS (SELECT remaining::DOUBLE / unclamped::DOUBLE AS level FROM levels WHERE remaining * weight <= cap * unclamped
        ORDER BY cap / weight, source NULLS LAST LIMIT 1),
    wanted AS (SELECT source, source_size, least(cap::DOUBLE, coalesce((SELECT level FROM level) * weight, cap::DOUBLE)) AS target FROM weighed),
    split AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole,
        target - CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END * source_size AS rest FROM wanted),
    placed AS (SELECT s.doc_id, s.size, p.source_size, p.target, p.whole, p.rest, coalesce(sum(s.size) OVER (PARTITION BY s.source
        ORDER BY s.draw, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
        FROM sized s JOIN split p ON s.source IS NOT DISTINCT FROM p.source)
    SELECT doc_id, size, source_size, target,
        ((whole + CASE WHEN rest > 0 AND before + size / 2 <= rest THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM placed
    """
