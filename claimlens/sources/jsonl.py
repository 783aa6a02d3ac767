"""JSON Lines: strict and tolerant scans, directories, appends and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _files(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _files(spark, path)
    return bool(fs.exists(p))


def listed(spark: SparkSession, path: str, suffix: str = ".jsonl", recursive: bool = False) -> list[str]:
    """Files of a folder by name; ValueError if there is no such folder."""
    fs, p = _files(spark, path)
    if not fs.exists(p) or not fs.getFileStatus(p).isDirectory():
        raise ValueError(f"no such folder: {path}")
    out, files = [], fs.listFiles(p, recursive)
    while files.hasNext():
        name = files.next().getPath().toString()
        if name.endswith(suffix):
            out.append(name)
    return sorted(out)


def sample_files(files: list[str], n: int, seed: int = 42) -> list[str]:
    """n files at random (all, if there are fewer), by the order of a seeded hash."""
    import hashlib

    return sorted(files, key=lambda f: hashlib.md5(f"{seed}:{f}".encode()).hexdigest())[:n] if len(files) > n else list(files)


def _tolerant(lines: DataFrame, schema: T.StructType) -> DataFrame:
    """Adds r, the row of each line (value); lines that can't be read, or only in part, go."""
    bad = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    parsed = lines.where(F.trim("value") != "").withColumn("r", F.from_json("value", bad, {"columnNameOfCorruptRecord": "_corrupt_record"}))
    return parsed.where(F.col("r").isNotNull() & F.col("r._corrupt_record").isNull()).withColumn("r", F.col("r").dropFields("_corrupt_record"))


def read(spark: SparkSession, path: str | list[str], schema: T.StructType, strict: bool = True, limit: int | None = None) -> DataFrame:
    """Rows of JSON Lines. strict: a line that can't be read raises, else it is skipped; a path
    that doesn't exist gives no rows. limit: the first rows in the order of files and lines."""
    paths = [path] if isinstance(path, str) else path
    paths = [p for p in paths if exists(spark, p)]
    if not paths:
        return spark.createDataFrame([], schema)
    if strict:
        df = spark.read.schema(schema).option("mode", "FAILFAST").json(paths)
    else:
        df = _tolerant(spark.read.text(paths), schema).select("r.*")
    if limit:
        df = df.withColumn("__file", F.input_file_name()).withColumn("__at", F.monotonically_increasing_id()).orderBy("__file", "__at").limit(limit).drop("__file", "__at")
    return df


def read_capped(spark: SparkSession, paths: list[str], schema: T.StructType, per_file: int) -> DataFrame:
    """The first rows of each file; lines that can't be read are skipped."""
    df = spark.read.text(paths).select("value", F.input_file_name().alias("__file"), F.monotonically_increasing_id().alias("__at"))
    df = _tolerant(df, schema)
    place = F.row_number().over(Window.partitionBy("__file").orderBy("__at"))
    return df.withColumn("__place", place).where(F.col("__place") <= per_file).select("r.*")


def count_lines(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).count()


def types(df: DataFrame) -> list[tuple[str, str, object]]:
    """Name, type and first value of each column."""
    first = df.first()
    return [(n, t, first[n] if first else None) for n, t in df.dtypes]


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("ignoreNullFields", "false").json(path)


def overwrite(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def run_record(spark: SparkSession, evaluation: DataFrame, **config) -> DataFrame:
    """An evaluation run as one row: the time, the configuration (None: null) and the metrics."""
    known = {k: (v if v is None or isinstance(v, (int, float, str, bool)) else str(v)) for k, v in config.items()}
    columns = [F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss").alias("timestamp")]
    columns += [(F.lit(None).cast("string") if v is None else F.lit(v)).alias(k) for k, v in known.items()]
    return evaluation.select(*columns, "*")


def grouped_results(hits: DataFrame, claims: DataFrame) -> DataFrame:
    """A claim and its evidence in order, for a JSON report."""
    rows = hits.groupBy("claim_id").agg(F.array_sort(F.collect_list(F.struct("rank", "article_id", "score", "text"))).alias("evidence"))
    return claims.select("claim_id", "claim").join(rows, "claim_id", "left")
