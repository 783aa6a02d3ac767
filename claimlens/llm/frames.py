"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that go to Python at once.
BATCH = 1024
#: Null document ids stand after all others.
LAST_ID = (1 << 63) - 1


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder in spark.checkpoint.dir; where it is unset and all runs on this machine
    (tests), a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext.getCheckpointDir()
        if held:
            return held.rstrip("/")
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        root = tempfile.mkdtemp(prefix="checkpoint-")
        spark.sparkContext.setCheckpointDir(root)
        atexit.register(__import__("shutil").rmtree, root, ignore_errors=True)
        return spark.sparkContext.getCheckpointDir().rstrip("/")
    return root.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder as Parquet and read it again: this cuts the
    lineage, and what was computed survives the loss of executors."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def drop(*stages: DataFrame) -> None:
    """Delete what staged() has written, once nothing reads it any more."""
    for df in stages:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._staged_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(df: DataFrame) -> DataFrame:
    """df, its session set to send at most BATCH rows at once to Python: whole texts in batches of
    the default 10,000 rows take hundreds of MB on either side."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH:
        conf.set(key, str(BATCH))
    return df


def id_column(name: str) -> Column:
    """The document id; null as LAST_ID, so that joins on it need no null checks."""
    return F.coalesce(F.col(name).cast("long"), F.lit(LAST_ID))


def text_column(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def row_key(text: str) -> Column:
    """Tells rows with one id and different texts apart."""
    return F.xxhash64(text_column(text))


def total_bytes(df: DataFrame, text: str) -> int:
    return int(df.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0)


def steady_heap() -> None:
    """Keep small freed buffers in this worker: numpy's temporaries else cost page faults."""
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 1 << 22)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, 1 << 23)  # M_TRIM_THRESHOLD
    except (OSError, AttributeError):
        pass


def pack(*arrays: np.ndarray, raw: tuple[int, ...] = ()) -> bytes:
    """Arrays as one compressed value; byte planes apart, but for those in `raw`, whose
    repeats are longer than an item."""
    out = [len(arrays).to_bytes(1, "little")]
    for i, a in enumerate(arrays):
        a = np.ascontiguousarray(a)
        n, width = len(a), (1 if a.ndim == 1 else a.shape[1])
        out.append(a.dtype.str.encode().ljust(4) + n.to_bytes(8, "little") + width.to_bytes(4, "little"))
        if i in raw or a.itemsize == 1:
            out.append(a.tobytes())
        else:
            out.append(a.reshape(-1).view(np.uint8).reshape(-1, a.itemsize).T.tobytes())
    return zstandard.ZstdCompressor(level=3).compress(bytes([sum(1 << i for i in raw)]) + b"".join(out))


def unpack(value: bytes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(value)
    flags, count, at, out = data[0], data[1], 2, []
    for i in range(count):
        kind = np.dtype(data[at : at + 4].decode().strip())
        n, width = int.from_bytes(data[at + 4 : at + 12], "little"), int.from_bytes(data[at + 12 : at + 16], "little")
        at += 16
        size = n * width * kind.itemsize
        a = np.frombuffer(data, np.uint8, size, at)
        at += size
        if not (flags >> i & 1 or kind.itemsize == 1):
            a = np.ascontiguousarray(a.reshape(kind.itemsize, -1).T).reshape(-1)
        a = a.view(kind)
        out.append(a.reshape(n, width) if width > 1 else a)
    return out


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All integers of [start, start + size) for each pair, one after the other."""
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, np.int64)
    begin = np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
    return begin + np.arange(total)


def batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c) for c in columns.values()], names=list(columns))
