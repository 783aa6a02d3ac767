"""Media columns: payloads in tar shards, addressed by content.

Each task writes tar shards to a shared folder; a member is a PNG image of 8-bit
grey samples, named by the payload's digest, and stands once in a shard. Rows
carry shard, digest, offset and length; all rows of one digest name the same
member, the first of those that tasks have written. Metadata columns come from
range reads of the members' first bytes; features from the samples read back.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import frames

#: Bytes of payload in a row of samples, of the padding, and of a shard.
UNIT, FILL, SHARD_BYTES = 576, b"\xff", 64 << 20
#: Bytes of a member that a header read fetches: signature and first chunk.
HEADER = 33
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def payload(text: bytes) -> bytes:
    """The text, filled up to a positive multiple of UNIT."""
    return text + FILL * (max(UNIT, -(-len(text) // UNIT) * UNIT) - len(text))


def encode(samples: bytes) -> bytes:
    """A grey PNG of UNIT samples a row."""

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    rows = np.zeros((len(samples) // UNIT, UNIT + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(samples, np.uint8).reshape(-1, UNIT)
    head = struct.pack(">IIBBBBB", UNIT, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 1)) + chunk(b"IEND", b"")


def header(data: bytes) -> dict:
    """Width, height, depth and colour kind from a member's first bytes."""
    if data[:8] != _SIGNATURE or data[12:16] != b"IHDR":
        raise ValueError("not an image of this store")
    width, height, depth, colour = struct.unpack(">IIBB", data[16:26])
    return {"width": width, "height": height, "depth": depth, "colour": colour}


def decode(data: bytes) -> bytes:
    """The samples of an image of encode(), with its checksums verified."""
    at, idat, size = 8, [], header(data)
    while at < len(data):
        n = int.from_bytes(data[at : at + 4], "big")
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != int.from_bytes(data[at + 8 + n : at + 12 + n], "big"):
            raise ValueError("damaged image")
        if kind == b"IDAT":
            idat.append(body)
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(idat)), np.uint8).reshape(size["height"], size["width"] + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows are not of this store")
    return rows[:, 1:].tobytes()


def feature(samples: bytes, head: dict) -> str:
    """Size, mean, deviation and a 8-bin histogram of the samples."""
    a = np.frombuffer(samples, np.uint8)
    bins = np.bincount(a >> 5, minlength=8)
    return f"{head['width']}x{head['height']}x{head['depth']} mean={a.mean():.4f} std={a.std():.4f} hist={','.join(map(str, bins))}"


def _filesystem(uri: str):
    from pyarrow import fs

    if "://" not in uri:  # a plain path, or Hadoop's short form of one
        uri = f"file://{uri.removeprefix('file:')}"
    return fs.FileSystem.from_uri(uri)


def store(docs: DataFrame, root: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the payload of each row of docs; rows: id, n_bytes, digest (sha256 of the payload),
    shard, offset and length (of the member's data in the shard).

    root: a folder that all machines share, by default one in spark.checkpoint.dir.
    An attempt that is lost leaves a shard that no row names, and so may copies of one payload in
    other tasks' shards. Null texts are empty and have a payload like any other; texts may be of any
    length. Rows that repeat an id are rows of their own; equal texts have equal addresses, the
    least by shard and offset. An empty table gives no rows. Other columns are left out.
    """
    root = root or f"{frames.checkpoint_root(docs.sparkSession)}/media-{uuid.uuid4().hex}"

    def write(batches):
        files, base = _filesystem(root)
        files.create_dir(base, recursive=True)
        out, at, known, name = None, 0, {}, ""
        for rb in batches:
            texts, ids = rb.column("text"), rb.column("doc")
            rows = []
            for i in range(rb.num_rows):
                text = texts[i].as_buffer().to_pybytes()
                data = payload(text)
                digest = hashlib.sha256(data).digest()
                if out is None or at >= SHARD_BYTES:
                    if out is not None:
                        out.write(bytes(1024))
                        out.close()
                    name, at, known = f"shard-{uuid.uuid4().hex}.tar", 0, {}
                    out = files.open_output_stream(f"{base}/{name}")
                if digest not in known:
                    image = encode(data)
                    info = tarfile.TarInfo(f"{digest.hex()}.png")
                    info.size = len(image)
                    head = info.tobuf(tarfile.USTAR_FORMAT)
                    known[digest] = (at + len(head), len(image))
                    out.write(head + image + bytes(-len(image) % 512))
                    at += len(head) + len(image) + -len(image) % 512
                rows.append((len(text), digest, name, *known[digest]))
            n, digest, shard, offset, length = zip(*rows, strict=True) if rows else ((),) * 5
            yield frames.batch(doc=ids, n_bytes=pa.array(n, pa.int64()), digest=pa.array(digest, pa.binary()), shard=pa.array(shard, pa.string()), offset=pa.array(offset, pa.int64()), length=pa.array(length, pa.int64()))
        if out is not None:
            out.write(bytes(1024))
            out.close()

    source = frames.small_batches(docs).select(F.col(id_col).alias("doc"), frames.text_column(text_col).cast("binary").alias("text"))
    kind = source.schema["doc"].dataType.simpleString()
    rows = source.mapInArrow(write, f"doc {kind}, n_bytes long, digest binary, shard string, offset long, length long")
    written = frames.staged(rows, "media-written")
    first = written.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("first"))
    index = written.select("doc", "n_bytes", "digest").join(first, "digest").select("doc", "n_bytes", "digest", "first.*")
    index = frames.staged(index, "media-index")
    frames.drop(written)
    return index.withColumn("root", F.lit(root)).withColumnRenamed("doc", id_col)


def _by_shard(stored: DataFrame, each, schema: str) -> DataFrame:
    """Members of each shard in the order of offsets, the shard open: each(file, members) -> columns.
    Members are read once for all rows that name them."""

    def rows(batches):
        file, opened = None, None
        for pdf in batches:
            for (root, shard), group in pdf.groupby(["root", "shard"], sort=False):
                if opened != (root, shard):
                    files, base = _filesystem(root)
                    file, opened = files.open_input_file(f"{base}/{shard}"), (root, shard)
                yield each(file, group)

    return stored.repartition("shard").sortWithinPartitions("shard", "offset").mapInPandas(rows, schema)


_PLACE = ["root", "shard", "offset", "length", "digest"]


def members(stored: DataFrame) -> DataFrame:
    """The different members that rows of store() name."""
    return stored.select(*_PLACE).distinct()


def with_metadata(found: DataFrame) -> DataFrame:
    """Adds width, height, depth and colour to members, each from a range read of its header alone."""
    names = ["width", "height", "depth", "colour"]

    def each(file, group):
        heads = []
        for at in group["offset"]:
            file.seek(int(at))
            heads.append(header(file.read(HEADER)))
        return group.assign(**{k: [h[k] for h in heads] for k in names})

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema)
    return _by_shard(found, each, f"{kinds}, width long, height long, depth long, colour long")


def read_back(stored: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Features of the stored bytes of each row: id, n_bytes, payload_bytes, payload_sha256,
    tail_crc32 (of the last 32 bytes), media_bytes, media_sha256, feature, and the metadata
    columns. A payload that isn't the one its row names raises, as does one whose size isn't
    what its header says."""

    def each(file, group):
        rows = []
        for at, size, digest, *head in group[["offset", "length", "digest", "width", "height", "depth", "colour"]].itertuples(index=False):
            file.seek(int(at))
            data = file.read(int(size))
            samples = decode(data)
            found = hashlib.sha256(samples).digest()
            head = dict(zip(("width", "height", "depth", "colour"), head, strict=True))
            if found != bytes(digest) or len(samples) != head["width"] * head["height"]:
                raise ValueError(f"{bytes(digest).hex()} reads back as {found.hex()}")
            rows.append((found, len(samples), found.hex(), zlib.crc32(samples[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature(samples, head)))
        out = pd.DataFrame(rows, columns=["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])
        for k in ("width", "height", "depth", "colour"):
            out[k] = group[k].to_numpy()
        return out

    read = _by_shard(with_metadata(members(stored)), each, "digest binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width long, height long, depth long, colour long")
    out = stored.select(F.col(id_col), "n_bytes", "digest").join(read, "digest")
    return out.select(id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "depth", "colour")
