"""Token-ID output: length-delimited binary records with a separate offset index.

A record file holds, for each document in ascending order of doc_id,

    u64  length of the payload
    u32  masked checksum of those eight bytes
    ...  payload: i64 doc_id, u8 bytes per id (2 or 4), ids
    u32  masked checksum of the payload

all little-endian.  A checksum is a CRC-32, rotated right by 15 bits with a constant added, so that a
checksum stored inside checked data doesn't disturb it.  The index file beside it holds a u64 offset for
each record and one for the end, so a reader can fetch records in any order.

Files are named after a task attempt; the manifest, a table written once, names those of the attempts
that counted, in order.  What an attempt that was lost has left is never read.

Defined results: a null text is an empty document with the end token alone; rows with a null doc_id come
first and are stored as the smallest 64-bit integer; repeated rows are repeated records; an empty table
gives an empty manifest; further columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Characters of text that make one file.
SHARD_CHARS = 16 << 20
#: A file is closed at about so many bytes, so that it can be read as one value.
SHARD_BYTES = 64 << 20
#: Parts whose files are summed by one task.
BIN = 1024
#: Tasks that read files, at most; each reads file after file.
MOST_TASKS = 100_000
NULL_ID = -(1 << 63)
MANIFEST = "part int, seq int, path string, n_docs long, n_tokens long"
_MASK = 0xA282EAD8


def masked(crc: int) -> int:
    return ((crc >> 15 | crc << 17) + _MASK) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray) -> bytes:
    """A record of a document's ids."""
    wide = 4 if len(ids) and int(ids.max()) > 0xFFFF else 2
    body = struct.pack("<qB", NULL_ID if doc_id is None else doc_id, wide) + ids.astype(f"<u{wide}").tobytes()
    head = struct.pack("<Q", len(body))
    return head + struct.pack("<I", masked(zlib.crc32(head))) + body + struct.pack("<I", masked(zlib.crc32(body)))


def parse(data: bytes | memoryview, at: int) -> tuple[int | None, np.ndarray, int]:
    """(doc_id, ids, place after it) of the record at a place.  ValueError if a checksum differs."""
    head = data[at : at + 8]
    n, check = struct.unpack_from("<QI", data, at)
    if masked(zlib.crc32(head)) != check:
        raise ValueError(f"damaged length at byte {at}")
    body = data[at + 12 : at + 12 + n]
    if len(body) != n or masked(zlib.crc32(body)) != struct.unpack_from("<I", data, at + 12 + n)[0]:
        raise ValueError(f"damaged record at byte {at}")
    doc_id, wide = struct.unpack_from("<qB", body)
    return (None if doc_id == NULL_ID else doc_id), np.frombuffer(body, f"<u{wide}", offset=9).astype("<u4"), at + 16 + n


def _open(path: str):
    """File system and path of a qualified path, for pyarrow, which has another name for one scheme of Hadoop's."""
    from pyarrow import fs

    if "://" not in path and path.startswith("file:"):
        path = path[len("file:") :]
    return fs.FileSystem.from_uri("s3://" + path[6:] if path.startswith("s3a://") else path)


def _qualified(spark: SparkSession, folder: str) -> str:
    """With the scheme that Spark would give it, so that executors write where Spark reads."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()


def write(documents: DataFrame, folder: str, tokenizer: str, end_id: int) -> DataFrame:
    """Writes all documents in order below folder; returns the manifest, read from folder/manifest."""
    spark = documents.sparkSession
    common.ready(spark)
    folder = _qualified(spark, folder)
    end = np.array([end_id], dtype="<u4").tobytes()
    docs = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .tokens import encoder

        words, part, seq = encoder(tokenizer), TaskContext.get().partitionId(), 0
        own, places, size, tokens = [], [0], 0, 0

        def close() -> pa.RecordBatch:
            nonlocal own, places, size, tokens, seq
            name = f"{folder}/part-{part:06d}-{seq:04d}-{uuid.uuid4().hex[:8]}"
            store, path = _open(f"{name}.rec")
            store.create_dir(path.rpartition("/")[0], recursive=True)
            for suffix, parts in ((".rec", own), (".idx", [np.array(places, "<u8").tobytes()])):
                with store.open_output_stream(path.removesuffix(".rec") + suffix) as f:
                    f.write(b"".join(parts))
            row = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "path": [f"{name}.rec"], "n_docs": [len(own)], "n_tokens": [tokens]})
            own, places, size, tokens, seq = [], [0], 0, 0, seq + 1
            return row

        for batch in batches:
            for doc_id, ids in zip(batch["doc_id"].to_pylist(), words.encode(batch["text"].to_pylist()), strict=True):
                record = frame(doc_id, np.frombuffer(ids + end, "<u4"))
                own.append(record)
                size += len(record)
                places.append(size)
                tokens += len(ids) // 4 + 1
                if size >= SHARD_BYTES:
                    yield close()
        if own:
            yield close()

    ordered = docs.repartitionByRange(int(chars // SHARD_CHARS) + 1, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, MANIFEST).write.parquet(f"{folder}/manifest")
    return manifest(spark, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """part, seq, path, n_docs, n_tokens and start: the tokens in all files before.  One row for a file.

    Sums are taken within bins of parts, then over the bins, so no task sorts all files.
    """
    files = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").withColumn("bin", F.floor(F.col("part") / BIN))
    bins = files.groupBy("bin").agg(F.sum("n_tokens").alias("all"))
    at = bins.select("bin", F.coalesce(F.sum("all").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("at"))
    within = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("bin").orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return files.withColumn("within", within).join(at, "bin").select("part", "seq", "path", "n_docs", "n_tokens", (F.col("at") + F.col("within")).cast("long").alias("start"))


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of every record, checked as it is read.

    The manifest's rows are dealt to tasks; each opens its files and their indexes, and finds records by the index.
    """
    common.ready(spark)
    files = manifest(spark, folder).select("path", "start")
    tasks = max(1, min(MOST_TASKS, spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").count()))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(batch["path"].to_pylist(), batch["start"].to_pylist(), strict=True):
                store, path = _open(name)
                with store.open_input_file(path) as f:
                    data = memoryview(f.read())
                with store.open_input_file(path.removesuffix(".rec") + ".idx") as f:
                    places = np.frombuffer(f.read(), "<u8").tolist()
                if not places or places[-1] != len(data):
                    raise ValueError(f"the index doesn't match the length of {name}")
                out = []
                for at, after in zip(places[:-1], places[1:], strict=True):
                    doc_id, ids, stop = parse(data, at)
                    if stop != after:
                        raise ValueError(f"the index doesn't match the record at byte {at}")
                    out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
                    start += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return files.repartition(tasks, "path").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
