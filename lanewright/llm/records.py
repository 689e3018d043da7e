"""Token ids as length-delimited binary records with an offset index.

A file holds the records of a range of doc_ids in ascending order.  A record is
``length (u64) | masked crc of length (u32) | payload | masked crc of payload (u32)``, all
little-endian; the payload is ``id width (u8: 2 or 4) | ids``.  Masking is
``rotate_right(crc32, 15) + 0xA282EAD8``, so that a checksum of data that hold checksums stays
useful.  The index (Parquet beside the files: doc_id, file, offset, size, n_tokens, start in the
file) serves reads in any order.  Files are written under a name of the attempt and renamed, so a
task that runs again leaves the same file.

Cases: null or empty text gives a record of the end id alone; a null doc_id sorts first; rows
that repeat a doc_id are ordered by text and each keep a record; no documents give no rows; extra
columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import require_columns, scratch_path, small_batches
from .tokens import encoder

MASK = 0xA282EAD8
INDEX = "doc_id {id}, file int, offset long, size long, n_tokens long, start long"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return length + struct.pack("<I", masked(length)) + payload + struct.pack("<I", masked(payload))


def unframe(data: memoryview) -> bytes:
    length = bytes(data[:8])
    (n,) = struct.unpack("<Q", length)
    if struct.unpack("<I", data[8:12])[0] != masked(length) or n + 16 > len(data):
        raise ValueError("corrupt record length")
    payload = bytes(data[12 : 12 + n])
    if struct.unpack("<I", data[12 + n : 16 + n])[0] != masked(payload):
        raise ValueError("corrupt record")
    return payload


def serialize(ids: np.ndarray) -> bytes:
    width = 2 if not len(ids) or ids.max() < 1 << 16 else 4
    return bytes([width]) + ids.astype(f"<u{width}").tobytes()


def deserialize(payload: bytes) -> np.ndarray:
    return np.frombuffer(payload, f"<u{payload[0]}", offset=1).astype("<u4")


def open_store(uri: str):
    """File system and path of a shared folder; any store that pyarrow knows."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def _name(path: str, part: int) -> str:
    return f"{path}/part-{part:06d}.rec"


def _write(batches: Iterable[pa.RecordBatch], path: str, tokenizer: str, end_id: int) -> Iterator[pa.RecordBatch]:
    store, root = open_store(path)
    enc, part = encoder(tokenizer), TaskContext.get().partitionId()
    end, temporary = np.array([end_id], "<u4").tobytes(), f"{root}/.{uuid.uuid4().hex}"
    out, at, start = None, 0, 0
    for b in batches:
        if not b.num_rows:
            continue
        out = out or store.open_output_stream(temporary)
        offsets, sizes, counts, starts = [], [], [], []
        for raw in enc.encode_many(b.column(1).to_pylist()):
            record = frame(serialize(np.frombuffer(raw + end, "<u4")))
            out.write(record)
            offsets.append(at), sizes.append(len(record)), counts.append(len(raw) // 4 + 1), starts.append(start)
            at += len(record)
            start += counts[-1]
        yield pa.record_batch([b.column(0), pa.array([part] * b.num_rows, pa.int32()), *(pa.array(x, pa.int64()) for x in (offsets, sizes, counts, starts))], ["doc_id", "file", "offset", "size", "n_tokens", "start"])
    if out:
        out.close()
        store.move(temporary, _name(root, part))


def write_records(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2) -> None:
    """Write the documents' records and their index under path."""
    require_columns(docs, ["doc_id", "text"])
    spark = docs.sparkSession
    small_batches(spark)
    store, root = open_store(path)
    store.create_dir(root)
    kind = docs.schema["doc_id"].dataType.simpleString()
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(partial(_write, path=path, tokenizer=tokenizer, end_id=end_id), INDEX.format(id=kind)).write.parquet(f"{path}/index")


def _read(batches: Iterable[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    store, root = open_store(path)
    opened: tuple[int, object] | None = None
    for b in batches:
        files, offsets, sizes = (b.column(i).to_pylist() for i in (1, 2, 3))
        ids, i = [], 0
        while i < len(files):
            j = i + 1
            while j < len(files) and files[j] == files[i] and offsets[j] == offsets[j - 1] + sizes[j - 1]:
                j += 1
            if opened is None or opened[0] != files[i]:
                opened = files[i], store.open_input_file(_name(root, files[i]))
            run = memoryview(opened[1].read_at(offsets[j - 1] + sizes[j - 1] - offsets[i], offsets[i]))
            ids += [unframe(run[offsets[k] - offsets[i] : offsets[k] - offsets[i] + sizes[k]]) for k in range(i, j)]
            i = j
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids, pa.binary())], [*b.schema.names, "payload"])


def _digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids = [deserialize(x) for x in b.column("payload").to_pylist()]
        yield pa.record_batch([b.column("doc_id"), b.column("start"), pa.array(map(len, ids), pa.int64()), pa.array((zlib.crc32(x.tobytes()) for x in ids), pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def _both(batches: Iterable[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    yield from _digest(_read(batches, path))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The index with ``start`` counted over all files, in the order of doc_id."""
    index = spark.read.parquet(f"{path}/index")
    # One row for each file: bounded by the number of write tasks.
    before = F.sum("total").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))
    files = index.groupBy("file").agg(F.sum("n_tokens").alias("total")).select("file", F.coalesce(before, F.lit(0)).alias("before"))
    return index.join(F.broadcast(files), "file").select("doc_id", "file", "offset", "size", "n_tokens", (F.col("start") + F.col("before")).alias("start"))


def read_records(spark: SparkSession, path: str, shuffle_seed: int | None = None) -> DataFrame:
    """doc_id, ids of every record, in the order of the files or shuffled through the index."""
    index = read_index(spark, path).select("doc_id", "file", "offset", "size")
    if shuffle_seed is not None:
        index = index.repartition(F.xxhash64(F.lit(shuffle_seed), "file", "offset")).sortWithinPartitions(F.xxhash64(F.lit(shuffle_seed), "file", "offset"))

    def ids(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _read(batches, path):
            yield pa.record_batch([b.column(0), pa.array([deserialize(x).tolist() for x in b.column("payload").to_pylist()], pa.list_(pa.int64()))], ["doc_id", "ids"])

    return index.mapInArrow(ids, f"doc_id {index.schema['doc_id'].dataType.simpleString()}, ids array<long>")


def encode_and_read_back(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """documents -> doc_id, start, n_tokens, ids_crc32, as read from files written to shared storage."""
    spark = docs.sparkSession
    path = scratch_path(spark, "records")
    write_records(docs, path, tokenizer, end_id)
    index = read_index(spark, path)
    return index.mapInArrow(partial(_both, path=path), f"doc_id {index.schema['doc_id'].dataType.simpleString()}, start long, n_tokens long, ids_crc32 long")
