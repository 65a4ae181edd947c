"""Blocks of documents that look their distinct values up in hash shards.

A task numbers the distinct values of a few million tokens and stores them with the numbers as
one block. Each block then sends every distinct value once to the shard that owns its hash; a
shard sees all requests for its values together and answers each block. What moves is at most
one entry per block and distinct value, packed, however often a value occurs, and no table of
all values is ever in one place.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from fathomix.llm.common import shuffle_partitions
from fathomix.session import shared_folder

# No UTF-8 text holds this byte.
BETWEEN = b"\xff"
SEED = 17


class Numbers(dict):
    """Numbers its keys in the order of their first use."""

    def __missing__(self, key: Any) -> int:
        self[key] = number = len(self)
        return number


def by_frequency(numbers: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The numbers changed so that frequent ones are small, the old number of each new one, its count."""
    counts = np.bincount(numbers, minlength=size)
    order = np.argsort(-counts, kind="stable")
    place = np.empty(size, np.uint32)
    place[order] = np.arange(size, dtype=np.uint32)
    return place[numbers], order, counts[order]


def squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def unsqueeze(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def pack(values: np.ndarray) -> bytes:
    """Whole numbers from 0 on, as compressed byte planes of the narrowest width."""
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    size = 4 if width <= 4 else 8
    wide = np.ascontiguousarray(values, f"<u{size}").view(np.uint8).reshape(-1, size)
    return bytes([width]) + squeeze(np.ascontiguousarray(wide[:, :width].T).tobytes())


def unpack(packed: bytes, kind: type = np.int64) -> np.ndarray:
    width = packed[0]
    raw = np.frombuffer(unsqueeze(packed[1:]), np.uint8).reshape(width, -1)
    wide = np.zeros((raw.shape[1], 4 if width <= 4 else 8), np.uint8)
    wide[:, :width] = raw.T
    return wide.view("<u4" if width <= 4 else "<u8").ravel().astype(kind, copy=False)


def pack_ascending(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=values.dtype.type(0)))


def unpack_ascending(packed: bytes) -> np.ndarray:
    return unpack(packed, np.uint64).cumsum(dtype=np.uint64)


def pack_texts(texts: Sequence[bytes]) -> bytes:
    return squeeze(BETWEEN.join(texts)) if texts else b""


def unpack_texts(packed: bytes) -> list[bytes]:
    return unsqueeze(packed).split(BETWEEN) if packed else []


def owners_of_texts(texts: Sequence[bytes], shards: int) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(t, SEED) for t in texts), np.uint64, len(texts))
    return owners(hashes, shards)


def owners(hashes: np.ndarray, shards: int) -> np.ndarray:
    """The shard of evenly spread 64-bit hashes."""
    return (((hashes >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int64)


def grouped(owner: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each shard that owns anything, and the places of what it owns, ascending."""
    order = np.argsort(owner, kind="stable")
    starts = np.flatnonzero(np.diff(owner[order], prepend=-1))
    for start, places in zip(starts.tolist(), np.split(order, starts[1:]) if len(starts) else []):
        yield int(owner[order[start]]), places


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one at a time; blocks are large, so no two are unpacked together."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def per_row(
    rows: DataFrame, make: Callable[[dict], Iterator[dict] | Sequence[dict]], schema: str, arrow: pa.Schema,
) -> DataFrame:
    """The rows that ``make`` yields for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            for made in make(row):
                yield pa.RecordBatch.from_pylist([made], arrow)

    return rows.mapInArrow(run, schema)


def table_bytes(batches: Sequence[pa.RecordBatch], schema: pa.Schema) -> bytes:
    """Rows of any types, for a block's binary column."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, schema) as writer:
        for batch in batches:
            writer.write_batch(pa.RecordBatch.from_arrays(batch.columns, schema=schema))
    return sink.getvalue().to_pybytes()


def table_of(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all().combine_chunks()


def stored_by(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` written to the shared folder in buckets of ``key``; joins by it leave them in place.

    The catalog keeps no entry. The files go when the application ends.
    """
    spark, table = rows.sparkSession, f"intermediate_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{table}"
    rows.write.format("parquet").bucketBy(shuffle_partitions(rows), key).option("path", path).saveAsTable(table)
    stored = spark.table(table)
    spark.sql(f"DROP TABLE {table}")
    return stored


def with_replies(blocks: DataFrame, replies: DataFrame, name: str) -> DataFrame:
    """``blocks`` and, as ``name``, their replies in the order of the shards."""
    answers = replies.filter("block IS NOT NULL").groupBy("block").agg(
        F.sort_array(F.collect_list(F.struct("shard", "reply"))).alias(name))
    return blocks.join(answers.hint("shuffle_hash"), "block", "left")


def placed(owner: np.ndarray, replies: Sequence[dict] | None, unpacked: Callable[[bytes], np.ndarray]) -> np.ndarray:
    """The replies' numbers in the order in which the block holds its values."""
    out = np.zeros(len(owner), np.int64)
    answers = {r["shard"]: r["reply"] for r in replies or []}
    for shard, places in grouped(owner):
        out[places] = unpacked(answers[shard])
    return out
