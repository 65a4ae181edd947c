"""What several operators of this folder share."""

from __future__ import annotations

import sys
from collections.abc import Callable
from itertools import repeat
from types import ModuleType
from typing import Any

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DataType

from fathomix.operators.skew import lookup_join
from fathomix.session import materialize, release

# Two hashes of a whole row; together 128 bits, so distinct rows have distinct keys.
ROW_KEYS = ("_row_key_a", "_row_key_b")


def words(text: bytes) -> list[bytes]:
    """Words of UTF-8 text: A-Z lower-cased, split at spaces and 0x09 to 0x0D."""
    return text.lower().split()


def per_worker(name: str, make: Callable[[], Any]) -> Any:
    """What ``make`` returns, made once per worker process and name."""
    kept = sys.modules.setdefault("fathomix_worker_values", ModuleType("fathomix_worker_values")).__dict__
    if name not in kept:
        kept[name] = make()
    return kept[name]


def hashes_of(parts: list[bytes], seed: int) -> np.ndarray:
    """The 64-bit hash of each word."""
    return np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(seed)), np.uint64, len(parts))


def small_batches(rows: DataFrame) -> None:
    """Hand texts to Python 500 rows at a time, unless the session has a size of its own.

    Spark's default of 10,000 rows holds some hundred megabytes of long texts per task.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if rows.sparkSession.conf.get(name) == "10000":
        rows.sparkSession.conf.set(name, "500")


def text_bytes(column: str = "text") -> Column:
    """The text's UTF-8 bytes; a null text is empty."""
    return F.coalesce(F.col(f"`{column}`"), F.lit("")).cast("binary")


def _beside_keys(columns: list[str]) -> list[str]:
    """The column names, changed where they are those of the row keys."""
    names, taken = [], {c.lower() for c in columns} | set(ROW_KEYS)
    for column in columns:
        if column.lower() in ROW_KEYS:
            column += "_given"
            while column.lower() in taken:
                column += "_"
            taken.add(column.lower())
        names.append(column)
    return names


def _hashable(name: str, kind: DataType) -> Column:
    """The column, or its JSON where Spark has no hash for its type."""
    text = kind.simpleString()
    return F.to_json(F.struct(F.col(f"`{name}`"))) if "map<" in text or "variant" in text else F.col(f"`{name}`")


def with_row_keys(rows: DataFrame) -> DataFrame:
    """Add hashes of each whole row, which name it even where its id is null.

    Columns that are called like the keys get other names until ``as_given``.
    """
    rows = rows.toDF(*_beside_keys(rows.columns))
    nulls = F.concat(F.lit(""), *[F.col(f"`{c}`").isNull().cast("string") for c in rows.columns])
    columns = [_hashable(f.name, f.dataType) for f in rows.schema]
    return rows.withColumns({
        ROW_KEYS[0]: F.xxhash64(nulls, *columns),
        ROW_KEYS[1]: F.xxhash64(F.lit("b"), *columns[::-1], nulls),
    })


def as_given(keyed: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows of ``with_row_keys(rows)`` with the columns of ``rows`` again."""
    return keyed.select(*[F.col(f"`{c}`") for c in _beside_keys(rows.columns)]).toDF(*rows.columns)


def without_rows(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """``rows`` (with row keys) whose keys are not in ``gone``."""
    return lookup_join(rows, gone.select(*ROW_KEYS).distinct(), ROW_KEYS, "left_anti")


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: each linked node and the smallest node it reaches.

    ``edges`` has ``a`` and ``b`` longs. Alternating large and small stars: every round hangs
    neighbours onto the smallest known node, so rounds grow with the logarithm of a
    component's size. Each round is written to the shared folder; only a count and a checksum
    reach the driver.
    """
    now = materialize(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    seen = _checksum(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = (
            both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .filter("u <> v").distinct()
        )
        large = materialize(large)
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        after = materialize(small.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct())
        found = _checksum(after)
        release(large, now)
        now = after
        if found == seen:
            break
        seen = found
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def _checksum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
