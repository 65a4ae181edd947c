"""Order-sensitive operators: row numbers, every-Nth thinning, caps, slots, previews.

Numbering the rows of a dataset with one window per dataset would put a long trajectory
into a single task. Here the rows of a dataset are first split into blocks of neighbouring
rows; blocks are numbered on their own and shifted by the count of the rows before them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from fathomix.operators.skew import lookup_join
from fathomix.session import materialize, materialize_counted

# Row numbers covered by one block; a block never holds more rows than this when row
# numbers are unique within a dataset.
BLOCK_ROWS = 1 << 18

# One task adds up the blocks of a dataset; row numbers so sparse that a dataset has more
# blocks than this are replaced by dense ones first.
MAX_BLOCKS = 1 << 20

# Blocks with fewer rows than this on average cost more than they save, once there are many.
MIN_BLOCK_ROWS = 64
MANY_BLOCKS = 100_000

# Up to this many results a cap sorts directly; each task then sends on at most that many.
DIRECT_LIMIT = 10_000

# A preview is sorted directly, so it shows no more than this.
PREVIEW_LIMIT = 10_000

# Low bits of Spark's increasing row id count the rows of a partition, high bits name it.
_ROW_BITS = 33


def _block(order: str, block_rows: int) -> Column:
    return F.expr(f"`{order}` div {block_rows}L")


def _keyed(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add the keys as one value, which joins and groups nulls like any other."""
    return rows.withColumn("_keys", F.struct(F.lit(0).alias("_"), *[F.col(f"`{k}`") for k in keys]))


def _rows_before(counts: DataFrame) -> DataFrame:
    earlier = (
        Window.partitionBy("_keys").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    )
    return counts.select(
        "_keys", "_block", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before")
    )


def _poor_blocks(blocks: DataFrame, block_rows: int) -> bool:
    """Whether a dataset has too many blocks, a block too many rows, or blocks too few rows.

    ``blocks`` has ``_keys``, ``_block`` and ``_rows``.
    """
    per_key = blocks.groupBy("_keys").agg(
        F.count("*").alias("n"), F.sum("_rows").alias("rows"), F.max("_rows").alias("most")
    )
    seen = per_key.agg(F.max("n"), F.sum("n"), F.sum("rows"), F.max("most")).first()
    if not seen[1]:
        return False
    thin_blocks = seen[1] > MANY_BLOCKS and seen[2] < MIN_BLOCK_ROWS * seen[1]
    return seen[0] > MAX_BLOCKS or thin_blocks or seen[3] > max(block_rows, DIRECT_LIMIT)


def block_counts(
    rows: DataFrame,
    keys: Sequence[str] = ("dataset_id",),
    order: str = "row_idx",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Stored ``_keys, _block, _rows``: how many rows each block of each key holds."""
    blocked = _keyed(rows, keys).withColumn("_block", F.struct(_block(order, block_rows).alias("b")))
    return materialize(blocked.groupBy("_keys", "_block").agg(F.count("*").alias("_rows")))


def with_position(
    rows: DataFrame,
    keys: Sequence[str] = ("dataset_id",),
    order: str = "row_idx",
    name: str = "position",
    block_rows: int = BLOCK_ROWS,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Add the 0-based position of each row within its keys, by ``order``.

    ``order`` is a whole number that is unique within the keys; gaps, such as those left by
    a filter, are fine. Rows with a null ``order`` come first, in any order among
    themselves, and null keys are keys like others: no row is lost on any path. Only the
    per-block counts cross datasets, so a dataset of any length is numbered in parallel.
    Counting runs when this is called, unless ``block_counts`` of the same rows are given.
    """
    keys = list(keys)
    blocked = _keyed(rows, keys).withColumn("_block", F.struct(_block(order, block_rows).alias("b")))
    counts = block_counts(rows, keys, order, block_rows) if counts is None else counts
    if _poor_blocks(counts, block_rows):
        return dense_row_index(rows, [order], keys, name)
    local = Window.partitionBy("_keys", "_block").orderBy(order)
    numbered = blocked.withColumn("_local", F.row_number().over(local) - 1)
    # The large side is already partitioned by keys and block, so this join moves none of it.
    joined = numbered.join(_rows_before(counts), ["_keys", "_block"])
    return joined.select(*rows.columns, (F.col("_before") + F.col("_local")).alias(name))


def thin(
    rows: DataFrame,
    step: int,
    keys: Sequence[str] = ("dataset_id",),
    order: str = "row_idx",
    block_rows: int = BLOCK_ROWS,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Keep every ``step``-th row of each dataset, starting with its first."""
    if step < 1:
        raise ValueError(f"step must be at least 1, got {step}")
    if step == 1:
        return rows
    placed = with_position(rows, keys, order, "_position", block_rows, counts)
    return placed.filter(F.col("_position") % step == 0).drop("_position")


def dense_row_index(
    rows: DataFrame,
    order: Sequence[str],
    keys: Sequence[str] = ("dataset_id",),
    name: str = "row_idx",
) -> DataFrame:
    """Number the rows of each dataset 0, 1, 2 … by ``order``, for data without an index.

    Rows that ``order`` does not tell apart are ordered by a hash of the whole row; nulls
    come first and null keys are keys like others. Rows are range partitioned and sorted on
    keys and order, so a long dataset spans many partitions, and written once with their
    place in the partition; the rows that come before a dataset's part of a partition are
    then a lookup. Rows move once.
    """
    keys = list(keys)
    hashed = [F.col(f"`{f.name}`") for f in rows.schema if f.dataType.typeName() != "map"]
    tied = rows.withColumn("_tie", F.xxhash64(*hashed))
    by = [*[F.col(f"`{c}`") for c in (*keys, *order)], F.col("_tie")]
    ranged = tied.repartitionByRange(*by).sortWithinPartitions(*by)
    row_id = F.monotonically_increasing_id()
    placed = materialize(
        _keyed(ranged, keys).withColumn("_id", row_id).select(
            *rows.columns,
            "_keys",
            F.shiftright("_id", _ROW_BITS).alias("_block"),
            F.col("_id").bitwiseAND((1 << _ROW_BITS) - 1).alias("_at"),
        )
    )
    counts = placed.groupBy("_keys", "_block").agg(
        F.count("*").alias("_rows"), F.min("_at").alias("_first")
    )
    shift = materialize(
        counts.join(_rows_before(counts), ["_keys", "_block"]).select(
            "_keys", "_block", (F.col("_before") - F.col("_first")).alias("_shift")
        )
    )
    joined = lookup_join(placed, shift, ["_keys", "_block"], salt_by=["_block", "_at"])
    return joined.select(*rows.columns, (F.col("_at") + F.col("_shift")).alias(name))


def last_known_before(
    rows: DataFrame,
    value: str,
    keys: Sequence[str],
    order: str,
    name: str,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add the latest non-null ``value`` among the earlier rows of the same keys.

    Null keys are keys like others; rows with a null ``order`` count as the earliest.
    """
    keys = list(keys)
    blocked = _keyed(rows, keys).withColumn("_block", F.struct(_block(order, block_rows).alias("b")))
    latest = F.max(
        F.when(F.col(value).isNotNull(), F.struct(F.col(order).alias("at"), F.col(value).alias("v")))
    )
    per_block = materialize(
        blocked.groupBy("_keys", "_block").agg(latest.alias("_last"), F.count("*").alias("_rows"))
    )
    if _poor_blocks(per_block, block_rows):
        dense = dense_row_index(rows, [order], keys, "_dense")
        return last_known_before(dense, value, keys, "_dense", name, block_rows).drop("_dense")
    earlier = (
        Window.partitionBy("_keys").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = per_block.select(
        "_keys", "_block", F.last("_last.v", ignorenulls=True).over(earlier).alias("_carried")
    )
    local = (
        Window.partitionBy("_keys", "_block")
        .orderBy(order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    looked = blocked.withColumn("_here", F.last(value, ignorenulls=True).over(local))
    joined = looked.join(carried, ["_keys", "_block"])
    return joined.select(*rows.columns, F.coalesce("_here", "_carried").alias(name))


def unique_results(results: DataFrame, keys: Sequence[str], rank: str = "rank") -> DataFrame:
    """One row per key, placed where the key was first seen."""
    return results.groupBy(*keys).agg(F.min(rank).alias(rank))


def first_ranked(
    results: DataFrame, limit: int, rank: str = "rank", name: str = "place"
) -> DataFrame:
    """The first ``limit`` results by a unique rank, with their 0-based place.

    A small cap is sorted directly and only the capped rows reach a numbering window. A
    large one is found by numbering ranges of ranks, so no task holds all of it.
    """
    if limit < 1:
        raise ValueError(f"the cap must be at least 1, got {limit}")
    if limit <= DIRECT_LIMIT:
        first = results.orderBy(rank).limit(limit)
        return first.withColumn(name, F.row_number().over(Window.orderBy(rank)).cast("long") - 1)
    return dense_row_index(results, [rank], [], name).filter(F.col(name) < limit)


def first_page(results: DataFrame, limit: int, rank: str = "rank") -> DataFrame:
    """The first ``limit`` results by a unique rank, unsorted and with all their columns.

    A large page is cut at the rank that closes it, so only ranks are sorted and stored.
    """
    if limit <= DIRECT_LIMIT:
        return first_ranked(results, limit, rank).drop("place")
    ranks = materialize(results.select(rank))
    if ranks.count() <= limit:
        return results
    last = dense_row_index(ranks, [rank], [], "place").filter(F.col("place") == limit - 1).first()[rank]
    return results.filter(F.col(rank).isNull() | (F.col(rank) <= F.lit(last)))


def preview(results: DataFrame, limit: int, order: Sequence[str | Column]) -> DataFrame:
    """The first ``limit`` results, each with the ``total`` and how many ``more`` there are.

    Pass only the columns to show: the results are written once, so that counting them does
    not search a second time.
    """
    if limit > PREVIEW_LIMIT:
        raise ValueError(f"a preview shows at most {PREVIEW_LIMIT} results; take a page for {limit}")
    kept, total = materialize_counted(results)
    return kept.orderBy(*order).limit(limit).withColumns(
        {"total": F.lit(total).cast("long"), "more": F.lit(max(total - limit, 0)).cast("long")}
    )


def palette_slot(place: Column, palette_size: int = 10) -> Column:
    """Palette slot of the track at ``place``; tracks without points still use one up."""
    return (place % palette_size).cast("int")
