"""Joins that hold up when a single key owns a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructType

# A lookup side within both limits is sent to every task.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20
# A key with more rows than this is spread over several tasks …
KEY_ROWS = 1_000_000
# … and at most so many keys are: a key must also hold this fraction of all rows.
HOT_KEYS = 10_000


def lookup_join(
    rows: DataFrame,
    lookup: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    broadcast_rows: int = BROADCAST_ROWS,
    key_rows: int = KEY_ROWS,
    salt_by: Sequence[str] | None = None,
    nulls: bool = False,
) -> DataFrame:
    """Join many ``rows`` per key to the few ``lookup`` rows of that key.

    The lookup side's rows and bytes are measured, whatever its column types, and it is
    broadcast only when both fit. Beyond that the rows per key are counted and every key
    with more than ``key_rows`` gets a salt for each ``key_rows`` of them, so a key with a
    third of all rows is dealt to as many tasks as it needs; other keys are not copied.
    ``how`` is ``inner``, ``left``, ``left_semi`` or ``left_anti``; both sides are read twice,
    so store what is costly to compute.

    ``salt_by`` names the columns that tell the rows of one key apart (all, if unset). Rows
    that are complete copies share a salt, so aggregate copies away before joining.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"lookup_join keeps the left rows; {how!r} is not supported")
    keys = list(on)
    if fits_broadcast(lookup, broadcast_rows):
        return _joined(rows, F.broadcast(lookup), keys, how, nulls)
    counts = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n")).first()[0] or 0
    hot = counts.filter(F.col("_n") > max(key_rows, total // HOT_KEYS)).select(
        *keys, F.ceil(F.col("_n") / key_rows).cast("long").alias("_salts")
    )
    if hot.isEmpty():
        return _joined(rows, lookup, keys, how, nulls)
    hashed = salt_by or [f.name for f in rows.schema if f.dataType.typeName() != "map"]
    salts = F.coalesce("_salts", F.lit(1).cast("long"))
    # At most HOT_KEYS keys can hold that fraction of the rows each.
    salted = _joined(rows, F.broadcast(hot), keys, "left", nulls).withColumn(
        "_salt", F.pmod(F.xxhash64(*hashed), salts)
    )
    copies = _joined(lookup, F.broadcast(hot), keys, "left", nulls).withColumn(
        "_salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))
    )
    return _joined(salted.drop("_salts"), copies.drop("_salts"), [*keys, "_salt"], how, nulls).drop("_salt")


def _joined(rows: DataFrame, lookup: DataFrame, keys: list[str], how: str, nulls: bool) -> DataFrame:
    if not nulls:
        return rows.join(lookup, keys, how)
    named = {k: f"_lookup_{k}" for k in keys}
    same = reduce(Column.__and__, [F.col(f"`{k}`").eqNullSafe(F.col(f"`{n}`")) for k, n in named.items()])
    return rows.join(lookup.withColumnsRenamed(named), same, how).drop(*named.values())


def _bytes(name: str, kind) -> Column | None:
    if isinstance(kind, (StringType, BinaryType)):
        size = F.octet_length(F.col(f"`{name}`"))
    elif isinstance(kind, (ArrayType, MapType, StructType)):
        size = F.octet_length(F.to_json(F.struct(F.col(f"`{name}`"))))
    else:
        return None
    return F.coalesce(size, F.lit(0)).cast("long")


def fits_broadcast(
    lookup: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES
) -> bool:
    """Whether a side has at most ``rows`` rows and ``size`` bytes; one distributed count."""
    variable = [b for f in lookup.schema if (b := _bytes(f.name, f.dataType)) is not None]
    width = F.lit(8 * len(lookup.columns)).cast("long")
    for part in variable:
        width = width + part
    measured = lookup.agg(F.count("*").alias("rows"), F.sum(width).alias("bytes")).first()
    return measured["rows"] <= rows and (measured["bytes"] or 0) <= size
