"""SimHash near-duplicates by a segment-popcount embedding.

A 64-bit fingerprint is embedded as the bit counts of its segments. The Manhattan distance
between two such vectors never exceeds the Hamming distance of the fingerprints, so a range
join in that space finds every pair within the Hamming radius, and the exact distance then
decides. The vector is cut into groups; of ``g`` groups at least one lies within
``radius // g`` of its partner, so each group is a grid of unit cells that a fingerprint
probes in its own cell and in the neighbours one step up.

With 16 segments of two bits in a group, chance puts about one in six million pairs into one
cell. ``segment_bits=1`` narrows that 650-fold for tables beyond some billion fingerprints;
the links found are the same.

Rows: a null text counts as empty, an empty text has fingerprint 0 and links like any other.
Rows with a null id get a fingerprint and a component but never name one. Repeated rows stay
repeated in ``near_duplicates`` and become one row in ``keep_one``. Extra columns are ignored
by the first and kept by the second.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from fathomix.llm.common import (
    ROW_KEYS, as_given, components, small_batches, text_bytes, with_row_keys, without_rows, words,
)
from fathomix.operators.skew import lookup_join
from fathomix.session import materialize, release

# Shingles whose bits are counted at once.
BLOCK = 1 << 16
HASH_SEED = 42
# The low bit of every two.
LOW_BITS = 0x5555555555555555


def fingerprint_of(text: bytes, shingle: int = 3) -> int:
    """Bits set in over half of the hashes of the text's word shingles, repeats included."""
    parts = words(text)
    if not parts:
        return 0
    joined = b" ".join(parts)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lengths) + np.arange(len(parts))
    starts = ends - lengths
    if len(parts) >= shingle:
        starts, ends = starts[: len(parts) - shingle + 1], ends[shingle - 1:]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, len(starts), BLOCK):
        pairs = zip(starts[at:at + BLOCK].tolist(), ends[at:at + BLOCK].tolist())
        hashes = np.array([digest(joined[a:b], HASH_SEED) for a, b in pairs], ">u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(starts)).tobytes(), "big", signed=True)


def fingerprints(rows: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",),
                 shingle: int = 3) -> DataFrame:
    """``keep`` columns and ``fingerprint`` (signed long) of each row's whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint_of(t.as_py(), shingle) for t in batch.column(batch.num_columns - 1)]
            columns = [*batch.columns[:-1], pa.array(found, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "fingerprint"])

    small_batches(rows)
    read = rows.select(*[F.col(f"`{c}`") for c in keep], text_bytes(text).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in read.schema[:-1])
    return read.mapInArrow(run, f"{schema}, fingerprint long")


def _bit_counts(fingerprint: Column, segment_bits: int) -> Column:
    """Bit counts of all segments, each in its segment's own place."""
    if segment_bits not in (1, 2):
        raise ValueError(f"segments have 1 or 2 bits, not {segment_bits}")
    if segment_bits == 1:
        return fingerprint
    low = fingerprint.bitwiseAND(LOW_BITS)
    high = F.shiftrightunsigned(fingerprint, 1).bitwiseAND(LOW_BITS)
    return F.shiftleft(low.bitwiseAND(high), 1).bitwiseOR(low.bitwiseXOR(high))


def links(distinct: DataFrame, radius: int = 3, segment_bits: int = 2) -> DataFrame:
    """Pairs ``a, b`` of different fingerprints at ``radius`` or fewer bits from each other.

    ``distinct`` has one row per ``fingerprint``; copies were folded before, so a group of
    copies costs one row here.
    """
    groups = (radius + 2) // 2
    segments = 64 // segment_bits
    if groups > segments:
        raise ValueError(f"radius {radius} needs more than {segments} segments")
    bounds = [segments * g // groups for g in range(groups + 1)]
    counts = distinct.select("fingerprint", _bit_counts(F.col("fingerprint"), segment_bits).alias("_counts"))
    index, probes = [], []
    for g, (first, last) in enumerate(zip(bounds, bounds[1:])):
        bits = (last - first) * segment_bits
        cell = F.shiftrightunsigned("_counts", first * segment_bits)
        if bits < 64:
            cell = cell.bitwiseAND((1 << bits) - 1)
        group = F.lit(g).alias("group")
        index.append(F.struct(group, cell.alias("cell")))
        steps = [F.struct(group, cell.alias("cell"), F.lit(False).alias("up"))]
        for i in range(last - first) if radius // groups else ():
            place = i * segment_bits
            field = F.shiftrightunsigned(cell, place).bitwiseAND((1 << segment_bits) - 1)
            # 0 becomes 1 and 1 becomes 2: the bits that change in the field.
            changed = F.when(field == 0, F.lit(1)).otherwise(F.lit(3)).cast("long")
            above = cell.bitwiseXOR(F.shiftleft(changed, place))
            steps.append(F.when(
                field < segment_bits, F.struct(group, above.alias("cell"), F.lit(True).alias("up"))
            ))
        probes.append(F.array_compact(F.array(*steps)))
    held = counts.select(F.col("fingerprint").alias("b"), F.inline(F.array(*index)))
    asked = counts.select(F.col("fingerprint").alias("a"), F.inline(F.concat(*probes)))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    pairs = asked.join(held, ["group", "cell"]).filter(near & (F.col("a") != F.col("b")))
    return pairs.filter(F.col("up") | (F.col("a") < F.col("b"))).select("a", "b")


def classes(prints: DataFrame, first: Column, radius: int = 3, segment_bits: int = 2) -> DataFrame:
    """``fingerprint, first``: the least ``first`` of all rows that each fingerprint reaches.

    ``prints`` is a stored table with ``fingerprint``.
    """
    distinct = materialize(prints.groupBy("fingerprint").agg(F.min(first).alias("first")))
    linked = components(links(distinct.select("fingerprint"), radius, segment_bits))
    rooted = distinct.join(linked.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").select(
        "fingerprint", "first", F.coalesce("root", "fingerprint").alias("root")
    )
    alone = rooted.groupBy("root").agg(F.min("first").alias("first"))
    return rooted.select("fingerprint", "root").join(alone, "root").select("fingerprint", "first")


def near_duplicates(docs: DataFrame, radius: int = 3, shingle: int = 3, segment_bits: int = 2) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs``.

    ``fingerprint`` is 16 hex digits and ``component_id`` the smallest ``doc_id`` reachable
    over links of ``radius`` or fewer differing bits (null where all are null).
    """
    prints = materialize(fingerprints(docs, shingle=shingle))
    named = materialize(classes(prints, F.col("doc_id"), radius, segment_bits))
    joined = lookup_join(prints, named, ["fingerprint"], salt_by=["doc_id"])
    return joined.select(
        "doc_id",
        F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        F.col("first").alias("component_id"),
    )


def keep_one(docs: DataFrame, radius: int = 3, shingle: int = 3, segment_bits: int = 2) -> DataFrame:
    """``docs`` with one row of each component: the smallest id, then the least row hash.

    A row with an id stays before rows without. Complete copies of the row that stays go too.
    """
    keyed = with_row_keys(docs)
    prints = materialize(fingerprints(keyed, keep=("doc_id", *ROW_KEYS), shingle=shingle))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *ROW_KEYS)
    named = materialize(classes(prints, order, radius, segment_bits))
    best = lookup_join(prints, named, ["fingerprint"], salt_by=list(ROW_KEYS))
    stays = F.col(ROW_KEYS[0]).eqNullSafe(F.col(f"first.{ROW_KEYS[0]}")) & F.col(ROW_KEYS[1]).eqNullSafe(
        F.col(f"first.{ROW_KEYS[1]}")
    )
    judged = materialize(best.select(*ROW_KEYS, stays.alias("_stays")))
    copies = materialize(
        judged.filter("_stays").groupBy(*ROW_KEYS).agg(F.count("*").alias("_n")).filter("_n > 1")
    )
    gone = judged.filter("NOT _stays").select(*ROW_KEYS).unionByName(copies.select(*ROW_KEYS))
    kept = without_rows(keyed, gone)
    if not copies.isEmpty():
        repeated = lookup_join(keyed, copies.select(*ROW_KEYS), ROW_KEYS, "left_semi")
        kept = kept.unionByName(repeated.dropDuplicates(list(ROW_KEYS)))
    release(prints)
    return as_given(kept, docs)
