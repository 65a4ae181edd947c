"""Shards by a hierarchical weighted hash tree.

A tree has regions, racks and shards; a node weighs as much as the shards below it. A row
descends from the root: at each level every child draws a hash of the row's key and the
child's name, divides the draw's exponential by its weight, and the smallest wins. A child's
draw depends on nothing but key, name and weight, so when weights change, rows move only
into or out of the subtrees whose weights changed. A shard added as a region of its own
takes rows only into itself.

Rows: a null key is a key of its own, a null text has no bytes, repeated rows share a shard
and get slots of their own, and extra columns are ignored. Only built-in functions are used.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from fathomix.operators.sampling import dense_row_index
from fathomix.session import materialize

# {region: {rack: {shard: weight}}}
Tree = Mapping[str, Mapping[str, Mapping[int, float]]]


def even_tree(shards: int, per_rack: int = 2, racks: int = 2) -> dict[str, dict[str, dict[int, float]]]:
    """Equal weights, ``per_rack`` shards to a rack and ``racks`` racks to a region."""
    tree: dict[str, dict[str, dict[int, float]]] = {}
    for shard in range(shards):
        rack = shard // per_rack
        tree.setdefault(f"region{rack // racks}", {}).setdefault(f"rack{rack}", {})[shard] = 1.0
    return tree


def grown(tree: Tree, shard: int, weight: float = 1.0) -> dict[str, dict[str, dict[int, float]]]:
    """``tree`` and one more shard, which is a region of its own."""
    copy = {region: {rack: dict(below) for rack, below in racks.items()} for region, racks in tree.items()}
    if f"region of {shard}" in copy or any(shard in s for r in copy.values() for s in r.values()):
        raise ValueError(f"shard {shard} is already in the tree")
    return {**copy, f"region of {shard}": {f"rack of {shard}": {shard: weight}}}


def _draw(key: Column, child: str, weight: float) -> Column:
    """Exponential draw over the weight; never zero, as the hash is moved to (0, 1)."""
    if not weight > 0:
        raise ValueError(f"the weight of {child} must be positive, not {weight}")
    unit = (F.shiftrightunsigned(F.xxhash64(key, F.lit(child)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return -F.log(unit) / F.lit(float(weight))


def _winner(key: Column, children: Mapping[str, float], names: Mapping[str, Column]) -> Column:
    draws = [
        F.struct(_draw(key, child, weight).alias("draw"), F.lit(child).alias("child"), names[child].alias("name"))
        for child, weight in sorted(children.items())
    ]
    return F.array_min(F.array(*draws))["name"] if len(draws) > 1 else next(iter(names.values()))


def place(tree: Tree, key: Column) -> Column:
    """Shard of a key: the region, then its rack, then its shard, each by weighted draws."""
    if not tree or not all(racks and all(racks.values()) for racks in tree.values()):
        raise ValueError("every node of the tree needs a child")
    text = F.coalesce(F.concat(F.lit("="), key.cast("string")), F.lit("null"))
    weights = {region: {rack: sum(s.values()) for rack, s in racks.items()} for region, racks in tree.items()}
    region = _winner(text, {r: sum(w.values()) for r, w in weights.items()}, {r: F.lit(r) for r in tree})
    shard = F.lit(None).cast("int")
    for name, racks in tree.items():
        rack = _winner(text, {f"{name}/{k}": w for k, w in weights[name].items()},
                       {f"{name}/{k}": F.lit(f"{name}/{k}") for k in racks})
        below = F.lit(None).cast("int")
        for rack_name, shards in racks.items():
            path = f"{name}/{rack_name}"
            leaf = _winner(text, {f"{path}/{s}": w for s, w in shards.items()},
                           {f"{path}/{s}": F.lit(s) for s in shards})
            below = F.when(rack == path, leaf).otherwise(below)
        shard = F.when(region == name, below).otherwise(shard)
    return shard


def shard_rows(docs: DataFrame, tree: Tree, next_tree: Tree | None = None, key: str = "doc_id") -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot, grown_shard`` of every row.

    ``size`` is the text's UTF-8 bytes plus one; ``slot`` counts each shard's rows from 0
    without gaps, by key. Numbering range-partitions the narrow rows, so no shard is one task.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    name = F.col(f"`{key}`")
    later = place(next_tree, name) if next_tree else F.lit(None).cast("int")
    sized = materialize(docs.select(
        name.alias(key),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        place(tree, name).alias("shard"),
        later.alias("grown_shard"),
    ))
    numbered = dense_row_index(sized, [key, "text_crc32"], ["shard"], "slot")
    return numbered.select(key, "size", "text_crc32", "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")
