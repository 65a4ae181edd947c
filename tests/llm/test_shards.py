import zlib

import pytest
from pyspark.sql import functions as F

from fathomix.llm import shards


@pytest.fixture(scope="module")
def keys(spark):
    return spark.range(20_000).select(F.col("id").alias("doc_id"))


def placed(keys, tree):
    return {r.doc_id: r.s for r in keys.select("doc_id", shards.place(tree, F.col("doc_id")).alias("s")).collect()}


def test_shares_follow_the_weights(keys):
    tree = {"a": {"r": {0: 1.0, 1: 3.0}, "q": {2: 2.0}}, "b": {"r": {3: 2.0}}}
    found = placed(keys, tree)
    for shard, weight in {0: 1, 1: 3, 2: 2, 3: 2}.items():
        assert sum(s == shard for s in found.values()) == pytest.approx(20_000 * weight / 8, rel=0.08)


def test_one_more_shard_takes_rows_only_into_itself(keys):
    for n in (1, 5, 8):
        tree = shards.even_tree(n)
        before, after = placed(keys, tree), placed(keys, shards.grown(tree, n))
        moved = {k: s for k, s in after.items() if s != before[k]}
        assert set(moved.values()) == {n}
        assert len(moved) == pytest.approx(20_000 / (n + 1), rel=0.1)


def test_movement_stays_in_the_changed_subtrees(keys):
    tree = shards.even_tree(8)
    heavier = {**tree, "region1": {**tree["region1"], "rack2": {4: 1.0, 5: 2.0}}}
    before, after = placed(keys, tree), placed(keys, heavier)
    moved = [(before[k], after[k]) for k in before if before[k] != after[k]]
    # Region 1 gains and no other region does; within it, rack 3 gives rows to rack 2 and gets its share of the gain.
    assert moved and all(to in (4, 5, 6, 7) for _, to in moved)
    inside = {**tree, "region1": {"rack2": {4: 1.5, 5: 0.5}, "rack3": tree["region1"]["rack3"]}}
    after = placed(keys, inside)
    assert {(before[k], after[k]) for k in before if before[k] != after[k]} == {(5, 4)}


def test_rows_get_gapless_slots(documents):
    rows = [(i, "text " * (i % 7)) for i in range(500)]
    got = shards.shard_rows(documents(rows).repartition(6), shards.even_tree(4)).collect()
    texts = dict(rows)
    for r in got:
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), None)
    for shard in range(4):
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))


def test_odd_rows(odd, empty):
    tree = shards.even_tree(3)
    got = shards.shard_rows(odd, tree, shards.grown(tree, 3)).collect()
    assert len(got) == 10 and sorted((r.size, r.text_crc32) for r in got)[:2] == [(1, 0), (1, 0)]
    for shard in range(3):
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))
    assert len({r.shard for r in got if r.doc_id is None}) == 1 and len({r.shard for r in got if r.doc_id == 7}) == 1
    assert shards.shard_rows(empty, tree).count() == 0


def test_bad_trees():
    for bad in ({}, {"a": {}}, {"a": {"b": {}}}):
        with pytest.raises(ValueError, match="child"):
            shards.place(bad, F.lit(1))
    with pytest.raises(ValueError, match="positive"):
        shards.place({"a": {"b": {0: 0.0, 1: 1.0}}}, F.lit(1))
    with pytest.raises(ValueError, match="already"):
        shards.grown(shards.even_tree(2), 1)


def test_only_built_in_functions(documents):
    plan = shards.shard_rows(documents([(1, "a")]), shards.even_tree(2))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def plain_place(tree, key):
    """The same draws by plain code: XXH64 over key and child, seed 42, exponential over the weight."""
    import math

    import xxhash

    text = ("null" if key is None else f"={key}").encode()

    def winner(children):
        draws = []
        for name, weight in children.items():
            bits = xxhash.xxh64_intdigest(name.encode(), xxhash.xxh64_intdigest(text, 42)) >> 11
            draws.append((-math.log((bits + 0.5) / 2**53) / weight, name))
        return min(draws)[1]

    weights = {r: {k: sum(s.values()) for k, s in racks.items()} for r, racks in tree.items()}
    region = winner({r: sum(w.values()) for r, w in weights.items()})
    rack = winner({f"{region}/{k}": w for k, w in weights[region].items()})
    leaves = tree[region][rack.split("/", 1)[1]]
    return int(winner({f"{rack}/{s}": w for s, w in leaves.items()}).rsplit("/", 1)[1])


def test_placement_equals_plain_draws(spark):
    from pyspark.sql import functions as F

    from fathomix.llm import shards

    uneven = {"a": {"x": {0: 1.0, 1: 3.5}, "y": {2: 0.2}}, "b": {"x": {3: 2.0}}}
    keys = [None, 0, 1, -7, *range(100, 600)]
    rows = spark.createDataFrame([(k,) for k in keys], "k long")
    for tree in (uneven, shards.even_tree(8), shards.grown(shards.even_tree(8), 8)):
        got = rows.select("k", shards.place(tree, F.col("k")).alias("s")).collect()
        assert {r["k"]: r["s"] for r in got} == {k: plain_place(tree, k) for k in keys}
