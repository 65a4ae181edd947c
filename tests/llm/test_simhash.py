import random

import pytest
import xxhash
from pyspark.sql import functions as F

from fathomix.llm import simhash


def plain_fingerprint(text, k=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    runs = [b" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, radius=3):
    root = {f: f for f in prints.values()}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    distinct = sorted(root)
    for i, a in enumerate(distinct):
        for b in distinct[i + 1:]:
            if (a ^ b).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: min(e for e in prints if find(prints[e]) == find(f)) for d, f in prints.items()}


@pytest.mark.parametrize("text", ["", "a", "a b", "a b c", "Ä B\tc\nd a b c", "x " * 200_000])
def test_fingerprint_equals_the_plain_count(text):
    assert simhash.fingerprint_of(text.encode()) % (1 << 64) == plain_fingerprint(text)


@pytest.mark.parametrize("radius, segment_bits", [(0, 2), (1, 1), (2, 2), (3, 1), (3, 2), (5, 2), (7, 2)])
def test_links_are_all_pairs_in_the_radius(spark, radius, segment_bits):
    random.seed(radius)
    values = {random.getrandbits(64) for _ in range(60)}
    for v in list(values):
        for _ in range(6):
            w = v
            for bit in random.sample(range(64), random.randint(1, radius + 2)):
                w ^= 1 << bit
            values.add(w)
    values |= {0, (1 << 64) - 1, 1, 3}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "fingerprint long")
    got = {tuple(sorted((r.a % (1 << 64), r.b % (1 << 64)))) for r in simhash.links(df, radius, segment_bits).collect()}
    assert got == {(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= radius}


def test_near_duplicates_equal_brute_force(documents):
    random.seed(1)
    base = [" ".join(random.choice("alpha beta gamma delta eps zeta eta".split()) + str(random.randint(0, 9))
                     for _ in range(120)) for _ in range(12)]
    texts = {}
    for i in range(150):
        words = base[i % 12].split()
        for _ in range(random.randint(0, 3)):
            words[random.randrange(len(words))] = f"new{random.randint(0, 5)}"
        texts[1000 - i] = " ".join(words)
    prints = {d: plain_fingerprint(t) for d, t in texts.items()}
    got = simhash.near_duplicates(documents(list(texts.items()))).collect()
    assert {r.doc_id: int(r.fingerprint, 16) for r in got} == prints
    assert {r.doc_id: r.component_id for r in got} == plain_components(prints)


def test_odd_rows(odd, empty):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == 10
    named = {(r.doc_id, r.component_id) for r in got}
    assert {(1, 1), (2, 1), (4, 1), (3, 3), (5, 3), (7, 7), (8, 8), (None, None)} == named
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.keep_one(empty).count() == 0


def test_keep_one_leaves_one_row_of_each_group(odd):
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(((r.doc_id, r.text[:9] if r.text else r.text) for r in kept.collect()), key=repr) == sorted(
        [(1, None), (3, "one"), (None, "one two"), (7, "a b c d e"), (8, "é ü Word ")], key=repr)


def test_long_chains_have_one_root(spark):
    from fathomix.llm.common import components

    edges = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).filter("a <> 100")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {n: 0 if n <= 100 else 101 for n in range(301)}
