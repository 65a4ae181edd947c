import random

import numpy as np
import pytest

from fathomix.llm import decontaminate as dc


def vocabulary(n):
    return [f"w{i}" for i in range(n)]


@pytest.fixture(scope="module")
def bench():
    random.seed(2)
    return [(i, " ".join(random.choices(vocabulary(3000), k=random.randint(14, 70)))) for i in range(25)]


def items_of(spark, bench):
    return spark.createDataFrame(bench, "item_id long, text string")


def plain_matches(docs, bench, least=0.8):
    """Every stretch of every document against every item."""
    found = {}
    for d, t in docs:
        words = (t or "").encode().lower().split()
        for i, item in bench:
            own = (item or "").encode().lower().split()
            if not own:
                continue
            target = dc.shingles(own, 5)
            best = max((dc.similarity(dc.shingles(words[max(s, 0):s + len(own)], 5), target)
                        for s in range(-len(own) + 1, len(words))), default=0)
            if best >= least:
                found[d, i] = best
    return found


def test_contiguous_copies_are_all_found(spark, documents, bench):
    random.seed(3)
    docs = []
    for n in range(60):
        words = random.choices(vocabulary(3000), k=random.randint(0, 300))
        item = random.choice(bench)[1].split()
        shingles = len(item) - 4
        lost = random.randint(0, shingles // 9)
        cut = random.randint(0, lost)
        place = random.randint(0, len(words))
        if n % 3:
            words[place:place] = [w.upper() for w in item[cut:len(item) - (lost - cut)]]
        docs.append((n, " ".join(words)))
    got = {(r.doc_id, r.item_id): r.similarity for r in dc.matches(documents(docs), items_of(spark, bench)).collect()}
    expected = plain_matches(docs, bench)
    assert set(got) == set(expected), (set(got) ^ set(expected), [expected.get(k) for k in set(got) ^ set(expected)])
    assert len(got) >= 35


def test_one_changed_word_stays_within_the_radius(spark, documents, bench):
    random.seed(4)
    docs = []
    for n, (_, item) in enumerate([b for b in bench if len(b[1].split()) >= 50] * 4):
        words = item.split()
        words[random.randrange(len(words))] = "changed"
        docs.append((n, " ".join(random.choices(vocabulary(3000), k=50) + words)))
    got = {(r.doc_id, r.item_id) for r in dc.matches(documents(docs), items_of(spark, bench)).collect()}
    expected = set(plain_matches(docs, bench))
    assert got <= expected and len(got) >= 0.9 * len(expected)


@pytest.mark.parametrize("radius", [0, 3, 7])
def test_blocks_find_every_fingerprint_within_the_radius(radius):
    random.seed(radius)
    index = dc.build_index([(0, " ".join(random.choices(vocabulary(900), k=60)))], radius=radius)
    one = index.classes[0]
    own = one.prints.view("<u8").ravel()
    asked = []
    for value in own.tolist() * 20:
        for bit in random.sample(range(64), random.randint(0, radius + 2)):
            value ^= 1 << bit
        asked.append(value)
    prints = np.array(asked, "<u8").view("<u2").reshape(-1, 4)
    window, member = one.candidates(prints, radius)
    expected = {(w, m) for w, a in enumerate(asked) for m, b in enumerate(own.tolist()) if (a ^ b).bit_count() <= radius}
    assert set(zip(window.tolist(), member.tolist())) == expected


def test_chunks_and_item_blocks_do_not_matter(spark, documents, bench, monkeypatch):
    random.seed(6)
    docs = [(n, " ".join(random.choices(vocabulary(3000), k=400) + [bench[n % 25][1], "end"])) for n in range(10)]
    whole = {tuple(r) for r in dc.matches(documents(docs), items_of(spark, bench)).collect()}
    monkeypatch.setattr(dc, "CHUNK", 100)
    monkeypatch.setattr(dc, "BLOCK_ITEMS", 7)
    assert {tuple(r) for r in dc.matches(documents(docs), items_of(spark, bench)).collect()} == whole
    assert len(whole) == 10


def test_odd_rows(spark, odd, empty, documents):
    items = spark.createDataFrame([(5, "a b c d e"), (3, "A b c  d e"), (1, None), (2, " "), (9, "one")],
                                  "item_id long, text string")
    got = sorted(((r.doc_id, r.item_id, r.similarity, r.first_word) for r in dc.matches(odd, items).collect()), key=repr)
    assert got == [(3, 9, 1.0, 0), (5, 9, 1.0, 0), (7, 3, 1.0, 0), (7, 3, 1.0, 0), (None, 9, 1.0, 0), (None, 9, 1.0, 0)]
    assert dc.matches(odd, items.limit(0)).count() == 0
    assert dc.matches(empty, items).count() == 0
    kept = dc.clean(odd, items)
    assert kept.columns == odd.columns
    assert {r.doc_id for r in kept.collect()} >= {1, 2, 4, 8} and {r.doc_id for r in kept.collect()}.isdisjoint({3, 5, 7})


def test_the_text_before_does_not_change_a_copy_at_the_start_of_the_next():
    for seed in range(40):
        rng = random.Random(seed)
        item = [f"i{rng.randrange(10**6)}" for _ in range(60)]
        index = dc.build_index([(1, " ".join(item))], 5, 0.8, 7)
        before = " ".join(f"a{rng.randrange(10**6)}" for _ in range(80)).encode()
        copy = " ".join([*item[5:], *(f"b{rng.randrange(10**6)}" for _ in range(60))]).encode()
        alone = [hit[1:] for hit in dc.scan(index, [copy])]
        assert alone and alone == [hit[1:] for hit in dc.scan(index, [before, copy]) if hit[0] == 1]
