import random

import numpy as np

import pytest

from fathomix.llm import paragraphs


def passage(rng, n, stem="p"):
    return " ".join(f"{stem}{rng.randrange(10**6)}" for _ in range(n))


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(3)
    rows = {i: "\n".join(passage(rng, rng.randint(3, 60), f"d{i}x") for _ in range(6)) for i in range(80)}
    inside = passage(rng, 55, "inner")
    line = passage(rng, 60, "line")
    for i in range(0, 30, 3):
        words = rows[i].split(" ")
        at = rng.randrange(len(words))
        rows[i] = " ".join([*words[:at], inside.upper() if i % 2 else inside, *words[at:]])
    for i in range(40, 48):
        own = line.split()
        own[i - 20] = f"edit{i}"
        rows[i] += "\n" + " ".join(own)
    return rows


def test_passages_and_near_paragraphs_are_found(documents, planted):
    got = paragraphs.repeated_spans(documents(list(planted.items())).repartition(4)).collect()
    by_doc = {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
    assert set(by_doc) == set(range(0, 30, 3)) | set(range(40, 48))
    assert {(d, r.removed, r.class_id) for d, rows in by_doc.items() for r in rows} == {
        (d, d != 0, 0) for d in range(0, 30, 3)} | {(d, d != 40, 40) for d in range(40, 48)}
    for d, rows in by_doc.items():
        words = planted[d].lower().split()
        for r in rows:
            held = words[r.first_word:r.first_word + r.n_words]
            assert len(held) == r.n_words >= paragraphs.MIN_WORDS
            assert all(w.startswith(("inner", "line", "edit")) for w in held)


def test_paragraph_components_equal_brute_force(documents):
    rng = random.Random(5)
    base = [passage(rng, 80, f"b{k}x").split() for k in range(4)]
    rows = []
    for i in range(60):
        words = list(base[i % 4])
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(80)] = f"e{rng.randrange(3)}"
        rows.append((i, " ".join(words)))
    sets = [paragraphs.shingle_set(t.encode()) for _, t in rows]
    edges = {(i, j) for i in range(60) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    root = list(range(60))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in edges:
        root[max(find(i), find(j))] = min(find(i), find(j))
    whole = {r.doc_id: r.class_id for r in paragraphs.repeated_spans(documents(rows)).collect() if r.removed and r.n_words == 80}
    # Pieces may join components further, so the class can only be an earlier copy of the same base.
    for i in range(60):
        if find(i) != i:
            assert whole[i] <= find(i) and whole[i] % 4 == i % 4


def test_large_buckets_are_joined_without_all_pairs(spark):
    rng = random.Random(6)
    rows = [(i, 60, [7, 1000 + rng.randrange(40), i, i, i]) for i in range(500)]
    pairs = paragraphs.colliding(spark.createDataFrame(rows, "hash long, words int, bands array<long>")).collect()
    assert len(pairs) <= 500 * 2 * (paragraphs.NEIGHBOURS + 1)
    from fathomix.llm.common import components

    joined = components(spark.createDataFrame([(r.a, r.b) for r in pairs], "a long, b long"))
    assert joined.select("root").distinct().count() == 1 and joined.count() == 500


def test_hot_buckets_are_cut_by_the_next_band(spark, monkeypatch):
    monkeypatch.setattr(paragraphs, "BUCKET_ROWS", 50)
    rows = [(i, 60, [7, 1000 + i % 8, 10**6 + i, 2 * 10**6 + i, 3 * 10**6 + i]) for i in range(400)]
    pairs = paragraphs.colliding(spark.createDataFrame(rows, "hash long, words int, bands array<long>")).collect()
    assert pairs and all(r.a % 8 == r.b % 8 for r in pairs if r.b - r.a > 8)
    linked = {r.a for r in pairs} | {r.b for r in pairs}
    assert linked == set(range(400))


def test_the_layout_does_not_change_the_pairs(spark):
    rng = random.Random(8)
    rows = [(i, 60, [rng.randrange(5), rng.randrange(20), i, -i, i]) for i in range(800)]
    frame = spark.createDataFrame(rows, "hash long, words int, bands array<long>")
    found = [{(r.a, r.b) for r in paragraphs.colliding(frame.repartition(n)).collect()} for n in (1, 7)]
    assert found[0] == found[1]


def test_small_buckets_are_compared_in_full(spark):
    rows = [(i, 60, [3, i, -i - 1, 100 + i, 200 + i]) for i in range(paragraphs.NEIGHBOURS + 1)]
    pairs = paragraphs.colliding(spark.createDataFrame(rows, "hash long, words int, bands array<long>")).collect()
    assert {(r.a, r.b) for r in pairs} == {(i, j) for i in range(5) for j in range(i + 1, 5)}


def test_odd_rows(odd, empty, documents):
    spans = paragraphs.repeated_spans(odd).collect()
    assert spans == []
    assert paragraphs.repeated_spans(empty).count() == 0
    long = "\n".join(" ".join(f"w{i}x{j}" for j in range(40)) for i in range(3))
    rows = documents([(None, long), (None, long), (4, long), (4, long), (5, None)], extra="row string")
    got = {(r.doc_id, r.removed, r.class_id, r.n_words) for r in paragraphs.repeated_spans(rows).collect()}
    assert got == {(4, False, 4, 120), (4, True, 4, 120), (None, True, 4, 120)}


def test_repeats_within_one_row_are_left_alone(documents):
    line = " ".join(f"w{j}" for j in range(40))
    assert paragraphs.repeated_spans(documents([(1, f"{line}\n{line}"), (2, "other words")])).count() == 0


def crowd(rng, n=3000, true=60, common=40, words=84):
    """Lines that share their first 40 words; ``true`` pairs of them are at 0.8 or more."""
    head = passage(rng, common, "head").split()
    rows, pairs = [], []
    for i in range(n):
        own = [f"o{i}x{j}" for j in range(words - common)]
        if 2 * i < 2 * true:
            edited = list(own)
            edited[rng.randrange(5, len(own) - 5)] = f"edit{i}"
            pairs.append((len(rows), len(rows) + 1))
            rows += [" ".join(head + own), " ".join(head + edited)]
        else:
            rows.append(" ".join(head + own))
    return rows, pairs


def test_true_pairs_among_thousands_of_others_in_a_bucket_are_all_linked(spark, documents):
    rng = random.Random(12)
    rows, pairs = crowd(rng)
    # Every line shares its first band, so all are in one bucket; the other bands tell nothing.
    frame = spark.createDataFrame(
        [(r.hash, r.words, [7, r.hash, r.hash + 1, r.hash + 2, r.hash + 3], r.text)
         for r in paragraphs.units(documents(list(enumerate(rows)))).filter("size(bands) > 0").collect()],
        "hash long, words int, bands array<long>, text long")
    docs = documents(list(enumerate(rows)))
    roots = {r.node: r.root for r in paragraphs.linked_paragraphs(frame, docs, 0.8).collect()}
    neighbours = {(r.a, r.b) for r in paragraphs.colliding(frame).collect()}
    names = {r.doc_id: r.hash for r in paragraphs.units(docs).filter("size(bands) > 0").collect()}
    sets = [paragraphs.shingle_set(t.encode()) for t in rows]
    assert all(len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for i, j in pairs)
    met = [names[i] in roots and roots[names[i]] == roots.get(names[j]) for i, j in pairs]
    assert sum(met) == len(pairs) == 60 and len(roots) == 120
    assert sum(tuple(sorted((names[i], names[j]))) in neighbours for i, j in pairs) < 60


def test_parts_of_a_cut_bucket_still_meet(spark, documents, monkeypatch):
    monkeypatch.setattr(paragraphs, "BUCKET_ROWS", 50)
    rows, pairs = crowd(random.Random(13), n=300, true=40)
    docs = documents(list(enumerate(rows)))
    found = paragraphs.units(docs).filter("size(bands) > 0").select("doc_id", "hash", "words", "text").collect()
    # The two of a pair differ in their next band's part.
    frame = spark.createDataFrame(
        [(r.hash, r.words, [7, 1000 + r.doc_id % 2, 10**6 + r.doc_id, 2 * 10**6 + r.doc_id, 3 * 10**6 + r.doc_id], r.text)
         for r in found],
        "hash long, words int, bands array<long>, text long")
    names = {r.doc_id: r.hash for r in found}
    roots = {r.node: r.root for r in paragraphs.linked_paragraphs(frame, docs, 0.8).collect()}
    assert all(names[i] in roots and roots[names[i]] == roots.get(names[j]) for i, j in pairs) and len(pairs) == 40


@pytest.mark.parametrize("leaders", [True, False])
def test_every_two_rows_of_a_long_posting_meet(spark, monkeypatch, leaders):
    monkeypatch.setattr(paragraphs, "BUCKET_ROWS", 50)
    postings = spark.createDataFrame([(7, i, 80, 0, 0, 0, 0, 0) for i in range(220)],
                                     "key long, hash long, size int, at int, s0 long, s1 long, s2 long, s3 long")
    none = spark.createDataFrame([], "node long, root long")
    got = {(r.a, r.b) for r in paragraphs.crossing(postings, none, 0.8, leaders).collect()}
    assert got == {(i, j) for i in range(220) for j in range(i + 1, 220)}
    one = spark.createDataFrame([(i, 0) for i in range(220)], "node long, root long")
    assert paragraphs.crossing(postings, one, 0.8, leaders).isEmpty()


def test_a_line_and_the_same_line_twice_are_linked(documents):
    rng = random.Random(14)
    line = passage(rng, 30)
    one, other = line, f"{line} {line}"
    sets = [paragraphs.shingle_set(t.encode()) for t in (one, other)]
    assert len(sets[0] & sets[1]) >= 0.8 * len(sets[0] | sets[1])
    docs = documents([(1, one), (2, other)])
    got = {(r.doc_id, r.first_word, r.n_words, r.class_id, r.removed) for r in paragraphs.repeated_spans(docs).collect()}
    # Without the paragraphs' link, equal pieces mark less than the whole lines.
    assert got == {(1, 0, 30, 1, False), (2, 0, 60, 1, True)}


def test_text_ids_are_kept(spark):
    line = passage(random.Random(15), 40)
    docs = spark.createDataFrame([("b", line), ("a", line), (None, line), ("c", "short")], "doc_id string, text string")
    got = {(r.doc_id, r.n_words, r.class_id, r.removed) for r in paragraphs.repeated_spans(docs).collect()}
    assert got == {("a", 40, "a", False), ("b", 40, "a", True), (None, 40, "a", True)}


def test_sketches_differ_in_no_more_bits_than_the_sets():
    draw = np.random.default_rng(4)
    for _ in range(300):
        common = draw.integers(0, 2**62, draw.integers(0, 80))
        one, other = (np.unique(np.concatenate([common, draw.integers(0, 2**62, draw.integers(0, 30))])) for _ in "ab")
        bits = int(np.bitwise_count((paragraphs.sketch(one) ^ paragraphs.sketch(other)).view(np.uint64)).sum())
        assert bits <= len(np.setxor1d(one, other))
