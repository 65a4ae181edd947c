import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from fathomix.llm import collocations as c


def plain(rows, min_count, top, longest=4, percent=80):
    """The phrases of ``(lang, text)`` rows, one text after the other."""
    counts, totals = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")
        for piece in re.split("[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for n in range(1, longest + 1):
                for i in range(len(words) - n + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i:i + n])] += 1
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= min_count}
        kept = []
        for p, a in candidates.items():
            if any(100 * b >= percent * a and len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q)))
                   for q, b in candidates.items()):
                continue
            score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, totals[lang], -score))
    return sorted(out)


def mined(df, **settings):
    return sorted(tuple(r) for r in c.mined(df, **settings).collect())


def corpus(seed, n=60):
    draw = random.Random(seed)
    vocab = ["a", "b", "New", "york", "é", "Ünder", "of", "the", "zz", " "]
    texts = []
    for _ in range(n):
        words = draw.choices(vocab, weights=range(1, 11), k=draw.randint(0, 40))
        texts.append("".join(w + draw.choice([" ", " ", " ", "  ", "\t", ", ", ".\n", "\r\n", "!"]) for w in words))
    return texts


@pytest.mark.parametrize("block_words", [20, 1 << 21])
def test_equals_plain_counting(spark, block_words):
    rows = [(draw, t) for draw, t in zip(["en", "fr", None, "und", "a b"] * 20, corpus(block_words))]
    rows += [("en", None), (None, ""), ("en", "New york New york " * 300), ("en", "New york New york " * 300)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "lang string, text string, rank int, phrase string")
    for settings_ in ({"min_count": 3, "top": 2000}, {"min_count": 8, "top": 5}):
        assert mined(df, block_words=block_words, **settings_) == plain(rows, **settings_)


@pytest.mark.parametrize("top", [1, 3, 7])
def test_few_best_of_many(spark, top):
    rows = [("en", t) for t in corpus(9, 150)] + [("fr", t) for t in corpus(10, 40)]
    df = spark.createDataFrame(rows, "lang string, text string")
    assert mined(df, min_count=3, top=top) == plain(rows, 3, top)


def test_ties_go_by_count_and_bytes(spark):
    rows = [("en", "z é. z e. b c d. " * 4 + "y y. " * 2)]
    df = spark.createDataFrame(rows, "lang string, text string")
    assert mined(df, min_count=2) == plain(rows, 2, 2000)


def test_no_rows(spark, empty, documents):
    assert mined(empty) == []
    assert mined(documents([(1, "one two"), (2, None)])) == []
    with pytest.raises(ValueError):
        c.mined(empty, longest=5)


def test_whole_numbers_beyond_64_bits(spark):
    huge = 4_000_000_000_000_000_000
    grams = spark.createDataFrame([([1], huge), ([2], huge), ([1, 2], huge - 7)], "ids array<long>, f long")
    row = c.best_cuts(grams.filter("size(ids) = 2"), grams, 2_000_000).first()
    assert row["score"] == 2_000_000 * (huge - 7) // (2 * huge)


@settings(max_examples=150, deadline=None)
@given(st.data())
def test_packing_and_permuting_can_be_undone(data):
    bits, length = data.draw(st.integers(1, 32)), data.draw(st.integers(2, 4))
    phrases = data.draw(st.lists(st.lists(st.integers(0, 2**bits - 1), min_size=length, max_size=length), min_size=1, max_size=20))
    ids = [np.array(x, np.int64) for x in zip(*phrases)]
    width = c.half_bits(length, bits)
    halves = c.packed(ids, bits)
    spread = c.permuted(*halves, width)
    assert all(int(h.max()) < 2**width for h in (*halves, *spread))
    assert len(set(zip(*map(np.ndarray.tolist, spread)))) == len({tuple(p) for p in phrases})
    assert np.array_equal(np.stack(c.unpacked(*c.restored(*spread, width), length, bits), axis=1), np.array(phrases))


@settings(max_examples=150, deadline=None)
@given(st.data())
def test_filters_lose_nothing(data):
    width = data.draw(st.integers(1, 64))
    number = st.integers(0, 2**width - 1)
    sets = data.draw(st.lists(st.lists(st.tuples(number, number), min_size=1, max_size=40), min_size=1, max_size=4))
    shard_bits = data.draw(st.integers(0, min(3, width)))
    by_shard = {}
    for fingerprints in sets:
        high, low = (np.array(x, np.uint64) for x in zip(*fingerprints))
        for shard, part in c.QuotientFilter.of(high, low, None, width).shards(shard_bits):
            by_shard.setdefault(shard, []).append(c.QuotientFilter.from_bytes(part.to_bytes(), shard))
    found = {}
    for parts in by_shard.values():
        every = c.QuotientFilter.merged(parts)
        keys = list(zip(every.high.tolist(), every.low.tolist()))
        assert keys == sorted(set(keys))
        found.update(zip(keys, every.counts.tolist()))
    assert found == Counter(x for s in sets for x in s)
