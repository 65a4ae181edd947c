import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from fathomix.llm import packing, tokens


def plain_ids(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path(tokens.DEFAULT))
    plain.encode_special_tokens = True
    return plain.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=60))
def test_ids_equal_the_tokenizer_file(text):
    encode, width = tokens.encoder(tokens.DEFAULT)
    assert width == "<u2" and encode(text).tolist() == plain_ids(text)


@pytest.mark.parametrize("text", ["<|endoftext|> a", "  \n\n  x", "é" * 3000, " " * 5000, "'s don't 12345 ### 　x"])
def test_special_texts_are_ordinary(text):
    encode, _ = tokens.encoder(tokens.DEFAULT)
    assert encode(text).tolist() == plain_ids(text)


def check_round_trip(rows, pieces, length):
    """All ids of all rows, each once, in gapless sequences of at most ``length``."""
    expected = sorted(tuple([*plain_ids(t), 1]) for _, t in rows)
    sequences, documents = {}, {}
    for p in pieces:
        ids = np.frombuffer(p.ids, "<u4")
        assert len(ids) == p.length > 0
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
        documents.setdefault((p.doc_id, p.doc_tokens), []).append((p.start, tuple(ids.tolist())))
    for parts in sequences.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= length
    assert sorted(sequences) == list(range(len(sequences)))
    short = sum(sum(size for _, size in parts) < length for parts in sequences.values())
    assert short <= 1
    return documents, expected


@pytest.mark.parametrize("length, window", [(16, 2), (64, 4), (2048, 32)])
def test_every_id_is_packed_once(documents, length, window):
    random.seed(length)
    rows = [(i, " ".join(random.choices("the of Anna 12 tokenizers é".split(), k=random.randint(0, 80)))) for i in range(150)]
    pieces = packing.pack(documents(rows).repartition(5), tokens.DEFAULT, length, window).collect()
    found, expected = check_round_trip(rows, pieces, length)
    whole = sorted(tuple(x for _, part in sorted(parts) for x in part) for parts in found.values())
    assert whole == expected


def shares_by_window(pieces, length, window):
    counts = {}
    for p in pieces:
        counts.setdefault(p.sequence_id // window, {}).setdefault(p.source_queue, 0)
        counts[p.sequence_id // window][p.source_queue] += p.length
    return counts


def test_every_window_holds_the_target_shares(documents):
    random.seed(9)
    rows = [(i, "word " * random.randint(1, 200)) for i in range(400)]
    pieces = packing.pack(documents(rows).repartition(7), tokens.DEFAULT, 32, 8).collect()
    total = {}
    for p in pieces:
        total[p.source_queue] = total.get(p.source_queue, 0) + p.length
    tokens_all = sum(total.values())
    windows = shares_by_window(pieces, 32, 8)
    for number, found in windows.items():
        if number < max(windows):
            for queue, n in total.items():
                # Boundaries of sequences and windows differ by less than one token per queue.
                assert abs(found.get(queue, 0) - 256 * n / tokens_all) <= 2 * len(total)


def test_a_mixture_holds_until_its_scarcest_source_is_dry(documents):
    rows = [(i, "word " * 49) for i in range(1, 301) if i != 7]
    pieces = packing.pack(documents(rows), tokens.DEFAULT, 50, 4, mixture={"s0": 2, "s1": 1, "s2": 1}).collect()
    windows = shares_by_window(pieces, 50, 4)
    for number in range(20):
        assert abs(windows[number]["=s0"] - 100) <= 6 and abs(windows[number]["=s1"] - 50) <= 6
    found, expected = check_round_trip(rows, pieces, 50)
    assert sum(len(p) for parts in found.values() for _, p in parts) == sum(map(len, expected))
    with pytest.raises(ValueError, match="every source"):
        packing.pack(documents(rows), tokens.DEFAULT, mixture={"s0": 1})


def test_many_sources_share_queues(documents, monkeypatch):
    rows = [(i, f"text {i}") for i in range(20)]
    monkeypatch.setattr(packing, "MAX_QUEUES", 2)
    found, expected = check_round_trip(rows, packing.pack(documents(rows), tokens.DEFAULT, 16, 2).collect(), 16)
    assert len(found) == 20


def test_odd_rows(odd, empty):
    from tests.llm.conftest import ODD

    pieces = packing.pack(odd, tokens.DEFAULT, 64, 2).collect()
    found, expected = check_round_trip(ODD, pieces, 64)
    assert sum(p.length for p in pieces) == sum(map(len, expected))
    assert {(k[0], k[1]) for k in found} == {(d, len(plain_ids(t)) + 1) for d, t in ODD}
    assert packing.pack(empty, tokens.DEFAULT).count() == 0
