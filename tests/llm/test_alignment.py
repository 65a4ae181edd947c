import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from fathomix.llm import alignment as al
from fathomix.llm.queries import op13_tokenizer_alignment

PARTS = ["a", "b", " ", "  ", "\n", "é", "中文", "😀", "<|endoftext|>", "</s>", "<0x41>", "the", " tokenizer", "'s", "123", "ü"]


def byte_alphabet():
    """The characters that byte-level vocabularies write bytes as."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(rest)}}


@pytest.fixture(scope="module")
def plain_tokens():
    """Ids and bytes of a text's tokens, from the two libraries themselves."""
    one = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    one.encode_special_tokens = True
    alphabet = byte_alphabet()
    other = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))

    def tokens(text):
        if not text:
            return [], []
        a = [(i, bytes(alphabet[c] for c in one.id_to_token(i))) for i in one.encode(" " + text, add_special_tokens=False).ids]
        b = [(i, bytes([int(other.id_to_piece(i)[3:5], 16)]) if other.is_byte(i)
              else other.id_to_piece(i).replace("▁", " ").encode()) for i in other.encode(text)]
        whole = (" " + text).encode()
        if any(b"".join(t for _, t in side) != whole for side in (a, b)):
            return [], []
        return a, b

    return tokens


def spans(tokens):
    at, out = 0, []
    for i, piece in tokens:
        out.append((i, at, at + len(piece)))
        at += len(piece)
    return out


def plain(tokens, texts):
    """Figures and groups of each text, by comparing every token with every other."""
    held, counts = [], Counter()
    for text in texts:
        a, b = map(spans, tokens(text))
        links = [(x, y) for x, s, e in a for y, t, f in b if s < f and t < e]
        ends = sorted({e for *_, e in a} & {e for *_, e in b})
        groups = [([x for x, s, e in a if low < e <= high], [y for y, s, e in b if low < e <= high])
                  for low, high in zip([0, *ends], ends)]
        held.append((len(a), len(b), groups, links))
        counts.update(links)
    best = Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return [(n_a, n_b, len(groups), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links),
             sum(len(x) * len(y) for x, y in groups), groups) for n_a, n_b, groups, links in held]


def spelling(groups):
    return ";".join("|".join(",".join(map(str, ids)) for ids in g) for g in groups)


def rows(df, key="doc_id"):
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "n_group_links"]
    return sorted(((r[key], *(r[n] for n in names), [(g["a"], g["b"]) for g in r["groups"]]) for r in df.collect()), key=repr)


@pytest.mark.parametrize("block_bytes, part_bytes, part_links", [(40, 16, 3), (1 << 23, 1 << 20, 1 << 21)])
def test_equals_comparing_all_tokens(documents, plain_tokens, monkeypatch, block_bytes, part_bytes, part_links):
    monkeypatch.setattr(al, "PART_BYTES", part_bytes)
    monkeypatch.setattr(al, "PART_LINKS", part_links)
    draw = random.Random(part_bytes)
    texts = ["".join(draw.choices(PARTS, k=draw.randint(0, 20))) for _ in range(80)]
    odd = [(100, None), (101, ""), (102, " "), (103, "with ▁ mark"), (104, "x y"), (104, "x y"), (None, "no id"), (105, "\0\t"),
           (106, "word longerword " * 150)]
    given_rows = [*enumerate(texts), *odd]
    found = rows(al.aligned(documents(given_rows, "groups string"), block_bytes=block_bytes))
    expected = plain(plain_tokens, [t for _, t in given_rows])
    assert found == sorted(((i, *x) for (i, _), x in zip(given_rows, expected)), key=repr)
    spelt = al.aligned(documents(given_rows), spelt=True, block_bytes=block_bytes).collect()
    assert sorted(((r["doc_id"], r["groups"]) for r in spelt), key=repr) == sorted(
        ((i, spelling(x[-1])) for (i, _), x in zip(given_rows, expected)), key=repr)


def test_query_over_whole_texts(spark, plain_tokens):
    folder = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{folder}/documents.parquet").collect()
    short = [r for r in table if len(r["text"] or "") <= 1500]
    found = {r["doc_id"]: r for r in op13_tokenizer_alignment(spark, folder).collect()}
    assert len(found) == len(table)
    for r, (n_a, n_b, n_groups, n_links, *_, groups) in zip(short, plain(plain_tokens, [r["text"] for r in short])):
        digest = hashlib.sha256(spelling(groups).encode()).hexdigest() if groups else ""
        got = found[r["doc_id"]]
        assert (got["n_a"], got["n_b"], got["n_groups"], got["n_links"], got["groups_sha256"]) == (n_a, n_b, n_groups, n_links, digest)


def test_empty_tables_and_other_columns(spark, empty):
    assert rows(al.aligned(empty)) == []
    table = spark.createDataFrame([("k", {"a": 1}, None)], "key string, more map<string,int>, text string")
    assert al.aligned(table, keep=("key", "more")).drop("groups").collect()[0][:4] == ("k", {"a": 1}, 0, 0)


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 2**31), st.integers(0, 8), st.integers(1, 8), st.integers(1, 8))
def test_products_equal_dense_ones(seed, height, inner, width):
    draw = np.random.default_rng(seed)

    def random_csr(rows_, columns):
        dense = draw.integers(0, 3, (rows_, columns)) * draw.integers(0, 2, (rows_, columns))
        row, column = np.nonzero(dense)
        starts = np.concatenate([[0], np.bincount(row, minlength=rows_).cumsum()]).astype(np.int64)
        return dense, al.Csr(starts, column.astype(np.int32), dense[row, column].astype(np.int32), columns)

    def dense_of(m):
        out = np.zeros((m.height, m.width), np.int64)
        out[m.row_of(), m.columns] = m.values
        return out

    (x, a), (y, b) = random_csr(height, inner), random_csr(inner, width)
    assert np.array_equal(dense_of(a.times(b)), x @ y)
    assert np.array_equal(dense_of(b.transposed()), y.T)
    assert np.array_equal(dense_of(a.rows(height // 3, height)), x[height // 3:])


def test_overlaps_count_shared_bytes():
    linked = al.overlaps(np.array([3, 2, 1]), np.array([1, 4, 1]))
    assert (linked.row_of().tolist(), linked.columns.tolist(), linked.values.tolist()) == (
        [0, 0, 1, 2], [0, 1, 1, 2], [1, 2, 2, 1])
