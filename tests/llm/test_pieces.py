import hashlib
import random

import pytest

from fathomix.llm import blocks, pieces
from fathomix.llm.queries import op11_piece_ids

ODD_PARTS = ["a", "b", " ", "▁", "\n", "\t", "\0", "é", "中", "😀", "<0x0A>", "<s>", "</s>", "<unk>", "the", " ",
             "ﬁ", "​", "�", "́", "  ", " word"]


@pytest.fixture(scope="module")
def processor():
    return pieces.load(pieces.DEFAULT)


def test_chunks_alone_give_the_ids_of_the_text(processor):
    draw = random.Random(5)
    for _ in range(5000):
        text = "".join(draw.choices(ODD_PARTS, k=draw.randint(0, 12)))
        found = pieces.chunks(text)
        distinct = list(dict.fromkeys(found))
        ids = dict(zip(distinct, pieces.segment(processor, distinct)))
        assert [i for c in found for i in ids[c]] == processor.encode(text)
        assert "".join(found) == ("▁" + text.replace(" ", "▁") if text else "")


def expected(processor, text, end=True):
    ids = processor.encode(text or "", add_eos=end)
    return ids, processor.decode(ids)


def collected(df, key="doc_id"):
    return sorted(((r[key], r["ids"], r["decoded"]) for r in df.collect()), key=repr)


@pytest.mark.parametrize("block_chunks", [1, 7, 1 << 22])
def test_equals_the_library_on_odd_rows(spark, documents, processor, block_chunks):
    draw = random.Random(block_chunks)
    texts = ["".join(draw.choices(ODD_PARTS, k=draw.randint(0, 30))) for _ in range(60)]
    rows = [*enumerate(texts), (100, None), (101, ""), (102, " "), (103, "x"), (103, "x"), (None, "no id "), (None, None),
            (104, "long " * 5000 + "z" * 3000)]
    found = collected(pieces.encoded(documents(rows, "ids string"), block_chunks=block_chunks))
    assert found == sorted(((i, *expected(processor, t)) for i, t in rows), key=repr)


def test_without_end_id_and_with_other_columns(spark, processor):
    rows = spark.createDataFrame([("k1", {"a": 1}, "one two"), ("k2", None, None)], "key string, more map<string,int>, text string")
    found = pieces.encoded(rows, keep=("key", "more"), end=False).collect()
    assert sorted((r["key"], r["more"], r["ids"]) for r in found) == [
        ("k1", {"a": 1}, processor.encode("one two")), ("k2", None, [])]


def test_empty_table(empty):
    assert pieces.encoded(empty).collect() == []


def test_results_are_cut_into_batches(documents, processor, monkeypatch):
    monkeypatch.setattr(pieces, "BATCH_IDS", 5)
    rows = [(i, "some words here " * (i % 4)) for i in range(30)]
    assert collected(pieces.encoded(documents(rows))) == sorted(((i, *expected(processor, t)) for i, t in rows), key=repr)


def test_query_over_whole_texts(spark, processor):
    folder = "/root/testdata/sf0.001"
    found = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in op11_piece_ids(spark, folder).collect()}
    rows = spark.read.parquet(f"{folder}/documents.parquet").collect()
    assert len(found) == len(rows)
    for r in rows:
        ids, text = expected(processor, r["text"])
        digest = hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert found[r["doc_id"]] == (len(ids), digest, hashlib.sha256(text.encode()).hexdigest())


def test_no_table_is_left_in_the_catalog(spark, documents):
    pieces.encoded(documents([(1, "a b")])).collect()
    assert [t.name for t in spark.catalog.listTables() if t.name.startswith("intermediate_")] == []


def test_models_whose_pieces_cross_markers_are_refused():
    class Crossing:
        def get_piece_size(self):
            return 1

        def id_to_piece(self, i):
            return "a▁b"

    with pytest.raises(ValueError, match="crosses"):
        pieces.require_separate_chunks(Crossing())


def test_packed_numbers_and_texts_return():
    import numpy as np

    for values in ([], [0], [5, 0, 255, 256, 1 << 40]):
        assert blocks.unpack(blocks.pack(np.array(values, np.int64))).tolist() == values
    assert blocks.unpack_texts(blocks.pack_texts([b"", b"a", "é".encode()])) == [b"", b"a", "é".encode()]
