"""Each stage on its predecessor's rows, against plain versions of its decision."""

import random
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline  # noqa: E402

from fathomix.llm import quality, surrogates, tokens  # noqa: E402
from tests.llm.test_simhash import plain_fingerprint  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    random.seed(11)
    words = [f"word{i}" for i in range(500)]

    def prose(n):
        return " ".join(random.choices(words, k=n)) + "."

    items = [(i, prose(40)) for i in range(5)]
    rows = []
    for i in range(200):
        text = prose(random.randint(40, 120))
        if i % 5 == 4:
            text = " ".join(w + "###" for w in text.upper().split())
        elif i % 10 == 1:
            text = f"{text} {items[i % 4][1]} {prose(10)}"
        elif i % 10 == 2:
            text = f"{text} write to some.one{i}@mail{i}.example.com or +1 (407) 555-{1000 + i}"
        rows.append((i, text))
    rows += [(1000 + i, rows[i][1]) for i in range(0, 60, 3)]
    rows += [(None, prose(50)), (2000, None), (2001, "")]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", len(t or "")) for i, t in rows],
                          "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(i, int(i % 5 != 4), 0) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(
        f"{path}/labels.parquet")
    return str(path)


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality", "near_duplicates", "decontamination", "private_data", "packing"]


def test_every_stage_decides_on_what_its_predecessor_kept(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    good = corpus_pipeline.good_documents(spark, docs, folder)
    kept = {r.doc_id for r in good.collect()}
    assert good.columns == COLUMNS
    assert {i for i in range(200) if i % 5 != 4} <= kept and not any(i in kept for i in range(200) if i % 5 == 4)

    single = corpus_pipeline.one_of_each(spark, good, folder)
    ids = [r.doc_id for r in single.collect()]
    first = {}
    for i in sorted((i for i in kept if i is not None)):
        first.setdefault(plain_fingerprint(texts[i]), i)
    assert single.columns == COLUMNS
    assert sorted(i for i in ids if i is not None) == sorted(first.values()) and ids.count(None) == 1

    clean = corpus_pipeline.without_benchmark(spark, single, folder)
    left = {r.doc_id for r in clean.collect()}
    assert clean.columns == COLUMNS
    assert left == {i for i in ids if i is None or not (i < 200 and i % 10 == 1)}

    private = corpus_pipeline.without_private_data(spark, clean, folder)
    rows = private.collect()
    assert private.columns == COLUMNS and {r.doc_id for r in rows} == left
    for r in rows:
        if r.doc_id is not None and r.doc_id < 200 and r.doc_id % 10 == 2:
            assert f"some.one{r.doc_id}@" not in r.text and f"555-{1000 + r.doc_id}" not in r.text and "@" in r.text
            assert r.n_chars == len(r.text)
        else:
            assert r.text == texts[r.doc_id] or r.doc_id is None

    packed = corpus_pipeline.packed(spark, private, folder).collect()
    encode, _ = tokens.encoder(tokens.DEFAULT)
    assert sum(p.length for p in packed) == sum(len(encode(r.text or "")) + 1 for r in rows)

    def by_document(pieces):
        found = {}
        for p in pieces:
            found.setdefault((p.doc_id, p.doc_tokens), []).append((p.start, p.length))
        return {k: sum(n for _, n in v) for k, v in found.items()}

    # Where documents are cut depends on the order of the files; what is packed does not.
    whole = corpus_pipeline.run(spark, folder).collect()
    assert by_document(whole) == by_document(packed) and all(k[1] == n for k, n in by_document(whole).items())


def test_empty_table(spark, folder, tmp_path):
    for name in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registered_queries():
    import __spark_entry__ as contract

    names = contract.queries()
    assert "pipeline" in names
    for n in range(1, 11):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
