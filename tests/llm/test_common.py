from pyspark.sql import functions as F

from fathomix.llm import simhash
from fathomix.llm.common import as_given, hashes_of, with_row_keys


def test_rows_are_named_whatever_their_columns(spark):
    rows = spark.createDataFrame([(1, "a b c", 5), (1, "a b c", 5), (2, "d e f g", 6)], "doc_id long, text string, _ROW_KEY_A int")
    rows = rows.withColumns({"_row_key_a_given": F.lit("x"), "nested": F.struct(F.create_map(F.lit("k"), "doc_id").alias("m"))})
    keyed = with_row_keys(rows)
    assert keyed.select("_row_key_a", "_row_key_b").distinct().count() == 2
    back = as_given(keyed, rows)
    assert back.schema == rows.schema and sorted(map(str, back.collect())) == sorted(map(str, rows.collect()))
    kept = simhash.keep_one(rows)
    assert kept.columns == rows.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2]


def test_maps_tell_rows_apart(spark):
    rows = spark.createDataFrame([(1, {"a": 1}), (1, {"a": 2}), (1, None)], "doc_id long, m map<string,int>")
    assert with_row_keys(rows).select("_row_key_a", "_row_key_b").distinct().count() == 3


def test_hashes_of_words():
    import xxhash

    parts = [b"", b"a", "é".encode()]
    assert hashes_of(parts, 7).tolist() == [xxhash.xxh64_intdigest(p, 7) for p in parts]
