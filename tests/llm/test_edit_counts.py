import random

import pytest
from pyspark.sql import functions as F

from fathomix.llm import edit_counts, tokens

encode, _ = tokens.encoder(tokens.DEFAULT)
ALPHABET = ["a", "the", " ", "  ", "\n", "é", "Ünter ", "'s", " 12", "3.", "!!", " ... ", "word ", "я", "\t "]


def count(text):
    return len(encode(text))


def edited(text, edits):
    parts, at = [], 0
    for start, end, new in sorted(edits):
        parts += [text[at:start], new]
        at = end
    return "".join([*parts, text[at:]])


@pytest.mark.parametrize("leaf", [1, 3, 8, 30, 400])
def test_counts_equal_encoding_the_whole_text(leaf, monkeypatch):
    monkeypatch.setattr(edit_counts, "LEAF_CHARS", leaf)
    random.seed(leaf)
    for _ in range(400):
        text = "".join(random.choices(ALPHABET, k=random.randint(0, 120)))
        places = sorted(random.sample(range(len(text) + 1), min(len(text) + 1, 2 * random.randint(0, 4)) // 2 * 2))
        edits = [(a, random.choice([a, b]), "".join(random.choices(ALPHABET, k=random.randint(0, 3))))
                 for a, b in zip(places[::2], places[1::2])]
        tree = edit_counts.build(text, count)
        assert tree.tokens[1] == count(text)
        after, new, _ = edit_counts.edit(tree, text, edits, count)
        assert new == edited(text, edits)
        assert (after.tokens[1], after.chars[1]) == (count(new), len(new))
        half = after.slots
        assert all(after.tokens[n] == after.tokens[2 * n] + after.tokens[2 * n + 1] for n in range(1, half))


def test_only_the_region_is_encoded():
    text = "some words of a longer text " * 2000
    tree = edit_counts.build(text, count)
    asked = []
    edit_counts.edit(tree, text, [(30_000, 30_004, "x"), (50_000, 50_000, " y ")], lambda t: asked.append(len(t)) or count(t))
    assert len(asked) == 2 and sum(asked) < 8 * edit_counts.LEAF_CHARS


def test_edits_must_not_overlap():
    tree = edit_counts.build("abc def", count)
    for bad in ([(0, 3, ""), (2, 4, "")], [(5, 9, "")], [(4, 2, "")]):
        with pytest.raises(ValueError, match="edits"):
            edit_counts.edit(tree, "abc def", bad, count)


def test_odd_rows(odd, empty):
    kind = "array<struct<start:int,end:int,replacement:string>>"
    edits = F.when(F.col("doc_id") == 2, F.from_json(F.lit('[{"start":0,"end":0,"replacement":"new text"}]'), kind)).when(
        F.col("doc_id") == 8, F.from_json(F.lit('[{"start":5,"end":9,"replacement":null},{"start":40000,"end":40003,"replacement":"z"}]'), kind))
    counted = edit_counts.with_trees(odd.withColumn("leaf_chars", F.lit("clash")), tokens.DEFAULT)
    rows = edit_counts.apply_edits(counted.withColumn("edits", edits), tokens.DEFAULT, "edits", keep=("doc_id", "text", "hash")).collect()
    assert len(rows) == 10
    for r in rows:
        text = r.text or ""
        after = {2: "new text", 8: edited(text, [(5, 9, ""), (40000, 40003, "z")])}.get(r.doc_id, text)
        assert (r.n_tokens, r.n_tokens_after, r.chars_after) == (count(text), count(after), len(after))
    assert edit_counts.with_trees(empty, tokens.DEFAULT).count() == 0


def test_house_edits_of_the_query(documents):
    from fathomix.llm.queries import house_edits

    rows = [(1, "a line that is long enough\nb 4466 8659 7353\na line that is long enough\nend"), (2, None), (3, "x")]
    counted = edit_counts.with_trees(documents(rows), tokens.DEFAULT)
    got = {r.doc_id: r for r in edit_counts.apply_edits(counted, tokens.DEFAULT, house_edits).collect()}
    assert got[1].n_tokens_after == count("a line that is long enough\nb <number>\nend") and got[1].n_edits == 2
    assert (got[2].n_tokens, got[2].n_tokens_after, got[3].n_edits) == (0, 0, 0)


def test_stored_trees_take_a_second_round_of_edits(spark, documents):
    kind = "array<struct<start:int,end:int,replacement:string>>"
    rows = [(i, "some words of a text, number %d " % i * (40 * i)) for i in range(1, 6)]
    texts = dict(rows)
    stored = edit_counts.with_trees(documents(rows), tokens.DEFAULT)
    for turn in range(3):
        asked = {i: [(7 * turn, 7 * turn + 3, "ab cd"), (len(t) // 2, min(len(t), len(t) // 2 + 400), "")] for i, t in texts.items()}
        edits = spark.createDataFrame([(i, e) for i, e in asked.items()], f"doc_id long, edits {kind}")
        stored = edit_counts.apply_edits(stored.join(edits, "doc_id"), tokens.DEFAULT, trees=True)
        texts = {i: edited(t, asked[i]) for i, t in texts.items()}
        got = {r["doc_id"]: r for r in stored.collect()}
        assert {i: r["text"] for i, r in got.items()} == texts
        for i, r in got.items():
            assert r["error"] is None and r["n_tokens"] == count(texts[i]) == sum(r["leaf_tokens"])
            assert sum(r["leaf_chars"]) == len(texts[i])


def test_edits_that_cannot_be_applied_are_named(spark, documents):
    kind = "array<struct<start:int,end:int,replacement:string>>"
    given = {1: [(0, 99, "x")], 2: [(None, 2, "x")], 3: [(0, 2, "x"), (1, 3, "y")], 4: [(0, 1, "z"), None], 5: None}
    edits = spark.createDataFrame(list(given.items()), f"doc_id long, edits {kind}")
    counted = edit_counts.with_trees(documents([(i, "a few words") for i in given]), tokens.DEFAULT).join(edits, "doc_id")
    got = {r["doc_id"]: r for r in edit_counts.apply_edits(counted, tokens.DEFAULT).collect()}
    for i in (1, 2, 3):
        assert got[i]["error"] and got[i]["n_tokens_after"] == got[i]["n_tokens"] == 3 and got[i]["n_edits"] == 0
    assert got[4]["error"] is None and got[4]["n_edits"] == 1 and got[5]["error"] is None
