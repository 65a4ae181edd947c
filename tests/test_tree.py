import pytest

from fathomix.operators import tree
from fathomix.sources.tables import CATALOG_SCHEMA, EDGE_SCHEMA, LEAF_SCHEMA


def build(spark, catalogs, edges, leaves):
    return (
        spark.createDataFrame([(c, c) for c in catalogs], CATALOG_SCHEMA),
        spark.createDataFrame([(*e, i) for i, e in enumerate(edges)], EDGE_SCHEMA),
        spark.createDataFrame([(c, n, {"OpenDAP": n}, i) for i, (c, n) in enumerate(leaves)], LEAF_SCHEMA),
    )


@pytest.fixture
def small(spark):
    return build(
        spark, ["root", "A", "B"], [("root", "a", "A"), ("root", "b", "B"), ("root", "broken", "GONE")],
        [("A", "a1.nc"), ("A", "a2.nc"), ("B", "b1.nc")],
    )


def test_index_lists_leaves_with_their_path(small, rows_of):
    index = tree.catalog_index(*small, "root")
    assert rows_of(index, "name", "path") == [("a1.nc", ["a"]), ("a2.nc", ["a"]), ("b1.nc", ["b"])]


def test_broken_references_are_skipped_and_counted(small):
    catalogs, edges, _ = small
    assert tree.broken_references(tree.walk_catalogs(catalogs, edges, "root")).first()["skipped"] == 1


def test_leaves_of_the_root_and_of_shared_catalogs(spark, rows_of):
    tables = build(
        spark, ["root", "A", "B", "S"], [("root", "a", "A"), ("root", "b", "B"), ("A", "s", "S"), ("B", "s", "S")],
        [("root", "top.nc"), ("S", "x.nc")],
    )
    index = tree.search_leaves(tree.catalog_index(*tables, "root"), "")
    assert rows_of(index, "name", "path_text") == [("top.nc", "(root)"), ("x.nc", "a > s"), ("x.nc", "b > s")]


def test_cycles_stop_at_the_depth_limit(spark):
    tables = build(spark, ["root"], [("root", "again", "root")], [("root", "x.nc")])
    index = tree.catalog_index(*tables, "root")
    assert sorted(r["depth"] for r in index.collect()) == list(range(9))
    assert tree.catalog_index(*tables, "root", max_depth=0).count() == 1


def test_name_search(small, rows_of):
    index = tree.catalog_index(*small, "root")
    assert rows_of(tree.search_leaves(index, "A1.NC"), "name") == [("a1.nc",)]
    assert tree.search_leaves(index, "a_.nc").count() == 0
    found = tree.find_datasets(index, ".nc", limit=2)
    assert rows_of(found, "name", "total", "more") == [("a1.nc", 3, 1), ("a2.nc", 3, 1)]


def test_browse_and_levels(small, rows_of):
    catalogs, edges, leaves = small
    assert rows_of(tree.browse(edges, leaves, "root"), "kind", "name") == [("sub_catalog", "a"), ("sub_catalog", "b"), ("sub_catalog", "broken")]
    assert rows_of(tree.browse(edges, leaves, "A"), "kind", "name") == [("dataset", "a1.nc"), ("dataset", "a2.nc")]
    levels = tree.level_summary(catalogs, edges, leaves)
    assert rows_of(levels, "catalog_url", "n_sub_catalogs", "n_datasets", "n_services") == [("A", 0, 2, 1), ("B", 0, 1, 1), ("root", 3, 0, 0)]


def test_descend(spark, rows_of):
    catalogs, edges, _ = build(
        spark, ["root", "x", "y", "z"],
        [("root", "North-1", "c1"), ("root", "North-2", "c2"), ("x", "Deployments", "c3"), ("y", "North", "c4"), ("y", "North-1", "c5"), ("y", "north", "c6")], [("x", "l")],
    )
    got = rows_of(tree.descend(catalogs, edges, "North"), "parent_url", "status", "chosen", "n_matches")
    assert got == [("root", "ambiguous", None, 2), ("x", "not_found", None, 0), ("y", "ok", "North", 3), ("z", "not_found", None, 0)]
    assert ("x", "ok", "Deployments") in rows_of(tree.descend(catalogs, edges, "deploy"), "parent_url", "status", "chosen")
    assert tree.candidates(edges.filter("parent_url = 'root'"), "ref_name", "north").count() == 2


def test_resolve_leaf(small, rows_of):
    catalogs, _, leaves = small
    decided = lambda query=None: rows_of(tree.resolve_leaf(catalogs, leaves, query), "catalog_url", "status", "chosen")
    assert decided() == [("A", "ambiguous", None), ("B", "ok", "b1.nc"), ("root", "no_datasets", None)]
    assert decided("a2.nc") == [("A", "ok", "a2.nc"), ("B", "not_found", None), ("root", "no_datasets", None)]
    assert decided("A1")[0] == ("A", "ok", "a1.nc")


def test_addresses(spark, rows_of):
    leaves = spark.createDataFrame(
        [("c", "both", {"HTTPServer": "h", "OpenDAP": "o"}, 0), ("c", "dap", {"OpenDAP": "o"}, 1), ("c", "wms", {"WMS": "w"}, 2)], LEAF_SCHEMA)
    assert rows_of(tree.download_address(leaves), "name", "service", "url") == [("both", "HTTPServer", "h"), ("dap", "OpenDAP", "o"), ("wms", None, None)]
    errors = {r["name"]: r["error"] for r in tree.download_address(leaves).collect()}
    assert errors["both"] is None and "WMS" in errors["wms"]
    missing = {r["name"]: r["error"] for r in tree.require_service(leaves, "HTTPServer").collect()}
    assert missing["both"] is None and "OpenDAP" in missing["dap"]


@pytest.mark.parametrize("max_depth", [1, 3, 8, 64])
def test_doubling_equals_walking(spark, rows_of, max_depth):
    chain = [(f"c{i}", f"r{i}", f"c{i + 1}", 0) for i in range(70)]
    loop = [("c3", "back", "c1", 1), ("c2", "gone", "nowhere", 2), ("c2", "twice", "c3", 3), ("lone", "x", "c5", 0)] if max_depth < 64 else []
    edges = spark.createDataFrame(chain + loop, "parent_url string, ref_name string, child_url string, pos int")
    catalogs = spark.createDataFrame([(f"c{i}", "n") for i in range(71)] + [("lone", "n")], "catalog_url string, catalog_name string")
    found = tree.walk_by_doubling(catalogs, edges, "c0", max_depth)
    assert rows_of(found) == rows_of(tree.walk_catalogs(catalogs, edges, "c0", max_depth))
    assert found.count() > max_depth
    assert tree.walk_by_doubling(catalogs, edges, "unknown", max_depth).count() == 0


def test_doubling_joins_grow_with_the_logarithm(spark, monkeypatch):
    made = []
    counted = tree.materialize_counted
    monkeypatch.setattr(tree, "materialize_counted", lambda df: made.append(1) or counted(df))
    edges = spark.createDataFrame([(f"c{i % 5}", f"r{i}", f"c{(i + 1) % 5}", 0) for i in range(5)],
                                  "parent_url string, ref_name string, child_url string, pos int")
    catalogs = spark.createDataFrame([(f"c{i}", "n") for i in range(5)], "catalog_url string, catalog_name string")
    assert tree.walk_by_doubling(catalogs, edges, "c0", 64).count() == 65 and len(made) == 6
