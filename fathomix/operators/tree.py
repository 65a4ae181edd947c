"""Catalog trees of a file server.

Three tables: ``catalogs(catalog_url, catalog_name)`` holds every readable catalog,
``edges(parent_url, ref_name, child_url, pos)`` the references between them and
``leaves(catalog_url, name, access_urls, pos)`` the datasets. A reference to a catalog that
is not in ``catalogs`` is broken.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from fathomix.functions.text import contains_text, path_text
from fathomix.operators.sampling import preview
from fathomix.operators.skew import lookup_join
from fathomix.session import materialize, materialize_counted

# Fixed value.
MAX_DEPTH = 8

# Services that serve a whole file, best first.
DOWNLOAD_SERVICES = ("HTTPServer", "OpenDAP")


def walk_catalogs(
    catalogs: DataFrame, edges: DataFrame, root_url: str, max_depth: int = MAX_DEPTH
) -> DataFrame:
    """Every way to reach a catalog from the root: ``catalog_url, path, depth, reachable``.

    Breadth first; a catalog reached twice appears twice, and a cycle stops at
    ``max_depth``. One join per level with the level before it, which is written to the
    checkpoint folder, so no level is computed twice and the walk ends where the tree does.
    Broken references appear once per visit with ``reachable`` false.
    """
    known = catalogs.select(F.col("catalog_url").alias("child_url"))
    refs = materialize(
        lookup_join(
            edges.select("parent_url", "ref_name", "child_url"),
            known.distinct().withColumn("reachable", F.lit(True)),
            ["child_url"],
            "left",
        ).withColumn("reachable", F.coalesce("reachable", F.lit(False)))
    )
    level = catalogs.filter(F.col("catalog_url") == root_url).select(
        "catalog_url",
        F.array().cast("array<string>").alias("path"),
        F.lit(0).alias("depth"),
        F.lit(True).alias("reachable"),
    )
    levels = [level]
    for depth in range(1, max_depth + 1):
        parents = level.filter("reachable").select(
            F.col("catalog_url").alias("parent_url"), F.col("path").alias("parent_path")
        )
        level, visits = materialize_counted(
            lookup_join(refs, parents, ["parent_url"]).select(
                F.col("child_url").alias("catalog_url"),
                F.concat("parent_path", F.array("ref_name")).alias("path"),
                F.lit(depth).alias("depth"),
                "reachable",
            )
        )
        if not visits:
            break
        levels.append(level)
    return reduce(DataFrame.unionByName, levels)


def walk_by_doubling(
    catalogs: DataFrame, edges: DataFrame, root_url: str, max_depth: int = MAX_DEPTH
) -> DataFrame:
    """What ``walk_catalogs`` gives, for deep trees: joins grow with the logarithm of the depth.

    The table holds all paths between catalogs up to some length. Joining those of exactly that
    length with all doubles it; what starts at the root is the walk. Cycles end at
    ``max_depth``. This keeps paths from every catalog, so a shallow tree is better walked level
    by level.
    """
    known = catalogs.select(F.col("catalog_url").alias("child_url")).distinct()
    refs = lookup_join(edges.select("parent_url", "ref_name", "child_url"), known.withColumn("reachable", F.lit(True)),
                       ["child_url"], "left")
    paths = materialize(refs.select(
        F.col("parent_url").alias("start"), F.col("child_url").alias("end"), F.array("ref_name").alias("path"),
        F.lit(1).alias("depth"), F.coalesce("reachable", F.lit(False)).alias("reachable")))
    length = 1
    while length < max_depth:
        whole = paths.filter((F.col("depth") == length) & F.col("reachable")).select(
            F.col("start").alias("_from"), F.col("end").alias("start"), F.col("path").alias("_path"))
        on = paths.filter(F.col("depth") <= max_depth - length)
        longer, found = materialize_counted(whole.join(on, "start").select(
            F.col("_from").alias("start"), "end", F.concat("_path", "path").alias("path"),
            (F.col("depth") + length).alias("depth"), "reachable"))
        if not found:
            break
        paths = paths.unionByName(longer)
        length *= 2
    root = catalogs.filter(F.col("catalog_url") == root_url).select(
        "catalog_url", F.array().cast("array<string>").alias("path"), F.lit(0).alias("depth"), F.lit(True).alias("reachable"))
    walked = paths.filter((F.col("start") == root_url) & (F.col("depth") <= max_depth)).select(
        F.col("end").alias("catalog_url"), "path", "depth", "reachable")
    return root if root.isEmpty() else root.unionByName(walked)


def catalog_index(
    catalogs: DataFrame,
    edges: DataFrame,
    leaves: DataFrame,
    root_url: str,
    max_depth: int = MAX_DEPTH,
) -> DataFrame:
    """Every leaf below the root: ``name, catalog_url, path, depth, pos``.

    Leaves of catalogs at ``max_depth`` are listed, their sub-catalogs are not followed.
    """
    walk = walk_catalogs(catalogs, edges, root_url, max_depth)
    places = walk.filter("reachable").select("catalog_url", "path", "depth")
    return lookup_join(
        leaves.select("catalog_url", "name", "pos"), places, ["catalog_url"]
    ).select("name", "catalog_url", "path", "depth", "pos")


def broken_references(walk: DataFrame) -> DataFrame:
    """How many references could not be followed, in one row."""
    return walk.agg(F.count_if(~F.col("reachable")).alias("skipped"))


def search_leaves(index: DataFrame, query: str) -> DataFrame:
    """Leaves whose name contains ``query``, in any case, with the path as text."""
    return index.filter(contains_text(F.col("name"), query)).withColumn(
        "path_text", path_text(F.col("path"))
    )


def find_datasets(index: DataFrame, query: str, limit: int = 30) -> DataFrame:
    """The first matches of a name search with their total."""
    found = search_leaves(index, query).select("name", "catalog_url", "path_text", "depth", "pos")
    return preview(found, limit, ["depth", "path_text", "pos", "name"])


def browse(edges: DataFrame, leaves: DataFrame, catalog_url: str) -> DataFrame:
    """One catalog level as rows: its sub-catalogs, then its datasets, by ``pos``."""
    below = edges.filter(F.col("parent_url") == catalog_url).select(
        F.lit("sub_catalog").alias("kind"), "pos", F.col("ref_name").alias("name"),
        F.col("child_url").alias("target_url"),
    )
    here = leaves.filter(F.col("catalog_url") == catalog_url).select(
        F.lit("dataset").alias("kind"), "pos", "name", F.col("catalog_url").alias("target_url")
    )
    return below.unionByName(here)


def _matched(name: Column, query: str) -> dict[str, Column]:
    """Aggregates that decide a name query: exact beats partial, two partials are too many."""
    hit = contains_text(name, query)
    exact = F.max(name == query)
    first, last = F.min(F.when(hit, name)), F.max(F.when(hit, name))
    chosen = F.when(exact, F.lit(query)).when(first == last, first)
    status = (
        F.when(first.isNull(), F.lit("not_found"))
        .when(chosen.isNull(), F.lit("ambiguous"))
        .otherwise(F.lit("ok"))
    )
    return {"status": status, "chosen": chosen, "n_matches": F.count_if(hit)}


def descend(catalogs: DataFrame, edges: DataFrame, query: str) -> DataFrame:
    """For every catalog, the sub-catalog that ``query`` names, or why there is none.

    Status is ``ok``, ``not_found`` or ``ambiguous``; ``candidates`` gives the choices as rows.
    """
    decided = edges.groupBy("parent_url").agg(
        *(column.alias(name) for name, column in _matched(F.col("ref_name"), query).items())
    )
    every = catalogs.select(F.col("catalog_url").alias("parent_url")).distinct()
    joined = every.join(decided, "parent_url", "left")
    return joined.select(
        "parent_url",
        F.coalesce("status", F.lit("not_found")).alias("status"),
        "chosen",
        F.coalesce("n_matches", F.lit(0)).alias("n_matches"),
    )


def candidates(names: DataFrame, column: str, query: str) -> DataFrame:
    """The rows a name query could mean, one per choice."""
    return names.filter(contains_text(F.col(column), query))


def resolve_leaf(catalogs: DataFrame, leaves: DataFrame, query: str | None = None) -> DataFrame:
    """For every catalog, the single leaf that ``query`` (or no query at all) means.

    Without a query a catalog must have exactly one leaf. Status is ``ok``, ``no_datasets``,
    ``not_found`` or ``ambiguous``.
    """
    if query is None:
        name = F.col("name")
        single = F.min(name) == F.max(name)
        decided = {
            "status": F.when(single, F.lit("ok")).otherwise(F.lit("ambiguous")),
            "chosen": F.when(single, F.min(name)),
            "n_matches": F.count("*"),
        }
    else:
        decided = _matched(F.col("name"), query)
    per_catalog = leaves.groupBy("catalog_url").agg(*(c.alias(n) for n, c in decided.items()))
    every = catalogs.select("catalog_url").distinct()
    return every.join(per_catalog, "catalog_url", "left").select(
        "catalog_url",
        F.coalesce("status", F.lit("no_datasets")).alias("status"),
        "chosen",
        F.coalesce("n_matches", F.lit(0)).alias("n_matches"),
    )


def leaf_choices(
    catalogs: DataFrame, edges: DataFrame, leaves: DataFrame, query: str | None = None
) -> DataFrame:
    """What a user can choose from where ``resolve_leaf`` finds no single leaf.

    Rows ``catalog_url, status, kind, name``: the matching datasets of an ambiguous catalog,
    and the sub-catalogs of one without datasets.
    """
    open_ends = materialize(
        resolve_leaf(catalogs, leaves, query).filter(F.col("status").isin("ambiguous", "no_datasets")).select(
            "catalog_url", "status")
    )
    meant = leaves if query is None else candidates(leaves, "name", query)
    datasets = lookup_join(
        meant.select("catalog_url", "name"), open_ends.filter("status = 'ambiguous'"), ["catalog_url"]
    ).select("catalog_url", "status", F.lit("dataset").alias("kind"), "name")
    below = lookup_join(
        edges.select(F.col("parent_url").alias("catalog_url"), F.col("ref_name").alias("name")),
        open_ends.filter("status = 'no_datasets'"), ["catalog_url"],
    ).select("catalog_url", "status", F.lit("sub_catalog").alias("kind"), "name")
    return datasets.unionByName(below)


def level_summary(catalogs: DataFrame, edges: DataFrame, leaves: DataFrame) -> DataFrame:
    """Sub-catalog, dataset and service counts of every catalog level."""
    subs = edges.groupBy(F.col("parent_url").alias("catalog_url")).agg(
        F.count("*").alias("n_sub_catalogs")
    )
    sets = leaves.groupBy("catalog_url").agg(F.count("*").alias("n_datasets"))
    services = level_services(leaves).groupBy("catalog_url").agg(F.count("*").alias("n_services"))
    summary = catalogs.select("catalog_url", "catalog_name")
    for part in (subs, sets, services):
        summary = summary.join(part, "catalog_url", "left")
    return summary.na.fill(0, ["n_sub_catalogs", "n_datasets", "n_services"])


def level_services(leaves: DataFrame) -> DataFrame:
    """Distinct service names at every catalog level, one row each; sort to list them."""
    return leaves.select("catalog_url", F.explode(F.map_keys("access_urls")).alias("service")).distinct()


def _services_text() -> Column:
    return F.array_join(F.array_sort(F.map_keys("access_urls")), ", ")


def download_address(leaves: DataFrame) -> DataFrame:
    """Whole-file address of every leaf from the best service it has.

    Rows without such a service get null and an ``error`` naming the services there are.
    """
    urls = [F.try_element_at("access_urls", F.lit(s)) for s in DOWNLOAD_SERVICES]
    service = F.coalesce(
        *(F.when(url.isNotNull(), F.lit(s)) for s, url in zip(DOWNLOAD_SERVICES, urls))
    )
    return leaves.select(
        "catalog_url",
        "name",
        service.alias("service"),
        F.coalesce(*urls).alias("url"),
        F.when(service.isNull(), F.concat(F.lit("no file service; available: "), _services_text())).alias("error"),
    )


def require_service(leaves: DataFrame, service: str = "OpenDAP") -> DataFrame:
    """Address of every leaf at one named service, with an ``error`` where it is missing."""
    url = F.try_element_at("access_urls", F.lit(service))
    missing = F.concat(F.lit(f"{service} is not offered; available: "), _services_text())
    return leaves.select("catalog_url", "name", url.alias("url"), F.when(url.isNull(), missing).alias("error"))
