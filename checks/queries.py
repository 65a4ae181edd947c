"""One registered query per operator, each over the whole of its tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from checks import adapters
from fathomix.functions import numbers, text, times
from fathomix.operators import (
    attributes as describe,
    columns,
    constraints,
    conversation,
    coverage as profiling,
    discovery,
    nested,
    postings,
    sampling,
    summaries,
    tree,
)
from fathomix.operators.constraints import Bounds
from fathomix.operators.skew import lookup_join
from fathomix.plans import export, plotdata
from fathomix.session import materialize, shared_folder
from fathomix.sources import enveloped, numbered, output, tables, versions

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# The bounds most queries use, and a box for regions.
WINDOW = Bounds(min_time="2024-01-03", max_time="2024-01-27", min_lat=40.0, max_lat=-45.0, max_lon=120.0)
REGION = Bounds(min_time="2024-01-05", max_time="2024-01-25", min_lat=-30.0, max_lat=35.0, min_lon=-120.0, max_lon=100.0)
# The words that stand for platform names in the invented chats.
SPOKEN = {"table": r"\b(the|und|que)\b", "file": r"\b(of|ist|des)\b"}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def as_of():
    return F.lit(adapters.AS_OF).cast("timestamp_ntz")


# --- sources, row numbers, export -------------------------------------------------------


@query
def row_index_dense(spark, d):
    rows = adapters.raw_observations(spark, d).select("dataset_id", "time", "event_id", "temperature")
    return sampling.dense_row_index(rows, ["time", "event_id"])


@query
def position_in_blocks(spark, d):
    rows = adapters.observations(spark, d).select("dataset_id", "row_idx")
    return sampling.with_position(rows, block_rows=1024)


def _with_null_keys(spark, d):
    e = F.col("row_idx")
    return adapters.observations(spark, d).select(
        F.when(e % 7 != 0, F.col("dataset_id")).alias("dataset_id"), F.when(e % 11 != 0, e).alias("row_idx"),
        e.alias("event_id"),
    )


@query
def thin_null_keys(spark, d):
    rows = _with_null_keys(spark, d).filter("row_idx IS NOT NULL")
    return sampling.thin(rows, 3, block_rows=1024)


@query
def position_null_order(spark, d):
    """Rows without a number come first, in no set order: their positions are compared sorted."""
    placed = sampling.with_position(_with_null_keys(spark, d), block_rows=1024)
    return placed.select("dataset_id", "row_idx", "position")


def _store(spark, d):
    path = f"{shared_folder(spark)}/numbered-{uuid.uuid4().hex}"
    return numbered.write_numbered(adapters.observations(spark, d), path, f"numbered_{uuid.uuid4().hex}", parts=8, block_rows=64)


@query
def thin_stored(spark, d):
    """Complete rows, thinned where the store keeps them."""
    rows = columns.drop_missing(_store(spark, d).rows, "temperature", "lat")
    return numbered.thin_stored(rows, 5).select("dataset_id", "row_idx", "temperature")


@query
def thin_all_stored(spark, d):
    return numbered.thin_all(_store(spark, d), 4).select("dataset_id", "row_idx")


@query
def stored_datasets(spark, d):
    """The rows of the datasets that customers ask for, from their folders only."""
    asked = adapters.table(spark, d, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").cast("string").alias("dataset_id"))
    return _store(spark, d).of_datasets(asked).select("dataset_id", "row_idx", "temperature")


@query
def mixed_timeseries(spark, d):
    return plotdata.mixed_timeseries(adapters.mixed_observations(spark, d), "temp", step=3)[0].points


@query
def mixed_unresolved(spark, d):
    return plotdata.mixed_timeseries(adapters.mixed_observations(spark, d), "temp", "salt")[1]


@query
def flatten_stored(spark, d):
    """The same as ``flatten_in_bounds``, from the files whose envelope meets the bounds."""
    path = f"{shared_folder(spark)}/enveloped-{uuid.uuid4().hex}"
    enveloped.store_nested(adapters.nested(spark, d), path, files=16)
    bounds = Bounds(min_time="2024-01-01T01:00:00Z", max_time="2024-01-01T12:00:00Z",
                    min_lat=30.0, max_lat=-20.0, max_lon=-60.0)
    return enveloped.flatten_stored(spark, path, ["time", "depth", "salinity"], bounds)


@query
def coverage_view(spark, d):
    """Coverage kept over an appended, a replaced and a deleted file."""
    path = f"{shared_folder(spark)}/view-{uuid.uuid4().hex}"
    rows = adapters.observations(spark, d).withColumn("piece", F.col("row_idx") % 4)
    view = versions.CoverageView(spark, f"{path}/files", f"{path}/view")

    def write(piece: int, test: str) -> None:
        rows.filter((F.col("piece") == piece) & F.expr(test)).drop("piece").write.mode("overwrite").parquet(f"{path}/files/piece={piece}")

    write(0, "true")
    write(1, "true")
    view.refresh()
    write(2, "true")
    write(1, "row_idx % 3 = 0")
    view.refresh()
    write(0, "false")
    write(3, "lat > 0 OR lat IS NULL")
    view.refresh()
    return view.coverage()


@query
def registry_kept(spark, d):
    """A registry after four deltas, one of them folded into a base."""
    path = f"{shared_folder(spark)}/registry-{uuid.uuid4().hex}"
    registry = versions.Registry(spark, path, ("conv_id", "role"), "turn")
    rows = adapters.table(spark, d, "conversations").select("conv_id", "role", "turn", "text")
    for part in range(4):
        registry.apply(rows.filter((F.col("turn") + F.col("conv_id")) % 4 == part))
        if part == 1:
            registry.compact()
    return registry.read()


@query
def catalog_doubled(spark, d):
    """The whole walk, by doubling."""
    catalogs, edges, _ = adapters.tree(spark, d)
    walk = tree.walk_by_doubling(catalogs, edges, adapters.ROOT_URL)
    return walk.select("catalog_url", F.array_join("path", " > ").alias("path"), "depth", "reachable")


@query
def read_back(spark, d):
    """The subset in every format, written and read again."""
    rows = materialize(adapters.observations(spark, d).select("dataset_id", "row_idx", "time", "lat", "temperature"))
    folder = f"{shared_folder(spark)}/formats-{uuid.uuid4().hex}"
    found = None
    for name in (*output.TEXT_FORMATS, *output.PLAIN_FORMATS):
        output.write_subset(rows, f"{folder}/{name}", name, {"lat": "degrees_north"})
        if name in output.PLAIN_FORMATS:
            again = tables.read_observations(spark, f"{folder}/{name}", output.PLAIN_FORMATS[name])
        else:
            separator, header, _ = output.TEXT_FORMATS[name]
            again = spark.read.option("sep", separator).option("header", str(header).lower()).csv(f"{folder}/{name}")
            again = tables.normalize_observations(again if header else again.toDF(*rows.columns))
        part = again.select(F.lit(name).alias("format"), "dataset_id", F.col("row_idx").cast("long").alias("row_idx"),
                            "time", "lat", "temperature")
        found = part if found is None else found.unionByName(part)
    return found


def _digest(rows: DataFrame, source: str, key: str, *content) -> DataFrame:
    """``source, key, digest``: one row per row of a table, over all its contents."""
    texts = [F.coalesce(c.cast("string"), F.lit("-")) for c in content]
    return rows.select(F.lit(source).alias("source"), F.col(key).cast("string").alias("key"),
                       F.md5(F.concat_ws("|", *texts).cast("binary")).alias("digest"))


@query
def read_tables(spark, d):
    """Attributes, index and catalog tree through their readers, every row by its contents."""
    folder = f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}"
    catalogs, edges, leaves = adapters.tree(spark, d)
    parts = {"attributes": adapters.attributes(spark, d), "index": adapters.index(spark, d), "catalogs": catalogs, "edges": edges,
             "leaves": leaves}
    for name, rows in parts.items():
        rows.write.parquet(f"{folder}/{name}")
    c = F.col

    def listed(name: str):
        return F.array_join(F.array_sort(name), ",")

    def micros(name: str):
        return F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), c(name))

    def millionths(name: str):
        return F.round(c(name) * 1_000_000).cast("long")

    read_catalogs, read_edges, read_leaves = tables.read_tree(spark, *(f"{folder}/{n}" for n in ("catalogs", "edges", "leaves")))
    urls = [c("access_urls")[n] for n in ("HTTPServer", "OpenDAP", "WMS")]
    read = [
        _digest(tables.read_attributes(spark, f"{folder}/attributes"), "attributes", "dataset_id", c("row_type"),
                c("variable_name"), c("attribute_name"), c("value")),
        _digest(tables.read_index(spark, f"{folder}/index"), "index", "dataset_id", c("title"), c("rank"), c("summary"),
                c("institution"), c("ioos_category"), c("cdm_data_type"), listed("standard_names"), listed("variable_names"),
                listed("keywords"), *[c(n).isNull() for n in ("griddap", "tabledap", "wms")], micros("time_min"), micros("time_max"),
                *[millionths(n) for n in ("lat_min", "lat_max", "lon_min", "lon_max")]),
        _digest(read_catalogs, "catalogs", "catalog_url", c("catalog_name")),
        _digest(read_edges, "edges", "child_url", c("parent_url"), c("ref_name"), c("pos")),
        _digest(read_leaves, "leaves", "name", c("catalog_url"), *urls, c("pos")),
    ]
    return reduce(DataFrame.unionByName, read)


@query
def read_nested(spark, d):
    """Nested trajectories through their reader, profile by profile."""
    path = f"{shared_folder(spark)}/nested-{uuid.uuid4().hex}"
    adapters.nested(spark, d).write.parquet(path)
    return nested.flatten(tables.read_nested(spark, path), ["time", "latitude", "longitude"], keys=["trajectory"])


@query
def subset_export(spark, d):
    return export.export_subset(
        adapters.observations(spark, d), adapters.coverage(spark, d),
        ["dataset_id", "time", "lat", "lon", "temperature"], WINDOW,
    )


@query
def subset_distinct(spark, d):
    return export.export_subset(
        adapters.observations(spark, d), adapters.coverage(spark, d),
        ["dataset_id", "depth", "temperature_qc"], WINDOW, distinct=True,
    )


@query
def subset_unconstrained(spark, d):
    return export.export_subset(adapters.observations(spark, d), adapters.coverage(spark, d))


@query
def download_address(spark, d):
    return tree.download_address(adapters.tree(spark, d)[2])


@query
def service_address(spark, d):
    return tree.require_service(adapters.tree(spark, d)[2], "OpenDAP")


# --- projection, schema, flattening -----------------------------------------------------


@query
def cleaned_headers(spark, d):
    raw = adapters.raw_observations(spark, d).select(
        "dataset_id",
        F.col("event_id").alias("row_idx"),
        F.col("time").alias("time (UTC)"),
        F.col("lat").alias("latitude (degrees_north)"),
        F.col("lon").alias("longitude (degrees_east)"),
        F.col("temperature").alias("Temperature (Celsius)"),
    )
    return columns.pick(
        columns.clean_headers(raw), dataset_id="dataset_id", row_idx="row_idx", time="time",
        lat="latitude", lon="lon", temperature="temp",
    )


@query
def flatten_observations(spark, d):
    return nested.flatten(
        adapters.nested(spark, d), ["time", "latitude", "longitude", "depth", "temperature"],
        keys=["dataset_id", "trajectory"],
    )


@query
def flatten_profiles(spark, d):
    return nested.flatten(adapters.nested(spark, d), ["time", "latitude", "longitude"], keys=["trajectory"])


@query
def flatten_in_bounds(spark, d):
    bounds = Bounds(min_time="2024-01-01T01:00:00Z", max_time="2024-01-01T12:00:00Z",
                    min_lat=30.0, max_lat=-20.0, max_lon=-60.0)
    return nested.flatten(adapters.nested(spark, d), ["time", "depth", "salinity"], bounds)


@query
def flatten_bare_end_date(spark, d):
    days = F.make_interval(days=(F.length("trajectory") + F.ascii(F.substring("trajectory", -1, 1))) % 5)
    moved = adapters.nested(spark, d).withColumn(
        "profiles", F.transform("profiles", lambda p: p.withField("time", p["time"] + days)))
    return nested.flatten(moved, ["time", "latitude"], Bounds(max_time="2024-01-03"))


@query
def flatten_nan_bounds(spark, d):
    nan = F.lit(float("nan"))
    holed = adapters.nested(spark, d).withColumn("profiles", F.transform("profiles", lambda p, i: p.withField(
        "latitude", F.when(i % 3 == 1, nan).otherwise(p["latitude"])).withField("obs", F.transform(
            p["obs"], lambda o, k: o.withField("temperature", F.when(k % 4 == 2, nan).otherwise(o["temperature"]))))))
    return nested.flatten(holed, ["latitude", "temperature"], Bounds(min_lat=0.0))


@query
def mixed_trajectories(spark, d):
    return nested.mixed_datasets(adapters.nested(spark, d))


@query
def variable_dictionary(spark, d):
    return describe.variable_dictionary(adapters.attributes(spark, d))


@query
def variables_matching(spark, d):
    rows = describe.variable_dictionary(adapters.attributes(spark, d))
    return describe.filter_variables(rows, "temperature RED")


@query
def variable_lines(spark, d):
    rows = describe.variable_dictionary(adapters.attributes(spark, d), describe.FILE_FIELDS)
    return describe.describe_lines(rows, describe.FILE_FIELDS).select("dataset_id", "variable_name", "line")


@query
def unknown_variables(spark, d):
    parts = adapters.table(spark, d, "lineitem").select(
        F.col("l_partkey").cast("string").alias("dataset_id"),
        F.concat(F.lit("extra_"), (F.col("l_linenumber") * 2).cast("string"), F.lit("_Flag")).alias("variable_name"),
    )
    return columns.unknown_variables(parts, describe.variable_dictionary(adapters.attributes(spark, d)))


# --- constraints ------------------------------------------------------------------------


@query
def resolved_requests(spark, d):
    rows = constraints.bound_requests(adapters.requests(spark, d), adapters.coverage(spark, d)).filter("status = 'ok'")
    return rows.select("request_id", "dataset_id", *constraints.RESOLVED_COLUMNS, "time_reset")


@query
def resolved_declared(spark, d):
    rows = describe.describe_bounds(adapters.attributes(spark, d))
    asked = Bounds(min_time="2024-01-15", min_lat=20.0, max_lon=-10.0)
    return constraints.resolve_bounds(rows, asked).select(
        "dataset_id", *constraints.RESOLVED_COLUMNS, "time_reset", "warnings"
    )


@query
def bounds_as_times(spark, d):
    rows = adapters.requests(spark, d).select(
        "request_id",
        *(times.pad_bare_date(F.col(c), c == "max_time").alias(c) for c in ("min_time", "max_time")),
    )
    return rows.select(
        "request_id",
        times.resolve_time(F.col("min_time"), as_of()).alias("from_time"),
        times.resolve_time(F.col("max_time"), as_of()).alias("to_time"),
    )


@query
def rows_for_requests(spark, d):
    """Every request's observations, several requests to a dataset."""
    resolved = constraints.bound_requests(adapters.requests(spark, d), adapters.coverage(spark, d))
    rows = adapters.observations(spark, d).select("dataset_id", "row_idx", "time", "lat", "lon", "temperature")
    return constraints.rows_for_requests(rows, resolved, as_of=as_of()).drop("lat", "lon")


@query
def requests_without_coverage(spark, d):
    """Requests with their status; the coverage lacks every third dataset."""
    known = adapters.coverage(spark, d).filter("dataset_id % 3 <> 1")
    resolved = constraints.bound_requests(adapters.requests(spark, d), known)
    # Without a coverage only what was asked for is known.
    bounds = [F.when(F.col("status") == "ok", F.col(c)).alias(c) for c in constraints.RESOLVED_COLUMNS]
    return resolved.select("request_id", "dataset_id", "status", *bounds)


@query
def bounds_null_keys(spark, d):
    """Observations without a dataset are a dataset like others."""
    e = F.col("row_idx")
    rows = adapters.observations(spark, d).select(
        F.when(e % 3 != 0, F.col("dataset_id")).alias("dataset_id"), "row_idx", "time", "lat", "lon")
    cover = materialize(profiling.observed_coverage(rows))
    return constraints.rows_in_bounds(rows, constraints.resolve_bounds(cover, WINDOW))


@query
def clamped_requests(spark, d):
    joined = lookup_join(adapters.requests(spark, d), adapters.coverage(spark, d), ["dataset_id"])
    return constraints.clamp_bounds(joined, as_of=as_of()).select(
        "request_id", "dataset_id", *constraints.RESOLVED_COLUMNS, "time_reset"
    )


@query
def skipped_requests(spark, d):
    resolved = constraints.bound_requests(adapters.requests(spark, d), adapters.coverage(spark, d))
    return constraints.unreadable_bounds(resolved)


@query
def declared_subset(spark, d):
    """Observations inside the coverage that their own attributes declare, and the user's bounds."""
    declared = materialize(describe.describe_bounds(adapters.attributes(spark, d)))
    rows = adapters.observations(spark, d).select("dataset_id", "row_idx", "time", "lat", "lon", "temperature")
    return constraints.rows_in_bounds(rows, constraints.resolve_bounds(declared, Bounds(min_lat=-50.0, max_time="2024-01-15")))


@query
def declared_dataset(spark, d):
    """The same for one dataset, with its bounds pushed to the scan."""
    declared = materialize(describe.describe_bounds(adapters.attributes(spark, d)))
    rows = adapters.observations(spark, d).select("dataset_id", "row_idx", "lat")
    return constraints.dataset_in_bounds(rows, declared, "4", Bounds(min_lat=-90.0, max_lat=90.0, min_lon=-180.0, max_lon=180.0))


@query
def incomplete_boxes(spark, d):
    return constraints.incomplete_boxes(adapters.requests(spark, d)).select("request_id", "missing")


@query
def drop_missing_any(spark, d):
    rows = adapters.observations(spark, d).select("dataset_id", "row_idx", "temperature", "lat", "lon")
    return columns.drop_missing(rows, "temperature", "lat", "lon")


@query
def drop_missing_all(spark, d):
    rows = adapters.observations(spark, d).select("dataset_id", "row_idx", "temperature", "lat", "lon")
    return columns.drop_missing(rows, "temperature", "lat", "lon", how="all")


# --- discovery --------------------------------------------------------------------------


@query
def search_keywords(spark, d):
    found = discovery.search_index(adapters.index(spark, d), 'the "src1 en" -ound')
    return found.select("dataset_id", "title", "rank")


@query
def search_facets(spark, d):
    found = discovery.search_index(
        adapters.index(spark, d), variables=["temperature"], ioos_category="en",
        standard_name="sea_water_practical_salinity", cdm_data_type="TrajectoryProfile",
    )
    return found.select("dataset_id", "title", "rank")


@query
def search_two_variables(spark, d):
    found = discovery.search_index(adapters.index(spark, d), variables=["temperature_qc", "salinity"])
    return found.select("dataset_id", "title")


@query
def search_region(spark, d):
    return discovery.search_index(adapters.index(spark, d), bounds=REGION).select("dataset_id", "rank")


@query
def search_regions(spark, d):
    """All requests' boxes and times against the coverage of all datasets."""
    regions = adapters.requests(spark, d).withColumnRenamed("request_id", "region_id").drop("dataset_id")
    return discovery.search_regions(adapters.index(spark, d).drop("summary", "keywords"), regions, as_of())


@query
def search_many(spark, d):
    """Every query of a table, answered from the stored substring index."""
    index = adapters.index(spark, d).drop("keywords")
    return postings.search_many(postings.index_of_datasets(index, ["dataset_id", "rank"]), postings.parsed(adapters.queries(spark, d)))


@query
def leaves_many(spark, d):
    """Name searches for all customers' numbers over all leaves."""
    asked = adapters.table(spark, d, "customer").select(
        F.col("c_custkey").alias("query_id"),
        F.concat(F.when(F.col("c_custkey") % 3 == 0, F.lit("ORDER-1")).otherwise(F.lit("")), F.col("c_custkey").cast("string")).alias("query"))
    index = postings.index_of_leaves(adapters.tree(spark, d)[2])
    return postings.search_many(index, postings.whole(asked))


@query
def search_unique(spark, d):
    found = discovery.search_index(adapters.index(spark, d), "record")
    return sampling.unique_results(found, ["institution", "ioos_category"])


@query
def search_preview(spark, d):
    found = discovery.search_index(adapters.index(spark, d), "the")
    unique = sampling.unique_results(found, ["dataset_id", "title"])
    return sampling.preview(unique, 30, ["rank", "dataset_id", "title"])


@query
def search_page(spark, d):
    found = discovery.search_index(adapters.index(spark, d), "of", items_per_page=1_000_000)
    return found.select("dataset_id", "rank")


@query
def search_any(spark, d):
    return discovery.search_any(
        adapters.index(spark, d), ["src3", "src4 -ist", "und"], title_pattern="SRC[34] (en|de)",
        variable=" Temp ",
    )


@query
def facet_institutions(spark, d):
    return discovery.facet_values(adapters.index(spark, d), "institution", "SRC1")


@query
def facet_standard_names(spark, d):
    return discovery.facet_values(adapters.index(spark, d), "standard_name")


@query
def facet_keywords(spark, d):
    return discovery.facet_values(adapters.index(spark, d), "keywords")


@query
def facet_listed(spark, d):
    return discovery.listed(discovery.facet_values(adapters.index(spark, d), "keywords"))


@query
def facet_checks(spark, d):
    docs = adapters.table(spark, d, "documents")
    asked = docs.select(F.lit("institution").alias("facet"), F.concat(F.lit("_"), "source", F.lit("_"), "lang", F.lit("_lab ")).alias("value")).unionByName(
        docs.select(F.lit("ioos_category").alias("facet"), F.upper("lang").alias("value"))
    ).unionByName(
        docs.select(F.lit("keywords").alias("facet"), F.explode(F.array_distinct(F.split("text", r"\s+"))).alias("value"))
    )
    return discovery.check_facets(asked, adapters.index(spark, d))


@query
def server_summary(spark, d):
    return discovery.server_summary(adapters.index(spark, d))


@query
def protocol_flags(spark, d):
    return discovery.protocol_flags(adapters.index(spark, d))


@query
def described_bounds(spark, d):
    rows = describe.describe_bounds(adapters.attributes(spark, d))
    return describe.coverage_lines(rows)


@query
def label_records(spark, d):
    return describe.label_records(adapters.attributes(spark, d))


@query
def label_records_file(spark, d):
    return describe.label_records(adapters.attributes(spark, d), file_server=True)


@query
def info_boxes(spark, d):
    return describe.info_box(describe.label_records(adapters.attributes(spark, d)))


@query
def units_joined(spark, d):
    rows = adapters.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_partkey").cast("string").alias("dataset_id"),
        F.when(F.col("l_linenumber") % 2 == 0, F.lit("temperature")).otherwise(F.lit("depth")).alias("variable_name"),
    )
    joined = describe.with_units(rows, describe.variable_units(adapters.attributes(spark, d)))
    return joined.withColumn("label", text.color_label(F.col("variable_name"), F.col("units")))


@query
def grids_rejected(spark, d):
    return describe.reject_grids(adapters.attributes(spark, d))


@query
def attribute_numbers(spark, d):
    rows = adapters.attributes(spark, d)
    return rows.select(
        "dataset_id", "variable_name", "attribute_name", "value",
        text.numeric_value(F.col("value")).alias("number"),
        text.is_qc_variable(F.col("variable_name")).alias("qc_variable"),
        text.is_qc_keyword(F.col("value")).alias("qc_keyword"),
    )


# --- catalog trees ----------------------------------------------------------------------


def _tree_index(spark, d, **options):
    return tree.catalog_index(*adapters.tree(spark, d), adapters.ROOT_URL, **options)


@query
def catalog_index(spark, d):
    rows = _tree_index(spark, d)
    return rows.select("name", "catalog_url", text.path_text(F.col("path")).alias("path"), "depth")


@query
def catalog_index_shallow(spark, d):
    rows = _tree_index(spark, d, max_depth=2)
    return rows.select("name", "catalog_url", text.path_text(F.col("path")).alias("path"), "depth")


@query
def catalog_broken_references(spark, d):
    catalogs, edges, _ = adapters.tree(spark, d)
    return tree.broken_references(tree.walk_catalogs(catalogs, edges, adapters.ROOT_URL))


@query
def catalog_find(spark, d):
    return tree.find_datasets(_tree_index(spark, d), "order-11").select(
        "name", "catalog_url", "path_text", "total", "more"
    )


@query
def catalog_browse(spark, d):
    _, edges, leaves = adapters.tree(spark, d)
    return tree.browse(edges, leaves, "https://files.example.org/n/3/catalog.xml")


@query
def catalog_descend(spark, d):
    catalogs, edges, _ = adapters.tree(spark, d)
    return tree.descend(catalogs, edges, "NATION_1")


@query
def catalog_leaf_single(spark, d):
    catalogs, _, leaves = adapters.tree(spark, d)
    return tree.resolve_leaf(catalogs, leaves)


@query
def catalog_leaf_named(spark, d):
    catalogs, _, leaves = adapters.tree(spark, d)
    return tree.resolve_leaf(catalogs, leaves, "order-7")


@query
def catalog_choices(spark, d):
    return tree.leaf_choices(*adapters.tree(spark, d))


@query
def catalog_choices_named(spark, d):
    return tree.leaf_choices(*adapters.tree(spark, d), "order-7")


@query
def catalog_levels(spark, d):
    return tree.level_summary(*adapters.tree(spark, d))


@query
def catalog_services(spark, d):
    return tree.level_services(adapters.tree(spark, d)[2])


# --- coverage, thinning, views ----------------------------------------------------------


@query
def observed_coverage(spark, d):
    return profiling.observed_coverage(adapters.observations(spark, d))


@query
def coverage_with_nan(spark, d):
    nan, e = F.lit(float("nan")), F.col("row_idx")
    holed = adapters.observations(spark, d).withColumns({
        "lat": F.when(e % 5 == 0, nan).otherwise(F.col("lat")), "lon": F.when(e % 6 == 1, nan).otherwise(F.col("lon"))})
    return profiling.observed_coverage(holed)


@query
def dataset_profiles(spark, d):
    return profiling.profile_datasets(adapters.observations(spark, d))


@query
def thin_every_fifth(spark, d):
    return sampling.thin(adapters.observations(spark, d).select("dataset_id", "row_idx", "temperature"), 5)


@query
def thin_then_drop(spark, d):
    return plotdata.map_points(adapters.observations(spark, d), step=25)


@query
def drop_then_thin(spark, d):
    return plotdata.scatter_points(adapters.observations(spark, d), "lat", "lon", step=25)


# --- plot jobs --------------------------------------------------------------------------


def _inside(spark, d, bounds=WINDOW):
    return plotdata.constrained(adapters.observations(spark, d), adapters.coverage(spark, d), bounds)


@query
def timeseries_points(spark, d):
    return plotdata.timeseries(_inside(spark, d), "temp", "salinity", step=5).points


@query
def timeseries_summary(spark, d):
    return plotdata.timeseries(
        _inside(spark, d), "temperature", step=5, attributes=adapters.attributes(spark, d)
    ).summary


@query
def profile_points(spark, d):
    return plotdata.profile(_inside(spark, d), "temperature", "salinity", step=3).points


@query
def profile_summary(spark, d):
    return plotdata.profile(_inside(spark, d), "temperature").summary


@query
def custom_points(spark, d):
    return plotdata.custom(_inside(spark, d), "Salinity", "temp", "depth").points


@query
def trajectory_points(spark, d):
    return plotdata.trajectory_map(
        _inside(spark, d), "temperature", step=4, attributes=adapters.attributes(spark, d)
    ).points


@query
def trajectory_summary(spark, d):
    summary = plotdata.trajectory_map(_inside(spark, d), "temperature", step=4).summary
    return summary.withColumns({c: F.round(c, 6) for c in ("center_lat", "center_lon")})


def _nested(spark, d, plot, **options):
    return plotdata.nested_rows(adapters.nested(spark, d), plot, **options)


@query
def nested_timeseries(spark, d):
    rows = _nested(spark, d, "timeseries", y="temperature", bounds=Bounds(min_lat=-20.0))
    return plotdata.timeseries(rows, "temperature", step=7).points


@query
def nested_profile(spark, d):
    rows = _nested(spark, d, "profile", x="temperature", color="salinity", bounds=Bounds(max_lon=-70.0))
    return plotdata.profile(rows, "temperature", "salinity", step=3).points


@query
def nested_custom(spark, d):
    rows = _nested(spark, d, "custom", x="salinity", y="temperature")
    return plotdata.custom(rows, "salinity", "temperature", step=5).points


@query
def nested_map(spark, d):
    rows = _nested(spark, d, "map", bounds=Bounds(min_time="2024-01-01T02:00:00Z"))
    return plotdata.trajectory_map(rows, step=3).points


@query
def clamped_track(spark, d):
    resolved = constraints.clamp_bounds(adapters.coverage(spark, d), WINDOW)
    rows = constraints.rows_in_bounds(adapters.observations(spark, d), resolved)
    return plotdata.colored_track(rows, 2).points


def _region(spark, d, **options):
    return plotdata.region_map(
        materialize(adapters.index(spark, d).drop("summary", "keywords")),
        adapters.coverage(spark, d), adapters.observations(spark, d), REGION, **options,
    )


@query
def region_points(spark, d):
    return _region(spark, d).points


@query
def region_searched(spark, d):
    """A search text and relative times instead of everything at all times."""
    return plotdata.region_map(
        materialize(adapters.index(spark, d).drop("keywords")), adapters.coverage(spark, d), adapters.observations(spark, d),
        Bounds(min_time="now-15days", max_time="now-1days", min_lat=-30.0, max_lat=35.0, min_lon=-120.0, max_lon=100.0),
        query="record src1", max_datasets=50, step=3, as_of=as_of(),
    ).points


@query
def region_tracks(spark, d):
    return _region(spark, d).tracks


def _rounded_view(summary):
    return summary.withColumns({c: F.round(c, 6) for c in ("center_lat", "center_lon", "span", "zoom")})


@query
def region_summary(spark, d):
    return _rounded_view(_region(spark, d).summary)


@query
def region_all_points(spark, d):
    return _region(spark, d, max_datasets=1_000_000, step=2).points


@query
def region_all_summary(spark, d):
    return _rounded_view(_region(spark, d, max_datasets=1_000_000, step=2).summary)


@query
def pooled_view(spark, d):
    points = plotdata.map_points(adapters.observations(spark, d), step=25)
    return _rounded_view(summaries.pooled_view(points))


@query
def colored_depth(spark, d):
    return plotdata.colored_depth(adapters.observations(spark, d), "temperature", 2).points


@query
def colored_track(spark, d):
    return plotdata.colored_track(adapters.observations(spark, d), 3).points


# --- scalar functions -------------------------------------------------------------------


def _page_addresses(spark, d):
    p, u = F.col("page_id"), F.col("url")
    return adapters.table(spark, d, "pages").select(
        "page_id",
        F.when(p % 4 == 0, F.regexp_replace(u, "/(en|fr|de|es)/", "/ERDDAP/tabledap/"))
        .when(p % 4 == 1, F.concat(F.regexp_extract(u, "^[^?#]*", 0), F.lit("/index.html/")))
        .when(p % 4 == 2, F.concat(F.regexp_extract(u, "^[^?#]*", 0), F.lit("/catalog.html?x=1")))
        .otherwise(u).alias("url"),
    )


@query
def table_server_addresses(spark, d):
    return _page_addresses(spark, d).withColumn("base", text.table_server_base(F.col("url")))


@query
def catalog_addresses(spark, d):
    return _page_addresses(spark, d).withColumn("catalog", text.catalog_address(F.col("url")))


@query
def clean_titles(spark, d):
    docs = adapters.table(spark, d, "documents")
    raw = F.concat(F.lit("_ "), "source", F.lit("_"), "text", F.lit("_3d o'NEIL u.s. "))
    return docs.select("doc_id", text.clean_title(raw).alias("title"))


@query
def listed_counts(spark, d):
    p = F.col("page_id")
    stated = F.format_string("View a List of All %,d Datasets", p * 37)
    html = F.when(p % 3 != 0, F.concat("html", stated)).otherwise(F.col("html"))
    return adapters.table(spark, d, "pages").select("page_id", text.listed_dataset_count(html).alias("n_datasets"))


@query
def hover_texts(spark, d):
    rows = adapters.observations(spark, d)
    return rows.select(
        "row_idx",
        numbers.hover_text(
            F.col("lat") / 7.0, F.col("lon") / 70000.0, F.col("time"), F.col("temperature") * 3333333.3, F.lit("t (C)"),
        ).alias("hover"),
    )


# --- chat logs --------------------------------------------------------------------------


@query
def platform_mentions(spark, d):
    rows = conversation.detect_platforms(adapters.table(spark, d, "conversations"), SPOKEN)
    return rows.withColumn("mentioned", F.array_join("mentioned", ","))


@query
def routed_turns(spark, d):
    return conversation.route_turns(adapters.table(spark, d, "conversations"), SPOKEN)


@query
def last_user_texts(spark, d):
    return conversation.last_user_text(adapters.table(spark, d, "conversations"))


@query
def registry_latest(spark, d):
    rows = adapters.table(spark, d, "conversations").select("conv_id", "role", "turn", "text")
    return conversation.latest_entries(rows, ["conv_id", "role"], "turn")


@query
def registry_null_sequence(spark, d):
    """Updates without a sequence count as the oldest."""
    t = F.col("turn")
    rows = adapters.table(spark, d, "conversations").select(
        "conv_id", "role", F.when((t > 1) & (F.col("conv_id") % 2 == 0), t).alias("turn"), "text")
    once = rows.groupBy("conv_id", "role", "turn").agg(F.min("text").alias("text"))
    return conversation.latest_entries(once, ["conv_id", "role"], "turn")


@query
def artifacts_appended(spark, d):
    rows = adapters.table(spark, d, "conversations").select("conv_id", "turn", "text")
    more = adapters.table(spark, d, "documents").select(
        F.col("doc_id").alias("conv_id"), F.length("text").cast("long").alias("turn"), "text")
    return conversation.append_entries(rows, more)
