"""Finding datasets in an index: keyword, facet, variable, region and time.

An index row is ``dataset_id, title, rank`` and, where known, ``summary, institution,
ioos_category, cdm_data_type, standard_names, variable_names, keywords`` (the last three
arrays), ``griddap, tabledap, wms`` and the typed coverage ``time_min, time_max, lat_min,
lat_max, lon_min, lon_max``. ``rank`` is the order in which a search lists results.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from math import isqrt

from pyspark.sql import Column, DataFrame, functions as F, types as T

from fathomix.functions.text import clean_title, contains_text, is_qc_keyword, is_qc_variable
from fathomix.functions.times import resolve_time
from fathomix.operators.constraints import DEFAULT_LAT, DEFAULT_LON, REQUEST_COLUMNS, Bounds
from fathomix.operators.sampling import dense_row_index, first_page
from fathomix.operators.skew import fits_broadcast, lookup_join
from fathomix.session import materialize

# The pseudo-dataset that lists all others, the protocols and the facets.
ALL_DATASETS = "allDatasets"
PROTOCOLS = ("griddap", "tabledap", "wms")
FACETS = {
    "institution": "institution",
    "ioos_category": "ioos_category",
    "standard_name": "standard_names",
    "cdm_data_type": "cdm_data_type",
    "keywords": "keywords",
}

# Fixed value.
VALUES_SHOWN = 20

# Plain words and the standard names they stand for in the older search.
STANDARD_NAMES = {
    "salinity": "sea_water_practical_salinity",
    "salt": "sea_water_practical_salinity",
    "temperature": "sea_water_temperature",
    "temp": "sea_water_temperature",
    "pressure": "sea_water_pressure",
    "depth": "depth",
    "oxygen": "mole_concentration_of_dissolved_molecular_oxygen_in_sea_water",
    "chlorophyll": "concentration_of_chlorophyll_in_sea_water",
    "density": "sea_water_density",
}

_COVERED = ("time_min", "time_max", "lat_min", "lat_max", "lon_min", "lon_max")
_SEARCHED = ("dataset_id", "title", "summary", "institution", "ioos_category", "cdm_data_type")
_SEARCHED_LISTS = ("keywords", "standard_names", "variable_names")


def search_terms(query: str) -> tuple[list[str], list[str]]:
    """Split a query into wanted and unwanted terms; quotes keep a phrase together.

    ``all`` on its own, like an empty query, wants everything.
    """
    wanted, unwanted = [], []
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]+)"|([^\s"-][^\s"]*))', query):
        (unwanted if minus else wanted).append((phrase or word).lower())
    return ([] if wanted == ["all"] else wanted), unwanted


def searchable_text(index: DataFrame) -> Column:
    """All metadata of a row that a keyword search reads, in lower case."""
    plain = [F.col(c).cast("string") for c in _SEARCHED if c in index.columns]
    lists = [F.array_join(c, " ") for c in _SEARCHED_LISTS if c in index.columns]
    return F.lower(F.concat_ws(" ", *plain, *lists))


def matches_query(index: DataFrame, query: str) -> Column:
    """Whether all wanted terms and no unwanted one occur in a row's metadata, in any case."""
    wanted, unwanted = search_terms(query)
    text = searchable_text(index)
    test = F.lit(True)
    for term in wanted:
        test = test & text.contains(term)
    for term in unwanted:
        test = test & ~text.contains(term)
    return test


def _facet_test(index: DataFrame, facet: str, value: str) -> Column:
    column = FACETS[facet]
    if isinstance(index.schema[column].dataType, T.ArrayType):
        return F.array_contains(column, value)
    return F.col(column) == value


def overlaps(bounds: Bounds, as_of: Column | None = None) -> Column:
    """Whether a row's coverage meets the box and time window; open sides always do."""
    moment = as_of if as_of is not None else F.localtimestamp()
    test = F.lit(True)
    if bounds.min_time:
        test = test & (F.col("time_max") >= resolve_time(F.lit(bounds.min_time), moment))
    if bounds.max_time:
        test = test & (F.col("time_min") <= resolve_time(F.lit(bounds.max_time), moment))
    for axis in ("lat", "lon"):
        low, high = getattr(bounds, f"min_{axis}"), getattr(bounds, f"max_{axis}")
        if low is not None:
            test = test & (F.col(f"{axis}_max") >= low)
        if high is not None:
            test = test & (F.col(f"{axis}_min") <= high)
    return test


# The finest grid of ``search_regions`` has 2 to this power cells a side.
FINEST = 12
# Regions, and datasets, of one block of a cell; pairs that one task makes, and the most tasks.
SIDE = 2000
TASK_PAIRS = 8_000_000
MOST_TASKS = 2000
_AXES = {"lat": DEFAULT_LAT, "lon": DEFAULT_LON}


def _on_grid(rows: DataFrame, low: str, high: str) -> DataFrame:
    """Add the ends of each row's box in cells of the finest grid, and its ``_level``.

    An open side reaches the edge of the world. On its level a box meets at most two cells a
    side; level 0 is a single cell. A box whose ends are the wrong way round meets only what holds
    all between them, so its first end stands for it.
    """
    ends = {}
    for axis, (first, last) in _AXES.items():
        a = F.coalesce(F.col(low.format(axis)), F.lit(first))
        b = F.coalesce(F.col(high.format(axis)), F.lit(last))
        for name, end in (("low", a), ("high", F.greatest(a, b))):
            cell = F.floor((end - first) * ((1 << FINEST) / (last - first)))
            ends[f"_{axis}_{name}"] = F.greatest(F.least(cell, F.lit((1 << FINEST) - 1)), F.lit(0)).cast("long")
    cells = rows.withColumns(ends)
    widest = F.greatest(*[F.col(f"_{axis}_high") - F.col(f"_{axis}_low") + 1 for axis in _AXES])
    return cells.withColumn("_level", F.lit(FINEST) - F.ceil(F.log2(widest)).cast("int"))


def _in_cells(boxes: DataFrame, levels: Column) -> DataFrame:
    """One row per cell ``_at, _y, _x`` that a box meets on each of the ``levels``."""
    placed = boxes.withColumn("_at", F.explode(levels))
    for axis, name in (("lat", "_y"), ("lon", "_x")):
        low, high = (F.expr(f"shiftright(_{axis}_{end}, {FINEST} - _at)") for end in ("low", "high"))
        placed = placed.withColumn(name, F.explode(F.sequence(low, high)))
    return placed


def _levels(boxes: DataFrame) -> Column:
    """The levels in use, at most ``FINEST + 1``."""
    return F.array(*[F.lit(r["_level"]) for r in boxes.select("_level").distinct().collect()]).cast("array<int>")


def search_regions(
    index: DataFrame, regions: DataFrame, as_of: Column | None = None, keep: Sequence[str] = ("dataset_id", "rank")
) -> DataFrame:
    """``region_id`` and the ``keep`` columns of every dataset whose coverage meets the region.

    ``regions`` has ``region_id`` and request columns; a pair is kept by the test that a single
    ``Bounds`` uses. Every box lies on the grid level where it meets at most four cells. A
    region meets the boxes of its own and finer levels in the cells of its level, and coarser
    ones in the cells of theirs, so boxes of any size meet by equal keys and nothing is compared
    with everything. A pair counts in the first cell that both meet. Datasets without some end of
    their coverage meet only the regions that do not ask for it, by the kind of region. Cells with many boxes, as
    the whole world's, are cut into blocks that many tasks share.
    """
    moment = as_of if as_of is not None else F.localtimestamp()
    times = {f"_{n}": F.nullif(F.col(n), F.lit("")) for n in ("min_time", "max_time")}
    asked = regions.select("region_id", *REQUEST_COLUMNS).withColumns(times).withColumns({
        "_from": resolve_time(F.col("_min_time"), moment), "_to": resolve_time(F.col("_max_time"), moment)})
    # A time that cannot be read meets nothing; an unknown end meets only regions that are open there.
    readable = [F.col(f"_{n}").isNull() | F.col(m).isNotNull() for n, m in (("min_time", "_from"), ("max_time", "_to"))]
    asked = asked.filter(readable[0] & readable[1]).withColumn("_sides", _bits(
        [F.col(c).isNotNull() for c in ("_min_time", "_max_time", "min_lat", "max_lat", "min_lon", "max_lon")]))
    asked = _on_grid(asked.drop("min_time", "max_time", "_min_time", "_max_time"), "min_{}", "max_{}")
    asked = materialize(_closed(asked, "min_{}", "max_{}"))
    sides = F.array(*[F.lit(r["_sides"]) for r in asked.select("_sides").distinct().collect()]).cast("array<int>")
    held = index.select(*keep, *[F.col(c).alias(f"_of_{c}") for c in _COVERED]).withColumn("_unknown", _bits(
        [F.col(f"_of_{c}").isNull() for c in ("time_max", "time_min", "lat_max", "lat_min", "lon_max", "lon_min")]))
    held = materialize(_closed(_on_grid(held, "_of_{}_min", "_of_{}_max"), "_of_{}_min", "_of_{}_max"))
    known, partly = held.filter("_unknown = 0").drop("_unknown"), held.filter("_unknown <> 0")
    # At most 64 copies: one for every kind of region that leaves the unknown ends open.
    partly = partly.withColumn("_sides", F.explode(F.filter(sides, lambda m: m.bitwiseAND(F.col("_unknown")) == 0))).drop("_unknown")
    return _meeting(asked.drop("_sides"), known, [], keep).unionByName(_meeting(asked, partly, ["_sides"], keep))


def _closed(boxes: DataFrame, low: str, high: str) -> DataFrame:
    """Open sides as the lowest and the highest number, which is NaN, so that a pair's test has no null."""
    ends = ((low, float("-inf")), (high, float("nan")))
    return boxes.withColumns({n: F.coalesce(F.col(n), F.lit(end)) for side, end in ends for n in map(side.format, _AXES)})


def _bits(flags: Sequence[Column]) -> Column:
    return sum((F.when(flag, F.lit(1 << i)).otherwise(F.lit(0)) for i, flag in enumerate(flags)), F.lit(0))


def _in_same_cells(boxes: DataFrame, homes: DataFrame, cells: list[str], of_box: list[str], of_home: list[str]) -> DataFrame:
    """The pairs of boxes and homes in each cell.

    A cell with many of either is cut into blocks of ``SIDE`` by ``SIDE``, or larger ones where that would be
    far more blocks than tasks; each is a key of its own, and the keys are dealt out by the pairs that
    they make, as few boxes can meet very many.
    """
    n_boxes, n_homes = (side.groupBy(*cells).agg(F.count("*").alias(n)) for side, n in ((boxes, "_boxes"), (homes, "_homes")))
    both = materialize(n_boxes.join(n_homes, cells))
    pairs = both.agg(F.sum(F.col("_boxes") * F.col("_homes"))).first()[0] or 0
    most = max(SIDE, isqrt(pairs // MOST_TASKS))
    cut = both.filter((F.col("_boxes") > most) | (F.col("_homes") > most)).select(
        *cells, *[F.ceil(F.col(n) / most).cast("int").alias(n) for n in ("_boxes", "_homes")])
    cut = F.broadcast(cut) if fits_broadcast(cut) else cut

    def in_blocks(side: DataFrame, own: str, other: str, by: list[str]) -> DataFrame:
        one, by = F.lit(1), [c for c in by if side.schema[c].dataType.typeName() != "map"]
        return side.join(cut, cells, "left").withColumn(f"{own}_at", F.pmod(F.xxhash64(*by), F.coalesce(own, one))).withColumn(
            f"{other}_at", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(other, one).cast("long") - 1))).drop("_boxes", "_homes")

    keys = [*cells, "_boxes_at", "_homes_at"]
    tasks = min(pairs // TASK_PAIRS + 1, MOST_TASKS)
    dealt = in_blocks(boxes, "_boxes", "_homes", of_box).repartition(tasks, *keys)
    return lookup_join(dealt, in_blocks(homes, "_homes", "_boxes", of_home), keys, salt_by=of_box)


def _meeting(asked: DataFrame, held: DataFrame, same: list[str], keep: Sequence[str]) -> DataFrame:
    """The pairs of regions and datasets on the grid that meet, among those with the ``same`` values."""
    kept = [c for c in held.columns if c not in asked.columns or c in same]
    ends = [f"_{axis}_low" for axis in _AXES]
    named = held.withColumnsRenamed({c: f"_of{c}" for c in (*ends, "_level")}).select(
        *kept, *[f"_of{c}" for c in (*ends, "_level")], *[F.col(f"_of{c}").alias(c) for c in (*ends, "_level")],
        *[f"_{axis}_high" for axis in _AXES])
    cells = [*same, "_at", "_y", "_x"]
    of_dataset = [*[c for c in kept if c not in same], *[f"_of{c}" for c in ends], *cells]
    # Regions at home, datasets on that level or finer; then datasets at home, regions finer.
    finer = _in_cells(named, F.filter(_levels(asked), lambda l: l <= F.col("_level"))).select(*of_dataset)
    pairs = _in_same_cells(finer, _in_cells(asked, F.array("_level")), cells, of_dataset, ["region_id"])
    others = _in_cells(asked, F.filter(_levels(held), lambda l: l < F.col("_level")))
    back = _in_same_cells(others, _in_cells(named, F.array("_level")).select(*of_dataset), cells, ["region_id"], of_dataset)
    found = pairs.unionByName(back)
    test = F.lit(True)
    for axis, name in (("lat", "_y"), ("lon", "_x")):
        test = test & F.expr(f"{name} = shiftright(greatest(_{axis}_low, _of_{axis}_low), {FINEST} - _at)")
        test = test & (F.col(f"_of_{axis}_max") >= F.col(f"min_{axis}")) & (F.col(f"_of_{axis}_min") <= F.col(f"max_{axis}"))
    test = test & (F.col("_from").isNull() | (F.col("_of_time_max") >= F.col("_from")))
    test = test & (F.col("_to").isNull() | (F.col("_of_time_min") <= F.col("_to")))
    return found.filter(test).select("region_id", *keep)


def search_index(
    index: DataFrame,
    query: str = "all",
    variables: Sequence[str] = (),
    bounds: Bounds | None = None,
    as_of: Column | None = None,
    items_per_page: int | None = None,
    **facets: str | None,
) -> DataFrame:
    """Index rows that match everything asked for.

    One variable must be a dataset's exact variable name; several are searched as further
    keywords. Facet values match exactly. A page size keeps the first rows by rank.
    """
    unknown = sorted(set(facets) - set(FACETS))
    if unknown:
        raise ValueError(f"unknown facets {unknown}; use {sorted(FACETS)}")
    if len(variables) > 1:
        query = " ".join(["" if query == "all" else query, *variables]).strip()
    found = index.filter(matches_query(index, query))
    if len(variables) == 1:
        found = found.filter(F.array_contains("variable_names", variables[0]))
    for facet, value in facets.items():
        if value:
            found = found.filter(_facet_test(index, facet, value))
    if bounds is not None:
        found = found.filter(overlaps(bounds, as_of))
    if items_per_page is not None:
        found = first_page(found, items_per_page)
    return found


def search_any(
    index: DataFrame,
    queries: Sequence[str],
    title_pattern: str | None = None,
    variable: str | None = None,
    bounds: Bounds | None = None,
    as_of: Column | None = None,
) -> DataFrame:
    """Union of several searches in one scan: each dataset once, first query first.

    ``variable`` may be a plain word for a standard name; ``title_pattern`` keeps titles it
    matches in any case.
    """
    first_hit = F.coalesce(
        *(F.when(matches_query(index, q), F.lit(i)) for i, q in enumerate(queries))
    )
    found = index.withColumn("query_no", first_hit).filter(F.col("query_no").isNotNull())
    if variable:
        name = STANDARD_NAMES.get(variable.lower().strip(), variable)
        found = found.filter(F.array_contains("standard_names", name))
    if bounds is not None:
        found = found.filter(overlaps(bounds, as_of))
    if title_pattern:
        found = found.filter(F.coalesce(F.col("title").rlike(f"(?i){title_pattern}"), F.lit(False)))
    place = F.min(F.struct("query_no", "rank", "title")).alias("first")
    return found.groupBy("dataset_id").agg(place).select("dataset_id", "first.*")


def facet_values(index: DataFrame, facet: str, query: str | None = None) -> DataFrame:
    """Distinct values of a facet, without nulls and, for standard names, without flags.

    ``listed`` gives their place in a sorted list.
    """
    column = FACETS[facet]
    is_list = isinstance(index.schema[column].dataType, T.ArrayType)
    # explode_outer: explode would have the list computed again to filter by its size.
    value = F.explode_outer(column) if is_list else F.col(column)
    values = index.select(value.alias("value")).filter("value IS NOT NULL")
    if query:
        values = values.filter(contains_text(F.col("value"), query))
    if facet == "standard_name":
        values = values.filter(~is_qc_variable(F.col("value")))
    return values.distinct()


def listed(values: DataFrame, column: str = "value") -> DataFrame:
    """Values with their 0-based ``place`` in a sorted list; no task holds the whole list."""
    return dense_row_index(values, [column], [], "place")


def check_facet(index: DataFrame, facet: str, value: str) -> None:
    """Raise when ``value`` is not one of the facet's values, listing the first of those."""
    if index.filter(_facet_test(index, facet, value)).isEmpty():
        first = facet_values(index, facet).orderBy("value").limit(VALUES_SHOWN).collect()
        raise ValueError(f"{value!r} is not a known {facet}; known are {[r['value'] for r in first]}")


def check_facets(requests: DataFrame, index: DataFrame) -> DataFrame:
    """Requested ``(facet, value)`` pairs, each once, with whether the index has them."""
    known = None
    for facet, column in FACETS.items():
        if column not in index.columns:
            continue
        is_list = isinstance(index.schema[column].dataType, T.ArrayType)
        value = F.explode_outer(column) if is_list else F.col(column)
        values = index.select(F.lit(facet).alias("facet"), value.alias("value")).filter(
            "value IS NOT NULL"
        )
        known = values if known is None else known.unionByName(values)
    listed = known.distinct().withColumn("valid", F.lit(True))
    asked = requests.select("facet", "value").distinct()
    return asked.join(listed, ["facet", "value"], "left").withColumn(
        "valid", F.coalesce("valid", F.lit(False))
    )


def protocol_flags(index: DataFrame) -> DataFrame:
    """One row telling, per protocol, whether any dataset offers it (empty text counts)."""
    return _real_datasets(index).agg(*(F.max(F.col(p).isNotNull()).alias(p) for p in PROTOCOLS))


def _real_datasets(index: DataFrame) -> DataFrame:
    return index.filter(F.col("dataset_id") != ALL_DATASETS)


def server_summary(index: DataFrame) -> DataFrame:
    """Summary of a server as ``section, value`` rows.

    Sections are ``dataset_count`` (one row), ``protocol``, ``institution`` and ``keyword``;
    names are cleaned, blank and quality-control entries left out, each name once. Rows
    rather than lists, because a server may have any number of keywords.
    """
    entries = F.concat(
        F.array(
            *(F.struct(F.lit(section).alias("section"), value.alias("value")) for section, value in (
                ("dataset_count", F.col("dataset_id")),
                ("institution", F.col("institution")),
                *(("protocol", F.when(F.col(p).isNotNull(), F.lit(p))) for p in PROTOCOLS),
            ))
        ),
        F.coalesce(
            F.transform("keywords", lambda k: F.struct(F.lit("keyword").alias("section"), k.alias("value"))), F.array()
        ),
    )
    # One pass over the index; raw values are made distinct first, so each is cleaned once.
    raw = materialize(
        _real_datasets(index).select(F.explode_outer(entries).alias("e")).select("e.*").filter("value IS NOT NULL").distinct()
    )
    count = raw.filter("section = 'dataset_count'").agg(F.count("*").cast("string").alias("value")).select(
        F.lit("dataset_count").alias("section"), "value"
    )
    protocols = raw.filter("section = 'protocol'")
    names = raw.filter("section IN ('institution', 'keyword')").filter(
        (F.trim("value") != "") & ~((F.col("section") == "keyword") & is_qc_keyword(F.col("value")))
    )
    cleaned = names.select("section", clean_title(F.col("value")).alias("value")).distinct()
    return count.unionByName(protocols).unionByName(cleaned)
