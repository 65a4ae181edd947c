"""Plot-ready points for one dataset, many datasets or a whole region.

Each job gives a points DataFrame and a summary DataFrame; drawing them is the viewer's
work. Scatter plots drop incomplete rows and then thin; maps thin first and then drop.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from fathomix.functions.numbers import fixed_hover_text, hover_text
from fathomix.functions.text import color_label
from fathomix.operators.attributes import info_box, label_records, variable_units
from fathomix.operators.columns import drop_missing, needed_columns, pick
from fathomix.operators.constraints import (
    Bounds,
    coverage_bounds,
    resolve_bounds,
    rows_in_bounds,
)
from fathomix.operators.discovery import search_index
from fathomix.operators.mixed import pick_mixed, resolved_names, variables_of
from fathomix.operators.nested import flatten, with_row_order
from fathomix.operators.sampling import BLOCK_ROWS, block_counts, first_ranked, palette_slot, thin, unique_results
from fathomix.operators.skew import lookup_join
from fathomix.operators.summaries import extents, pooled_view, track_centers
from fathomix.session import materialize, materialize_counted

IDENTITY = {"dataset_id": "dataset_id", "row_idx": "row_idx"}


@dataclass(frozen=True)
class PlotData:
    points: DataFrame
    summary: DataFrame


def constrained(
    observations: DataFrame,
    coverage: DataFrame | None,
    bounds: Bounds | None,
    as_of: Column | None = None,
) -> DataFrame:
    """Table-server rows of all datasets inside their bounds; no coverage, no filter."""
    if coverage is None:
        return observations
    resolved = resolve_bounds(coverage, bounds) if bounds else coverage_bounds(coverage)
    return rows_in_bounds(observations, resolved, as_of)


def nested_rows(
    nested: DataFrame, plot: str, x: str | None = None, y: str | None = None,
    color: str | None = None, bounds: Bounds | None = None,
) -> DataFrame:
    """File-server rows for one kind of plot, each trajectory as a dataset of its own."""
    needed = needed_columns(plot, x, y, color, file_server=True)
    rows = with_row_order(flatten(nested, needed, bounds, keys=["trajectory"]))
    return rows.withColumnRenamed("trajectory", "dataset_id")


def scatter_points(
    rows: DataFrame,
    x: str,
    y: str,
    color: str | None = None,
    step: int = 1,
    drop_on: tuple[str, ...] = ("x", "y"),
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Points ``dataset_id, row_idx, x, y[, color]``: complete rows, then every Nth."""
    wanted = {**IDENTITY, "x": x, "y": y, **({"color": color} if color else {})}
    return thin(drop_missing(pick(rows, **wanted), *drop_on), step, block_rows=block_rows)


def _titled(summary: DataFrame, title: str, attributes: DataFrame | None) -> DataFrame:
    named = summary.withColumn("title", F.lit(title))
    if attributes is None:
        return named
    labels = materialize(info_box(label_records(attributes)))
    return lookup_join(named, labels, ["dataset_id"], "left")


def _scatter_job(
    rows: DataFrame, x: str, y: str, color: str | None, step: int, title: str,
    attributes: DataFrame | None, invert_y: bool = False,
) -> PlotData:
    points = scatter_points(rows, x, y, color, step)
    summary = _titled(extents(points), title, attributes).withColumn("invert_y", F.lit(invert_y))
    return PlotData(points, summary)


def timeseries(rows: DataFrame, y: str, color: str | None = None, step: int = 1,
               attributes: DataFrame | None = None) -> PlotData:
    """A variable against time."""
    return _scatter_job(rows, "time", y, color, step, f"{y} vs time", attributes)


def mixed_timeseries(rows: DataFrame, y: str, color: str | None = None, step: int = 1) -> tuple[PlotData, DataFrame]:
    """A variable against time for datasets that may each call it differently.

    ``rows`` have ``time`` and a map of ``values``; the second result lists the datasets that
    are not plotted, with the reason.
    """
    wanted = {"y": y, **({"color": color} if color else {})}
    names = materialize(resolved_names(variables_of(rows), list(wanted.values())))
    picked = pick_mixed(rows, names, **wanted).withColumnRenamed("time", "x")
    points = thin(drop_missing(picked.select("dataset_id", "row_idx", "x", *wanted), "x", "y"), step)
    job = PlotData(points, _titled(extents(points), f"{y} vs time", None).withColumn("invert_y", F.lit(False)))
    return job, names.filter("reason IS NOT NULL").select("dataset_id", "wanted", "reason")


def profile(rows: DataFrame, x: str, color: str | None = None, step: int = 1,
            attributes: DataFrame | None = None) -> PlotData:
    """A variable against depth, depth growing downwards."""
    return _scatter_job(rows, x, "depth", color, step, f"{x} profile", attributes, invert_y=True)


def custom(rows: DataFrame, x: str, y: str = "time", color: str | None = None, step: int = 1,
           attributes: DataFrame | None = None) -> PlotData:
    """Any variable against any other."""
    return _scatter_job(rows, x, y, color, step, f"{x} vs {y}", attributes)


def map_points(rows: DataFrame, color: str | None = None, step: int = 1,
               block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Positions ``dataset_id, row_idx, lat, lon[, color]``: every Nth row, then complete ones."""
    wanted = {**IDENTITY, "lat": "lat", "lon": "lon", **({"color": color} if color else {})}
    return drop_missing(thin(pick(rows, **wanted), step, block_rows=block_rows), "lat", "lon")


def trajectory_map(rows: DataFrame, color: str | None = None, step: int = 1,
                   attributes: DataFrame | None = None) -> PlotData:
    """Positions with hover text, and the centre of each dataset's map."""
    points = map_points(rows, color, step)
    if color is None:
        hover = hover_text(F.col("lat"), F.col("lon"))
    else:
        points = _with_color_label(points, color, attributes)
        hover = hover_text(F.col("lat"), F.col("lon"), color=F.col("color"), label=F.col("color_label"))
    summary = track_centers(points).withColumn(
        "title", F.concat(F.lit("Flight path: "), F.col("dataset_id"))
    )
    return PlotData(points.withColumn("hover", hover), summary)


def _with_color_label(points: DataFrame, color: str, attributes: DataFrame | None) -> DataFrame:
    if attributes is None:
        return points.withColumn("color_label", F.lit(color))
    declared = variable_units(attributes.filter(F.col("variable_name") == color))
    units = materialize(declared.select("dataset_id", "units"))
    labelled = lookup_join(points, units, ["dataset_id"], "left",
                           salt_by=["dataset_id", "row_idx"])
    return labelled.withColumn("color_label", color_label(F.lit(color), F.col("units"))).drop("units")


@dataclass(frozen=True)
class RegionMap:
    points: DataFrame
    summary: DataFrame
    tracks: DataFrame


def region_map(
    index: DataFrame,
    coverage: DataFrame,
    observations: DataFrame,
    bounds: Bounds,
    query: str = "all",
    max_datasets: int = 10,
    step: int = 25,
    as_of: Column | None = None,
    block_rows: int = BLOCK_ROWS,
) -> RegionMap:
    """Positions of the first ``max_datasets`` datasets with data in a region.

    Datasets are found by query and coverage, capped in rank order, and only then read;
    those without rows in their bounds are skipped. ``tracks`` lists the capped datasets
    with their slot, or null where skipped. ``summary`` is one row.
    """
    bounds.require_box()
    found, total = materialize_counted(
        unique_results(search_index(index, query, bounds=bounds, as_of=as_of), ["dataset_id"])
    )
    capped, n_capped = materialize_counted(first_ranked(found, max_datasets, name="slot_order"))

    rows = observations.select("dataset_id", "row_idx", "time", "lat", "lon")
    covered = lookup_join(coverage, capped.select("dataset_id"), ["dataset_id"], "left_semi")
    inside = rows_in_bounds(rows, resolve_bounds(covered, bounds), as_of)
    counts = block_counts(inside, block_rows=block_rows)
    loaded = counts.groupBy(F.col("_keys.dataset_id").alias("dataset_id")).agg(F.sum("_rows").alias("n_rows"))
    placed = first_ranked(capped.join(loaded, "dataset_id"), max_datasets, "slot_order")
    slots = placed.select("dataset_id", "n_rows", palette_slot(F.col("place")).alias("slot"))
    tracks = materialize(capped.join(slots, "dataset_id", "left"))
    points = lookup_join(
        drop_missing(thin(inside, step, block_rows=block_rows, counts=counts), "lat", "lon"),
        tracks.select("dataset_id", "slot"), ["dataset_id"],
        salt_by=["dataset_id", "row_idx"],
    ).select("dataset_id", "row_idx", "lat", "lon", "slot")
    plotted = tracks.agg(F.count("slot")).scalar()
    summary = pooled_view(points).select(
        "*",
        F.lit(total).cast("long").alias("total_found"),
        plotted.alias("plotted"),
        (F.lit(n_capped).cast("long") - plotted).alias("skipped"),
        F.lit(total > max_datasets).alias("capped"),
        F.when(plotted == 0, F.lit("none of the datasets could be plotted"))
        .when(F.col("n_points") == 0, F.lit("no dataset has a position to plot"))
        .alias("error"),
    )
    return RegionMap(points, summary, tracks)


def colored_depth(rows: DataFrame, color: str, step: int = 1) -> PlotData:
    """The older time-depth scatter: rows without the colour value drop, others stay."""
    points = scatter_points(rows, "time", "depth", color, step, drop_on=("color",))
    summary = extents(points).withColumn("invert_y", F.lit(True))
    return PlotData(points, summary)


def colored_track(rows: DataFrame, step: int = 1, block_rows: int = BLOCK_ROWS) -> PlotData:
    """The older map coloured by temperature, dropping on temperature only."""
    wanted = {n: n for n in ("time", "lat", "lon", "temperature", "depth")}
    full = drop_missing(pick(rows, **IDENTITY, **wanted), "temperature")
    points = thin(full, step, block_rows=block_rows)
    hover = fixed_hover_text(F.col("time"), F.col("temperature"), F.col("depth"))
    return PlotData(points.withColumn("hover", hover), track_centers(points))
