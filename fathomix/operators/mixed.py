"""Observations of datasets whose variables differ, in one table.

A row holds ``dataset_id``, ``row_idx`` and ``values``, a map from the dataset's own column names
to numbers. A wanted name is found in each dataset by the rules that ``resolve_column`` applies
to one table: as written, then in any case, then by alias, after units are stripped and
coordinates shortened. A dataset that has no such column, or several that are called alike once
their units are gone, is a row with the reason.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from fathomix.functions.numbers import null_if_nan
from fathomix.operators.columns import VARIABLE_ALIASES
from fathomix.operators.skew import lookup_join
from fathomix.session import materialize


def plain_name(name: Column) -> Column:
    """A header without its units and with short coordinates, as ``clean_headers`` gives it."""
    bare = F.regexp_replace(name, r"\s*\([^)]*\)$", "")
    return F.when(bare == "latitude", F.lit("lat")).when(bare == "longitude", F.lit("lon")).otherwise(bare)


def variables_of(rows: DataFrame) -> DataFrame:
    """``dataset_id, column, name, pos``: the columns each dataset has, and the last place where each stands."""
    listed = rows.select("dataset_id", F.posexplode(F.map_keys("values")).alias("pos", "column"))
    return listed.groupBy("dataset_id", "column").agg(F.max("pos").alias("pos")).withColumn("name", plain_name(F.col("column")))


def resolved_names(variables: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """``dataset_id, wanted, column, reason`` of every dataset and wanted name.

    ``reason`` is null where ``column`` was found. Of columns that differ only by case the last
    one counts.
    """
    variables = materialize(variables)
    tries = []
    for name in dict.fromkeys(wanted):
        lowered = name.lower()
        tries += [(name, 0, lowered), (name, 1, lowered)]
        if lowered in VARIABLE_ALIASES:
            tries.append((name, 2, VARIABLE_ALIASES[lowered]))
    listed = F.array(*[F.struct(F.lit(w).alias("wanted"), F.lit(r).alias("rule"), F.lit(l).alias("lowered")) for w, r, l in tries])
    asked = variables.select("dataset_id").distinct().select("dataset_id", F.explode(listed).alias("t")).select("dataset_id", "t.*")
    same = variables.groupBy("dataset_id", "name").agg(F.count("*").alias("n"))
    known = lookup_join(variables, same, ["dataset_id", "name"], nulls=True).select(
        "dataset_id", F.lower("name").alias("lowered"), "name", "column", "pos", "n")
    met = lookup_join(asked, known, ["dataset_id", "lowered"], "left", nulls=True)
    met = met.filter((F.col("rule") > 0) | F.col("name").isNull() | (F.col("name") == F.col("wanted")))
    first = F.min_by(F.struct("column", "name", "n"), F.when(F.col("name").isNotNull(), F.struct("rule", -F.col("pos"))))
    best = met.groupBy("dataset_id", "wanted").agg(first.alias("best"))
    reason = F.when(F.col("best.column").isNull(), F.concat(F.lit("no column matches "), "wanted")).when(
        F.col("best.n") > 1, F.concat(F.lit("several columns are named "), F.col("best.name")))
    return best.select("dataset_id", "wanted", F.when(reason.isNull(), F.col("best.column")).alias("column"), reason.alias("reason"))


def pick_mixed(rows: DataFrame, names: DataFrame, **wanted: str) -> DataFrame:
    """``alias=name`` numbers of the datasets that have all wanted names, with the rows' other columns.

    ``names`` is the stored result of ``resolved_names``.
    """
    chosen = names.filter(F.col("wanted").isin(*wanted.values())).groupBy("dataset_id").agg(
        F.map_from_entries(F.collect_list(F.struct("wanted", "column"))).alias("_names"),
        F.count("reason").alias("_missing")).filter("_missing = 0").drop("_missing")
    joined = lookup_join(rows, materialize(chosen), ["dataset_id"], salt_by=["dataset_id", "row_idx"], nulls=True)
    values = [null_if_nan(F.try_element_at("values", F.try_element_at("_names", F.lit(n)))).alias(a) for a, n in wanted.items()]
    return joined.select(*[c for c in rows.columns if c != "values"], *values)
