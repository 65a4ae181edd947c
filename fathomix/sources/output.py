"""Writing subsets in the common output formats, and the observation store layout."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F, types as T

from fathomix.functions.times import iso_text, zoneless_time
from fathomix.operators.columns import add_units

# Format names; a trailing 0 means no header, p means units in the header.
TEXT_FORMATS = {
    "csv": (",", True, False),
    "csv0": (",", False, False),
    "csvp": (",", True, True),
    "tsv": ("\t", True, False),
    "tsv0": ("\t", False, False),
    "tsvp": ("\t", True, True),
}
PLAIN_FORMATS = {"json": "json", "jsonlKVP": "json", "parquet": "parquet", "orc": "orc"}


def write_subset(
    rows: DataFrame,
    path: str,
    fmt: str = "csv",
    units: Mapping[str, str] | None = None,
    mode: str = "errorifexists",
) -> None:
    """Write ``rows`` as one of the supported formats, one file per task."""
    if fmt not in TEXT_FORMATS and fmt not in PLAIN_FORMATS:
        raise ValueError(f"format {fmt!r} is not supported; use {sorted([*TEXT_FORMATS, *PLAIN_FORMATS])}")
    if PLAIN_FORMATS.get(fmt) in ("parquet", "orc"):
        rows.write.mode(mode).format(PLAIN_FORMATS[fmt]).save(path)
        return
    # Text keeps microseconds only where times are written as such.
    text = rows.select(
        *(
            iso_text(zoneless_time(F.col(f.name), f.dataType)).alias(f.name)
            if isinstance(f.dataType, (T.TimestampNTZType, T.TimestampType))
            else F.col(f.name)
            for f in rows.schema
        )
    )
    if fmt in PLAIN_FORMATS:
        text.write.mode(mode).json(path)
        return
    separator, header, with_units = TEXT_FORMATS[fmt]
    named = add_units(text, dict(units or {})) if with_units else text
    named.write.mode(mode).option("sep", separator).option("header", str(header).lower()).csv(path)


def store_observations(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Store observations so that reading one dataset touches few files.

    Ranges over dataset and row number keep neighbours together and split a long dataset
    over many files, where one folder per dataset would not.
    """
    laid_out = rows.repartitionByRange("dataset_id", "row_idx")
    laid_out.sortWithinPartitions("dataset_id", "row_idx").write.mode(mode).parquet(path)
