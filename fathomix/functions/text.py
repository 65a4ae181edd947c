"""Text expressions: addresses, titles, quality-control names, labels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Words that mark a quality-control variable or keyword.
QC_WORDS = ("qc", "qartod")
QC_SUFFIX = "flag"

# Fixed value: the sentence on a table server's front page that states its size.
LISTED_COUNT_PATTERN = r"View a List of All ([\d,]+) Datasets"

# Fixed value.
LABEL_WIDTH = 35


def contains_text(column: Column, query: str) -> Column:
    """Case-insensitive substring test; ``%`` and ``_`` in the query are plain characters."""
    return F.lower(column).contains(query.lower())


def _without_query_and_fragment(url: Column) -> Column:
    return F.split_part(F.split_part(url, F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1))


def table_server_base(url: Column) -> Column:
    """Base address of a table server, whichever of its pages ``url`` points at."""
    plain = _without_query_and_fragment(url)
    # Fixed value: the server's address pattern.
    base = F.regexp_extract(plain, r"(?i)(https?://[^/]+/erddap)", 1)
    other = F.regexp_replace(F.rtrim(plain, F.lit("/")), r"/index\.html\z", "")
    return F.when(base != "", base).otherwise(other)


def catalog_address(url: Column) -> Column:
    """Address of a file server's catalog document for any catalog page ``url``."""
    plain = F.rtrim(_without_query_and_fragment(url), F.lit("/"))
    return (
        F.when(plain.endswith("catalog.html"), F.regexp_replace(plain, r"html\z", "xml"))
        .when(plain.endswith(".xml") | plain.endswith(".html"), plain)
        .otherwise(F.concat(plain, F.lit("/catalog.xml")))
    )


def clean_title(raw: Column) -> Column:
    """``invented_seas_bureau`` -> ``Invented Seas Bureau``; null -> empty text.

    Every run of cased letters starts with a capital, so ``o'neil 3d`` becomes
    ``O'Neil 3D``, which plain ``initcap`` would not do.
    """
    spaced = F.replace(F.btrim(raw, F.lit("_ ")), F.lit("_"), F.lit(" "))
    cased = r"\p{IsLowercase}\p{IsUppercase}\p{IsTitlecase}"
    runs = F.regexp_extract_all(F.lower(spaced), F.lit(f"([{cased}]+|[^{cased}]+)"), F.lit(1))
    return F.coalesce(F.array_join(F.transform(runs, F.initcap), ""), F.lit(""))


def is_qc_variable(name: Column) -> Column:
    """Whether a variable name marks a quality-control column."""
    return is_qc_keyword(name) | F.lower(name).endswith(QC_SUFFIX)


def is_qc_keyword(keyword: Column) -> Column:
    """Whether a free-text keyword is about quality control (no suffix rule)."""
    lowered = F.lower(keyword)
    hit = F.lit(False)
    for word in QC_WORDS:
        hit = hit | lowered.contains(word)
    return hit


def numeric_value(text: Column) -> Column:
    """The number an attribute holds, or null where it holds other text.

    A trailing ``d`` or ``f`` is a JVM-only spelling of a number and counts as text.
    """
    jvm_only = text.rlike(r"[0-9.][dDfF]\s*$")
    return F.when(~jvm_only, text.try_cast("double"))


def listed_dataset_count(html: Column) -> Column:
    """Dataset count stated on a table server's front page; null where it states none."""
    digits = F.regexp_extract(html, LISTED_COUNT_PATTERN, 1)
    return F.replace(digits, F.lit(","), F.lit("")).try_cast("bigint")


def short_label(text: Column) -> Column:
    return F.substring(text, 1, LABEL_WIDTH)


def path_text(path: Column) -> Column:
    """Catalog names joined with `` > ``; ``(root)`` for the top level."""
    return F.when(F.size(path) == 0, F.lit("(root)")).otherwise(F.array_join(path, " > "))


def color_label(variable: Column, units: Column) -> Column:
    """``name (units)``, or the bare name where units are unknown or empty."""
    return F.when(units != "", F.format_string("%s (%s)", variable, units)).otherwise(variable)


def detail_text(**parts: Column) -> Column:
    """``key: value`` pairs joined with commas, leaving out the null ones."""
    pairs = [F.concat(F.lit(f"{key}: "), value) for key, value in parts.items()]
    return F.concat_ws(", ", *pairs)


def time_range_text(start: Column, end: Column) -> Column:
    return F.when(start != "", F.format_string("%s to %s", start, end)).otherwise(
        F.lit("not specified in metadata")
    )
