"""Observations kept with their positions, in buckets that numbering reads in place.

Row numbers, caps and every-Nth thinning need a row's position in its dataset. Stored once per
row, an unfiltered thinning is a test on each row where it lies. For filtered rows positions
have to be counted anew, but the store's layout spares the shuffle: a dataset is cut into
blocks of neighbouring rows, rows are bucketed and sorted by dataset and block, and windows and
joins over those two columns run inside the buckets. Only counts per block move. Datasets are
spread over folders by a hash, so reading some of them leaves the other folders alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from fathomix.operators.sampling import BLOCK_ROWS, with_position
from fathomix.operators.skew import lookup_join
from fathomix.session import materialize

PARTS = 64
# Columns that the store adds: the dataset as text that is never null, and the layout.
LAYOUT = ("store_key", "store_block", "position", "part")


def _key(dataset: Column) -> Column:
    return F.when(dataset.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), dataset.cast("string")))


def _part(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


@dataclass(frozen=True)
class NumberedStore:
    """Stored rows with ``LAYOUT`` columns, and the rows and first position of each block."""

    rows: DataFrame
    blocks: DataFrame
    parts: int

    def of_datasets(self, datasets: DataFrame) -> DataFrame:
        """Rows of the datasets listed in ``dataset_id``, whatever their number, reading their folders only."""
        keyed = datasets.select(_key(F.col("dataset_id")).alias("store_key")).distinct().withColumn(
            "part", _part(F.col("store_key"), self.parts))
        keyed = materialize(keyed)
        # At most ``parts`` numbers, so they always fit into the scan's filter.
        wanted = [r["part"] for r in keyed.select("part").distinct().collect()]
        near = self.rows.filter(F.col("part").isin(wanted))
        return lookup_join(near, keyed.select("store_key"), ["store_key"], "left_semi", salt_by=["store_key", "position"])


def write_numbered(
    observations: DataFrame, path: str, table: str, parts: int = PARTS, buckets: int | None = None,
    block_rows: int = BLOCK_ROWS, order: str = "row_idx",
) -> NumberedStore:
    """Number, lay out and store ``observations`` as the external ``table`` at ``path``.

    ``order`` is unique per dataset. Rows move once, here.
    """
    spark = observations.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    numbered = with_position(observations, ["dataset_id"], order, "position")
    laid_out = numbered.withColumn("store_key", _key(F.col("dataset_id"))).withColumns({
        "store_block": F.expr(f"position div {block_rows}L"), "part": _part(F.col("store_key"), parts)})
    # The writers' tasks are the buckets, so every bucket is one file in a folder.
    laid_out.repartition(buckets, "store_key", "store_block").write.format("parquet").partitionBy("part").bucketBy(
        buckets, "store_key", "store_block").sortBy("store_key", "store_block", "position").option(
        "path", f"{path}/rows").saveAsTable(table)
    rows = spark.table(table)
    rows.groupBy("store_key", "store_block").agg(
        F.count("*").alias("n_rows"), F.min("position").alias("first")).write.parquet(f"{path}/blocks")
    spark.createDataFrame([(parts, buckets)], "parts int, buckets int").write.parquet(f"{path}/layout")
    return NumberedStore(rows, spark.read.parquet(f"{path}/blocks"), parts)


def open_numbered(spark: SparkSession, path: str, table: str) -> NumberedStore:
    """The store at ``path`` in a session whose catalog does not know it yet, as ``table``."""
    layout = spark.read.parquet(f"{path}/layout").first()
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(f"{path}/rows").schema
                      if f.name != "part")
    spark.sql(
        f"CREATE TABLE {table} ({kinds}, part INT) USING parquet PARTITIONED BY (part) CLUSTERED BY (store_key, store_block) "
        f"SORTED BY (store_key, store_block, position) INTO {layout['buckets']} BUCKETS LOCATION '{path}/rows'")
    spark.sql(f"MSCK REPAIR TABLE {table}")
    return NumberedStore(spark.table(table), spark.read.parquet(f"{path}/blocks"), layout["parts"])


def thin_all(store: NumberedStore, step: int) -> DataFrame:
    """Every ``step``-th row of each stored dataset: a test on the stored position, no row moves."""
    if step < 1:
        raise ValueError(f"step must be at least 1, got {step}")
    return store.rows.filter(F.col("position") % step == 0)


def thin_stored(rows: DataFrame, step: int) -> DataFrame:
    """Every ``step``-th of the rows left in each dataset, as ``thin`` keeps them.

    ``rows`` are a store's rows after any filters, column choices or broadcast joins that keep
    the ``LAYOUT`` columns; they are numbered inside their buckets.
    """
    if step < 1:
        raise ValueError(f"step must be at least 1, got {step}")
    if step == 1:
        return rows
    keys = ["store_key", "store_block"]
    counts = materialize(rows.groupBy(*keys).agg(F.count("*").alias("_rows")))
    earlier = Window.partitionBy("store_key").orderBy("store_block").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(*keys, F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    local = F.row_number().over(Window.partitionBy(*keys).orderBy("position")) - 1
    placed = rows.withColumn("_local", local).join(before, keys)
    return placed.filter((F.col("_local") + F.col("_before")) % step == 0).select(*rows.columns)
