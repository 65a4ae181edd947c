"""Observations that keep arriving as files.

Cleaning, filtering and projection are the same functions as for stored tables. Thinning
needs a dataset's whole order and stays with stored tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.streaming import StreamingQuery

from fathomix.operators.coverage import observed_coverage
from fathomix.sources.tables import normalize_observations


def follow_observations(
    spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet",
    files_per_batch: int | None = None,
) -> DataFrame:
    """Stream of normalized observations from the files arriving in a folder."""
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return normalize_observations(reader.load(path))


def store_arrivals(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append every arriving row once to a Parquet store; stops when nothing is left."""
    return (
        rows.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def follow_coverage(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write the coverage after every batch as a version of its own below ``path``.

    ``latest_coverage`` reads the last complete version, so readers never meet a half-written
    table and a failed write loses nothing. A repeated batch writes its version again.
    """

    def replace(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/version={number}")

    return (
        observed_coverage(rows)
        .writeStream.outputMode("complete")
        .foreachBatch(replace)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def latest_coverage(spark: SparkSession, path: str) -> DataFrame:
    """The last version that ``follow_coverage`` completed."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    done = files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(folder, "version=*/_SUCCESS"))
    versions = [int(s.getPath().getParent().getName().partition("=")[2]) for s in done or ()]
    if not versions:
        raise ValueError(f"no coverage has been completed below {path}")
    return spark.read.parquet(f"{path}/version={max(versions)}")
