"""Tables that are kept up to date by small changes: versions in a folder, the last complete one counts.

``CoverageView`` keeps each file's share of the coverage, so that new files are read once and
replaced or deleted ones are taken back. ``Registry`` keeps a base and the changes after it,
merges them when it is read, and folds them into a new base when asked.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from fathomix.functions.numbers import without_nan
from fathomix.operators.conversation import latest_entries
from fathomix.operators.coverage import coverage_of_ranges
from fathomix.operators.skew import lookup_join
from fathomix.session import materialize
from fathomix.sources.tables import normalize_observations


def versions(spark: SparkSession, path: str, name: str) -> list[int]:
    """Numbers of the complete versions ``path/name=N``, ascending."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    done = files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(folder, f"{name}=*/_SUCCESS"))
    return sorted(int(s.getPath().getParent().getName().partition("=")[2]) for s in done or ())


_RANGES = tuple(f"{axis}_{end}" for axis in ("time", "lat", "lon") for end in ("min", "max"))
_FILE = ["file", "modified", "bytes"]


@dataclass(frozen=True)
class CoverageView:
    """Coverage of the Parquet observations below ``source``, kept at ``path``."""

    spark: SparkSession
    source: str
    path: str

    def _files(self) -> DataFrame:
        listed = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option(
            "pathGlobFilter", "*.parquet").load(self.source)
        return listed.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("modified"),
                             F.col("_metadata.file_size").alias("bytes"), "path")

    def refresh(self) -> int:
        """Read what is new, take back what is gone, write the next version; the number of files read."""
        files = materialize(self._files())
        number, kept = 0, None
        done = versions(self.spark, self.path, "version")
        if done:
            number = done[-1] + 1
            before = self.spark.read.parquet(f"{self.path}/version={done[-1]}")
            kept = lookup_join(before, files, _FILE, "left_semi")
            fresh = files.join(before.select(*_FILE).distinct(), _FILE, "left_anti")
        else:
            fresh = files
        fresh = materialize(fresh)
        # The scan of these files holds the same list.
        names = [r["path"] for r in fresh.select("path").collect()]
        parts = self._parts(names, fresh) if names else None
        both = parts if kept is None else kept if parts is None else kept.unionByName(parts)
        if both is None:
            both = self._empty(files)
        both.write.parquet(f"{self.path}/version={number}")
        return len(names)

    def _parts(self, names: Sequence[str], fresh: DataFrame) -> DataFrame:
        rows = self.spark.read.parquet(*names)
        observed = normalize_observations(rows.select("*", F.col("_metadata.file_path").alias("file")), ["file"])
        shares = without_nan(observed, "lat", "lon").groupBy("file", "dataset_id").agg(
            F.count("*").alias("rows"),
            *[(F.min if c.endswith("min") else F.max)(c[:-4]).alias(c) for c in _RANGES])
        # A file without rows leaves its mark as well, so that it is not read again.
        marked = fresh.join(shares, "file", "left")
        return marked.select(*_FILE, "dataset_id", F.coalesce("rows", F.lit(0)).alias("rows"), *_RANGES)

    def _empty(self, files: DataFrame) -> DataFrame:
        kinds = {c: "timestamp_ntz" if c.startswith("time") else "double" for c in _RANGES}
        return files.limit(0).select(*_FILE, F.lit(None).cast("string").alias("dataset_id"), F.lit(0).cast("long").alias("rows"),
                                     *[F.lit(None).cast(k).alias(c) for c, k in kinds.items()])

    def coverage(self) -> DataFrame:
        """The coverage as of the last refresh, in the form constraints expect."""
        done = versions(self.spark, self.path, "version")
        if not done:
            raise ValueError(f"no coverage has been completed below {self.path}")
        shares = self.spark.read.parquet(f"{self.path}/version={done[-1]}").filter("rows > 0")
        ranges = shares.groupBy("dataset_id").agg(
            F.min("time_min").alias("first"), F.max("time_max").alias("last"),
            *[(F.min if c.endswith("min") else F.max)(c).alias(c) for c in _RANGES[2:]])
        return coverage_of_ranges(ranges)


@dataclass(frozen=True)
class Registry:
    """Entries by ``keys``, the one with the highest ``sequence`` of each, kept at ``path``."""

    spark: SparkSession
    path: str
    keys: tuple[str, ...]
    sequence: str

    def _parts(self) -> tuple[list[int], list[int]]:
        bases = versions(self.spark, self.path, "base")
        last = bases[-1] if bases else -1
        return bases[-1:], [d for d in versions(self.spark, self.path, "delta") if d > last]

    def apply(self, updates: DataFrame) -> int:
        """Store changes as the next delta, each key once; the delta's number."""
        bases, deltas = self._parts()
        number = max([-1, *bases, *deltas]) + 1
        latest_entries(updates, self.keys, self.sequence).write.parquet(f"{self.path}/delta={number}")
        return number

    def read(self) -> DataFrame:
        """All entries: the base and the deltas after it, merged."""
        bases, deltas = self._parts()
        paths = [f"{self.path}/base={n}" for n in bases] + [f"{self.path}/delta={n}" for n in deltas]
        if not paths:
            raise ValueError(f"the registry at {self.path} is empty")
        schema = self.spark.read.parquet(paths[0]).schema
        return latest_entries(self.spark.read.schema(schema).parquet(*paths), self.keys, self.sequence)

    def compact(self) -> None:
        """Write the merged entries as a base that stands for all deltas so far, sorted by key."""
        bases, deltas = self._parts()
        if deltas:
            self.read().repartitionByRange(*self.keys).sortWithinPartitions(*self.keys).write.parquet(f"{self.path}/base={deltas[-1]}")
