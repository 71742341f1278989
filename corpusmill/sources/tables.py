"""Scans, the registry of named sources and prompt tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill import schemas

READERS = ("parquet", "json", "orc", "csv", "text")


def scan(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | None = None, **options) -> DataFrame:
    """A lazy table scan. JSON, CSV and text need a schema; Parquet and ORC carry their own."""
    if fmt not in READERS:
        raise ValueError(f"unknown format: {fmt}")
    reader = spark.read.options(**options)
    if schema:
        reader = reader.schema(schema)
    return reader.format(fmt).load(path)


def spread_out(df: DataFrame) -> DataFrame:
    """Deal the rows of a scan with fewer splits than cores to all cores; larger scans stay as they are.

    For CPU-bound work on a few row groups. At scale the scan has more splits than cores, and nothing
    is shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def scan_subset(spark: SparkSession, path: str, column: str, name: str) -> DataFrame:
    """One named subset of a table partitioned by ``column``; other directories are not listed."""
    return spark.read.parquet(path).where(F.col(column) == name)


def scan_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1000, **options) -> DataFrame:
    """The same scan as a bounded one-pass file stream; ``path`` is a folder of files or, as in a batch scan, one file."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(place) and files.getFileStatus(place).isFile():  # a stream watches folders
        path, options = place.getParent().toString(), {**options, "pathGlobFilter": place.getName()}
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_trigger)
        .options(**options)
        .parquet(path)
    )


def reload_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    """One split of a saved table, read from its directory only."""
    return scan_subset(spark, path, "split", split)


def prompts_from_json(spark: SparkSession, path: str) -> DataFrame:
    """A JSON list of prompts; a missing ``max_tokens`` is 200, a missing category ``general``."""
    raw = spark.read.schema(schemas.PROMPTS).option("multiLine", True).json(path)
    return raw.fillna({"max_tokens": 200, "category": "general"})


@dataclass(frozen=True)
class Source:
    """Where a source lives and the DataFrame -> DataFrame function that formats its rows.

    The formatter gives at least ``text`` (NULL rejects a row). ``subset`` is a partition
    (column, value) to read instead of the whole table.
    """

    path: str
    formatter: Callable[[DataFrame], DataFrame]
    fmt: str = "parquet"
    schema: str | None = None
    subset: tuple[str, str] | None = None
    description: str = ""


@dataclass
class SourceRegistry:
    """Named sources. An unknown name and an unreadable path raise; no source is skipped silently."""

    sources: dict[str, Source] = field(default_factory=dict)

    def add(self, name: str, source: Source) -> None:
        self.sources[name] = source

    def load(self, spark: SparkSession, name: str) -> DataFrame:
        if name not in self.sources:
            raise ValueError(f"Unknown dataset: {name}")
        source = self.sources[name]
        raw = scan(spark, source.path, source.fmt, source.schema)
        if source.subset:
            column, value = source.subset
            raw = raw.where(F.col(column) == value)
        return source.formatter(raw).withColumn("source", F.lit(name))

    def load_all(self, spark: SparkSession, names: list[str]) -> DataFrame:
        """The union of several sources by column name."""
        first, *rest = [self.load(spark, n) for n in names]
        for other in rest:
            first = first.unionByName(other, allowMissingColumns=True)
        return first


def map_batches(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """Vectorised Python over row batches (pandas in, pandas out), for user code such as tokenizers."""

    def run(batches):
        for batch in batches:
            yield function(batch)

    return df.mapInPandas(run, schema)
