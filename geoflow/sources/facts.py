"""Period-partitioned Parquet facts and single result tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoflow.session import cut, file_system, scope, task_count


class MissingInput(FileNotFoundError):
    """A fact table is not there; the message names the stage that makes it."""


def read_facts(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Scan a partitioned table; the period column comes from the directory names."""
    return spark.read.schema(schema).parquet(path)


def read_or_none(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame | None:
    try:
        reader = spark.read if schema is None else spark.read.schema(schema)
        return reader.parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def require_inputs(spark: SparkSession, tables: dict[str, tuple[str, T.StructType]], stage: str = "generate") -> dict:
    """Open every table or say which stage has to run first."""
    opened = {}
    for name, (path, schema) in tables.items():
        df = read_or_none(spark, path, schema)
        if df is None:
            raise MissingInput(f"{name} not found at {path}; run the '{stage}' stage first")
        opened[name] = df
    return opened


def fit(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Names, order and types of the schema."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def _replace(spark: SparkSession, staged: str, path: str) -> None:
    """Put a folder that is written in the place of another: the old one steps aside, the new one takes its name, the old one goes."""
    files, new = file_system(spark, staged)
    _, here = file_system(spark, path)
    _, aside = file_system(spark, f"{path}.old-{uuid.uuid4().hex}")
    files.mkdirs(here.getParent())
    old = files.exists(here)
    if old and not files.rename(here, aside):
        raise OSError(f"{path} cannot be renamed")
    if not files.rename(new, here):
        if old:
            files.rename(aside, here)
        raise OSError(f"{staged} cannot be renamed to {path}")
    if old:
        files.delete(aside, True)


def _staged(spark: SparkSession, path: str, write: Callable[[str], None], parts: bool = False) -> None:
    """Let ``write`` fill a new folder beside ``path``, which takes its place when it is whole; with ``parts`` each folder in it takes its own.

    If the write fails, the old table is as it was.
    """
    path = path.rstrip("/")
    staged = f"{path}.new-{uuid.uuid4().hex}"
    files, folder = file_system(spark, staged)
    try:
        write(staged)
        if not parts:
            _replace(spark, staged, path)
            return
        for entry in files.listStatus(folder):
            if entry.isDirectory() and not entry.getPath().getName().startswith("_"):
                _replace(spark, str(entry.getPath()), f"{path}/{entry.getPath().getName()}")
    finally:
        files.delete(folder, True)


def write_facts(
    df: DataFrame,
    path: str,
    period: str = "period_idx",
    spread: int | None = None,
    only_new_periods: bool = False,
    lookup: str | None = None,
) -> None:
    """One directory per period, the old table replaced when the new one is written.

    ``spread`` gathers a period's rows into that many files, dealt in the order of a kept copy whatever they
    hold, so that no period is written by one task and equal rows are spread as well. Without it every task writes its
    own rows and nothing is shuffled. ``only_new_periods`` replaces only the periods
    that occur in ``df``, one after the other. ``lookup`` names a column by which rows are sorted within a task's part of a period
    and which gets a Bloom filter, so that a search for one value reads few row groups.
    """
    spark = df.sparkSession
    with scope():
        if spread:
            salt = F.pmod(F.monotonically_increasing_id(), F.lit(spread))
            df = cut(df).withColumn("_salt", salt).repartition(task_count(spark), F.col(period), F.col("_salt")).drop("_salt")
        if lookup:
            df = df.sortWithinPartitions(period, lookup)
        writer = df.write.option("compression", "snappy").partitionBy(period)
        if lookup:
            writer = writer.option(f"parquet.bloom.filter.enabled#{lookup}", "true")
        _staged(spark, path, writer.parquet, only_new_periods)


def write_result(df: DataFrame, path: str) -> None:
    _staged(df.sparkSession, path, df.write.option("compression", "snappy").parquet)


#: Periods that are counted: the bits of one bitmap.
COUNTED_PERIODS = 1 << 15


def row_metrics(df: DataFrame, name: str, period: str | None = "period_idx") -> tuple[DataFrame, Observation]:
    """Count rows and distinct periods while ``df`` is written.

    Observed metrics allow no distinct aggregate; a bitmap with a bit for each period counts them
    exactly in the same pass. A period outside 0 to 32,767 fails the write. Without ``period`` only rows are counted.
    """
    seen = Observation(name)
    counts = [F.count(F.lit(1)).alias("rows")]
    if period:
        at = F.col(period).cast("long")
        outside = F.raise_error(F.concat(F.lit(f"period outside 0 to {COUNTED_PERIODS - 1}: "), F.col(period).cast("string"))).cast("long")
        bit = F.when(at.between(0, COUNTED_PERIODS - 1), at).when(at.isNotNull(), outside)
        counts.append(F.bitmap_count(F.bitmap_construct_agg(bit)).cast("int").alias("periods"))
    return df.observe(seen, *counts), seen
