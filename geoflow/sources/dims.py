"""Region dimension and run sizes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoflow.functions.expr import argmax_label, normalise
from geoflow.schemas import GROUPS, MAX_REGIONS, REGION
from geoflow.session import local_frame


def checked_regions(df: DataFrame) -> DataFrame:
    """Fail on an index that does not fit the region bits of a packed id."""
    idx = F.col("region_idx")
    ok = F.when(idx.between(0, MAX_REGIONS - 1), idx).otherwise(
        F.raise_error(F.concat(F.lit("region index outside the id's range: "), idx)).cast("int")
    )
    return df.withColumn("region_idx", ok)


def region_dim(spark: SparkSession, rows: list) -> DataFrame:
    """Regions in list order: position, names, centre, share, radius, dominant group.

    The list has at most 64 rows, which is what the packed id can hold.
    """
    if len(rows) > MAX_REGIONS:
        raise ValueError(f"at most {MAX_REGIONS} regions fit the packed id, not {len(rows)}")
    keyed = T.StructType([T.StructField("region_idx", T.IntegerType(), False), *REGION.fields])
    raw = local_frame(spark, [{**{n: r.get(n) for n in REGION.names}, "region_idx": i} for i, r in enumerate(rows)], keyed)
    groups = normalise(F.col("ethno"))
    return raw.select(
        "region_idx",
        F.col("id").alias("region_id"),
        "name",
        "lat",
        "lon",
        "continent",
        "pop_share",
        F.coalesce("radius_deg", F.lit(4.0)).alias("radius_deg"),
        argmax_label(groups, GROUPS).alias("ethno"),
    )


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    """Regions from a JSON array, positions following the file's order."""
    record = spark.read.schema(REGION).option("multiLine", True).json(path)
    rows = [r.asDict(recursive=True) for r in record.limit(MAX_REGIONS + 1).collect()]
    return region_dim(spark, rows)


@dataclass(frozen=True)
class Scale:
    """Size of a run: people and moves to make, and shuffle partitions."""

    name: str
    initial: int
    shuffle_partitions: int

    @property
    def people(self) -> int:
        return max(30 * self.initial, 50_000)

    @property
    def moves(self) -> int:
        return max(20 * self.initial, 30_000)


# The four presets.
SCALES = {
    "tiny": Scale("tiny", 20_000, 4),
    "small": Scale("small", 200_000, 16),
    "medium": Scale("medium", 2_000_000, 64),
    "big": Scale("big", 20_000_000, 512),
}


def run_size(df: DataFrame, initial: str = "initial") -> DataFrame:
    """People and moves to make for an initial population, as ``Scale`` has it."""
    n = F.col(initial)
    return df.select(
        n,
        F.greatest(n * 30, F.lit(50_000).cast("long")).alias("people"),
        F.greatest(n * 20, F.lit(30_000).cast("long")).alias("moves"),
    )


def targets(spark: SparkSession) -> DataFrame:
    rows = [
        {"scale": s.name, "initial": s.initial, "people": s.people, "moves": s.moves, "shuffle_partitions": s.shuffle_partitions}
        for s in SCALES.values()
    ]
    return local_frame(spark, rows, "scale string, initial long, people long, moves long, shuffle_partitions int")
