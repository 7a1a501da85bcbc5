"""Strongest origin-destination corridors of each period."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoflow.functions.periods import Periods
from geoflow.operators.density import label_counts, totals_with_dominant

ROUTE = ["period_idx", "from_region_idx", "to_region_idx"]


def corridor_totals(moves: DataFrame) -> DataFrame:
    """Moves and dominant cause per period and pair, from counts per cause."""
    counts = label_counts(moves, ROUTE, "cause_label")
    return totals_with_dominant(counts, ROUTE, "cause_label", "migrations", "top_cause")


def top_per_period(df: DataFrame, value: str, ties: list[str], k: int, period: str = "period_idx") -> DataFrame:
    """The k largest rows of each period; each task keeps only k rows per period before the shuffle."""
    order = Window.partitionBy(period).orderBy(F.col(value).desc(), *ties)
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def corridors(moves: DataFrame, regions: DataFrame, periods: Periods, k: int = 250) -> DataFrame:
    """Top corridors with both ends described; regions are joined to the k rows only."""
    ranked = top_per_period(corridor_totals(moves), "migrations", ["from_region_idx", "to_region_idx"], k)

    def end(side: str, position: str) -> DataFrame:
        return regions.select(
            F.col("region_idx").alias(position),
            F.col("region_id").alias(f"{side}_id"),
            F.col("name").alias(f"{side}_name"),
            F.col("lat").alias(f"{side}_lat"),
            F.col("lon").alias(f"{side}_lon"),
            F.col("continent").alias(f"{side}_continent"),
        )

    described = (
        ranked.where(F.col("period_idx").between(0, periods.last))
        .join(end("src", "from_region_idx"), "from_region_idx")
        .join(end("dst", "to_region_idx"), "to_region_idx")
    )
    return described.select(
        "period_idx",
        periods.first_year(F.col("period_idx")).alias("period_year"),
        *[f"{side}_{c}" for side in ("src", "dst") for c in ("id", "name", "lat", "lon", "continent")],
        "migrations",
        "top_cause",
    )


def strongest_corridor(table: DataFrame, period: int) -> DataFrame:
    order = [F.col("migrations").desc(), "src_id", "dst_id"]
    return table.where(F.col("period_idx") == period).orderBy(*order).limit(1)
