"""Views between two adjacent periods."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoflow.functions.expr import density_ratio, direction_score
from geoflow.operators.corridors import top_per_period
from geoflow.operators.shares import ratio_to_max

# Smallest blended magnitude shown, and the fade of other causes.
SMALLEST_SHOWN = 0.5
OTHER_CAUSE_FACTOR = 0.18


def _unit(t: float) -> float:
    return max(0.0, min(1.0, float(t)))


def blend_density(current: DataFrame, following: DataFrame, t: float, max_cells: int | None = 3500) -> DataFrame:
    """Density between two periods: ``(cell, pop, label)``, largest first.

    A full outer join on the cell, written as one aggregate over both sides so that
    cells are shuffled once. A cell's label is the later one if the cell is new or
    its later part is more than half. A cell that is there without a label is not new.
    """
    t = _unit(t)
    now = current.select("cell", (F.col("pop") * F.lit(1 - t)).alias("p0"), F.lit(None).cast("double").alias("p1"),
                         F.col("dominant_continent").alias("c0"), F.lit(None).cast("string").alias("c1"), F.lit(True).alias("known"))
    then = following.select("cell", F.lit(None).cast("double").alias("p0"), (F.col("pop") * F.lit(t)).alias("p1"),
                            F.lit(None).cast("string").alias("c0"), F.col("dominant_continent").alias("c1"), F.lit(False).alias("known"))
    both = now.unionByName(then).groupBy("cell").agg(
        F.sum("p0").alias("p0"), F.sum("p1").alias("p1"), F.max("c0").alias("c0"), F.max("c1").alias("c1"),
        F.max("known").alias("known")
    )
    pop = F.coalesce("p0", F.lit(0.0)) + F.coalesce("p1", F.lit(0.0))
    later = ~F.col("known") | (F.coalesce("p1", F.lit(0.0)) > pop * F.lit(0.5))
    blended = both.select("cell", pop.alias("pop"), F.when(later, F.col("c1")).otherwise(F.col("c0")).alias("label"))
    shown = at_least(blended, "pop")
    return shown if max_cells is None else top_cells(shown, max_cells)


def at_least(df: DataFrame, value: str, smallest: float = SMALLEST_SHOWN) -> DataFrame:
    return df.where(F.col(value) >= F.lit(smallest))


def top_cells(df: DataFrame, max_cells: int) -> DataFrame:
    return df.orderBy(F.col("pop").desc(), "cell").limit(max_cells)


def blend_corridors(current: DataFrame, following: DataFrame, t: float, top_n: int = 60) -> DataFrame:
    """Strongest corridors of both periods with their intensity; a corridor may appear twice."""
    t = _unit(t)
    parts = []
    for df, weight in ((current, 1 - t * 0.4), (following, 0.6 + t * 0.4)):
        rated = ratio_to_max(df, "migrations", ["period_idx"], "_ratio")
        best = top_per_period(rated, "migrations", ["src_id", "dst_id"], top_n)
        parts.append(best.withColumn("intensity", F.col("_ratio") * F.lit(weight)).drop("_ratio", "rank"))
    return parts[0].unionByName(parts[1])


def with_direction(df: DataFrame) -> DataFrame:
    return df.withColumn("direction", direction_score(F.col("dst_lon") - F.col("src_lon")))


def highlight(df: DataFrame, cause: str | None) -> DataFrame:
    """Factor 1 for the chosen cause (or if none is chosen), small for all others."""
    chosen = F.lit(True) if cause is None else F.col("top_cause") == cause
    return df.withColumn("factor", F.when(chosen, F.lit(1.0)).otherwise(F.lit(OTHER_CAUSE_FACTOR)))


def visible_peak(df: DataFrame) -> DataFrame:
    """Largest magnitude shown, at least 1."""
    return df.agg(F.greatest(F.coalesce(F.max("pop"), F.lit(1.0)), F.lit(1.0)).alias("peak"))


def with_density_ratio(df: DataFrame) -> DataFrame:
    return df.withColumn("ratio", density_ratio(F.col("pop"), visible_peak(df).scalar()))


def localize(df: DataFrame, key: str, text: str, labels: DataFrame) -> DataFrame:
    """Replace ``text`` by the translation of ``key`` where there is one.

    ``labels`` is ``(key, label)``; whether it is broadcast follows from its size.
    """
    named = labels.select(F.col("key").alias(key), F.col("label").alias("_label"))
    joined = df.join(named, key, "left")
    return joined.withColumn(text, F.coalesce("_label", text)).drop("_label")
