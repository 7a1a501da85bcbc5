"""Regular time periods as arithmetic, so that facts need no join to find theirs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoflow.schemas import MAX_PERIODS


@dataclass(frozen=True)
class Periods:
    """Periods ``[start + i*width, start + (i+1)*width)`` up to ``end`` (exclusive)."""

    start: int
    end: int
    width: int

    def __post_init__(self):
        if not 0 < self.count <= MAX_PERIODS:
            raise ValueError(f"between 1 and {MAX_PERIODS} periods are possible, not {self.count}")

    @property
    def count(self) -> int:
        return -(-(self.end - self.start) // self.width)

    @property
    def last(self) -> int:
        return self.count - 1

    def first_year(self, period: Column) -> Column:
        return (F.lit(self.start) + period.cast("int") * F.lit(self.width)).cast("int")

    def index(self, year: Column) -> Column:
        """Index of the period of a year, clamped to the first and last period."""
        raw = F.floor((year - F.lit(self.start)) / F.lit(float(self.width)))
        return F.greatest(F.lit(0), F.least(F.lit(self.last), raw.cast("int")))

    def progress(self, year: Column) -> Column:
        """Position of a year inside its (clamped) period, from 0 to 1."""
        base = self.first_year(self.index(year))
        part = (year.cast("double") - base) / F.lit(float(self.width))
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), part))

    def covered(self, first: Column, last: Column, match: str = "start_year") -> Column:
        """Array of the periods an inclusive year interval falls on.

        ``start_year``: the period's first year lies in the interval.
        ``overlap``: any year of the period does.
        """
        width = F.lit(float(self.width))
        low = (first - F.lit(self.start)) / width
        if match == "start_year":
            low = F.ceil(low)
        elif match == "overlap":
            low = F.floor(low)
        else:
            raise ValueError("match is 'start_year' or 'overlap'")
        high = F.floor((last - F.lit(self.start)) / width)
        low = F.greatest(low.cast("int"), F.lit(0))
        high = F.least(high.cast("int"), F.lit(self.last))
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    def indexes(self) -> Column:
        return F.sequence(F.lit(0), F.lit(self.last))

    def frame(self, spark: SparkSession) -> DataFrame:
        """Dimension table ``(period_idx, period_year)``."""
        idx = F.col("id").cast("int")
        return spark.range(0, self.count, 1, 1).select(
            idx.alias("period_idx"), self.first_year(idx).alias("period_year")
        )


def periods_of(df: DataFrame, year: Column, width: int) -> DataFrame:
    """Dimension table of the periods between the lowest and highest year found."""
    span = df.agg(F.min(year).cast("int").alias("lo"), F.max(year).cast("int").alias("hi"))
    steps = F.floor((F.col("hi") - F.col("lo")) / F.lit(width)).cast("int")
    steps = F.when(steps < MAX_PERIODS, steps).otherwise(
        F.raise_error(F.lit(f"more than {MAX_PERIODS} periods")).cast("int")
    )
    return span.where(F.col("lo").isNotNull()).select(
        "lo", F.explode(F.sequence(F.lit(0), steps)).alias("period_idx")
    ).select("period_idx", (F.col("lo") + F.col("period_idx") * width).cast("int").alias("period_year"))
