"""People per grid cell and period, with the dominant label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoflow.functions.expr import cell_id, cell_name
from geoflow.functions.periods import Periods
from geoflow.operators.intervals import alive_during


def dominant(label: str, weight: str) -> Column:
    """Label with the largest weight, the lowest label on ties."""
    return F.min_by(label, F.struct(-F.col(weight), F.col(label)))


def living(people: DataFrame, periods: Periods, mode: str = "born",
           birth: str = "birth_year", death: str = "death_year") -> DataFrame:
    """People with the period they count in.

    ``born``: the period of birth, as stored. ``living``: every period their life
    overlaps, one row each.
    """
    if mode == "living":
        span = periods.covered(F.col(birth), F.col(death), "overlap")
        people = people.withColumn("period_idx", F.explode(span))
    elif mode != "born":
        raise ValueError("mode is 'born' or 'living'")
    inside = F.col("period_idx").between(0, periods.last)
    return people.where(inside).where(
        alive_during(periods.first_year(F.col("period_idx")), periods.width, F.col(birth), F.col(death))
    )


def label_counts(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    return df.groupBy(*keys, label).agg(F.count("*").alias("n"))


def totals_with_dominant(counts: DataFrame, keys: list[str], label: str, total: str, top: str) -> DataFrame:
    """Sum and dominant label in one aggregate, so no join of the two is needed."""
    return counts.groupBy(*keys).agg(
        F.sum("n").cast("long").alias(total), dominant(label, "n").alias(top)
    )


def density(people: DataFrame, regions: DataFrame, periods: Periods, mode: str = "born",
            cell: Column | None = None, res: int = 3) -> DataFrame:
    """``(period_idx, period_year, cell, pop, dominant_continent)``.

    Rows are counted by region position before anything is joined: what is shuffled
    are counts per cell, and the label is looked up for those. Both later aggregates
    use one more exchange by period and cell. In ``living`` mode people are counted
    per cell and span of periods, a span is two changes of a count, and a cell's changes are summed
    up period by period in its own row.
    """
    if cell is None:
        cell = cell_id(F.col("birth_lat").cast("double"), F.col("birth_lon").cast("double"), res)
    if mode == "living":
        return _named_cells(_summed_changes(people, regions, periods, cell), periods)
    counted = label_counts(
        living(people, periods, mode).select("period_idx", cell.alias("_cell"), "birth_region_idx"),
        ["period_idx", "_cell"],
        "birth_region_idx",
    )
    named = counted.join(
        regions.select(F.col("region_idx").alias("birth_region_idx"), "continent"), "birth_region_idx"
    )
    by_label = (
        named.repartition("period_idx", "_cell")
        .groupBy("period_idx", "_cell", "continent")
        .agg(F.sum("n").alias("n"))
    )
    out = totals_with_dominant(by_label, ["period_idx", "_cell"], "continent", "pop", "dominant_continent")
    return _named_cells(out, periods)


def _named_cells(out: DataFrame, periods: Periods) -> DataFrame:
    name = cell_name(F.col("_cell")) if dict(out.dtypes)["_cell"] == "bigint" else F.col("_cell")
    return out.select(
        "period_idx",
        periods.first_year(F.col("period_idx")).alias("period_year"),
        name.alias("cell"),
        "pop",
        "dominant_continent",
    )


def changes(people: DataFrame, regions: DataFrame, periods: Periods, cell: Column) -> DataFrame:
    """``_cell, continent, at, d``: how the number of living people changes, two rows for every span of a cell and label at most."""
    span = periods.covered(F.col("birth_year"), F.col("death_year"), "overlap")
    spans = people.select(cell.alias("_cell"), "birth_region_idx", span.alias("_span")).where(F.size("_span") > 0)
    first, end = F.col("_span")[0], F.element_at("_span", -1) + 1
    counted = spans.groupBy("_cell", "birth_region_idx", first.alias("_first"), end.alias("_end")).agg(F.count("*").alias("n"))
    named = counted.join(regions.select(F.col("region_idx").alias("birth_region_idx"), "continent"), "birth_region_idx")
    both = F.array(F.struct(F.col("_first").alias("at"), F.col("n").alias("d")), F.struct(F.col("_end").alias("at"), (-F.col("n")).alias("d")))
    return named.select("_cell", "continent", F.explode(both).alias("_x")).select("_cell", "continent", "_x.at", "_x.d")


def _summed_changes(people: DataFrame, regions: DataFrame, periods: Periods, cell: Column) -> DataFrame:
    """``period_idx, _cell, pop, dominant_continent`` from changes.

    A cell has at most one change for each label and period, so that its row is bounded by the labels and 64 periods.
    """
    by_label = (
        changes(people, regions, periods, cell)
        .repartition("_cell")
        .groupBy("_cell", "continent", "at").agg(F.sum("d").alias("d"))
        .groupBy("_cell", "continent").agg(F.collect_list(F.struct("at", "d")).alias("steps"))
        .groupBy("_cell").agg(F.collect_list(F.struct("continent", "steps")).alias("labels"))
    )
    each = by_label.withColumn("period_idx", F.explode(periods.indexes()))

    def so_far(steps: Column) -> Column:
        counts = lambda n, x: n + F.when(x["at"] <= F.col("period_idx"), x["d"]).otherwise(F.lit(0).cast("long"))
        return F.aggregate(steps, F.lit(0).cast("long"), counts)

    counted = F.transform("labels", lambda x: F.struct((-so_far(x["steps"])).alias("less"), x["continent"].alias("continent")))
    alive = each.withColumn("_alive", F.filter(counted, lambda x: x["less"] < 0)).where(F.size("_alive") > 0)
    total = -F.aggregate("_alive", F.lit(0).cast("long"), lambda n, x: n + x["less"])
    return alive.select("period_idx", "_cell", total.alias("pop"), F.array_min("_alive")["continent"].alias("dominant_continent"))


def by_magnitude(df: DataFrame, value: str, ties: list[str], period: str = "period_idx") -> DataFrame:
    """Global order: by period, largest first."""
    return df.orderBy(period, F.col(value).desc(), *ties)


def hot_cells(table: DataFrame, period: int, limit: int = 50) -> DataFrame:
    return table.where(F.col("period_idx") == period).orderBy(F.col("pop").desc(), "cell").limit(limit)
