"""Events against time and regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoflow.functions.periods import Periods
from geoflow.operators.joins import lookup_join

# Flow intensity of a quiet period, and per active event.
BASE_INTENSITY = 0.005
EVENT_INTENSITY = 0.10


# --- predicates -----------------------------------------------------------------

def alive_during(period_year: Column, width: int, birth: Column, death: Column) -> Column:
    return (death >= period_year) & (birth <= period_year + F.lit(width - 1))


def active_at(year) -> Column:
    """Both ends of an event's interval are inclusive."""
    return (F.col("start_year") <= year) & (F.col("end_year") >= year)


# --- lookups by year ------------------------------------------------------------

def active_events(event: DataFrame, year: float, limit: int = 6) -> DataFrame:
    """First events, by start, that are active at the rounded year."""
    at = F.round(F.lit(float(year))).cast("int")
    return event.where(active_at(at)).orderBy("start_year", "id").limit(limit)


def active_events_by_year(event: DataFrame, first: int, last: int, limit: int = 6) -> DataFrame:
    """The same for every year of a range: ``(year, rank, id, ...)``."""
    low = F.greatest(F.col("start_year"), F.lit(first))
    high = F.least(F.col("end_year"), F.lit(last))
    spread = event.where(low <= high).withColumn("year", F.explode(F.sequence(low, high)))
    order = Window.partitionBy("year").orderBy("start_year", "id")
    return spread.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def names_by_year(event: DataFrame) -> DataFrame:
    """Names of the events active in each year, by start and id; an event that ends before it starts is active in none."""
    spread = event.where("start_year <= end_year").select(
        F.explode(F.sequence("start_year", "end_year")).alias("year"), "start_year", "id", "name"
    )
    listed = F.array_sort(F.collect_list(F.struct("start_year", "id", "name")))
    return spread.groupBy("year").agg(F.transform(listed, lambda e: e["name"]).alias("names"))


# --- joins ----------------------------------------------------------------------

def events_in_period(event: DataFrame, periods: Periods, match: str = "start_year") -> DataFrame:
    """Interval join of events with periods: one row per event and period it falls on.

    The periods of an interval follow from arithmetic, so there is no range join.
    """
    covered = periods.covered(F.col("start_year"), F.col("end_year"), match)
    return event.withColumn("period_idx", F.explode(covered)).withColumn(
        "period_year", periods.first_year(F.col("period_idx"))
    )


def resolve_regions(event_region: DataFrame, regions: DataFrame) -> DataFrame:
    """Region ids to positions; ids that no region has are dropped."""
    return event_region.join(regions.select("region_id", "region_idx"), "region_id").select("id", "region_idx")


def unknown_regions(event_region: DataFrame, regions: DataFrame) -> DataFrame:
    """What ``resolve_regions`` drops."""
    return event_region.join(regions.select("region_id"), "region_id", "left_anti")


def resolve_pulls(event_pull: DataFrame, regions: DataFrame) -> DataFrame:
    """Both ends of a pull to positions; unknown ends and self-pulls are dropped."""
    src = regions.select(F.col("region_id").alias("src_id"), F.col("region_idx").alias("src_idx"))
    dst = regions.select(F.col("region_id").alias("dst_id"), F.col("region_idx").alias("dst_idx"))
    return (
        event_pull.join(src, "src_id")
        .join(dst, "dst_id")
        .where(F.col("src_idx") != F.col("dst_idx"))
        .select("id", "src_idx", "dst_idx", "weight")
    )


def cause_labels(event: DataFrame, pulls: DataFrame) -> DataFrame:
    """One label per ``(src_idx, dst_idx, year)``: the heaviest pull, earliest on ties.

    Labels are settled on the catalogue's side, so the facts never fan out.
    """
    lasting = event.where("start_year <= end_year").select("id", "start_year", "end_year")
    dated = pulls.where(F.col("weight") > 0).join(lasting, "id")
    yearly = dated.withColumn("year", F.explode(F.sequence("start_year", "end_year")))
    order = F.struct(-F.col("weight"), F.col("start_year"), F.col("id"))
    return yearly.groupBy("src_idx", "dst_idx", "year").agg(F.min_by("id", order).alias("cause_label"))


def label_cause(moves: DataFrame, event: DataFrame, pulls: DataFrame,
                src: str = "from_region_idx", dst: str = "to_region_idx") -> DataFrame:
    """Add ``cause_label`` to moves by their own year; ``baseline`` where no pull acts."""
    labels = cause_labels(event, pulls).select(
        F.col("src_idx").alias(src), F.col("dst_idx").alias(dst), "year", "cause_label"
    )
    joined = lookup_join(moves, labels, [src, dst, "year"], "left")
    return joined.withColumn("cause_label", F.coalesce("cause_label", F.lit("baseline")))


# --- aggregates -----------------------------------------------------------------

def active_counts(event: DataFrame, periods: Periods, match: str = "start_year") -> DataFrame:
    """Active events and flow intensity of every period, quiet ones included.

    An event is two changes of the number of active ones, whatever its length; they are summed up over the
    periods, of which there are 64 at most.
    """
    covered = event.select(periods.covered(F.col("start_year"), F.col("end_year"), match).alias("_c")).where(F.size("_c") > 0)
    both = F.array(F.struct(F.col("_c")[0].alias("period_idx"), F.lit(1).alias("d")),
                   F.struct((F.element_at("_c", -1) + 1).alias("period_idx"), F.lit(-1).alias("d")))
    changed = covered.select(F.explode(both).alias("_x")).groupBy("_x.period_idx").agg(F.sum("_x.d").alias("d"))
    all_periods = periods.frame(event.sparkSession)
    n = F.sum(F.coalesce("d", F.lit(0).cast("long"))).over(Window.orderBy("period_idx"))
    return all_periods.join(changed, "period_idx", "left").withColumn("n", n).select(
        "period_idx",
        "period_year",
        F.col("n").alias("active_events"),
        (F.lit(BASE_INTENSITY) + F.lit(EVENT_INTENSITY) * F.col("n")).alias("intensity"),
    )


def region_periods(regions: DataFrame, periods: Periods) -> DataFrame:
    """Every region in every period."""
    return regions.select("region_idx", F.explode(periods.indexes()).alias("period_idx"))


def event_factors(event: DataFrame, region_events: DataFrame, regions: DataFrame,
                  periods: Periods, match: str = "start_year") -> DataFrame:
    """Mortality and birth factor of every region in every period.

    Factors start at 1, mortality takes the largest and birth the smallest, so
    values on the other side of 1 have no effect.
    """
    active = events_in_period(event, periods, match).select("id", "period_idx", "mortality", "birth")
    hit = active.join(region_events, "id").groupBy("period_idx", "region_idx").agg(
        F.max("mortality").alias("m"), F.min("birth").alias("b")
    )
    return region_periods(regions, periods).join(hit, ["period_idx", "region_idx"], "left").select(
        "period_idx",
        "region_idx",
        F.greatest(F.lit(1.0), F.coalesce("m", F.lit(1.0))).alias("mortality_factor"),
        F.least(F.lit(1.0), F.coalesce("b", F.lit(1.0))).alias("birth_factor"),
    )


def pull_matrix(event: DataFrame, pulls: DataFrame, periods: Periods, match: str = "start_year") -> DataFrame:
    """Summed pull weight per period and ordered pair of regions."""
    active = events_in_period(event, periods, match).select("id", "period_idx")
    return active.join(pulls, "id").groupBy("period_idx", "src_idx", "dst_idx").agg(
        F.sum("weight").alias("pull")
    )
