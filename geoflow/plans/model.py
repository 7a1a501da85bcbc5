"""Population, cohort plan and flow model, region by period.

All frames here are bounded by the packed id: at most 64 regions and 64 periods.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoflow.functions.expr import clip, gravity, haversine_km, linear_schedule
from geoflow.functions.periods import Periods
from geoflow.operators.intervals import active_counts
from geoflow.operators.shares import apportion, global_share, midpoint, row_share
from geoflow.schemas import MAX_REGIONS
from geoflow.sources.dims import checked_regions

# Fixed values of the model: yearly birth and death rate and capacity growth at
# both ends of time, and the parts of a flow that follow pulls and distance.
BIRTH_RATE = (0.040, 0.012)
DEATH_RATE = (0.035, 0.008)
CAPACITY_GROWTH = (1.0, 25.0)
PULL_PART = 0.7
GRAVITY_PART = 0.3


def schedule(ends: tuple[float, float], periods: Periods, period: Column) -> Column:
    return linear_schedule(ends[0], ends[1], periods.count, period)


def region_pairs(regions: DataFrame) -> DataFrame:
    """Ordered pairs of different regions with their distance.

    Region positions are below 64 (others fail), so the second region is listed by
    position and looked up by an equality join.
    """
    regions = checked_regions(regions)
    src = regions.select(
        F.col("region_idx").alias("src_idx"), F.col("lat").alias("src_lat"), F.col("lon").alias("src_lon"),
        F.explode(F.sequence(F.lit(0), F.lit(MAX_REGIONS - 1))).alias("dst_idx"),
    )
    dst = regions.select(
        F.col("region_idx").alias("dst_idx"), F.col("lat").alias("dst_lat"), F.col("lon").alias("dst_lon")
    )
    distance = haversine_km(F.col("src_lat"), F.col("src_lon"), F.col("dst_lat"), F.col("dst_lon"))
    return (
        src.where(F.col("src_idx") != F.col("dst_idx"))
        .join(dst, "dst_idx")
        .select("src_idx", "dst_idx", distance.alias("distance_km"))
    )


def logistic_fold(steps: DataFrame, key: str, order: str, out: str = "population") -> DataFrame:
    """Logistic growth along time, one value per step.

    ``steps`` holds per key and step: start (value at the first step), net (growth
    per step) and capacity. Each key's steps, at most 64, are folded in one array.
    """
    step = F.struct(order, "start", "net", "capacity")
    listed = steps.groupBy(key).agg(F.array_sort(F.collect_list(step)).alias("_steps"))
    first = F.array(F.element_at("_steps", 1)["start"])
    rest = F.slice("_steps", F.lit(2), F.greatest(F.size("_steps") - 1, F.lit(0)))

    def grow(values: Column, s: Column) -> Column:
        last = F.element_at(values, -1)
        room = clip(F.lit(1.0) - last / F.greatest(s["capacity"], F.lit(1e-9)), -0.5, 1.0)
        grown = last * (F.lit(1.0) + s["net"] * room)
        return F.concat(values, F.array(F.greatest(grown, last * F.lit(0.5))))

    folded = listed.select(key, "_steps", F.aggregate(rest, first, grow).alias("_values"))
    pairs = F.arrays_zip(F.col("_steps")[order].alias("at"), F.col("_values").alias("value"))
    return folded.select(key, F.explode(pairs).alias("_p")).select(
        F.col("_p.at").alias(order), key, F.col("_p.value").alias(out)
    )


def population(regions: DataFrame, factors: DataFrame, periods: Periods) -> DataFrame:
    """Population index ``(period_idx, region_idx, population)`` from initial shares."""
    initial = global_share(regions.select("region_idx", "pop_share"), "pop_share", "start", plan_sized=True)
    d = F.col("period_idx")
    births = schedule(BIRTH_RATE, periods, d) * F.lit(float(periods.width)) * F.col("birth_factor")
    deaths = schedule(DEATH_RATE, periods, d) * F.lit(float(periods.width)) * F.col("mortality_factor")
    steps = factors.join(initial, "region_idx").select(
        "period_idx",
        "region_idx",
        "start",
        (births - deaths).alias("net"),
        (F.col("start") * schedule(CAPACITY_GROWTH, periods, d)).alias("capacity"),
    )
    return logistic_fold(steps, "region_idx", "period_idx")


def birth_weights(pop: DataFrame, factors: DataFrame, periods: Periods) -> DataFrame:
    """Share of all births that falls on each region and period."""
    mid = midpoint(pop, "population", ["region_idx"], "period_idx")
    rate = schedule(BIRTH_RATE, periods, F.col("period_idx"))
    weighted = mid.join(factors, ["period_idx", "region_idx"]).select(
        "period_idx", "region_idx", (F.col("midpoint") * F.col("birth_factor") * rate).alias("w")
    )
    return global_share(weighted, "w", "weight", plan_sized=True).drop("w")


def cohort_plan(weights: DataFrame, total) -> DataFrame:
    """People to make per period and region, summing to the total exactly."""
    keys = ["period_idx", "region_idx"]
    return apportion(weights, "weight", total, keys, plan_sized=True).select(*keys, "n")


def flow_shares(regions: DataFrame, pop: DataFrame, pulls: DataFrame, event: DataFrame,
                periods: Periods, match: str = "start_year") -> DataFrame:
    """Share of all moves per period and ordered pair of regions.

    ``pulls`` is the pull matrix. In a period with any pull, a source without pulls
    keeps only its gravity part.
    """
    by_period = Window.partitionBy("period_idx")
    intensity = active_counts(event, periods, match).select("period_idx", "intensity")
    pulled = pulls.groupBy("period_idx").agg(F.sum("pull").alias("period_pull"))
    # Everything that depends on the source alone is settled before pairs are made.
    leaving = F.col("population") / F.greatest(F.sum("population").over(by_period), F.lit(1e-12)) * F.col("intensity")
    mass = F.greatest("population", F.lit(1e-9))
    src = pop.join(intensity, "period_idx").join(pulled, "period_idx", "left").select(
        "period_idx", F.col("region_idx").alias("src_idx"), mass.alias("src_mass"), leaving.alias("leaving"),
        (F.coalesce("period_pull", F.lit(0.0)) > 0).alias("has_pull"),
    )
    dst = pop.select("period_idx", F.col("region_idx").alias("dst_idx"), mass.alias("dst_mass"))
    paired = src.join(region_pairs(regions), "src_idx").join(dst, ["period_idx", "dst_idx"])
    weighted = paired.withColumn("w", gravity(F.col("src_mass"), F.col("dst_mass"), F.col("distance_km")))
    scaled = row_share(weighted, "w", ["period_idx"], "scaled", plan_sized=True)
    near = row_share(scaled, "scaled", ["period_idx", "src_idx"], "near", floor=1e-12, plan_sized=True)
    drawn = row_share(pulls, "pull", ["period_idx", "src_idx"], "drawn", plan_sized=True)
    joined = near.join(
        drawn.select("period_idx", "src_idx", "dst_idx", "drawn"), ["period_idx", "src_idx", "dst_idx"], "left"
    )
    both = F.lit(PULL_PART) * F.coalesce("drawn", F.lit(0.0)) + F.lit(GRAVITY_PART) * F.col("near")
    blend = F.when(F.col("has_pull"), both).otherwise(F.col("near"))
    flows = joined.select("period_idx", "src_idx", "dst_idx", (F.col("leaving") * blend).alias("w"))
    return global_share(flows, "w", plan_sized=True).select("period_idx", "src_idx", "dst_idx", "share")


def flow_counts(shares: DataFrame, total, exact: bool = False) -> DataFrame:
    """Whole moves per period and pair, zero rows left out.

    Counts are floors, so their sum stays below the total; ``exact`` apportions.
    """
    keys = ["period_idx", "src_idx", "dst_idx"]
    if exact:
        counted = apportion(shares, "share", total, keys)
    else:
        total = total if isinstance(total, Column) else F.lit(int(total))
        counted = shares.withColumn("n", F.floor(F.col("share") * total).cast("long"))
    return nonzero(counted.select(*keys, "n"))


def nonzero(df: DataFrame, value: str = "n") -> DataFrame:
    return df.where(F.col(value) > 0)


def plan_total(plan: DataFrame) -> DataFrame:
    return plan.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("total"))


