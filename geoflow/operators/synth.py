"""Seeded datasets made on the executors.

Every draw is a hash of the seed and the row's own keys, so the rows are the same
for any number of partitions and for any task that is run again.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoflow.functions.draws import Draws, jitter, lifespan
from geoflow.functions.expr import death_year, gaussian_kernel, pack_id, year_in_period
from geoflow.functions.periods import Periods
from geoflow.operators.intervals import cause_labels
from geoflow.operators.joins import BROADCAST_ROWS, lookup_join
from geoflow.plans.model import region_pairs
from geoflow.schemas import MOVE, NO_PARENT, PERSON
from geoflow.session import cut, task_count
from geoflow.sources.catalog import cause_dim
from geoflow.sources.facts import fit

# Fixed values of the model.
DEFAULT_SEED = 20260429
PARENT_OFFSETS = (2, 3)
MOVER_OFFSETS = (1, 2, 3)
BIRTH_SPREAD = 0.5
MOVE_SPREAD = 0.4

#: Weights below this many decimals are under the resolution of a 52-bit draw.
KERNEL_DECIMALS = 15

#: Rows one chunk of a plan row makes; a large cohort becomes many chunks.
CHUNK_ROWS = 1 << 13

#: Bins of a draw table.
BINS = 32
#: Names of a draw table's bin and, as a prefix, of its keys.
BIN, KEY = "_bin", "_key_"


# --- expanding a plan -----------------------------------------------------------

def chunks(plan: DataFrame, n: str = "n", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Plan rows cut into ``(chunk, first, size)`` of bounded size."""
    count = F.ceil(F.col(n) / F.lit(float(chunk_rows))).cast("long")
    cut_up = plan.where(F.col(n) > 0).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)))
    first = F.col("chunk") * F.lit(chunk_rows).cast("long")
    return cut_up.withColumn("first", first).withColumn(
        "size", F.least(F.lit(chunk_rows).cast("long"), F.col(n) - first)
    )


def expand(plan: DataFrame, keys: list[str], n: str = "n", out: str = "i", chunk_rows: int = CHUNK_ROWS,
           partitions: int | None = None) -> DataFrame:
    """n rows per plan row with an index from 0.

    Only the chunks are shuffled, before they grow, so one cohort that holds most of
    the rows still spreads over all tasks. Ranges of ``keys`` keep a period's rows in
    few tasks and so in few files, without a shuffle of the rows themselves. The
    partition number is given outright: adaptive execution would merge the small
    chunk rows into one task.
    """
    tasks = partitions or 2 * task_count(plan.sparkSession)
    spread = chunks(plan, n, chunk_rows).repartitionByRange(tasks, *keys, "chunk")
    index = F.explode(F.sequence(F.col("first"), F.col("first") + F.col("size") - 1))
    return spread.withColumn(out, index).drop("chunk", "first", "size")


# --- drawing from a table -------------------------------------------------------

def draw_table(table: DataFrame, keys: list[str], weight: str, order: list[str], bins: int = BINS) -> DataFrame:
    """Weights of each key as intervals ``(lo, hi]`` of (0, 1), listed per bin of equal width.

    The bin lets a draw find its few candidates by equality. The table is kept, for it
    is used more than once.
    """
    values = [c for c in table.columns if c not in (*keys, weight)]
    used = table.where(F.col(weight) > 0)
    inside = Window.partitionBy(*keys).orderBy(*order)
    running = F.sum(weight).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    # The last running sum of the key is its total, so its last bound is exactly 1.
    total = F.max("_run").over(Window.partitionBy(*keys))
    summed = used.withColumn("_run", running).withColumn("hi", F.col("_run") / total)
    bounded = summed.withColumn("lo", F.coalesce(F.lag("hi").over(inside), F.lit(0.0)))
    touched = F.sequence(
        F.floor(F.col("lo") * bins).cast("int"), F.least(F.floor(F.col("hi") * bins).cast("int"), F.lit(bins - 1))
    )
    placed = bounded.where(F.col("hi") > F.col("lo")).withColumn("bin", F.explode(touched))
    return cut(placed.select(*[F.col(k).alias(KEY + k) for k in keys], F.col("bin").alias(BIN), "lo", "hi", *values))


def choose(df: DataFrame, table: DataFrame, keys: list[str], draw: Column, bins: int = BINS) -> DataFrame:
    """Add the columns of the choice whose interval holds the draw, null where a key has none or is null.

    A table of up to ``BROADCAST_ROWS`` rows is broadcast; beyond that the join is shuffled by key and bin.
    """
    values = [c for c in table.columns if c not in (BIN, "lo", "hi", *[KEY + k for k in keys])]
    drawn = df.withColumn("_u", draw).withColumn("_at", F.floor(F.col("_u") * bins).cast("int"))
    held = (F.col("_at") == F.col(BIN)) & (F.col("lo") < F.col("_u")) & (F.col("hi") >= F.col("_u"))
    for key in keys:
        held = held & (F.col(key) == F.col(KEY + key))
    small = table.count() <= BROADCAST_ROWS
    return drawn.join(F.broadcast(table) if small else table, held, "left").select(*df.columns, *values)


# --- parents --------------------------------------------------------------------

def parent_choices(plan: DataFrame, regions: DataFrame) -> DataFrame:
    """For every child cohort the cohorts its parents can come from, with weights.

    A parent is born two or three periods earlier (never before the first) in a
    region drawn by nearness. Where the drawn cohort is empty, the child's region
    stands in; if that is empty too, any cohort of the period by its size, and if the
    whole period is empty, of the period before it. All of that is settled here, in a
    frame of cohorts, so people need a single draw.
    """
    sized = plan.where(F.col("n") > 0).select("period_idx", "region_idx", "n")
    children = sized.where(F.col("period_idx") >= min(PARENT_OFFSETS)).select("period_idx", "region_idx")
    near = region_pairs(regions).unionByName(
        regions.select(F.col("region_idx").alias("src_idx"), F.col("region_idx").alias("dst_idx"),
                       F.lit(0.0).alias("distance_km"))
    ).select(F.col("src_idx").alias("region_idx"), F.col("dst_idx").alias("want"),
             F.round(gaussian_kernel(F.col("distance_km")), KERNEL_DECIMALS).alias("w")).where(F.col("w") > 0)
    offsets = F.explode(F.array(*[F.lit(o) for o in PARENT_OFFSETS]))
    wanted = (
        children.withColumn("_offset", offsets)
        .withColumn("at", F.greatest(F.col("period_idx") - F.col("_offset"), F.lit(0)))
        .drop("_offset")
        .join(near, "region_idx")
    )
    cohort = sized.select(F.col("period_idx").alias("at"), F.col("region_idx").alias("want"), F.col("n").alias("n_want"))
    own = sized.select(F.col("period_idx").alias("at"), "region_idx", F.col("n").alias("n_own"))
    here = sized.groupBy(F.col("period_idx").alias("at")).agg(F.sum("n").alias("total_here"))
    looked = (
        wanted.join(cohort, ["at", "want"], "left").join(own, ["at", "region_idx"], "left").join(here, "at", "left")
    )
    # Only where both cohorts are empty does a row meet the cohorts of a whole period.
    settled = F.coalesce("n_want", "n_own").isNotNull()
    before = F.greatest(F.col("at") - 1, F.lit(0))
    resort = F.when(~settled, F.when(F.col("total_here").isNotNull(), F.col("at")).otherwise(before))
    any_cohort = sized.join(here.withColumnRenamed("at", "period_idx"), "period_idx").select(
        F.col("period_idx").alias("any_period"), F.col("region_idx").alias("any_region"), F.col("n").alias("any_n"),
        (F.col("n") / F.col("total_here")).alias("any_share"),
    )
    met = looked.withColumn("_resort", resort).join(any_cohort, F.col("_resort") == F.col("any_period"), "left")
    base = ["period_idx", "region_idx"]
    chosen = met.select(
        *base,
        F.when(settled, F.col("at")).otherwise(F.col("any_period")).alias("parent_period"),
        F.when(F.col("n_want").isNotNull(), F.col("want"))
        .when(settled, F.col("region_idx"))
        .otherwise(F.col("any_region"))
        .alias("parent_region"),
        F.coalesce("n_want", "n_own", "any_n").alias("parent_n"),
        (F.col("w") * F.coalesce("any_share", F.lit(1.0))).alias("w"),
    )
    return (
        chosen.where(F.col("parent_n").isNotNull())
        .repartition(*base)
        .groupBy(*base, "parent_period", "parent_region")
        .agg(F.max("parent_n").alias("parent_n"), F.sum("w").alias("w"))
    )


def assign_parents(people: DataFrame, plan: DataFrame, regions: DataFrame, draws: Draws) -> DataFrame:
    """Add two parent ids; -1 for the first periods and where no cohort can be found."""
    table = draw_table(parent_choices(plan, regions), ["period_idx", "region_idx"], "w",
                       ["parent_period", "parent_region"])
    out = people
    for number in (1, 2):
        salt = f"parent{number}"
        out = choose(out, table, ["period_idx", "region_idx"], draws.wide(salt, 0))
        index = F.floor(draws.wide(salt, 1) * F.col("parent_n")).cast("long")
        packed = pack_id(F.col("parent_period"), F.col("parent_region"), index)
        out = out.withColumn(
            f"parent{number}_id",
            F.when(F.col("parent_n").isNotNull(), packed).otherwise(F.lit(NO_PARENT).cast("long")),
        ).drop("parent_period", "parent_region", "parent_n")
    return out


# --- facts ----------------------------------------------------------------------

def people(plan: DataFrame, regions: DataFrame, periods: Periods, seed: int = DEFAULT_SEED,
           source: str = "xxhash64", partitions: int | None = None) -> DataFrame:
    """One row per planned person, in the people schema."""
    key = [F.col("period_idx"), F.col("region_idx"), F.col("i")]
    draws = Draws(seed, *key, source=source)
    centre = regions.select("region_idx", "lat", "lon", "radius_deg", "continent")
    # The region's attributes are joined to plan rows and travel along the expansion.
    rows = expand(plan.join(centre, "region_idx"), ["period_idx", "region_idx"], partitions=partitions)
    first = periods.first_year(F.col("period_idx"))
    birth = year_in_period(first, draws.uniform("year", 0), periods.width)
    lat, lon = jitter(F.col("lat"), F.col("lon"), F.col("radius_deg"), BIRTH_SPREAD, draws, "place")
    made = rows.select(
        "period_idx", "region_idx", "i",
        pack_id(*key).alias("id"),
        birth.alias("birth_year"),
        lifespan(F.col("period_idx"), periods.last, draws).alias("_span"),
        F.floor(draws.uniform("year", 1) * 2).alias("sex"),
        lat.alias("birth_lat"),
        lon.alias("birth_lon"),
        F.col("continent").alias("birth_continent"),
    ).withColumn("death_year", death_year(F.col("birth_year"), F.col("_span"), first))
    return fit(
        assign_parents(made, plan, regions, draws).withColumn("birth_region_idx", F.col("region_idx")), PERSON
    )


def mover_choices(plan: DataFrame, flows: DataFrame) -> DataFrame:
    """Cohorts a move's person can come from: one to three periods earlier, never empty."""
    sized = plan.where(F.col("n") > 0).select(
        F.col("period_idx").alias("mover_period"), F.col("region_idx").alias("src_idx"), F.col("n").alias("mover_n")
    )
    sources = flows.select("period_idx", "src_idx").distinct()
    offsets = F.explode(F.array(*[F.lit(o) for o in MOVER_OFFSETS]))
    asked = sources.withColumn("_offset", offsets).withColumn(
        "mover_period", F.greatest(F.col("period_idx") - F.col("_offset"), F.lit(0))
    )
    return asked.groupBy("period_idx", "src_idx", "mover_period").agg(F.count("*").cast("double").alias("w")).join(
        sized, ["mover_period", "src_idx"]
    )


def moves(flows: DataFrame, plan: DataFrame, regions: DataFrame, event: DataFrame, pulls: DataFrame,
          periods: Periods, seed: int = DEFAULT_SEED, source: str = "xxhash64",
          partitions: int | None = None) -> DataFrame:
    """One row per planned move, in the moves schema."""
    key = [F.col("period_idx"), F.col("src_idx"), F.col("dst_idx"), F.col("i")]
    draws = Draws(seed, *key, source=source)
    src = regions.select(F.col("region_idx").alias("src_idx"), F.col("lat").alias("src_lat"),
                         F.col("lon").alias("src_lon"), F.col("radius_deg").alias("src_radius"))
    dst = regions.select(F.col("region_idx").alias("dst_idx"), F.col("lat").alias("dst_lat"),
                         F.col("lon").alias("dst_lon"), F.col("radius_deg").alias("dst_radius"))
    rows = expand(flows.join(src, "src_idx").join(dst, "dst_idx"), ["period_idx", "src_idx", "dst_idx"],
                  partitions=partitions)
    first = periods.first_year(F.col("period_idx"))
    dated = rows.withColumn("year", year_in_period(first, draws.uniform("when", 0), periods.width))
    table = draw_table(mover_choices(plan, flows), ["period_idx", "src_idx"], "w", ["mover_period"], bins=4)
    chosen = choose(dated, table, ["period_idx", "src_idx"], draws.wide("mover", 0), bins=4)
    index = F.floor(draws.wide("mover", 1) * F.col("mover_n")).cast("long")
    person = F.when(F.col("mover_n").isNotNull(), pack_id(F.col("mover_period"), F.col("src_idx"), index)).otherwise(
        F.lit(NO_PARENT).cast("long")
    )
    labels = cause_labels(event, pulls).join(cause_dim(event), "cause_label")
    labelled = lookup_join(chosen, labels, ["src_idx", "dst_idx", "year"], "left")
    from_lat, from_lon = jitter(F.col("src_lat"), F.col("src_lon"), F.col("src_radius"), MOVE_SPREAD, draws, "from")
    to_lat, to_lon = jitter(F.col("dst_lat"), F.col("dst_lon"), F.col("dst_radius"), MOVE_SPREAD, draws, "to")
    return fit(
        labelled.select(
            person.alias("person_id"),
            "year",
            F.col("src_idx").alias("from_region_idx"),
            F.col("dst_idx").alias("to_region_idx"),
            from_lat.alias("from_lat"),
            from_lon.alias("from_lon"),
            to_lat.alias("to_lat"),
            to_lon.alias("to_lon"),
            F.coalesce("cause_id", F.lit(0)).alias("cause_id"),
            F.coalesce("cause_label", F.lit("baseline")).alias("cause_label"),
            "period_idx",
        ),
        MOVE,
    )


# --- a user's own generator -----------------------------------------------------

def generate_groups(plan: DataFrame, keys: list[str], make: Callable[..., pd.DataFrame], schema,
                    chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Grouped-map hook for a generator written in pandas.

    ``make(*key_values, first, size)`` returns the rows of one chunk of a group. The
    chunk is part of the grouping key, so no call makes more than ``chunk_rows`` rows
    however large the group is.
    """
    parts = chunks(plan, "n", chunk_rows).select(*keys, "chunk", "first", "size")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        row = pdf.iloc[0]
        return make(*[row[k] for k in keys], int(row["first"]), int(row["size"]))

    spread = parts.repartition(task_count(plan.sparkSession), *keys, "chunk")
    return spread.groupBy(*keys, "chunk").applyInPandas(run, schema)
