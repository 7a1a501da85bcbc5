"""Shares, ratios and exact splits of a total."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoflow.functions.draws import Draws
from geoflow.functions.expr import safe_ratio
from geoflow.operators.joins import lookup_join
from geoflow.session import cut, task_count


def _sum_of(df: DataFrame, weight: str, plan_sized: bool) -> Column:
    """Sum over all rows: a subquery, or for plan-sized frames a window in one task."""
    return F.sum(weight).over(Window.partitionBy()) if plan_sized else df.agg(F.sum(weight)).scalar()


def _with_group(df: DataFrame, keys: list[str], aggregate: Column) -> DataFrame:
    """Join a group's aggregate to its rows. Keys are compared as one struct, so that null is a key like any other."""
    grouped = df.withColumn("_group", F.struct(*keys))
    return lookup_join(grouped, grouped.groupBy("_group").agg(aggregate), ["_group"]).drop("_group")


def global_share(df: DataFrame, weight: str, out: str = "share", plan_sized: bool = False) -> DataFrame:
    """Weight over the sum of all weights; unchanged where that is zero.

    Plan-sized frames have at most one row per period and pair of regions.
    """
    total = _sum_of(df, weight, plan_sized)
    return df.withColumn(out, safe_ratio(F.col(weight), total))


def row_share(df: DataFrame, weight: str, keys: list[str], out: str = "share",
              floor: float | None = None, plan_sized: bool = False) -> DataFrame:
    """Weight over the sum of its group.

    A group that sums to zero keeps its weights; with ``floor`` the divisor is never
    below that value instead. The sums are joined back by ``lookup_join``, so a large
    group is never gathered in one task; plan-sized frames use a window instead.
    """
    if plan_sized:
        joined = df.withColumn("_sum", F.sum(weight).over(Window.partitionBy(*keys)))
    else:
        joined = _with_group(df, keys, F.sum(weight).alias("_sum"))
    if floor is None:
        part = safe_ratio(F.col(weight), F.col("_sum"))
    else:
        part = F.col(weight) / F.greatest(F.col("_sum"), F.lit(floor))
    return joined.withColumn(out, part).drop("_sum")


def ratio_to_max(df: DataFrame, value: str, keys: list[str], out: str = "ratio") -> DataFrame:
    """Value over its group's largest; divisor 1 where that is zero or absent."""
    joined = _with_group(df, keys, F.max(value).alias("_max"))
    ratio = safe_ratio(F.col(value).cast("double"), F.col("_max").cast("double"))
    return joined.withColumn(out, ratio).drop("_max")


def midpoint(df: DataFrame, value: str, keys: list[str], order: str, out: str = "midpoint") -> DataFrame:
    """Mean of the previous and the current value; the first value as it is.

    A key's series has one row per period.
    """
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn(out, (F.coalesce(before, F.col(value)) + F.col(value)) / F.lit(2.0))


def global_rank(df: DataFrame, order: list[Column], out: str = "rank") -> DataFrame:
    """Position of every row in one total order, without a single-task sort.

    Rows are range-partitioned and kept; the position is the row number inside the
    partition plus the sizes of the partitions before it.
    """
    tasks = task_count(df.sparkSession)
    placed = cut(df.repartitionByRange(tasks, *order).withColumn("_part", F.spark_partition_id()))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_size"))
    before = F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return (
        placed.withColumn("_inside", inside)
        .join(F.broadcast(offsets), "_part")
        .withColumn(out, (F.col("_inside") + F.col("_before")).cast("long"))
        .drop("_part", "_inside", "_before")
    )


#: Remainders are compared at nine decimals, as whole numbers below this one.
REST_UNITS = 1_000_000_000
#: The first and the second half of such a number; both have few enough values to be counted in the driver.
REST_LOW = 1 << 15


def _cutting_rest(based: DataFrame, wanted: int) -> tuple[int, int]:
    """(r, n): all rows with a remainder above r, and n of those equal to it, are the ``wanted`` largest.

    Remainders are counted by their first half, and those of the cutting one by their second
    half, so that neither rows nor values are sorted. At most 30,518 and 32,768 counts are collected.
    """
    above, high = wanted, None
    for part, own in ((F.expr(f"_rest div {REST_LOW}"), based), (F.col("_rest") % REST_LOW, None)):
        if own is None:
            own = based.where(F.expr(f"_rest div {REST_LOW}") == high)
        counts = own.groupBy(part.alias("v")).agg(F.count("*").alias("c")).toArrow()
        for value, n in sorted(zip(counts.column("v").to_pylist(), counts.column("c").to_pylist()), reverse=True):
            if above <= n:
                break
            above -= n
        if high is not None:
            return high * REST_LOW + value, above
        high = value
    raise AssertionError("unreachable")


def apportion(df: DataFrame, weight: str, total, keys: list[str], out: str = "n", plan_sized: bool = False) -> DataFrame:
    """Split an integer total by weight so that the parts sum to it exactly.

    Every row gets the floor of its part, and the largest remainders get one more;
    equal remainders (at nine decimals) go by ``keys``. ``plan_sized`` says that the
    frame is a cohort plan, at most 64 by 64 rows, which one task may rank.

    Otherwise the rows are kept once and the sum of the weights is taken once. The remainder
    from which a row gets one more is found by counting remainders; only rows that have exactly
    this one are ranked, and only if not all of them get one more. ``total`` is a number, or a scalar
    that is taken once.
    """
    if not plan_sized:
        if isinstance(total, Column):
            total = df.sparkSession.range(1).select(total).first()[0]
        return _apportion_by_threshold(cut(df), weight, int(total), keys, out)
    total = total if isinstance(total, Column) else F.lit(int(total))
    mass = _sum_of(df, weight, plan_sized)
    mass = F.when(mass > 0, mass).otherwise(F.raise_error(F.lit("weights sum to zero")).cast("double"))
    split = df.withColumn("_part", F.col(weight) / mass * total)
    based = split.withColumn("_base", F.floor("_part").cast("long")).withColumn(
        "_rest", F.round(F.col("_part") - F.floor("_part"), 9)
    ).drop("_part")
    given = _sum_of(based, "_base", plan_sized)
    order = [F.col("_rest").desc(), *[F.col(k) for k in keys]]
    left = based.withColumn("_rank", F.row_number().over(Window.orderBy(*order))).withColumn("_left", total - given)
    extra = F.when(F.col("_rank") <= F.col("_left"), F.lit(1)).otherwise(F.lit(0))
    return left.withColumn(out, (F.col("_base") + extra).cast("long")).drop("_base", "_rest", "_rank", "_left")


def _apportion_by_threshold(kept: DataFrame, weight: str, total: int, keys: list[str], out: str) -> DataFrame:
    names = kept.columns
    mass = kept.agg(F.sum(F.col(weight).cast("double"))).first()[0]
    if mass is None:  # no rows
        return kept.withColumn(out, F.lit(0).cast("long"))
    if mass <= 0:
        raise ValueError("weights sum to zero")
    part = F.col(weight) / F.lit(mass) * F.lit(total)
    rest = F.round(F.round(part - F.floor(part), 9) * REST_UNITS).cast("long")
    based = kept.select("*", F.floor(part).cast("long").alias("_base"), rest.alias("_rest"))
    n, given = based.agg(F.count("*"), F.sum("_base")).first()
    # Rounding can leave more than one for a row, or less than none; every row takes its share of that.
    each, left = divmod(total - given, n)
    extra = F.lit(0)
    if left:
        cutting, wanted = _cutting_rest(based, left)
        extra = F.when(F.col("_rest") > cutting, 1).otherwise(0)
        ties = based.where(F.col("_rest") == cutting)
        if wanted < ties.count():
            ranked = global_rank(ties, [F.col(k) for k in keys], "_rank").withColumn("_extra", F.when(F.col("_rank") <= wanted, 1).otherwise(0)).drop("_rank")
            based = based.where((F.col("_rest") != cutting) | F.col("_rest").isNull()).withColumn("_extra", extra).unionByName(ranked)
            extra = F.col("_extra")
        else:
            extra = F.when(F.col("_rest") >= cutting, 1).otherwise(0)
    return based.select(*[F.col(f"`{c}`") for c in names], (F.col("_base") + F.lit(each) + extra).cast("long").alias(out))


def split_evenly(df: DataFrame, mass: str, keys: list[str], seed: int, parts: int = 10,
                 source: str = "xxhash64") -> DataFrame:
    """Split each row's integer mass over ``parts`` sub-periods, exactly.

    Fractions are Dirichlet(4): gamma draws over their sum. What the floors leave
    goes to the largest fractions. All of it happens inside the row's own array.
    """
    slots = F.sequence(F.lit(0), F.lit(parts - 1))
    key_columns = [F.col(k) for k in keys]
    draws = F.transform(slots, lambda k: Draws(seed, *key_columns, k, source=source).gamma4("split"))
    drawn = df.withColumn("_draw", draws)
    whole = F.aggregate("_draw", F.lit(0.0), lambda acc, x: acc + x)
    shared = drawn.withColumn("_sum", whole)
    fractions = shared.withColumn("_part", F.transform("_draw", lambda x: x / F.col("_sum")))
    based = fractions.withColumn(
        "_base", F.transform("_part", lambda x: F.floor(x * F.col(mass)).cast("long"))
    )
    short = F.col(mass) - F.aggregate("_base", F.lit(0).cast("long"), lambda acc, x: acc + x)
    larger = lambda x: F.size(F.filter("_part", lambda y: y > x))
    final = F.zip_with(
        "_base", "_part", lambda b, x: b + F.when(larger(x) < F.col("_short"), F.lit(1)).otherwise(F.lit(0))
    )
    return (
        based.withColumn("_short", short)
        .withColumn("_final", final)
        .select(*df.columns, F.posexplode("_final").alias("slot", "n"))
    )
