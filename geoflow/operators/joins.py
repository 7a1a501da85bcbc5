"""Joins of facts with small tables, with a size check and a way beyond it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoflow.session import cut, task_count

#: A side is broadcast only if it was counted and has no more rows than this.
BROADCAST_ROWS = 1_000_000

#: A key with fewer rows than this is never salted.
HOT_ROWS = 100_000


def lookup_join(facts: DataFrame, table: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join facts to a lookup table that may have several rows per key.

    The table is written once and counted.
    """
    return kept_join(facts, cut(table), on, how)


def kept_join(facts: DataFrame, kept: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """The same for a table that is already written.

    Up to ``BROADCAST_ROWS`` rows it is sent to every executor and the facts are not
    moved; beyond that the facts are shuffled with their hot keys spread.
    """
    if kept.count() <= BROADCAST_ROWS:
        return facts.join(F.broadcast(kept), on, how)
    return skew_join(facts, kept, on, how)


def hot_keys(df: DataFrame, on: list[str], tasks: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keys that hold more than a quarter of an even task share, and at least ``hot_rows``: ``*on, rows``.

    One pass counts rows per key; all smaller keys become one row. At most
    ``4 * tasks`` keys can hold that much, hence the result may be broadcast. Keys with a null are left out.
    """
    counted = df.where(_complete(on)).groupBy(*on).agg(F.count("*").alias("_n"))
    large = F.when(F.col("_n") >= hot_rows, F.struct(*on))
    summed = cut(counted.select(large.alias("_key"), "_n").groupBy("_key").agg(F.sum("_n").alias("_n")))
    total = summed.agg(F.sum("_n")).first()[0] or 0
    return summed.where(F.col("_key").isNotNull() & (F.col("_n") > total // (4 * tasks))).select("_key.*", F.col("_n").alias("rows"))


def _complete(on: list[str]) -> Column:
    return reduce(Column.__and__, [F.col(k).isNotNull() for k in on])


def skew_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", hot_rows: int = HOT_ROWS,
              rows_per_salt: int | None = None) -> DataFrame:
    """Shuffle join whose hot keys are spread over as many salts as their rows ask for.

    Hot keys are counted, and each gets one salt for ``rows_per_salt`` of its rows (a quarter of an even
    task share where that is not given). The left side is kept, and the rows of a hot key are dealt
    in the order in which they lie in the kept files, whatever they hold, so that equal rows are spread
    as well and a task that is run again deals them in the same way. The right side's rows
    of these keys are repeated once per salt. Left rows with a null in the key match nothing and are not
    shuffled. Exact for inner and left joins.
    """
    if how not in ("inner", "left"):
        raise ValueError("only inner and left joins can be salted on the left side")
    left = cut(left)
    tasks = task_count(left.sparkSession)
    found = cut(hot_keys(left, on, tasks, hot_rows))
    if rows_per_salt is None:
        rows_per_salt = max(1, hot_rows // 4, left.count() // (4 * tasks))
    hot = F.broadcast(found.select(*on, F.ceil(F.col("rows") / rows_per_salt).cast("int").alias("_salts")))
    whole = left.where(_complete(on))
    dealt = F.pmod(F.monotonically_increasing_id(), F.col("_salts")).cast("int")
    salted = whole.join(hot, on, "left").withColumn("_salt", F.coalesce(dealt, F.lit(0))).drop("_salts")
    copies = F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1)
    repeated = right.join(hot, on, "left").withColumn("_salt", F.explode(copies)).drop("_salts")
    joined = salted.join(repeated, [*on, "_salt"], how).drop("_salt")
    if how == "inner":
        return joined
    return joined.unionByName(left.where(~_complete(on)), allowMissingColumns=True)
