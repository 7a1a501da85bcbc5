"""Ancestor walks over a table that refers to itself."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoflow.functions.expr import period_of_id
from geoflow.operators.shares import global_rank
from geoflow.schemas import NO_PARENT
from geoflow.session import cut, local_frame

#: A level of at most this many ids names them in the scan's filter, and takes at most so many rows back.
NAMED_IDS, FOUND_ROWS = 500, 10_000

#: A sample of at most this many rows is numbered in one task.
RANKED_ROWS = 10_000

#: Ids per list; Parquet filters test lists up to this length value by value.
PUSHED_IDS = 10


def late_seeds(people: DataFrame, first_period: int = 45) -> DataFrame:
    """A filter on the partition column, so earlier periods are not read."""
    return people.where(F.col("period_idx") >= first_period)


def hash_sample(df: DataFrame, n: int = 50, key: str = "id", out: str = "lineage_id") -> DataFrame:
    """Repeatable sample: the n rows with the lowest hash of their key, numbered from 0.

    Up to ``RANKED_ROWS`` rows are picked and numbered in one task. For more, rows are counted by the first
    four digits of their hash, what may be among the first n is kept, and that is numbered by range.
    """
    mark = F.md5(F.col(key).cast("string"))
    marked = df.withColumn("_mark", mark)
    if n <= RANKED_ROWS:
        number = F.row_number().over(Window.orderBy("_mark", key)) - 1
        return marked.orderBy("_mark", key).limit(n).withColumn(out, number.cast("int")).drop("_mark")
    digits = F.substring("_mark", 1, 4)
    counts = marked.groupBy(digits.alias("digits")).agg(F.count("*").alias("c")).orderBy(F.col("digits").asc_nulls_first()).collect()  # at most 65,537
    last, before = None, 0
    for row in counts:
        last, before = row["digits"], before + row["c"]
        if before >= n:
            break
    may_be = F.lit(False) if last is None else digits <= last
    ranked = global_rank(marked.where(may_be | F.col("_mark").isNull()), [F.col("_mark").asc_nulls_first(), F.col(key)], "_rank")
    return ranked.where(F.col("_rank") <= n).withColumn(out, (F.col("_rank") - 1).cast("int")).drop("_mark", "_rank")


def walk_ancestors(people: DataFrame, seeds: DataFrame, max_nodes: int = 14, key: str = "id",
                   parent: str = "parent1_id", period: str | None = None) -> DataFrame:
    """Rows met on the way from each seed along its first parent, with ``depth``.

    ``seeds`` are rows of ``people`` with a ``lineage_id``. Only ids are walked; the rows are joined to what
    was met once, at the end. Where ``period`` names the partition column, ids are packed and the period is
    decoded from the parent's id, so that only the partitions in question are read. A row that
    lies outside the period of its id is therefore nobody's parent. Of a repeated id every row is met.

    Up to ``NAMED_IDS`` ids are followed by name: each level is one scan that skips row groups by their statistics, and
    the links of these ids come back to the driver. More are followed by doubling: a two-column table of ids and
    their ancestors at 1, 2, 4 and 8 steps is joined to what was met, so that 14 nodes take four rounds, and only
    the tables of 1, 2 and 4 steps are kept. The rows do not depend on the way.
    """
    names = people.columns
    start = cut(seeds.select("lineage_id", F.lit(0).alias("depth"), *names))
    link = _Links(people, key, parent, period)
    met = None
    if max_nodes > 1:
        first = start.where(link.has_parent).select("lineage_id", *link.up)
        named = first.limit(NAMED_IDS + 1).toArrow()
        if named.num_rows <= NAMED_IDS:
            met = _walk_by_name(link, named, max_nodes, start.schema["lineage_id"])
        if met is None:
            met = _walk_by_doubling(link, first, max_nodes)
    if met is None:
        return start
    found = link.own.join(met, link.on).select("lineage_id", "depth", *names)
    return start.unionByName(found)


class _Links:
    """The links of a table: of each row its key and its parent, with their periods where there are any."""

    def __init__(self, people: DataFrame, key: str, parent: str, period: str | None) -> None:
        self.on = [key] if period is None else [period, key]
        self.has_parent = F.col(parent).isNotNull() & (F.col(parent) != NO_PARENT)
        kind = None if period is None else dict(people.dtypes)[period]
        self.up = [F.col(parent).alias("_up")] + ([] if period is None else [period_of_id(F.col(parent)).cast(kind).alias("_up_period")])
        #: Rows that can be somebody's parent.
        self.own = people.where(F.col(key).isNotNull() if period is None else F.col(period) == period_of_id(F.col(key)).cast(kind))
        self.fields = [people.schema[name] for name in self.on]
        self.key, self.period, self.period_of = key, period, lambda c: period_of_id(c).cast(kind)


def _walk_by_name(link: _Links, named: pa.Table, max_nodes: int, lineage: T.StructField) -> DataFrame | None:
    """``lineage_id, depth`` and the ids met, or nothing if they are too many to be named."""
    def ids(table: pa.Table) -> list[tuple]:
        return list(zip(*[table.column(c).to_pylist() for c in ("_up_period", "_up") if c in table.column_names]))

    level = list(zip(named.column("lineage_id").to_pylist(), ids(named)))
    met: list[tuple] = []
    for depth in range(1, max_nodes):
        met += [(one, depth, *at) for one, at in level]
        if not level or depth == max_nodes - 1:
            break
        asked = pa.Table.from_pylist([dict(zip(link.on, at)) for at in set(at for _, at in level)])
        rows = link.own.where(_names_only(asked, link.on)).where(link.has_parent)
        found = rows.select(*link.on, *link.up).limit(FOUND_ROWS + 1).toArrow()
        if found.num_rows > FOUND_ROWS:
            return None
        parents: dict[tuple, list[tuple]] = {}
        for at, up in zip(zip(*[found.column(c).to_pylist() for c in link.on]), ids(found)):
            parents.setdefault(at, []).append(up)
        level = [(one, up) for one, at in level for up in parents.get(at, ())]
        if len(level) > NAMED_IDS:
            return None
    if not met:
        return None
    schema = T.StructType([lineage, T.StructField("depth", T.IntegerType()), *link.fields])
    # At most NAMED_IDS rows for each level.
    return F.broadcast(local_frame(link.own.sparkSession, [dict(zip(schema.names, row)) for row in met], schema))


def _walk_by_doubling(link: _Links, first: DataFrame, max_nodes: int) -> DataFrame:
    """``lineage_id, depth`` and the ids met, by tables of ancestors at 1, 2, 4 ... steps."""
    jump = cut(link.own.where(link.has_parent).select(F.col(link.key).alias("_at"), link.up[0]))
    met = first.select("lineage_id", F.lit(1).alias("depth"), F.col("_up").alias("_id"))
    span = 1
    while span < max_nodes - 1:
        further = met.join(jump, F.col("_id") == F.col("_at")).select("lineage_id", (F.col("depth") + span).alias("depth"), F.col("_up").alias("_id"))
        met = met.unionByName(further.where(F.col("depth") < max_nodes))
        span *= 2
        if span < max_nodes - 1:
            twice = jump.alias("a").join(jump.alias("b"), F.col("a._up") == F.col("b._at")).select("a._at", "b._up")
            jump = cut(twice) if 2 * span < max_nodes - 1 else twice  # the last one is read once
    at = [F.col("_id").alias(link.key)] + ([] if link.period is None else [link.period_of(F.col("_id")).alias(link.period)])
    return met.select("lineage_id", "depth", *at)


def _names_only(named: pa.Table, on: list[str]) -> Column:
    """Filter that lets the scan skip row groups: the named keys, few at a time.

    Short lists are tested against the statistics of every row group; a long one
    would only be tested by its smallest and largest value.
    """
    *partition, key = on
    ids = sorted(set(named.column(key).to_pylist()))
    lists = [F.col(key).isin(ids[i : i + PUSHED_IDS]) for i in range(0, len(ids), PUSHED_IDS)]
    wanted = reduce(Column.__or__, lists)
    for name in partition:
        wanted = F.col(name).isin(sorted(set(named.column(name).to_pylist()))) & wanted
    return wanted


def lineages(people: DataFrame, regions: DataFrame, n: int = 50, max_nodes: int = 14,
             first_period: int = 45) -> DataFrame:
    """Sampled late people and their ancestors with region names."""
    narrow = people.select(
        "id", F.col("birth_year").cast("int").alias("year"),
        F.col("birth_region_idx").cast("int").alias("region_idx"),
        F.col("birth_lat").cast("double").alias("lat"), F.col("birth_lon").cast("double").alias("lon"),
        "parent1_id", "period_idx",
    )
    seeds = hash_sample(late_seeds(narrow, first_period), n)
    walked = walk_ancestors(narrow, seeds, max_nodes, period="period_idx")
    return walked.join(regions.select("region_idx", "region_id", F.col("name").alias("region_name"), "continent"), "region_idx").select(
        "lineage_id", "depth", F.col("id").alias("person_id"), "year", "region_idx",
        "region_id", "region_name", "continent", "lat", "lon",
    )


#: Ids of a bitmap, and rows for each from which bitmaps are smaller than ids.
BITMAP_IDS, DENSE_ROWS = 1 << 15, 512


def _bitmaps(ids: DataFrame) -> DataFrame:
    """``bucket, bits``: which ids there are, a bit each."""
    return ids.where("id is not null").groupBy(F.expr("bitmap_bucket_number(id)").alias("bucket")).agg(
        F.expr("bitmap_construct_agg(bitmap_bit_position(id))").alias("bits"))


def orphans(child: DataFrame, parent_table: DataFrame, parent: str, key: str = "id", dense: bool | None = None) -> DataFrame:
    """Parent ids that no row has, with the number of children naming them.

    Packed ids of one period and region are numbered without gaps, so that ``BITMAP_IDS`` of them are one bitmap. Both
    sides are brought to bitmaps before anything is shuffled, and a bucket whose bits are all there has no orphan; only the
    ids of the other buckets are counted and joined. Where ids are ``dense`` is measured unless it is said: with
    fewer than ``DENSE_ROWS`` rows for a bucket all buckets are taken. The rows are the same.

    Children are counted per parent first, so a parent with very many children is
    one row when the shuffle starts.
    """
    named = child.where(F.col(parent).isNotNull() & (F.col(parent) != NO_PARENT)).select(F.col(parent).alias("id"))
    there = parent_table.select(F.col(key).alias("id"))
    if dense is None:
        rows, buckets = there.agg(F.count("*"), F.approx_count_distinct(F.shiftright("id", 15))).first()
        dense = rows >= DENSE_ROWS * max(1, buckets)
    if dense:
        bucket = F.expr("bitmap_bucket_number(id)")
        known = _bitmaps(there).select("bucket", "bits", F.expr("bitmap_count(bits)").alias("n"))
        asked = _bitmaps(named).select("bucket", "bits", F.lit(0).cast("long").alias("n"))
        open_ = cut(known.unionByName(asked).groupBy("bucket").agg(F.expr("bitmap_count(bitmap_or_agg(bits))").alias("_all"), F.max("n").alias("_known"))
                    .where("_all > _known").select(F.col("bucket").alias("_bucket")))
        named = named.join(open_, bucket == F.col("_bucket"), "left_semi")
        there = there.join(open_, bucket == F.col("_bucket"), "left_semi")
    counted = named.groupBy("id").agg(F.count("*").alias("children"))
    return counted.join(there, "id", "left_anti").withColumnRenamed("id", key)


def lineage_spans(df: DataFrame, min_nodes: int = 2) -> DataFrame:
    """One row per lineage: years of both ends, title, number of nodes."""
    oldest = F.max_by(F.struct("region_name", "year"), "depth")
    seed = F.min_by(F.struct("region_name", "year"), "depth")
    grouped = df.groupBy("lineage_id").agg(F.count("*").alias("nodes"), oldest.alias("o"), seed.alias("s"))
    return min_length(grouped, min_nodes).select(
        "lineage_id",
        F.concat("o.region_name", F.lit(" → "), "s.region_name").alias("title"),
        F.col("o.year").alias("first_year"),
        F.col("s.year").alias("last_year"),
        "nodes",
    )


def min_length(grouped: DataFrame, nodes: int = 2) -> DataFrame:
    return grouped.where(F.col("nodes") >= nodes)


def lineage_path(df: DataFrame) -> DataFrame:
    """Points of each lineage by year; a lineage has few nodes, one per generation."""
    point = F.struct("year", (-F.col("depth")).alias("rank"), "lon", "lat")
    listed = df.groupBy("lineage_id").agg(F.array_sort(F.collect_list(point)).alias("points"))
    last = F.element_at("points", -1)
    return listed.select(
        "lineage_id",
        F.transform("points", lambda p: F.array(p["lon"], p["lat"])).alias("path"),
        last["lon"].alias("end_lon"),
        last["lat"].alias("end_lat"),
        F.element_at("points", 1)["year"].alias("first_year"),
        last["year"].alias("last_year"),
    )


def lineage_visible(spans: DataFrame, year: float, selected: int | None = None,
                    hovered: int | None = None, tail: int = 25) -> DataFrame:
    """State of each lineage at a year: selected, hovered, window or dim."""
    at = F.lit(float(year))
    inside = (F.col("first_year") <= at) & (at <= F.col("last_year") + F.lit(tail))
    is_selected = F.lit(False) if selected is None else F.col("lineage_id") == selected
    is_hovered = F.lit(False) if hovered is None else F.col("lineage_id") == hovered
    state = (
        F.when(is_selected, "selected").when(is_hovered, "hovered").when(inside, "window").otherwise("dim")
    )
    return spans.withColumn("state", state)
