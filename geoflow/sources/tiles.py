"""Nested JSON tiles and documents for a viewer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoflow.functions.expr import grid_cell_bound
from geoflow.functions.periods import Periods
from geoflow.operators.intervals import names_by_year
from geoflow.operators.shares import global_rank
from geoflow.schemas import GROUPS

VERSION = 1

#: Most cells of one document, about five megabytes of text.
PART_CELLS = 100_000


def _listed(order: list[Column], body: Column) -> Column:
    """Array of ``body`` sorted by ``order``."""
    keyed = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)], body.alias("body"))
    return F.transform(F.array_sort(F.collect_list(keyed)), lambda e: e["body"])


_CELL = {"h": "cell", "p": "pop", "c": "dominant_continent"}


def density_tiles(table: DataFrame, res: int = 3, per_part: int = PART_CELLS) -> DataFrame:
    """``(period_idx, doc)``: a period's cells, fullest first; for fine grids ``(period_idx, part, doc)``.

    A document is one row by nature. Where the grid of the table's resolution has no more cells than a part, a period
    is one document; otherwise its cells are dealt into numbered parts of ``per_part`` cells, in the same order.
    """
    if grid_cell_bound(res) > per_part:
        return density_parts(table, per_part)
    cell = F.struct(*[F.col(c).alias(k) for k, c in _CELL.items()])
    listed = table.groupBy("period_idx").agg(_listed([-F.col("pop"), F.col("cell")], cell).alias("cells"))
    doc = F.to_json(F.struct(F.col("period_idx").alias("d"), "cells"))
    return listed.select("period_idx", doc.alias("doc"))


def density_parts(table: DataFrame, per_part: int = PART_CELLS) -> DataFrame:
    """``(period_idx, part, doc)``: the cells of a period, fullest first, in parts numbered from 0; no task ranks or holds a whole period."""
    ranked = global_rank(table, [F.col("period_idx"), F.col("pop").desc(), F.col("cell")], "_rank")
    first = ranked.groupBy("period_idx").agg(F.min("_rank").alias("_first"))
    placed = ranked.join(F.broadcast(first), "period_idx").withColumn("_at", F.col("_rank") - F.col("_first"))  # one row a period
    cell = F.struct(*[F.col(c).alias(k) for k, c in _CELL.items()])
    part = F.expr(f"_at div {int(per_part)}").cast("int")
    listed = placed.groupBy("period_idx", part.alias("part")).agg(_listed([F.col("_at")], cell).alias("cells"))
    doc = F.to_json(F.struct(F.col("period_idx").alias("d"), "part", "cells"))
    return listed.select("period_idx", "part", doc.alias("doc"))


def tile_index(table: DataFrame, per_part: int = PART_CELLS) -> DataFrame:
    """``(period_idx, doc)``: how many cells and parts a period has, for a reader that goes through the parts."""
    counted = table.groupBy("period_idx").agg(F.count("*").alias("cells"))
    parts = F.ceil(F.col("cells") / F.lit(per_part)).cast("int")
    return counted.select("period_idx", F.to_json(F.struct(F.col("period_idx").alias("d"), "cells", parts.alias("parts"))).alias("doc"))


def corridor_tiles(table: DataFrame) -> DataFrame:
    """``(period_idx, doc)``: a period's top corridors, strongest first."""
    def place(side: str) -> Column:
        names = {"id": "id", "name": "name", "lat": "lat", "lon": "lon", "cont": "continent"}
        return F.struct(*[F.col(f"{side}_{c}").alias(k) for k, c in names.items()])

    arc = F.struct(place("src").alias("from"), place("dst").alias("to"),
                   F.col("migrations").alias("n"), F.col("top_cause").alias("cause"))
    order = [-F.col("migrations"), F.col("src_id"), F.col("dst_id")]
    listed = table.groupBy("period_idx").agg(
        F.min("period_year").alias("year"), _listed(order, arc).alias("arcs")
    )
    doc = F.to_json(F.struct(F.col("period_idx").alias("d"), "year", "arcs"))
    return listed.select("period_idx", doc.alias("doc"))


def lineage_docs(table: DataFrame, min_nodes: int = 2) -> DataFrame:
    """``(lineage_id, doc)``: title, span and nodes of each lineage."""
    node = F.struct(
        F.col("depth").alias("d"), F.col("year").alias("y"), F.col("region_id").alias("r"),
        F.col("region_name").alias("n"), F.col("continent").alias("c"), "lat", "lon",
    )
    listed = table.groupBy("lineage_id").agg(_listed([F.col("depth")], node).alias("nodes"))
    kept = listed.where(F.size("nodes") >= min_nodes)
    oldest, seed = F.element_at("nodes", -1), F.element_at("nodes", 1)
    doc = F.to_json(
        F.struct(
            F.col("lineage_id").alias("id"),
            F.concat(oldest["n"], F.lit(" → "), seed["n"]).alias("title"),
            F.array(oldest["y"], seed["y"]).alias("span"),
            "nodes",
        )
    )
    return kept.select("lineage_id", doc.alias("doc"))


def lineage_doc(table: DataFrame, min_nodes: int = 2) -> DataFrame:
    """All sampled lineages in one document; their number is the sample size."""
    docs = lineage_docs(table, min_nodes)
    listed = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("lineage_id", "doc"))), lambda e: e["doc"]), ","
    )
    return docs.agg(F.concat(F.lit('{"lineages":['), listed, F.lit("]}")).alias("doc"))


def meta_doc(regions: DataFrame, periods: Periods, event: DataFrame, event_region: DataFrame) -> DataFrame:
    """One document describing regions, periods and events."""
    region = F.struct(F.col("region_id").alias("id"), "name", "lat", "lon", "continent")
    region_part = regions.agg(_listed([F.col("region_idx")], region).alias("regions")).scalar()
    places = event_region.groupBy("id").agg(F.array_sort(F.collect_list("region_id")).alias("regions"))
    entry = F.struct(
        "id", "name", F.col("start_year").alias("start"), F.col("end_year").alias("end"), "type",
        F.coalesce("regions", F.array().cast("array<string>")).alias("regions"),
    )
    events = event.join(places, "id", "left").agg(
        _listed([F.col("start_year"), F.col("id")], entry).alias("events")
    ).scalar()
    years = F.array(*[F.lit(periods.start + i * periods.width) for i in range(periods.count)])
    return event.sparkSession.range(1).select(
        F.to_json(
            F.struct(
                F.lit(VERSION).alias("version"),
                F.lit(periods.start).alias("startYear"),
                F.lit(periods.start + periods.count * periods.width).alias("endYear"),
                years.alias("decades"),
                F.lit(periods.count).alias("decadeCount"),
                region_part.alias("regions"),
                F.array(*[F.lit(g) for g in GROUPS]).alias("ethnoGroups"),
                events.alias("events"),
            )
        ).alias("doc")
    )


def timeline(event: DataFrame, first: int, last: int) -> DataFrame:
    """``(year, names)`` for every year of the range, quiet years with an empty list."""
    years = event.sparkSession.range(first, last + 1, 1, 1).select(F.col("id").cast("int").alias("year"))
    empty = F.array().cast("array<string>")
    return years.join(names_by_year(event), "year", "left").select(
        "year", F.coalesce("names", empty).alias("names")
    )


def timeline_doc(event: DataFrame, first: int, last: int) -> DataFrame:
    entry = F.struct("year", "names")
    listed = timeline(event, first, last).agg(_listed([F.col("year")], entry).alias("yearly"))
    return listed.select(F.to_json(F.struct("yearly")).alias("doc"))


def dataset_summary(regions: DataFrame, event: DataFrame, periods: DataFrame, lineage: DataFrame) -> DataFrame:
    """Counts of regions, events, periods and lineages in one row."""
    def rows(df: DataFrame, what: Column) -> Column:
        return df.agg(what.alias("n")).scalar()

    return regions.sparkSession.range(1).select(
        rows(regions, F.count("*")).alias("regions"),
        rows(event, F.count("*")).alias("events"),
        rows(periods, F.count("*")).alias("periods"),
        rows(lineage, F.count_distinct("lineage_id")).alias("lineages"),
    )


# --- files ----------------------------------------------------------------------

def write_tiles(tiles: DataFrame, path: str) -> None:
    """A folder for each period (and part) below ``path``, written by the executors, old ones replaced."""
    parts = [c for c in ("period_idx", "part") if c in tiles.columns]
    tiles.write.mode("overwrite").partitionBy(*parts).text(path)


def write_lines(docs: DataFrame, path: str) -> None:
    """One document a line, in as many files as there are tasks."""
    docs.select("doc").write.mode("overwrite").text(path)


def write_doc(doc: DataFrame, path: str) -> None:
    doc.select("doc").write.mode("overwrite").text(path)


def read_tiles(spark: SparkSession, path: str, schema: T.StructType, period: int | None = None) -> DataFrame:
    """Tiles of a period and its neighbours, one before and two after; of all if none is named.

    A period in parts has a row for each of them.
    """
    raw = spark.read.schema("value string, period_idx int").text(path)
    if period is not None:
        raw = raw.where(F.col("period_idx").isin([period + d for d in (-1, 0, 1, 2)]))
    return raw.select("period_idx", F.from_json("value", schema).alias("tile"))
