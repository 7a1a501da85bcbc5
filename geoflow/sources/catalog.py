"""The catalogue of dated events."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geoflow.schemas import EVENT
from geoflow.session import local_frame


@dataclass(frozen=True)
class Catalog:
    """``event`` plus its two child tables.

    event: id, name, start_year, end_year, type, mortality, birth
    event_region: id, region_id
    event_pull: id, src_id, dst_id, weight, reason
    """

    event: DataFrame
    event_region: DataFrame
    event_pull: DataFrame


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Nested event records from JSON (array or lines), or from YAML where available."""
    if path.endswith((".yaml", ".yml")):
        import yaml

        text = spark.read.text(path, wholetext=True).first()[0]
        rows = yaml.safe_load(text)["events"]
        return local_frame(spark, [_coerced(r) for r in rows], EVENT)
    multi_line = not path.endswith(".jsonl")
    return spark.read.schema(EVENT).option("multiLine", multi_line).json(path)


def _coerced(record: dict) -> dict:
    """Numbers to the schema's types; absent entries stay absent for the defaults."""
    out = {f.name: record.get(f.name) for f in EVENT.fields}
    out["start"], out["end"] = int(record["start"]), int(record["end"])
    for name in ("mortality", "birth"):
        out[name] = None if out[name] is None else float(out[name])
    out["pulls"] = [{**p, "weight": float(p["weight"])} for p in record.get("pulls") or []]
    return out


def split_records(records: DataFrame) -> Catalog:
    """Apply the defaults and explode the two lists into child tables."""
    event = records.select(
        "id",
        "name",
        F.col("start").alias("start_year"),
        F.col("end").alias("end_year"),
        "type",
        F.coalesce("mortality", F.lit(1.0)).alias("mortality"),
        F.coalesce("birth", F.lit(1.0)).alias("birth"),
    )
    region = records.select("id", F.explode("regions").alias("region_id"))
    pull = records.select("id", F.explode("pulls").alias("p")).select(
        "id",
        F.col("p.from").alias("src_id"),
        F.col("p.to").alias("dst_id"),
        F.col("p.weight").alias("weight"),
        F.coalesce("p.reason", F.lit("")).alias("reason"),
    )
    return Catalog(event, region, pull)


def load_catalog(spark: SparkSession, path: str) -> Catalog:
    return split_records(read_records(spark, path))


def cause_dim(event: DataFrame) -> DataFrame:
    """``baseline`` = 0, then 1..n in order of start and id.

    The window has no partition key: an event catalogue is a hand-written document.
    """
    order = Window.orderBy("start_year", "id")
    named = event.select(
        F.col("id").alias("cause_label"),
        F.row_number().over(order).cast("int").alias("cause_id"),
    )
    first = local_frame(event.sparkSession, [{"cause_label": "baseline", "cause_id": 0}], named.schema)
    return first.unionByName(named)
