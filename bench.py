"""Timed queries; prints one JSON line.

Every query is run once on small data (code generation, class loading), then timed on
``$BENCH_SF_DIR``. The ``run_tiny_*`` entries are the stages of a whole run at the
smallest preset: 600,000 people and up to 400,000 moves over 50 periods. The
``run_small_*`` entries make ten times as many.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from geoflow.functions.periods import Periods
from geoflow.plans import job
from geoflow.session import SETTINGS, cut, fresh_path
from geoflow.sources.catalog import Catalog
from geoflow.sources.dims import SCALES
from parity import all_cases  # noqa: F401
from parity.registry import run
from parity.views import Views

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
WARM_DIR = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
CPUS = os.environ.get("BENCH_CPUS", "8")

HEADLINE = (
    "m3_cohort_plan", "m5_flow_counts", "g6_people", "g6_people_default_draws", "g8_moves", "m6_density_born",
    "m6_density_living", "m7_corridors", "m8_lineages", "j8_walk_ancestors", "j9_blend_density", "j10_label_cause",
    "j11_orphans", "a7_event_factors", "a12_row_share", "w1_top_corridors", "w4_apportion", "w5_split_evenly",
    "o2_hash_sample", "s2_write_facts", "s9_density_tiles", "s10_corridor_tiles",
)


def session() -> SparkSession:
    builder = SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = (
        builder.config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def consume(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(work) -> float:
    start = time.perf_counter()
    work()
    return round(time.perf_counter() - start, 3)


def whole_run(spark: SparkSession, sf_dir: str, scale: str) -> dict[str, float]:
    views = Views(spark, sf_dir)
    catalog = views.catalog()
    kept = Catalog(cut(catalog.event), cut(catalog.event_region), cut(catalog.event_pull))
    given = job.Inputs(cut(views.region_pop()), kept, Periods(1525, 2025, 10))
    out = fresh_path(spark, "bench")
    return {
        f"run_{scale}_{stage}": timed(lambda: job.run(spark, given, out, SCALES[scale], stages=(stage,)))
        for stage in job.STAGES
    }


def main() -> None:
    spark = session()
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        consume(run(name, spark, WARM_DIR))
        seconds[name] = timed(lambda: consume(run(name, spark, SF_DIR)))
    for scale in ("tiny", "small"):
        seconds.update(whole_run(spark, SF_DIR, scale))
    print(json.dumps({
        "metric": "total_query_time", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
