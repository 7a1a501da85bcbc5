"""The whole run: generate, aggregate, export. Each stage can be left out, and ``check`` asked for.

    spark-submit -m geoflow.plans.job --regions regions.json --events events.json --out /data/run --scale tiny
"""

from __future__ import annotations

import argparse
import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoflow.functions.periods import Periods
from geoflow.operators import synth
from geoflow.operators.corridors import corridors
from geoflow.operators.density import by_magnitude, density
from geoflow.operators.intervals import event_factors, pull_matrix, resolve_pulls, resolve_regions, unknown_regions
from geoflow.operators.lineage import lineages, orphans
from geoflow.plans import model
from geoflow.schemas import MOVE, PERSON
from geoflow.session import build_session, cut, scope, tasks_for, together
from geoflow.sources import facts, tiles
from geoflow.sources.catalog import Catalog, load_catalog
from geoflow.sources.dims import SCALES, Scale, read_regions

# The default time range, and how many corridors, lineages and
# generations a run keeps; lineages start in the last tenth of the periods.
PERIODS = Periods(1525, 2025, 10)
TOP_CORRIDORS = 250
LINEAGE_SEEDS = 50
LINEAGE_NODES = 14
LATE_SHARE = 0.9

STAGES = ("generate", "aggregate", "export")
CHECK = "check"


@dataclass(frozen=True)
class Inputs:
    regions: DataFrame
    catalog: Catalog
    periods: Periods = PERIODS
    match: str = "start_year"


@dataclass(frozen=True)
class Options:
    """How a run counts, and how much it keeps."""

    density: str = "born"
    exact: bool = False
    corridors: int = TOP_CORRIDORS
    seeds: int = LINEAGE_SEEDS
    nodes: int = LINEAGE_NODES


@dataclass(frozen=True)
class Plans:
    """The bounded frames a dataset is generated from."""

    cohorts: DataFrame
    flows: DataFrame


def plans(given: Inputs, people: int, moves: int, exact: bool = False) -> Plans:
    catalog, periods = given.catalog, given.periods
    region_events = resolve_regions(catalog.event_region, given.regions)
    pulls = resolve_pulls(catalog.event_pull, given.regions)
    factors = cut(event_factors(catalog.event, region_events, given.regions, periods, given.match))
    pop = cut(model.population(given.regions, factors, periods))
    weights = model.birth_weights(pop, factors, periods)
    matrix = pull_matrix(catalog.event, pulls, periods, given.match)
    shares = model.flow_shares(given.regions, pop, matrix, catalog.event, periods, given.match)
    return Plans(*together(
        lambda: cut(model.cohort_plan(weights, people)),
        lambda: cut(model.flow_counts(shares, moves, exact)),
    ))


def generate(given: Inputs, out: str, scale: Scale, seed: int = synth.DEFAULT_SEED, options: Options = Options()) -> dict[str, dict]:
    """Write people and moves; returns the rows and periods of each."""
    made = plans(given, scale.people, scale.moves, options.exact)
    spark, event, periods = given.regions.sparkSession, given.catalog.event, given.periods
    pulls = resolve_pulls(given.catalog.event_pull, given.regions)
    people = synth.people(made.cohorts, given.regions, periods, seed, partitions=tasks_for(spark, scale.people))
    moves = synth.moves(made.flows, made.cohorts, given.regions, event, pulls, periods, seed, partitions=tasks_for(spark, scale.moves))
    report: dict[str, dict] = {}
    together(
        lambda: _counted(report, "people", people, lambda df: facts.write_facts(df, f"{out}/people", lookup="id")),
        lambda: _counted(report, "moves", moves, lambda df: facts.write_facts(df, f"{out}/moves")),
    )
    return report


def _counted(report: dict[str, dict], name: str, df: DataFrame, write: Callable[[DataFrame], None], period: str | None = "period_idx") -> None:
    """Write a table and note its rows and periods, counted on the way."""
    watched, seen = facts.row_metrics(df, name, period)
    write(watched)
    report[name] = seen.get


def _facts(spark: SparkSession, out: str) -> dict[str, DataFrame]:
    return facts.require_inputs(
        spark, {"people": (f"{out}/people", PERSON), "moves": (f"{out}/moves", MOVE)}, "generate"
    )


def aggregate(spark: SparkSession, given: Inputs, out: str, options: Options = Options()) -> dict[str, dict]:
    """Write the aggregates; returns the rows and periods of each."""
    opened = _facts(spark, out)
    people, moves, regions, periods = opened["people"], opened["moves"], given.regions, given.periods
    late = int(periods.count * LATE_SHARE)
    report: dict[str, dict] = {}

    def cells() -> None:
        counted = density(people, regions, periods, options.density)
        _counted(report, "density", by_magnitude(counted, "pop", ["cell"]), lambda df: facts.write_result(df, f"{out}/density"))

    def routes() -> None:
        top = corridors(moves, regions, periods, options.corridors)
        _counted(report, "corridors", by_magnitude(top, "migrations", ["src_id", "dst_id"]), lambda df: facts.write_result(df, f"{out}/corridors"))

    def walks() -> None:
        # Kept before it is ordered: sorting by ranges runs twice over what it sorts, here a scan of all people.
        walked = cut(lineages(people, regions, options.seeds, options.nodes, late))
        _counted(report, "lineages", walked.orderBy("lineage_id", "depth"), lambda df: facts.write_result(df, f"{out}/lineages"), None)

    together(walks, cells, routes)
    return report


def check(spark: SparkSession, given: Inputs, out: str) -> dict[str, int]:
    """What the run's tables and catalogue name but nothing holds; every number is 0 in a whole dataset.

    ``unknown_regions`` and ``unknown_pull_ends`` are regions that events name and the list does not have, so that these
    links have no effect;
    ``orphan_parents`` are ids that people name as a parent and no row has, ``orphan_children`` the rows naming them;
    ``people_off_map`` and ``moves_off_map`` are rows whose region positions no region has.
    """
    with scope():
        opened, regions, catalog = _facts(spark, out), given.regions, given.catalog
        people, moves = opened["people"], opened["moves"]
        known = regions.select("region_id")
        links = unknown_regions(catalog.event_region, regions)
        ends = [catalog.event_pull.select(F.col(end).alias("region_id")) for end in ("src_id", "dst_id")]
        pulls = ends[0].unionByName(ends[1]).join(known, "region_id", "left_anti")
        lost = cut(orphans(people, people, "parent1_id"))

        def off_map(df: DataFrame, *positions: str) -> int:
            counted = df.groupBy(*positions).count()
            for at in positions:
                counted = counted.join(regions.select(F.col("region_idx").alias(at), F.lit(True).alias(f"on_{at}")), at, "left")
            missing = F.lit(False)
            for at in positions:
                missing = missing | F.col(f"on_{at}").isNull()
            return counted.where(missing).agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]

        names = ("unknown_regions", "unknown_pull_ends", "orphan_parents", "orphan_children", "people_off_map", "moves_off_map")
        return dict(zip(names, together(
            links.count,
            pulls.count,
            lost.count,
            lambda: lost.agg(F.coalesce(F.sum("children"), F.lit(0))).first()[0],
            lambda: off_map(people, "birth_region_idx"),
            lambda: off_map(moves, "from_region_idx", "to_region_idx"),
        )))


def export(spark: SparkSession, given: Inputs, out: str) -> list[str]:
    """Write the documents; an aggregate that is not there is left out. Returns what was written."""
    periods, event = given.periods, given.catalog.event
    end = periods.start + periods.count * periods.width
    meta = tiles.meta_doc(given.regions, periods, event, given.catalog.event_region)
    timeline = tiles.timeline_doc(event, periods.start, end)
    steps = {
        "meta": lambda: tiles.write_doc(meta, f"{out}/tiles/meta"),
        "timeline": lambda: tiles.write_doc(timeline, f"{out}/tiles/timeline"),
    }
    cells = facts.read_or_none(spark, f"{out}/density")
    if cells is not None:
        steps["density"] = lambda: tiles.write_tiles(tiles.density_tiles(cells), f"{out}/tiles/density")
    routes = facts.read_or_none(spark, f"{out}/corridors")
    if routes is not None:
        steps["corridors"] = lambda: tiles.write_tiles(tiles.corridor_tiles(routes), f"{out}/tiles/corridors")
    walked = facts.read_or_none(spark, f"{out}/lineages")
    if walked is not None:
        steps["lineages"] = lambda: tiles.write_lines(tiles.lineage_docs(walked), f"{out}/tiles/lineages")
    together(*steps.values())
    return list(steps)


def run(spark: SparkSession, given: Inputs, out: str, scale: Scale, seed: int = synth.DEFAULT_SEED,
        stages: tuple[str, ...] = STAGES, options: Options = Options()) -> dict[str, dict]:
    """The stages one after the other; what they keep on the way is deleted when the run ends.

    Returns the rows, and where there are any the periods, of every table that was written, and with the stage
    ``check`` what it found.
    """
    report: dict[str, dict] = {}
    with scope():
        if "generate" in stages:
            report |= generate(given, out, scale, seed, options)
        if "aggregate" in stages:
            report |= aggregate(spark, given, out, options)
        if CHECK in stages:
            report[CHECK] = check(spark, given, out)
        if "export" in stages:
            export(spark, given, out)
    return report


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("--regions", required=True, help="JSON array of regions, in position order")
    parser.add_argument("--events", required=True, help="event catalogue, JSON or YAML")
    parser.add_argument("--out", required=True, help="folder for facts, aggregates and tiles")
    parser.add_argument("--scale", default="small", choices=list(SCALES))
    parser.add_argument("--seed", type=int, default=synth.DEFAULT_SEED)
    parser.add_argument("--match", default="start_year", choices=["start_year", "overlap"])
    parser.add_argument("--density", default=Options.density, choices=["born", "living"], help="whom a period's density counts")
    parser.add_argument("--exact", action="store_true", help="flow counts that sum up to the target")
    parser.add_argument("--corridors", type=int, default=Options.corridors, help="corridors kept for each period")
    parser.add_argument("--seeds", type=int, default=Options.seeds, help="people whose ancestors are followed")
    parser.add_argument("--nodes", type=int, default=Options.nodes, help="most people of a lineage, the first included")
    parser.add_argument("--check", action="store_true", help="report links, parents and regions that are not there")
    for stage in STAGES:
        parser.add_argument(f"--skip-{stage}", action="store_true")
    args = parser.parse_args(argv)
    scale = SCALES[args.scale]
    spark = build_session(f"geoflow-{scale.name}", scale.shuffle_partitions)
    given = Inputs(read_regions(spark, args.regions), load_catalog(spark, args.events),
                   match=args.match)
    stages = tuple(s for s in STAGES if not getattr(args, f"skip_{s}")) + ((CHECK,) if args.check else ())
    options = Options(args.density, args.exact, args.corridors, args.seeds, args.nodes)
    print(json.dumps(run(spark, given, args.out, scale, args.seed, stages, options)))


if __name__ == "__main__":
    main()
