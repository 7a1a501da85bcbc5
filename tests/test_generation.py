"""Generated datasets, files, and the whole run."""

import json

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from geoflow.functions.draws import Draws
from geoflow.functions.periods import Periods
from geoflow.operators import lineage, synth
from geoflow.operators.intervals import resolve_pulls
from geoflow.operators.lineage import _names_only, late_seeds, lineages, orphans
from geoflow.plans import job
from geoflow.schemas import CORRIDOR_TILE, DENSITY_TILE, EVENT, MOVE, NO_PARENT, PERSON
from geoflow.session import cut, fresh_path, local_frame
from geoflow.sources import facts, tiles
from geoflow.sources.catalog import load_catalog, split_records
from geoflow.sources.dims import Scale, read_regions, region_dim, run_size, targets
from tests.conftest import plan, rows

P = Periods(1525, 1605, 10)


def region_rows(count):
    return [{"id": f"r{k}", "name": f"Region {k}", "lat": 5.0 * k, "lon": 9.0 * k, "pop_share": 1.0 + k, "continent": f"C{k % 2}",
             "ethno": [1.0] * 8, "radius_deg": 2.0} for k in range(count)]


def event_rows():
    return [{"id": f"e{k}", "name": f"Event {k}", "start": 1525 + 8 * k, "end": 1540 + 8 * k, "type": "war", "mortality": 2.0, "birth": 0.8,
             "regions": [f"r{k % 4}"], "pulls": [{"from": f"r{k % 4}", "to": f"r{(k + 1) % 4}", "weight": 0.4, "reason": "x"}],
             "description": None} for k in range(6)]


@pytest.fixture(scope="module")
def regions(spark):
    return region_dim(spark, region_rows(4))


@pytest.fixture(scope="module")
def catalog(spark):
    return split_records(local_frame(spark, event_rows(), EVENT))


@pytest.fixture(scope="module")
def cohorts(spark):
    """A plan with one very large cohort, an empty region, and a whole empty period."""
    sizes = [(p, r, 40) for p in range(8) for r in range(4) if p != 2 and r != 3] + [(7, 3, 20000)]
    return spark.createDataFrame(sizes, "period_idx int, region_idx int, n long")


@pytest.fixture(scope="module")
def people(spark, cohorts, regions):
    return cut(synth.people(cohorts, regions, P, seed=1))


def test_people_follow_plan_and_schema(people, cohorts):
    assert people.schema.names == PERSON.names and [f.dataType for f in people.schema] == [f.dataType for f in PERSON]
    counted = people.groupBy("period_idx", F.col("birth_region_idx").cast("int").alias("region_idx")).agg(F.count("*").alias("n"))
    assert counted.exceptAll(cohorts).count() == 0 and cohorts.exceptAll(counted).count() == 0
    assert people.select("id").distinct().count() == people.count()
    bad = people.where((F.col("death_year") < P.first_year(F.col("period_idx"))) | ~F.col("birth_lat").between(-85, 85)
                       | ~F.col("birth_lon").between(-180, 180) | ~F.col("sex").isin(0, 1))
    assert bad.count() == 0


def test_parents_exist_and_are_older(people):
    for column in ("parent1_id", "parent2_id"):
        assert orphans(people, people, column).count() == 0
    with_parent = people.where(F.col("parent1_id") != NO_PARENT)
    assert with_parent.where("period_idx < 2").count() == 0
    assert people.where((F.col("period_idx") >= 2) & (F.col("parent1_id") == NO_PARENT)).count() == 0
    older = people.select(F.col("id").alias("parent1_id"), F.col("period_idx").alias("born"))
    steps = {r[0] for r in with_parent.join(older, "parent1_id").where("period_idx >= 6").select(F.col("period_idx") - F.col("born")).distinct().collect()}
    assert steps == {2, 3}


def test_an_empty_period_sends_its_children_one_period_back(people):
    """Children of periods 4 and 5 that draw the empty period 2 find parents in period 1."""
    older = people.select(F.col("id").alias("parent1_id"), F.col("period_idx").alias("born"))
    joined = people.join(older, "parent1_id")
    born = {(r[0], r[1]) for r in joined.where("period_idx in (4, 5)").select("period_idx", "born").distinct().collect()}
    assert born == {(4, 1), (5, 1), (5, 3)}


def test_rows_do_not_depend_on_partitions_and_seed_matters(spark, cohorts, regions, people):
    for parts in (1, 16):
        other = synth.people(cohorts.repartition(parts), regions, P, seed=1, partitions=parts)
        assert other.exceptAll(people).count() == 0 and other.count() == people.count()
    assert synth.people(cohorts, regions, P, seed=2).exceptAll(people).count() > 0


def test_a_large_cohort_spreads_over_tasks(cohorts):
    sizes = synth.chunks(cohorts, chunk_rows=1000)
    assert sizes.agg(F.max("size"), F.sum("size")).first() == (1000, cohorts.agg(F.sum("n")).first()[0])
    one = cohorts.where("n = 20000")
    made = synth.expand(one, ["period_idx", "region_idx"], chunk_rows=500, partitions=8)
    used = made.groupBy(F.spark_partition_id().alias("p")).count()
    assert used.count() == 8 and used.agg(F.max("count")).first()[0] <= 4000


def test_no_python_worker_makes_rows(spark, cohorts, regions, catalog):
    flows = spark.createDataFrame([(3, 0, 1, 50), (4, 2, 0, 30)], "period_idx int, src_idx int, dst_idx int, n long")
    pulls = resolve_pulls(catalog.event_pull, regions)
    for df in (synth.people(cohorts, regions, P), synth.moves(flows, cohorts, regions, catalog.event, pulls, P)):
        text = plan(df)
        assert not any(node in text for node in ("EvalPython", "InPandas", "CartesianProduct", "NestedLoop"))


def test_movers_come_from_earlier_people_of_the_source(spark, cohorts, regions, catalog, people):
    flows = spark.createDataFrame([(3, 0, 1, 500), (6, 1, 2, 300), (5, 3, 0, 9)], "period_idx int, src_idx int, dst_idx int, n long")
    pulls = resolve_pulls(catalog.event_pull, regions)
    made = cut(synth.moves(flows, cohorts, regions, catalog.event, pulls, P, seed=1))
    assert [f.dataType for f in made.schema] == [f.dataType for f in MOVE] and made.count() == 809
    named = made.where(F.col("person_id") != NO_PARENT)
    assert orphans(named.withColumnRenamed("person_id", "p"), people, "p").count() == 0
    # Region 3 has no one before the last period, so its movers are unknown.
    assert made.where("from_region_idx = 3").select("person_id").distinct().collect()[0][0] == NO_PARENT
    joined = named.join(people.select(F.col("id").alias("person_id"), F.col("birth_region_idx"), F.col("period_idx").alias("born")), "person_id")
    assert joined.where("birth_region_idx <> from_region_idx or period_idx - born not between 1 and 3").count() == 0
    labels = {r[0] for r in made.where("from_region_idx = 0").select("cause_label").distinct().collect()}
    assert "e4" in labels


def test_user_generator_sees_bounded_chunks(spark, cohorts):
    def make(period, region, first, size):
        assert size <= 700
        return pd.DataFrame({"period": [period] * size, "i": range(first, first + size)})

    made = synth.generate_groups(cohorts, ["period_idx", "region_idx"], make, "period int, i long", chunk_rows=700)
    assert made.count() == cohorts.agg(F.sum("n")).first()[0]
    assert made.where("period = 7").agg(F.max("i")).first()[0] == 19999


def test_choice_shares(spark):
    weights = spark.createDataFrame([(0, "a", 1.0), (0, "b", 0.0), (0, "c", 3.0), (1, "d", 5.0)], "k int, v string, w double")
    table = synth.draw_table(weights, ["k"], "w", ["v"])
    df = spark.range(40000).select("id", (F.col("id") % 3).cast("int").alias("k"))
    got = synth.choose(df, table, ["k"], Draws(3, F.col("id")).wide("x", 0))
    counts = {(r.k, r.v): r["count"] for r in got.groupBy("k", "v").count().collect()}
    assert got.count() == 40000
    assert counts[0, "a"] / (counts[0, "a"] + counts[0, "c"]) == pytest.approx(0.25, abs=0.02)
    assert set(counts) == {(0, "a"), (0, "c"), (1, "d"), (2, None)}


def test_choice_by_keys_of_any_size(spark):
    """Keys (0, 64) and (1, 0) are different, and a null key has no choice."""
    weights = spark.createDataFrame([(0, 64, "a", 1.0), (1, 0, "b", 1.0), (-5, 1 << 40, "c", 1.0)], "k int, m long, v string, w double")
    table = synth.draw_table(weights, ["k", "m"], "w", ["v"])
    df = spark.createDataFrame([(1, 0, 64), (2, 1, 0), (3, -5, 1 << 40), (4, 0, 0), (5, None, 0), (6, 0, 64)], "id long, k int, m long")
    got = synth.choose(df, table, ["k", "m"], Draws(3, F.col("id")).wide("x", 0)).select("id", "v")
    assert rows(got) == [(1, "a"), (2, "b"), (3, "c"), (4, None), (5, None), (6, "a")]


# --- files ----------------------------------------------------------------------

def test_walk_prunes_partitions(spark, people):
    path = fresh_path(spark, "people")
    facts.write_facts(people, path)
    table = facts.read_facts(spark, path, PERSON)
    assert "PartitionFilters: [isnotnull(period_idx" in plan(late_seeds(table, 6))
    step = table.where("period_idx = 7").select(F.col("parent1_id").alias("id"), (F.col("period_idx") - 2).alias("period_idx"))
    joined = table.join(F.broadcast(step.limit(5)), ["period_idx", "id"])
    assert "dynamicpruning" in plan(joined)
    ids = [r[0] for r in table.where("period_idx = 7").select("parent1_id").limit(25).collect()]
    named = pa.table({"id": ids, "period_idx": [5] * len(ids)})
    text = plan(table.where(_names_only(named, ["period_idx", "id"])))
    assert "PushedFilters: [Or(" in text and "In(id, [" in text and "period_idx" in text.split("PartitionFilters")[1].split("PushedFilters")[0]
    walked = lineages(table, region_dim(spark, region_rows(4)), n=5, first_period=7)
    assert walked.groupBy("lineage_id").agg(F.max("depth").alias("d")).where("d >= 2").count() == 5


def test_missing_inputs_name_the_stage(spark):
    nowhere = fresh_path(spark, "none")
    with pytest.raises(facts.MissingInput, match="run the 'generate' stage"):
        facts.require_inputs(spark, {"people": (nowhere, PERSON)})
    assert facts.read_or_none(spark, nowhere) is None


def test_catalog_from_files(spark, tmp_path):
    array = tmp_path / "events.json"
    array.write_text(json.dumps(event_rows()))
    assert load_catalog(spark, str(array)).event_pull.count() == 6
    yaml = pytest.importorskip("yaml")
    text = tmp_path / "events.yaml"
    short = [{"id": "a", "name": "A", "start": 1600, "end": 1601, "type": "war"},
             {"id": "b", "name": "B", "start": 1600, "end": 1601, "type": "war", "mortality": 2, "pulls": [{"from": "x", "to": "y", "weight": 1}]}]
    text.write_text(yaml.safe_dump({"events": short}))
    loaded = load_catalog(spark, str(text))
    assert rows(loaded.event.select("id", "mortality", "birth")) == [("a", 1.0, 1.0), ("b", 2.0, 1.0)]
    assert loaded.event_pull.count() == 1 and loaded.event_region.count() == 0


def test_sizes(spark):
    assert rows(targets(spark).where("scale = 'tiny'").select("people", "moves")) == [(600000, 400000)]
    small = spark.createDataFrame([(10,)], "initial long")
    assert rows(run_size(small)) == [(10, 50000, 30000)]
    assert Scale("x", 10, 4).people == 50000


def test_tiles_of_a_fine_grid_are_parted(spark, tmp_path):
    table = spark.range(5000).select((F.col("id") % 3).cast("int").alias("period_idx"), F.col("id").cast("string").alias("cell"),
                                     (F.col("id") % 100 + 1).alias("pop"), F.lit("X").alias("dominant_continent"))
    parts = tiles.density_tiles(table, res=9, per_part=300)
    tiles.write_tiles(parts, str(tmp_path / "parts"))
    back = tiles.read_tiles(spark, str(tmp_path / "parts"), DENSITY_TILE).select("period_idx", F.size("tile.cells").alias("n"), F.inline("tile.cells"))
    assert back.agg(F.max("n")).first()[0] == 300 and back.select("h").distinct().count() == 5000
    assert {(r.period_idx, r.part) for r in parts.collect()} == {(p, k) for p in range(3) for k in range(6)}
    index = {r.period_idx: json.loads(r.doc) for r in tiles.tile_index(table, 300).collect()}
    assert index[2] == {"d": 2, "cells": 1666, "parts": 6}


def test_a_failed_write_leaves_the_old_table(spark, tmp_path):
    path = str(tmp_path / "facts")
    old = spark.range(100).select("id", (F.col("id") % 4).cast("int").alias("period_idx"))
    facts.write_facts(old, path)
    broken = old.withColumn("id", F.when(F.col("id") == 77, F.raise_error(F.lit("stopped half way")).cast("long")).otherwise(-F.col("id")))
    for only_new in (False, True):
        with pytest.raises(Exception, match="stopped half way"):
            facts.write_facts(broken, path, only_new_periods=only_new)
        assert sorted(map(tuple, spark.read.parquet(path).select("id", "period_idx").collect())) == sorted(map(tuple, old.collect()))
    with pytest.raises(Exception, match="stopped half way"):
        facts.write_result(broken, path)
    facts.write_facts(spark.read.parquet(path).where("period_idx = 1").withColumn("id", -F.col("id")), path, only_new_periods=True)
    assert spark.read.parquet(path).agg(F.sum(F.when(F.col("id") < 0, 1))).first()[0] == 25
    assert [p.name for p in tmp_path.iterdir()] == ["facts"]


def test_equal_rows_are_spread_over_files(spark, tmp_path):
    path = str(tmp_path / "equal")
    facts.write_facts(spark.range(4000).select(F.lit(1).alias("x"), F.lit(3).alias("period_idx")), path, spread=4)
    sizes = [r[1] for r in spark.read.parquet(path).groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) > 1 and max(sizes) <= 2000 and sum(sizes) == 4000


def test_a_lookup_reads_few_row_groups(spark, tmp_path):
    path = str(tmp_path / "sorted")
    df = spark.range(200_000).select((F.col("id") * 7919 % 200_003).alias("id"), F.lit(0).alias("period_idx")).coalesce(1)
    before = spark.conf.get("parquet.block.size", None)
    spark.conf.set("parquet.block.size", str(64 << 10))
    try:
        facts.write_facts(df, path, lookup="id")
    finally:
        spark.conf.unset("parquet.block.size") if before is None else spark.conf.set("parquet.block.size", before)
    found = spark.read.parquet(path).where("id = 4242")
    assert found.count() == df.where("id = 4242").count() == 1
    found.collect()
    scan = found._jdf.queryExecution().executedPlan()
    while scan.children().size():
        scan = scan.children().apply(0)
    read = scan.metrics().apply("numOutputRows").value()
    assert read <= 20_000


def test_bitmaps_find_the_same_orphans(spark):
    ids = spark.range(-40_000, 60_000).where("id % 5000 <> 17").withColumnRenamed("id", "id")
    children = spark.range(150_000).select(F.when(F.col("id") % 11 != 0, F.col("id") % 110_000 - 45_000).alias("parent1_id"))
    plain = sorted(map(tuple, lineage.orphans(children, ids, "parent1_id", dense=False).collect()))
    assert sorted(map(tuple, lineage.orphans(children, ids, "parent1_id", dense=True).collect())) == plain
    assert sorted(map(tuple, lineage.orphans(children, ids, "parent1_id").collect())) == plain and len(plain) > 9_000


def test_whole_run(spark, tmp_path):
    regions_file, events_file, out = tmp_path / "regions.json", tmp_path / "events.json", str(tmp_path / "out")
    regions_file.write_text(json.dumps(region_rows(4)))
    events_file.write_text(json.dumps(event_rows()))
    given = job.Inputs(read_regions(spark, str(regions_file)), load_catalog(spark, str(events_file)), P)
    with pytest.raises(facts.MissingInput):
        job.run(spark, given, out, Scale("x", 1, 4), stages=("aggregate",))
    assert job.export(spark, given, out) == ["meta", "timeline"]
    report = job.run(spark, given, out, Scale("x", 1, 4))
    assert report["people"] == {"rows": 50000, "periods": 8} and set(report) == {"people", "moves", "density", "corridors", "lineages"}
    assert report["lineages"] == {"rows": spark.read.parquet(f"{out}/lineages").count()}
    assert facts.read_facts(spark, f"{out}/people", PERSON).count() == 50000
    moves = facts.read_facts(spark, f"{out}/moves", MOVE).count()
    assert 29000 < moves <= 30000
    density = spark.read.parquet(f"{out}/density")
    assert density.agg(F.sum("pop")).first()[0] == 50000
    near = tiles.read_tiles(spark, f"{out}/tiles/density", DENSITY_TILE, 0).select("period_idx", F.inline("tile.cells"))
    assert sorted(r[0] for r in near.select("period_idx").distinct().collect()) == [0, 1, 2]
    arcs = tiles.read_tiles(spark, f"{out}/tiles/corridors", CORRIDOR_TILE).select(F.inline("tile.arcs"))
    assert arcs.agg(F.sum("n")).first()[0] == moves
    meta = json.loads(spark.read.text(f"{out}/tiles/meta").first()[0])
    assert (meta["decadeCount"], len(meta["regions"]), len(meta["events"])) == (8, 4, 6)
    yearly = json.loads(spark.read.text(f"{out}/tiles/timeline").first()[0])["yearly"]
    assert len(yearly) == 81 and yearly[0] == {"year": 1525, "names": ["Event 0"]} and yearly[80]["names"] == []
    lines = [json.loads(r[0]) for r in spark.read.text(f"{out}/tiles/lineages").collect()]
    assert sorted(x["id"] for x in lines) == list(range(50))


def test_lineages_are_ordered_without_a_scan_of_people(spark, tmp_path, monkeypatch):
    """Sorting by ranges runs twice over what it sorts."""
    regions_file, events_file, out = tmp_path / "regions.json", tmp_path / "events.json", str(tmp_path / "out")
    regions_file.write_text(json.dumps(region_rows(4)))
    events_file.write_text(json.dumps(event_rows()))
    given = job.Inputs(read_regions(spark, str(regions_file)), load_catalog(spark, str(events_file)), P)
    job.run(spark, given, out, Scale("x", 1, 4), stages=("generate",))
    plans, write = {}, facts.write_result

    def watched(df, path):
        plans[path.rsplit("/", 1)[1]] = plan(df)
        write(df, path)

    monkeypatch.setattr(facts, "write_result", watched)
    job.run(spark, given, out, Scale("x", 1, 4), stages=("aggregate",))
    assert f"{out}/people" in plans["density"] and f"{out}/people" not in plans["lineages"]
    written = [(r["lineage_id"], r["depth"]) for r in spark.read.parquet(f"{out}/lineages").collect()]
    assert written == sorted(written) and len(written) > 50


def test_options_and_check_of_a_run(spark, tmp_path):
    regions_file, events_file, out = tmp_path / "regions.json", tmp_path / "events.json", str(tmp_path / "out")
    regions_file.write_text(json.dumps(region_rows(4)))
    rows = event_rows()
    rows[0] = rows[0] | {"regions": ["nowhere"], "pulls": [{"from": "nowhere", "to": "elsewhere", "weight": 1.0, "reason": "x"}]}
    events_file.write_text(json.dumps(rows))
    given = job.Inputs(read_regions(spark, str(regions_file)), load_catalog(spark, str(events_file)), P)
    options = job.Options(density="living", exact=True, corridors=2, seeds=5, nodes=3)
    report = job.run(spark, given, out, Scale("x", 1, 4), stages=(*job.STAGES, job.CHECK), options=options)
    assert report["check"] == {"unknown_regions": 1, "unknown_pull_ends": 2, "orphan_parents": 0, "orphan_children": 0, "people_off_map": 0, "moves_off_map": 0}
    people = facts.read_facts(spark, f"{out}/people", PERSON)
    assert facts.read_facts(spark, f"{out}/moves", MOVE).count() == 30000
    living = spark.read.parquet(f"{out}/density").agg(F.sum("pop")).first()[0]
    assert living == people.agg(F.sum(F.size(P.covered(F.col("birth_year"), F.col("death_year"), "overlap")))).first()[0] > 50000
    assert spark.read.parquet(f"{out}/corridors").groupBy("period_idx").count().agg(F.max("count")).first()[0] == 2
    walked = spark.read.parquet(f"{out}/lineages")
    assert walked.select("lineage_id").distinct().count() == 5 and walked.agg(F.max("depth")).first()[0] <= 2

    gone = people.where(F.col("parent1_id") >= 0).agg(F.min("parent1_id")).first()[0]
    broken = people.where(F.col("id") != gone).withColumn("birth_region_idx", F.when(F.col("birth_region_idx") == 3, 9).otherwise(F.col("birth_region_idx")).cast("byte"))
    children = broken.where(F.col("parent1_id") == gone).count()
    off = broken.where("birth_region_idx = 9").count()
    facts.write_facts(broken, f"{out}/people")
    found = job.check(spark, given, out)
    assert (found["orphan_parents"], found["orphan_children"], found["people_off_map"]) == (1, children, off) and children > 0 and off > 0
