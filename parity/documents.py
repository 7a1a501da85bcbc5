"""Sources, sinks and documents: written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoflow.operators.blend import localize
from geoflow.operators.density import density
from geoflow.schemas import CORRIDOR_TILE, DENSITY_TILE, GROUPS, MAX_REGIONS, MOVE
from geoflow.session import dealt_by, fresh_path, local_frame
from geoflow.sources import facts, tiles
from geoflow.sources.catalog import cause_dim, load_catalog
from geoflow.sources.dims import region_dim
from geoflow.functions.periods import periods_of
from parity.columns import PRIORITIES, priority_arrays
from parity.registry import case
from parity.relational import corridor_table, nodes
from parity.views import PERIODS, sql, view

BY_PERIOD = "select period_idx, count(*) as n, cast(sum(seq) as bigint) as seqs from v_move group by 1"


def summed(df):
    return df.groupBy("period_idx").agg(F.count("*").alias("n"), F.sum("seq").alias("seqs"))


def written_moves(v, **how):
    path = fresh_path(v.spark, "moves")
    moves = v.move()
    facts.write_facts(moves, path, **how)
    return path, moves.schema


@case("s1_read_facts", sql(f"{BY_PERIOD} having period_idx = 3", "v_move"))
def s1(v):
    path, schema = written_moves(v)
    return summed(facts.read_facts(v.spark, path, schema).where(F.col("period_idx") == 3))


@case("s2_write_facts", sql(BY_PERIOD, "v_move"))
def s2(v):
    path, schema = written_moves(v, spread=4)
    return summed(facts.read_facts(v.spark, path, schema))


@case("s3_write_result", sql("select * from v_corridor", "v_corridor"))
def s3(v):
    path = fresh_path(v.spark, "corridors")
    facts.write_result(v.region(), path)
    facts.write_result(corridor_table(v), path)
    return v.spark.read.parquet(path)


def saved_catalog(v):
    """The events as nested records in a file, as a user would have them."""
    regions = v.event_region().groupBy("id").agg(F.collect_list("region_id").alias("regions"))
    pull = F.struct(F.col("src_id").alias("from"), F.col("dst_id").alias("to"), "weight")
    pulls = v.event_pull().groupBy("id").agg(F.collect_list(pull).alias("pulls"))
    records = v.event().join(regions, "id", "left").join(pulls, "id", "left").select(
        "id", "name", F.col("start_year").alias("start"), F.col("end_year").alias("end"), "type",
        F.when(F.col("mortality") != 1, F.col("mortality")).alias("mortality"), "birth", "regions", "pulls",
    )
    path = fresh_path(v.spark, "events") + ".jsonl"
    records.write.json(path)
    return load_catalog(v.spark, path)


@case("s4_load_catalog", sql("""
    select e.id, e.start_year, e.end_year, round(e.mortality, 9) as mortality, round(e.birth, 9) as birth, x.n as regions,
           p.n as pulls, round(p.w, 9) as weight
    from v_event e left join (select id, count(*) as n from v_event_region group by 1) x on x.id = e.id
    left join (select id, count(*) as n, sum(weight) as w from v_event_pull group by 1) p on p.id = e.id""",
    "v_event", "v_event_region", "v_event_pull"))
def s4(v):
    catalog = saved_catalog(v)
    regions = catalog.event_region.groupBy("id").agg(F.count("*").alias("regions"))
    pulls = catalog.event_pull.groupBy("id").agg(F.count("*").alias("pulls"), F.round(F.sum("weight"), 9).alias("weight"))
    return catalog.event.join(regions, "id", "left").join(pulls, "id", "left").select(
        "id", "start_year", "end_year", F.round("mortality", 9).alias("mortality"), F.round("birth", 9).alias("birth"),
        "regions", "pulls", "weight",
    )


view("v_priority", """
    select c_nationkey as region_idx, o_orderpriority as label, count(*) as n
    from orders join customer on c_custkey = o_custkey group by 1, 2""")
view("v_group", f"""
    select region_idx, arg_min(g.name, {{'a': -n, 'b': g.at}}) as ethno from v_priority
    join (select unnest([{', '.join(f"'{p}'" for p in PRIORITIES)}]) as label, unnest([{', '.join(f"'{g}'" for g in GROUPS[:5])}]) as name,
                 unnest(range(5)) as at) g on g.label = v_priority.label group by 1""", "v_priority")


@case("s5_region_dim", sql("select r.*, g.ethno from v_region_pop r join v_group g on g.region_idx = r.region_idx", "v_region_pop", "v_group"))
def s5(v):
    described = v.region_pop().join(priority_arrays(v), "region_idx").orderBy("region_idx").limit(MAX_REGIONS + 1)
    rows = [
        {"id": r.region_id, "name": r.name, "lat": r.lat, "lon": r.lon, "pop_share": r.pop_share, "continent": r.continent,
         "radius_deg": r.radius_deg, "ethno": r.counts + [0.0] * 3}
        for r in described.collect()
    ]
    return region_dim(v.spark, rows)


@case("s6_period_dim", """
    select cast(i as int) as period_idx, cast(lo + i * 2 as int) as period_year from (
      select min(year(o_orderdate)) as lo, unnest(range((max(year(o_orderdate)) - min(year(o_orderdate))) // 2 + 1)) as i from orders)""")
def s6(v):
    return periods_of(v.table("orders"), F.year("o_orderdate"), 2)


@case("s7_fit_schema", sql("""
    select person_id, year, from_region_idx, to_region_idx, cause_label, period_idx, count(*) as n from v_move group by all""", "v_move"))
def s7(v):
    zero = [F.lit(0).alias(c) for c in ("from_lat", "from_lon", "to_lat", "to_lon", "cause_id")]
    fitted = facts.fit(v.move().select("*", *zero), MOVE)
    ints = [F.col(c).cast("int").alias(c) for c in ("year", "from_region_idx", "to_region_idx")]
    # Nearly every row is a group of its own, so a task's memory goes by its rows; moves are at most the lines.
    moves = dealt_by(fitted.select("person_id", *ints, "cause_label", "period_idx"), v.table("lineitem").count(), "person_id")
    return moves.groupBy(
        "person_id", "year", "from_region_idx", "to_region_idx", "cause_label", "period_idx"
    ).agg(F.count("*").alias("n"))


@case("s8_require_inputs", sql(BY_PERIOD, "v_move"))
def s8(v):
    path, schema = written_moves(v)
    return summed(facts.require_inputs(v.spark, {"moves": (path, schema)})["moves"])


CELLS = """string_agg('{"h":"' || cell || '","p":' || pop || ',"c":"' || dominant_continent || '"}', ',' order by pop desc, cell)"""


def cell_table(v):
    return density(v.person(), v.region(), PERIODS)


def written_tiles(v, docs, name):
    path = fresh_path(v.spark, name)
    tiles.write_tiles(docs, path)
    return path


@case("s9_density_tiles", sql("""select period_idx, '{"d":' || period_idx || ',"cells":[' || """ + CELLS + """ || ']}' as doc
    from v_density group by 1""", "v_density"))
def s9(v):
    path = written_tiles(v, tiles.density_tiles(cell_table(v)), "density-tiles")
    return v.spark.read.schema("value string, period_idx int").text(path).select("period_idx", F.col("value").alias("doc"))


@case("s9_density_parts", sql("""
    select period_idx, part, '{"d":' || period_idx || ',"part":' || part || ',"cells":[' || """ + CELLS + """ || ']}' as doc
    from (select *, cast((row_number() over (partition by period_idx order by pop desc, cell) - 1) // 40 as int) as part from v_density)
    group by 1, 2""", "v_density"))
def s9_parts(v):
    """The same cells as for a grid that is too fine for one document."""
    path = written_tiles(v, tiles.density_tiles(cell_table(v), res=6, per_part=40), "density-parts")
    return v.spark.read.schema("value string, period_idx int, part int").text(path).select("period_idx", "part", F.col("value").alias("doc"))


def place_json(side: str) -> str:
    return (f"""'{{"id":"' || {side}_id || '","name":"' || {side}_name || '","lat":' || cast({side}_lat as varchar) || ',"lon":' """
            f"""|| cast({side}_lon as varchar) || ',"cont":"' || {side}_continent || '"}}'""")


ARCS = f"""string_agg('{{"from":' || {place_json('src')} || ',"to":' || {place_json('dst')} || ',"n":' || migrations
           || ',"cause":"' || top_cause || '"}}', ',' order by migrations desc, src_id, dst_id)"""


@case("s10_corridor_tiles", sql(f"""
    select period_idx, '{{"d":' || period_idx || ',"year":' || min(period_year) || ',"arcs":[' || {ARCS} || ']}}' as doc
    from v_corridor group by 1""", "v_corridor"))
def s10(v):
    path = written_tiles(v, tiles.corridor_tiles(corridor_table(v)), "corridor-tiles")
    return v.spark.read.schema("value string, period_idx int").text(path).select("period_idx", F.col("value").alias("doc"))


view("v_lineage_doc", """
    select lineage_id, '{"id":' || lineage_id || ',"title":"' || arg_max(region_name, depth) || ' → ' || arg_min(region_name, depth)
           || '","span":[' || arg_max(year, depth) || ',' || arg_min(year, depth) || '],"nodes":['
           || string_agg('{"d":' || depth || ',"y":' || year || ',"r":"' || region_id || '","n":"' || region_name || '","c":"' || continent
                         || '","lat":' || cast(lat as varchar) || ',"lon":' || cast(lon as varchar) || '}', ',' order by depth) || ']}' as doc
    from v_node group by 1 having count(*) >= 2""", "v_node")


@case("s11_lineage_lines", sql("select doc from v_lineage_doc", "v_lineage_doc"))
def s11_lines(v):
    path = fresh_path(v.spark, "lineage-lines")
    tiles.write_lines(tiles.lineage_docs(nodes(v)), path)
    return v.spark.read.schema("doc string").text(path)


@case("s11_lineage_doc", sql("""
    select '{"lineages":[' || string_agg(doc, ',' order by lineage_id) || ']}' as doc from v_lineage_doc""", "v_lineage_doc"))
def s11(v):
    path = fresh_path(v.spark, "lineages")
    tiles.write_doc(tiles.lineage_doc(nodes(v)), path)
    return v.spark.read.schema("doc string").text(path)


view("v_meta_region", """
    select string_agg('{"id":"' || region_id || '","name":"' || name || '","lat":' || cast(lat as varchar) || ',"lon":' || cast(lon as varchar)
                      || ',"continent":"' || continent || '"}', ',' order by region_idx) as text from v_region""", "v_region")
view("v_meta_event", """
    select string_agg('{"id":"' || e.id || '","name":"' || name || '","start":' || start_year || ',"end":' || end_year || ',"type":"' || type
                      || '","regions":[' || coalesce(x.regions, '') || ']}', ',' order by start_year, e.id) as text
    from v_event e left join (select id, string_agg('"' || region_id || '"', ',' order by region_id) as regions from v_event_region group by 1) x
      on x.id = e.id""", "v_event", "v_event_region")


@case("s12_meta_doc", sql("""
    select '{"version":1,"startYear":1995,"endYear":2002,"decades":[1995,1996,1997,1998,1999,2000,2001],"decadeCount":7,"regions":[' || r.text
           || '],"ethnoGroups":[""" + ",".join(f'"{g}"' for g in GROUPS) + """],"events":[' || e.text || ']}' as doc
    from v_meta_region r, v_meta_event e""", "v_meta_region", "v_meta_event"))
def s12(v):
    path = fresh_path(v.spark, "meta")
    tiles.write_doc(tiles.meta_doc(v.region(), PERIODS, v.event(), v.event_region()), path)
    return v.spark.read.schema("doc string").text(path)


view("v_quiet_year", "select cast(unnest(generate_series(1990, 2005)) as int) as year")
view("v_year_names", """
    select q.year, coalesce(string_agg('"' || e.name || '"', ',' order by e.start_year, e.id), '') as names
    from v_quiet_year q left join v_event_year e on e.year = q.year group by 1""", "v_quiet_year", "v_event_year")


@case("s13_timeline_doc", sql("""
    select '{"yearly":[' || string_agg('{"year":' || year || ',"names":[' || names || ']}', ',' order by year) || ']}' as doc
    from v_year_names""", "v_year_names"))
def s13(v):
    path = fresh_path(v.spark, "timeline")
    tiles.write_doc(tiles.timeline_doc(v.event(), 1990, 2005), path)
    return v.spark.read.schema("doc string").text(path)


@case("s14_replace_period", sql("""
    select period_idx, count(*) as n, cast(sum(case when period_idx = 3 then seq + 100 else seq end) as bigint) as seqs
    from v_move group by 1""", "v_move"))
def s14(v):
    path, schema = written_moves(v)
    again = v.move().where(F.col("period_idx") == 3).withColumn("seq", (F.col("seq") + 100).cast("int"))
    facts.write_facts(again, path, only_new_periods=True)
    return summed(facts.read_facts(v.spark, path, schema))


@case("s15_cause_dim", sql("select cause_label, cause_id from v_cause", "v_cause"))
def s15(v):
    return cause_dim(v.event())


@case("s16_read_tiles", sql("select period_idx, cell as h, pop as p, dominant_continent as c from v_density where period_idx between 2 and 5", "v_density"))
def s16(v):
    path = written_tiles(v, tiles.density_tiles(cell_table(v)), "tiles")
    near = tiles.read_tiles(v.spark, path, DENSITY_TILE, period=3)
    return near.select("period_idx", F.inline("tile.cells"))


@case("s16_read_corridor_tiles", sql("select period_idx, src_id, dst_id, migrations from v_corridor where period_idx between 2 and 5", "v_corridor"))
def s16_corridors(v):
    path = written_tiles(v, tiles.corridor_tiles(corridor_table(v)), "tiles")
    near = tiles.read_tiles(v.spark, path, CORRIDOR_TILE, period=3).select("period_idx", F.explode("tile.arcs").alias("a"))
    return near.select("period_idx", F.col("a.from.id").alias("src_id"), F.col("a.to.id").alias("dst_id"), F.col("a.n").alias("migrations"))


@case("s17_row_metrics", sql("select count(*) as rows, cast(count(distinct period_idx) as int) as periods from v_density", "v_density"))
def s17(v):
    watched, seen = facts.row_metrics(cell_table(v), "density")
    facts.write_result(watched, fresh_path(v.spark, "density"))
    return local_frame(v.spark, [seen.get], "rows long, periods int")


@case("s17_many_periods", sql("select count(*) as rows, cast(count(distinct l_orderkey % 30000) as int) as periods from lineitem"))
def s17_many(v):
    """Far more periods than a word has bits."""
    lines = v.table("lineitem").select((F.col("l_orderkey") % 30000).alias("period_idx"))
    watched, seen = facts.row_metrics(lines, "many")
    facts.write_result(watched, fresh_path(v.spark, "many"))
    return local_frame(v.spark, [seen.get], "rows long, periods int")


@case("s18_localize", sql("""
    select r.region_id, coalesce(l.label, r.name) as name, count(*) as n from v_person join v_region r on r.region_idx = birth_region_idx
    left join (select 'nation_' || s_nationkey as key, min(s_name) as label from supplier group by 1) l on l.key = r.region_id
    group by 1, 2""", "v_person", "v_region"))
def s18(v):
    labels = v.table("supplier").groupBy(F.concat(F.lit("nation_"), F.col("s_nationkey").cast("string")).alias("key")).agg(F.min("s_name").alias("label"))
    counted = v.person().groupBy(F.col("birth_region_idx").alias("region_idx")).agg(F.count("*").alias("n"))
    named = counted.join(v.region(), "region_idx").select("region_id", "name", "n")
    return localize(named, "region_id", "name", labels)


@case("a14_dataset_summary", sql("""
    select (select count(*) from v_region) as regions, (select count(*) from v_event) as events,
           (select count(*) from v_period) as periods, (select count(distinct lineage_id) from v_node) as lineages""",
    "v_region", "v_event", "v_period", "v_node"))
def a14(v):
    return tiles.dataset_summary(v.region(), v.event(), PERIODS.frame(v.spark), nodes(v))
