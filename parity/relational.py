"""Filters, joins, aggregates, windows, sorts and unions."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoflow.functions.expr import gravity, pack_id
from geoflow.operators import blend, intervals, lineage, shares
from geoflow.operators.corridors import ROUTE, corridor_totals, corridors, strongest_corridor, top_per_period
from geoflow.operators.density import (
    by_magnitude,
    density,
    hot_cells,
    label_counts,
    living,
    totals_with_dominant,
)
from geoflow.operators.synth import expand
from geoflow.plans import model
from geoflow.session import fresh_path
from geoflow.sources.facts import write_facts
from parity.registry import case
from parity.views import PERIODS, SEED, cell, packed, sql, view

# --- filters --------------------------------------------------------------------

view("v_person_cell", f"select id, {cell('birth_lat', 'birth_lon')} as cell from v_person", "v_person")
view("v_living", """
    select p.*, d.period_idx as at_idx from v_person p
    join v_period d on p.death_year >= d.period_year and p.birth_year <= d.period_year""", "v_person", "v_period")


@case("p1_alive_during_born", sql("""
    select d.period_idx, count(*) as n from v_person p join v_period d on d.period_idx = p.period_idx
    where p.death_year >= d.period_year and p.birth_year <= d.period_year group by 1""", "v_person", "v_period"))
def p1_born(v):
    return living(v.person(), PERIODS).groupBy("period_idx").agg(F.count("*").alias("n"))


@case("p1_alive_during_living", sql("select at_idx as period_idx, count(*) as n from v_living group by 1", "v_living"))
def p1_living(v):
    return living(v.person(), PERIODS, "living").groupBy("period_idx").agg(F.count("*").alias("n"))


@case("p2_late_seeds", sql("select id from v_person where period_idx >= 5", "v_person"))
def p2(v):
    return lineage.late_seeds(v.person(), 5).select("id")


view("v_cause_count", """
    select period_idx, from_region_idx, to_region_idx, cause_label, count(*) as n from v_move group by 1, 2, 3, 4""", "v_move")
view("v_total", """
    select period_idx, from_region_idx, to_region_idx, cast(sum(n) as bigint) as migrations,
           arg_min(cause_label, {'a': -n, 'b': cause_label}) as top_cause
    from v_cause_count group by 1, 2, 3""", "v_cause_count")
view("v_ranked", """
    select *, cast(row_number() over (partition by period_idx order by migrations desc, from_region_idx, to_region_idx) as int) as rank
    from v_total""", "v_total")


@case("p3_rank_filter", sql("select * from v_ranked where rank <= 10", "v_ranked"))
def p3(v):
    return top_per_period(corridor_totals(v.move()), "migrations", ["from_region_idx", "to_region_idx"], 10)


@case("p4_nonzero", sql("""
    select from_region_idx, to_region_idx, count(*) filter (where seq > 6) as n from v_move group by 1, 2
    having count(*) filter (where seq > 6) > 0""", "v_move"))
def p4(v):
    counted = v.move().groupBy("from_region_idx", "to_region_idx").agg(F.count(F.when(F.col("seq") > 6, 1)).alias("n"))
    return model.nonzero(counted)


@case("p5_project", sql("""
    select person_id as id, cast(seq as bigint) as seq, cast(period_idx + 1995 as int) as period_year, cause_label as cause
    from v_move""", "v_move"))
def p5(v):
    return v.move().select(
        F.col("person_id").alias("id"), F.col("seq").cast("long").alias("seq"),
        PERIODS.first_year(F.col("period_idx")).alias("period_year"), F.col("cause_label").alias("cause"),
    )


@case("p6_active_at", sql("select id from v_event where start_year <= 1998 and end_year >= 1998", "v_event"))
def p6(v):
    return v.event().where(intervals.active_at(F.lit(1998))).select("id")


@case("p7_active_events", sql("""
    select id, start_year, end_year from v_event where start_year <= 1998 and end_year >= 1998 order by start_year, id limit 6""", "v_event"))
def p7(v):
    return intervals.active_events(v.event(), 1997.8).select("id", "start_year", "end_year")


view("v_event_year", """
    select id, name, start_year, cast(unnest(generate_series(start_year, end_year)) as int) as year from v_event""", "v_event")


@case("p7_active_events_by_year", sql("""
    select * from (select year, id, cast(row_number() over (partition by year order by start_year, id) as int) as rank
                   from v_event_year where year between 1995 and 2001) where rank <= 6""", "v_event_year"))
def p7_years(v):
    return intervals.active_events_by_year(v.event(), 1995, 2001).select("year", "id", "rank")


BLEND_T = 0.3
view("v_blend", f"""
    select coalesce(a.cell, b.cell) as cell,
           coalesce(a.pop * cast({1 - BLEND_T} as double), 0) + coalesce(b.pop * cast({BLEND_T} as double), 0) as pop,
           case when a.cell is null or coalesce(b.pop * cast({BLEND_T} as double), 0)
                     > (coalesce(a.pop * cast({1 - BLEND_T} as double), 0) + coalesce(b.pop * cast({BLEND_T} as double), 0)) * 0.5
                then b.dominant_continent else a.dominant_continent end as label
    from (select * from v_density where period_idx = 3) a
    full outer join (select * from v_density where period_idx = 4) b on a.cell = b.cell""", "v_density")


def two_periods(v):
    table = density(v.person(), v.region(), PERIODS)
    return table.where(F.col("period_idx") == 3), table.where(F.col("period_idx") == 4)


@case("j9_blend_density", sql("select cell, round(pop, 6) as pop, label from v_blend where pop >= 0.5", "v_blend"))
def j9(v):
    return blend.blend_density(*two_periods(v), BLEND_T, None).select("cell", F.round("pop", 6).alias("pop"), "label")


view("v_blend_null", f"""
    select coalesce(a.cell, b.cell) as cell,
           coalesce(a.pop * cast({1 - BLEND_T} as double), 0) + coalesce(b.pop * cast({BLEND_T} as double), 0) as pop,
           case when a.cell is null or coalesce(b.pop * cast({BLEND_T} as double), 0) > coalesce(a.pop * cast({1 - BLEND_T} as double), 0)
                then b.dominant_continent else a.label end as label
    from (select *, case when pop % 3 <> 0 then dominant_continent end as label from v_density where period_idx = 3) a
    full outer join (select * from v_density where period_idx = 4) b on a.cell = b.cell""", "v_density")


@case("j9_blend_null", sql("select cell, round(pop, 6) as pop, label from v_blend_null where pop >= 0.5", "v_blend_null"))
def j9_null(v):
    """Cells of the first period without a label are there all the same."""
    now, then = two_periods(v)
    unnamed = now.withColumn("dominant_continent", F.when(F.col("pop") % 3 != 0, F.col("dominant_continent")))
    return blend.blend_density(unnamed, then, BLEND_T, None).select("cell", F.round("pop", 6).alias("pop"), "label")


@case("p8_at_least", sql("select cell, round(pop, 6) as pop from v_blend where pop >= 1.2", "v_blend"))
def p8(v):
    shown = blend.at_least(blend.blend_density(*two_periods(v), BLEND_T, None), "pop", 1.2)
    return shown.select("cell", F.round("pop", 6).alias("pop"))


@case("o3_top_cells", sql("select cell, round(pop, 6) as pop, label from v_blend where pop >= 0.5 order by v_blend.pop desc, cell limit 200", "v_blend"))
def o3(v):
    return blend.blend_density(*two_periods(v), BLEND_T, 200).select("cell", F.round("pop", 6).alias("pop"), "label")


@case("a13_visible_peak", sql("select round(greatest(max(pop), 1), 6) as peak from v_blend where pop >= 0.5", "v_blend"))
def a13(v):
    shown = blend.blend_density(*two_periods(v), BLEND_T, None)
    return blend.visible_peak(shown).select(F.round("peak", 6).alias("peak"))


# --- joins ----------------------------------------------------------------------

@case("j1_fact_dimension", sql("""
    select r.name, d.period_year, count(*) as n from v_person p join v_region r on r.region_idx = p.birth_region_idx
    join v_period d on d.period_idx = p.period_idx group by 1, 2""", "v_person", "v_region", "v_period"))
def j1(v):
    counted = v.person().groupBy("period_idx", F.col("birth_region_idx").alias("region_idx")).agg(F.count("*").alias("n"))
    joined = counted.join(v.region(), "region_idx").join(PERIODS.frame(v.spark), "period_idx")
    return joined.groupBy("name", "period_year").agg(F.sum("n").alias("n"))


@case("j2_role_playing", sql("""
    select s.name as src_name, d.name as dst_name, count(*) as n from v_move
    join v_region s on s.region_idx = from_region_idx join v_region d on d.region_idx = to_region_idx group by 1, 2""", "v_move", "v_region"))
def j2(v):
    counted = v.move().groupBy("from_region_idx", "to_region_idx").agg(F.count("*").alias("n"))
    src = v.region().select(F.col("region_idx").alias("from_region_idx"), F.col("name").alias("src_name"))
    dst = v.region().select(F.col("region_idx").alias("to_region_idx"), F.col("name").alias("dst_name"))
    return counted.join(src, "from_region_idx").join(dst, "to_region_idx").select("src_name", "dst_name", "n")


@case("j3_total_and_dominant", sql("""
    select t.period_idx, t.cell, t.pop, d.label as dominant from
      (select period_idx, cell, cast(sum(n) as bigint) as pop from v_cell_count group by 1, 2) t
      join (select period_idx, cell, arg_min(continent, {'a': -n, 'b': continent}) as label from v_cell_count group by 1, 2) d
        on d.period_idx = t.period_idx and d.cell = t.cell""", "v_cell_count"))
def j3(v):
    return totals_with_dominant(cell_counts(v), ["period_idx", "cell"], "continent", "pop", "dominant")


view("v_event_period", """
    select e.*, d.period_idx, d.period_year from v_event e join v_period d
      on e.start_year <= d.period_year and e.end_year >= d.period_year""", "v_event", "v_period")


@case("j4_events_in_period", sql("select id, period_idx, period_year from v_event_period", "v_event_period"))
def j4(v):
    return intervals.events_in_period(v.event(), PERIODS).select("id", "period_idx", "period_year")


view("v_wide_period", "select cast(i as int) as period_idx, cast(1994 + i * 3 as int) as period_year from (select unnest(range(3)) as i)")


@case("j4_events_in_period_overlap", sql("""
    select e.id, d.period_idx from v_event e join v_wide_period d
      on e.start_year <= d.period_year + 2 and e.end_year >= d.period_year""", "v_event", "v_wide_period"))
def j4_overlap(v):
    from geoflow.functions.periods import Periods

    return intervals.events_in_period(v.event(), Periods(1994, 2003, 3), "overlap").select("id", "period_idx")


view("v_region_event", """
    select x.id, r.region_idx from v_event_region x join v_region r on r.region_id = x.region_id""", "v_event_region", "v_region")


@case("j5_resolve_regions", sql("select id, region_idx from v_region_event", "v_region_event"))
def j5(v):
    return intervals.resolve_regions(v.event_region(), v.region())


@case("j5_unknown_regions", sql("""
    select id, region_id from v_event_region where region_id not in (select region_id from v_region)""", "v_event_region", "v_region"))
def j5_unknown(v):
    return intervals.unknown_regions(v.event_region(), v.region()).select("id", "region_id")


view("v_pull", """
    select p.id, s.region_idx as src_idx, d.region_idx as dst_idx, p.weight from v_event_pull p
    join v_region s on s.region_id = p.src_id join v_region d on d.region_id = p.dst_id
    where s.region_idx <> d.region_idx""", "v_event_pull", "v_region")


@case("j6_resolve_pulls", sql("select id, src_idx, dst_idx, weight from v_pull", "v_pull"))
def j6(v):
    return intervals.resolve_pulls(v.event_pull(), v.region())


@case("j7_region_pairs", sql("""
    select src_idx, dst_idx, round(a.pop_share * b.pop_share / ((km + 1500) * (km + 1500)), 9) as w
    from v_pair_all join v_region_pop a on a.region_idx = src_idx join v_region_pop b on b.region_idx = dst_idx""",
    "v_pair_all", "v_region_pop"))
def j7(v):
    pop = v.region_pop()
    src = pop.select(F.col("region_idx").alias("src_idx"), F.col("pop_share").alias("a"))
    dst = pop.select(F.col("region_idx").alias("dst_idx"), F.col("pop_share").alias("b"))
    paired = model.region_pairs(v.region()).join(src, "src_idx").join(dst, "dst_idx")
    return paired.select("src_idx", "dst_idx", F.round(gravity(F.col("a"), F.col("b"), F.col("distance_km")), 9).alias("w"))


WALK = """
    select s.lineage_id, 0 as depth, s.id, s.parent1_id from v_seed s
    union all
    select w.lineage_id, w.depth + 1, p.id, p.parent1_id from v_walk w join v_link p on p.id = w.parent1_id
    where w.depth < 13 and w.parent1_id <> -1"""
view("v_seed", """
    select cast(row_number() over (order by md5(cast(id as varchar)), id) - 1 as int) as lineage_id, *
    from (select * from v_link order by md5(cast(id as varchar)), id limit 50)""", "v_link")
view("v_walk(lineage_id, depth, id, parent1_id)", WALK, "v_seed", "v_link")


@case("o2_hash_sample", sql("select lineage_id, id from v_seed", "v_seed"))
def o2(v):
    return lineage.hash_sample(v.link(), 50).select("lineage_id", "id")


@case("j8_walk_ancestors", sql("select lineage_id, depth, id from v_walk", "v_walk(lineage_id, depth, id, parent1_id)"))
def j8(v):
    return lineage.walk_ancestors(v.link(), lineage.hash_sample(v.link(), 50)).select("lineage_id", "depth", "id")


# Events as ids of 50 periods: some are stored outside their period, some twice.
view("v_packed", f"""
    select {packed('event_id % 50', '0', 'event_id // 50')} as id, event_id as number,
           case when event_id < 7 + user_id % 40 then -1
                else {packed('(event_id - 7 - user_id % 40) % 50', '0', '(event_id - 7 - user_id % 40) // 50')} end as parent1_id,
           cast(case when event_id % 97 = 0 then 0 else event_id % 50 end as int) as period_idx
    from (select event_id, user_id from events union all select event_id, user_id from events where event_id % 89 = 0)""")
PACKED_WALK = """
    select cast(w.lineage_id as int) as lineage_id, 0 as depth, w.number, w.parent1_id
    from (select row_number() over (order by number) - 1 as lineage_id, * from v_packed where number % 40 = 5 and number % 89 <> 0) w
    union all
    select w.lineage_id, w.depth + 1, p.number, p.parent1_id from v_packed_walk w join v_packed p on p.id = w.parent1_id
    where w.depth < 13 and w.parent1_id <> -1 and p.period_idx = p.number % 50"""
view("v_packed_walk(lineage_id, depth, number, parent1_id)", PACKED_WALK, "v_packed")


def packed_links(v):
    at = F.col("event_id")
    up = at - 7 - F.col("user_id") % 40
    rows = v.table("events").select("event_id", "user_id")
    both = rows.unionByName(rows.where("event_id % 89 = 0"))
    return both.select(
        pack_id(at % 50, F.lit(0), F.floor(at / 50)).alias("id"), at.alias("number"),
        F.when(up < 0, F.lit(-1).cast("long")).otherwise(pack_id(up % 50, F.lit(0), F.floor(up / 50))).alias("parent1_id"),
        F.when(at % 97 == 0, 0).otherwise(at % 50).cast("int").alias("period_idx"))


@case("j8_walk_by_period", sql("select lineage_id, depth, number from v_packed_walk", "v_packed_walk(lineage_id, depth, number, parent1_id)"))
def j8_by_period(v):
    """A table by period, written as one, and a seed for every fortieth number."""
    path = fresh_path(v.spark, "links")
    write_facts(packed_links(v), path)
    links = v.spark.read.parquet(path)
    asked = links.where("number % 40 = 5 and number % 89 <> 0")
    seeds = shares.global_rank(asked, [F.col("number")], "_rank").withColumn("lineage_id", (F.col("_rank") - 1).cast("int")).drop("_rank")
    return lineage.walk_ancestors(links, seeds, period="period_idx").select("lineage_id", "depth", "number")


@case("o2_hash_sample_many", sql("""
    select cast(row_number() over (order by md5(cast(id as varchar)), id) - 1 as int) as lineage_id, id from (
      select l_orderkey * 10 + l_linenumber as id from lineitem) qualify lineage_id < 20000"""))
def o2_many(v):
    """More rows than one task numbers."""
    lines = v.table("lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"))
    return lineage.hash_sample(lines, 20_000).select("lineage_id", "id")


view("v_label_year", """
    select p.src_idx, p.dst_idx, y.year, arg_min(p.id, {'a': -p.weight, 'b': y.start_year, 'c': p.id}) as cause_label
    from v_pull p join v_event_year y on y.id = p.id where p.weight > 0 group by 1, 2, 3""", "v_pull", "v_event_year")


@case("j10_label_cause", sql("""
    select m.person_id, m.seq, coalesce(l.cause_label, 'baseline') as cause_label from v_move m
    left join v_label_year l on l.src_idx = m.from_region_idx and l.dst_idx = m.to_region_idx and l.year = m.year""", "v_move", "v_label_year"))
def j10(v):
    pulls = intervals.resolve_pulls(v.event_pull(), v.region())
    return intervals.label_cause(v.move().drop("cause_label"), v.event(), pulls).select("person_id", "seq", "cause_label")


@case("j11_orphans", sql("""
    select parent1_id as id, count(*) as children from v_link
    where parent1_id <> -1 and parent1_id not in (select id from v_link) group by 1""", "v_link"))
def j11(v):
    return lineage.orphans(v.link(), v.link(), "parent1_id")


@case("j11_orphans_dense", sql("""
    select l_orderkey as id, count(*) as children from lineitem
    where l_orderkey not in (select o_orderkey from orders where o_orderkey % 7 <> 3) group by 1"""))
def j11_dense(v):
    """Order keys without gaps, some of which are taken out, by bitmaps."""
    there = v.table("orders").where("o_orderkey % 7 <> 3").select(F.col("o_orderkey").alias("id"))
    return lineage.orphans(v.table("lineitem"), there, "l_orderkey", dense=True)


# --- aggregates -----------------------------------------------------------------

def cell_counts(v):
    from geoflow.functions.expr import cell_id

    people = living(v.person(), PERIODS).select(
        "period_idx", cell_id(F.col("birth_lat"), F.col("birth_lon")).alias("cell"), F.col("birth_region_idx").alias("region_idx")
    )
    counted = label_counts(people, ["period_idx", "cell"], "region_idx")
    named = counted.join(v.region().select("region_idx", "continent"), "region_idx")
    return named.groupBy("period_idx", "cell", "continent").agg(F.sum("n").alias("n"))


@case("a1_label_counts", sql("select period_idx, cell, continent, n from v_cell_count", "v_cell_count"))
def a1(v):
    return cell_counts(v)


@case("a2_cell_totals", sql("select period_idx, cell, cast(sum(n) as bigint) as pop from v_cell_count group by 1, 2", "v_cell_count"))
def a2(v):
    return cell_counts(v).groupBy("period_idx", "cell").agg(F.sum("n").alias("pop"))


@case("a3_dominant", sql("select period_idx, cell, arg_min(continent, {'a': -n, 'b': continent}) as label from v_cell_count group by 1, 2", "v_cell_count"))
def a3(v):
    from geoflow.operators.density import dominant

    return cell_counts(v).groupBy("period_idx", "cell").agg(dominant("continent", "n").alias("label"))


@case("a4_cause_counts", sql("select * from v_cause_count", "v_cause_count"))
def a4(v):
    return label_counts(v.move(), ROUTE, "cause_label")


@case("a5_corridor_totals", sql("select * from v_total", "v_total"))
def a5(v):
    return corridor_totals(v.move())


view("v_active", """
    select d.period_idx, d.period_year, count(e.id) as active_events, cast(0.005 as double) + cast(0.1 as double) * count(e.id) as intensity
    from v_period d left join v_event_period e on e.period_idx = d.period_idx group by 1, 2""", "v_period", "v_event_period")


@case("a6_active_counts", sql("select period_idx, period_year, active_events, round(intensity, 9) as intensity from v_active", "v_active"))
def a6(v):
    return intervals.active_counts(v.event(), PERIODS).withColumn("intensity", F.round("intensity", 9))


view("v_factor", """
    select d.period_idx, r.region_idx, greatest(1, coalesce(max(e.mortality), 1)) as mortality_factor,
           least(1, coalesce(min(e.birth), 1)) as birth_factor
    from v_period d cross join v_region r
    left join (select e.period_idx, x.region_idx, e.mortality, e.birth from v_event_period e join v_region_event x on x.id = e.id) e
      on e.period_idx = d.period_idx and e.region_idx = r.region_idx
    group by 1, 2""", "v_period", "v_region", "v_event_period", "v_region_event")


def factors(v):
    return intervals.event_factors(
        v.event(), intervals.resolve_regions(v.event_region(), v.region()), v.region(), PERIODS
    )


@case("a7_event_factors", sql("select * from v_factor", "v_factor"))
def a7(v):
    return factors(v)


view("v_pull_matrix", """
    select e.period_idx, p.src_idx, p.dst_idx, sum(p.weight) as pull
    from v_event_period e join v_pull p on p.id = e.id group by 1, 2, 3""", "v_event_period", "v_pull")


def pull_matrix(v):
    return intervals.pull_matrix(v.event(), intervals.resolve_pulls(v.event_pull(), v.region()), PERIODS)


@case("a8_pull_matrix", sql("select period_idx, src_idx, dst_idx, round(pull, 9) as pull from v_pull_matrix", "v_pull_matrix"))
def a8(v):
    return pull_matrix(v).withColumn("pull", F.round("pull", 9))


@case("a9_names_by_year", sql("select year, string_agg(name, '|' order by start_year, id) as names from v_event_year group by 1", "v_event_year"))
def a9(v):
    return intervals.names_by_year(v.event()).select("year", F.array_join("names", "|").alias("names"))


@case("a10_ordered_array", sql("""
    select period_idx, string_agg(from_region_idx || '>' || to_region_idx || ':' || migrations, ',' order by rank) as routes
    from v_ranked where rank <= 20 group by 1""", "v_ranked"))
def a10(v):
    best = top_per_period(corridor_totals(v.move()), "migrations", ["from_region_idx", "to_region_idx"], 20)
    text = F.concat(F.col("from_region_idx"), F.lit(">"), F.col("to_region_idx"), F.lit(":"), F.col("migrations"))
    listed = F.array_sort(F.collect_list(F.struct("rank", text.alias("text"))))
    return best.groupBy("period_idx").agg(F.array_join(F.transform(listed, lambda e: e["text"]), ",").alias("routes"))


@case("a11_global_share", """
    select c_custkey, round(c_acctbal / (select sum(c_acctbal) from customer), 12) as share from customer""")
def a11(v):
    return shares.global_share(v.table("customer"), "c_acctbal").select("c_custkey", F.round("share", 12).alias("share"))


@case("a12_row_share", """
    select l_orderkey, l_linenumber, round(l_extendedprice / sum(l_extendedprice) over (partition by l_suppkey), 12) as share from lineitem""")
def a12(v):
    items = v.table("lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")
    return shares.row_share(items, "l_extendedprice", ["l_suppkey"]).select("l_orderkey", "l_linenumber", F.round("share", 12).alias("share"))


@case("a15_plan_total", sql("select cast(sum(n) as bigint) as total from v_cohort_plan", "v_cohort_plan"))
def a15(v):
    return model.plan_total(v.cohort_plan())


view("v_node", """
    select w.lineage_id, w.depth, w.id as person_id, cast(2100 - w.depth * 7 as int) as year, l.region_idx,
           r.region_id, r.name as region_name, r.continent, r.lat, r.lon
    from v_walk w join v_link l on l.id = w.id join v_region r on r.region_idx = l.region_idx""",
    "v_walk(lineage_id, depth, id, parent1_id)", "v_link", "v_region")


def nodes(v):
    """The walk over events as a lineage table; years follow the depth."""
    walked = lineage.walk_ancestors(v.link(), lineage.hash_sample(v.link(), 50))
    return walked.join(v.region(), "region_idx").select(
        "lineage_id", "depth", F.col("id").alias("person_id"), (F.lit(2100) - F.col("depth") * 7).cast("int").alias("year"),
        "region_idx", "region_id", F.col("name").alias("region_name"), "continent", "lat", "lon",
    )


view("v_span", """
    select lineage_id, arg_max(region_name, depth) || ' → ' || arg_min(region_name, depth) as title,
           arg_max(year, depth) as first_year, arg_min(year, depth) as last_year, count(*) as nodes
    from v_node group by 1 having count(*) >= 2""", "v_node")


@case("a16_lineage_spans", sql("select * from v_span", "v_span"))
def a16(v):
    return lineage.lineage_spans(nodes(v))


@case("a17_lineage_path", sql("""
    select lineage_id, string_agg(cast(lon as varchar) || ' ' || cast(lat as varchar), ',' order by year) as path,
           arg_max(lon, year) as end_lon, arg_max(lat, year) as end_lat, min(year) as first_year, max(year) as last_year
    from v_node group by 1""", "v_node"))
def a17(v):
    joined = F.array_join(F.transform("path", lambda p: F.concat(p[0].cast("string"), F.lit(" "), p[1].cast("string"))), ",")
    return lineage.lineage_path(nodes(v)).withColumn("path", joined)


@case("p9_min_length", sql("select lineage_id, count(*) as nodes from v_node group by 1 having count(*) >= 5", "v_node"))
def p9(v):
    return lineage.min_length(nodes(v).groupBy("lineage_id").agg(F.count("*").alias("nodes")), 5)


@case("p10_lineage_visible", sql("""
    select lineage_id, case when lineage_id = 3 then 'selected' when lineage_id = 5 then 'hovered'
           when first_year <= 2044 and 2044 <= last_year + 25 then 'window' else 'dim' end as state from v_span""", "v_span"))
def p10(v):
    spans = lineage.lineage_spans(nodes(v))
    return lineage.lineage_visible(spans, 2044, selected=3, hovered=5).select("lineage_id", "state")


view("v_corridor", """
    select t.period_idx, cast(t.period_idx + 1995 as int) as period_year,
           s.region_id as src_id, s.name as src_name, s.lat as src_lat, s.lon as src_lon, s.continent as src_continent,
           d.region_id as dst_id, d.name as dst_name, d.lat as dst_lat, d.lon as dst_lon, d.continent as dst_continent,
           t.migrations, t.top_cause
    from v_ranked t join v_region s on s.region_idx = from_region_idx join v_region d on d.region_idx = to_region_idx
    join v_period p on p.period_idx = t.period_idx where rank <= 250""", "v_ranked", "v_region", "v_period")


def corridor_table(v, k=250):
    return corridors(v.move(), v.region(), PERIODS, k)


@case("p11_highlight", sql("""
    select period_idx, src_id, dst_id, case when top_cause = '2-HIGH' then cast(1 as double) else cast(0.18 as double) end as factor
    from v_corridor""", "v_corridor"))
def p11(v):
    return blend.highlight(corridor_table(v), "2-HIGH").select("period_idx", "src_id", "dst_id", "factor")


@case("p12_point_lookup", sql("select * from v_region_pop where region_id = 'nation_7'", "v_region_pop"))
def p12(v):
    return v.region_pop().where(F.col("region_id") == "nation_7")


# --- windows, folds and splits --------------------------------------------------

@case("w1_top_corridors", sql("select * from v_ranked where rank <= 25", "v_ranked"))
def w1(v):
    return top_per_period(corridor_totals(v.move()), "migrations", ["from_region_idx", "to_region_idx"], 25)


@case("w2_midpoint", sql("""
    select period_idx, region_idx, (coalesce(lag(n) over (partition by region_idx order by period_idx), n) + n) / cast(2 as double) as midpoint
    from v_cohort_plan""", "v_cohort_plan"))
def w2(v):
    return shares.midpoint(v.cohort_plan(), "n", ["region_idx"], "period_idx").select("period_idx", "region_idx", "midpoint")


@case("w3_logistic_fold", sql("""
    select region_idx, period_idx, round(value, 9) as value from v_fold""", "v_fold"))
def w3(v):
    plan = v.cohort_plan()
    first = plan.groupBy("region_idx").agg(F.min_by("n", "period_idx").cast("double").alias("start"))
    steps = plan.join(first, "region_idx").select(
        "region_idx", "period_idx", "start", (F.col("n") % 7 * F.lit(0.1) - F.lit(0.2)).alias("net"),
        (F.col("n") * F.lit(1.5)).alias("capacity"),
    )
    return model.logistic_fold(steps, "region_idx", "period_idx", "value").withColumn("value", F.round("value", 9))


view("v_step", """
    select region_idx, period_idx, row_number() over (partition by region_idx order by period_idx) as k,
           cast(first_value(n) over (partition by region_idx order by period_idx) as double) as start,
           n % 7 * cast(0.1 as double) - cast(0.2 as double) as net, n * cast(1.5 as double) as capacity
    from v_cohort_plan""", "v_cohort_plan")
GROWN = """greatest(f.value * (1 + s.net * greatest(cast(-0.5 as double),
               least(cast(1 as double), 1 - f.value / greatest(s.capacity, cast(1e-9 as double))))), f.value * 0.5)"""
view("v_fold", f"""
    select region_idx, period_idx, k, start as value from v_step where k = 1
    union all
    select s.region_idx, s.period_idx, s.k, {GROWN} from v_fold f join v_step s on s.region_idx = f.region_idx and s.k = f.k + 1""", "v_step")

view("v_apportion", """
    select c_custkey, w, w / sum(w) over () * 1000003 as part from (select c_custkey, c_acctbal + 1000 as w from customer)""")
view("v_apportion_rank", """
    select *, cast(floor(part) as bigint) as base, sum(floor(part)) over () as given,
           row_number() over (order by round(part - floor(part), 9) desc, c_custkey) as rank from v_apportion""", "v_apportion")


@case("w4_apportion", sql("""
    select c_custkey, base + case when rank <= 1000003 - given then 1 else 0 end as n from v_apportion_rank""", "v_apportion_rank"))
def w4(v):
    weighted = v.table("customer").select("c_custkey", (F.col("c_acctbal") + 1000).alias("w"))
    return shares.apportion(weighted, "w", 1_000_003, ["c_custkey"]).select("c_custkey", "n")


@case("w4_apportion_equal", sql("select c_custkey, cast(3 as bigint) as n from customer"))
def w4_equal(v):
    """Equal weights and a total that they divide: no row is ranked."""
    weighted = v.table("customer").select("c_custkey", F.lit(0.1).cast("double").alias("w"))
    return shares.apportion(weighted, "w", 3 * weighted.count(), ["c_custkey"]).select("c_custkey", "n")


@case("w4_apportion_ties", sql("""
    select c_custkey, cast(2 + case when row_number() over (order by c_custkey) <= (select count(*) // 3 from customer) then 1 else 0 end as bigint) as n
    from customer"""))
def w4_ties(v):
    """Equal weights and a total that they do not divide: the keys decide."""
    weighted = v.table("customer").select("c_custkey", F.lit(1.0).alias("w"))
    rows = weighted.count()
    return shares.apportion(weighted, "w", 2 * rows + rows // 3, ["c_custkey"]).select("c_custkey", "n")


def gamma_sql() -> str:
    from parity.views import u

    product = " * ".join(u("split", "period_idx", "region_idx", "slot", part=p) for p in range(4))
    return f"-ln({product})"


view("v_gamma", f"select period_idx, region_idx, n as mass, slot, {gamma_sql()} as g from v_cohort_plan cross join (select unnest(range(10)) as slot)", "v_cohort_plan")
view("v_part", "select *, g / sum(g) over (partition by period_idx, region_idx) as part from v_gamma", "v_gamma")
view("v_part_rank", """
    select *, cast(floor(part * mass) as bigint) as base, row_number() over (partition by period_idx, region_idx order by part desc) as rank,
           mass - sum(cast(floor(part * mass) as bigint)) over (partition by period_idx, region_idx) as short from v_part""", "v_part")


@case("w5_split_evenly", sql("""
    select period_idx, region_idx, cast(slot as int) as slot, base + case when rank <= short then 1 else 0 end as n from v_part_rank""", "v_part_rank"))
def w5(v):
    split = shares.split_evenly(v.cohort_plan().withColumnRenamed("n", "mass"), "mass", ["period_idx", "region_idx"], SEED, source="md5")
    return split.select("period_idx", "region_idx", "slot", "n")


@case("w6_ratio_to_max", sql("""
    select period_idx, from_region_idx, to_region_idx,
           round(migrations / cast(max(migrations) over (partition by period_idx) as double), 9) as ratio from v_total""", "v_total"))
def w6(v):
    rated = shares.ratio_to_max(corridor_totals(v.move()), "migrations", ["period_idx"])
    return rated.select(*ROUTE, F.round("ratio", 9).alias("ratio"))


@case("w7_node_order", sql("select lineage_id, string_agg(region_id, ',' order by year desc) as regions from v_node group by 1", "v_node"))
def w7(v):
    listed = F.array_sort(F.collect_list(F.struct((-F.col("year")).alias("y"), "region_id")))
    return nodes(v).groupBy("lineage_id").agg(F.array_join(F.transform(listed, lambda e: e["region_id"]), ",").alias("regions"))


# --- sorts and limits -----------------------------------------------------------

@case("o1_by_magnitude", sql("select * from v_density", "v_density"))
def o1(v):
    return by_magnitude(density(v.person(), v.region(), PERIODS), "pop", ["cell"])


@case("o4_top_arcs", sql("select * exclude (rank) from v_ranked where rank <= 60", "v_ranked"))
def o4(v):
    return top_per_period(corridor_totals(v.move()), "migrations", ["from_region_idx", "to_region_idx"], 60).drop("rank")


@case("o5_hot_cells", sql("select cell, pop from v_density where period_idx = 2 order by pop desc, cell limit 50", "v_density"))
def o5(v):
    return hot_cells(density(v.person(), v.region(), PERIODS), 2).select("cell", "pop")


@case("o5_strongest_corridor", sql("""
    select src_name, dst_name, migrations, top_cause from v_corridor where period_idx = 2
    order by migrations desc, src_id, dst_id limit 1""", "v_corridor"))
def o5_corridor(v):
    return strongest_corridor(corridor_table(v), 2).select("src_name", "dst_name", "migrations", "top_cause")


# --- unions ---------------------------------------------------------------------

def blend_part(period: int, weight: float) -> str:
    return f"""select * from (select period_idx, src_id, dst_id, migrations,
        round(migrations / cast(max(migrations) over () as double) * cast({weight} as double), 9) as intensity,
        row_number() over (order by migrations desc, src_id, dst_id) as k from v_corridor where period_idx = {period}) where k <= 42"""


@case("u1_blend_corridors", sql(f"""
    select period_idx, src_id, dst_id, migrations, intensity from ({blend_part(3, 1 - 0.3 * 0.4)} union all {blend_part(4, 0.6 + 0.3 * 0.4)})""", "v_corridor"))
def u1(v):
    table = corridor_table(v)
    both = blend.blend_corridors(table.where(F.col("period_idx") == 3), table.where(F.col("period_idx") == 4), 0.3, 42)
    return both.select("period_idx", "src_id", "dst_id", "migrations", F.round("intensity", 9).alias("intensity"))


@case("u2_cohorts_together", sql("select period_idx, region_idx, count(*) as n, max(i) as last from v_expanded group by 1, 2", "v_expanded"))
def u2(v):
    """Early and late cohorts made apart and put together are all cohorts."""
    plan = v.cohort_plan()
    early, late = plan.where(F.col("period_idx") < 3), plan.where(F.col("period_idx") >= 3)
    keys = ["period_idx", "region_idx"]
    both = expand(early, keys).unionByName(expand(late, keys))
    return both.groupBy(*keys).agg(F.count("*").alias("n"), F.max("i").alias("last"))
